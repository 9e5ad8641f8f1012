"""Toxicity by a classifier chain: each linear model sees the words and the probabilities of the categories before it."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, by_value, filter_texts, mapped, one_text_each, stash

by_value(__name__)

#: At most so many labelled rows are learned from (a task holds them), and so many terms kept for each category.
SAMPLE, TERMS, FOLDS = 20_000, 2_000, 3
#: A term that fewer of those rows have isn't learned.
LEAST = 5
REJECT = 0.5
_WORD, _SIGNS = re.compile(r"\w+"), re.compile(r"[^\w\s]+")


def terms(text: str | None) -> set[str]:
    """Words in lower case, their beginnings (inflected forms share them) and runs of signs; of the whole text."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {f"4:{w[:4]}" for w in words if len(w) > 4} | {f"5:{w[:5]}" for w in words if len(w) > 5} | {f"~{s}" for s in _SIGNS.findall(text or "")}


class Linear:
    """Logistic regression with an L2 penalty on rows of term numbers (sparse, 0/1) and a few dense columns."""

    def __init__(self, width: int, dense: int):
        self.w, self.v, self.b = np.zeros(width), np.zeros(dense), 0.0

    def fit(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 150) -> Linear:
        n, width = len(y), len(self.w)
        if n == 0:
            return self
        rate = np.clip(y.mean(), 1 / (n + 2), 1 - 1 / (n + 2))
        self.b = float(np.log(rate / (1 - rate)))
        if y.min() == y.max():
            return self
        seen = np.bincount(cols, minlength=width)
        lip_w, lip_v = 0.25 * seen + penalty, 0.25 * (dense**2).sum(0) + penalty  # a diagonal bound on the curvature
        scale = 1.0 + np.bincount(rows, minlength=n).mean() + dense.shape[1]
        m = [np.zeros(width), np.zeros(dense.shape[1]), 0.0]
        for step in range(steps):
            z = np.bincount(rows, self.w[cols], n) + dense @ self.v + self.b
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            grad = (np.bincount(cols, g[rows], width) + penalty * self.w, dense.T @ g + penalty * self.v, g.sum())
            rate_ = 4.0 / scale
            m = [0.9 * a + b for a, b in zip(m, (grad[0] / lip_w, grad[1] / lip_v, grad[2] / (0.25 * n)), strict=True)]
            self.w -= rate_ * m[0]
            self.v -= rate_ * m[1]
            self.b -= rate_ * m[2]
        return self

    def predict(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, self.w[cols], len(dense)) + dense @ self.v + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """Linear models in the order of the categories. The earlier probabilities that a model is fitted on are out of fold."""

    def __init__(self, vocabulary: list[str], categories: list[str]):
        self.index, self.categories, self.models = {t: i for i, t in enumerate(vocabulary)}, categories, []
        self.vocabulary = frozenset(vocabulary)

    def fit(self, found: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, each: Callable = map) -> Chain:
        """found: the numbers of each row's terms; each: how the fits of one category, which don't need one another, are run."""
        n, width = len(found), len(self.index)
        sizes, cols = np.array([len(f) for f in found], np.int32), np.concatenate([*found, np.zeros(0, np.int32)])
        earlier = np.zeros((n, 0))
        for k in range(len(self.categories)):
            jobs = Fits(width, sizes, cols, earlier, labels[:, k], fold)
            *outside, whole = each(jobs, [*range(FOLDS), None])
            out = np.zeros(n)
            for f, (*_, p) in enumerate(outside):
                out[fold == f] = p
            model = Linear(width, k)
            model.w, model.v, model.b = whole[0], whole[1], float(whole[2][0])
            self.models.append(model)
            earlier = np.column_stack([earlier, out])
        return self

    def predict(self, texts) -> np.ndarray:
        found = [[self.index[t] for t in terms(x) & self.vocabulary] for x in texts]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        cols = np.array([c for f in found for c in f], np.int64)
        out = np.zeros((len(found), 0))
        for model in self.models:
            out = np.column_stack([out, model.predict(rows, cols, out)])
        return out


class Fits:
    """The fits of one category: called with a fold, the weights (of terms, of earlier categories, and the constant) that the
    other folds teach, and what they say of this one; with None, those of all rows. It travels to tasks: term numbers take
    two bytes each, and rows are told by their sizes."""

    def __init__(self, width: int, sizes: np.ndarray, cols: np.ndarray, earlier: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.width, self.sizes, self.cols = width, sizes.astype(np.int32), cols.astype(np.uint16 if width <= 65_536 else np.int32)
        self.earlier, self.y, self.fold = earlier, y.astype(np.int8), fold.astype(np.int8)

    def __call__(self, f: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows, cols = np.repeat(np.arange(len(self.sizes)), self.sizes), self.cols.astype(np.int64)
        inside = np.ones(len(self.y), bool) if f is None else self.fold != f
        use, seen, unseen = inside[rows], np.cumsum(inside) - 1, np.cumsum(~inside) - 1
        model = Linear(self.width, self.earlier.shape[1]).fit(seen[rows[use]], cols[use], self.earlier[inside], self.y[inside].astype(float))
        return model.w, model.v, np.array([model.b]), model.predict(unseen[rows[~use]], cols[~use], self.earlier[~inside])


def in_tasks(spark: SparkSession) -> Callable:
    """A map whose calls are Spark tasks; function and results are of bounded size."""

    def each(function, values: list) -> list:
        sent = Sent(spark, (function, values))

        def start():
            f, all_ = sent()
            return lambda part: (None, [[pickle.dumps(f(all_[i])) for i in part.column("i").to_pylist()]])

        numbered = spark.range(0, len(values), 1, len(values)).select(F.col("id").alias("i"))
        got = dict(mapped(numbered, ["i"], {"out": "binary"}, start, 1).collect())
        return [pickle.loads(got[i]) for i in range(len(values))]

    return each


def _terms_of():
    return lambda part: (None, [[sorted(terms(t)) for t in part.column("text").to_pylist()]])


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, width: int = TERMS) -> Chain:
    """A chain for the 0/1 columns `categories` of labels (doc_id, ...), in that order.

    Learns from at most `sample` labelled rows (a documented bound: those least by a hash of doc_id); rows with a null
    category or doc_id are left out, a doc_id labelled twice counts once, with its largest labels, and of a doc_id
    that stands more than once one text is learned from, the least by its hash. The terms kept are the `width` of each category whose counts, taken in Spark over
    these rows, depend on it most by chi-square (the first by name of those that do so equally). Without labels every
    probability is one half.
    """
    whole = labels.select(F.col("doc_id").cast("long").alias("_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    whole = whole.groupBy("_id").agg(*[F.max(c).alias(c) for c in categories])
    chosen = F.broadcast(whole.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = one_text_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("_id")))
    found = stash(mapped(rows, ["doc_id"], {"terms": "array<string>"}, _terms_of), "terms")
    known = {r["_id"]: [r[c] for c in categories] for r in chosen.collect()}
    n, positive = len(known), np.array(list(known.values()), float).reshape(-1, len(categories)).sum(0)
    each = found.join(chosen, F.col("doc_id") == F.col("_id")).select(F.explode("terms").alias("term"), *categories)
    counted = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).where(F.col("n") >= LEAST)
    counted = stash(counted, "term-counts")
    vocabulary: set[str] = set()
    for c, p in zip(categories, positive, strict=True):
        expected = F.col("n") * float(p) / max(n, 1)
        chi = (F.col(c) - expected) ** 2 / (expected * (1 - F.col("n") / (n + 1.0)) + 1e-9)
        vocabulary |= {r["term"] for r in counted.orderBy(chi.desc(), "term").limit(width).select("term").collect()}
    ordered = sorted(vocabulary)
    chain = Chain(ordered, categories)
    sent = Sent(docs.sparkSession, chain.index)

    def numbers():
        index = sent()
        return lambda part: (None, [[np.array([index[t] for t in ts if t in index], "<i4").tobytes() for ts in part.column("terms").to_pylist()]])

    data = mapped(found, ["doc_id"], {"numbers": "binary"}, numbers).orderBy("doc_id", "numbers").collect()
    rows_ = [np.frombuffer(r["numbers"], "<i4") for r in data]
    y = np.array([known[r["doc_id"]] for r in data], float).reshape(-1, len(categories))
    fold = np.array([hash(r["doc_id"]) * 2654435761 % 2**32 % FOLDS for r in data], np.int64)
    return chain.fit(rows_, y, fold, in_tasks(docs.sparkSession))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> for every whole text.

    Null and empty texts get what the terms' absence tells; repeated rows repeat, a null doc_id stays null, an empty
    table gives an empty result.
    """
    sent = Sent(docs.sparkSession, chain)

    def start():
        chain = sent()
        return lambda part: (None, list(chain.predict(part.column("text").to_pylist()).T))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(rows, ["doc_id"], {f"p_{c}": "double" for c in chain.categories}, start)


def label_categories(labels: DataFrame) -> DataFrame:
    """The chain's categories from the label table: first low quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))


CATEGORIES = ["low_quality", "toxic"]


def keep_clean(docs: DataFrame, chain: Chain, reject: float = REJECT) -> DataFrame:
    """documents whose last category is less likely than `reject`; all columns and kept rows as they were.

    Null and empty texts are judged by the terms' absence, like any text; repeated rows and rows without a doc_id stay
    or go by their text; an empty table stays empty.
    """
    sent = Sent(docs.sparkSession, chain)

    def start():
        fitted = sent()
        return lambda texts: fitted.predict(texts)[:, -1] < reject

    return filter_texts(docs, start)

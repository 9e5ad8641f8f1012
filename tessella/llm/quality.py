"""Quality by nearest-neighbour voting: exact cosines of every document with labelled latent-semantic vectors."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, by_value, mapped, one_text_each, stash

by_value(__name__)

#: At most so many labelled rows are voters (a bound that also bounds what is broadcast), of so many latent dimensions.
SAMPLE, RANK, NEIGHBOURS = 6_000, 64, 25
#: Hashed columns for words, and for forms: signs, cases, lengths.
WORDS, FORMS = 2_048, 512
#: Similarity counts to this power in the vote, so that the closest lead.
SHARP = 4
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Columns(dict):
    """Column of a word, or columns of its form."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        if token[0].isalnum() or token[0] == "_":
            case = "U" if token.isupper() else "l" if token.islower() else "T" if token.istitle() else "d" if token.isdigit() else "m"
            form = f"{case}{min(len(token), 20) // 3}"
            out = zlib.crc32(token.lower().encode()) % WORDS, WORDS + zlib.crc32(form.encode()) % FORMS
        else:
            out = -1, WORDS + zlib.crc32(token[:4].encode()) % FORMS
        self[token] = out
        return out


def term_counts(text: str | None, columns: Columns) -> tuple[np.ndarray, np.ndarray]:
    """Columns and log-scaled counts of the whole text: words and forms each of norm 1 before weighting."""
    seen: Counter = Counter()
    for token, n in Counter(_TOKEN.findall(text or "")).items():
        word, form = columns[token]
        seen[form] += n
        if word >= 0:
            seen[word] += n
    cols = np.fromiter(seen.keys(), np.int64, len(seen))
    vals = 1 + np.log(np.fromiter(seen.values(), float, len(seen)))
    return cols, vals


def _sparse():
    columns = Columns()

    def make(part: pa.RecordBatch):
        both = [term_counts(t, columns) for t in part.column("text").to_pylist()]
        return None, [[c.astype("<u2").tobytes() for c, _ in both], [v.astype("<f4").tobytes() for _, v in both]]

    return make


class Space:
    """tf-idf weights, then the leading right singular vectors of the labelled rows."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], rank: int, seed: int = 7):
        n, width = len(rows), WORDS + FORMS
        df = np.bincount(np.concatenate([c for c, _ in rows]), minlength=width) if rows else np.zeros(width)
        self.idf = np.log((1 + n) / (1 + df)) + 0.1
        x = np.zeros((n, width), np.float32)
        for i, (c, v) in enumerate(rows):
            x[i, c] = self._weigh(c, v)
        rng = np.random.default_rng(seed)
        q = rng.standard_normal((width, min(rank + 16, width))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q)) if n else (q, None)
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = (q @ vt[:rank].T).astype(np.float32)
        self.labelled = self._unit(x @ self.basis)

    def _weigh(self, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
        out = vals * self.idf[cols]
        word = cols < WORDS
        for part in (word, ~word):
            if norm := float(np.sqrt((out[part] ** 2).sum())):
                out[part] /= norm
        return out

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def place(self, texts, columns: Columns) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        for i, t in enumerate(texts):
            c, v = term_counts(t, columns)
            if len(c):
                out[i] = self._weigh(c, v) @ self.basis[c]
        return self._unit(out)


class Voters:
    """Labelled vectors and their labels."""

    def __init__(self, space: Space, y: np.ndarray, neighbours: int):
        self.space, self.y, self.neighbours = space, y.astype(np.float32), min(neighbours, len(y))
        self.prior = float(y.mean()) if len(y) else 0.5

    def vote(self, points: np.ndarray) -> np.ndarray:
        """Mean label of the nearest voters, by similarity; the share of label 1 where nothing is similar."""
        if not self.neighbours:
            return np.full(len(points), self.prior)
        out, labelled = np.empty(len(points)), self.space.labelled.astype(float)
        for i in range(0, len(points), 256):
            sims = np.round(points[i : i + 256].astype(float) @ labelled.T, 12)
            last = np.partition(sims, -self.neighbours, axis=1)[:, [-self.neighbours]]
            nearer, tied = sims > last, sims == last
            left = self.neighbours - nearer.sum(1, keepdims=True)
            near = np.nonzero(nearer | tied & (np.cumsum(tied, 1, dtype=np.int32) <= left))[1].reshape(len(sims), -1)
            w = np.maximum(np.take_along_axis(sims, near, 1), 0) ** SHARP
            total = w.sum(1)
            out[i : i + 256] = np.where(total > 0, (w * self.y[near]).sum(1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train_voters(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Voters:
    """Voters from at most `sample` labelled rows that aren't held out (a documented bound; those least by a hash of doc_id).

    Rows without a doc_id or a label are left out; a doc_id labelled twice counts once, as good if one label says so. Of
    a doc_id that stands more than once one text votes, the least by its hash. Without labels, there are no voters.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("y")).dropna()
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.max("y").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("_id"))
    found = stash(mapped(one_text_each(rows), ["doc_id"], {"cols": "binary", "vals": "binary"}, _sparse), "sparse")
    y = {r["_id"]: r["y"] for r in chosen.collect()}
    data = found.orderBy("doc_id").collect()
    sparse = [(np.frombuffer(r["cols"], "<u2").astype(np.int64), np.frombuffer(r["vals"], "<f4").astype(float)) for r in data]
    return Voters(Space(sparse, rank), np.array([y[r["doc_id"]] for r in data], float), neighbours)


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    An empty or null text, alike to nothing, gets the share of label 1 (0.5 without voters). Repeated rows give repeated
    results; a null doc_id stays null and isn't held out; an empty table gives an empty result. Of voters that are
    equally near to a text (to twelve digits), and can't all be among the nearest, those with the least doc_id vote.
    """
    sent = Sent(docs.sparkSession, voters)

    def start():
        columns, voters = Columns(), sent()
        return lambda part: (None, [voters.vote(voters.space.place(part.column("text").to_pylist(), columns))])

    scored = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], {"score": "double"}, start)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

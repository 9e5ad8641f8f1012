"""Retrieval: BM25 over postings, dense similarity, rank fusion, reranking, diverse selection, chunking."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions import constants as C
from tessella.functions import text as X
from tessella.functions.shared import written
from tessella.functions.shipping import by_value

from .position import if_small, top

by_value(__name__)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, term, tf): the text's terms, and how often each stands in it. A key names one text.

    A text's terms are counted where it is read, a batch of texts at a time; nothing is shuffled.
    """
    terms = docs.select(key, X.words(F.col(text)).alias("terms")).withColumn("size", F.size("terms")).where("size > 0")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words = batch.column("size").to_numpy(), batch.column("terms").flatten().dictionary_encode()
            many = max(1, len(words.dictionary))
            pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * many + words.indices.to_numpy(), return_counts=True)
            row, term = pa.array(pairs // many), pa.array(pairs % many)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(row), batch.column("size").take(row), words.dictionary.take(term), pa.array(tf, pa.int64())], names=[key, "size", "term", "tf"])

    return terms.mapInArrow(counted, f"`{key}` {dict(docs.dtypes)[key]}, size int, term string, tf long")


def corpus_size(docs: DataFrame, text: str) -> tuple[int, float]:
    """The number of texts and their mean number of terms (1 if none has any), in one pass."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(X.words(F.col(text)))), F.lit(0)).alias("words")).first()
    return row["n"], round(row["words"] / row["n"], 9) if row["words"] else 1.0


def used_postings(docs: DataFrame, key: str, text: str, queries: DataFrame) -> tuple[DataFrame, int, float]:
    """The postings of the queries' terms, written, and what corpus_size tells, from one pass over the texts.

    queries: (query, term). Words are told apart where a text is read and all but the queries' go there; each text also has an
    empty term, which no word is, so that texts without any of them are counted.
    """
    empty = F.array(F.lit(""))
    terms = docs.select(key, F.coalesce(X.words(F.col(text)), F.array().cast("array<string>")).alias("words")).withColumn("size", F.size("words"))
    each = terms.select(key, "size", F.explode(F.concat("words", empty)).alias("term"))
    wanted = queries.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    counted = each.join(if_small(written(wanted)), "term", "left_semi").groupBy(key, "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = written(counted)
    row = counted.where("term = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("tf") * F.col("size")), F.lit(0)).alias("words")).first()
    mean = round(row["words"] / row["n"], 9) if row["words"] else 1.0
    return counted.where("term <> ''"), row["n"], mean


def bm25(post: DataFrame, n_docs: int, mean_size: float, queries: DataFrame, key: str, k: int, known: DataFrame | None = None) -> DataFrame:
    """The k best texts of each query by BM25 (Robertson's formula): query, key, score, rank from 0.

    queries: (query, term), distinct. Only postings of the queries' terms are kept, before anything is shuffled. known: (term,
    df), where an index holds how many texts each term stands in.
    """
    used = post.join(if_small(queries.select("term").distinct()), "term", "left_semi")
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if known is None else known
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = queries.join(df, "term").select("query", "term", idf.alias("idf"))
    norm = F.col("tf") + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("size") / mean_size)
    weighted = used.join(if_small(written(asked)), "term").withColumn("w", F.col("idf") * F.col("tf") * (C.BM25_K1 + 1) / norm)
    scores = weighted.groupBy("query", key).agg(F.round(F.sum("w"), 9).alias("score"))
    return top(scores, "query", [F.desc("score"), F.col(key)], k).withColumn("rank", F.col("rank") - 1)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector at norm 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v.cast("array<double>"), lambda x: x / norm)).otherwise(v.cast("array<double>"))


#: Rows, and queries, that one task multiplies at a time.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 32_768


def _doubles(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The components of all vectors in a row, where each vector begins, and its length: -1 for null and for a null component."""
    parts = vectors.flatten()
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    begins = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, int)
    known = np.where(np.asarray(vectors.is_null()), -1, lengths)
    if parts.null_count:
        gaps = np.flatnonzero(np.asarray(parts.is_null()))
        known[np.searchsorted(begins + lengths, gaps, "right")] = -1
    return np.asarray(parts.fill_null(0.0), float), begins, known


def _least_of_copies(keys: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that may be among the k first of a query: of equal vectors those of the k + 1 least keys, of equal keys k.

    keys are in order, so the order of rows is kept."""
    if x.shape[1] == 0:
        groups = np.zeros(len(x), int)
    else:
        groups = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(groups, kind="stable")
    g, at = groups[order], np.arange(len(order))
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    other = first | np.r_[True, keys[order][1:] != keys[order][:-1]] if len(g) else first
    number = np.cumsum(other)
    number = number - number[np.maximum.accumulate(np.where(first, at, 0))]
    repeat = at - np.maximum.accumulate(np.where(other, at, 0))
    return np.sort(order[(number <= k) & (repeat < k)])


def _first_others(begin: np.ndarray, end: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row): the first k of n rows for each query, those from begin to end left out."""
    row = np.arange(k) + np.where(np.arange(k) >= begin[:, None], (end - begin)[:, None], 0)
    query, place = np.nonzero(row < n)
    return query, row[query, place]


def _likely(x: np.ndarray, q: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, query - i, row) of what may be among the k largest products of each query, or within 2e-9 of them, 256 queries from i at a time.

    A matrix product finds it, in single precision where lengths of rows are alike: rows go to 64 strides, and the k-th of the largest
    products of each group is at most the k-th of all, so that only groups which reach it, less rounding, are looked into. Rows that aren't finite
    are likely for all; a query whose products are all 0, or no number, has the first rows."""
    n, width = x.shape
    odd = np.flatnonzero(~np.isfinite(x).all(1))
    norms, lengths = np.sqrt((np.delete(x, odd, 0) ** 2).sum(1)), np.sqrt((q * q).sum(1))
    largest, longest = norms.max(initial=0.0), np.nanmax(lengths, initial=0.0)
    kind = np.float32 if len(norms) and largest <= 8 * np.median(norms) and max(largest, longest, largest * longest) < 1e30 else np.float64
    groups = max(k, -(-n // 64))
    strides = -(-n // groups)
    columns, questions = np.zeros((width, groups * strides), kind), q.astype(kind)
    columns[:, :n] = x.T
    columns[:, odd] = 0
    held = np.empty((256, groups * strides), kind)
    flat = np.isnan(q).any(1) | (q == 0).all(1)
    for i in range(0, len(q), 256):
        lo, hi, some = begin[i : i + 256], end[i : i + 256], flat[i : i + 256]
        s = np.matmul(questions[i : i + 256], columns, out=held[: len(lo)])
        s[:, n:], s[:, odd] = -np.inf, -np.inf
        own = [(r, lo[r], hi[r]) for r in np.flatnonzero(hi > lo)]
        for r, first, last in own:
            s[r, first:last] = -np.inf
        s = s.reshape(len(lo), strides, groups)
        high = s.max(1)
        slack = 2e-9 + 4 * width * np.finfo(kind).eps * largest * lengths[i : i + 256]
        least = np.partition(high, groups - k, 1)[:, groups - k] - slack
        a, g = np.nonzero(~(high < least[:, None]) & ~some[:, None])  # what isn't a number is likely
        one, stride = np.nonzero(~(s[a, :, g] < least[a, None]))
        a, b = a[one], stride * groups + g[one]
        few, first = _first_others(lo[some], hi[some], n, k)
        a, b = np.r_[a, np.flatnonzero(some)[few], np.repeat(np.arange(len(lo)), len(odd))], np.r_[b, first, np.tile(odd, len(lo))]
        fits = (b < n) & ~((b >= lo[a]) & (b < hi[a]))
        a, b = np.divmod(np.unique(a[fits] * max(1, n) + b[fits]), max(1, n))
        yield i, a, b


def _best_products(x: np.ndarray, q: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, product): each query's k largest products, the first rows among equal ones, and what lies so near the k-th that
    nine digits may not part them. Rows from begin to end have the query's own key. Matrix products find candidates (see _likely); the
    products returned are summed component by component, as `dot` does."""
    columns, found = np.ascontiguousarray(x.T), []
    for i, a, b in _likely(x, q, begin, end, k):
        rows, product = np.ascontiguousarray(q[i : i + 256].T), np.zeros(len(a))
        for d in range(x.shape[1]):
            product += columns[d, b] * rows[d, a]
        missing = np.isnan(product)
        order = np.lexsort((b, -product, ~missing, a))
        a, b, product = a[order], b[order], product[order]
        place = np.arange(len(a)) - np.searchsorted(a, a, "left")
        last = np.full(rows.shape[1], np.nan)
        last[a[place == k - 1]] = product[place == k - 1]
        keep = (place < k) | (product >= last[a] - 2e-9)
        found.append((a[keep] + i, b[keep], product[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def best_in_blocks(rows: DataFrame, asked: DataFrame, key: str, k: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """The k largest inner products of each query with the rows of the blocks that it asks, its own key left out: query, key, score, rank.

    rows: (key, vector, block), at most about BLOCK_ROWS a block; asked: (query, q, block). A task multiplies a block by at most
    about BLOCK_QUERIES queries and returns k rows of each, so that pairs are never dealt. shape: into how many blocks (numbered
    from 0) rows are dealt and into how many parts queries, if known; each pair of them then has a task of its own, since by bytes few
    tasks would hold all. A vector that isn't as long as the query, is null or holds a null has a null score.
    """
    types, wants = dict(rows.dtypes), dict(asked.dtypes)
    parts = shape[1] if shape else max(1, -(-asked.select("query").distinct().count() // BLOCK_QUERIES))
    kind = "array<float>" if {types["vector"], wants["q"]} == {"array<float>"} else "array<double>"
    numbers = lambda c: F.col(c).cast(kind).alias("_v")
    of = F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    both = rows.where(F.col(key).isNotNull()).select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.col(key).alias("_key"), none(wants["query"], "_query"), numbers("vector"), F.lit(False).alias("_asks"))
    both = both.unionByName(asked.where("query IS NOT NULL").select("block", of.alias("_part"), none(types[key], "_key"), F.col("query").alias("_query"), numbers("q"), F.lit(True).alias("_asks")))
    schema = pa.schema([("query", to_arrow_type(asked.schema["query"].dataType)), (key, to_arrow_type(rows.schema[key].dataType)), ("product", pa.float64())])

    def multiplied(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group["_asks"]
        mine, base = group.filter(asks), group.filter(pc.invert(asks)).sort_by("_key")
        out = []
        if mine.num_rows and base.num_rows:
            queries, keys = (t[c].combine_chunks() for t, c in ((mine, "_query"), (base, "_key")))
            names, own = (a.to_numpy(zero_copy_only=False) for a in (keys, queries))
            (v, v_at, v_long), (q, q_at, q_long) = (_doubles(t["_v"].combine_chunks()) for t in (base, mine))

            def add(a: np.ndarray, b: np.ndarray, product: pa.Array) -> None:
                out.append(pa.table([queries.take(pa.array(a)), keys.take(pa.array(b)), product], schema=schema))

            between = lambda rows, asks: tuple(np.searchsorted(names[rows], own[asks], side) for side in ("left", "right"))
            for width in np.unique(q_long):
                some, fit = np.flatnonzero(q_long == width), np.flatnonzero((v_long == width) & (width >= 0))
                few = some
                if len(fit):
                    x = v[v_at[fit][:, None] + np.arange(width)]
                    x[np.isnan(x).any(1)] = np.nan  # alike: no product with them is a number
                    kept = _least_of_copies(names[fit], x, k)
                    x, fit = x[kept], fit[kept]
                    begin, end = between(fit, some)
                    a, b, product = _best_products(x, q[q_at[some][:, None] + np.arange(width)], begin, end, k)
                    add(some[a], fit[b], pa.array(product))
                    few = some[len(fit) - (end - begin) < k]
                rest = np.flatnonzero((v_long != width) | (width < 0))
                if len(rest) and len(few):  # no score, and so last: the first k keys other than the query's
                    a, b = _first_others(*between(rest, few), len(rest), k)
                    add(few[a], rest[b], pa.nulls(len(b), pa.float64()))
        return pa.concat_tables(out) if out else schema.empty_table()

    both = both.select((F.col("block") * parts + F.col("_part")).alias("_task"), "_key", "_query", "_v", "_asks")
    both = both.repartitionById(shape[0] * parts, "_task") if shape else both
    found = both.groupBy("_task").applyInArrow(multiplied, f"query {wants['query']}, `{key}` {types[key]}, product double")
    return top(found.select("query", key, F.round("product", 9).alias("score")), "query", [F.desc("score"), F.col(key)], k)


def dense_top(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float | None = None) -> DataFrame:
    """The k most similar vectors of each query (query, q): query, key, score, rank from 0.

    All queries meet all rows, in blocks that a task multiplies (see best_in_blocks): what is shuffled is each row once for
    BLOCK_QUERIES queries, each query for each block, and k rows of a query for each block. Queries are parted before rows are, for 32
    tasks at least.
    """
    n, asks = base.count(), queries.select("query").distinct().count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    parts = max(1, -(-asks // BLOCK_QUERIES), min(-(-32 // blocks), -(-asks // 2048)))
    blocks = max(blocks, min(-(-32 // parts), -(-n // 2048)))
    rows = base.select(key, F.col(vector).alias("vector"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    asked = queries.select("query", "q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = best_in_blocks(rows, asked, key, k, (blocks, parts))
    if least is not None:
        found = found.where(F.col("score") >= least)
    return found.withColumn("rank", F.col("rank") - 1)


def fuse(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of (query, key, rank from 0): the k best by the sum of 1 / (60 + rank)."""
    all_ = lists[0].select("query", key, "rank")
    for more in lists[1:]:
        all_ = all_.unionByName(more.select("query", key, "rank"))
    scores = all_.groupBy("query", key).agg(F.round(F.sum(1 / (C.RRF_K + F.col("rank"))), 12).alias("score"))
    return top(scores, "query", [F.desc("score"), F.col(key)], k).withColumn("rank", F.col("rank") - 1)


def diverse(candidates: DataFrame, key: str, vector: str, n: int, weight: float = C.LAMBDA) -> DataFrame:
    """Maximal marginal relevance: n times the candidate with the largest weight * score - (1 - weight) * similarity to
    those chosen. candidates: (query, key, score, vector), a bounded list for each query; each round adds one row each.

    The candidates and each round's choice are written, since every later round reads them."""
    candidates, chosen = written(candidates), None
    for step in range(n):
        if chosen is None:
            worth = candidates.withColumn("mmr", weight * F.col("score"))
        else:
            old = chosen.select("query", F.col(key).alias("_k"), F.col(vector).alias("_v"))
            near = candidates.join(old, "query").groupBy("query", key).agg(F.max(dot(F.col(vector), F.col("_v"))).alias("near"), F.max((F.col(key) == F.col("_k")).cast("int")).alias("taken"))
            worth = candidates.join(near.where("taken = 0").drop("taken"), ["query", key]).withColumn("mmr", weight * F.col("score") - (1 - weight) * F.col("near")).drop("near")
        best = top(worth.withColumn("mmr", F.round("mmr", 9)), "query", [F.desc("mmr"), F.desc("score"), F.col(key)], 1).drop("rank").withColumn("step", F.lit(step))
        best = written(best) if step < n - 1 else best
        chosen = best if chosen is None else chosen.unionByName(best)
    return chosen


def overlap_top(docs: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """The k texts of each query that share most of its distinct words. docs: (key, term), queries: (query, term), both distinct."""
    shared = docs.join(if_small(queries), "term").groupBy("query", key).agg(F.count(F.lit(1)).alias("shared"))
    return top(shared, "query", [F.desc("shared"), F.col(key)], k)


def _bare(term: str) -> str:
    """A term without accents (the d with stroke stays)."""
    return "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))


def expansions() -> list[tuple[str, list[tuple[str, list[str]]]]]:
    """(canonical term, [(unaccented term, what it adds)]): the first term that a query holds adds the canonical one and the first
    two of the group's others."""
    return [(term, [(_bare(v), [term, *[o for o in others if o != v][:2]]) for v in [*others, term]]) for term, others in C.SYNONYMS.items()]


def expanded(query: Column, most: int = 6) -> Column:
    """A query with what its synonyms add, `most` terms of all at most; a group whose canonical term it spells out adds nothing.

    Terms are found in the unaccented query, where no letter, digit or underscore touches them: words are put between marks
    on both sides, so that a term with its marks is a plain part of the text.
    """
    groups = [{"term": term, "rules": [{"mark": re.sub(r"(\w+)", "\x01\\1\x01", v), "adds": adds} for v, adds in rules]} for term, rules in expansions()]
    groups = F.from_json(F.lit(json.dumps(groups)), "array<struct<term:string,rules:array<struct<mark:string,adds:array<string>>>>>")
    low = F.lower(query)
    marked = F.regexp_replace(F.regexp_replace(X.folded(low), r"\p{M}", ""), r"([\p{L}\p{N}_]+)", "\x01$1\x01")
    none = F.array().cast("array<string>")
    adds = lambda q, g: F.when(q["low"].contains(g["term"]), none).otherwise(F.coalesce(F.get(F.filter(g["rules"], lambda r: q["marked"].contains(r["mark"])), F.lit(0))["adds"], none))
    both = F.array(F.struct(low.alias("low"), marked.alias("marked")))  # so that each is made once
    extra = F.get(F.transform(both, lambda q: F.slice(F.flatten(F.transform(groups, lambda g: adds(q, g))), 1, most)), F.lit(0))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", query, F.array_join(extra, " "))).otherwise(query)


def heading_level(line: str) -> int | None:
    """1 for a named part ("Phần 2: ..."), 2 for capitals, 2 + its numbers for a numbered heading; None for other lines."""
    line = line.strip()
    if not line or len(line) > 100:
        return None
    number, _, title = line.partition(" ")
    numbers = number.removesuffix(".").split(".")
    if 3 <= len(title.strip()) <= 80 and len(numbers) <= 5 and all(n.isdecimal() for n in numbers):
        return 2 + len(numbers)
    for name in C.PARTS:
        if line.lower().startswith(f"{name} "):
            rest = line[len(name) :].strip()
            title = rest.lstrip("0123456789ivxIVX")
            if len(title) < len(rest) and 3 <= len(title.lstrip(" :.")) <= 80:
                return 1
    letters = [c for c in line if c.isalpha()]
    if len(line) >= 5 and len(line.split()) >= 2 and letters and not any(c.isdigit() for c in line) and all(c.isupper() for c in letters):
        return 2
    return None


def is_noise(line: str) -> bool:
    """Lines that a document's pages repeat, and page numbers."""
    said = line.strip()
    return said in C.PAGE_LINES or (said.isdecimal() and len(said) <= 4)


def compatible(c: Column) -> Column:
    """Text with its characters in their compatible composed form (NFKC), for which Spark has no function."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return normal(c)


def section_chunks(docs: DataFrame, key: str, text: str, full: int = 1500, good: int = 800, part: int = 400, least: int = 150) -> DataFrame:
    """(key, chunk, path, text): chunks that end at a heading, at a sentence's end when long enough, or when full; lines of noise go.

    Sequential state runs within one text, so texts are dealt to tasks as they are read; nothing is shuffled.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, whole in zip(batch[key], batch[text], strict=True):
                stack: list[tuple[int, str]] = []
                held: list[str] = []
                size, number = 0, 0
                for line in [*(x for x in (whole or "").split("\n") if not is_noise(x)), None]:
                    level = heading_level(line) if line is not None else 0
                    ends = line is None or (level and size >= part) or size >= full or (size >= good and held[-1].rstrip().endswith((".", "!", "?")))
                    if ends and held:
                        said = "\n".join(held).strip()
                        if len(said) >= least:
                            rows.append((k, number, [t for _, t in stack][-3:], said))
                            number += 1
                        held, size = [], 0
                    if line is None:
                        break
                    if level:
                        stack = [s for s in stack if s[0] < level] + [(level, line.strip())]
                    held.append(line)
                    size += len(line) + 1
            yield pd.DataFrame(rows, columns=[key, "chunk", "path", "text"])

    return docs.select(key, text).mapInPandas(cut, f"{key} {dict(docs.dtypes)[key]}, chunk int, path array<string>, text string")


def evidence(pages: DataFrame, key: str, text: str, patterns: DataFrame, around: int = 100) -> DataFrame:
    """First match of each pattern (concept, pattern: a table of fixed size, broadcast) on each page, with what stands around it."""
    pairs = pages.join(F.broadcast(patterns), F.rlike(F.col(text), F.col("pattern")))
    at = F.regexp_instr(F.col(text), F.col("pattern"))
    begin = F.greatest(at - around, F.lit(1))
    found = F.regexp_substr(F.col(text), F.col("pattern"))
    return pairs.select(key, "concept", at.alias("place"), found.alias("found"), F.substring(F.col(text), begin, at - begin + F.length(found) + around).alias("snippet"))


def bounded(df: DataFrame, key: str, by: list, most: int) -> DataFrame:
    """At most `most` rows of each key, in an order that leaves no ties."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """A bag of words as a unit vector: each word adds 1 or -1 at a place that its hash names; no words, no length."""

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h // 2 % dims] += 1 - 2 * (h % 2)
            norm = float(np.sqrt(v @ v))
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return vector(text)


def evidence_cards(found: DataFrame, docs: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, step, key, text, relevance): the sentences of retrieved texts that are most like the query, in their order.

    found: (query, key) of a bounded list each; queries: (query, text). Sentences below the threshold go, the best few
    of a text stay (two if none passes), and the cards are chosen to be relevant and unlike one another.
    """
    q = queries.select("query", hashed_vector(F.col("text")).alias("q"))
    texts = found.select("query", key).join(docs.select(key, F.col(text).alias("_t")), key)
    each = texts.select("query", key, F.posexplode(X.sentences(F.col("_t"))).alias("place", "sentence"))
    each = each.join(q, "query").withColumn("v", hashed_vector(F.col("sentence")))
    each = each.withColumn("score", F.round(dot(F.col("v"), F.col("q")), 9))
    w = Window.partitionBy("query", key).orderBy(F.desc("score"), "place")
    each = each.withColumn("r", F.row_number().over(w))
    each = each.where(((F.col("score") >= C.SENTENCE_SIMILARITY) & (F.col("r") <= C.SENTENCES)) | (F.col("r") <= 2))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sentence"))), lambda s: s["sentence"]), " ")
    cards = each.groupBy("query", key).agg(F.substring(joined, 1, C.CARD_CHARS).alias("text"), F.avg("score").alias("score"))
    cards = cards.withColumn("v", hashed_vector(F.col("text")))
    return diverse(cards, key, "v", C.CARDS).select("query", "step", key, "text", F.col("score").alias("relevance"))

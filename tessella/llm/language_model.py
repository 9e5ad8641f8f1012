"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by the workers that score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOGETHER, Files, Sent, by_value, fill_folder, kept, mapped, new_folder, stash, write_arrays

by_value(__name__)

#: Words are known by 48 bits of their hash: among a billion different words one in 280,000 shares its number with another.
MASK = np.uint64((1 << 48) - 1)
END, START = (1 << 48) - 1, (1 << 48) - 2
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: What a bucket of the model holds, in training tokens; it grows with the square root beyond 135 million.
BUCKET = 500_000
#: Counts from here on don't fit beside the others' four bytes.
LARGE = (1 << 32) - 1
#: A context with more than this share of the training tokens is dealt by its pairs, not as a whole.
HOT = 2_000
#: One text in so many is looked at to plan the buckets.
SAMPLED = 64
WORD_FIELDS = ("count", "before", "after", "ones", "twos", "more")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


class WordNumbers(dict):
    """Numbers of words as eight bytes; kept for the words met of late."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        n = xxhash.xxh64_intdigest(word) & 0xFFFFFFFFFFFF
        out = self[word] = (n if n < START else n - 2).to_bytes(8, "little")
        return out


def tokens(texts, numbers: WordNumbers) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each followed by the end, and each text's number of tokens.

    bytes.lower and bytes.split know ASCII alone: A-Z, and the white space that the contract names.
    """
    flat, sizes, end = [], [], END.to_bytes(8, "little")
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        flat += [b"".join(map(numbers.__getitem__, words)), end]
        sizes.append(len(words) + 1)
    return np.frombuffer(b"".join(flat), "<u8"), np.array(sizes, np.int64)


def contexts(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each, the start before a text's first."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[np.cumsum(sizes) - sizes] = START
    return out


def bucket_of(a: np.ndarray, key: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    return (np.where(np.isin(a, hot), key, mix(a)) % np.uint64(buckets)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, their summed counts, and what stands beside their first."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return (keys[first], np.add.reduceat(counts, first) if len(keys) else counts, *[m[order][first] for m in more])


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    numbers = kept(("model words",), WordNumbers)
    for texts in _together(batches):
        words, counts = np.unique(tokens(texts, numbers)[0], return_counts=True)
        yield pd.DataFrame({"word": words.astype(np.int64), "count": counts})


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            yield batch["text"].iloc[at : at + TOGETHER]


def _pair_blobs(hot: np.ndarray, buckets: int):
    """Pairs counted in a task, as one row for each bucket: runs of a context (number, length), then what follows and how often."""

    def flush(parts: list) -> Iterator[pd.DataFrame]:
        key, n, a, b = _summed(*map(np.concatenate, zip(*parts, strict=True)))
        at = bucket_of(a, key, hot, buckets)
        order = np.lexsort((a, at))
        at, a, b, n = at[order], a[order], b[order], n[order]
        edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
        rows = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            run = np.flatnonzero(np.r_[True, a[lo + 1 : hi] != a[lo : hi - 1], True])
            low, high = (b[lo:hi] & np.uint64(0xFFFFFFFF)).astype("<u4"), (b[lo:hi] >> np.uint64(32)).astype("<u2")
            many = n[lo:hi] > 254
            small = np.where(many, 255, n[lo:hi]).astype("u1")
            rows.append(
                (int(at[lo]), a[lo:hi][run[:-1]].astype("<u8").tobytes(), np.diff(run).astype("<u4").tobytes(), low.tobytes(), high.tobytes(), small.tobytes(), n[lo:hi][many].astype("<i8").tobytes())
            )
        for i in range(0, len(rows), 64):
            yield pd.DataFrame(rows[i : i + 64], columns=["bucket", "a", "runs", "low", "high", "small", "large"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, parts, held = kept(("model words",), WordNumbers), [], 0
        for texts in _together(batches):
            words, sizes = tokens(texts, numbers)
            a = contexts(words, sizes)
            key, at, n = np.unique(pair_key(a, words), return_index=True, return_counts=True)
            parts.append((key, n, a[at], words[at]))
            held += len(key)
            if held > 1_200_000:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    return count


def _open_pairs(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, n = [], [], []
    for r in rows.itertuples(index=False):
        a.append(np.repeat(np.frombuffer(r.a, "<u8"), np.frombuffer(r.runs, "<u4")))
        b.append(np.frombuffer(r.low, "<u4").astype(np.uint64) | np.frombuffer(r.high, "<u2").astype(np.uint64) << np.uint64(32))
        c = np.frombuffer(r.small, "u1").astype(np.int64)
        c[c == 255] = np.frombuffer(r.large, "<i8")
        n.append(c)
    return tuple(map(np.concatenate, (a, b, n)))


def _store_pairs(folder: str):
    """A bucket's pairs as a file (keys of those counted once; keys and counts of the others, those of 32 bits and more apart with
    their places), and what words learn from them."""

    def store(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b, n = _open_pairs(rows)
        keys, n, a, b = _summed(pair_key(a, b), n, a, b)
        once = n == 1
        large = np.flatnonzero(n[~once] >= LARGE)
        head = np.array([once.sum(), (~once).sum(), len(large)], "<u8")
        counts = np.minimum(n[~once], LARGE).astype("<u4")
        write_arrays(folder, f"pairs-{key[0]}", head, keys[once].astype("<u8"), keys[~once].astype("<u8"), large.astype("<u8"), n[~once][large].astype("<u8"), counts)
        wa, ia = np.unique(a, return_inverse=True)
        wb, ib, nb = np.unique(b, return_inverse=True, return_counts=True)
        size = len(wa)
        of_a = {
            "after": np.bincount(ia, n, size), "ones": np.bincount(ia, n == 1, size),
            "twos": np.bincount(ia, n == 2, size), "more": np.bincount(ia, n > 2, size),
        }
        out = pd.concat([
            pd.DataFrame({"word": wa.astype(np.int64), "count": 0, "before": 0} | of_a),
            pd.DataFrame({"word": wb.astype(np.int64), "count": np.bincount(ib, n, len(wb)), "before": nb} | dict.fromkeys(of_a, 0)),
            pd.DataFrame({"word": [-1 - k for k in range(1, 5)], "count": 0, "before": [int((n == k).sum()) for k in range(1, 5)]} | dict.fromkeys(of_a, 0)),
        ])
        return out.groupby("word", as_index=False).sum().astype("int64")

    return store


def _store_words(folder: str):
    def store(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        columns = [rows[f].to_numpy("<u8") for f in WORD_FIELDS]
        write_arrays(folder, f"words-{key[0]}", rows["word"].to_numpy("<u8"), *columns)
        return pd.DataFrame({"stored": [len(rows)]})

    return store


class Model:
    """Where the arrays lie, and the few numbers that belong to no word. It is this that goes to the workers."""

    def __init__(self, folder: str, hot: np.ndarray, pair_buckets: int, word_buckets: int, total: int, distinct: int, pair_kinds: list[int], word_kinds: list[int], discounts):
        self.hot, self.pair_buckets, self.word_buckets = hot, pair_buckets, word_buckets
        self.total, self.distinct, self.discounts = total, distinct, discounts
        self.bigrams = sum(word_kinds)
        self.files = Files(folder)

    def _by_bucket(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1], True]) if len(at) else np.zeros(1, int)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield int(at[order[lo]]), order[lo:hi]

    def words(self, w: np.ndarray) -> dict[str, np.ndarray]:
        """The fields of distinct words; zeros for those that weren't met."""
        out = {f: np.zeros(len(w), np.int64) for f in WORD_FIELDS}
        for bucket, rows in self._by_bucket((mix(w) % np.uint64(self.word_buckets)).astype(np.int64)):
            table = self.files[f"words-{bucket}"].view("<u8").reshape(1 + len(WORD_FIELDS), -1)
            if table.shape[1]:
                place = np.minimum(np.searchsorted(table[0], w[rows]), table.shape[1] - 1)
                met = table[0][place] == w[rows]
                for k, f in enumerate(WORD_FIELDS):
                    out[f][rows[met]] = table[k + 1][place[met]]
        return out

    def pairs(self, a: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs."""
        out = np.zeros(len(key), np.int64)
        for bucket, rows in self._by_bucket(bucket_of(a, key, self.hot, self.pair_buckets)):
            raw = self.files[f"pairs-{bucket}"]
            if not len(raw):
                continue
            at = np.cumsum([24, *(8 * raw[:24].view("<u8").astype(np.int64)[[0, 1, 2, 2]])])
            single, other, large, large_counts = (raw[lo:hi].view("<u8") for lo, hi in zip(at, at[1:], strict=False))
            counts = raw[at[-1] :].view("<u4")
            rows = rows[np.argsort(key[rows])]  # neighbouring searches read neighbouring pages
            for keys, values in ((single, None), (other, counts)):
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, key[rows]), len(keys) - 1)
                    met = keys[place] == key[rows]
                    out[rows[met]] = 1 if values is None else values[place[met]]
                    if values is not None and len(large):
                        met &= values[place] == LARGE
                        out[rows[met]] = large_counts[np.searchsorted(large, place[met])]
        return out

    def score(self, texts, numbers: WordNumbers) -> dict[str, np.ndarray]:
        words, sizes = tokens(texts, numbers)
        a = contexts(words, sizes)
        vocabulary, place = np.unique(np.r_[words, np.uint64(START)], return_inverse=True)
        place = place[:-1]
        fields = self.words(vocabulary)
        start = int(np.searchsorted(vocabulary, np.uint64(START)))
        before = np.r_[start, place[:-1]]
        before[np.cumsum(sizes) - sizes] = start
        keys, at, back = np.unique(pair_key(a, words), return_index=True, return_inverse=True)
        n = self.pairs(a[at], keys)[back]

        (d1, d2, d3), (e1, e2, e3) = self.discounts
        # lower order: in how many contexts a word was met, smoothed with one unknown word beside those met
        met, kinds = fields["before"], self.bigrams
        off = np.where(met == 0, 0, np.where(met == 1, e1, np.where(met == 2, e2, e3)))
        low = (met - off) / max(kinds, 1) + self.lower_mass / (self.distinct + 1)
        off = np.where(n == 0, 0, np.where(n == 1, d1, np.where(n == 2, d2, d3)))
        after = fields["after"][before]
        rest = d1 * fields["ones"] + d2 * fields["twos"] + d3 * fields["more"]
        known = after > 0
        safe = np.where(known, after, 1)
        p = np.where(known, (n - off) / safe + rest[before] / safe * low[place], low[place])
        c = fields["count"][place]
        ends = np.cumsum(sizes)
        sums = lambda x: np.add.reduceat(x, ends - sizes) if len(ends) else np.zeros(0)
        return {
            "n_tokens": sizes,
            "n_known": sums((c > 0).astype(np.int64)),
            "base_score": sums(np.log10((c + 1) / (self.total + self.distinct + 1))),
            "score": sums(np.log10(p)),
        }


def discounts(kinds: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the numbers of n-grams counted 1 to 4 times.

    Where these are too few for the formula it falls back to half a count for each, which keeps every probability above 0.
    """
    n1, n2, n3, n4 = kinds
    if min(n1, n2, n3) == 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return tuple(d if 0 < d < k + 1 else 0.5 for k, d in enumerate(out))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def train(texts: DataFrame) -> Model:
    """The model of a column `text`, of all its rows: null texts are empty and count as an end each; repeated rows count again.

    Pairs are counted in tasks and summed by key; a word's count is that of the pairs that it ends. Pairs lie in
    buckets of their context (of their own, where the context has over 1/2000 of all tokens), so no bucket grows with
    one frequent word; which words are so frequent, and how many buckets it takes, is estimated from a sample, and
    decides only where a pair is counted. Each bucket becomes a sorted array in the shared folder; only totals and
    at most 2000 frequent words come to the driver.
    """
    spark = texts.sparkSession
    folder = new_folder(spark, "language-model")
    counted = texts.select("text").sample(1 / SAMPLED, seed=7).mapInPandas(_word_counts, "word long, count long")
    counted = stash(counted.groupBy("word").agg(F.sum("count").alias("count")), "word-counts")
    guess = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = counted.where(F.col("count") > guess / HOT).orderBy(F.desc("count")).limit(HOT).select("word").collect()
    hot = np.array(sorted({START, *(r["word"] for r in hot)}), np.uint64)
    guess *= SAMPLED
    pair_buckets = max(1, math.ceil(guess / max(BUCKET, 43 * math.sqrt(guess))))
    blobs = texts.select("text").mapInPandas(
        _pair_blobs(hot, pair_buckets), "bucket int, a binary, runs binary, low binary, high binary, small binary, large binary"
    )
    learnt = blobs.groupBy("bucket").applyInPandas(_store_pairs(folder), ", ".join(f"{f} long" for f in ("word", *WORD_FIELDS)))
    words = stash(learnt.groupBy("word").agg(*[F.sum(f).alias(f) for f in WORD_FIELDS]), "words")
    total, distinct = words.where("word >= 0 and count > 0").agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    word_buckets = max(1, math.ceil(distinct / max(100_000, 50 * math.sqrt(distinct))))
    pair_kinds = {r["word"]: r["before"] for r in words.where("word < 0").collect()}
    kind = F.when(F.col("before") > 4, 5).otherwise(F.col("before"))
    word_kinds = {r["kind"]: (r["n"], r["s"]) for r in words.where("word >= 0 and before > 0").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("before").alias("s")).collect()}
    two = [pair_kinds.get(-1 - k, 0) for k in range(1, 5)]
    one = [word_kinds.get(k, (0, 0))[0] for k in range(1, 5)]
    model = Model(folder, hot, pair_buckets, word_buckets, total, distinct, two, [s for _, s in word_kinds.values()], (discounts(two), discounts(one)))
    more = sum(n for n, _ in word_kinds.values()) - one[0] - one[1]
    e1, e2, e3 = model.discounts[1]
    model.lower_mass = (e1 * one[0] + e2 * one[1] + e3 * more) / model.bigrams if model.bigrams else 1.0
    dealt = words.where("word >= 0").withColumn("bucket", _word_bucket(word_buckets))
    dealt.groupBy("bucket").applyInPandas(_store_words(folder), "stored long").agg(F.count(F.lit(1))).first()
    fill_folder(spark, folder, [f"pairs-{b}" for b in range(pair_buckets)] + [f"words-{b}" for b in range(word_buckets)])
    return model


def _word_bucket(buckets: int):
    @F.pandas_udf("long")
    def bucket(word: pd.Series) -> pd.Series:
        return pd.Series((mix(word.to_numpy(np.uint64)) % np.uint64(buckets)).astype(np.int64))

    return bucket("word")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every whole text.

    A null text is empty, and an empty one has its end alone. Repeated rows give repeated results; a null doc_id stays
    null and isn't held out; an empty table gives an empty result, and a model of an empty table one probability to all.
    """
    sent = Sent(docs.sparkSession, model)
    fields = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}

    def start():
        numbers, model = kept(("model words",), WordNumbers), sent()

        def apply(part: pa.RecordBatch):
            out = model.score(part.column("text").to_pylist(), numbers)
            return None, [out[f] for f in fields]

        return apply

    scored = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], fields, start)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )

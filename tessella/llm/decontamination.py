"""Benchmark decontamination by spaced seeds: hashes that skip some token positions join test and training texts; hits are verified."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Files, by_value, fill_folder, filter_texts, kept, mapped, new_folder, stash, write_arrays

by_value(__name__)

#: Fixed masks: 1 is a token that must agree, 0 one that may differ. Each spans 8 tokens and reads 5.
MASKS = ("11010011", "10110101", "11001101")
SPAN = len(MASKS[0])
#: A document is contaminated by an aligned stretch with so many agreeing tokens (all, of shorter items), at so large a share.
AGREE, SHARE = 11, 0.8
#: Seeds are stored in files of so many characters of test texts each.
BLOCK_CHARS = 8_000_000
#: A seed that stands in so many pairs of places is crossed text by text, not place by place.
CROSSED = 100_000
_WORD = re.compile(r"\w+")
_FILTER_BITS = 22


class Numbers(dict):
    """64-bit number of a word; kept for the words met of late."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def numbered(texts, numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, in lower case, and where each text begins (with the end of the last)."""
    flat: list[int] = []
    edges = [0]
    for text in texts:
        flat += map(numbers.__getitem__, _WORD.findall((text or "").lower()))
        edges.append(len(flat))
    return np.array(flat, np.uint64), np.array(edges, np.int64)


def masked(words: np.ndarray, edges: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash under a mask at each place where its span lies in one text, and the places."""
    span, n = len(mask), len(words)
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n - span + 1, int(mask, 2) + 2**40 * span, np.uint64)
    for k in range(span):
        if mask[k] == "1":
            h = (h ^ words[k : n - span + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    room = np.repeat(edges[1:], np.diff(edges))[: n - span + 1] - np.arange(n - span + 1)
    places = np.flatnonzero(room >= span)
    return h[places], places


class Seeds:
    """Sorted seed hashes of test texts, with the text and the place of each; read from a file, they stay mapped there."""

    KINDS = ("<i8", "<u8", "<i8", "<u8", "<i8", "<i8", "<i4", "?", "?")  # the widest first, so that all stay aligned in a file

    def __init__(self, *arrays: np.ndarray):
        self.ids, self.words, self.edges, self.hashes, self.at, self.short, self.text, self.named, self.filter = self.arrays = arrays

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]]) -> Seeds:
        words, edges = numbered([t for _, t in items], Numbers())
        size = np.diff(edges)
        parts = [masked(words, edges, m) for m in MASKS]
        short = sorted({int(n) for n in size if 0 < n < SPAN})
        for n in short:  # shorter than a mask: the whole text must agree
            h, at = masked(words, edges, "1" * n)
            whole = np.isin(at, edges[:-1][size == n])
            parts.append((h[whole], at[whole]))
        h, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        hashes, at = h[order], at[order]
        text = np.searchsorted(edges, at, "right") - 1
        filter_ = np.zeros(1 << _FILTER_BITS, bool)
        filter_[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        ids, named = np.array([i or 0 for i, _ in items], np.int64), np.array([i is not None for i, _ in items], bool)
        return cls(ids, words, edges, hashes, at, np.array(short, np.int64), text.astype(np.int32), named, filter_)

    def write(self, folder: str, name: str) -> None:
        write_arrays(folder, name, np.array([len(x) for x in self.arrays], "<u8"), *[x.astype(k) for x, k in zip(self.arrays, self.KINDS, strict=True)])

    @classmethod
    def read(cls, raw: np.ndarray) -> Seeds:
        at, found = 8 * len(cls.KINDS), []
        for kind, n in zip(cls.KINDS, raw[:at].view("<u8").tolist(), strict=True):
            end = at + n * np.dtype(kind).itemsize
            found.append(np.frombuffer(raw[at:end], kind) if end > at else np.zeros(0, kind))
            at = end
        return cls(*found)

    def item(self, text: int) -> int | None:
        return int(self.ids[text]) if self.named[text] else None

    def hits(self, words: np.ndarray, edges: np.ndarray, hashed: dict | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, test text, diagonals) of equal seeds; a diagonal is the place in the batch where the test text would begin.

        hashed: the batch's hashes under each mask, kept from one file of seeds to the next. A seed that stands often on
        both sides, as in texts of one repeated word, has as many diagonals as places, not as pairs of places: they
        are the differences of two sets of places, found text by text.
        """
        hashed, out = {} if hashed is None else hashed, []
        for mask in [*MASKS, *["1" * n for n in self.short.tolist()]]:
            if mask not in hashed:
                hashed[mask] = masked(words, edges, mask)
            h, places = hashed[mask]
            maybe = self.filter[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)]
            h, places = h[maybe], places[maybe]
            low = np.searchsorted(self.hashes, h, "left")
            n = np.searchsorted(self.hashes, h, "right") - low
            _, back, often = np.unique(h, return_inverse=True, return_counts=True)
            hot = often[back] * n > CROSSED
            for value in np.unique(h[hot]).tolist():
                out += self._crossed(np.uint64(value), places[h == np.uint64(value)], edges)
            low, n, places = low[~hot], n[~hot], places[~hot]
            seed = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if n.sum() else np.zeros(0, np.int64)
            place = np.repeat(places, n)
            text = self.text[seed].astype(np.int64)
            out.append(np.column_stack([np.searchsorted(edges, place, "right") - 1, text, place - (self.at[seed] - self.edges[text])]))
        found = np.unique(np.concatenate(out), axis=0)
        cut = np.flatnonzero((found[1:, :2] != found[:-1, :2]).any(1)) + 1
        for rows in np.split(found, cut):
            if len(rows):
                yield int(rows[0, 0]), int(rows[0, 1]), rows[:, 2]

    def _crossed(self, value: np.uint64, places: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
        low, high = np.searchsorted(self.hashes, value, "left"), np.searchsorted(self.hashes, value, "right")
        of, texts = np.searchsorted(edges, places, "right") - 1, np.asarray(self.text[low:high])
        inside, out = np.asarray(self.at[low:high]) - self.edges[texts], []
        for doc in np.unique(of):
            for text in np.unique(texts):
                found = differences(places[of == doc], inside[texts == text])
                out.append(np.column_stack([np.full(len(found), doc), np.full(len(found), text, np.int64), found]))
        return out

    def overlap(self, words: np.ndarray, lo: int, hi: int, text: int, start: int) -> tuple[int, int, int] | None:
        """Agreeing tokens, first and end place of the stretch along a diagonal that agrees in the most tokens, if it is long enough.

        Of all stretches that are alike enough (their sum of 1 - SHARE for each agreeing token less SHARE for each other
        one is at least 0): for each end, the first place whose sum from the start is no larger is where the stretch
        with the most agreeing tokens begins. AGREE decides.
        """
        item = self.words[self.edges[text] : self.edges[text + 1]]
        first, last = max(start, lo), min(start + len(item), hi)
        same = words[first:last] == item[first - start : last - start]
        least = min(AGREE, len(item))
        if np.count_nonzero(same) < least:
            return None
        agree = np.r_[0, np.cumsum(same)]
        total = np.round(agree - SHARE * np.arange(len(agree)), 9)
        begin = np.searchsorted(-np.minimum.accumulate(total), -total)
        found = agree - agree[begin]
        end = int(np.argmax(found))
        if found[end] < least:
            return None
        begin = int(np.searchsorted(agree, agree[begin[end]], "right")) - 1
        return int(found[end]), first + begin - lo, first + end - lo


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distinct x - y of whole numbers x of p and y of q; of long lists by a convolution of what is there."""
    if len(p) * len(q) <= 1_000_000:
        return np.unique(p[:, None] - q[None, :])
    low, high = p.min(), q.max()
    a, b = np.zeros(p.max() - low + 1), np.zeros(high - q.min() + 1)
    a[p - low], b[high - q] = 1, 1
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    met = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n]
    return np.flatnonzero(met > 0.5) + low - high


class SeedFiles:
    """Seeds of all test texts, in files of the shared folder. It is this that goes to the workers."""

    def __init__(self, folder: str, blocks: int):
        self.files, self.blocks = Files(folder), blocks

    def __iter__(self) -> Iterator[Seeds]:
        for k in range(self.blocks):
            if len(raw := self.files[f"seeds-{k}"]):
                yield Seeds.read(raw)


def store_seeds(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> SeedFiles:
    """Seeds of the test texts, made in tasks. A text that stands twice under one item_id counts once; null texts have none."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").cast("string").alias("item"), "text").distinct()
    items = stash(items, "test-texts")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    folder = new_folder(spark, "seeds")

    def store(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = [int(i) if isinstance(i, str) else None for i in rows["item"]]
        texts = sorted(zip(ids, rows["text"], strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        Seeds.of(texts).write(folder, f"seeds-{key[0]}")
        return pd.DataFrame({"block": [key[0]]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    dealt.groupBy("block").applyInPandas(store, "block long").agg(F.count(F.lit(1))).first()
    fill_folder(spark, folder, [f"seeds-{k}" for k in range(blocks)])
    return SeedFiles(folder, blocks)


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and test text that it overlaps: doc_id, item_id, agree, item_words, first_word, end_word.

    Words are compared in lower case without signs. Documents are read once, whatever the number of test texts, whose
    seeds lie in files of the shared folder that workers map; nothing is shuffled. Null and empty texts, on either side,
    overlap nothing; test texts of under 8 words must agree wholly; repeated documents give repeated results, a repeated
    test text counts once; null ids stay null; an empty table gives an empty result. Of stretches that agree in
    equally many words, the one with the most words of the two texts side by side counts, then the first.
    """
    seeds = store_seeds(benchmark, block_chars)
    fields = dict.fromkeys(["item_id", "agree", "item_words", "first_word", "end_word"], "long")
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], fields, _finder(seeds))


def leaks(texts, files, numbers: Numbers, one: bool = False) -> Iterator[tuple[int, int | None, int, int, int, int]]:
    """Best overlap of each row of texts and each test text that has one: row, item, agree, words of the test text, first, end.

    one: a row's first overlap suffices.
    """
    words, edges = numbered(texts, numbers)
    hashed: dict = {}
    done: set[int] = set()
    for seeds in files:
        for doc, text, starts in seeds.hits(words, edges, hashed):
            if doc in done:
                continue
            low, high, size = int(edges[doc]), int(edges[doc + 1]), int(seeds.edges[text + 1] - seeds.edges[text])
            side = np.minimum(starts + size, high) - np.maximum(starts, low)
            best = None
            for k in np.argsort(-side, kind="stable").tolist():
                if side[k] <= (best[0] if best else 0):
                    break  # no later diagonal has as many words
                got = seeds.overlap(words, low, high, text, int(starts[k]))
                if got and (best is None or got[0] > best[0]):
                    best = got
                    if one:
                        break
            if best:
                yield doc, seeds.item(text), best[0], size, best[1], best[2]
                if one:
                    done.add(doc)


def _finder(files: SeedFiles) -> Callable:
    def start():
        numbers = kept(("leak words",), Numbers)

        def find(part: pa.RecordBatch):
            found = list(leaks(part.column("text").to_pylist(), files, numbers))
            places, *columns = zip(*found, strict=True) if found else [[]] * 6
            return places, columns

        return find

    return start


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """documents without those that overlap a test text; all columns and kept rows as they were, in one pass.

    Null and empty texts, rows without a doc_id and repeated rows stay, if they overlap nothing; an empty table stays empty.
    """
    return filter_texts(docs, _keeper(store_seeds(benchmark, block_chars)))


def _keeper(files: SeedFiles) -> Callable:
    def start():
        numbers = kept(("leak words",), Numbers)

        def clean(texts: list[str | None]) -> np.ndarray:
            out = np.ones(len(texts), bool)
            out[[d for d, *_ in leaks(texts, files, numbers, one=True)]] = False
            return out

        return clean

    return start

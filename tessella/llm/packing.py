"""Packing token sequences by minimum bin slack: a bitset subset-sum picks what fills each window best."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, kept, mapped, ranked, stash

by_value(__name__)

WINDOW = 4096
END_ID = 2
#: Chunks of which a worker keeps the ids: so many met of late, and as many before them.
CACHE = 400_000
_SIGNS = b".,;:!?#$%&*"
_PLAIN = b"abcdefghijklmnopqrstuvwxyz0123456789"
_SCALE = 1 << 40


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within `counts`, with the largest sum that is at most `room`.

    Bit s of `reach` tells whether sum s can be made. A length's copies enter in lots of 1, 2, 4, ..., so a length
    takes as many shifts as its count has digits. The lots that make the best sum are found by going back.
    """
    mask, reach, lots = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:
            lot = min(lot, left)
            lots.append((reach, length, lot))
            reach |= reach << length * lot & mask
            left, lot = left - lot, lot * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, lot in reversed(lots):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + lot
            at -= length * lot
    return chosen


def plan_windows(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, number in a window, first sequence, offset in it).

    Each window takes the longest piece left and what fills the rest best; the same filling is repeated as often as
    the counts allow. Every filling uses up a length, so there are at most `window` fillings, each of at most
    sqrt(2 * window) different lengths: the plan is bounded whatever the number of documents.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = best_fill({k: v for k, v in left.items() if v}, window - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // c for k, c in chosen.items())
        offset = 0
        for length, each in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], each, sequence, offset))
            offset += length * each
            used[length] += each * times
            left[length] -= each * times
            if not left[length]:
                del left[length]
        sequence += times
    return rows


class ChunkIds:
    """ids (little-endian unsigned 32-bit) of chunks of text without white space, kept for the chunks met of late.

    The tokenizer lower-cases, drops white space and never merges across it, so a text's ids are those of its chunks.
    Chunks met for the first time are encoded many at once; the offsets tell whose ids are whose.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before = Tokenizer.from_file(path), {}, {}

    def _encode(self, chunks: list[bytes]) -> None:
        words = [c.decode() for c in chunks]
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        at = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
        ends = 4 * np.searchsorted(at, [*starts[1:], starts[-1] + len(words[-1]) + 1])
        raw, begin = ids.tobytes(), 0
        for chunk, end in zip(chunks, ends.tolist(), strict=True):
            self.known[chunk] = raw[begin:end]
            begin = end

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        split, found, new = [], [], set()
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        for text in texts:
            raw = (text or "").encode()
            # a special token's name counts only as it is spelt
            chunks = (raw if b"<|" in raw else raw.lower()).split()
            ids = list(map(self.known.get, chunks))
            missing = []
            for k, i in enumerate(ids):
                if i is None:
                    if (i := self.before.get(chunks[k])) is None:
                        missing.append(k)
                    else:
                        self.known[chunks[k]] = ids[k] = i
            new.update([chunks[k] for k in missing])
            split.append(chunks if missing else None)
            found.append((ids, missing))
        tailed = []  # signs after a letter or digit are tokens of their own
        for c in new:
            core = c.rstrip(_SIGNS)
            if len(core) < len(c) and core and core[-1] in _PLAIN:
                tailed.append((c, core, c[len(core) :]))
        new.difference_update(c for c, _, _ in tailed)
        new.update(part for _, *parts in tailed for part in parts if part not in self.known)
        new = list(new)
        for i in range(0, len(new), 200):
            self._encode(new[i : i + 200])
        for c, core, tail in tailed:
            self.known[c] = self.known[core] + self.known[tail]
        for chunks, (ids, missing) in zip(split, found, strict=True):
            for k in missing:
                ids[k] = self.known[chunks[k]]
            yield b"".join(ids)


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into whole windows and a rest: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    A null text is empty and has the end id alone; a null doc_id stays null.
    """
    end = np.array([end_id], "<u4").tobytes()
    fields = dict.fromkeys(["start", "length", "ids_crc32", "doc_tokens"], "long") | ({"ids": "binary"} if keep_ids else {})

    def start():
        words = kept(("chunk ids", tokenizer), lambda: ChunkIds(tokenizer))

        def cut(part: pa.RecordBatch):
            places, rows = [], []
            for place, ids in enumerate(words.of(part.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for first in range(0, n, window):
                    piece = ids[4 * first : 4 * (first + window)]
                    places.append(place)
                    rows.append((first, len(piece) // 4, zlib.crc32(piece), n, piece)[: len(fields)])
            return places, list(zip(*rows, strict=True)) or [[]] * len(fields)

        return cut

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], fields, start)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...) of 1 to `window` tokens.

    Only the histogram of lengths (at most `window` numbers) comes to the driver. A piece's rank among those of its
    length tells its window and place. Pieces must be a written table, since they are read three times. Repeated rows
    are packed each; an empty table gives an empty result; a window that isn't full is left short, not padded. Pieces of
    one length are interchangeable; of fillings that are equally full the one found first, with the longest pieces, is taken.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = np.array(sorted(plan_windows(histogram, window)), np.int64).reshape(-1, 5)
    keys = plan[:, 0] * _SCALE + plan[:, 1]

    def start():
        def place(part: pa.RecordBatch):
            length, rank = (np.array(part.column(c), np.int64) for c in ("length", "_rank"))
            row = plan[np.searchsorted(keys, length * _SCALE + rank, "right") - 1]
            window_, place_ = np.divmod(rank - row[:, 1], row[:, 2])
            return None, [row[:, 3] + window_, row[:, 4] + place_ * length]

        return place

    placed = ranked(pieces, "length", ["doc_id", "start", "ids_crc32"], "_rank").select(*pieces.columns, "_rank")
    return mapped(placed, pieces.columns, {"sequence_id": "long", "offset": "long"}, start, 10_000)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """All documents, cut and packed; a null text is empty and has the end id alone."""
    return pack(stash(token_pieces(docs, tokenizer, window, keep_ids=keep_ids), "pieces"), window)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each window: its ids in order (packed with keep_ids) and the documents in it; at most a window of tokens each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
    )

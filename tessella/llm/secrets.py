"""Secret scans: three patterns, and strings that a tokenizer's vocabulary can't shorten."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, kept, mapped

by_value(__name__)

#: The kinds in their order.
KINDS = ("assign", "access", "hex", "dense")
#: A word of a secret's alphabet counts as random below so many characters a token.
RATIO = 2.0
LEAST = 20
#: Letters in a row, so many and more, are readable only if the vocabulary shortens them too.
READABLE = 16
MARK = "[SECRET]"


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # whole runs
WORD = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Known digests (md5 to sha-512, UUIDs) and identifiers (numbers, and readable words joined by signs) are no secrets of themselves.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\Z")
SIGNS = re.compile(r"[+/_=-]+")
PIECE = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,8}")
LONG = re.compile(rf"[A-Za-z]{{{READABLE},}}")
LAST_PIECE = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+)?[0-9]{0,8}")


def identifier(word: str) -> bool:
    """Numbers, or pieces joined by signs that may be readable: words, capitals, up to 8 digits, which the last piece may have after letters."""
    pieces = [p for p in SIGNS.split(word) if p]
    if all(p.isdigit() for p in pieces):
        return True
    return all(map(PIECE.fullmatch, pieces[:-1])) and LAST_PIECE.fullmatch(pieces[-1]) is not None


class Efficiency:
    """Characters a token under a tiktoken vocabulary."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def poor(self, word: str) -> bool:
        """Whether the vocabulary leaves the word under RATIO characters a token."""
        return len(word) < RATIO * len(self.encoding.encode_ordinary(word))

    def random(self, word: str) -> bool:
        if DIGEST.match(word) or identifier(word) and not any(map(self.poor, LONG.findall(word))):
            return False
        return self.poor(word)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns: leftmost, not overlapping within a kind, those too short dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def dense_spans(text: str, test: Efficiency, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of random strings outside the spans that are known already, which stand in order."""
    starts, ends, out = [], [], []  # of the stretches that the known spans cover
    for s, _, e in known:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in WORD.finditer(text):
        k = bisect_right(ends, m.start())
        inside = k < len(starts) and starts[k] < m.end()
        if not inside and test.random(m[0]):
            out.append((m.start(), 3, m.end()))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, base (spans of the patterns), spans (those and the random strings), both as kind:start:end in code points, and redacted.

    Every whole text is scanned where it is read; nothing is shuffled. A null or empty text has no spans; repeated
    rows give repeated results, a null doc_id stays null, an empty table gives an empty result. `redacted` is the text
    with each stretch of spans replaced by one mark, null where nothing was found.
    """

    def start():
        test = kept(("efficiency", vocabulary), lambda: Efficiency(vocabulary, pattern))

        def scan(part: pa.RecordBatch):
            columns: tuple[list, list, list] = [], [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + dense_spans(text, test, base))
                for column, value in zip(columns, (_joined(base), _joined(spans), redact(text, spans) if spans else None), strict=True):
                    column.append(value)
            return None, columns

        return scan

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(rows, ["doc_id"], {"base": "string", "spans": "string", "redacted": "string"}, start)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the hash of the base spans."""
    kinds = F.split("base", ",")
    count = lambda k: F.size(F.filter(kinds, lambda x: x.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2("base", 256).alias("base_sha256"), "spans")


def redacted_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """documents with secrets masked and n_chars (if it is there) brought up to date; every row stays, in one pass without a join.

    Null and empty texts, nulls in other columns, repeated rows and other columns stay as they are; an empty table stays empty.
    """
    name = "_masked"
    while name in docs.columns:
        name = "_" + name
    found, masked = mapped(docs, docs.columns, {name: "string"}, _masker(vocabulary, pattern)), F.col(name)
    new = {"text": F.coalesce(masked, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(masked.isNotNull(), F.length(masked)).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return found.withColumns(new).drop(name)


def _masker(vocabulary: str, pattern: str):
    def start():
        test = kept(("efficiency", vocabulary), lambda: Efficiency(vocabulary, pattern))

        def mask(part: pa.RecordBatch):
            out = []
            for text in part.column("text").to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + dense_spans(text or "", test, base))
                out.append(redact(text, spans) if spans else None)
            return None, [out]

        return mask

    return start


def sha256_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()

"""Text and number expressions, each a Column built from Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def basic(c: Column) -> Column:
    """Lower case, semicolons as commas, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit(";"), F.lit(","))), r"\s+", " "))


def parts(c: Column) -> Column:
    """The values of a cell that lists several; none for null."""
    cells = F.filter(F.transform(F.split(basic(c), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(cells, F.array().cast("array<string>"))


def canonical(token: Column, names: dict[str, str] = C.CANONICAL) -> Column:
    """One spelling for each value: no full stops, underscores as spaces, known synonyms replaced."""
    plain = F.trim(F.regexp_replace(F.translate(token, "_.", " "), r"\s+", " "))
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, plain), plain)


def clean_cell(c: Column, names: dict[str, str] = C.CANONICAL) -> Column:
    """The cell with its values in one spelling, each once, in their order."""
    clean = F.array_distinct(F.transform(parts(c), lambda t: canonical(t, names)))
    return F.when(c.isNotNull(), F.array_join(clean, ", "))


def number(c: Column) -> Column:
    """The number in a text, or null; a decimal comma counts as a point."""
    return F.expr("try_cast(x as double)") if c is None else F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"[^0-9.\-]", "").try_cast("double")


def range_ends(c: Column) -> tuple[Column, Column]:
    """Low and high end of a reference range such as 4-10."""
    pattern = r"(-?\d+(?:\.\d+)?)\s*[-–]\s*(-?\d+(?:\.\d+)?)"
    plain = F.replace(c, F.lit(","), F.lit("."))
    return tuple(F.nullif(F.regexp_extract(plain, pattern, k), F.lit("")).cast("double") for k in (1, 2))


def folded(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), C.ACCENTED, C.PLAIN)


def words(c: Column) -> Column:
    """Letters, digits and underscores in lower case, as an array."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def sentences(c: Column) -> Column:
    """Sentences of at least 8 characters: bullets begin one; a stop, space and capital end one."""
    flat = F.regexp_replace(F.regexp_replace(F.trim(c), r"\n+\s*-\s*", ". "), r"\n+", " ")
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?;])\s+(?=\p{Lu})"), lambda x: F.trim(x)), lambda s: F.length(s) >= 8)


def chunks(c: Column, size: int = 1200, step: int = 1050) -> Column:
    """Windows of `size` characters, `step` apart, until the text ends."""
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / F.lit(step))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(c, k * step + 1, F.lit(size)))


def trust(share: Column) -> Column:
    out = None
    for least, name in C.TRUST:
        out = F.when(share >= least, name) if out is None else out.when(share >= least, name)
    return out.otherwise(C.TRUST_ELSE)


def first_match(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule whose substring stands in c."""
    out = None
    for part, name in rules:
        out = F.when(c.contains(part), name) if out is None else out.when(c.contains(part), name)
    return out


def any_match(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def scanned_number(token: Column) -> Column:
    """A token with a digit whose look-alike letters are digits and whose single decimal comma is a point."""
    fixed = F.regexp_replace(F.translate(token, C.SCANNED, C.DIGITS), r"^([^,]*\d),(\d{1,3})\z", "$1.$2")
    return F.when(token.rlike(r"^[0-9OolISBZg.,%<>=-]*[0-9][0-9OolISBZg.,%<>=-]*\z"), fixed).otherwise(token)


def rounded_even(c: Column, digits: int) -> Column:
    """Rounded, halves to the even digit."""
    return F.bround(c, digits)

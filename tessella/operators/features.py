"""From a wide table to a feature table: columns that leak, strings, days out of focus and rows without a target go."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = re.compile(r"^(.*?)[Nn](\d+)$")


def series_columns(columns: list[str]) -> dict[str, tuple[str, int]]:
    """column -> (measure, day) of the columns that end in N and a day; measures go without regard to case."""
    return {c: (m[1].lower(), int(m[2])) for c in columns if (m := DAY.match(c)) and m[1]}


def prepared(df: DataFrame, target: str, leaky: list[str], days: list[int] | None = None) -> DataFrame:
    """Features and target: no leaky columns, strings or days out of focus, no rows without a target."""
    found = series_columns(df.columns)
    out = [c for c, t in df.dtypes if c in leaky or (t == "string" and c != target) or (days is not None and c in found and found[c][1] not in days)]
    return df.drop(*[c for c in out if c != target]).dropna(subset=[target])


def existing(df: DataFrame, groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """The columns of each group that the table has, without regard to case."""
    names = {c.lower(): c for c in df.columns}
    kept = {g: [names[c.lower()] for c in cols if c.lower() in names] for g, cols in groups.items()}
    return {g: cols for g, cols in kept.items() if cols}


def aligned(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns in this order; those that are missing are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names])


def row_trends(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Eight trend columns of each group of day columns, on the wide row itself: no shuffle."""
    new = {}
    for name, cols in groups.items():
        cells = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols])
        seen = F.filter(cells, lambda x: x.isNotNull())
        steps = F.filter(F.zip_with(F.slice(cells, 2, max(len(cols) - 1, 1)), F.slice(cells, 1, max(len(cols) - 1, 1)), lambda b, a: b - a), lambda x: x.isNotNull())
        steps = steps if len(cols) > 1 else F.array().cast("array<double>")
        new |= {
            f"{name}_max": F.array_max(seen),
            f"{name}_min": F.array_min(seen),
            f"{name}_range": F.array_max(seen) - F.array_min(seen),
            f"{name}_first": F.get(seen, 0),
            f"{name}_last": F.get(seen, F.size(seen) - 1),
            f"{name}_n_observed": F.size(seen),
            f"{name}_max_dropdown": F.array_min(steps),
            f"{name}_max_rise": F.array_max(steps),
        }
    return df.withColumns(new)


def row_masks(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """<column>_mask and <column>_tdelta of each day column, within its group, on the wide row itself."""
    new = {}
    for cols in groups.values():
        last = F.lit(-1)
        for i, c in enumerate(cols):
            has = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
            last = F.when(has, i).otherwise(last)
            new |= {f"{c}_mask": has.cast("int"), f"{c}_tdelta": F.when(last >= 0, i - last).otherwise(-1)}
    return df.withColumns(new)


def distinct_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order; ties in it must be equal rows."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return first.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])

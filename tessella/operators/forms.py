"""Text forms: patient cards, prompts, evidence blocks, answers read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of the labels in answers.
LABELS = {
    "thuong": 1, "thường": 1, "sxh": 1, "thông thường": 1, "binh thường": 1, "bình thường": 1, "common": 1, "normal": 1,
    "canhbao": 2, "cảnh báo": 2, "canh bao": 2, "warning": 2, "sxhcanhbao": 2, "tieuhuyetsacto": 2,
    "nang": 3, "nặng": 3, "soc sxh": 3, "soxsxh": 3, "socsxh": 3, "thexuathuyet": 3, "tonthuonganthan": 3, "socsxhnang": 3, "soc,gan": 3,
    "soc,xhthtren": 3, "soctaisoc1lan": 3, "shh": 3, "gan": 3, "tonthuongtang": 3, "xuất huyết": 3, "xuathuyet": 3, "severe": 3,
}


def patient_cards(obs: DataFrame) -> DataFrame:
    """(patient, card): a line for each measure, N<day>=<value> or a dash for each day."""
    cell = F.concat(F.lit("N"), F.col("day").cast("string"), F.lit("="), F.when(F.col("value").isNotNull(), F.format_string("%.1f", "value")).otherwise("—"))
    row = obs.groupBy("patient", "measure").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", cell.alias("cell")))), lambda c: c["cell"]), " ").alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("measure", "line"))), lambda r: F.concat(r["measure"], F.lit(": "), r["line"]))
    return row.groupBy("patient").agg(F.array_join(lines, "\n").alias("card"))


def described(df: DataFrame, key: str, sex: str, age: str, weight: str, day: str, illness: str, signs: list[str], lines: str) -> DataFrame:
    """(key, card): a patient in words, from columns; signs are arrays of names, lines an array of a measure's line each.
    What isn't known is a question mark, or left out where a line is for it alone."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    head = F.concat(F.lit("Thông tin: "), known(sex), F.lit(", "), known(age), F.lit(" tuổi, "), known(weight), F.lit("kg"))
    listed = [F.when(F.size(s) > 0, F.concat(F.lit(f"{s}: "), F.array_join(s, ", "))) for s in signs]
    rows = [
        F.lit("--- Bệnh nhân ---"), head, F.concat(F.lit("Ngày bệnh khi nhập viện: N"), known(day)), F.concat(F.lit("Bệnh nền: "), F.nullif(F.col(illness), F.lit(""))),
        *listed, F.when(F.size(lines) > 0, F.concat(F.lit("Lab theo ngày:\n  "), F.array_join(lines, "\n  "))),
    ]
    return df.select(key, F.array_join(F.array_compact(F.array(*rows)), "\n").alias("card"))


def trend_line(low_day: Column, high_day: Column, first: Column, last: Column, change: Column) -> Column:
    """A measure's course in words: lowest and highest day, first and last value, change."""
    change_ = F.when(change.isNotNull(), F.format_string(" (%+.1f%%)", change)).otherwise("")
    return F.concat(F.format_string("thấp nhất N%d, cao nhất N%d, từ %.1f đến %.1f", low_day, high_day, first, last), change_)


def lab_table(rows: DataFrame, key: str) -> DataFrame:
    """(key, block): laboratory rows (exam, value, unit, flag) as lines, those out of range marked."""
    mark = F.when(F.col("flag").isin("low", "high"), F.concat(F.lit(" ["), F.col("flag"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("- "), "exam", F.lit(": "), F.coalesce(F.format_string("%.1f", "value"), F.lit("?")), F.coalesce(F.concat(F.lit(" "), "unit"), F.lit("")), mark)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("exam", line.alias("line")))), lambda r: r["line"]), "\n").alias("block"))


def facts_block(facts: DataFrame, most: int = 6) -> Column:
    """Graph facts (path, relations, score: columns of facts) of the best `most` as lines a -[r]-> b."""
    arrow = lambda a, r: F.when(r != "", F.concat(a, F.lit(" -["), r, F.lit("]->"))).otherwise(a)
    step = lambda f: F.array_join(F.zip_with(f["path"], F.concat(f["relations"], F.array(F.lit(""))), arrow), " ")
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col("score"), F.col("path"), F.col("relations"))), asc=False), 1, most)
    return F.array_join(F.transform(best, lambda f: F.trim(step(f))), "\n")


def messages(system: Column, history: Column, context: Column, question: Column) -> Column:
    """A chat's messages as an array of (role, content): the system's, those of the history (an array of the same), the
    context if there is one, and the question."""
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    context_ = F.when(F.coalesce(context, F.lit("")) != "", F.array(said("system", context))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return F.concat(F.array(said("system", system)), F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), context_, F.array(said("user", question)))


def prompt(card: Column, instruction: str) -> Column:
    return F.concat(F.lit(instruction + "\n\n"), card, F.lit('\n\nAnswer with {"label": ..., "confidence": ..., "reasoning": ...}'))


def parsed_answers(df: DataFrame, key: str, raw: str, keep: list[str] | None = None) -> DataFrame:
    """Label, confidence and reasoning of the last JSON object with a label; nulls where there is none that can be read. keep: more columns of df."""
    found = F.regexp_extract_all(F.col(raw), F.lit(r'(\{[^{}]*"label"[^{}]*\})'), 1)
    last = F.when(F.size(found) > 0, F.element_at(found, -1))
    straight = F.translate(last, "“”‘’", "\"\"''")
    read = F.from_json(straight, "label string, confidence string, reasoning string", {"mode": "PERMISSIVE"})
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return df.select(key, F.try_element_at(known, F.lower(F.trim(read["label"]))).alias("predicted"), read["confidence"].try_cast("double").alias("confidence"), F.nullif(F.trim(read["reasoning"]), F.lit("")).alias("reasoning"), *(keep or []))


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sections(raw: Column) -> list[Column]:
    """Reason, evidence lines and red flags of a sectioned answer."""
    part = lambda name, stop: strip(F.regexp_extract(raw, rf"(?is)\[{name}\]:?\s*(.+?)(?={stop}|\{{|\z)", 1))
    split = lambda c, least: F.slice(F.filter(F.transform(F.split(c, r"\n+"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^-+", ""))), lambda x: F.length(x) >= least), 1, 6)
    flags = part(r"Cờ đỏ", r"\z")
    none = F.lower(flags).rlike(r"^\(?không")
    return [
        part(r"Lý do", r"\[Bằng chứng\]|\[Cờ đỏ\]").alias("reason"),
        split(part(r"Bằng chứng", r"\[Cờ đỏ\]"), 4).alias("evidence"),
        F.when(none, F.array().cast("array<string>")).otherwise(split(flags, 3)).alias("red_flags"),
    ]


def evidence_block(cards: DataFrame, key: str, most: int = 350) -> DataFrame:
    """Numbered evidence cards of each query as one text, each cut at a word."""
    cut = F.when(F.length("text") > most, F.concat(F.regexp_replace(F.substring("text", 1, most), r"\s+\S*$", ""), F.lit("…"))).otherwise(F.col("text"))
    line = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), cut)
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return cards.groupBy(key).agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("block"))

"""Laboratory reports as text: lines to rows, scanned digits, ranges, severity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import constants as C
from tessella.functions import text as X


def aliases(spark: SparkSession) -> DataFrame:
    """(exam, alias, place): a table of fixed size, to be broadcast."""
    rows = [(exam, a, i) for i, (exam, names) in enumerate(C.EXAMS.items()) for a in names]
    return spark.createDataFrame(rows, "exam string, alias string, place int")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of a text that aren't empty, with their number from 0."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "text")).where(F.trim("text") != "")


def exam_of(text: Column) -> Column:
    """The first test one of whose aliases stands in the text as a word."""
    low, out = F.lower(text), None
    for exam, names in C.EXAMS.items():
        pattern = r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(n.replace("(", r"\(").replace(")", r"\)") for n in names) + r")(?:$|[^\p{L}\p{N}_])"
        out = F.when(low.rlike(pattern), exam) if out is None else out.when(low.rlike(pattern), exam)
    return out


def lab_rows(report: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, exam, value, word, unit) of the lines that name a test, mended; a test read twice counts once, its first line."""
    names = "|".join(a.replace("(", r"\(").replace(")", r"\)") for names in C.EXAMS.values() for a in sorted(names, key=len, reverse=True))
    word = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{names})(?:$|[^\p{{L}}\p{{N}}_])"
    near = lines(report, key, text).where(F.lower("text").rlike(word)).withColumn("text", mended(F.col("text")))  # one look before sixteen
    found = near.withColumn("exam", exam_of(F.col("text"))).where("exam is not null")
    rest = F.lower("text")
    for _ in range(2):  # names side by side share the sign between them
        rest = F.regexp_replace(rest, rf"(^|[^\p{{L}}\p{{N}}_])(?:{names})($|[^\p{{L}}\p{{N}}_])", "$1 $2")
    number = F.regexp_extract(rest, r"(-?\d+(?:[.,]\d+)?)", 1)
    said = F.nullif(F.regexp_extract(rest, r"(positive|negative|dương tính|âm tính)", 1), F.lit(""))
    rows = found.select(
        key,
        "line",
        "exam",
        X.number(number).alias("value"),
        said.alias("word"),
        F.nullif(F.regexp_extract(F.lower("text"), r"(k/ul|m/ul|g/dl|u/l|mmol/l|umol/l|%)", 1), F.lit("")).alias("unit"),
    )
    return rows.groupBy(key, "exam").agg(F.min(F.struct("line", "value", "word", "unit")).alias("r")).select(key, "exam", "r.*")


def exam_name(raw: Column) -> Column:
    """The test of a name: that whose name or alias it is, else the first one of whose aliases it holds, else the name itself."""
    key, exact, part = X.basic(raw), None, None
    for exam, names in C.EXAMS.items():
        same, inside = key.isin(exam.lower(), *names), F.lit(False)
        for n in names:
            inside = inside | key.contains(n)
        exact = F.when(same, exam) if exact is None else exact.when(same, exam)
        part = F.when(inside, exam) if part is None else part.when(inside, exam)
    return F.coalesce(exact, part, F.trim(raw))


def default_range(exam: Column) -> Column:
    """The reference range of a test that has one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in C.RANGES.items() for x in kv]), exam)


def range_flag(value: Column, low: Column, high: Column) -> Column:
    """unknown, low, high or normal, against a range that may be open at one end."""
    return F.when(value.isNull() | (low.isNull() & high.isNull()), "unknown").when(value < low, "low").when(value > high, "high").otherwise("normal")


def form_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, exam, value, flag) of a form's lines NAME,VALUE,FLAG; lines without a name go, the flag is that of the
    test's range where the form gives none."""
    cell = lambda k: F.nullif(F.trim(F.get(F.split("text", ","), k)), F.lit(""))
    rows = lines(df, key, text).select(key, "line", cell(0).alias("name"), X.number(cell(1)).alias("value"), F.lower(cell(2)).alias("said")).where("name is not null")
    low, high = X.range_ends(F.col("range"))
    named = rows.withColumn("exam", exam_name(F.col("name"))).withColumn("range", default_range(F.col("exam"))).withColumns({"low": low, "high": high})
    return named.select(key, "line", "exam", "value", F.coalesce("said", range_flag(F.col("value"), F.col("low"), F.col("high"))).alias("flag"))


def lab_nodes(rows: DataFrame, key: str) -> DataFrame:
    """(key, node): the graph's nodes that rows (key, exam, value, flag) switch on, each once."""
    e, v, f = F.upper("exam"), F.col("value"), F.coalesce(F.lower("flag"), F.lit(""))
    node = (
        F.when((e == "PLT") & ((f == "low") | (v < 100)), "tieu_cau_thap")
        .when((e == "HCT") & (f == "high"), "hct_cao")
        .when(e.isin("AST", "ALT") & ((f == "high") | (v > 50)), "ast_alt_cao")
        .when((e == "WBC") & (f == "low"), "bach_cau_thap")
        .when(e.contains("HFLC") & (v > 10), "hflc_cao")
    )
    return rows.select(key, node.alias("node")).where("node is not null").distinct()


def sign_nodes(rows: DataFrame, key: str) -> DataFrame:
    """(key, node): the graph's nodes of the signs (boolean columns) that are there and on, each once."""
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(s), n) for s, n in C.SIGN_NODES.items() if s in rows.columns])))
    return rows.select(key, F.explode(hits).alias("node"))


def flagged(rows: DataFrame, value: str, low: Column, high: Column) -> DataFrame:
    """unknown, low, high or normal, against a range."""
    v = F.col(value)
    return rows.withColumn("flag", range_flag(v, low, high))


def mended(line: Column) -> Column:
    """A line whose number-like words are freed of look-alike letters; its white space stays."""
    return F.array_join(F.transform(F.regexp_extract_all(line, F.lit(r"([ \t\f\r]+|[^ \t\f\r]+)"), 1), lambda t: X.scanned_number(t)), "")


def repaired(text: Column) -> Column:
    """A text whose lines that tell of laboratory results are mended; other lines stay."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.lower(x).rlike("|".join(C.LAB_WORDS)), mended(x)).otherwise(x)), "\n")


def severity_rules(latest: DataFrame) -> DataFrame:
    """Level, red flags, warnings, evidence and completeness from the latest PLT, WBC, HCT, AST, ALT and serology, trends and signs.

    latest: one row for each patient with columns plt, wbc, hct, ast, alt (double) and serology (boolean), and any of the
    clinical signs, of hct_up_plt_down (a warning) and of hct_drop_suspicious (a red flag) as boolean columns. Muscle
    pain or pain behind the eyes is evidence by itself, though none that is listed.
    """
    sign = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in latest.columns else F.lit(False)
    plt, wbc, hct = F.col("plt"), F.col("wbc"), F.col("hct")
    liver = F.coalesce(F.greatest("ast", "alt"), F.lit(0.0))
    low_plt = F.coalesce(plt < 50, F.lit(False))
    listed = lambda *rules: F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))
    red = listed(("plt<20", plt < 20), ("liver>=1000", liver >= 1000), ("liver>=300,plt<50", (liver >= 300) & (liver < 1000) & low_plt), ("hct drop", sign("hct_drop_suspicious")), *[(s, sign(s)) for s in C.RED_SIGNS])
    warning = listed(("plt<50", (plt >= 20) & (plt < 50)), ("liver>=300", (liver >= 300) & (liver < 1000) & ~low_plt), ("liver>=200", (liver >= 200) & (liver < 300)), ("hct up, plt down", sign("hct_up_plt_down")), *[(s, sign(s)) for s in C.WARNING_SIGNS])
    evidence = listed(("plt<150", (plt >= 50) & (plt < 150)), ("wbc<=4.5", wbc <= 4.5), ("hct>=45", hct >= 45), ("serology", F.col("serology")))
    known = sum(F.col(c).isNotNull().cast("int") for c in ("plt", "wbc", "hct", "ast", "alt")) + F.coalesce(F.col("serology").cast("int"), F.lit(0))
    minor = F.lit(False)
    for s in C.MINOR_SIGNS:
        minor = minor | sign(s)
    out = latest.select("patient", red.alias("red"), warning.alias("warning"), evidence.alias("evidence"), minor.alias("minor"), known.alias("n_known"))
    level = F.when(F.size("red") > 0, "red flag").when(F.size("warning") > 0, "warning").when((F.size("evidence") > 0) | F.col("minor"), "evidence").otherwise("insufficient")
    complete = F.when(F.col("n_known") >= 5, "high").when(F.col("n_known") >= 3, "medium").otherwise("low")
    return out.withColumn("level", level).withColumn("completeness", complete).drop("minor")


ADVICE = {"red flag": "urgent review", "warning": "close follow-up", "evidence": "repeat tests", "insufficient": "collect data"}


def advised(rules: DataFrame) -> DataFrame:
    """The recommendation of each level."""
    return rules.withColumn("advice", F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])[F.col("level")])


def rebuilt(words: DataFrame, key: str) -> DataFrame:
    """Text of each page from scanned words (key, line, place, word, confidence): words by line, lines in order, mean confidence."""
    return rebuilt_lines(words.groupBy(key, "line").agg(F.collect_list(F.struct("place", "word", "confidence")).alias("words")), key)


def rebuilt_lines(lines: DataFrame, key: str) -> DataFrame:
    """As rebuilt, from (key, line, words): a line's words as an array of (place, word, confidence). A line is joined where it is
    read, so that its text alone is shuffled; lines without words are left out."""
    said = F.array_join(F.transform(F.sort_array("words"), lambda w: w["word"]), " ")
    known = F.filter(F.transform("words", lambda w: w["confidence"].cast("double")), lambda c: c.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, c: a + c), F.size(known))
    line = lines.where(F.size("words") > 0).select(key, "line", said.alias("said"), mean.alias("c"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("line", "said"))), lambda x: x["said"])
    return line.groupBy(key).agg(F.array_join(each, "\n").alias("text"), F.avg("c").alias("confidence"))

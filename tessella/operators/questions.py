"""What a question asks for: filters, day, measure, symptom, intent, kind; and the codes and names that go with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import constants as C
from tessella.functions import text as X


def _any(q: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | q.contains(p)
    return out


def _first(rules: list[tuple[Column, object]]) -> Column:
    out = None
    for hit, value in rules:
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def filters(question: Column) -> Column:
    """The filters that a question names, as a struct (sex, history, severity); null where it names none.

    A woman is asked for by her word, or by the unaccented one that stands alone; a history of the disease is negated by
    a "no" anywhere, and its own words don't name a severity.
    """
    q = F.lower(question)
    woman = q.contains("nữ") | F.concat(F.lit(" "), q, F.lit(" ")).contains(" nu ")
    history = _any(q, C.HISTORY)
    rest = q
    for h in C.HISTORY:
        rest = F.replace(rest, F.lit(h), F.lit(" "))
    negated = q.contains("không") | q.contains("khong")
    return F.struct(
        F.when(woman, "nữ").when(q.contains("nam"), "nam").alias("sex"),
        F.when(history, F.when(negated, 0).otherwise(1)).alias("history"),
        X.first_match(F.when(history, rest).otherwise(q), list(C.SEVERITIES.items())).alias("severity"),
    )


def day(question: Column) -> Column:
    """The day that a question names: "ngày 5", else "n5" or "n 5" as a word."""
    q = F.lower(question)
    named = F.regexp_extract(q, r"ngày\s*(\d+)", 1)
    short = F.regexp_extract(q, r"(?:^|[^\p{L}\p{N}_])n\s*(\d+)(?:$|[^\p{L}\p{N}_])", 1)
    return F.when(named != "", named).when(short != "", short).try_cast("int")


def _longest(names: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(names.items(), key=lambda kv: -len(kv[0]))


def measure(question: Column) -> Column:
    """The measure whose longest name stands in a question."""
    return X.first_match(F.lower(question), _longest(C.MEASURES))


def symptom(question: Column) -> Column:
    """The symptom whose longest name stands in a question."""
    return X.first_match(F.lower(question), _longest(C.SYMPTOMS))


def intent(question: Column) -> Column:
    """One of eight intents by ordered rules, or null."""
    q = F.lower(F.trim(question))
    symptoms, cohort = _any(q, C.SYMPTOM_WORDS), _any(F.concat(F.lit(" "), q, F.lit(" ")), C.COHORT_WORDS)
    rules = [(_any(q, C.BLEEDING), "top_bleeding_site"), (_any(q, C.OTHER_SYMPTOMS), "top_other_symptoms"), (cohort & symptoms, "cohort_query")]
    rules += [(_any(q, phrases), name) for name, phrases in C.INTENTS.items()]
    return _first([*rules, (~symptoms & ~cohort & _any(q, C.OVERVIEW), "overview_count")])


def kind(question: Column, has_context: Column) -> Column:
    """patient if a question refers to one, or there is one in context and it doesn't sound general; else general."""
    q = F.lower(question)
    return F.when(X.any_match(q, C.PATIENT) | (has_context & ~X.any_match(q, C.GENERAL)), "patient").otherwise("general")


def asks_prescription(question: Column) -> Column:
    return X.any_match(F.lower(question), C.PRESCRIPTION)


def has_patient_data(n_reports: Column, signs: list[Column], fever_days: Column, comorbidity: Column, rule: Column, n_trends: Column) -> Column:
    """Whether anything is known of a patient: reports, a sign, days of fever, an illness, a rule's level, a trend."""
    some = (F.coalesce(n_reports, F.lit(0)) > 0) | rule.isNotNull() | (F.coalesce(n_trends, F.lit(0)) > 0)
    some = some | (F.coalesce(fever_days, F.lit(0)) != 0) | (F.coalesce(comorbidity, F.lit("")) != "")
    for s in signs:
        some = some | F.coalesce(s, F.lit(False))
    return some


def severity_group(note: Column) -> Column:
    """The group of a severity note; null and empty are unknown."""
    x = F.lower(F.trim(F.coalesce(note, F.lit(""))))
    return _first([
        (x.isin("", "nan"), "không rõ"), (x.contains("soc") | x.contains("sox"), "sốc / nặng"), (x.contains("canhbao"), "cảnh báo sốt xuất huyết"), (x == "sxh", "sốt xuất huyết"),
    ]).otherwise("khác")


def sex_label(code: Column) -> Column:
    """1 is a man, 2 a woman; other codes stay, none is unknown."""
    x = F.trim(F.coalesce(code.cast("string"), F.lit("")))
    return F.when(x == "1", "nam").when(x == "2", "nữ").when(x.isin("", "nan"), "không rõ").otherwise(x)


def label_code(label: Column, mode: str = "multiclass") -> Column:
    """Codes of the labels 1, 2, 3: from 0 on (multiclass), or of the warning models; others have none."""
    codes = {"multiclass": (0, 1, 2), "binary_warning": (1, 0, 2)}[mode]
    return _first([(label == k + 1, code) for k, code in enumerate(codes)])


def severity_node(text: Column) -> Column:
    """The graph's node of a grade as rules or people name it."""
    t = F.lower(text)
    grades = [(["nặng", "soc", "sốc"], "sxhd_nang"), (["cảnh báo", "canh bao", "warning"], "sxhd_canh_bao"), (["thường", "thuong", "common"], "sxhd_thuong")]
    return _first([(_any(t, words), node) for words, node in grades])


def named(code: Column, names: dict[str, str]) -> Column:
    """A code as people read it; codes without a name stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code), code)


def filters_text(found: Column) -> Column:
    """The filters of `filters` in words."""
    parts = F.array(
        F.concat(F.lit("nhóm "), found["severity"]),
        F.concat(F.lit("giới tính "), found["sex"]),
        F.when(found["history"] == 1, "có tiền căn SXH").when(found["history"] == 0, "không có tiền căn SXH"),
    )
    said = F.array_join(F.array_compact(parts), ", ")
    return F.when(said == "", "toàn bộ bệnh nhân").otherwise(said)


def report_time(first: Column, number: Column) -> Column:
    """The day of report `number` (from 1) of files that name none: one a day from `first` on."""
    return F.date_add(first, number - 1)


def parsed_time(raw: Column) -> Column:
    """A time as text, or null where it is none."""
    return F.try_to_timestamp(raw)


def short_id() -> Column:
    """Eight random hexadecimal digits."""
    return F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 8)

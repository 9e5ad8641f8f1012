"""Queries of questions, codes, rules, nodes, logs and folds over the driver's tables, with their SQL twins.

Questions are the user's whole messages with a phrase of the clinic after them, by turn.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import constants as C
from tessella.functions import text as X
from tessella.operators import cohort, evaluate, forms, graph, labtext, model, position, questions, series, sessions

from .clinical import _CUBE, _LATEST
from .common import CLASSED, MEASURES, OBS, classed, obs, rounded, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


PHRASES = [
    "Có bao nhiêu bệnh nhân?", "Tiểu cầu ngày 5 ở nhóm cảnh báo là bao nhiêu", "Bệnh nhân nữ không có tiền căn sxh bị đau bụng", "giới tính nam", "so sánh HCT N4 và N6",
    "Vị trí xuất huyết nào hay gặp", "triệu chứng khác", "tuổi trung bình của nhóm sốc", "liều paracetamol bao nhiêu mg", "phân loại sxh là gì", "bệnh lý nền hay gặp", "PLT = 50 thì sao", "khi nào cần nhập viện", "benh nhan nu",
]
_PHRASE = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_ASK = f"a AS (SELECT conv_id, turn, text || ' ' || {_PHRASE}[CAST((conv_id + turn) % {len(PHRASES)} AS INT) + 1] AS question FROM conversations WHERE role = 'user'), q AS (SELECT *, lower(question) AS q, lower(trim(question)) AS t FROM a)"


def _asked(spark, d):
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("conv_id") + F.col("turn")) % len(PHRASES)).cast("int") + 1)
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat("text", F.lit(" "), phrase).alias("question"))


def _has(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


def _case(column: str, names: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{k}') THEN '{v}'" for k, v in names.items()) + " END"


def _longest(names: dict[str, str]) -> dict[str, str]:
    return dict(sorted(names.items(), key=lambda kv: -len(kv[0])))


_HISTORY = _has("q", C.HISTORY)
_REST = f"CASE WHEN {_HISTORY} THEN replace(replace(q, '{C.HISTORY[0]}', ' '), '{C.HISTORY[1]}', ' ') ELSE q END"
_SEX = "CASE WHEN contains(q, 'nữ') OR contains(' ' || q || ' ', ' nu ') THEN 'nữ' WHEN contains(q, 'nam') THEN 'nam' END"
_FILTERS = f"f AS (SELECT conv_id, turn, {_SEX} AS sex, CASE WHEN {_HISTORY} THEN CASE WHEN contains(q, 'không') OR contains(q, 'khong') THEN 0 ELSE 1 END END AS history, {_case('r', C.SEVERITIES)} AS severity FROM (SELECT *, {_REST} AS r FROM q))"


@query(
    "question_filters",
    f"WITH {_ASK}, {_FILTERS} SELECT *, coalesce(nullif(concat_ws(', ', 'nhóm ' || severity, 'giới tính ' || sex, CASE history WHEN 1 THEN 'có tiền căn SXH' WHEN 0 THEN 'không có tiền căn SXH' END), ''), 'toàn bộ bệnh nhân') AS said FROM f",
)
def question_filters(spark, d):
    found = _asked(spark, d).withColumn("f", questions.filters(F.col("question")))
    return found.select("conv_id", "turn", "f.*", questions.filters_text(F.col("f")).alias("said"))


_DAY = "TRY_CAST(coalesce(nullif(regexp_extract(q, 'ngày\\s*(\\d+)', 1), ''), nullif(regexp_extract(q, '(?:^|[^\\p{L}\\p{N}_])n\\s*(\\d+)(?:$|[^\\p{L}\\p{N}_])', 1), '')) AS INT)"


@query("question_parts", f"WITH {_ASK} SELECT conv_id, turn, {_DAY} AS day, {_case('q', _longest(C.MEASURES))} AS measure, {_case('q', _longest(C.SYMPTOMS))} AS symptom FROM q")
def question_parts(spark, d):
    q = F.col("question")
    return _asked(spark, d).select("conv_id", "turn", questions.day(q).alias("day"), questions.measure(q).alias("measure"), questions.symptom(q).alias("symptom"))


_INTENT = (
    f"CASE WHEN {_has('t', C.BLEEDING)} THEN 'top_bleeding_site' WHEN {_has('t', C.OTHER_SYMPTOMS)} THEN 'top_other_symptoms' WHEN s AND c THEN 'cohort_query' "
    + " ".join(f"WHEN {_has('t', p)} THEN '{n}'" for n, p in C.INTENTS.items())
    + f" WHEN NOT s AND NOT c AND {_has('t', C.OVERVIEW)} THEN 'overview_count' END"
)


@query("intent_route", f"""WITH {_ASK}, w AS (SELECT *, {_has("t", C.SYMPTOM_WORDS)} AS s, {_has("' ' || t || ' '", C.COHORT_WORDS)} AS c FROM q) SELECT coalesce({_INTENT}, 'none') AS intent, count(*) AS n FROM w GROUP BY 1""")
def intent_route(spark, d):
    return _asked(spark, d).groupBy(F.coalesce(questions.intent(F.col("question")), F.lit("none")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def _rx(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(q, '{p}')" for p in patterns) + ")"


@query("query_class", f"WITH {_ASK} SELECT conv_id, turn, CASE WHEN {_rx(C.PATIENT)} OR (turn > 0 AND NOT {_rx(C.GENERAL)}) THEN 'patient' ELSE 'general' END AS kind FROM q")
def query_class(spark, d):
    return _asked(spark, d).select("conv_id", "turn", questions.kind(F.col("question"), F.col("turn") > 0).alias("kind"))


@query("prescription_guardrail", f"WITH {_ASK} SELECT conv_id, turn, {_rx(C.PRESCRIPTION)} AS refused FROM q")
def prescription(spark, d):
    return _asked(spark, d).select("conv_id", "turn", questions.asks_prescription(F.col("question")).alias("refused"))


@query("guardrail", f"WITH {_ASK} SELECT turn % 2 AS part, count(*) AS n, count(*) FILTER ({_rx(C.PRESCRIPTION)}) AS refused FROM q GROUP BY 1")
def guardrail(spark, d):
    return _asked(spark, d).groupBy((F.col("turn") % 2).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(questions.asks_prescription(F.col("question"))).alias("refused"))


@query(
    "label_codes",
    "WITH t AS (SELECT 2 - quality + toxic AS label FROM labels) SELECT label, CASE label WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS multiclass, CASE label WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 END AS warning, count(*) AS n FROM t GROUP BY label",
)
def label_codes(spark, d):
    t = table(spark, d, "labels").select((2 - F.col("quality") + F.col("toxic")).alias("label"))
    codes = [questions.label_code(F.col("label"), m).alias(a) for m, a in (("multiclass", "multiclass"), ("binary_warning", "warning"))]
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", *codes, "n")


_NOTES = ["Soc SXH", "canhbao, plt", "SXH ", "", "khac", "soxsxh"]


@query(
    "derived_labels",
    "WITH t AS (SELECT CASE c_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN NULL ELSE 'x' END AS sex, lower(trim(coalesce(CASE WHEN c_custkey % 7 < 6 THEN " + "[" + ", ".join(f"'{n}'" for n in _NOTES) + "][CAST(c_custkey % 7 AS INT) + 1] END, ''))) AS note FROM customer) "
    "SELECT CASE sex WHEN '1' THEN 'nam' WHEN '2' THEN 'nữ' ELSE coalesce(sex, 'không rõ') END AS sex_label, CASE WHEN note = '' THEN 'không rõ' WHEN contains(note, 'soc') OR contains(note, 'sox') THEN 'sốc / nặng' WHEN contains(note, 'canhbao') THEN 'cảnh báo sốt xuất huyết' WHEN note = 'sxh' THEN 'sốt xuất huyết' ELSE 'khác' END AS severity_group, count(*) AS n FROM t GROUP BY ALL",
)
def derived_labels(spark, d):
    sex = F.when(F.col("c_nationkey") % 4 == 0, "1").when(F.col("c_nationkey") % 4 == 1, "2").when(F.col("c_nationkey") % 4 == 3, "x")
    note = F.get(F.array(*[F.lit(n) for n in _NOTES]), (F.col("c_custkey") % 7).cast("int"))
    labels = table(spark, d, "customer").select(questions.sex_label(sex).alias("sex_label"), questions.severity_group(note).alias("severity_group"))
    return labels.groupBy("sex_label", "severity_group").agg(F.count(F.lit(1)).alias("n"))


@query("display_names", "SELECT CASE event_type WHEN 'view' THEN 'tiểu cầu' WHEN 'click' THEN 'bạch cầu' ELSE event_type END AS name, count(*) AS n FROM events GROUP BY 1")
def display_names(spark, d):
    code = F.when(F.col("event_type") == "view", "tieucau").when(F.col("event_type") == "click", "bachcau").otherwise(F.col("event_type"))
    return table(spark, d, "events").groupBy(questions.named(code, C.MEASURE_NAMES).alias("name")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = ["PLT", " Tiểu cầu (TC)", "hct;", "Hematocrit 1", "dengue NS1Ag test", "p_unknown", "gpt", "Na+"]
_FORM = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


def _forms(spark, d):
    """Two form lines for each part: a test's name, a value, and a flag on every third."""
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % 8).cast("int"))
    first = F.concat(name, F.lit(", "), (F.col("p_size") * 5).cast("string"), F.lit(","), F.when(F.col("p_partkey") % 3 == 0, "HIGH").otherwise(""))
    return table(spark, d, "part").select("p_partkey", F.concat(first, F.lit("\n"), F.lit("WBC,"), (F.col("p_size") % 12).cast("string"), F.lit(",5")).alias("text"))


_ALIASES = ", ".join(f"{{'e': '{e}', 'n': [{', '.join(f"'{n}'" for n in names)}]}}" for e, names in C.EXAMS.items())
_LOW = "CASE e " + " ".join(f"WHEN '{k}' THEN {v.split('-')[0]}" for k, v in C.RANGES.items()) + " END"
_HIGHEST = "CASE e " + " ".join(f"WHEN '{k}' THEN {v.split('-')[1].split(' ')[0]}" for k, v in C.RANGES.items()) + " END"
_FORMS = f"""p AS (SELECT p_partkey, 0 AS line, trim({_FORM}[CAST(p_partkey % 8 AS INT) + 1]) AS name, CAST(p_size * 5 AS DOUBLE) AS value, CASE WHEN p_partkey % 3 = 0 THEN 'high' END AS said FROM part UNION ALL SELECT p_partkey, 1, 'WBC', p_size % 12, '5' FROM part),
k AS (SELECT *, trim(regexp_replace(lower(replace(name, ';', ',')), '\\s+', ' ', 'g')) AS key, [{_ALIASES}] AS al FROM p),
m AS (SELECT p_partkey, line, value, said, coalesce(list_filter(al, lambda a: lower(a.e) = key OR list_contains(a.n, key))[1].e, list_filter(al, lambda a: len(list_filter(a.n, lambda x: contains(key, x))) > 0)[1].e, name) AS e FROM k),
fr AS (SELECT p_partkey, line, e AS exam, value, coalesce(said, CASE WHEN value IS NULL OR {_LOW} IS NULL THEN 'unknown' WHEN value < {_LOW} THEN 'low' WHEN value > {_HIGHEST} THEN 'high' ELSE 'normal' END) AS flag FROM m)"""


@query("form_rows", f"WITH {_FORMS} SELECT * FROM fr")
def form_rows(spark, d):
    return labtext.form_rows(_forms(spark, d), "p_partkey", "text")


@query(
    "lab_nodes",
    f"WITH {_FORMS}, n AS (SELECT DISTINCT p_partkey, CASE WHEN upper(exam) = 'PLT' AND (flag = 'low' OR value < 100) THEN 'tieu_cau_thap' WHEN upper(exam) = 'HCT' AND flag = 'high' THEN 'hct_cao' WHEN upper(exam) IN ('AST', 'ALT') AND (flag = 'high' OR value > 50) THEN 'ast_alt_cao' WHEN upper(exam) = 'WBC' AND flag = 'low' THEN 'bach_cau_thap' WHEN contains(upper(exam), 'HFLC') AND value > 10 THEN 'hflc_cao' END AS node FROM fr) SELECT node, count(*) AS n FROM n WHERE node IS NOT NULL GROUP BY node",
)
def lab_nodes(spark, d):
    rows = labtext.form_rows(_forms(spark, d), "p_partkey", "text")
    return labtext.lab_nodes(rows, "p_partkey").groupBy("node").agg(F.count(F.lit(1)).alias("n"))


_SIGNS = [*C.WARNING_SIGNS, *C.RED_SIGNS, *C.MINOR_SIGNS]


def _signed(spark, d):
    """The latest values of each patient with trend flags and clinical signs, a sign on every few patients."""
    last = lambda m, k: F.max_by(F.when(F.col("measure") == m, F.col("value")), F.when((F.col("measure") == m) & F.col("value").isNotNull(), F.col("day"))) * k
    latest = obs(spark, d).groupBy("patient").agg(last("view", 6.0).alias("plt"), last("click", 0.2).alias("wbc"), last("error", 1.0).alias("hct"), last("purchase", 1.0).alias("ast"), last("signup", 1.0).alias("alt"))
    flags = series.trend_flags(obs(spark, d), "view", "click", ("error", "signup")).select("patient", F.col("both").alias("hct_up_plt_down"))
    signs = {s: F.col("patient") % (29 + 2 * i) == 1 for i, s in enumerate(_SIGNS)}
    drop = F.col("patient") % 61 == 0
    return latest.join(flags, "patient", "left").withColumns(signs | {"serology": F.col("patient") % 7 == 0, "hct_drop_suspicious": drop})


_LATEST2 = _LATEST.replace("* 2 AS plt", "* 6 AS plt").replace("* 4 AS ast", "* 1 AS ast").replace("* 3 AS alt", "* 1 AS alt")
_ON = lambda names: "[" + ", ".join(f"CASE WHEN patient % {29 + 2 * _SIGNS.index(s)} = 1 THEN '{s}' END" for s in names) + "]"
_RULED = f"""s AS (SELECT *, value - lag(value) OVER w AS step, row_number() OVER (PARTITION BY patient, measure ORDER BY day DESC) AS back FROM obs WHERE value IS NOT NULL WINDOW w AS (PARTITION BY patient, measure ORDER BY day)),
tf AS (SELECT patient, coalesce(bool_and(step < 0) FILTER (measure = 'view' AND back <= 2), false) AND coalesce(bool_or(step > 0) FILTER (measure = 'click'), false) AS updown FROM s WHERE step IS NOT NULL GROUP BY patient),
l AS (SELECT patient, {_LATEST2}, patient % 7 = 0 AS serology FROM obs GROUP BY patient), l2 AS (SELECT l.*, coalesce(updown, false) AS updown, coalesce(greatest(ast, alt), 0) AS liver, coalesce(plt < 50, false) AS lowp FROM l LEFT JOIN tf ON tf.patient = l.patient),
r AS (SELECT patient, len(list_filter([CASE WHEN plt < 20 THEN 'a' END, CASE WHEN liver >= 1000 OR liver >= 300 AND lowp THEN 'b' END, CASE WHEN patient % 61 = 0 THEN 'c' END], lambda x: x IS NOT NULL)) + len(list_filter({_ON(C.RED_SIGNS)}, lambda x: x IS NOT NULL)) AS n_red,
len(list_filter([CASE WHEN plt >= 20 AND plt < 50 THEN 'a' END, CASE WHEN liver >= 200 AND liver < 1000 AND NOT (liver >= 300 AND lowp) THEN 'b' END, CASE WHEN updown THEN 'c' END], lambda x: x IS NOT NULL)) + len(list_filter({_ON(C.WARNING_SIGNS)}, lambda x: x IS NOT NULL)) AS n_warning,
len(list_filter([CASE WHEN plt >= 50 AND plt < 150 THEN 'a' END, CASE WHEN wbc <= 4.5 THEN 'b' END, CASE WHEN hct >= 45 THEN 'c' END, CASE WHEN serology THEN 'd' END], lambda x: x IS NOT NULL)) AS n_evidence, len(list_filter({_ON(C.MINOR_SIGNS)}, lambda x: x IS NOT NULL)) AS n_minor FROM l2)"""


@query(
    "clinical_rules",
    f"WITH {OBS}, {_RULED} SELECT patient, n_red, n_warning, n_evidence, CASE WHEN n_red > 0 THEN 'red flag' WHEN n_warning > 0 THEN 'warning' WHEN n_evidence > 0 OR n_minor > 0 THEN 'evidence' ELSE 'insufficient' END AS level FROM r",
)
def clinical_rules(spark, d):
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return labtext.severity_rules(_signed(spark, d)).select("patient", n("red"), n("warning"), n("evidence"), "level")


@query("sign_nodes", f"WITH {OBS}, p AS (SELECT DISTINCT patient FROM obs), n AS (SELECT DISTINCT patient, unnest([" + ", ".join(f"CASE WHEN patient % {29 + 2 * _SIGNS.index(s)} = 1 THEN '{C.SIGN_NODES[s]}' END" for s in _SIGNS if s in C.SIGN_NODES) + "]) AS node FROM p) SELECT node, count(*) AS n FROM n WHERE node IS NOT NULL GROUP BY node")
def sign_nodes(spark, d):
    return labtext.sign_nodes(_signed(spark, d), "patient").groupBy("node").agg(F.count(F.lit(1)).alias("n"))


_GRADES = ["SXHD nặng", "Severe / sốc", "có dấu hiệu cảnh báo", "warning", "thường", "common", "none"]


@query(
    "severity_nodes",
    f"WITH g AS (SELECT [{', '.join(f"'{g}'" for g in _GRADES)}][CAST(o_orderkey % 7 AS INT) + 1] AS t FROM orders) SELECT CASE WHEN contains(lower(t), 'nặng') OR contains(lower(t), 'soc') OR contains(lower(t), 'sốc') THEN 'sxhd_nang' WHEN contains(lower(t), 'cảnh báo') OR contains(lower(t), 'canh bao') OR contains(lower(t), 'warning') THEN 'sxhd_canh_bao' WHEN contains(lower(t), 'thường') OR contains(lower(t), 'thuong') OR contains(lower(t), 'common') THEN 'sxhd_thuong' END AS node, count(*) AS n FROM g GROUP BY 1",
)
def severity_nodes(spark, d):
    grade = F.get(F.array(*[F.lit(g) for g in _GRADES]), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, d, "orders").groupBy(questions.severity_node(grade).alias("node")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "patient_data_known",
    f"WITH {OBS}, p AS (SELECT patient, count(value) AS n FROM obs WHERE measure = 'error' GROUP BY patient) SELECT count(*) FILTER (n > 0 OR patient % 5 = 1 OR patient % 3 = 0 OR patient % 4 = 2) AS known, count(*) AS n FROM p",
)
def patient_data_known(spark, d):
    p = obs(spark, d).where("measure = 'error'").groupBy("patient").agg(F.count("value").alias("n"))
    i = F.col("patient")
    has = questions.has_patient_data(F.col("n"), [i % 5 == 1], F.when(i % 3 == 0, 4), F.when(i % 4 == 2, "x"), F.lit(None).cast("string"), F.lit(0))
    return p.agg(F.count_if(has).alias("known"), F.count(F.lit(1)).alias("n"))


@query(
    "reasoning_edges",
    f"WITH {OBS}, {_RULED}, e AS (SELECT unnest([CASE WHEN plt < 150 THEN 'platelet_low>dengue_suspicion:supports' END, CASE WHEN wbc <= 4.5 THEN 'wbc_low>dengue_suspicion:supports' END, CASE WHEN updown THEN 'hct_rising_plus_plt_falling>warning_pattern:supports' END, CASE WHEN patient % 2 = 0 THEN 'warning_pattern>supportive_care:escalates_to' END, 'avoid_nsaids>dengue_suspicion:contraindicated_in_context']) AS edge FROM l2) SELECT edge, count(*) AS n FROM e WHERE edge IS NOT NULL GROUP BY edge",
)
def reasoning_edges(spark, d):
    rows = _signed(spark, d).select("patient", (F.col("plt") < 150).alias("plt_low"), (F.col("wbc") <= 4.5).alias("wbc_low"), "hct_up_plt_down", F.when(F.col("patient") % 2 == 0, "SXHD có dấu hiệu cảnh báo").otherwise("thường").alias("level"))
    edge = F.concat("src", F.lit(">"), "dst", F.lit(":"), "relation")
    return graph.reasoning(rows, "patient").groupBy(edge.alias("edge")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "relation_edges",
    "WITH n AS (SELECT s_suppkey, ['symptom', 'warning_sign', 'lab', 'drug', 'intervention'][CAST(s_suppkey % 5 AS INT) + 1] AS type, CASE WHEN s_suppkey % 15 = 1 THEN 'tay_chan_lanh' WHEN s_suppkey % 15 = 2 THEN 'hflc_cao' ELSE 's' || s_suppkey END AS id FROM supplier), "
    "e AS (SELECT id AS src, unnest(CASE type WHEN 'symptom' THEN ['sxhd_thuong:supports:1.0'] WHEN 'warning_sign' THEN CASE WHEN id = 'tay_chan_lanh' THEN ['sxhd_canh_bao:warning_of:1.0', 'sxhd_nang:warning_of:1.5'] ELSE ['sxhd_canh_bao:warning_of:1.0'] END WHEN 'lab' THEN CASE WHEN id = 'hflc_cao' THEN ['sxhd_thuong:supports:1.0'] ELSE ['sxhd_canh_bao:supports:1.0'] END "
    "WHEN 'drug' THEN CASE WHEN s_suppkey % 2 = 0 THEN ['sxhd_thuong:contraindicated_for:1.0', 'sxhd_canh_bao:contraindicated_for:1.0', 'sxhd_nang:contraindicated_for:1.0'] ELSE ['sxhd_thuong:treats:1.0', 'sxhd_canh_bao:treats:1.0'] END ELSE ['sxhd_nang:treats:1.0'] END) AS edge FROM n) SELECT edge, count(*) AS n FROM e GROUP BY edge",
)
def relation_edges(spark, d):
    k = F.col("s_suppkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("symptom", "warning_sign", "lab", "drug", "intervention")]), (k % 5).cast("int"))
    name = F.when(k % 15 == 1, "tay_chan_lanh").when(k % 15 == 2, "hflc_cao").otherwise(F.concat(F.lit("s"), k.cast("string")))
    nodes = table(spark, d, "supplier").select(name.alias("id"), kind.alias("type"), (k % 2 == 0).alias("contraindicated"), F.array(F.lit("sxhd_nang")).alias("treats"))
    edge = F.concat("dst", F.lit(":"), "relation", F.lit(":"), F.col("weight").cast("string"))
    return graph.related(nodes).groupBy(edge.alias("edge")).agg(F.count(F.lit(1)).alias("n"))


_SAID = [p.replace(r"\s*", " ") for _, _, _, p, _ in graph.concept_patterns() if not set(p.replace(r"\s*", "")) & set(r"\.*?+()[]|")]


def _guideline(spark, d):
    """Each whole text with a phrase of the guideline before it."""
    said = F.get(F.array(*[F.lit(x) for x in _SAID]), (F.col("doc_id") % len(_SAID)).cast("int"))
    return graph.concept_matches(table(spark, d, "documents").select("doc_id", F.concat(F.upper(said), F.lit("\n"), "text").alias("text")), "doc_id", "text")


_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_MATCHED = f"""known AS (SELECT * FROM (VALUES {", ".join(f"({_QUOTED(k)}, {_QUOTED(c)}, {i}, {_QUOTED(p)})" for k, c, i, p, _ in graph.concept_patterns())}) t(type, concept, place, pattern)),
pages AS (SELECT doc_id AS page, regexp_replace(upper(([{", ".join(map(_QUOTED, _SAID))}])[CAST(doc_id % {len(_SAID)} AS INT) + 1]) || chr(10) || text, '[\\s\\x{{00a0}}]+', ' ', 'g') AS flat FROM documents),
hits AS (SELECT page, type, concept, place, flat, regexp_extract(flat, '(?i)' || pattern) AS found FROM pages JOIN known ON regexp_matches(flat, '(?i)' || pattern)),
told AS (SELECT page, type, concept, place, substr(trim(substr(flat, greatest(instr(flat, found) - 100, 1), instr(flat, found) - greatest(instr(flat, found) - 100, 1)) || '[' || found || ']' || substr(flat, instr(flat, found) + length(found), 100)), 1, 300) AS snippet FROM hits)"""


@query("guideline_matches", f"WITH {_MATCHED} SELECT * FROM told")
def guideline_matches(spark, d):
    return _guideline(spark, d)


@query("guideline_nodes", f"WITH {_MATCHED} SELECT concept AS id, type, count(DISTINCT page) AS n_pages, min(page) AS first_page, arg_min(snippet, page * 1000 + place) AS evidence FROM told GROUP BY ALL")
def guideline_nodes(spark, d):
    return graph.concept_graph(_guideline(spark, d), unseen=False)[0].select("id", "type", "n_pages", "first_page", "evidence")


@query(
    "guideline_edges",
    f"WITH {_MATCHED}, n AS (SELECT DISTINCT concept AS c, type FROM told), e AS (SELECT c AS src, unnest(CASE type WHEN 'symptom' THEN ['sxhd_thuong:supports:1.0'] "
    f"WHEN 'warning_sign' THEN CASE WHEN c IN ({', '.join(map(_QUOTED, C.SEVERE_WARNINGS))}) THEN ['sxhd_canh_bao:warning_of:1.0', 'sxhd_nang:warning_of:1.5'] ELSE ['sxhd_canh_bao:warning_of:1.0'] END "
    f"WHEN 'lab' THEN CASE WHEN c IN ({', '.join(map(_QUOTED, C.MILD_LABS))}) THEN ['sxhd_thuong:supports:1.0'] ELSE ['sxhd_canh_bao:supports:1.0'] END "
    f"WHEN 'drug' THEN CASE WHEN c <> 'paracetamol' THEN ['sxhd_thuong:contraindicated_for:1.0', 'sxhd_canh_bao:contraindicated_for:1.0', 'sxhd_nang:contraindicated_for:1.0'] ELSE ['sxhd_thuong:treats:1.0', 'sxhd_canh_bao:treats:1.0'] END "
    f"WHEN 'intervention' THEN CASE c WHEN 'oresol' THEN ['sxhd_thuong:treats:1.0'] WHEN 'theo_doi_ngoai_tru' THEN ['sxhd_thuong:treats:1.0'] WHEN 'truyen_dich_tinh_mach' THEN ['sxhd_canh_bao:treats:1.0', 'sxhd_nang:treats:1.0'] WHEN 'nhap_vien_theo_doi' THEN ['sxhd_canh_bao:treats:1.0'] ELSE ['sxhd_nang:treats:1.0'] END ELSE [] END) AS edge FROM n) SELECT src, edge FROM e",
)
def guideline_edges(spark, d):
    edges = graph.concept_graph(_guideline(spark, d), unseen=False)[1]
    return edges.select("src", F.concat("dst", F.lit(":"), "relation", F.lit(":"), F.col("weight").cast("string")).alias("edge"))


def _log(spark, d):
    """Events as a log of sessions: one for each user and fifth of his events."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "renamed").when((F.col("event_type") == "error") & (F.col("event_id") % 11 == 0), "deleted").otherwise("message")
    role = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "click", "assistant")
    said = F.when(F.col("event_type") == "signup", F.concat(F.lit(sessions.DEFAULT_TITLE), F.lit(" mới"))).otherwise(F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")))
    session = F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string"))
    time = F.format_string("%012d", F.col("event_id"))
    return e.select(session.alias("session"), kind.alias("event"), time.alias("time"), role.alias("role"), said.alias("content"))


_LOG = """lg AS (SELECT user_id || '-' || (event_id % 5) AS session, CASE WHEN event_type = 'signup' THEN 'created' WHEN event_type = 'purchase' THEN 'renamed' WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'deleted' ELSE 'message' END AS event, printf('%012d', event_id) AS time,
CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' END AS role, CASE WHEN event_type = 'signup' THEN 'Cuộc trò chuyện mới' ELSE event_type || ' ' || event_id END AS content FROM events),
st AS (SELECT session, min(time) AS created, max(time) AS updated, count(*) FILTER (event = 'message') AS n_messages, count(*) FILTER (event = 'deleted') AS gone, arg_max(content, time) FILTER (event = 'renamed') AS name, arg_min(content, time) FILTER (event = 'message' AND role = 'user') AS first, arg_min(content, time) FILTER (event = 'created') AS opened FROM lg GROUP BY session),
ss AS (SELECT session, coalesce(name, first, opened, 'Untitled') AS title, created, updated, n_messages FROM st WHERE gone = 0)"""


@query("session_states", f"WITH {_LOG} SELECT * FROM ss")
def session_states(spark, d):
    return sessions.state(_log(spark, d))


@query("sessions_listed", f"WITH {_LOG} SELECT * FROM ss ORDER BY updated DESC, session LIMIT 15")
def sessions_listed(spark, d):
    return sessions.listed(sessions.state(_log(spark, d)))


@query(
    "report_times",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(date_trunc('day', o_orderdate) AS DATE) END AS day, CAST(DATE '2024-01-01' + CAST(o_orderkey % 10 AS INT) - 1 AS DATE) AS given FROM orders",
)
def report_times(spark, d):
    raw = F.when(F.col("o_orderkey") % 9 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    given = questions.report_time(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 10).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", questions.parsed_time(raw).cast("date").alias("day"), given.alias("given"))


@query(
    "demographics_cube",
    f"WITH base AS (SELECT 'acctbal' AS measure, 0 AS day, CAST(1 + c_nationkey % 3 AS INT) AS class, c_acctbal AS value FROM customer UNION ALL SELECT 'spent', 0, CAST(1 + c_nationkey % 3 AS INT), o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey) SELECT measure, day, class, {_CUBE} FROM base GROUP BY ALL",
)
def demographics_cube(spark, d):
    people = table(spark, d, "customer").withColumn("class", (1 + F.col("c_nationkey") % 3).cast("int"))
    row = lambda df, m, c: df.select(F.lit(m).alias("measure"), F.lit(0).alias("day"), "class", F.col(c).alias("value"))
    spent = table(spark, d, "orders").join(people, F.col("c_custkey") == F.col("o_custkey"))
    return rounded(position.cube(row(people, "acctbal", "c_acctbal").unionByName(row(spent, "spent", "o_totalprice"))))


@query("most_common_types", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def most_common_types(spark, d):
    return cohort.most_common(table(spark, d, "part"), "p_type", 5)


_SCORES = "sc AS (SELECT 2 - quality + toxic AS label, [n_chars % 97, n_chars % 89, n_chars % 83] AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
_AUC = "SELECT avg(a) AS auc FROM (SELECT class, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS a FROM (SELECT class, y, avg(k) OVER (PARTITION BY class, s) AS r FROM (SELECT class, label = class AS y, p[class] AS s, row_number() OVER (PARTITION BY class ORDER BY p[class]) AS k FROM sc, (SELECT unnest([1, 2, 3]) AS class))) GROUP BY class)"


@query("auc_one_against_rest", f"WITH {_SCORES} SELECT round(1e-9 + auc, 6) AS auc FROM ({_AUC})")
def auc_one_against_rest(spark, d):
    docs = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    scored = docs.select((2 - F.col("quality") + F.col("toxic")).alias("label"), F.array(*[(F.col("n_chars") % k).cast("double") for k in (97, 89, 83)]).alias("p"))
    return rounded(evaluate.ovr_auc(scored, "label", "p", (1, 2, 3)))


@query(
    "fold_means",
    "WITH f AS (SELECT c_acctbal, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':42'), c_custkey) - 1) % 5 AS INT) AS fold FROM customer), m AS (SELECT fold, avg(c_acctbal) AS acctbal FROM f GROUP BY fold) SELECT round(1e-9 + avg(acctbal), 6) AS acctbal_mean, round(1e-9 + stddev_pop(acctbal), 6) AS acctbal_std FROM m",
)
def fold_means(spark, d):
    dealt = model.stratified_folds(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey", "c_mktsegment")
    return rounded(evaluate.over_folds(dealt.groupBy("fold").agg(F.avg("c_acctbal").alias("acctbal")), ["acctbal"]))


@query("half_even", "SELECT p_partkey, round_even(p_retailprice / 4, 1) AS quarter FROM part")
def half_even(spark, d):
    return table(spark, d, "part").select("p_partkey", X.rounded_even(F.col("p_retailprice") / 4, 1).alias("quarter"))


@query(
    "lab_tables",
    f"WITH {_FORMS} SELECT p_partkey, string_agg('- ' || exam || ': ' || coalesce(printf('%.1f', value), '?') || ' u' || CASE WHEN flag IN ('low', 'high') THEN ' [' || flag || ']' ELSE '' END, chr(10) ORDER BY exam, line) AS block FROM fr GROUP BY p_partkey HAVING count(DISTINCT exam) = 2",
)
def lab_tables(spark, d):
    rows = labtext.form_rows(_forms(spark, d), "p_partkey", "text").withColumn("unit", F.lit("u"))
    two = rows.groupBy("p_partkey").agg(F.count_distinct("exam").alias("k")).where("k = 2").select("p_partkey")
    return forms.lab_table(rows, "p_partkey").join(two, "p_partkey", "left_semi")


@query(
    "missingness_entry",
    f"WITH {CLASSED.split(', base AS')[0]}, near AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER p AS ld, last_value(value IGNORE NULLS) OVER p AS lv, first_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER n AS rd, first_value(value IGNORE NULLS) OVER n AS rv FROM obs WINDOW p AS (PARTITION BY patient, measure ORDER BY day ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY patient, measure ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
    "fl AS (SELECT patient, measure, day, value IS NULL AND rd - ld - 1 BETWEEN 1 AND 3 AS fill, value IS NOT NULL OR coalesce(value IS NULL AND rd - ld - 1 BETWEEN 1 AND 3, false) AS has FROM near) SELECT measure, day, count(*) FILTER (fill) AS imputed, count(*) FILTER (has) AS observed FROM fl GROUP BY ALL",
)
def missingness_entry(spark, d):
    done = series.with_missingness(obs(spark, d), MEASURES, "spline", max_gap=3)
    return done.groupBy("measure", "day").agg(F.sum("imputed").alias("imputed"), F.sum("mask").alias("observed"))


@query("train_imputed")
def train_imputed(spark, d):
    """Folds and holdout of boosted trees on values, masks and deltas after gaps are filled; the class goes by a patient's mean value."""
    base = classed(spark, d)
    labels = base.groupBy("patient").agg((F.avg("value") > 49).cast("int").alias("label"))
    return model.train_with_imputation(obs(spark, d), labels, "label", ["view", "click"], [3, 4, 5], folds=2, rounds=5)


@query("feature_importance")
def feature_importance(spark, d):
    base = series.trends(obs(spark, d)).groupBy("patient").agg(*[F.max(F.when(F.col("measure") == m, F.col("last_value"))).alias(m) for m in MEASURES], F.sum("n_observed").cast("double").alias("n"))
    return model.top_features(base.withColumn("class", (F.col("n") > 51).cast("int")), [*MEASURES, "n"], "class", 3, rounds=5)

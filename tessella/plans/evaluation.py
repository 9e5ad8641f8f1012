"""Queries of the evaluation, session and routing operators over the driver's tables, with their SQL twins.

Truth is 1 + (1 - quality) + toxic; the prediction is a rule on n_chars, the confidence a share of doc_id, the latency
n_chars: they exercise the formulas and mean nothing else.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import constants as C
from tessella.operators import evaluate, forms, sessions

from .common import rounded, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _records(spark, d, cut: int = 2000):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rule = F.when(F.col("n_chars") % 11 == 0, None).when(F.col("n_chars") < cut // 4, 3).when(F.col("n_chars") < cut, 1).otherwise(2)
    return labels.join(docs, "doc_id").select(
        "doc_id",
        (2 - F.col("quality") + F.col("toxic")).alias("truth"),
        rule.cast("int").alias("predicted"),
        ((F.col("doc_id") % 101) / 100.0).alias("confidence"),
        F.col("text").alias("answer"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("because")).alias("reasoning"),
        F.col("n_chars").cast("double").alias("latency_ms"),
    )


def _rec(name: str = "r", cut: int = 2000) -> str:
    return f"""{name} AS (SELECT l.doc_id, 2 - quality + toxic AS truth, CASE WHEN n_chars % 11 = 0 THEN NULL WHEN n_chars < {cut // 4} THEN 3 WHEN n_chars < {cut} THEN 1 ELSE 2 END AS predicted,
  (l.doc_id % 101) / 100.0 AS confidence, text AS answer, CAST(n_chars AS DOUBLE) AS latency_ms FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _agree(r: str, p: str) -> str:
    """CTEs that end in one row `{p}agree` of agreement metrics."""
    return f"""{p}v AS (SELECT truth AS t, predicted AS p FROM {r} WHERE truth IN (1, 2, 3) AND predicted IN (1, 2, 3)),
{p}k AS (SELECT unnest([1, 2, 3]) AS class), {p}n AS (SELECT count(*) AS n FROM {p}v),
{p}pc AS (SELECT class, count(*) FILTER (t = class AND p = class) AS hit, count(*) FILTER (t = class) AS support, count(*) FILTER (p = class) AS said FROM {p}k, {p}v GROUP BY class),
{p}s AS (SELECT class, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS "precision", CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, CASE WHEN said + support > 0 THEN 2.0 * hit / (said + support) ELSE 0 END AS f1, support, said, hit FROM {p}pc),
{p}e AS (SELECT sum(CASE WHEN a.class = b.class THEN a.support * b.said ELSE 0 END) / (n * n) AS pe, sum(power(a.class - b.class, 2) / 4 * a.support * b.said) / n AS ew FROM {p}s a, {p}s b, {p}n GROUP BY n),
{p}o AS (SELECT avg(CASE WHEN t = p THEN 1.0 ELSE 0 END) AS po, sum(power(t - p, 2) / 4) AS ow, avg(abs(t - p)) AS mae FROM {p}v),
{p}agree AS (SELECT n, po AS accuracy, CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) ELSE 0 END AS kappa, CASE WHEN ew <> 0 THEN 1 - ow / ew ELSE 0 END AS qwk, mae AS ordinal_mae,
(SELECT avg(recall) FROM {p}s WHERE support > 0) AS balanced_accuracy, (SELECT avg(f1) FROM {p}s WHERE support > 0) AS macro_f1, (SELECT sum(f1 * support) / sum(support) FROM {p}s) AS weighted_f1 FROM {p}n, {p}e, {p}o)"""


def _out(columns: list[str]) -> str:
    return ", ".join(f"round(1e-9 + {c}, 6) AS {c}" for c in columns)


_AGREE = ["accuracy", "kappa", "qwk", "ordinal_mae", "balanced_accuracy", "macro_f1", "weighted_f1"]
_SAFE = """safe0 AS (SELECT count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_invalid, count(*) FILTER (NOT ok AND truth = 3) AS n_invalid_severe, count(*) FILTER (ok AND p < truth) AS n_under, count(*) FILTER (ok AND p > truth) AS n_over,
count(*) FILTER (ok AND p = truth) AS n_exact, count(*) FILTER (ok AND truth = 3 AND p = 1) AS critical_misses, count(*) FILTER (ok AND truth = 3 AND p = 3) AS tp, count(*) FILTER (ok AND truth <> 3 AND p = 3) AS fp, count(*) FILTER (ok AND truth = 3 AND p <> 3) AS fn, count(*) FILTER (ok AND truth <> 3 AND p <> 3) AS tn
FROM (SELECT truth, predicted AS p, truth IS NOT NULL AND predicted IS NOT NULL AS ok FROM r)),
safe AS (SELECT *, n_under / n_valid AS under_rate, n_over / n_valid AS over_rate, n_exact / n_valid AS exact_rate, tp / nullif(tp + fn, 0) AS severe_recall, tp / nullif(tp + fp, 0) AS severe_precision, tn / nullif(tn + fn, 0) AS severe_npv FROM safe0)"""
_RATES = ["under_rate", "over_rate", "exact_rate", "severe_recall", "severe_precision", "severe_npv"]
_COUNTS = "n_valid, n_invalid, n_invalid_severe, n_under, n_over, n_exact, critical_misses, tp, fp, fn, tn"
_BINS = "bins AS (SELECT CAST(confidence >= 0.2 AS INT) + CAST(confidence >= 0.4 AS INT) + CAST(confidence >= 0.6000000000000001::DOUBLE AS INT) + CAST(confidence >= 0.8 AS INT) AS bin, count(*) AS n, avg(confidence) AS confidence, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0 END) AS accuracy, sum(power(confidence - CASE WHEN truth = predicted THEN 1 ELSE 0 END, 2)) AS squares FROM (SELECT truth, predicted, CAST(confidence AS DOUBLE) AS confidence FROM r) WHERE predicted IS NOT NULL AND confidence BETWEEN 0 AND 1 GROUP BY 1)"


@query("confusion", f"WITH {_rec()} SELECT truth, " + ", ".join(f"count(*) FILTER (predicted = {c}) AS predicted_{c}" for c in (1, 2, 3)) + " FROM r WHERE truth IN (1, 2, 3) AND predicted IN (1, 2, 3) GROUP BY truth")
def confusion(spark, d):
    return evaluate.confusion(_records(spark, d))


@query("class_prf", f'WITH {_rec()}, {_agree("r", "x")} SELECT class, round(1e-9 + "precision", 6) AS "precision", {_out(["recall", "f1"])}, support FROM xs')
def class_prf(spark, d):
    return rounded(evaluate.per_class(_records(spark, d)))


@query("agreement", f"WITH {_rec()}, {_agree('r', 'x')} SELECT n, {_out(_AGREE)} FROM xagree")
def agreement(spark, d):
    return rounded(evaluate.agreement(_records(spark, d)))


@query("safety", f"WITH {_rec()}, {_SAFE} SELECT {_COUNTS}, {_out(_RATES)} FROM safe")
def safety(spark, d):
    return rounded(evaluate.safety(_records(spark, d)))


@query("deploy_readiness", f"WITH {_rec()}, {_SAFE} SELECT critical_misses, {_out(['under_rate', 'severe_recall'])}, critical_misses = 0 AND under_rate <= 0.1 AND severe_recall >= 0.9 AS deployable FROM safe")
def deploy(spark, d):
    return rounded(evaluate.deployable(evaluate.safety(_records(spark, d))))


@query("calibration_bins", f"WITH {_rec()}, {_BINS} SELECT bin, n, {_out(['confidence', 'accuracy', 'squares'])} FROM bins")
def calibration_bins(spark, d):
    return rounded(evaluate.calibration(_records(spark, d)))


@query("calibration", f"WITH {_rec()}, {_BINS} SELECT round(1e-9 + sum(squares) / sum(n), 6) AS brier, round(1e-9 + sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM bins")
def calibration(spark, d):
    return rounded(evaluate.calibration_error(evaluate.calibration(_records(spark, d))))


_CITE = "(?i)(token|mail|page)\\s*[=.]"
_LAB = "(?i)(stupid|idiot|trash)"


@query(
    "response_quality",
    f"WITH {_rec()}, w AS (SELECT trim(answer) AS a, predicted, doc_id % 3 = 0 AS re FROM r), x AS (SELECT length(a) AS c, len(list_filter(regexp_split_to_array(a, '\\s+'), lambda v: v <> '')) AS w, regexp_matches(a, '{_CITE}') AS ci, regexp_matches(a, '{_LAB}') AS la, re, predicted IS NOT NULL AS ok FROM w) "
    "SELECT round(1e-9 + avg(c), 6) AS chars_mean, round(1e-9 + median(c), 6) AS chars_median, round(1e-9 + avg(w), 6) AS words_mean, round(1e-9 + median(w), 6) AS words_median, round(1e-9 + avg(CAST(ci AS INT)), 6) AS citation_rate, round(1e-9 + avg(CAST(la AS INT)), 6) AS lab_rate, round(1e-9 + avg(CAST(re AS INT)), 6) AS reasoning_rate, round(1e-9 + avg(CAST(ok AS INT)), 6) AS parse_rate FROM x",
)
def response_quality(spark, d):
    return rounded(evaluate.answers(_records(spark, d), _CITE, _LAB))


@query("latency", f"WITH {_rec()} SELECT round(1e-9 + quantile_cont(latency_ms, 0.5), 6) AS p50, round(1e-9 + quantile_cont(latency_ms, 0.95), 6) AS p95, round(1e-9 + avg(latency_ms), 6) AS mean, max(latency_ms) AS longest, sum(latency_ms) AS total FROM r")
def latency(spark, d):
    return rounded(evaluate.latency(_records(spark, d)))


_SAID = ["chars_mean", "words_mean", "citation_rate", "lab_rate", "reasoning_rate", "parse_rate", "chars_median", "words_median"]


@query(
    "evaluation_report",
    f"WITH {_rec()}, {_agree('r', 'x')}, {_SAFE}, {_BINS}, w AS (SELECT trim(answer) AS a, predicted, doc_id % 3 = 0 AS re FROM r), "
    f"y AS (SELECT length(a) AS c, len(list_filter(regexp_split_to_array(a, '\\s+'), lambda v: v <> '')) AS w, regexp_matches(a, '{C.CITATION}') AS ci, regexp_matches(a, '{C.LAB_NUMBER}') AS la, re, predicted IS NOT NULL AS ok FROM w), "
    "said AS (SELECT avg(c) AS chars_mean, avg(w) AS words_mean, avg(CAST(ci AS INT)) AS citation_rate, avg(CAST(la AS INT)) AS lab_rate, avg(CAST(re AS INT)) AS reasoning_rate, avg(CAST(ok AS INT)) AS parse_rate, median(c) AS chars_median, median(w) AS words_median FROM y), "
    "took AS (SELECT quantile_cont(latency_ms, 0.5) AS latency_p50, quantile_cont(latency_ms, 0.95) AS latency_p95, avg(latency_ms) AS latency_mean, max(latency_ms) AS latency_longest FROM r) "
    f"SELECT n, {_out(_AGREE)}, {_COUNTS.replace('n_valid, ', '')}, {_out(_RATES)}, round(1e-9 + (SELECT sum(squares) / sum(n) FROM bins), 6) AS brier, round(1e-9 + (SELECT sum(n * abs(confidence - accuracy)) / sum(n) FROM bins), 6) AS ece, "
    f"{_out(_SAID)}, {_out(['latency_p50', 'latency_p95', 'latency_mean', 'latency_longest'])} FROM xagree, safe, said, took",
)
def evaluation_report(spark, d):
    return rounded(evaluate.report(_records(spark, d)))


@query(
    "record_status",
    f"WITH {_rec()} SELECT CASE WHEN predicted IS NULL THEN 'unread' WHEN predicted = truth THEN 'correct' WHEN truth = 3 AND predicted = 1 THEN 'critical miss' WHEN predicted < truth THEN 'under' ELSE 'over' END AS status, count(*) AS n FROM r GROUP BY 1",
)
def record_status(spark, d):
    return _records(spark, d).groupBy(evaluate.status(F.col("truth"), F.col("predicted")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


_HIGH, _LOW = ["accuracy", "kappa", "qwk", "macro_f1"], ["ordinal_mae"]
_AB = f"""WITH {_rec()}, {_rec("r2", 4000)}, {_agree("r", "x")}, {_agree("r2", "y")}, two AS (""" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {1 if m in _HIGH else -1} AS sign, x.{m} AS a, y.{m} AS b FROM xagree x, yagree y" for m in _HIGH + _LOW
) + "), won AS (SELECT metric, a, b, b - a AS delta, CASE WHEN abs(b - a) < 1e-9 THEN 'tie' WHEN sign * (b - a) > 0 THEN 'b' ELSE 'a' END AS winner FROM two)"


def _compared(spark, d):
    return evaluate.compare(evaluate.agreement(_records(spark, d)), evaluate.agreement(_records(spark, d, 4000)), _HIGH, _LOW)


@query("ab_compare", f"{_AB} SELECT metric, {_out(['a', 'b', 'delta'])}, winner FROM won")
def ab_compare(spark, d):
    return rounded(_compared(spark, d))


@query("ab_wins", f"{_AB} SELECT winner, count(*) AS n FROM won GROUP BY winner")
def ab_wins(spark, d):
    return evaluate.wins(_compared(spark, d))


@query(
    "roc_auc_rank",
    "WITH s AS (SELECT toxic AS y, n_chars % 997 AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id), k AS (SELECT y, avg(r) OVER (PARTITION BY s) AS r FROM (SELECT y, s, row_number() OVER (ORDER BY s) AS r FROM s)) "
    "SELECT round(1e-9 + (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM k",
)
def roc_auc(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("s", (F.col("n_chars") % 997).cast("double"))
    return rounded(evaluate.auc(joined, "toxic", "s"))


@query(
    "parse_json_answer",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 END AS predicted, CASE WHEN event_type IN ('view', 'click', 'error', 'signup') THEN round(1e-9 + CAST(json_extract_string(props, '$.k') AS INT) / 100.0, 6) END AS confidence FROM events""",
)
def parse_json_answer(spark, d):
    events = table(spark, d, "events")
    label = F.create_map(*[F.lit(x) for kv in {"view": "Thường", "click": " cảnh báo ", "error": "SEVERE", "signup": "none"}.items() for x in kv])
    k = (F.get_json_object("props", "$.k").cast("int") / 100).cast("string")
    answer = F.concat(F.lit('first {"label": "old", "confidence": 0} then ```json {"label": "'), F.coalesce(F.try_element_at(label, F.col("event_type")), F.lit("")), F.lit('", "confidence": '), k, F.lit("}```"))
    broken = F.when(F.col("event_type") == "purchase", F.lit("no answer")).otherwise(answer)
    return rounded(forms.parsed_answers(events.withColumn("raw", broken), "event_id", "raw").drop("reasoning"))


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", F.col("text").alias("content"))


@query("session_summary", "SELECT conv_id AS session, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user, max(turn) AS last_turn FROM conversations GROUP BY 1")
def session_summary(spark, d):
    return sessions.summaries(_turns(spark, d))


@query("session_history", "SELECT * FROM (SELECT conv_id AS session, turn, role, text AS content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS back FROM conversations WHERE role IN ('user', 'assistant')) WHERE back <= 6")
def session_history(spark, d):
    return sessions.history(_turns(spark, d))


@query(
    "session_title",
    "SELECT session, CASE WHEN length(c) <= 60 THEN c ELSE regexp_replace(substr(c, 1, 60), '\\s+\\S*$', '') || '...' END AS title FROM (SELECT conv_id AS session, trim(regexp_replace(min_by(text, turn), '\\s+', ' ', 'g')) AS c FROM conversations WHERE role = 'user' GROUP BY 1)",
)
def session_title(spark, d):
    return sessions.titles(_turns(spark, d))


@query("session_latest", "SELECT conv_id AS session, max(turn) AS turn, max_by(role, turn) AS role, max_by(text, turn) AS content FROM conversations GROUP BY 1")
def session_latest(spark, d):
    return sessions.latest(_turns(spark, d))


@query("session_nested", "SELECT conv_id AS session, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def session_nested(spark, d):
    m = sessions.nested(_turns(spark, d))
    return m.select("session", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"))

"""Queries of the cohort, series, position and laboratory operators over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import boosting, cohort, forms, labtext, model, position, series

from .common import CLASSED, FILLED, MEASURES, OBS, classed, last_day, obs, rounded, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_DESCRIBE = """count({c}) AS n, round(1e-9 + quantile_cont({c}, 0.25), 6) AS q1, round(1e-9 + quantile_cont({c}, 0.5), 6) AS median, round(1e-9 + quantile_cont({c}, 0.75), 6) AS q3,
  round(1e-9 + avg({c}), 6) AS mean, round(1e-9 + stddev_samp({c}), 6) AS sd, round(1e-9 + min({c}), 6) AS lowest, round(1e-9 + max({c}), 6) AS highest"""
_TRUST = "CASE WHEN {s} >= 0.7 THEN 'high' WHEN {s} >= 0.4 THEN 'medium' WHEN {s} >= 0.2 THEN 'low' ELSE 'very low' END"


@query(
    "daily_stats",
    f"WITH {OBS} SELECT measure, day, {_DESCRIBE.format(c='value')}, count(*) AS total, round(1e-9 + count(value) / count(*), 6) AS coverage, {_TRUST.format(s='count(value) / count(*)')} AS trust FROM obs GROUP BY measure, day",
)
def daily_stats(spark, d):
    return rounded(cohort.daily_stats(obs(spark, d)))


@query("age_stats", f"SELECT {_DESCRIBE.format(c='o_totalprice')} FROM orders")
def age_stats(spark, d):
    orders = table(spark, d, "orders")
    ends = orders.agg(*[c for c in cohort.moments("o_totalprice")])
    return rounded(ends.crossJoin(position.quantiles(orders, [], "o_totalprice", {"q1": 0.25, "median": 0.5, "q3": 0.75})))


@query(
    "presence_rates",
    f"WITH {CLASSED} SELECT measure, class, count(value) AS n_present, count(*) FILTER (value > 20) AS n_positive, round(1e-9 + count(value) / count(*), 6) AS present_rate, round(1e-9 + count(*) FILTER (value > 20) / count(*), 6) AS positive_rate FROM base GROUP BY ALL",
)
def presence_rates(spark, d):
    return rounded(cohort.presence(classed(spark, d).withColumn("value", F.col("value") - 20), ["measure", "class"]))


@query("value_counts_with_null", "SELECT nullif(o_orderstatus, 'P') AS value, count(*) AS n, round(1e-9 + count(*) / (SELECT count(*) FROM orders), 6) AS rate FROM orders GROUP BY 1")
def value_counts(spark, d):
    orders = table(spark, d, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    return rounded(cohort.value_counts(orders, "s"))


_CELL = "replace(p_name || ';' || p_type || ' ; ' || p_brand, ' ', ',')"
_PARTS = f"list_filter(list_transform(string_split(trim(regexp_replace(lower(replace({_CELL}, ';', ',')), '\\s+', ' ', 'g')), ','), lambda x: trim(x)), lambda x: x <> '')"


def _cell(c=None):
    return F.replace(F.concat("p_name", F.lit(";"), "p_type", F.lit(" ; "), "p_brand"), F.lit(" "), F.lit(","))


@query("token_counts", f"SELECT token, count(*) AS n, round(1e-9 + count(*) / (SELECT count(*) FROM part), 6) AS rate FROM (SELECT unnest({_PARTS}) AS token FROM part) GROUP BY token")
def token_counts(spark, d):
    return rounded(cohort.token_counts(table(spark, d, "part"), _cell()))


@query(
    "before_after_cleaning",
    f"""WITH t AS (SELECT {_PARTS} AS p FROM part), b AS (SELECT token, count(*) AS n FROM (SELECT unnest(p) AS token FROM t) GROUP BY 1),
a AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(p, lambda x: CASE x WHEN 'blue' THEN 'cold' WHEN 'green' THEN 'cold' WHEN 'ring' THEN 'widget' ELSE x END))) AS token FROM t) GROUP BY 1)
SELECT coalesce(b.token, a.token) AS token, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM b FULL JOIN a ON a.token = b.token""",
)
def before_after(spark, d):
    return cohort.before_after(table(spark, d, "part"), _cell(), {"blue": "cold", "green": "cold", "ring": "widget"})


@query("cohort_filter_count", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' AND c_nationkey = 3")
def cohort_filter(spark, d):
    found = cohort.matching(table(spark, d, "customer"), {"c_mktsegment": "Building", "c_nationkey": 3, "absent": "x"})
    return found.agg(F.count(F.lit(1)).alias("n"))


@query(
    "cohort_symptom_rate",
    "SELECT c_mktsegment AS segment, count(*) AS n, round(1e-9 + avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1",
)
def cohort_symptom_rate(spark, d):
    joined = cohort.matching(table(spark, d, "orders"), {"o_orderstatus": "f"}).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    high = (F.col("o_totalprice") > 250000).cast("double")
    return rounded(joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.avg(high).alias("rate")))


@query(
    "class_distribution_full",
    "SELECT s.c_mktsegment, count(c.c_custkey) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer UNION SELECT 'NONE') s LEFT JOIN customer c ON c.c_mktsegment = s.c_mktsegment AND c.c_acctbal > 9000 GROUP BY 1",
)
def class_distribution(spark, d):
    customers = table(spark, d, "customer")
    classes = customers.select("c_mktsegment").union(spark.range(1).select(F.lit("NONE"))).distinct()
    return cohort.class_counts(customers.where("c_acctbal > 9000"), "c_mktsegment", classes)


@query(
    "severity_from_text",
    "SELECT CASE WHEN o_orderpriority LIKE '4%' THEN NULL WHEN lower(o_orderpriority) SIMILAR TO '.*(urgent|high).*' THEN 2 WHEN lower(o_orderpriority) LIKE '%medium%' THEN 1 ELSE 0 END AS severity, count(*) AS n FROM orders GROUP BY 1",
)
def severity_from_text(spark, d):
    note = F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority"))
    return table(spark, d, "orders").groupBy(cohort.severity(note, "urgent|high", "medium").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


_MASK = "CAST(value IS NOT NULL AS INT) AS mask, coalesce(day - last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER (PARTITION BY patient, measure ORDER BY day ROWS UNBOUNDED PRECEDING), -1) AS delta"


@query("missing_mask_delta", f"WITH {OBS} SELECT patient, measure, day, value, {_MASK} FROM obs")
def missing_mask(spark, d):
    return series.mask_delta(obs(spark, d))


@query(
    "imputed_mask_delta",
    f"WITH {FILLED}, o2 AS (SELECT patient, measure, day, value FROM filled) SELECT patient, measure, day, round(1e-9 + value, 6) AS value, {_MASK} FROM o2",
)
def imputed_mask(spark, d):
    return rounded(series.mask_delta(series.impute_linear(obs(spark, d)).drop("imputed")))


@query("gap_linear_impute", f"WITH {FILLED} SELECT patient, measure, day, round(1e-9 + value, 6) AS value, imputed FROM filled")
def gap_linear(spark, d):
    return rounded(series.impute_linear(obs(spark, d)))


@query(
    "gap_report",
    f"WITH {FILLED} SELECT measure, day, count(*) FILTER (value IS NOT NULL AND imputed = 0) AS observed, count(*) FILTER (imputed = 1) AS imputed, count(*) FILTER (value IS NULL) AS kept_null FROM filled GROUP BY measure, day",
)
def gap_report(spark, d):
    return series.gap_report(obs(spark, d))


@query("gap_noise_impute")
def gap_noise(spark, d):
    return series.impute_linear(obs(spark, d).withColumn("measure", F.when(F.col("measure") == "view", "PLT").otherwise(F.col("measure"))), seed=42)


@query("gap_spline")
def gap_spline(spark, d):
    return series.impute_spline(obs(spark, d))


@query("gap_chained")
def gap_chained(spark, d):
    return series.impute_chained(obs(spark, d), MEASURES, rounds=3)


@query(
    "trend_features",
    f"""WITH {OBS}, s AS (SELECT *, value - lag(value) OVER (PARTITION BY patient, measure ORDER BY day) AS step FROM obs)
SELECT patient, measure, max(value) AS highest, min(value) AS lowest, round(1e-9 + max(value) - min(value), 6) AS spread, min_by(value, CASE WHEN value IS NOT NULL THEN day END) AS first_value,
max_by(value, CASE WHEN value IS NOT NULL THEN day END) AS last_value, count(value) AS n_observed, round(1e-9 + min(step), 6) AS max_dropdown, round(1e-9 + max(step), 6) AS max_rise FROM s GROUP BY patient, measure""",
)
def trend_features(spark, d):
    return rounded(series.trends(obs(spark, d)))


@query(
    "trend_summary",
    f"""WITH {OBS}, s AS (SELECT patient, measure, arg_min(value, day) AS first_value, arg_max(value, day) AS last_value, min(value) AS lo, max(value) AS hi FROM obs WHERE value IS NOT NULL GROUP BY ALL)
SELECT s.patient, s.measure, (SELECT min(day) FROM obs o WHERE o.patient = s.patient AND o.measure = s.measure AND o.value = lo) AS lowest_day,
(SELECT min(day) FROM obs o WHERE o.patient = s.patient AND o.measure = s.measure AND o.value = hi) AS highest_day, first_value, last_value,
CASE WHEN first_value <> 0 THEN round(1e-9 + (last_value - first_value) / first_value * 100, 6) END AS change_pct FROM s""",
)
def trend_summary(spark, d):
    return rounded(series.trend_summary(obs(spark, d)))


@query(
    "trend_flags",
    f"""WITH {OBS}, s AS (SELECT *, value - lag(value) OVER w AS step, row_number() OVER (PARTITION BY patient, measure ORDER BY day DESC) AS back FROM obs WHERE value IS NOT NULL WINDOW w AS (PARTITION BY patient, measure ORDER BY day))
SELECT patient, falling, rising, falling AND rising AS both, either_up FROM (SELECT patient, coalesce(bool_and(step < 0) FILTER (measure = 'view' AND back <= 2), false) AS falling,
coalesce(bool_or(step > 0) FILTER (measure = 'click'), false) AS rising, coalesce(bool_or(step > 0) FILTER (measure IN ('error', 'signup')), false) AS either_up FROM s WHERE step IS NOT NULL GROUP BY patient)""",
)
def trend_flags(spark, d):
    return series.trend_flags(obs(spark, d), "view", "click", ("error", "signup"))


@query(
    "series_pivot",
    f"WITH {OBS} SELECT patient, day, " + ", ".join(f"max(value) FILTER (measure = '{m}') AS {m}" for m in MEASURES) + " FROM obs GROUP BY patient, day",
)
def series_pivot(spark, d):
    return series.last_by_day(obs(spark, d), MEASURES)


@query(
    "report_gap_hours",
    "SELECT user_id, event_id, round(1e-9 + (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3.6e9, 6) AS hours FROM events",
)
def report_gap(spark, d):
    return rounded(series.hours_between(table(spark, d, "events"), "user_id", "ts", "event_id"))


_CUBE = """count(value) AS n, round(1e-9 + avg(value), 6) AS mean, round(1e-9 + quantile_cont(value, 0.5), 6) AS median, round(1e-9 + quantile_cont(value, 0.1), 6) AS q10, round(1e-9 + quantile_cont(value, 0.25), 6) AS q25,
round(1e-9 + quantile_cont(value, 0.75), 6) AS q75, round(1e-9 + quantile_cont(value, 0.9), 6) AS q90, min(value) AS lowest, max(value) AS highest"""


@query("stats_cube", f"WITH {CLASSED} SELECT measure, day, class, {_CUBE} FROM base WHERE value IS NOT NULL GROUP BY measure, day, class")
def stats_cube(spark, d):
    return rounded(position.cube(classed(spark, d)))


@query(
    "stats_cube_full",
    f"""WITH {CLASSED}, c AS (SELECT measure, day, class, {_CUBE} FROM base WHERE value IS NOT NULL GROUP BY measure, day, class),
g AS (SELECT m.measure, CAST(d.day AS INT) AS day, CAST(k.class AS INT) AS class FROM (SELECT DISTINCT measure FROM base) m CROSS JOIN (SELECT unnest(range(1, (SELECT max(day) FROM base) + 3)) AS day) d CROSS JOIN range(1, 4) k(class))
SELECT g.measure, g.day, g.class, """
    + ", ".join(f"coalesce(c.{s}, 0) AS {s}" for s in position.STATS)
    + " FROM g LEFT JOIN c ON c.measure = g.measure AND c.day = g.day AND c.class = g.class",
)
def stats_cube_full(spark, d):
    base = classed(spark, d)
    grid = base.select("measure").distinct().select("measure", F.explode(F.sequence(F.lit(1), F.lit(last_day(spark, d) + 2))).alias("day"))
    return rounded(position.cube(base, grid.select("measure", "day", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("class"))))


@query(
    "admission_day_dist",
    f"WITH {CLASSED} SELECT class, day, count(*) AS n FROM (SELECT patient, class, min(day) AS day FROM base WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY class, day",
)
def admission_day(spark, d):
    return position.first_day_counts(classed(spark, d))


_PLACED = """mine AS (SELECT patient AS query, measure, day, value AS own FROM base WHERE patient % 100 = 0 AND value IS NOT NULL),
placed AS (SELECT m.query, b.measure, b.day, b.class, m.own, 100.0 * count(*) FILTER (b.value <= m.own) / count(*) AS percentile, quantile_cont(b.value, 0.5) AS median FROM base b JOIN mine m ON m.measure = b.measure AND m.day = b.day WHERE b.value IS NOT NULL GROUP BY ALL),
far AS (SELECT *, CASE WHEN median <> 0 THEN abs(own - median) / greatest(median, 1e-6) END AS distance FROM placed)"""


def _placed(spark, d):
    base = classed(spark, d)
    return position.percentiles(base.where("patient % 100 = 0"), base)


@query(
    "percentile_position",
    f"WITH {CLASSED}, {_PLACED} SELECT query, measure, day, class, own, round(1e-9 + percentile, 6) AS percentile, round(1e-9 + median, 6) AS median, round(1e-9 + distance, 6) AS distance FROM far",
)
def percentile_position(spark, d):
    return rounded(_placed(spark, d))


_SCORES = f"""{_PLACED}, per AS (SELECT class, patient, measure, max(CAST(coalesce(value, 0) > 0 AS INT)) AS has FROM base GROUP BY ALL), rt AS (SELECT class, measure, avg(has) AS rate FROM per GROUP BY ALL),
al AS (SELECT p.patient AS query, rt.class, avg(rate) AS alignment FROM per p JOIN rt ON rt.measure = p.measure WHERE p.has = 1 AND p.patient % 100 = 0 GROUP BY ALL),
sc AS (SELECT f.query, f.class, avg(distance) AS mean_distance, count(distance) AS n, any_value(alignment) AS alignment, CASE WHEN count(distance) > 0 THEN 0.7 / (1 + avg(distance)) ELSE 0 END + 0.3 * coalesce(any_value(alignment), 0) AS score FROM far f LEFT JOIN al ON al.class = f.class AND al.query = f.query GROUP BY f.query, f.class)"""


def _scores(spark, d):
    base = classed(spark, d)
    return position.class_scores(_placed(spark, d), position.alignments(base, base.where("patient % 100 = 0")))


@query("class_scores", f"WITH {CLASSED}, {_SCORES} SELECT query, class, round(1e-9 + mean_distance, 6) AS mean_distance, n, round(1e-9 + alignment, 6) AS alignment, round(1e-9 + score, 6) AS score FROM sc")
def class_scores(spark, d):
    return rounded(_scores(spark, d))


@query("class_score_best", f"WITH {CLASSED}, {_SCORES} SELECT query, class, round(1e-9 + score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, class) = 1")
def class_score_best(spark, d):
    return rounded(position.best_class(_scores(spark, d)))


_DIMS = ["click", "error", "view"]


def _medians(spark, d):
    return obs(spark, d).groupBy("patient").agg(*[F.median(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in _DIMS])


_KNN = f"""v AS (SELECT patient, {", ".join(f"quantile_cont(CASE WHEN measure = '{m}' THEN value END, 0.5) AS {m}" for m in _DIMS)} FROM obs GROUP BY patient),
s AS (SELECT {", ".join(f"avg({m}) AS a_{m}, stddev_pop({m}) + 1e-9 AS s_{m}" for m in _DIMS)} FROM v),
p AS (SELECT q.patient AS query, v.patient, round(1e-9 + sqrt({" + ".join(f"coalesce(pow((v.{m} - q.{m}) / s_{m}, 2), 0)" for m in _DIMS)}), 6) AS distance FROM v JOIN v q ON q.patient <> v.patient AND q.patient % 100 = 0, s),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, patient) AS rank FROM p) WHERE rank <= 5)"""


def _neighbours(spark, d):
    vectors = _medians(spark, d)
    return position.nearest(vectors, vectors.where("patient % 100 = 0"), _DIMS, 5)


@query("knn_patients", f"WITH {OBS}, {_KNN} SELECT query, patient, distance, CAST(rank AS INT) AS rank FROM nn")
def knn_patients(spark, d):
    return _neighbours(spark, d)


@query("knn_label_counts", f"WITH {OBS}, {_KNN} SELECT query, CAST(1 + patient % 3 AS INT) AS class, count(*) AS n FROM nn GROUP BY ALL")
def knn_labels(spark, d):
    labels = _medians(spark, d).select("patient", (1 + F.col("patient") % 3).cast("int").alias("class"))
    return position.label_counts(_neighbours(spark, d), labels)


@query(
    "range_flags",
    """SELECT flag, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 48 THEN 'unknown' WHEN l_quantity < lo THEN 'low' WHEN l_quantity > hi THEN 'high' ELSE 'normal' END AS flag
FROM lineitem JOIN (SELECT p_partkey, CAST(regexp_extract(r, '(-?\\d+(?:\\.\\d+)?)\\s*[-–]\\s*(-?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS lo, CAST(regexp_extract(r, '(-?\\d+(?:\\.\\d+)?)\\s*[-–]\\s*(-?\\d+(?:\\.\\d+)?)', 2) AS DOUBLE) AS hi
FROM (SELECT p_partkey, replace((p_size % 10) || ',5 - ' || (p_size + 10) || ' U/L', ',', '.') AS r FROM part)) ON p_partkey = l_partkey) GROUP BY flag""",
)
def range_flags(spark, d):
    text = F.concat((F.col("p_size") % 10).cast("string"), F.lit(",5 - "), (F.col("p_size") + 10).cast("string"), F.lit(" U/L"))
    low, high = X.range_ends(text)
    ranges = table(spark, d, "part").select("p_partkey", low.alias("low"), high.alias("high"))
    rows = table(spark, d, "lineitem").join(ranges, F.col("l_partkey") == F.col("p_partkey")).withColumn("v", F.when(F.col("l_quantity") <= 48, F.col("l_quantity")))
    return labtext.flagged(rows, "v", F.col("low"), F.col("high")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


_LATEST = ", ".join(f"max_by(value, day) FILTER (measure = '{m}' AND value IS NOT NULL) * {k} AS {c}" for m, c, k in (("view", "plt", 2), ("click", "wbc", 0.2), ("error", "hct", 1), ("purchase", "ast", 4), ("signup", "alt", 3)))
_RULES = f"""l AS (SELECT patient, {_LATEST}, patient % 7 = 0 AS serology FROM obs GROUP BY patient), l2 AS (SELECT *, coalesce(greatest(ast, alt), 0) AS liver, coalesce(plt < 50, false) AS lowp,
CAST(plt IS NOT NULL AS INT) + CAST(wbc IS NOT NULL AS INT) + CAST(hct IS NOT NULL AS INT) + CAST(ast IS NOT NULL AS INT) + CAST(alt IS NOT NULL AS INT) + CAST(serology AS INT) AS n_known FROM l),
r AS (SELECT patient, n_known, CASE WHEN plt < 20 OR liver >= 1000 OR (liver >= 300 AND lowp) THEN 'red flag' WHEN plt < 50 OR liver >= 200 THEN 'warning' WHEN plt < 150 OR wbc <= 4.5 OR hct >= 45 OR serology THEN 'evidence' ELSE 'insufficient' END AS level FROM l2)"""


def _rules(spark, d):
    last = lambda m, k: F.max_by(F.when(F.col("measure") == m, F.col("value")), F.when((F.col("measure") == m) & F.col("value").isNotNull(), F.col("day"))) * k
    latest = obs(spark, d).groupBy("patient").agg(last("view", 2.0).alias("plt"), last("click", 0.2).alias("wbc"), last("error", 1.0).alias("hct"), last("purchase", 4.0).alias("ast"), last("signup", 3.0).alias("alt"))
    return labtext.severity_rules(latest.withColumn("serology", F.col("patient") % 7 == 0))


@query("severity_rules", f"WITH {OBS}, {_RULES} SELECT patient, level FROM r")
def severity_rules(spark, d):
    return _rules(spark, d).select("patient", "level")


@query(
    "rule_completeness",
    f"WITH {OBS}, {_RULES} SELECT level, CASE WHEN n_known >= 5 THEN 'high' WHEN n_known >= 3 THEN 'medium' ELSE 'low' END AS completeness, CASE level WHEN 'red flag' THEN 'urgent review' WHEN 'warning' THEN 'close follow-up' WHEN 'evidence' THEN 'repeat tests' ELSE 'collect data' END AS advice, count(*) AS n FROM r GROUP BY ALL",
)
def rule_completeness(spark, d):
    return labtext.advised(_rules(spark, d)).groupBy("level", "completeness", "advice").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stratified_split",
    "SELECT c_custkey, c_mktsegment, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':42'), c_custkey) <= round(count(*) OVER (PARTITION BY c_mktsegment) * 0.2) THEN 'test' ELSE 'train' END AS split FROM customer",
)
def stratified_split(spark, d):
    return model.stratified_split(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


@query(
    "stratified_folds",
    "SELECT c_custkey, c_mktsegment, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':42'), c_custkey) - 1) % 5 AS INT) AS fold FROM customer",
)
def stratified_folds(spark, d):
    return model.stratified_folds(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


@query(
    "balanced_weights",
    "SELECT c_mktsegment, count(*) AS n, round(1e-9 + any_value(w), 6) AS weight FROM customer JOIN (SELECT c_mktsegment AS s, (SELECT count(*) FROM customer) / ((SELECT count(DISTINCT c_mktsegment) FROM customer) * count(*)) AS w FROM customer GROUP BY 1) ON s = c_mktsegment GROUP BY 1",
)
def balanced_weights(spark, d):
    weighted = model.balanced_weights(table(spark, d, "customer"), "c_mktsegment")
    return weighted.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("weight") + 1e-9, 6).alias("weight"))


def _levels(spark, d):
    """Each patient's last value of each measure (null: none) and a class by the number of observations."""
    base = series.trends(obs(spark, d)).groupBy("patient").agg(*[F.max(F.when(F.col("measure") == m, F.col("last_value"))).alias(m) for m in MEASURES], F.sum("n_observed").cast("double").alias("n"))
    return base.withColumn("class", (F.col("n") > 51).cast("int") + (F.col("n") > 56).cast("int"))


@query("train_holdout")
def train_holdout(spark, d):
    return model.train_and_evaluate(_levels(spark, d), "patient", "class", [*MEASURES, "n"], folds=2, rounds=10)


_EDGES = [[10.0, 20.0, 40.0, 80.0]] * len(MEASURES)


@query(
    "boosting_histogram",
    f"""WITH {OBS}, s AS (SELECT patient, measure, arg_max(value, day) FILTER (value IS NOT NULL) AS v, count(value) AS k FROM obs GROUP BY ALL),
b AS (SELECT patient, CAST(sum(k) > 51 AS INT) + CAST(sum(k) > 56 AS INT) AS y, {", ".join(f"max(v) FILTER (measure = '{m}') AS f{i}" for i, m in enumerate(MEASURES))} FROM s GROUP BY patient),
w AS (SELECT y, (SELECT count(*) FROM b) / ((SELECT count(DISTINCT y) FROM b) * count(*)) AS w FROM b GROUP BY y),
p AS (SELECT k, sum(CASE WHEN y = k THEN w ELSE 0 END) / sum(w) AS p FROM b JOIN w USING (y), (SELECT unnest([0, 1, 2]) AS k) GROUP BY k),
g AS (SELECT b.*, k, w * (p - CASE WHEN y = k THEN 1 ELSE 0 END) AS g, w * 1.5 * p * (1 - p) AS h FROM b JOIN w USING (y), p),
u AS (SELECT k, g, h, unnest([{", ".join(f"{{'feature': {i}, 'v': f{i}}}" for i in range(len(MEASURES)))}]) AS x FROM g)
SELECT CAST(k AS INT) AS class, x.feature AS feature, CASE WHEN x.v IS NULL THEN -1 ELSE CAST(x.v > 10 AS INT) + CAST(x.v > 20 AS INT) + CAST(x.v > 40 AS INT) + CAST(x.v > 80 AS INT) END AS bin,
round(1e-9 + sum(g), 6) AS g, round(1e-9 + sum(h), 6) AS h, count(*) AS n FROM u GROUP BY ALL""",
)
def boosting_histogram(spark, d):
    weighted = model.balanced_weights(_levels(spark, d), "class")
    state, _, _ = boosting.started(weighted, MEASURES, "class", ["weight"], 3, _EDGES)
    leaf = F.from_json(F.lit('[[{"feature": [-1]}, {"feature": [-1]}, {"feature": [-1]}]]'), f"array<array<{boosting.TREE}>>")
    return rounded(boosting.histogram(boosting.with_grads(state, 3), leaf, 1, 3, 0).drop("model", "node"))


@query(
    "patient_card",
    f"""WITH {OBS}, l AS (SELECT patient, measure, string_agg('N' || day || '=' || coalesce(printf('%.1f', value + 1e-9), '—'), ' ' ORDER BY day) AS line FROM obs GROUP BY ALL)
SELECT patient, string_agg(measure || ': ' || line, chr(10) ORDER BY measure) AS card, count(*) AS n_lines FROM l GROUP BY patient""",
)
def patient_card(spark, d):
    return forms.patient_cards(obs(spark, d)).select("patient", "card", F.size(F.split("card", "\n")).cast("long").alias("n_lines"))


@query("union_frames", "SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_frames(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query(
    "series_values_thinned",
    f"WITH {OBS}, a AS (SELECT measure, list(value ORDER BY value) AS v FROM obs WHERE value IS NOT NULL GROUP BY measure), i AS (SELECT measure, v, len(v) AS n, unnest(range(100)) AS i FROM a WHERE len(v) > 100) SELECT measure, i AS place, v[CAST(floor(i * (n - 1) / 99) AS INT) + 1] AS value FROM i",
)
def values_thinned(spark, d):
    out = position.thinned_values(obs(spark, d), ["measure"], "value")
    return out.withColumn("place", F.col("place").cast("long"))

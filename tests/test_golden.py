"""Synthetic golden cases: imputation, trends, evaluation, rules, selection."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import boosting, cohort, evaluate, forms, graph, labtext, model, position, retrieval, series, sessions, triage
from tessella.plans import search
from tessella.plans.common import MEASURES


def grid(spark, rows):
    cells = [(p, "plt", d + 1, v) for p, values in rows.items() for d, v in enumerate(values)]
    return spark.createDataFrame([(p, m, d, None if v is None else float(v)) for p, m, d, v in cells], "patient string, measure string, day int, value double")


GAPS = {"P1": [200, None, 150, None, 80], "P2": [None, 150, None, 100, None], "P3": [180, None, None, 120, None]}


def filled(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["patient"], {})[r["day"]] = r["value"]
    return {p: [v[d] for d in sorted(v)] for p, v in out.items()}


def test_linear_gaps(spark):
    done = series.impute_linear(grid(spark, GAPS))
    assert filled(done) == {"P1": [200, 175, 150, 115, 80], "P2": [None, 150, 125, 100, None], "P3": [180, 160, 140, 120, None]}
    total = series.gap_report(grid(spark, GAPS)).agg(F.sum("observed"), F.sum("imputed"), F.sum("kept_null")).first()
    assert tuple(total) == (7, 5, 3)
    masks = {(r["patient"], r["day"]): (r["mask"], r["delta"]) for r in series.mask_delta(done.drop("imputed")).collect()}
    assert {k: v for k, v in masks.items() if v != (1, 0)} == {("P2", 1): (0, -1), ("P2", 5): (0, 1), ("P3", 5): (0, 1)}
    assert filled(series.impute_linear(grid(spark, GAPS), 1))["P3"] == [180, None, None, 120, None]


def test_noise_depends_on_keys_alone(spark):
    df = grid(spark, {f"P{i}": GAPS["P1"] for i in range(40)})
    a, b = (filled(series.impute_linear(x, seed=7)) for x in (df, df.repartition(5)))
    assert a == b and len({v[1] for v in a.values()}) == 40
    assert all(5 <= x <= 800 for v in a.values() for x in v if x is not None)


def test_spline_and_chain_keep_ends(spark):
    df = grid(spark, {"P1": [None, 10, 12, None, 20, 30, None], "P2": [5, None, None, None, None, 6, 7]})
    got = filled(series.impute_spline(df))
    assert got["P1"][0] is None and got["P1"][6] is None and 12 < got["P1"][3] < 20
    assert got["P2"][1] is None
    x, y = np.array([0.0, 1, 2, 4]), np.array([0.0, 1, 2, 4])
    assert np.allclose(series.natural_spline(x, y, np.array([3.0])), 3)
    wide = [(p, m, d, float(p * d + (3 if m == "b" else 0)) if (p + d) % 4 else None) for p in range(1, 9) for m in ("a", "b") for d in range(1, 7)]
    obs = spark.createDataFrame(wide, "patient int, measure string, day int, value double")
    done = {(r["patient"], r["measure"], r["day"]): r for r in series.impute_chained(obs, ["a", "b"], 2).collect()}
    assert len(done) == len(wide)
    assert all(done[p, m, d]["value"] == v and done[p, m, d]["imputed"] == 0 for p, m, d, v in wide if v is not None)


def test_trends(spark):
    got = {r["patient"]: r for r in series.trends(grid(spark, {"A": [26, 21, 10, 11, 43, 120], "B": [5, None, 9], "C": [None, None, None]})).collect()}
    assert [got["A"][c] for c in ("highest", "lowest", "spread", "first_value", "last_value", "n_observed", "max_dropdown", "max_rise")] == [120, 10, 110, 26, 120, 6, -11, 77]
    assert got["B"]["max_dropdown"] is None and got["B"]["last_value"] == 9
    assert got["C"]["n_observed"] == 0 and got["C"]["highest"] is None


@pytest.fixture(scope="module")
def records(spark):
    rows = [(3, 3, 0.9, 1200), (2, 2, 0.7, 950), (3, 2, 0.6, 1100), (2, 1, 0.5, 800), (3, 1, 0.4, 900), (1, 2, 0.6, 1000), (2, 2, 0.85, 1050), (2, None, None, 700)]
    return spark.createDataFrame([(t, p, c, float(ms), "PLT 30, trang 5") for t, p, c, ms in rows], "truth int, predicted int, confidence double, latency_ms double, answer string")


def test_evaluation(records):
    a = evaluate.agreement(records).first()
    want = {"n": 7, "accuracy": 3 / 7, "balanced_accuracy": 1 / 3, "macro_f1": 0.357143, "weighted_f1": 0.459184, "kappa": 0.125, "qwk": 0.075472, "ordinal_mae": 5 / 7}
    assert all(a[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    s = evaluate.safety(records).first()
    assert (s["n_under"], s["n_over"], s["critical_misses"], s["n_invalid"]) == (3, 1, 1, 1) and s["severe_recall"] == pytest.approx(1 / 3)
    c = evaluate.calibration_error(evaluate.calibration(records)).first()
    assert (c["brier"], c["ece"]) == (pytest.approx(0.178929, abs=1e-6), pytest.approx(0.378571, abs=1e-6))
    t = evaluate.latency(records).first()
    assert (t["p50"], t["p95"], t["mean"], t["longest"]) == (975, 1165, 962.5, 1200)
    assert evaluate.report(records).count() == 1
    assert evaluate.answers(records).first()["lab_rate"] == 1


def test_published_matrix(spark):
    counts = {(1, 2): 1, (2, 2): 16, (2, 3): 3, (3, 2): 2, (3, 3): 8}
    rows = [(t, p) for (t, p), n in counts.items() for _ in range(n)]
    a = evaluate.agreement(spark.createDataFrame(rows, "truth int, predicted int")).first()
    want = {"accuracy": 0.8, "macro_f1": 0.534670, "kappa": 0.580420, "qwk": 0.610390, "ordinal_mae": 0.2}
    assert all(a[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


@pytest.mark.parametrize(
    ("row", "red", "warning", "evidence"),
    [
        ({"plt": 19.9}, 1, 0, 0), ({"plt": 20.0}, 0, 1, 0), ({"plt": 49.9}, 0, 1, 0), ({"plt": 50.0}, 0, 0, 1), ({"plt": 149.9}, 0, 0, 1), ({"plt": 150.0}, 0, 0, 0),
        ({"wbc": 4.5}, 0, 0, 1), ({"wbc": 4.6}, 0, 0, 0), ({"hct": 45.0}, 0, 0, 1), ({"hct": 44.9}, 0, 0, 0),
        ({"ast": 1000.0}, 1, 0, 0), ({"alt": 300.0, "plt": 49.0}, 1, 1, 0), ({"alt": 300.0, "plt": 60.0}, 0, 1, 1), ({"ast": 200.0}, 0, 1, 0), ({"ast": 199.0}, 0, 0, 0),
    ],
)
def test_rules(spark, row, red, warning, evidence):
    values = [row.get(c) for c in ("plt", "wbc", "hct", "ast", "alt")]
    df = spark.createDataFrame([(1, *values, False)], "patient int, plt double, wbc double, hct double, ast double, alt double, serology boolean")
    got = labtext.severity_rules(df).first()
    assert (len(got["red"]), len(got["warning"]), len(got["evidence"])) == (red, warning, evidence)


def test_cells(spark):
    df = spark.createDataFrame([("Mui; petechiae ,  MUI",), (None,), (" , ;",)], "c string")
    got = df.select(X.clean_cell(F.col("c")).alias("x"), X.parts(F.col("c")).alias("p")).collect()
    assert [r["x"] for r in got] == ["chay mau mui, petechia", None, ""] and [len(r["p"]) for r in got] == [3, 0, 0]


def test_text_forms(spark):
    df = spark.createDataFrame([("a1b Tiểu cầu ĐÊM", "4,5 - 10 K/uL")], "t string, r string")
    low, high = X.range_ends(F.col("r"))
    r = df.select(X.folded(F.col("t")).alias("f"), low.alias("lo"), high.alias("hi"), X.sentences(F.lit("One two three. Four five six! ab")).alias("s")).first()
    assert r["f"] == "a1b tieu cau đem" and (r["lo"], r["hi"]) == (4.5, 10) and r["s"] == ["One two three.", "Four five six! ab"]
    chunks = df.select(F.transform(X.chunks(F.repeat(F.lit("x"), 2300)), lambda c: F.length(c)).alias("n")).first()["n"]
    assert chunks == [1200, 1200, 200]
    raw = 'x {"label": "old"} ``` {"label": "Nặng ", "confidence": "0.8", "reasoning": "r"}'
    a = spark.createDataFrame([(1, raw), (2, "none"), (3, '{"label": broken')], "i int, raw string")
    got = {r["i"]: (r["predicted"], r["confidence"], r["reasoning"]) for r in forms.parsed_answers(a, "i", "raw").collect()}
    assert got == {1: (3, 0.8, "r"), 2: (None, None, None), 3: (None, None, None)}
    s = spark.createDataFrame([("[Lý do]: vì PLT\n[Bằng chứng]: - PLT 30\n- HCT 47\n[Cờ đỏ]: (không)\n{}",)], "raw string").select(*forms.sections(F.col("raw"))).first()
    assert s["reason"] == "vì PLT" and s["evidence"] == ["PLT 30", "HCT 47"] and s["red_flags"] == []


def test_lab_lines(spark):
    df = spark.createDataFrame([(1, "WBC 4,5 K/uL\nnot a test\nPLT: 150\nNS1 positive\nPLT 99")], "k int, text string")
    got = {r["exam"]: (r["value"], r["word"]) for r in labtext.lab_rows(df, "k").collect()}
    assert got == {"WBC": (4.5, None), "PLT": (150.0, None), "NS1": (None, "positive")}
    fix = lambda t: df.select(labtext.repaired(F.lit(t)).alias("x")).first()["x"]
    assert fix("PLT l5O K/uL 4,52 NS1 1,234,567") == "PLT 150 K/uL 4.52 NS1 1,234,567"
    assert fix("PLT l2\nWBC O5 x\n5O people,  l0 dogs\n\nHct\t4l %") == "PLT 12\nWBC 05 x\n5O people,  l0 dogs\n\nHct\t41 %"
    assert fix("") == "" and fix(None) is None
    scanned = spark.createDataFrame([(1, "PLT l5O\nWBC 4,S2")], "k int, text string")
    assert {r["exam"]: r["value"] for r in labtext.lab_rows(scanned, "k").collect()} == {"PLT": 150.0, "WBC": 4.52}


def expanded_by_rule(query, most=6):
    """The rule for one query at a time."""
    import re
    import unicodedata

    from tessella.functions import constants as C

    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    added = []
    for term, others in C.SYNONYMS.items():
        for v in [*others, term]:
            if len(added) < most and re.search(rf"\b{re.escape(bare(v))}\b", bare(query.lower())) and term not in query.lower() and term not in added:
                added += [term, *[o for o in others if o != v][:2]]
    return " ".join([query, *added[:most]])


def test_synonyms_of_every_group(spark):
    from tessella.functions import constants as C

    asked = [v for term, others in C.SYNONYMS.items() for v in [term, *others]]
    asked += ["PLT. thấp?", "albumin thấp", "ALB thấp, creat cao", "tieu  cau", "xplt", "plt_1", "NaCl 0.9%", "nacl 0x9", "N4-N6 het sốt", "plt hct wbc ast", "soc va non", "Đạm máu", "đau vùng gan", "", "không có gì"]
    df = spark.createDataFrame(list(enumerate(asked)) + [(9999, None)], "i int, q string")
    got = {r["i"]: r["x"] for r in df.select("i", retrieval.expanded(F.col("q")).alias("x")).collect()}
    assert got.pop(9999) is None
    assert got == {i: expanded_by_rule(q) for i, q in enumerate(asked)}
    assert got[asked.index("PLT. thấp?")] == "PLT. thấp? tiểu cầu tieu cau platelet"


def test_severity_of_notes(spark):
    notes = ["SOC", "sxhnang", " TonThuong gan ", "canhbao", "thai 20 tuan", "khong", "", None]
    df = spark.createDataFrame([(n,) for n in notes], "n string").select(cohort.note_severity(F.col("n")).alias("s"))
    assert [r["s"] for r in df.collect()] == [2, 2, 2, 1, 1, 0, 0, None]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "r", 1.5), ("b", "a", "r", 1.0), ("b", "c", "s", None)], "src string, dst string, relation string, weight double")
    seeds = spark.createDataFrame([("a",)], "id string")
    got = sorted(("/".join(r["path"]), r["score"]) for r in graph.paths(edges, seeds, 3).collect())
    assert got == [("a/b", 1.5), ("a/b/c", 0.5)]
    pages = spark.createDataFrame([(1, p, s) for p, s in [(1, 3), (2, 1), (3, 4), (4, 0), (5, 3), (20, 3), (21, 3), (22, 5)]], "book int, page int, score int")
    assert graph.longest_run(graph.runs(pages, "book", "page", "score"), "book").first()["first"] == 20


def test_sections(spark):
    text = "PHẦN MỘT HAI\n" + "word " * 100 + "\n1. First things\n" + "more " * 100 + "\n1.1. Deeper things\n" + "last " * 100
    got = retrieval.section_chunks(spark.createDataFrame([(1, text), (2, None), (3, "short")], "k int, t string"), "k", "t").orderBy("chunk").collect()
    assert [len(r["path"]) for r in got] == [1, 2, 3] and got[2]["path"][-1] == "1.1. Deeper things"


def test_mmr(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.0]), (1, 3, 0.5, [0.0, 1.0])]
    got = retrieval.diverse(spark.createDataFrame(rows, "query int, k int, score double, v array<double>"), "k", "v", 2).orderBy("step").collect()
    assert [r["k"] for r in got] == [1, 3]


def test_splits(spark):
    df = spark.range(503).withColumn("label", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    parts = {(r["label"], r["split"]): r["count"] for r in model.stratified_split(df, "id", "label").groupBy("label", "split").count().collect()}
    assert parts["a", "test"] == round(168 * 0.2) and parts["b", "test"] == round(335 * 0.2)
    folds = [r["count"] for r in model.stratified_folds(df, "id", "label", 4).where("label = 'a'").groupBy("fold").count().collect()]
    assert max(folds) - min(folds) <= 1 and sum(folds) == 168
    assert model.usable_folds(df.limit(4), "label", 5) == 2


def test_sessions(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"message {t} " + "long " * 20) for t in range(9)] + [(1, 9, "system", "x")]
    turns = spark.createDataFrame(rows, "session int, turn int, role string, content string")
    assert sorted(r["turn"] for r in sessions.history(turns).collect()) == [3, 4, 5, 6, 7, 8]
    assert len(sessions.titles(turns).first()["title"]) <= 63
    assert sessions.latest(turns).first()["role"] == "system" and len(sessions.nested(turns).first()["messages"]) == 10


def test_wide_to_long(spark):
    wide = spark.createDataFrame([(1, 5.0, math.nan)], "id int, HctN1 double, hctN2 double")
    got = {r["day"]: r["value"] for r in cohort.long_form(wide, "id", {"HctN1": ("Hct", 1), "hctN2": ("Hct", 2)}).collect()}
    assert got == {1: 5.0, 2: None}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=40))
def test_status_and_edges(pairs):
    assert len(evaluate.EDGES) == 4 and all(a < b for a, b in zip(evaluate.EDGES, evaluate.EDGES[1:], strict=False))
    assert len(MEASURES) == 5


def test_auc_counts_ties(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)]
    got = evaluate.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()["auc"]
    pairs = [(a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z]
    assert got == pytest.approx(sum(pairs) / len(pairs))
    assert evaluate.auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()["auc"] is None


@pytest.mark.parametrize("in_task", [position.IN_TASK, 100])
def test_quantiles_of_large_groups(spark, monkeypatch, in_task):
    monkeypatch.setattr(position, "IN_TASK", in_task)
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.integers(0, 40, 900)] + [("b", float(x)) for x in rng.random(301)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in position.quantiles(df, ["k"], "v", {"q1": 0.25, "q9": 0.9}).collect()}
    for k in "ab":
        v = [x for y, x in rows if y == k]
        assert (got[k]["q1"], got[k]["q9"]) == pytest.approx((np.percentile(v, 25), np.percentile(v, 90)))
    thin = sorted((r["place"], r["v"]) for r in position.thinned_values(df, ["k"], "v").where("k = 'a'").collect())
    v = sorted(x for y, x in rows if y == "a")
    assert thin == [(i, v[i * 899 // 99]) for i in range(100)]


def test_query_expand_reads_whole_messages(spark, tmp_path):
    long = "a message without any name of a test so far, and " * 20 + "then platelet counts"
    turns = [(1, 1, "user", long), (1, 2, "assistant", long), (2, 2, "user", long), (3, 1, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["expanded"] for r in search.query_expand(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 1)}
    assert got[1, 1].startswith(long + " ") and "tiểu cầu" in got[1, 1][len(long) :]
    assert got[2, 2].startswith(f"{long} PLT. và (dengue) shock ")


def test_nearest_ties_go_by_patient(spark):
    near = [(i, 1 + (60 - i) * 1e-11) for i in range(1, 61)]  # alike in six digits, lower ids a little farther
    vectors = spark.createDataFrame([(0, 0.0), *near], "patient long, x double")
    got = position.nearest(vectors, vectors.where("patient = 0"), ["x"], 5).orderBy("rank").collect()
    assert [r["patient"] for r in got] == [1, 2, 3, 4, 5]


def evidence_by_design(x, y, rounds=300, tolerance=1e-3):
    """Bayesian ridge on the design matrix itself, by its singular values."""
    mx, my = x.mean(0), y.mean()
    x, y = x - mx, y - my
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    alpha, lam, before = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    weights = lambda: vt.T @ (s * (u.T @ y) / (s**2 + lam / alpha))
    for _ in range(rounds):
        w = weights()
        gamma = (alpha * s**2 / (lam + alpha * s**2)).sum()
        lam, alpha = (gamma + 2e-6) / ((w**2).sum() + 2e-6), (len(y) - gamma + 2e-6) / (((y - x @ w) ** 2).sum() + 2e-6)
        if before is not None and np.abs(w - before).sum() < tolerance:
            break
        before = w
    w = weights()
    return np.r_[my - mx @ w, w]


def test_bayesian_ridge_of_collinear_columns():
    rng = np.random.default_rng(4)
    for n, noise in ((12, 0.5), (200, 0.1), (200, 3.0)):
        a = rng.standard_normal(n)
        x = np.column_stack([a, 2 * a, rng.standard_normal(n) + 5])  # the second column says nothing new
        y = 3 * a - x[:, 2] + noise * rng.standard_normal(n)
        got = series.evidence_ridge(n, x.sum(0), y.sum(), x.T @ x, x.T @ y, y @ y)
        np.testing.assert_allclose(got, evidence_by_design(x, y), rtol=1e-6, atol=1e-8)
    assert series.evidence_ridge(0, np.zeros(2), 0.0, np.zeros((2, 2)), np.zeros(2), 0.0).tolist() == [0, 0, 0]
    flat = series.evidence_ridge(5, np.full(1, 5.0), 10.0, np.full((1, 1), 5.0), np.full(1, 10.0), 20.0)
    assert flat == pytest.approx([2, 0])


@pytest.mark.parametrize("ridge", [0.5, None])
def test_chained_imputation_against_numpy(spark, ridge):
    rng = np.random.default_rng(12)
    n, days, measures = 30, 6, ["a", "b", "c"]
    base = rng.standard_normal((n, days))
    truth = np.stack([base + 0.1 * rng.standard_normal((n, days)), 2 * base + 0.1 * rng.standard_normal((n, days)), -base + 0.5], 2)
    seen = truth.copy()
    seen[rng.random(seen.shape) < 0.3] = np.nan
    rows = [(p, m, d + 1, None if np.isnan(seen[p, d, k]) else float(seen[p, d, k])) for p in range(n) for k, m in enumerate(measures) for d in range(days)]
    obs = spark.createDataFrame(rows, "patient int, measure string, day int, value double")
    got = {(r["patient"], r["measure"], r["day"]): (r["value"], r["imputed"]) for r in series.impute_chained(obs, measures, rounds=4, ridge=ridge).collect()}
    flat = seen.reshape(-1, 3)
    there, median = ~np.isnan(flat), np.nanmedian(flat, axis=0)
    x = np.where(there, flat - median, 0.0)
    for _ in range(4):
        new = x.copy()
        for t in range(3):
            others = [i for i in range(3) if i != t]
            a = np.column_stack([np.ones(len(x)), x[:, others]])
            use = there[:, t]
            beta = evidence_by_design(a[use][:, 1:], x[use, t]) if ridge is None else np.linalg.solve(a[use].T @ a[use] + np.diag([1e-9, ridge, ridge]), a[use].T @ x[use, t])
            new[~use, t] = (a @ beta)[~use]
        x = new
    full = (x + median).reshape(seen.shape)
    for p in range(n):
        for k, m in enumerate(measures):
            at = np.flatnonzero(~np.isnan(seen[p, :, k]))
            for d in range(days):
                value, imputed = got[p, m, d + 1]
                inner = len(at) > 0 and at[0] < d < at[-1] and np.isnan(seen[p, d, k])
                assert imputed == int(inner)
                if inner:
                    assert value == pytest.approx(full[p, d, k], abs=1e-8 if ridge else 1e-6)
                else:
                    assert (value is None) == np.isnan(seen[p, d, k])
    assert np.abs(full - truth)[np.isnan(seen)].mean() < 0.5 * np.abs(np.nanmedian(seen) - truth)[np.isnan(seen)].mean()


def test_a_client_is_asked_once(spark, tmp_path):
    marks = str(tmp_path)

    def start():
        import uuid

        def client(prompts):
            with open(f"{marks}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(len(prompts)))
            return ['{"label": "nặng", "confidence": 0.5}'] * len(prompts)

        return client

    got = triage.triaged(spark.createDataFrame([(i, "p") for i in range(10)], "k int, prompt string"), "k", "prompt", start).collect()
    assert len(got) == 10 and {r["predicted"] for r in got} == {3} and sum(int(f.read_text()) for f in tmp_path.iterdir()) == 10


def test_clinical_signs(spark):
    base = {"plt": None, "wbc": None, "hct": None, "ast": None, "alt": None}
    fields = "patient int, plt double, wbc double, hct double, ast double, alt double, serology boolean, myalgia boolean, oliguria boolean, dyspnea boolean, hct_up_plt_down boolean, hct_drop_suspicious boolean"
    rows = [(i, *base.values(), False, *[j == i for j in range(5)]) for i in range(6)]
    got = {r["patient"]: r["level"] for r in labtext.severity_rules(spark.createDataFrame(rows, fields)).collect()}
    assert got == {0: "evidence", 1: "warning", 2: "red flag", 3: "warning", 4: "red flag", 5: "insufficient"}


def test_headings_noise_and_compatible_text(spark):
    level = retrieval.heading_level
    assert [level(x) for x in ("8. Điều trị", "8.2.1. Điều trị cụ thể", "Phần II: Chẩn đoán", "PHỤ LỤC 23: Bảng", "CHẨN ĐOÁN BỆNH", "CAPS", "8.2", "word line", "1.2.3.4.5.6 deep")] == [3, 5, 1, 1, 2, None, None, None, None]
    assert [retrieval.is_noise(x) for x in ("Truyền nhiễm ", " 12 ", "12345", "x")] == [True, True, False, False]
    df = spark.createDataFrame([(1, "ﬁne ①"), (2, None)], "k int, t string")
    assert [r["x"] for r in df.select(retrieval.compatible(F.col("t")).alias("x")).collect()] == ["fine 1", None]


def test_runs_across_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(b, int(p), int(rng.integers(0, 5))) for b in (1, 2) for p in np.flatnonzero(rng.random(400) < 0.8)]
    df = spark.createDataFrame(rows, "book int, page int, score int")
    plain = {tuple(r) for r in graph.runs(df, "book", "page", "score").select("book", "run", "first", "last", "n_core").collect()}
    assert plain == {tuple(r) for r in graph.runs(df, "book", "page", "score", part=7).select("book", "run", "first", "last", "n_core").collect()}
    want, state = [], {}
    for b, p, s in sorted(rows):
        last, broken, run = state.get(b, (None, False, 0))
        broken = broken or s < 1
        if s >= 3:
            if last is None or p - last > 5 or broken:
                run += 1
                want.append([b, run, p, p, 0])
            want[-1][3], want[-1][4] = p, want[-1][4] + 1
            last, broken = p, False
        state[b] = (last, broken, run)
    assert plain == {tuple(w) for w in want}


def test_facts_fall_back_to_the_best_paths(spark):
    edges = spark.createDataFrame([("aaa", "bbb", "r", 1.0), ("aaa", "ccc", "r", 2.0)], "src string, dst string, relation string, weight double")
    found = graph.paths(edges, spark.createDataFrame([("aaa",)], "id string"), 1)
    assert graph.answered(found, ["bbb"], least=0.7).count() == 1
    assert [r["path"][-1] for r in graph.answered(found, ["zzz"], least=0.9).collect()] == ["ccc", "bbb"]
    block = found.agg(forms.facts_block(found).alias("b")).first()["b"]
    assert block == "aaa -[r]-> ccc\naaa -[r]-> bbb"


def test_runs_are_stored_by_tag(spark, records, tmp_path):
    for tag in ("a", "b"):
        evaluate.store_run(records, str(tmp_path), tag)
    got = spark.read.json(f"{tmp_path}/*/metrics")
    assert {r["tag"] for r in got.select("tag").collect()} == {"a", "b"} and "| accuracy | 0.4286 |" in spark.read.text(f"{tmp_path}/tag=a/report", wholetext=True).first()["value"]
    assert spark.read.csv(f"{tmp_path}/tag=a/records", header=True).count() == 8


def test_cards_and_messages(spark):
    row = [(1, "nam", 30, None, 4, "", ["đau bụng"], [], ["PLT: N1=50"])]
    df = spark.createDataFrame(row, "k int, sex string, age int, weight double, day int, illness string, signs array<string>, flags array<string>, labs array<string>")
    card = forms.described(df, "k", "sex", "age", "weight", "day", "illness", ["signs", "flags"], "labs").first()["card"]
    assert card == "--- Bệnh nhân ---\nThông tin: nam, 30 tuổi, ?kg\nNgày bệnh khi nhập viện: N4\nsigns: đau bụng\nLab theo ngày:\n  PLT: N1=50"
    none = F.lit(None).cast("array<struct<role:string,content:string>>")
    said = df.select(forms.messages(F.lit("s"), none, F.lit("c"), F.lit("q")).alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in said] == [("system", "s"), ("system", "c"), ("user", "q")]
    line = df.select(forms.trend_line(F.lit(2), F.lit(4), F.lit(10.0), F.lit(15.0), F.lit(50.0)).alias("x")).first()["x"]
    assert line == "thấp nhất N2, cao nhất N4, từ 10.0 đến 15.0 (+50.0%)"


def test_models_are_saved_and_say_the_same(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)], "k int, a double, b double, y int")
    fitted = model.fit_boosted(df, ["a", "b"], "y", 2, 3)
    model.save(fitted, f"{tmp_path}/m", {"features": ["a", "b"]})
    loaded, meta = model.load(f"{tmp_path}/m")
    assert meta == {"features": ["a", "b"]} and boosting.importance(loaded, 1)[0][0] == "a"
    assert boosting.predict(loaded, df).where("predicted = y").count() == 200

from pyspark.sql import functions as F

from tessella.sources import files
from tessella.streaming import events


def test_csv_json_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 2.5, "b")], "id int, x double, s string")
    files.write_csv(df, f"{tmp_path}/csv")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/csv", "id int, x double, s string").orderBy("id").collect()] == [(1, None, "a"), (2, 2.5, "b")]
    files.write_json(df.where("id = 2"), f"{tmp_path}/json")
    assert files.read_json(spark, f"{tmp_path}/json", "id int, x double, s string", whole=False).first()["x"] == 2.5
    made = []
    make = lambda: made.append(1) or df
    for meta in ({"v": "1"}, {"v": "1"}, {"v": "2"}):
        assert files.cached(spark, f"{tmp_path}/cache", make, meta).count() == 2
    assert len(made) == 2


def test_records_and_graph(spark, tmp_path):
    a = spark.createDataFrame([(1, "x" * 2000)], "patient int, raw_response string")
    b = spark.createDataFrame([(2, ["f", "g"])], "patient int, red_flags array<string>")
    files.write_records([a, b], f"{tmp_path}/records")
    got = spark.read.csv(f"{tmp_path}/records", header=True)
    assert got.count() == 2 and got.agg(F.max(F.length("raw_response"))).first()[0] == 1000
    nodes, edges = files.graph_frames(spark, [{"id": "a", "type": "lab", "label": 'say "x"', "note": "n"}], [{"source": "a", "target": "b", "relation": "treats"}])
    said = files.graph_yaml(nodes, edges)
    assert '\\"x\\"' in said and "weight: 1.0" in said
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "page.txt").write_text("one\ntwo")
    assert files.read_pages(spark, f"{tmp_path}/t").first()["text"] == "one\ntwo"
    assert "| x | 0.5000 |" in files.markdown({"x": 0.5, "n": 3}, "Report")


def test_streams_agree_with_batch(spark, tiny, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{tiny}/events.parquet").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    q = events.latest(events.read(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("latest_values").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet(f"{tiny}/events.parquet").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    got = spark.table("latest_values").select("user_id", "event_type", "value")
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_cohort_splits_and_evaluation_sets(spark, tmp_path):
    from tessella.operators import model

    df = spark.createDataFrame([(i, "soc" if i % 4 == 0 else "canhbao", i % 2 + 1, i % 3 + 1) for i in range(40)], "k int, note string, sex int, y int")
    files.write_csv(df, f"{tmp_path}/cohort")
    got = files.read_cohort(spark, f"{tmp_path}/cohort", "k int, note string, sex int, y int", ["k"], "note", "sex").orderBy("patient_id").collect()
    assert [r["patient_id"] for r in got] == [f"BN_{i:03d}" for i in range(1, 41)] and got[0]["severity_group"] == "sốc / nặng" and {r["sex_label"] for r in got} == {"nam", "nữ"}
    files.write_split(model.stratified_split(df, "k", "y"), f"{tmp_path}/splits", 80, "y", "cohort", 42)
    train, test, meta = files.read_split(spark, f"{tmp_path}/splits", 80, "k int, note string, sex int, y int")
    assert train.count() == meta["n_train"] and test.count() == meta["n_test"] and meta["n_total"] == 40 and train.intersect(test).count() == 0
    files.write_holdout(df, f"{tmp_path}/holdout", ["k"], "y")
    back = files.read_evaluation(spark, f"{tmp_path}/holdout", "k int, _ground_truth int, _ground_truth_label string", "_ground_truth_label")
    assert back.where("truth = _ground_truth").count() == 40
    assert files.read_evaluation(spark, f"{tmp_path}/holdout", "k int, _ground_truth int, _ground_truth_label string", "_ground_truth", True).where("truth is null").count() == 0


def test_graph_file(spark, tmp_path):
    import pytest

    pytest.importorskip("yaml")
    nodes, edges = files.graph_frames(spark, [{"id": "a", "type": "lab", "label": "x: y"}], [{"source": "a", "target": "b", "relation": "treats", "weight": 1.5}])
    (tmp_path / "g.yaml").write_text(files.graph_yaml(nodes, edges))
    back = files.read_graph(spark, f"{tmp_path}/g.yaml")
    assert back[0].first()["label"] == "x: y" and back[1].first()["weight"] == 1.5

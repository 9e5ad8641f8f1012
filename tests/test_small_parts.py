"""Readers and helpers that no query uses."""

import datetime
import re

from pyspark.sql import functions as F

from tessella.operators import features, forms, graph, questions, retrieval, series, triage
from tessella.sources import files


def test_pages_and_binary_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\nsecond")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-")
    page = files.read_pages(spark, f"{tmp_path}/*.txt").collect()
    assert [(r["source_file"].rsplit("/", 1)[1], r["page"], r["text"]) for r in page] == [("a.txt", 1, "first\nsecond")]
    assert [bytes(r["content"]) for r in files.read_binary(spark, str(tmp_path), "*.pdf").collect()] == [b"%PDF-"]


def test_turns_are_appended(spark, tmp_path):
    for t in range(3):
        files.append_turns(spark.createDataFrame([(1, t, "user", f"m{t}")], "session int, turn int, role string, content string"), f"{tmp_path}/log")
    assert sorted(r["turn"] for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [0, 1, 2]


def test_columns_that_exist(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Alpha int, beta int, HctN1 int")
    assert features.existing(df, {"a": ["alpha", "gamma"], "b": ["BETA"], "c": ["none"]}) == {"a": ["Alpha"], "b": ["beta"]}


def test_bounded_rows_and_blocks(spark):
    df = spark.createDataFrame([(1, i, "word " * i) for i in range(90)] + [(2, 0, "one")], "query int, rank int, text string")
    kept = retrieval.bounded(df, "query", ["rank"], 2)
    assert sorted((r["query"], r["rank"]) for r in kept.collect()) == [(1, 0), (1, 1), (2, 0)]
    block = {r["query"]: r["block"] for r in forms.evidence_block(df.where("rank IN (0, 80)"), "query").collect()}
    assert block[2] == "[1] one" and block[1].split("\n")[1].startswith("[81] word word") and block[1].endswith("word…") and len(block[1]) < 370


def test_short_ids_and_guards(spark):
    ids = [r["i"] for r in spark.range(50).select(questions.short_id().alias("i")).collect()]
    assert len(set(ids)) == 50 and all(re.fullmatch("[0-9a-f]{8}", i) for i in ids)
    asked = spark.createDataFrame([("kê đơn giúp tôi",), ("sốt là gì",), (None,)], "q string")
    assert [r["reply"] for r in triage.guarded(asked, "q", ["kê đơn"], "no").collect()] == ["no", None, None]


def test_parts_of_graphs(spark):
    nodes = spark.createDataFrame([("a", "x", "A"), ("b", "y", "B")], "id string, type string, label string")
    assert [r["id"] for r in graph.of_type(nodes, "x").collect()] == ["a"]
    active = spark.createDataFrame([(1, "a"), (1, "z")], "k int, node string")
    assert [tuple(r) for r in graph.existing(active, nodes).collect()] == [(1, "a")]


def test_hours_go_on_from_range_to_range(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(1, start + datetime.timedelta(minutes=i * i), i) for i in range(400)] + [(2, start, 1), (3, None, 1), (3, start, 2), (None, start, 5), (None, start + datetime.timedelta(hours=2), 6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["i"]): r["hours"] for r in series.hours_between(spark.createDataFrame(rows, "k int, t timestamp, i int").repartition(5), "k", "t", "i").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    assert got[1, 0] is None and all(abs(got[1, i] - (2 * i - 1) / 60) < 1e-9 for i in range(1, 400))
    assert got[2, 1] is None and got[3, 1] is None and got[3, 2] is None and got[None, 5] is None and got[None, 6] == 2

"""Runs that were stopped go on where they stopped."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import bootstrap, boosting, model, runs, stored


def client(log, fail_on=None):
    """A client that writes down each prompt that it answers, and raises at one that holds `fail_on`."""

    def start():
        def reply(prompts):
            if fail_on and any(fail_on in p for p in prompts):
                raise RuntimeError("the model is gone")
            with open(f"{log}/{os.getpid()}", "a") as out:
                out.writelines(json.dumps(p) + "\n" for p in prompts)
            return [f'{{"label": "severe", "confidence": 0.{len(p) % 10}}}' if "x" not in p else None for p in prompts]

        return reply

    return start


def asked(log):
    return sorted(json.loads(x) for f in os.listdir(log) for x in open(f"{log}/{f}"))


@pytest.fixture
def log(tmp_path):
    os.mkdir(f"{tmp_path}/log")
    return f"{tmp_path}/log"


def test_nothing_is_asked_twice(spark, tmp_path, log):
    rows = [(i, f"prompt {i:03d}") for i in range(100)] + [(200, "prompt 007"), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(3)
    with pytest.raises(Exception, match="the model is gone"):
        runs.answers(df, "id", "prompt", client(log, "prompt 050"), f"{tmp_path}/run", "a")
    before = asked(log)
    assert 0 < len(before) < 100
    got = {r["id"]: r["answer"] for r in runs.answers(df, "id", "prompt", client(log), f"{tmp_path}/run", "a").collect()}
    assert len(got) == 103 and got[201] is None and got[200] == got[7] is not None and got[202] == '{"label": "severe", "confidence": 0.0}'
    assert asked(log) == sorted({p for _, p in rows if p is not None})  # each once in both runs
    again = {r["id"]: r["answer"] for r in runs.answers(df, "id", "prompt", client(log), f"{tmp_path}/run", "a").collect()}
    assert again == got and len(asked(log)) == 101
    changed = df.withColumn("prompt", F.when(F.col("id") == 5, F.lit("another")).otherwise(F.col("prompt")))
    runs.answers(changed, "id", "prompt", client(log), f"{tmp_path}/run", "a").count()
    assert len(asked(log)) == 102
    runs.answers(df.where("id < 3"), "id", "prompt", client(log), f"{tmp_path}/run", "b").count()
    assert len(asked(log)) == 105  # another run asks for itself
    assert runs.answers(df.limit(0), "id", "prompt", client(log), f"{tmp_path}/run", "c").count() == 0


def test_two_attempts_count_once(spark, tmp_path):
    import pyarrow as pa

    for k in range(2):  # as two attempts of a task leave it; a file that isn't whole has another name
        runs._commit_file(f"{tmp_path}/answers/tag=t", f"x-{k}.parquet", pa.table({"hash": ["h"], "answer": [f"a{k}"], "latency_ms": [1.0]}, runs.ANSWERS))
    with open(f"{tmp_path}/answers/tag=t/_x-9", "w") as out:
        out.write("half")
    assert runs._stored(f"{tmp_path}/answers/tag=t", "x-") == {"h"}
    assert [tuple(r) for r in runs._answered(spark, f"{tmp_path}/answers/tag=t").collect()] == [("h", "a0", 1.0)]


def test_from_prompts_to_a_report(spark, tmp_path, log):
    df = spark.createDataFrame([(i, f"prompt {i}", 3 if i % 2 else 1) for i in range(20)] + [(21, "x", 3)], "id long, prompt string, truth int")
    row = runs.evaluated(df, "id", "prompt", "truth", client(log), f"{tmp_path}/run", "a").first()
    assert row["n"] == 20 and row["accuracy"] == 0.5 and row["n_invalid"] == 1 and row["tag"] == "a"
    assert spark.read.json(f"{tmp_path}/run/tag=a/metrics").count() == 1
    runs.evaluated(df, "id", "prompt", "truth", client(log), f"{tmp_path}/run", "a")
    assert len(asked(log)) == 21


def test_steps_are_made_once_and_after_a_stop(tmp_path):
    made = []

    def step(name, source, needs=(), broken=None):
        def make(folder, folders):
            os.makedirs(folder)
            with open(f"{folder}/half", "w") as out:
                out.write(name)
            if broken:
                raise broken
            made.append((name, sorted(folders)))

        return runs.Step(name, source, make, needs)

    plan = lambda a=1, b=1, broken=None: [step("a", a), step("b", b, ("a",), broken), step("c", 1, ("b",)), step("d", 1)]
    path = f"{tmp_path}/built"
    first = runs.build(path, plan(broken=ValueError("no disk")))
    assert [(s.name, s.ok) for s in first] == [("a", True), ("b", False)] and first[1].message == "ValueError: no disk"
    assert [(s.name, s.skipped) for s in runs.build(path, plan())] == [("a", True), ("b", False), ("c", False), ("d", False)]
    assert [m[0] for m in made] == ["a", "b", "c", "d"] and made[1] == ("b", ["a"])
    assert all(s.skipped for s in runs.build(path, plan()))
    assert [s.skipped for s in runs.build(path, plan(b=2))] == [True, False, False, True]
    assert [s.skipped for s in runs.build(path, plan(b=2), force=("a",))] == [False, False, False, True]
    assert [(s.skipped, s.message) for s in runs.build(path, plan(b=2), skip=("b",))][1:3] == [(True, "left out")] * 2


def test_a_stop_between_write_and_marker(tmp_path, monkeypatch):
    made = []
    plan = [runs.Step("a", 1, lambda folder, _: made.append(folder))]
    mark = runs._mark

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(runs, "_mark", stop)
    with pytest.raises(KeyboardInterrupt):
        runs.build(f"{tmp_path}", plan)
    monkeypatch.setattr(runs, "_mark", mark)
    assert not runs.build(f"{tmp_path}", plan)[0].skipped and len(set(made)) == 2
    assert runs.build(f"{tmp_path}", plan)[0].folder == made[1]


def test_five_steps(spark, tmp_path):
    cohort = spark.createDataFrame([(i, i % 2, float(i % 2) + (i % 7) / 10, None if i % 5 == 0 else float(i)) for i in range(80)], "id long, y int, a double, b double")
    texts = spark.createDataFrame([(1, "Sốt cao và đau đầu"), (2, "Tiểu cầu giảm, không dùng aspirin"), (3, None)], "page int, text string")
    make = lambda c=cohort, t=texts: bootstrap.steps(c, "id", "y", ["a", "b"], t, "page", "text", rounds=2)
    done = {s.name: s for s in runs.build(f"{tmp_path}", make())}
    assert list(done) == ["split", "statistics", "model", "index", "graph"] and all(s.ok and not s.skipped for s in done.values())
    assert spark.read.parquet(done["split"].folder).where("split = 'train'").count() == 64
    assert {(r["measure"], r["class"]) for r in spark.read.parquet(done["statistics"].folder).collect()} == {(m, c) for m in "ab" for c in (0, 1)}
    fitted, meta = model.load(done["model"].folder)
    assert isinstance(fitted, boosting.Boosted) and meta["holdout_accuracy"] == 1.0
    queries = spark.createDataFrame([(1, "aspirin")], "query int, term string")
    assert [r["page"] for r in stored.TermIndex.open(spark, done["index"].folder, texts, "page").search(queries, 3).collect()] == [2]
    assert spark.read.parquet(f"{done['graph'].folder}/nodes").where("n_pages > 0").count() == 4
    assert all(s.skipped for s in runs.build(f"{tmp_path}", make()))
    changed = texts.withColumn("text", F.coalesce("text", F.lit("li bì")))
    assert [s.skipped for s in runs.build(f"{tmp_path}", make(t=changed))] == [True, True, True, False, False]

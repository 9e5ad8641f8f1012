"""Sources and sinks: CSV, JSON, JSON lines, text, YAML graphs, models and cached tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT_META = "source string, created_at string, test_size double, random_state int, target_col string, n_total int, n_train int, n_test int, train_class_distribution map<string,int>, test_class_distribution map<string,int>, train_file string, test_file string"
SESSION = "session_id string, title string, created_at string, updated_at string, messages array<struct<role:string,content:string,timestamp:string>>"
CHUNK = "chunk_id string, text string, source_file string, page int, section_path array<string>"
LAB_ROW = "exam_name_raw string, exam_name_normalized string, value_num double, value_text string, unit string, reference_range string, source string, confidence double, report_id string, report_label string, report_time string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a schema that is given, not inferred; NaN becomes null."""
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, nanValue="nan", emptyValue="")
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats}) if floats else df


def read_cohort(spark: SparkSession, path: str, schema: str, order: list[str], severity: str, sex: str) -> DataFrame:
    """The cohort's CSV with patient_id (BN_001 and on, in the order of columns that tell rows apart), severity_group and
    sex_label. Ranks are taken in ranges of the first of these columns, so no task numbers all rows."""
    from tessella.operators import questions
    from tessella.operators.position import ranges

    df = read_csv(spark, path, schema)
    first = F.coalesce(F.col(order[0]).cast("string"), F.lit(""))
    placed = ranges(df.select(first.alias("_first")), [], "_first").select(F.col("_first").alias("_f"), "start")
    inside = F.row_number().over(Window.partitionBy("_f").orderBy(*order))
    numbered = df.withColumn("_first", first).join(placed, F.col("_first") == F.col("_f")).withColumn("_n", F.col("start") + inside)
    names = {"patient_id": F.concat(F.lit("BN_"), F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string")))}
    names |= {"severity_group": questions.severity_group(F.col(severity)), "sex_label": questions.sex_label(F.col(sex))}
    return numbered.withColumns(names).select("patient_id", *df.columns, "severity_group", "sex_label")


def read_split(spark: SparkSession, folder: str, percent: int, schema: str) -> tuple[DataFrame, DataFrame, dict]:
    """Train part, test part and what is known of a split of `percent` rows for training, as write_split leaves them."""
    meta = read_json(spark, f"{folder}/meta_{percent}", SPLIT_META, whole=False).first().asDict(recursive=True)
    return read_csv(spark, f"{folder}/train_{percent}", schema), read_csv(spark, f"{folder}/test_{100 - percent}", schema), meta


def write_split(split: DataFrame, folder: str, percent: int, label: str, source: str, seed: int) -> None:
    """The two parts of stratified_split as CSV and a line of JSON about them: sizes, classes, seed."""
    counts = {part: {str(r[label]): r["count"] for r in split.where(F.col("split") == part).groupBy(label).count().collect()} for part in ("train", "test")}
    n = {part: sum(c.values()) for part, c in counts.items()}
    names = {"train": f"train_{percent}", "test": f"test_{100 - percent}"}
    for part, name in names.items():
        write_csv(split.where(F.col("split") == part).drop("split"), f"{folder}/{name}")
    now = split.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("t")).first()["t"]
    row = (source, now, 1 - percent / 100, seed, label, sum(n.values()), n["train"], n["test"], counts["train"], counts["test"], names["train"], names["test"])
    write_json(split.sparkSession.createDataFrame([row], SPLIT_META).coalesce(1), f"{folder}/meta_{percent}")


def read_evaluation(spark: SparkSession, path: str, schema: str, label: str, numbers: bool = False) -> DataFrame:
    """An evaluation set with truth 1, 2 or 3, from a column of labels by name or by number; other labels have none."""
    from tessella.operators.forms import LABELS

    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    number = F.when(F.col(label).try_cast("int").isin(1, 2, 3), F.col(label).try_cast("int"))
    truth = number if numbers else F.try_element_at(known, F.lower(F.trim(F.col(label).cast("string"))))
    return read_csv(spark, path, schema).withColumn("truth", truth)


def write_holdout(df: DataFrame, path: str, features: list[str], label: str) -> None:
    """Features with _ground_truth and its name, as CSV."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in ((1, "thuong"), (2, "canhbao"), (3, "nang")) for x in kv]), F.col(label).cast("int"))
    write_csv(df.select(*features, F.col(label).alias("_ground_truth"), name.alias("_ground_truth_label")), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_records(frames: list[DataFrame], path: str, cut: int = 1000) -> None:
    """Evaluation records with different columns in one CSV, raw answers cut."""
    all_ = frames[0]
    for more in frames[1:]:
        all_ = all_.unionByName(more, allowMissingColumns=True)
    if "raw_response" in all_.columns:
        all_ = all_.withColumn("raw_response", F.substring("raw_response", 1, cut))
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in all_.dtypes]
    write_csv(all_.select(*flat), path)


def read_json(spark: SparkSession, path: str, schema: str, whole: bool = True) -> DataFrame:
    """JSON documents (whole files) or JSON lines."""
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_turns(turns: DataFrame, path: str) -> None:
    """Chat sessions only grow: each message is a new row."""
    turns.write.mode("append").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files, each as page 1."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.lit(1).alias("page"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Scans and PDF files as bytes, for a reader of your own (none is installed here)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def write_cards(cards: DataFrame, path: str) -> None:
    cards.select(F.concat(F.lit("--- "), F.col("patient").cast("string"), F.lit("\n"), F.col("card")).alias("value")).write.mode("overwrite").text(path)


def graph_frames(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph read from a file of a few dozen lines."""
    n = [(x["id"], x.get("type"), x.get("label"), json.dumps({k: v for k, v in x.items() if k not in ("id", "type", "label")}, ensure_ascii=False)) for x in nodes]
    e = [(x["source"], x["target"], x.get("relation"), float(x.get("weight", 1.0))) for x in edges]
    return spark.createDataFrame(n, "id string, type string, label string, attrs string"), spark.createDataFrame(e, "src string, dst string, relation string, weight double")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a YAML file of a few dozen lines, read through Spark, so from any store. Needs a YAML parser."""
    import yaml

    found = yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"])
    return graph_frames(spark, found.get("nodes") or [], found.get("edges") or [])


def graph_yaml(nodes: DataFrame, edges: DataFrame) -> str:
    """A graph of a few dozen nodes as YAML; strings are quoted."""
    quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = ["nodes:"]
    for r in nodes.orderBy("id").toLocalIterator():
        out += [f"  - id: {r['id']}", f"    type: {r['type']}", f"    label: {quote(r['label'])}"]
    out.append("edges:")
    for r in edges.orderBy("src", "dst", "relation").toLocalIterator():
        out += [f"  - source: {r['src']}", f"    target: {r['dst']}", f"    relation: {r['relation']}", f"    weight: {r['weight']}"]
    return "\n".join(out) + "\n"


def thinned(stats: DataFrame, values: str, most: int = 100) -> DataFrame:
    """At most `most` evenly spaced values of each array."""
    n = F.size(values)
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(values, F.floor(i * (n - 1) / (most - 1)).cast("int")))
    return stats.withColumn(values, F.when(n <= most, F.col(values)).otherwise(even))


def cached(spark: SparkSession, path: str, make, meta: dict[str, str]) -> DataFrame:
    """The table at path if what it was made from is the same, else made anew."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    want = json.dumps(meta, sort_keys=True)
    if not there or spark.read.text(f"{path}/meta").first()["value"] != want:
        make().write.mode("overwrite").parquet(f"{path}/table")
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return spark.read.parquet(f"{path}/table")


def markdown(row: dict[str, object], title: str) -> str:
    """A one-row report as Markdown."""
    lines = [f"# {title}", "", "| metric | value |", "| --- | --- |"]
    lines += [f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in row.items()]
    return "\n".join(lines) + "\n"

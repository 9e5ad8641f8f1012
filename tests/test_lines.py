"""Pages from scanned words: by rows of words and by lines of words."""

from pyspark.sql import functions as F

from tessella.operators import labtext
from tessella.plans import catalogue


def test_lines_equal_rows_of_words(spark):
    rows = [(1, 2, 1, "b", 0.5), (1, 2, 0, "a", 1.0), (1, 1, 0, "c", None), (2, 7, 3, "é", 0.25), (2, 7, 1, "d", 0.75), (2, 9, 0, "e", 1.0)]
    words = spark.createDataFrame(rows, "page int, line int, place int, word string, confidence double")
    lines = words.groupBy("page", "line").agg(F.collect_list(F.struct("place", "word", "confidence")).alias("words"))
    lines = lines.unionByName(lines.limit(1).select("page", F.lit(99).alias("line"), F.slice("words", 1, 0).alias("words")))
    want = [(1, "c\na b", 0.75), (2, "d é\ne", 0.75)]
    for got in (labtext.rebuilt(words, "page"), labtext.rebuilt_lines(lines, "page")):
        assert sorted(map(tuple, got.collect())) == want


def test_one_shuffle_of_lines(spark, tiny):
    plan = catalogue.queries()["text_from_words"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1

"""BM25 from one pass over the texts, and an index of vectors that is read in blocks."""

from pyspark.sql import functions as F

from tessella.operators import retrieval


def rows(df):
    return sorted(map(repr, df.collect()))


def test_used_postings(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None), (5, "x x x y"), (6, "A é_1 a")], "doc_id int, text string")
    queries = spark.createDataFrame([(7, "a"), (7, "é_1"), (8, "c"), (8, "none")], "query int, term string")
    used, n, mean = retrieval.used_postings(docs, "doc_id", "text", queries)
    assert (n, mean) == retrieval.corpus_size(docs, "text")
    every = retrieval.postings(docs, "doc_id", "text")
    columns = ["doc_id", "size", "term", "tf"]
    assert rows(used.select(columns)) == rows(every.where(F.col("term").isin("a", "é_1", "c", "none")).select(columns))
    assert rows(retrieval.bm25(used, n, mean, queries, "doc_id", 3)) == rows(retrieval.bm25(every, n, mean, queries, "doc_id", 3))
    assert retrieval.used_postings(docs.limit(0), "doc_id", "text", queries)[1:] == (0, 1.0)

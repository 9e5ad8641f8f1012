"""The registered queries opN_<name> and the SQL twins that exist."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, graph_search, html, language_model, ngram_join, packing, prefix_trie, quality, secrets, sharding, toxicity, whitening
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(table(spark, sf_dir, "documents"))


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.document_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell"
    )


def op3_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return secrets.digest(found)


def op5_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train_chain(docs, toxicity.label_categories(table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    return toxicity.score(docs, chain).withColumn("rejected", F.col("p_toxic") >= toxicity.REJECT)


def op7_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.cosine_links(table(spark, sf_dir, "embeddings"), 0.9)


def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train_voters(docs, table(spark, sf_dir, "labels")))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.train(docs.where(~language_model.held_out())))


def op11_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.search(table(spark, sf_dir, "embeddings"), 10, 100)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 32).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_JACCARD = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
x AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS k, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.k) AS ka, any_value(b.k) AS kb, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, ka, kb FROM p WHERE 10 * i >= 8 * (na + nb - i)),
r AS (SELECT doc_id AS v, doc_id AS x FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.x),
c AS (SELECT v, min(x) AS class_id FROM r GROUP BY v), n AS (SELECT a, count(*) AS n_links, count(DISTINCT kb) FILTER (kb <> ka) AS n_texts FROM l GROUP BY a)
SELECT v AS doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts, v = class_id AS kept FROM c LEFT JOIN n ON a = v"""

_COSINE = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e WHERE v IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS x FROM embeddings UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.x),
c AS (SELECT v, min(x) AS component_id FROM r GROUP BY v), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v AS vec_id, coalesce(n_links, 0) AS n_links, component_id, v = component_id AS kept FROM c LEFT JOIN n ON a = v"""


_TRIE = """WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM o GROUP BY c),
t AS (SELECT i, CASE WHEN i % 2 = 1 THEN xor(i // 2, 3988292384) ELSE i // 2 END AS j FROM range(256) r(i)),
t2 AS (SELECT t.i, CASE WHEN t.j % 2 = 1 THEN xor(t.j // 2, 3988292384) ELSE t.j // 2 END AS j FROM t),
t3 AS (SELECT i, CASE WHEN j % 2 = 1 THEN xor(j // 2, 3988292384) ELSE j // 2 END AS j FROM t2),
t4 AS (SELECT i, CASE WHEN j % 2 = 1 THEN xor(j // 2, 3988292384) ELSE j // 2 END AS j FROM t3),
t5 AS (SELECT i, CASE WHEN j % 2 = 1 THEN xor(j // 2, 3988292384) ELSE j // 2 END AS j FROM t4),
t6 AS (SELECT i, CASE WHEN j % 2 = 1 THEN xor(j // 2, 3988292384) ELSE j // 2 END AS j FROM t5),
t7 AS (SELECT i, CASE WHEN j % 2 = 1 THEN xor(j // 2, 3988292384) ELSE j // 2 END AS j FROM t6),
t8 AS (SELECT list(CASE WHEN j % 2 = 1 THEN xor(j // 2, 3988292384) ELSE j // 2 END ORDER BY i) AS t FROM t7),
p AS (SELECT n.c, n.n, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(n.c AS VARCHAR)) + 1), lambda k: CAST(ascii(substring(CAST(n.c AS VARCHAR), k, 1)) AS BIGINT))),
  lambda a, b: xor(a // 256, t8.t[xor(a % 256, b) + 1])) AS crc FROM n, t8),
h AS (SELECT p.c, p.n, xor(crc, 4294967295) % 4 AS h, least(xor(crc, 4294967295) % 4, coalesce(b.n, 0)) AS g FROM p LEFT JOIN n b ON b.c = p.c - p.c % 20),
r AS (SELECT h.c, o.pos - h.h + h.g AS d, o.role, o.text FROM h JOIN o ON o.c = h.c AND o.pos > h.h UNION ALL SELECT h.c, o.pos, o.role, o.text FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.pos <= h.g),
z AS (SELECT c, 0 AS d, list_value() AS path, 0 AS words FROM n UNION ALL
  SELECT c, d, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM r),
y AS (SELECT c, CAST(d AS BIGINT) AS d, md5(CAST(to_json(path) AS VARCHAR)) AS k, words, lag(md5(CAST(to_json(path) AS VARCHAR))) OVER (PARTITION BY c ORDER BY d) AS pk, d = max(d) OVER (PARTITION BY c) AS ends FROM z),
v AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(pk) AS pk, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM y GROUP BY k, d),
k AS (SELECT pk, count(*) AS n_children FROM v WHERE pk IS NOT NULL GROUP BY pk),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS worth FROM v LEFT JOIN k ON k.pk = v.k),
s AS (SELECT a.k, count(*) FILTER (w.n_children = 0) AS n_leaves, sum(w.worth) AS saved_tokens FROM w JOIN y b ON b.k = w.k AND b.c = w.conv_id JOIN y a ON a.c = b.c AND a.d <= b.d GROUP BY a.k)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(w.ids) AS ends_sha256 FROM w JOIN s ON s.k = w.k LEFT JOIN v q ON q.k = w.pk"""


def oracle_sql() -> dict[str, str]:
    """The other operators train models, tokenise or parse, which SQL can't express."""
    return {"op1_ngram_jaccard_join": _JACCARD, "op8_pivot_range_join": _COSINE, "op12_prefix_trie": _TRIE}

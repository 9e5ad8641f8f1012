"""Queries of the text, retrieval and graph operators over the driver's tables, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import constants as C
from tessella.functions import text as X
from tessella.functions.shared import shared_folder
from tessella.operators import graph, labtext, position, retrieval, stored

from .common import rounded, table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_WORDS = "regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}_]+)', 1)"
_FOLD = f"translate(lower({{}}), '{C.ACCENTED}', '{C.PLAIN}')"


@query("fold_text", f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.folded(F.col("text"))).alias("folded"))


@query("tokenize_counts", f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS token FROM documents) GROUP BY token")
def tokenize_counts(spark, d):
    post = retrieval.postings(table(spark, d, "documents"), "doc_id", "text")
    return post.groupBy(F.col("term").alias("token")).agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("normalized_text", "SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS normal FROM documents")
def normalized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.squeezed(F.col("text"))).alias("normal"))


@query(
    "fixed_chunks",
    "SELECT doc_id, k AS chunk, length(c) AS n_chars, md5(c) AS hash FROM (SELECT doc_id, k, substr(text, 1050 * k + 1, 1200) AS c FROM (SELECT doc_id, text, unnest(range(CAST(greatest(0, ceil((length(text) - 1200) / 1050.0)) AS BIGINT) + 1)) AS k FROM documents))",
)
def fixed_chunks(spark, d):
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk", "c"))
    return cut.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("hash"))


@query("section_chunks")
def section_chunks(spark, d):
    return retrieval.section_chunks(table(spark, d, "documents"), "doc_id", "text")


@query(
    "sentences",
    "WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(trim(text), '\\n+\\s*-\\s*', '. ', 'g'), '\\n+', ' ', 'g') AS t FROM documents), "
    "s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?;])\\s+(\\p{Lu})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 8) AS s FROM f) "
    "SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS place, unnest(s) AS sentence FROM s",
)
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("place", "sentence"))


_TERMS = f"q AS (SELECT DISTINCT item_id AS query, unnest({_WORDS.format('text')}) AS term FROM benchmark WHERE item_id % 100 = 0)"
_POST = f"w AS (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents), p AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM w) GROUP BY ALL)"
_BM25 = f"""{_TERMS}, {_POST}, g AS (SELECT count(*) AS n, round(avg(len(t)), 9) AS mean FROM w), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b0 AS (SELECT query, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))), 9) AS score FROM q JOIN p USING (term) JOIN df USING (term), g GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) - 1 AS rank FROM b0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 30)"""


def _queries(spark, d):
    """Every hundredth test text as a query: its distinct words."""
    items = table(spark, d, "benchmark").where("item_id % 100 = 0")
    return items.select(F.col("item_id").alias("query"), F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))


def _bm25(spark, d):
    asked = _queries(spark, d)
    post, n, mean = retrieval.used_postings(table(spark, d, "documents"), "doc_id", "text", asked)
    return retrieval.bm25(post, n, mean, asked, "doc_id", C.CANDIDATES)


@query("bm25_topk", f"WITH {_BM25} SELECT query, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM bm")
def bm25_topk(spark, d):
    return _bm25(spark, d).withColumn("score", F.round("score", 6))


@query("stored_bm25_topk", f"WITH {_BM25} SELECT query, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM bm")
def stored_bm25_topk(spark, d):
    """As bm25_topk, from an index to which the texts are added in two batches."""
    docs, path = table(spark, d, "documents"), f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    stored.TermIndex.add(path, docs.where("doc_id % 3 = 0"), buckets=16)
    stored.TermIndex.add(path, docs.where("doc_id % 3 <> 0"))
    return stored.TermIndex.open(spark, path, docs).search(_queries(spark, d), C.CANDIDATES).withColumn("score", F.round("score", 6))


_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_DENSE = f"dn AS (SELECT a.vec_id AS query, b.vec_id, round({_DOT}, 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 9) DESC, b.vec_id) - 1 AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 9) DESC, b.vec_id) <= 30)"


def _dense(spark, d, k: int = C.CANDIDATES):
    base = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.dense_top(base, base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), "vec_id", "embedding", k)


@query("dense_topk", f"WITH {_DENSE} SELECT query, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM dn")
def dense_topk(spark, d):
    return _dense(spark, d).withColumn("score", F.round("score", 6))


@query("stored_dense_topk", f"WITH {_DENSE} SELECT query, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM dn")
def stored_dense_topk(spark, d):
    """As dense_topk, from an index of cells."""
    base, path = table(spark, d, "embeddings"), f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    index = stored.VectorIndex.build(path, base)
    asked = base.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return index.search(asked, C.CANDIDATES).withColumn("score", F.round("score", 6))


@query("rerank_threshold", f"WITH {_DENSE} SELECT query, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM dn WHERE score >= 0.35 AND rank < 6")
def rerank_threshold(spark, d):
    found = _dense(spark, d).where((F.col("score") >= C.CHUNK_SIMILARITY) & (F.col("rank") < C.KEEP))
    return found.withColumn("score", F.round("score", 6))


@query(
    "rrf_fusion",
    f"WITH {_BM25}, {_DENSE}, u AS (SELECT query, doc_id AS id, rank FROM bm UNION ALL SELECT query, vec_id, rank FROM dn), f AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM u GROUP BY ALL) "
    "SELECT query, id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS INT) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 20",
)
def rrf_fusion(spark, d):
    lists = [_bm25(spark, d).withColumnRenamed("doc_id", "id"), _dense(spark, d).withColumnRenamed("vec_id", "id")]
    return retrieval.fuse(lists, "id", 20).withColumn("score", F.round("score", 9))


_MMR = f"""c AS (SELECT d.query, d.vec_id, d.score, e.embedding FROM dn d JOIN embeddings e ON e.vec_id = d.vec_id),
m0 AS (SELECT *, round(0.7 * score, 9) AS mmr FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(0.7 * score, 9) DESC, score DESC, vec_id) = 1),
n1 AS (SELECT a.query, a.vec_id, a.score, a.embedding, round(0.7 * a.score - 0.3 * {_DOT}, 9) AS mmr FROM c a JOIN m0 b ON a.query = b.query AND a.vec_id <> b.vec_id),
m1 AS (SELECT * FROM n1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY mmr DESC, score DESC, vec_id) = 1),
s1 AS (SELECT query, vec_id, embedding FROM m0 UNION ALL SELECT query, vec_id, embedding FROM m1),
n2 AS (SELECT a.query, a.vec_id, any_value(a.score) AS score, round(0.7 * any_value(a.score) - 0.3 * max({_DOT}), 9) AS mmr, max(CAST(a.vec_id = b.vec_id AS INT)) AS taken FROM c a JOIN s1 b ON a.query = b.query GROUP BY 1, 2),
m2 AS (SELECT * FROM n2 WHERE taken = 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY mmr DESC, score DESC, vec_id) = 1)"""


@query("mmr_select", f"WITH {_DENSE}, {_MMR} SELECT query, vec_id, 0 AS step, round(mmr, 6) AS mmr FROM m0 UNION ALL SELECT query, vec_id, 1, round(mmr, 6) FROM m1 UNION ALL SELECT query, vec_id, 2, round(mmr, 6) FROM m2")
def mmr_select(spark, d):
    found = _dense(spark, d).drop("rank").join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    chosen = retrieval.diverse(found.select("query", "vec_id", "score", "embedding"), "vec_id", "embedding", C.CARDS)
    return chosen.select("query", "vec_id", "step", F.round("mmr", 6).alias("mmr"))


@query(
    "keyword_overlap_topk",
    f"WITH {_TERMS}, dt AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents), s AS (SELECT query, doc_id, count(*) AS shared FROM q JOIN dt USING (term) GROUP BY 1, 2) "
    "SELECT query, doc_id, shared, CAST(row_number() OVER (PARTITION BY query ORDER BY shared DESC, doc_id) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, doc_id) <= 5",
)
def keyword_overlap(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))
    return retrieval.overlap_top(docs, _queries(spark, d), "doc_id", 5)


_BARE = f"regexp_replace({_FOLD.format('q')}, '\\p{{M}}', '', 'g')"
_WORDED = "(?:^|[^\\p{L}\\p{N}_])%s(?:$|[^\\p{L}\\p{N}_])"
_ADDED = ", ".join(
    f"CASE WHEN contains(lower(q), '{t}') THEN [] {' '.join(f"WHEN regexp_matches(bare, '{_WORDED % v.replace('.', '[.]')}') THEN [{', '.join(f"'{m}'" for m in more)}]" for v, more in rules)} ELSE [] END" for t, rules in retrieval.expansions()
)


@query(
    "query_expand",
    f"WITH q AS (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ' PLT. và (dengue) shock' ELSE '' END AS q FROM conversations WHERE role = 'user'), l AS (SELECT *, {_BARE} AS bare FROM q), "
    f"e AS (SELECT conv_id, turn, q, flatten([{_ADDED}])[1:6] AS e FROM l) SELECT conv_id, turn, array_to_string(list_concat([q], e), ' ') AS expanded FROM e",
)
def query_expand(spark, d):
    asked = F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit(" PLT. và (dengue) shock")).otherwise(F.lit("")))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", retrieval.expanded(asked).alias("expanded"))


_PATTERNS = [("secret", "(password|token)[^a-z]{1,4}[a-z0-9]+"), ("license", "Licensed under"), ("insult", "(idiot|stupid)")]


@query(
    "concept_evidence",
    f"WITH pt AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{p}')" for n, p in _PATTERNS)}) t(concept, pattern)), m AS (SELECT doc_id, concept, text, regexp_extract(text, pattern, 0) AS found FROM documents JOIN pt ON regexp_matches(text, pattern)), "
    "a AS (SELECT *, instr(text, found) AS place FROM m) SELECT doc_id, concept, CAST(place AS INT) AS place, found, substr(text, greatest(place - 100, 1), place - greatest(place - 100, 1) + length(found) + 100) AS snippet FROM a",
)
def concept_evidence(spark, d):
    patterns = spark.createDataFrame(_PATTERNS, "concept string, pattern string")
    return retrieval.evidence(table(spark, d, "documents"), "doc_id", "text", patterns)


@query(
    "concept_counts",
    f"WITH pt AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{p}')" for n, p in _PATTERNS)}) t(concept, pattern)) SELECT concept, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents JOIN pt ON regexp_matches(text, pattern) GROUP BY concept",
)
def concept_counts(spark, d):
    patterns = spark.createDataFrame(_PATTERNS, "concept string, pattern string")
    found = retrieval.evidence(table(spark, d, "documents"), "doc_id", "text", patterns)
    return found.groupBy("concept").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


_TREE = """nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier),
edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS relation, 1.5 AS weight FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'hosts', 1.0 FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || (s_suppkey % 5), 'serves', 0.5 FROM supplier)"""
_PATHS = """p AS (SELECT [src, dst] AS path, [relation] AS relations, dst AS e, 1 AS hops, CAST(weight AS DOUBLE) AS score FROM edges WHERE src LIKE 'r%'
UNION ALL SELECT list_append(path, dst), list_append(relations, relation), dst, hops + 1, CAST(weight AS DOUBLE) / (hops + 1) FROM p JOIN edges ON src = e WHERE hops < {h} AND NOT list_contains(path, dst))"""


def _tree(spark, d):
    """Regions, nations and suppliers as a graph."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    node = lambda df, p, c, kind, label: df.select(key(p, c).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"))
    nodes = node(region, "r", "r_regionkey", "region", "r_name").unionByName(node(nation, "n", "n_nationkey", "nation", "n_name")).unionByName(node(supplier, "s", "s_suppkey", "supplier", "s_name"))
    edge = lambda df, a, b, relation, weight: df.select(a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight"))
    edges = (
        edge(nation, key("r", "n_regionkey"), key("n", "n_nationkey"), "contains", 1.5)
        .unionByName(edge(supplier, key("n", "s_nationkey"), key("s", "s_suppkey"), "hosts", 1.0))
        .unionByName(edge(supplier, key("s", "s_suppkey"), F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string")), "serves", 0.5))
    )
    return nodes, edges


def _paths(spark, d, hops, relations=None):
    nodes, edges = _tree(spark, d)
    return graph.paths(edges, nodes.where("type = 'region'").select("id"), hops, relations)


def _flat(found):
    return found.select(F.array_join("path", "/").alias("path"), F.array_join("relations", "/").alias("relations"), "hops", F.round("score", 9).alias("score"))


_FLAT = "SELECT array_to_string(path, '/') AS path, array_to_string(relations, '/') AS relations, hops, round(score, 9) AS score FROM p"


@query("graph_paths_2hop", f"WITH RECURSIVE {_TREE}, {_PATHS.format(h=2)} {_FLAT}")
def graph_paths(spark, d):
    return _flat(_paths(spark, d, 2))


@query("graph_paths_3hop", f"WITH RECURSIVE {_TREE}, {_PATHS.format(h=3)} {_FLAT}")
def graph_paths_3(spark, d):
    return _flat(_paths(spark, d, 3))


@query("graph_relation_filter", f"WITH RECURSIVE {_TREE.replace('edges AS', 'all_edges AS')}, edges AS (SELECT * FROM all_edges WHERE relation IN ('contains', 'serves')), {_PATHS.format(h=2)} {_FLAT}")
def graph_relation(spark, d):
    return _flat(_paths(spark, d, 2, ["contains", "serves"]))


@query("graph_top_facts", f"WITH RECURSIVE {_TREE}, {_PATHS.format(h=3)} {_FLAT} ORDER BY p.score DESC, hops, array_to_string(p.path, '/') LIMIT 40")
def graph_facts(spark, d):
    return _flat(graph.facts(_paths(spark, d, 3), 40))


_ASKED = """t AS (SELECT list(DISTINCT 'n' || n_nationkey) AS t FROM nation WHERE n_nationkey % 10 = 2 AND n_nationkey > 9),
w AS (SELECT p.*, list_distinct(list_filter(regexp_extract_all(lower(array_to_string(path, ' ')), '([\\p{L}\\p{N}]+)', 1), lambda x: length(x) >= 3)) AS w FROM p),
s AS (SELECT w.*, CASE WHEN len(w) > 0 THEN least(1.0::DOUBLE, len(list_intersect(w, t)) / len(w)::DOUBLE) ELSE 0 END + 0.3::DOUBLE * score AS q FROM w, t)"""


@query("graph_question_facts", f"WITH RECURSIVE {_TREE}, {_PATHS.format(h=3)}, {_ASKED} {_FLAT.replace('FROM p', 'FROM s')} WHERE q >= 0.15 ORDER BY q DESC, s.score DESC, hops, array_to_string(s.path, '/') LIMIT 6")
def graph_question(spark, d):
    nodes, edges = _tree(spark, d)
    asked = [r["id"] for r in table(spark, d, "nation").where("n_nationkey % 10 = 2 and n_nationkey > 9").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")).collect()]
    return _flat(graph.answered(_paths(spark, d, 3), asked))


@query("graph_evidence_counts", f"WITH RECURSIVE {_TREE}, {_PATHS.format(h=3)} SELECT label, count(*) AS n FROM p JOIN nodes ON id = e WHERE type = 'region' GROUP BY label")
def graph_evidence(spark, d):
    nodes, _ = _tree(spark, d)
    return graph.type_counts(_paths(spark, d, 3), nodes, "region")


@query("graph_node_counts", f"WITH {_TREE} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def graph_nodes(spark, d):
    return _tree(spark, d)[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "graph_activate",
    "SELECT node, count(*) AS n FROM (SELECT unnest([CASE WHEN o_totalprice > 400000 THEN 'high' END, CASE WHEN o_totalprice < 50000 THEN 'low' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END]) AS node FROM orders) WHERE node IS NOT NULL GROUP BY node",
)
def graph_activate(spark, d):
    rules = [("high", F.col("o_totalprice") > 400000), ("low", F.col("o_totalprice") < 50000), ("urgent", F.col("o_orderpriority").startswith("1"))]
    return graph.active(table(spark, d, "orders"), "o_orderkey", rules).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(
    "graph_label_match",
    "WITH n AS (SELECT i AS id, w AS label FROM (VALUES (1, 'that the'), (2, 'und'), (3, 'de la'), (4, 'scum')) t(i, w)) SELECT doc_id, id FROM documents JOIN n ON contains(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g') || ' ', ' ' || label || ' ')",
)
def graph_label_match(spark, d):
    nodes = spark.createDataFrame([(1, "that the"), (2, "und"), (3, "de la"), (4, "scum")], "id int, label string")
    return graph.named_in(table(spark, d, "documents"), "doc_id", "text", nodes)


@query(
    "graph_diff",
    "WITH o AS (SELECT n_nationkey AS id, n_regionkey AS x FROM nation WHERE n_nationkey < 20), n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS x FROM nation WHERE n_nationkey > 4) "
    "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.x <> n.x",
)
def graph_diff(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("x"))
    new = nation.where("id > 4").withColumn("x", F.when(F.col("id") % 4 == 0, F.col("x") + 1).otherwise(F.col("x")))
    return graph.difference(nation.where("id < 20"), new, "id", "x")


_DENSITY = "(length(lower(text)) - length(replace(lower(text), ' the ', ''))) // 5"
_RUNS = f"""pg AS (SELECT source, doc_id AS page, CAST({_DENSITY} AS INT) AS score FROM documents), f AS (SELECT *, sum(CAST(score < 1 AS INT)) OVER (PARTITION BY source ORDER BY page) AS far FROM pg),
c AS (SELECT *, coalesce(page - lag(page) OVER w > 50 OR far <> lag(far) OVER w, true) AS gap FROM f WHERE score >= 3 WINDOW w AS (PARTITION BY source ORDER BY page)),
r AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY source ORDER BY page) AS run FROM c)"""


def _runs(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("page"), graph.keyword_density(F.col("text"), [" the "]).alias("score"))
    return graph.runs(docs, "source", "page", "score", apart=50)


@query("page_runs", f'WITH {_RUNS} SELECT source, CAST(run AS BIGINT) AS run, min(page) AS "first", max(page) AS "last", count(*) AS n_core FROM r GROUP BY source, run')
def page_runs(spark, d):
    return _runs(spark, d)


@query("longest_page_run", f'WITH {_RUNS}, g AS (SELECT source, CAST(run AS BIGINT) AS run, min(page) AS "first", max(page) AS "last", count(*) AS n_core FROM r GROUP BY source, run) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_core DESC, run) = 1')
def longest_run(spark, d):
    return graph.longest_run(_runs(spark, d), "source")


_LAB = "CASE doc_id % 4 WHEN 0 THEN 'PLT: l' || (doc_id % 9) || 'O K/uL' WHEN 1 THEN 'WBC ' || (doc_id % 9) || ',5 k/ul' WHEN 2 THEN 'NS1 positive' ELSE 'note' END"


def _reports(spark, d):
    """Each whole text with a laboratory line before it."""
    i = F.col("doc_id")
    line = (
        F.when(i % 4 == 0, F.concat(F.lit("PLT: l"), (i % 9).cast("string"), F.lit("O K/uL")))
        .when(i % 4 == 1, F.concat(F.lit("WBC "), (i % 9).cast("string"), F.lit(",5 k/ul")))
        .when(i % 4 == 2, F.lit("NS1 positive"))
        .otherwise(F.lit("note"))
    )
    return table(spark, d, "documents").select("doc_id", F.concat(line, F.lit("\n"), "text").alias("text"))


def _word(names: list[str]) -> str:
    return "(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(n.replace("(", "\\(").replace(")", "\\)") for n in names) + ")(?:$|[^\\p{L}\\p{N}_])"


_EVERY = "|".join(a.replace("(", "\\(").replace(")", "\\)") for names in C.EXAMS.values() for a in sorted(names, key=len, reverse=True))
_DROP = f"regexp_replace({{}}, '(^|[^\\p{{{{L}}}}\\p{{{{N}}}}_])(?:{_EVERY})($|[^\\p{{{{L}}}}\\p{{{{N}}}}_])', '\\1 \\2', 'g')"
_TOKEN = "CASE WHEN regexp_matches(t, '^[0-9OolISBZg.,%<>=-]*[0-9][0-9OolISBZg.,%<>=-]*\\z') THEN regexp_replace(translate(t, 'OolISBZg', '00115829'), '^([^,]*\\d),(\\d{1,3})\\z', '\\1.\\2') ELSE t END"
_MENDED = f"array_to_string(list_transform(regexp_extract_all({{}}, '[ \\t\\f\\r]+|[^ \\t\\f\\r]+'), lambda t: {_TOKEN.replace('{', '{{').replace('}', '}}')}), '')"
_ROWS = (
    f"l AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line, unnest(ls) AS raw FROM (SELECT doc_id, string_split({_LAB} || chr(10) || text, chr(10)) AS ls FROM documents)), "
    f"m AS (SELECT doc_id, line, {_MENDED.format('raw')} AS t FROM l), "
    "x AS (SELECT doc_id, line, lower(t) AS low, CASE " + " ".join(f"WHEN regexp_matches(lower(t), '{_word(n)}') THEN '{e}'" for e, n in C.EXAMS.items()) + " END AS exam FROM m), "
    f"y AS (SELECT *, {_DROP.format(_DROP.format('low'))} AS rest FROM x WHERE exam IS NOT NULL), "
    "z AS (SELECT doc_id, exam, line, TRY_CAST(replace(nullif(regexp_extract(rest, '(-?\\d+(?:[.,]\\d+)?)', 1), ''), ',', '.') AS DOUBLE) AS value, nullif(regexp_extract(rest, '(positive|negative|dương tính|âm tính)', 1), '') AS word, "
    "nullif(regexp_extract(low, '(k/ul|m/ul|g/dl|u/l|mmol/l|umol/l|%)', 1), '') AS unit, row_number() OVER (PARTITION BY doc_id, exam ORDER BY line) AS r FROM y)"
)


@query("lab_line_parse", f"WITH {_ROWS} SELECT doc_id, exam, line, value, word, unit FROM z WHERE r = 1")
def lab_line_parse(spark, d):
    return labtext.lab_rows(_reports(spark, d), "doc_id")


_FIXED = f"array_to_string(list_transform(string_split({{}}, chr(10)), lambda x: CASE WHEN regexp_matches(lower(x), '{'|'.join(C.LAB_WORDS)}') THEN {_MENDED.format('x').replace('{', '{{').replace('}', '}}')} ELSE x END), chr(10))"


@query("ocr_number_fix", f"SELECT doc_id, md5({_FIXED.format(f'{_LAB} || chr(10) || text')}) AS hash FROM documents")
def ocr_number_fix(spark, d):
    return _reports(spark, d).select("doc_id", F.md5(labtext.repaired(F.col("text"))).alias("hash"))


@query("lab_exam_counts", f"WITH {_ROWS} SELECT exam, count(*) AS n FROM z WHERE r = 1 GROUP BY exam")
def lab_exam_counts(spark, d):
    return labtext.lab_rows(_reports(spark, d), "doc_id").groupBy("exam").agg(F.count(F.lit(1)).alias("n"))


_EACH = _DENSE.replace(" WHERE a.vec_id % 100 = 0", "")


@query("nearest_embedding_labels", f"WITH {_EACH} SELECT query, e.label, count(*) AS n FROM dn JOIN embeddings e ON e.vec_id = dn.vec_id WHERE rank < 10 GROUP BY ALL")
def nearest_labels(spark, d):
    """Every row asks."""
    base = table(spark, d, "embeddings")
    found = retrieval.dense_top(base, base.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), "vec_id", "embedding", 10)
    return position.label_counts(found, base, "vec_id", "label")


@query("embedding_norms", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def embedding_norms(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(retrieval.dot(v, v)), 6).alias("norm"))

"""Property graphs as two DataFrames: nodes (id, type, label) and edges (src, dst, relation, weight)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import constants as C
from tessella.functions.concepts import CONCEPTS
from tessella.functions.text import words as tokens

from .position import if_small


def paths(edges: DataFrame, seeds: DataFrame, hops: int, relations: list[str] | None = None) -> DataFrame:
    """Simple paths of 1 to `hops` edges from each seed (a column id): path, relations, hops, score.

    A path's score is the weight of its last edge divided by its hops. Each hop is one join of the paths' ends with
    the edges; the number of hops is a parameter, so the loop is short whatever the graph.
    """
    if relations is not None:
        edges = edges.where(F.col("relation").isin(*relations))
    step = edges.select("src", "dst", "relation", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    front = seeds.select(F.array("id").alias("path"), F.array().cast("array<string>").alias("relations"), F.col("id").alias("end"))
    found = None
    for hop in range(1, hops + 1):
        joined = front.join(step, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        grown = joined.select(
            F.concat("path", F.array("dst")).alias("path"),
            F.concat("relations", F.array("relation")).alias("relations"),
            F.col("dst").alias("end"),
            F.lit(hop).alias("hops"),
            (F.col("weight") / hop).alias("score"),
        )
        found = grown if found is None else found.unionByName(grown)
        front = grown.select("path", "relations", "end")
    return found


def facts(found: DataFrame, k: int) -> DataFrame:
    """The k best paths; the shorter and then the alphabetically first wins ties."""
    return found.orderBy(F.desc("score"), "hops", F.array_join("path", "/")).limit(k)


def question_score(found: DataFrame, tokens: list[str], least: float = 0.15) -> DataFrame:
    """Share of a path's words that the question has, at most 1, plus 0.3 of its score; those below `least` go."""
    of_path = F.filter(F.regexp_extract_all(F.lower(F.array_join("path", " ")), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda t: F.length(t) >= 3)
    shared = F.size(F.array_intersect(of_path, F.array(*[F.lit(t) for t in tokens])))
    share = F.when(F.size(of_path) > 0, F.least(F.lit(1.0), shared / F.size(F.array_distinct(of_path)))).otherwise(0.0)
    return found.withColumn("question_score", share + 0.3 * F.col("score")).where(F.col("question_score") >= least)


def answered(found: DataFrame, tokens: list[str], k: int = 6, least: float = 0.15) -> DataFrame:
    """The k paths that answer a question best; if none does at all, the k best by their own score. Adds question_score (null then)."""
    asked = question_score(found, tokens, least).orderBy(F.desc("question_score"), F.desc("score"), "hops", F.array_join("path", "/")).limit(k)
    own = facts(found, k).withColumn("question_score", F.lit(None).cast("double"))
    some = asked.agg(F.count(F.lit(1)).alias("_n"))
    return asked.unionByName(own.crossJoin(F.broadcast(some)).where("_n = 0").drop("_n"))


def existing(active: DataFrame, nodes: DataFrame) -> DataFrame:
    """Activated nodes (a column node) that the graph has."""
    return active.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select(active.columns)


def of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind)


def required_part(pattern: str) -> str:
    """The longest piece of plain text, in lower case, that every match of a pattern holds; empty where there is none."""
    import re._constants as kinds
    import re._parser as parser

    pieces, run = [""], ""
    for kind, value in parser.parse(pattern, re.IGNORECASE):
        if kind is kinds.LITERAL:
            run += chr(value).lower()
        else:
            pieces.append(run)
            run = ""
    return max([*pieces, run], key=len)


def concept_patterns() -> list[tuple[str, str, int, str, str]]:
    """(type, concept, place, pattern, required part) of the guideline's concepts; places follow their order."""
    listed = [(kind, name, p) for kind, group in CONCEPTS.items() for name, c in group.items() for p in c["patterns"]]
    return [(kind, name, i, p, required_part(p)) for i, (kind, name, p) in enumerate(listed)]


def concept_matches(pages: DataFrame, page: str, text: str, around: int = 100, most: int = 300) -> DataFrame:
    """(page, type, concept, place, snippet): the first match of each pattern of the guideline's concepts on each page, in brackets among
    what stands around it.

    One pass over a page looks for the plain text that each pattern requires; only patterns whose text is there are matched.
    """
    known = F.from_json(F.lit(json.dumps([dict(zip(("type", "concept", "place", "pattern", "part"), r, strict=True)) for r in concept_patterns()])), "array<struct<type:string,concept:string,place:int,pattern:string,part:string>>")
    flat = pages.select(F.col(page).alias("page"), F.regexp_replace(text, r"[\s\u00a0]+", " ").alias("flat")).withColumn("low", F.lower("flat"))
    near = flat.select("page", "flat", F.explode(F.filter(known, lambda k: F.contains(F.col("low"), k["part"]))).alias("k"))
    pattern = F.concat(F.lit("(?iu)"), F.regexp_replace("k.pattern", r"^\\b", r"(?<![\\p{L}\\p{N}_])"))
    found = near.withColumn("at", F.regexp_instr("flat", pattern)).where("at > 0").withColumn("found", F.regexp_substr("flat", pattern))
    begin, end = F.greatest(F.col("at") - around, F.lit(1)), F.col("at") + F.length("found")
    snippet = F.concat(F.substring("flat", begin, F.col("at") - begin), F.lit("["), F.col("found"), F.lit("]"), F.substring("flat", end, F.lit(around)))
    return found.select("page", "k.type", "k.concept", "k.place", F.substring(F.trim(snippet), 1, most).alias("snippet"))


def concept_graph(matches: DataFrame, unseen: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the guideline from concept_matches. Nodes: id, type, label, n_pages, first_page, evidence (of the first page,
    by its first pattern), description, threshold, note; concepts that no page names are there only if `unseen`. Edges (src, dst,
    relation, weight) between concepts follow from their types. The pages of a concept are the distinct pages of its matches."""
    spark = matches.sparkSession
    rows = [(n, kind, c["label"], c.get("contraindicated", False), c.get("treats", []), c.get("description"), c.get("threshold"), c.get("note")) for kind, group in CONCEPTS.items() for n, c in group.items()]
    table = spark.createDataFrame(rows, "id string, type string, label string, contraindicated boolean, treats array<string>, description string, threshold string, note string")
    first = F.min(F.struct("page", "place", "snippet"))
    by_page = matches.groupBy("concept", "page").agg(F.min(F.struct("place", "snippet")).alias("m")).select("concept", "page", "m.*")
    seen = by_page.groupBy(F.col("concept").alias("id")).agg(F.count(F.lit(1)).alias("n_pages"), first.alias("first"))
    nodes = table.join(seen, "id", "left" if unseen else "inner")
    shown = nodes.select("id", "type", "label", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.col("first.page").alias("first_page"), F.col("first.snippet").alias("evidence"), "description", "threshold", "note")
    return shown, related(nodes)


def related(nodes: DataFrame) -> DataFrame:
    """(src, dst, relation, weight): what each concept says of the grades of severity, by its type (and drugs by whether
    they are contraindicated, a boolean column; interventions by the grades that they treat, an array column)."""
    rule = lambda k: F.array(*[F.struct(F.lit(g).alias("dst"), F.lit(r).alias("relation"), F.lit(w).alias("weight")) for r, g, w in k])
    mild = rule([("supports", "sxhd_thuong", 1.0)])
    severe = F.concat(rule(C.RELATIONS["warning_sign"]), rule([("warning_of", "sxhd_nang", 1.5)]))
    treated = F.transform(F.coalesce("treats", F.array().cast("array<string>")), lambda g: F.struct(g.alias("dst"), F.lit("treats").alias("relation"), F.lit(1.0).alias("weight")))
    kind = F.col("type")
    edges = (
        F.when(kind == "symptom", rule(C.RELATIONS["symptom"]))
        .when((kind == "warning_sign") & F.col("id").isin(*C.SEVERE_WARNINGS), severe)
        .when(kind == "warning_sign", rule(C.RELATIONS["warning_sign"]))
        .when((kind == "lab") & F.col("id").isin(*C.MILD_LABS), mild)
        .when(kind == "lab", rule(C.RELATIONS["lab"]))
        .when((kind == "drug") & F.coalesce("contraindicated", F.lit(False)), rule(C.RELATIONS["contraindicated"]))
        .when(kind == "drug", rule(C.RELATIONS["drug"]))
        .when(kind == "intervention", treated)
    )
    return nodes.select(F.col("id").alias("src"), F.explode(edges).alias("e")).select("src", "e.dst", "e.relation", "e.weight")


def reasoning(rows: DataFrame, key: str) -> DataFrame:
    """(key, src, dst, relation): a patient's small graph from plt_low, wbc_low, hct_up_plt_down (boolean) and the rules' level (text)."""
    low = F.lower(F.coalesce("level", F.lit("")))
    grave = low.contains("cảnh báo") | low.contains("nặng") | low.contains("khẩn")
    edge = lambda c, a, b, r: F.when(c, F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.lit(r).alias("relation")))
    edges = F.array(
        edge(F.col("plt_low"), "platelet_low", "dengue_suspicion", "supports"),
        edge(F.col("wbc_low"), "wbc_low", "dengue_suspicion", "supports"),
        edge(F.col("hct_up_plt_down"), "hct_rising_plus_plt_falling", "warning_pattern", "supports"),
        edge(grave, "warning_pattern", "supportive_care", "escalates_to"),
        edge(F.lit(True), "avoid_nsaids", "dengue_suspicion", "contraindicated_in_context"),
    )
    return rows.select(key, F.explode(F.array_compact(edges)).alias("e")).select(key, "e.*")


def active(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, node) of each rule that holds for a row."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    return rows.select(key, F.explode(hits).alias("node"))


def named_in(texts: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """(key, id) of nodes whose label stands in a text as a word; key is unique. An equi-join on words finds the labels'
    first words where the texts are read; only labels of several words look at a text again."""
    label = F.lower("label")
    first = F.regexp_extract(label, r"^([\p{L}\p{N}_]+)", 1)
    words = texts.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word"))
    met = words.join(if_small(nodes.select("id", label.alias("label"), first.alias("word"))), "word")
    whole = met.where(F.col("label") == F.col("word")).select(key, "id")
    part = met.where(F.col("label") != F.col("word")).select(key, "id", "label").join(texts.select(key, F.lower(text).alias("_low")), key)
    padded = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    return whole.unionByName(part.where(F.contains(padded(F.col("_low")), padded(F.col("label")))).select(key, "id"))


def difference(old: DataFrame, new: DataFrame, by: str, compared: str) -> DataFrame:
    """added, removed and changed rows by id."""
    added = new.join(old, by, "left_anti").select(by, F.lit("added").alias("change"))
    removed = old.join(new, by, "left_anti").select(by, F.lit("removed").alias("change"))
    both = old.select(by, F.col(compared).alias("_old")).join(new.select(by, F.col(compared).alias("_new")), by)
    changed = both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(by, F.lit("changed").alias("change"))
    return added.unionByName(removed).unionByName(changed)


def type_counts(found: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """How many paths end at each node of a type."""
    ends = found.select(F.element_at("path", -1).alias("id"))
    return ends.join(if_small(nodes.where(F.col("type") == kind).select("id", "label")), "id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def runs(pages: DataFrame, key: str, page: str, score: str, core: int = 3, near: int = 1, apart: int = 5, part: int = 10_000) -> DataFrame:
    """Runs of core pages at most `apart` from one another with only near pages between: key, run, first, last, n_core.

    Books (keys) are cut into ranges of `part` page numbers, so that one with most of the pages is shared out. In a range,
    windows find where runs begin; what a range hands to the next (its last core page, whether a far page follows it)
    is one row each, and so is what it adds to the numbers of runs: windows over a book's ranges do the rest.
    """
    far, is_core = F.coalesce(F.col(score) < near, F.lit(False)), F.coalesce(F.col(score) >= core, F.lit(False))
    cut = pages.select(key, F.col(page).alias("_page"), far.alias("_far"), is_core.alias("_core")).withColumn("_part", F.floor(F.col("_page") / part))
    last_core, last_far = F.max(F.when(F.col("_core"), F.col("_page"))), F.max(F.when(F.col("_far"), F.col("_page")))
    ranges = cut.groupBy(key, "_part").agg(last_core.alias("_c"), last_far.alias("_f"))
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.max("_c").over(w).alias("_c"), F.max("_f").over(w).alias("_f"))
    inside = Window.partitionBy(key, "_part").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.withColumn("_ci", F.max(F.when(F.col("_core"), F.col("_page"))).over(inside)).withColumn("_fi", F.max(F.when(F.col("_far"), F.col("_page"))).over(inside))
    joined = joined.where("_core").join(ranges, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    before, broken = F.coalesce("_ci", "_c"), F.coalesce("_fi", "_f")
    begins = before.isNull() | (F.col("_page") - before > apart) | F.coalesce(broken > before, F.lit(False)) | F.col("_far")
    cores = joined.select(key, "_part", "_page", begins.cast("int").alias("_new"))
    counts = cores.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.sum("_new").alias("_n"))
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("_new").over(Window.partitionBy(key, "_part").orderBy("_page").rowsBetween(Window.unboundedPreceding, 0))
    numbered = cores.withColumn("_in", within).join(counts.drop("_n"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    numbered = numbered.select(key, (F.col("_start") + F.col("_in")).alias("run"), "_page")
    return numbered.groupBy(key, "run").agg(F.min("_page").alias("first"), F.max("_page").alias("last"), F.count(F.lit(1)).alias("n_core"))


def longest_run(found: DataFrame, key: str) -> DataFrame:
    """The run of each key with most core pages, the first of equals."""
    best = F.max(F.struct("n_core", (-F.col("run")).alias("r"), "first", "last"))
    return found.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.r")).alias("run"), "b.first", "b.last", "b.n_core")


def keyword_density(text: Column, keywords: list[str]) -> Column:
    """How often keywords stand in a text."""
    low = F.lower(text)
    return sum((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k) for k in keywords).cast("int")


def built(evidence: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """A graph from (page, concept): concepts on at least `least` pages, and how many pages two of them share.

    Pairs are those of the concepts of one page, of which the pattern table holds few.
    """
    pages = evidence.select("page", "concept").distinct()
    nodes = pages.groupBy("concept").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= least).select(F.col("concept").alias("id"), "n_pages")
    other = pages.select("page", F.col("concept").alias("dst"))
    edges = pages.join(other, "page").where("concept < dst").groupBy(F.col("concept").alias("src"), "dst").agg(F.count(F.lit(1)).alias("weight"))
    return nodes, edges

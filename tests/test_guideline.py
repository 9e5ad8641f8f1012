"""The guideline's concepts: found as plain matching finds them, with their nodes and edges."""

import re

from tessella.functions.concepts import CONCEPTS
from tessella.operators import graph

SAYINGS = {
    r"(sau\s*)?": "sau ", r"(nhiều|liên\s*tục)": "liên tục", r"(ói\s*)?": "ói ", r"≥\s*\d+\s*lần": "≥ 3 lần", r"(mũi|chân\s*răng|nướu)": "chân răng", r">?\s*2\s*cm": "> 2 cm",
    r"<\s*0[,.]5\s*ml": "< 0,5 ml", r".*": " và rồi ", r"≥?\s*20\s*%?": "20 %", r"[/\\]?": "/", r">\s*\d+": "> 40", r"<\s*\d+": "< 4", r"<\s*100": "<100", r"[,.]?": ".", r"\b": "", "d.f": "d.f",
}


def saying(pattern):
    for part, said in SAYINGS.items():
        pattern = pattern.replace(part, said)
    return re.sub(r"\\s\*", " ", pattern)


def matched_plainly(pages, around=100):
    out = []
    for page, text in pages:
        flat = re.sub(r"\s+", " ", text or "")
        for kind, name, place, pattern, _ in graph.concept_patterns():
            if m := re.search(pattern, flat, re.IGNORECASE):
                near = f"{flat[max(0, m.start() - around) : m.start()]}[{m.group(0)}]{flat[m.end() : m.end() + around]}"
                out.append((page, kind, name, place, near.strip()[:300]))
    return sorted(out)


def pages_of(spark):
    said = [saying(p) for _, _, _, p, _ in graph.concept_patterns()]
    pages = [(i, f"{'trước đó ' * (i % 40)}{s.upper() if i % 2 else s}\n\n sau đó {i}") for i, s in enumerate(said)]
    pages += [(500, " ".join(said)), (501, ""), (502, None), (503, "snsaid xnsaids"), (504, "NSAIDs"), (505, "đau\n\tđầu"), (506, "không có gì")]
    return pages, spark.createDataFrame(pages, "page_no int, text string")


def test_matches_equal_plain_matching(spark):
    pages, df = pages_of(spark)
    want = matched_plainly([(p, t) for p, t in pages if t is not None])
    assert {w[3] for w in want} == {p[2] for p in graph.concept_patterns()}  # every pattern is met
    assert sorted(tuple(r) for r in graph.concept_matches(df, "page_no", "text").collect()) == want
    assert graph.concept_matches(df.limit(0), "page_no", "text").count() == 0


def test_required_parts():
    assert graph.required_part(r"đau\s*(sau\s*)?hốc\s*mắt") == "đau" or len(graph.required_part(r"đau\s*(sau\s*)?hốc\s*mắt")) == 3
    assert graph.required_part(r"(a|b)?") == "" and graph.required_part(r"ABC?x") == "abc"[:2] and graph.required_part("x+y") == "y"
    for _, _, _, pattern, part in graph.concept_patterns():
        assert part and re.search(pattern, saying(pattern), re.IGNORECASE) and part in saying(pattern).lower()


def test_nodes_and_edges(spark):
    pages, df = pages_of(spark)
    matches = graph.concept_matches(df, "page_no", "text")
    nodes, edges = graph.concept_graph(matches)
    got = {r["id"]: r for r in nodes.collect()}
    plain = matched_plainly([(p, t) for p, t in pages if t is not None])
    assert set(got) == {n for g in CONCEPTS.values() for n in g}
    for name, r in got.items():
        own = sorted((p, i, s) for p, _, n, i, s in plain if n == name)
        assert (r["n_pages"], r["first_page"], r["evidence"]) == (len({p for p, *_ in own}), own[0][0], own[0][2])
    pairs = {(r["src"], r["dst"], r["relation"], r["weight"]) for r in edges.collect()}
    assert ("tay_chan_lanh", "sxhd_nang", "warning_of", 1.5) in pairs and ("hflc_cao", "sxhd_thuong", "supports", 1.0) in pairs
    assert ("aspirin", "sxhd_nang", "contraindicated_for", 1.0) in pairs and ("paracetamol", "sxhd_canh_bao", "treats", 1.0) in pairs
    assert {d for s, d, *_ in pairs if s == "truyen_dich_tinh_mach"} == {"sxhd_canh_bao", "sxhd_nang"}
    assert len(pairs) == 6 + 9 + 3 + 5 + 4 * 3 + 2 + 6
    one = graph.concept_matches(df.where("page_no = 505"), "page_no", "text")
    few, few_edges = graph.concept_graph(one, unseen=False)
    assert [r["id"] for r in few.collect()] == ["dau_dau"] and few_edges.count() == 1
    assert graph.concept_graph(one)[0].where("n_pages = 0").count() == 32

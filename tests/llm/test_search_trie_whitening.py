"""Graph search, the prefix trie and whitening against brute force; odd rows in each."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import graph_search, prefix_trie, queries, whitening

NAN, INF = float("nan"), float("inf")
CLASHING = ["rep", "vec", "ids", "shard", "_at", "found", "rank", "score", "n", "d", "k1", "k2", "_part", "conv", "step", "path", "deviation", "component", "length", "task"]


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASHING})


# ---------------------------------------------------------------- graph search


def nearest_by_brute_force(rows, query, k=10):
    """[(id, score)] for the row at place `query`, over all other rows."""
    vec = np.array(rows[query][1])
    far = [(float(np.sqrt(((np.array(v) - vec) ** 2).sum())), i) for p, (i, v) in enumerate(rows) if p != query and len(v) == len(vec)]
    return sorted(far)[:k]


def test_search_recall_on_all_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_search, "LEAST_SHARD", 400)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 24))
    rows = [(i, (centres[i % 20] + rng.standard_normal(24) * (0.01 if i % 3 else 0.7)).tolist()) for i in range(3000)]
    got = collections.defaultdict(list)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for r in graph_search.search(df).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        found.sort()
        want = nearest_by_brute_force(rows, q)
        assert [r for r, *_ in found] == list(range(1, 11))
        exact = [np.sqrt(((np.array(rows[i][1]) - np.array(rows[q][1])) ** 2).sum()) for *_, i in found]
        np.testing.assert_allclose([s for _, s, _ in found], exact, rtol=1e-13)
        hits += len({i for *_, i in found} & {i for _, i in want})
    assert hits / (10 * len(got)) >= 0.97


def test_search_of_copies_and_odd_rows(spark):
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i), 1.0]) for i in range(300)] + [(200, [1.0, 2.0]), (-100, [5.0, 5.0])]
    odd = [(None, [1.0, 2.0]), (400, None), (500, [0.0, -0.0]), (600, [NAN, 1.0]), (700, [INF, 1.0]), (800, []), (900, [1.0, None])]
    df = clashing(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"))
    got = collections.defaultdict(list)
    for r in graph_search.search(df).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == {0, 100, 200, -100}
    for q in (0, 100, -100):
        place = next(p for p, (i, _) in enumerate(rows) if i == q)
        want = nearest_by_brute_force(rows, place)
        assert [(round(s, 9), i) for _, s, i in sorted(got[q])] == [(round(s, 9), i) for s, i in want]
    assert len(got[200]) == 20  # the id stands twice


def test_search_with_few_candidates_and_extremes(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (100, [1e300]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in graph_search.search(df).collect())
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    assert got[0][3] == 2.0 and got[1][3] == 1e300
    assert graph_search.search(df.limit(0)).count() == 0
    assert graph_search.search(df.where("vec_id = 100")).count() == 0


def test_pruning_keeps_what_no_kept_one_is_nearer_to():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((60, 5)).astype(np.float32)
    norms = (points**2).sum(1)
    own, candidates = np.array([3]), np.array([[*range(60), 5, -1]])
    got = [int(x) for x in graph_search.robust_prune(points, norms, own, candidates, 8, 1.2)[0] if x >= 0]
    left, want = sorted(set(range(60)) - {3}, key=lambda i: ((points[i] - points[3]) ** 2).sum()), []
    while left and len(want) < 8:
        want.append(left[0])
        left = [i for i in left if not 1.44 * ((points[i] - points[want[-1]]) ** 2).sum() < ((points[i] - points[3]) ** 2).sum() and i != want[-1]]
    assert got == want


def test_distances_neither_overflow_nor_vanish():
    far = graph_search.distances(np.array([[3e-200, 4e-200], [3e200, 4e200], [1.0, 1.0]]), np.zeros(2))
    np.testing.assert_allclose(far, [5e-200, 5e200, np.sqrt(2)], rtol=1e-12)


# ---------------------------------------------------------------- prefix trie


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 3000])
def test_findclose_by_a_stack(n):
    rng = np.random.default_rng(n)
    for lean in (0.5, 0.9, 0.1):
        bits, depth = [], 0
        while len(bits) < 2 * n:
            up = depth == 0 or (sum(bits) < n and rng.random() < lean)
            if sum(bits) == n:
                up = False
            bits.append(int(up))
            depth += 1 if up else -1
        tree, stack = prefix_trie.Parentheses(np.array(bits)), []
        for at, b in enumerate(bits):
            if b:
                stack.append(at)
            else:
                assert tree.findclose(stack.pop()) == at
        assert tree.pairs(len(bits)) == sum(bits[i] and not bits[i + 1] for i in range(len(bits) - 1))
        for i in rng.integers(0, len(bits), 5):
            assert tree.pairs(int(i)) == sum(bits[j] and not bits[j + 1] for j in range(i))


def trie_by_brute_force(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h]) + tuple(own[h:])
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own in members.items():
        worth = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += worth
    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if built[c] == p)))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard", [8, 200, prefix_trie.SHARD])
def test_trie_by_brute_force(spark, shard):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(400):  # few words, so that many conversations share their first turns, some are equal, some parts of others
        rows += [(c, t, "user" if t % 2 else "assistant", " ".join(rng.choice(["a", "b c", "d\te\nf"], 1 + int(rng.random() < 0.1)))) for t in range(int(rng.integers(1, 7)))]
    rows += [(1000 + k, t, "user", f"word {t}") for k in range(300) for t in range(5)]  # a third are alike
    rows += [(c, None, None, None) for c in (7, 21, 2003)] + [(None, 0, "user", "x"), (2040, 3, "", "same"), (2041, 3, None, "same"), (2047, 1, "user", None)]
    got = trie_rows(prefix_trie.trie(clashing(spark.createDataFrame(rows, TURNS)).repartition(7), shard))
    assert got == trie_by_brute_force(rows)


def test_trie_of_long_repeated_and_no_turns(spark):
    long = [(c, t, "user", f"w{t} x") for c in (0, 20, 41) for t in range(700)] + [(41, 900, "user", "y")]
    again = [(60, 1, "user", "z"), (60, 1, "user", "z"), (60, 1, "user", "z")]
    assert trie_rows(prefix_trie.trie(spark.createDataFrame(long + again, TURNS))) == trie_by_brute_force(long + again)
    turnless = [c for c in range(500, 560) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:3]
    rows = [(c, 0, "user", "gone") for c in turnless]
    assert trie_rows(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == trie_by_brute_force(rows)
    assert trie_rows(prefix_trie.trie(spark.createDataFrame(rows + again, TURNS))) == trie_by_brute_force(rows + again)
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    one = [(3, 0, "user", "a b c")]
    assert trie_rows(prefix_trie.trie(spark.createDataFrame(one, TURNS))) == trie_by_brute_force(one)


def test_trie_equals_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tiny}/conversations.parquet'")
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"
    want = con.execute(f"SELECT {names.replace(' ', ', ')} FROM ({queries.oracle_sql()['op12_prefix_trie']})").fetchall()
    assert trie_rows(queries.op12_prefix_trie(spark, tiny)) == sorted(want, key=str)


# ---------------------------------------------------------------- whitening


def test_counts_and_eigenvalues():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 9, 40):
        for trial in range(12):
            a = rng.standard_normal((d, d))
            a = np.round(a + a.T, 1 if trial % 3 == 0 else 12)
            e = np.linalg.eigvalsh(a)
            for shift in rng.uniform(-4, 4, 4):
                assert whitening.above(a, shift) == (e > shift).sum()
            b = [a @ a.T, np.diag(np.round(np.abs(np.diag(a)))), np.eye(d) * 3, a[:, : d // 2] @ a[:, : d // 2].T][trial % 4]
            want = np.linalg.eigvalsh(b)[::-1]
            values, axes = whitening.leading(b, 32)
            assert len(values) == min(32, int((want > 1e-10 * max(want[0], 1e-300)).sum()))
            if len(values):
                np.testing.assert_allclose(values, want[: len(values)], rtol=1e-10)
                assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12
                assert np.abs(b @ axes - axes * values).max() < 1e-12 * d * want[0]


def whitened_by_brute_force(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(object).astype(int) + 1_000_000
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    c = x - sums / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return deviation, np.abs(c @ u / np.sqrt(e)), e / np.trace(c.T @ c / n)


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((500, 40)) * np.linspace(1, 9, 40)).tolist()
    odd = [(600, None), (601, []), (602, [NAN] * 40), (603, [INF] + [0.0] * 39), (604, [None] + [0.0] * 39), (605, [1.0]), (606, [1e300] * 40)]
    df = clashing(spark.createDataFrame([(None if i == 7 else i, v) for i, v in enumerate(vectors)] + odd, "vec_id long, embedding array<double>"))
    rows = whitening.whiten(df.repartition(5)).collect()
    deviation, whitened, explained = whitened_by_brute_force(vectors, 32)
    assert len(rows) == 500 * 32
    for r in rows:
        i, k = 7 if r["vec_id"] is None else r["vec_id"], r["component"] - 1
        assert r["n"] == 500 and int(r["deviation"]) == deviation[i] and r["identity_error"] <= 1e-10
        assert abs(abs(r["whitened"]) - whitened[i, k]) < 1e-8 and abs(r["explained"] - explained[k]) < 1e-12
    signs = {(r["component"]): 0 for r in rows}
    assert sorted(signs) == list(range(1, 33))
    table = np.zeros((500, 32))
    for r in rows:
        table[7 if r["vec_id"] is None else r["vec_id"], r["component"] - 1] = r["whitened"]
    np.testing.assert_allclose(table.T @ table / 500, np.eye(32), atol=1e-9)


def test_whitening_of_few_equal_and_large_entries(spark):
    make = lambda vectors: spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    assert whitening.whiten(make([]).limit(0)).count() == 0
    assert whitening.whiten(make([[1.0, 2.0]] * 4)).count() == 0
    assert whitening.whiten(make([[1.0, 2.0]])).count() == 0
    flat = whitening.whiten(make([[0.0, 5.0], [1.0, 5.0], [3.0, 5.0]])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 3 and abs(sum(r["whitened"] ** 2 for r in flat) - 3) < 1e-12
    big = [[2.0**50, 0.0], [-(2.0**50), 1.0], [0.0, 2.0]]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(make(big)).where("component = 1").collect()}
    x = [[int(64 * c) + 1_000_000 for c in v] for v in big]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}

"""Hard cases of the training-data operators: whole numbers beside nulls, adversarial texts, recall at the threshold, brute force."""

import collections
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import common, decontamination, embedding_dedup, html, language_model, ngram_join, packing, quality, secrets, sharding, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BIG = [2**53 + 1, 2**53 + 3, None]
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen"


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, tiny):
    return spark.read.parquet(f"{tiny}/labels.parquet")


def named(spark, ids, texts):
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").coalesce(1)


def test_ids_beside_nulls_stay_whole(spark, tiny, docs, labels):
    df = named(spark, BIG, [TEXT] * 3)
    bench = spark.createDataFrame([(2**53 + 1, TEXT), (None, TEXT + " more")], "item_id long, text string").coalesce(1)
    chain = toxicity.train_chain(docs, toxicity.label_categories(labels), toxicity.CATEGORIES)
    voters = quality.train_voters(docs, labels)
    model = language_model.train(df)
    found = {
        "join": common.stash(ngram_join.jaccard_links(df), "links"),
        "shards": sharding.document_shards(df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")}), 2),
        "pack": packing.pack_documents(df, WORD_BPE),
        "secrets": secrets.digest(secrets.scan_secrets(df, RANKS, public_tokenizers.PATTERN)),
        "toxicity": toxicity.score(df, chain),
        "quality": quality.score(df, voters),
        "model": language_model.score(df, model),
    }
    for name, got in found.items():
        assert {r["doc_id"] for r in got.collect()} == set(BIG), name
    assert [r["n_links"] for r in found["join"].collect()] == [2, 2, 2]
    assert {r["doc_id"]: (r["class_id"], r["kept"]) for r in found["join"].collect()} == {BIG[0]: (BIG[0], True), BIG[1]: (BIG[0], False), None: (BIG[0], True)}
    assert {r["doc_id"] for r in ngram_join.one_of_each(df, found["join"]).collect()} == {BIG[0], None}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, bench).collect()}
    assert got == {(d, i) for d in BIG for i in (2**53 + 1, None)}
    assert decontamination.keep_clean(df, bench).count() == 0
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert {(r["page_id"], r["text"]) for r in html.extract(pages).collect()} == {(i, TEXT) for i in BIG}
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in BIG], "vec_id long, embedding array<double>").coalesce(1)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.cosine_links(vectors).collect()}
    assert got == dict.fromkeys(BIG, (2, BIG[0]))
    for stage in (lambda d: toxicity.keep_clean(d, chain), lambda d: decontamination.keep_clean(d, bench.limit(0)), lambda d: secrets.redacted_documents(d, RANKS, public_tokenizers.PATTERN)):
        assert {r["doc_id"] for r in stage(df).collect()} == set(BIG)


def test_a_doc_id_that_stands_twice(spark):
    other = " ".join(f"other{k}" for k in range(20))
    df = named(spark, [3, 7, 7, 7, 9], [TEXT, TEXT, other, other, other])
    links = common.stash(ngram_join.jaccard_links(df), "links")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in links.collect())
    assert got == [(3, 3, 1), (7, 3, 1), (7, 7, 2), (7, 7, 2), (9, 7, 2)]
    kept = ngram_join.one_of_each(df, links).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 7, 7, 7]


def test_session_settings_stay(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    secrets.scan_secrets(docs, RANKS, public_tokenizers.PATTERN).count()
    assert spark.conf.get(key) == before


# ---------------------------------------------------------------- secrets


def slow_identifier(word):
    """The rule read off a backtracking pattern, for words of few pieces."""
    return re.fullmatch(r"[0-9+/_=-]+|[+/_=-]*(?:(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,8})[+/_=-]+)*(?:[A-Za-z]?[a-z]+|[A-Z]+)?[0-9]{0,8}[+/_=-]*", word) is not None


def test_identifiers():
    rng = np.random.default_rng(3)
    letters = np.array(list("aB9_-"))
    for _ in range(3000):
        word = "".join(rng.choice(letters, int(rng.integers(1, 12))))
        assert secrets.identifier(word) == slow_identifier(word), word
    began = time.perf_counter()
    assert not secrets.identifier("ab-" * 60 + "a1b2") and secrets.identifier("ab-" * 100_000 + "a1")
    assert time.perf_counter() - began < 2


def test_long_and_crowded_texts_are_scanned(spark):
    texts = ["ab-" * 60 + "a1b2", "ab-" * 100_000, "token=abcdef " * 20_000 + "x9Kq2Lm8Zr4Tv1Wp7Yn3Bc6D", "aB3" * 100_000, "token " * 50_000, "a" * 300_000]
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in secrets.scan_secrets(named(spark, range(len(texts)), texts), RANKS, public_tokenizers.PATTERN).collect()}
    assert time.perf_counter() - began < 60
    assert len(got[2]["spans"].split(",")) == 20_001 and got[2]["spans"].endswith("dense:260000:260024") and got[1]["spans"] == ""


def test_dense_spans_by_brute_force(spark, docs):
    test = secrets.Efficiency(RANKS, public_tokenizers.PATTERN)
    extra = ["x9Kq2Lm8Zr4Tv1Wp7Yn3Bc6D and token=x9Kq2Lm8Zr4Tv1Wp7Yn3Bc6D", "550e8400-e29b-41d4-a716-446655440000 SOME_NAME_OF_A_THING_2024 some-slug-of-a-page-about-20-things"]
    df = docs.select("doc_id", "text").union(named(spark, [10**6, 10**6 + 1], extra))
    alphabet = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    n = 0
    for r in secrets.scan_secrets(df, RANKS, public_tokenizers.PATTERN).join(df, "doc_id").collect():
        text, want, at = r["text"] or "", [], 0
        base = [tuple(map(int, x.split(":")[1:])) for x in r["base"].split(",") if x]
        while at < len(text):
            end = at
            while end < len(text) and text[end] in alphabet:
                end += 1
            word = text[at:end]
            if len(word) >= 20 and not any(s < end and at < e for s, e in base) and not secrets.DIGEST.match(word):
                poor = lambda w: len(w) / len(test.encoding.encode_ordinary(w)) < 2
                readable = slow_identifier(word) and not any(len(p) >= 16 and poor(p) for p in re.split("[^A-Za-z]+", word) if p)
                if not readable and poor(word):
                    want.append(f"dense:{at}:{end}")
            at = end + 1
        assert [x for x in r["spans"].split(",") if x.startswith("dense")] == want
        n += len(want)
    assert n > 0


def test_recall_and_false_positives_by_alphabet():
    """Random strings of any alphabet are found, most at 20 characters and nearly all from 32 on; long words and names are not."""
    test, rng = secrets.Efficiency(RANKS, public_tokenizers.PATTERN), np.random.default_rng(6)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for alphabet in (lower, upper, lower + upper, lower + digits, lower + upper + digits, upper + "234567", digits + "ABCDEF", lower + upper + digits + "+/", lower + upper + digits + "-_"):
        for n, least in ((20, 0.87), (30, 0.93), (44, 0.95)):
            found = sum(test.random("".join(rng.choice(list(alphabet), n))) for _ in range(400))
            assert found >= least * 400, (alphabet, n, found)
    words = (
        "Donaudampfschifffahrtsgesellschaft Rechtsschutzversicherungsgesellschaften Kraftfahrzeughaftpflichtversicherung Geschwindigkeitsbegrenzung "
        "Betriebswirtschaftslehre Wirtschaftswissenschaften anticonstitutionnellement intergouvernementalisation otorrinolaringologista electroencefalografista "
        "internacionalizaciones contrarrevolucionarios incomprehensibilities counterrevolutionaries deinstitutionalization Lebensversicherungsgesellschaftsangestellter "
        "getElementsByTagNameNS SQL_GROUPED_MAP_PANDAS_UDF MEMORY_DEL_SUBCOMMAND_NAME contrib/slapd-modules/nssov/nss-pam-ldapd/nslcd _no_init_or_replace_init "
        "simd/arm/jidctred-neon com/giampaolo/psutil/issues/1179 2024-01-31-12-30-00-000000 ==================== some-slug-of-a-page-about-20-things"
    ).split()
    assert [w for w in words if len(w) >= 20 and test.random(w)] == []
    assert test.random("token-list-qzxwvkjhgpqtrsmnbvcx") and not test.random("D41D8CD98F00B204E9800998ECF8427E")


def test_redaction_without_n_chars(spark):
    df = named(spark, [1, 2, None], ["token=abcdef x", None, ""]).withColumn("_masked", F.lit(5))
    got = secrets.redacted_documents(df, RANKS, public_tokenizers.PATTERN)
    assert got.columns == df.columns and {r["doc_id"]: r["text"] for r in got.collect()} == {1: f"{secrets.MARK} x", 2: None, None: ""}


# ---------------------------------------------------------------- decontamination


def any_stretch(same):
    """Whether some stretch agrees in 11 places or more, four in five of its own."""
    agree = np.r_[0, np.cumsum(same)]
    n = len(same)
    return any(agree[b] - agree[a] >= min(11, n) and 5 * (agree[b] - agree[a]) >= 4 * (b - a) for a in range(n) for b in range(a + 1, n + 1))


def test_recall_of_short_and_changed_passages(spark):
    """Two-sided, against every stretch: nothing is found that isn't an overlap, and the seeds miss few of the shortest."""
    rng = np.random.default_rng(5)
    shapes = [(14, 2), (14, 3), (15, 3), (20, 4), (25, 5), (40, 8), (60, 12), (15, 6), (25, 12)]
    texts, items, want = [], [], {}
    for k in range(900):
        n, changed = shapes[k % len(shapes)]
        words = [f"i{k}w{j}" for j in range(n)]
        said = words.copy()
        for j in rng.choice(n, changed, replace=False):
            said[j] = f"other{k}x{j}"
        items.append((k, " ".join(words)))
        texts.append(f"before {k} " + " ".join(said) + " after it")
        want[k] = any_stretch(np.array([a == b for a, b in zip(words, said, strict=True)]))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(named(spark, range(900), texts), spark.createDataFrame(items, "item_id long, text string"), 10_000).collect()}
    assert all(d == i and want[d] for d, i in found)
    share = collections.defaultdict(list)
    for k, w in want.items():
        if w:
            share[shapes[k % len(shapes)]].append((k, k) in found)
    print({k: (len(v), np.mean(v)) for k, v in share.items()})
    assert all(np.mean(v) >= 0.9 for v in share.values()) and np.mean([x for v in share.values() for x in v]) > 0.97


def test_repeated_words_end_soon(spark):
    said = "the " * 20_000
    pair = "a b " * 5_000
    docs = named(spark, range(4), [said, said + "end", pair, "c " * 30 + pair])
    bench = spark.createDataFrame([(1, "the " * 4_000), (2, pair), (3, None), (4, ""), (None, "b a " * 10)], "item_id long, text string")
    began = time.perf_counter()
    got = {(r["doc_id"], r["item_id"]): r["agree"] for r in decontamination.find_leaks(docs, bench).collect()}
    assert time.perf_counter() - began < 90
    assert got == {(0, 1): 4000, (1, 1): 4000, (2, 2): 10_000, (3, 2): 10_000, (2, None): 20, (3, None): 20}
    assert decontamination.keep_clean(docs, bench).count() == 0


def test_differences_of_places():
    rng = np.random.default_rng(1)
    p, q = np.sort(rng.choice(9000, 2000, replace=False)), np.sort(rng.choice(5000, 1500, replace=False))
    assert decontamination.differences(p, q).tolist() == np.unique(p[:, None] - q[None, :]).tolist()


# ---------------------------------------------------------------- pages


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "x" + "</i>" * 100_000, "<div>" * 50_000 + "<i>" + "<b>" * 50_000 + "</div></i>" * 50_000, "<header>" * 50_000 + "y", "<li>" * 100_000, "<p><a>" * 50_000, "<!--" * 50_000, "<" * 100_000, "</" * 50_000, "&" * 100_000, "<a b='" * 20_000])
def test_bad_markup_is_read_in_linear_time(page):
    began = time.perf_counter()
    html.main_text(page, lambda h: False)
    assert time.perf_counter() - began < 15


def test_an_article_keeps_what_only_sounds_like_furniture():
    page = (
        "<body><div class='search'>find</div><article><h1>H</h1><section class='related-work'><p>kept one</p></section><div id='search-algorithms'>kept two</div>"
        "<div class='form-of-life'>kept three</div><div class='related-posts'>gone</div><div class='share'>gone</div><div class='notice box'>gone</div>"
        "<div class='ad-slot-top'>gone</div><div class='comments-list'>gone</div><div class='cookie-notice'>gone</div></article></body>"
    )
    assert html.main_text(page, lambda h: False) == "H kept one kept two kept three"


def test_templates_by_brute_force(spark):
    """Counts of subtrees by host, in and outside articles, against plain counting; few of many pages may share a table."""
    pages = []
    for i in range(1200):
        table = "<table><tr><td>shared by six</td></tr></table>" if i < 6 else ""
        box = f"<ul><li>box of section {i % 3}</li></ul>" if i % 4 else ""
        pages.append((i, "http://big.example/p", f"<article><h1>Head {i}</h1><p>text {i}</p>{table}{box}</article><div class=x>all {i % 100}</div>"))
    pages += [(5000 + i, "http://small.example/p", f"<article><h1>Head {i}</h1><p>text {i}</p>{'<table><tr><td>shared by six</td></tr></table>' if i < 6 else ''}</article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(1200):
        assert got[i] == f"Head {i} text {i}" + (" shared by six" if i < 6 else "")
    assert got[5003] == "Head 3 text 3"


# ---------------------------------------------------------------- embeddings


def brute_components(x, threshold=0.9):
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(1))
        if (new == comp).all():
            return link.sum(1), comp
        comp = new


def test_clusters_are_split_and_copies_stay_few(spark):
    rng = np.random.default_rng(8)
    shares = {}
    for n in (4000, 12000):
        centres = rng.standard_normal((n // 100, 64))
        x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        units = embedding_dedup.unit_vectors(df).select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("size"), "vec")
        shares[n] = embedding_dedup.cell_pairs(common.stash(units, "units"), 0.9).count() / n
        if n == 4000:
            got = {r["vec_id"]: r for r in embedding_dedup.cosine_links(df).collect()}
            links, comp = brute_components(x)
            assert [got[i]["n_links"] for i in range(n)] == links.tolist() and [got[i]["component_id"] for i in range(n)] == comp.tolist()
    assert shares[12000] <= 1.5 * shares[4000] + 1


def test_nested_cells_and_mixed_lengths(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SMALL", 100)
    monkeypatch.setattr(embedding_dedup, "CELLS", 3)
    rng = np.random.default_rng(9)
    centres = np.repeat(rng.standard_normal((30, 16)), 20, 0) + 0.5 * rng.standard_normal((600, 16))
    x = centres[rng.integers(0, 600, 1500)] + 0.1 * rng.standard_normal((1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(9000, [1.0, 2.0]), (9001, [2.0, 4.0]), (9002, [-1.0])]
    got = {r["vec_id"]: r for r in embedding_dedup.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links, comp = brute_components(x)
    assert [got[i]["n_links"] for i in range(1500)] == links.tolist() and [got[i]["component_id"] for i in range(1500)] == comp.tolist()
    assert [got[i]["n_links"] for i in (9000, 9001, 9002)] == [1, 1, 0]


# ---------------------------------------------------------------- Jaccard join


def test_recall_at_the_threshold(spark):
    """Pairs of 0.80 to 0.82, of equal and of unequal sizes, alone and among many that share a passage."""
    rng = np.random.default_rng(4)
    passage = [f"p{j}" for j in range(34)]
    texts, exact = [], []
    for k in range(700):
        words = [f"k{k}w{j}" for j in range(104)] + (passage if k % 2 else [])
        n = len(words) - 4
        other = words.copy()
        if k % 3:
            for j in rng.choice(len(words) // 6, 2, replace=False):  # two changes far apart break ten shingles
                other[int(j) * 6] = f"c{k}x{j}"
        else:
            other += [f"more{k}x{j}" for j in range(int(n * 0.24))]
        texts += [" ".join(words), " ".join(other)]
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (words, other))
        exact.append(len(a & b) / len(a | b))
    assert all(e >= 0.8 for e in exact) and min(exact) < 0.82
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_links(named(spark, range(len(texts)), texts)).collect()}
    assert np.mean([got[2 * k] == 1 and got[2 * k + 1] == 1 for k in range(700)]) >= 0.999


def test_deeper_buckets_and_dense_groups(spark, monkeypatch):
    """Small buckets force the tree down; shared passages part, groups of near copies are compared whole, and all links are there."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(3):
        passage = rng.integers(0, 10**6, 60)
        for _ in range(40):
            own = rng.integers(0, 10**6, 90)
            for _ in range(2):
                own = own.copy()
                own[rng.integers(0, 90, 4)] = rng.integers(0, 10**6, 4)
                sets.append(frozenset(map(int, [*passage, *own])))
    group = rng.integers(0, 10**6, 100)
    for _ in range(120):
        one = group.copy()
        one[rng.integers(0, 100, 4)] = rng.integers(0, 10**6, 4)
        sets.append(frozenset(map(int, one)))
    df = named(spark, range(len(sets)), [" ".join(f"w{x}" for x in sorted(s)) for s in sets])
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_links(df, width=1).collect()}
    want = [sum(i != j and 10 * len(a & b) >= 8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert all(got[i] <= w for i, w in enumerate(want)) and sum(got.values()) >= 0.999 * sum(want) > 1000


def test_bounds_of_the_join():
    assert ngram_join.runs_for(0.9999) < 12 and 0.3 < ngram_join.dies_out() < 0.4
    d = ngram_join.differ_for(0.8)
    tail = sum(math.comb(64, k) * 0.15**k * 0.85 ** (64 - k) for k in range(d + 1, 65))
    assert tail <= 1e-8 < tail + math.comb(64, d) * 0.15**d * 0.85 ** (64 - d)


# ---------------------------------------------------------------- classifiers


def test_chain_by_brute_force(spark, docs, labels):
    """The chain that tasks fit, against dense matrices and plain loops over folds."""
    chain = toxicity.train_chain(docs, toxicity.label_categories(labels), toxicity.CATEGORIES, width=60)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: (1 - r["quality"], r["toxic"]) for r in labels.collect() if r["doc_id"] in texts}
    ids = sorted(known)
    x = np.zeros((len(ids), len(chain.index)))
    for i, d in enumerate(ids):
        x[i, [chain.index[t] for t in toxicity.terms(texts[d]) if t in chain.index]] = 1
    fold = np.array([hash(d) * 2654435761 % 2**32 % toxicity.FOLDS for d in ids])

    def fit(x, dense, y):
        n = len(y)
        rate = np.clip(y.mean(), 1 / (n + 2), 1 - 1 / (n + 2))
        z = np.concatenate([np.zeros(x.shape[1] + dense.shape[1]), [np.log(rate / (1 - rate))]])
        if y.min() == y.max():
            return z
        full = np.column_stack([x, dense, np.ones(n)])
        bound = np.concatenate([0.25 * x.sum(0) + 1, 0.25 * (dense**2).sum(0) + 1, [0.25 * n]])
        ridge = np.concatenate([np.ones(len(z) - 1), [0]])
        m, step = np.zeros(len(z)), 4 / (1 + x.sum(1).mean() + dense.shape[1])
        for _ in range(150):
            p = 1 / (1 + np.exp(-np.clip(full @ z, -30, 30)))
            m = 0.9 * m + (full.T @ (p - y) + ridge * z) / bound
            z = z - step * m
        return z

    def predict(z, x, dense):
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, dense, np.ones(len(x))]) @ z, -30, 30)))

    earlier, whole = np.zeros((len(ids), 0)), []
    for k in range(2):
        y, out = np.array([known[d][k] for d in ids], float), np.zeros(len(ids))
        for f in range(toxicity.FOLDS):
            out[fold == f] = predict(fit(x[fold != f], earlier[fold != f], y[fold != f]), x[fold == f], earlier[fold == f])
        whole.append(fit(x, earlier, y))
        earlier = np.column_stack([earlier, out])
    said = np.zeros((len(ids), 0))
    for z in whole:
        said = np.column_stack([said, predict(z, x, said)])
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in toxicity.score(docs, chain).collect()}
    assert np.allclose([got[d] for d in ids], said, atol=1e-6)
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, chain).collect()}
    assert kept == {d for d, p in got.items() if p[1] < toxicity.REJECT}


def test_votes_by_brute_force(spark, docs, labels):
    """All documents, by a full singular value decomposition of a dense matrix and sorting of all voters."""
    voters = quality.train_voters(docs, labels, rank=12)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in texts}
    columns, width = quality.Columns(), quality.WORDS + quality.FORMS

    def dense(ids, idf=None):
        x = np.zeros((len(ids), width))
        for i, d in enumerate(ids):
            c, v = quality.term_counts(texts[d], columns)
            x[i, c] = v
        if idf is not None:
            x *= idf
            for part in (slice(0, quality.WORDS), slice(quality.WORDS, None)):
                norm = np.linalg.norm(x[:, part], axis=1, keepdims=True)
                x[:, part] = np.divide(x[:, part], norm, out=np.zeros_like(x[:, part]), where=norm > 0)
        return x

    ids = sorted(known)
    idf = np.log((1 + len(ids)) / (1 + (dense(ids) > 0).sum(0))) + 0.1
    train, every = dense(ids, idf), dense(sorted(texts), idf)
    best = np.linalg.svd(train, full_matrices=False)[2][:12].T
    assert np.linalg.norm(train @ voters.space.basis) >= 0.999 * np.linalg.norm(train @ best)  # the latent space is the leading one
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    sims = unit(every @ voters.space.basis) @ unit(train @ voters.space.basis).T
    y = np.array([known[d] for d in ids], float)
    want = {}
    for d, row in zip(sorted(texts), sims, strict=True):
        near = np.argsort(-row)[: quality.NEIGHBOURS]
        w = np.maximum(row[near], 0) ** quality.SHARP
        want[d] = (w * y[near]).sum() / w.sum() if w.sum() else y.mean()
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, voters).collect()}
    off = np.array([abs(got[d] - want[d]) for d in texts])
    assert (off < 1e-4).mean() > 0.97  # of voters that are equally near, rounding lets in another


# ---------------------------------------------------------------- sharding, folders, pipeline


def test_bounds_are_exact_for_strings_that_differ_late(spark):
    same = "a-long-prefix-that-all-share/and-more/"
    values = [f"{same}{k:05d}" for k in range(1000)] + [same + "x"] * 200 + [None] * 100
    df = common.stash(spark.createDataFrame([(v, len(v or "") * 1.5) for v in values], "s string, x double"), "strings")
    bounds = sharding.quantile_bounds(df, ["s", "x"], 16, 20)
    have = sorted(v for v in values if v)
    below = {v: 100 + sum(w < v for w in have) for v in set(have)}
    want = {}
    for v in sorted(below):
        want.setdefault(below[v] * 16 // len(values), v)
    assert sorted(bounds["s"]) == sorted(v for b, v in want.items() if b > 0)
    assert len(bounds["s"]) == 13


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_files_of_a_store_that_is_not_mounted(tmp_path):
    common.write_arrays(str(tmp_path), "a", np.arange(5), np.arange(3.0))
    files = common.Files(str(tmp_path))
    assert files["a"][:40].view("<i8").tolist() == [0, 1, 2, 3, 4] and len(files["a"]) == 64


def test_stages_keep_odd_rows(spark, tiny):
    odd = [None, "", "clean and short", TEXT, TEXT, "word " * 20_000]
    df = spark.createDataFrame([(i if i != 2 else None, t, None, "s", None) for i, t in enumerate(odd)], spark.read.parquet(f"{tiny}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (df, df.limit(0)):
            got = stage(spark, rows, tiny)
            n = got.count()
            assert got.columns == df.columns and (n == 0 if rows is not df else n >= 5), name

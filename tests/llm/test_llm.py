"""The training-data operators against brute force, and on odd rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldloom.llm import bpe, components, exact_dedup, lm_scoring, ngram_join, packing, quality, rp_forest, token_counts, toxicity, url_filter
from fieldloom.llm import queries as llm_queries
from fieldloom.llm.common import Membership, cleared, hot_join, hot_keys, stored

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD_SCHEMA = "doc_id long, text string, lang string, n_tokens int, node string, key string, kept string, toxic string, grams string, text_sha256 string, row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, and columns with names that operators use."""
    long = " ".join(f"w{k % 700} the" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two  three four five six"), (4, "one two  three four five six"), (5, "one two\tthree four five six"), (6, long), (7, "x" * 200_000), (None, "no id at all here"), (8, "漢字 😀 <|endoftext|> \x00 ü")]
    return stored(spark.createDataFrame([(i, t, "en", 1, "n", "k", "y", "z", "g", "h", "r") for i, t in rows], ODD_SCHEMA), "odd")


@pytest.fixture(scope="session")
def empty(spark):
    return stored(spark.createDataFrame([], ODD_SCHEMA), "empty")


@pytest.fixture(scope="session")
def labels(spark):
    return stored(spark.createDataFrame([(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(200)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int"), "labels")


@pytest.fixture(scope="session")
def corpus(spark):
    """200 documents: each fourth is junk, each fifth is toxic, and some are copies and near copies."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeinorst") for _ in range(r.randint(2, 7))) for _ in range(600)]
    rows = []
    for k in range(200):
        words = [r.choice(vocabulary) for _ in range(r.randint(30, 120))]
        if k % 4 == 0:
            words = [w.upper() + "!!" for w in words]
        elif k % 5 == 0:
            words.insert(5, r.choice(("idiot", "scum", "pathetic")))
        rows.append((k, " ".join(words)))
    base = rows[1][1].split()
    for k in range(200, 230):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((k, " ".join(words)))
    rows += [(230, rows[2][1]), (231, rows[2][1].replace(" ", "\n\t", 3))]
    return stored(spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "corpus")


def test_bpe_equals_the_library(spark, odd, corpus, empty):
    v = bpe.Vocabulary.read(RANKS)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    for df in (odd, corpus):
        got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, RANKS, P.PATTERN).collect())
        want = collections.Counter()
        for r in df.collect():
            ids = lib.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert got == want
    assert bpe.digests(empty, RANKS, P.PATTERN).count() == 0
    assert bpe.encode(odd.where("doc_id = 8"), RANKS, P.PATTERN).first().ids == lib.encode_ordinary(odd.where("doc_id = 8").first().text)


def test_bpe_appends_and_edits():
    v, r = bpe.Vocabulary.read(RANKS), random.Random(1)
    plain = lambda raw: [v.ranks[p] for p in bpe.merged(raw, v.ranks)]
    for _ in range(300):
        raw = bytes(r.choice(b"aeiothns \xc3\xa9") for _ in range(r.randint(0, 120)))
        t = bpe.PrefixTable(v, raw[:50])
        t.append(raw[50:])
        assert t.ids() == plain(raw)
        i = r.randint(0, len(raw))
        j, by = r.randint(i, len(raw)), bytes(r.choice(b"aeioth") for _ in range(r.randint(0, 5)))
        t.replace(i, j, by)
        assert t.piece == raw[:i] + by + raw[j:] and t.ids() == plain(t.piece)
    t = bpe.PrefixTable(v, b"the quick brown fox " * 500)
    assert t.replace(100, 101, b"z") < 500  # only near the edit


def test_token_counts_and_their_cache(spark, odd, corpus, empty):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    cache = token_counts.CountCache(spark, "counts_test", buckets=4)
    for df in (odd, corpus, corpus, empty):
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in cache.count(df, path, P.PATTERN).collect())
        n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got == sorted((r.doc_id or -1, len((r.text or "").encode()), n(r.text), n(r.text) > 512) for r in df.collect())
    stored_rows = spark.table("counts_test")
    assert stored_rows.count() == stored_rows.select("content", "tokenizer").distinct().count() == odd.union(odd.limit(0)).select(F.coalesce("text", F.lit(""))).distinct().count() + corpus.select("text").distinct().count()
    model = P.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    small = corpus.limit(5)
    assert sorted(r.n_tokens for r in cache.count(small, model).collect()) == sorted(len(sp.encode(r.text)) for r in small.collect())


def test_exact_dedup_and_its_index(spark, odd, corpus, empty):
    index = exact_dedup.DigestIndex(spark, "digests_test", buckets=4)
    normal = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    rows = corpus.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in index.deduplicate(corpus).collect()}
    assert got == {r.doc_id: (min(g), len(g), min(g) == r.doc_id, hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in rows for g in [groups[normal(r.text)]]}
    again = corpus.withColumn("doc_id", F.col("doc_id") + 1000)
    assert index.deduplicate(again).where("kept").count() == 0 and index.deduplicate(empty).count() == 0
    assert spark.table("digests_test").count() == len(groups)
    plan = corpus.sparkSession.table("digests_test").join(spark.table("digests_test").hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    o = exact_dedup.DigestIndex(spark, "digests_odd")
    kept = o.deduplicate(odd)
    assert sorted(r.doc_id or -1 for r in kept.where("kept").collect()) == [-1, 1, 3, 4, 6, 7, 8] and kept.count() == odd.count()
    nameless = exact_dedup.DigestIndex(spark, "digests_nameless")
    once = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [r.kept for r in nameless.deduplicate(once).collect()] == [True]
    assert not any(r.kept for r in nameless.deduplicate(once.unionByName(spark.createDataFrame([(7, "a  b")], once.schema))).collect())
    assert sorted(r.doc_id or -1 for r in exact_dedup.kept_rows(odd, exact_dedup.DigestIndex(spark, "digests_rows")).collect()) == [-1, 1, 3, 4, 6, 7, 8]


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent", "part"), [(4, 85, 100_000), (5, 80, 100_000), (4, 85, 3), (2, 40, 2)])
def test_ngram_join_equals_brute_force(spark, corpus, monkeypatch, width, percent, part):
    monkeypatch.setattr(ngram_join, "PART", part)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(corpus, width, percent).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in corpus.collect()], width, percent)


def test_ngram_join_on_odd_rows(spark, odd, empty):
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.join(odd, 4, 85).collect())
    assert got == [(-1, -1), (1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)]
    assert ngram_join.join(empty, 4, 85).count() == 0
    assert {r.doc_id for r in ngram_join.one_of_each(odd).collect()} == {None, 1, 2, 3, 4, 6, 7, 8}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {k: 10 for k in range(10, 61)} | {k: 100 for k in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_finds_what_brute_force_finds(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 16))
    x[:300] = x[0] + 0.05 * r.standard_normal((300, 16))
    x[300:303] = x[1000]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] + [1.0] * 15, 0), (2004, [], 0), (2005, [float("inf")] * 16, 0), (2006, x[5].tolist()[:8], 1), (None, x[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"rep": F.lit("x"), "key": F.lit(1), "unit": F.lit(2), "node": F.lit(None)})
    got = {q.vec_id: q for q in rp_forest.near_duplicates(df, leaf=100).collect()}
    assert len(got) == 1507
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[k].n_links for k in range(1500))
    assert 0.99 * near.sum() <= found <= near.sum() and all(got[k].n_links <= near[k].sum() for k in range(1500))
    assert all(got[k].component_id == 0 for k in range(300)) and got[301].component_id == 300 and got[1000].component_id == 300
    assert all(got[k].n_links == 0 and got[k].kept for k in range(2000, 2007))
    assert rp_forest.near_duplicates(df.limit(0)).count() == 0


def test_forest_counts_a_pair_once_in_blocks(spark):
    """One leaf that cannot be split: every pair is compared, in blocks."""
    r = np.random.default_rng(1)
    x = 1 + 1e-3 * r.standard_normal((60, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = rp_forest.near_duplicates(df, leaf=100).collect()
    assert [q.n_links for q in got] == [59] * 60
    members = rp_forest.near_duplicates(df, leaf=5, trees=40).collect()
    assert all(q.n_links <= 59 and q.component_id == 0 for q in members)


def test_forest_keeps_the_links_of_a_dense_group(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal(64) + 0.31 * r.standard_normal((6000, 64))
    x[5000:] = r.standard_normal((1000, 64))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {q.vec_id: q.n_links for q in rp_forest.near_duplicates(df).collect()}
    assert all(got[k] <= near[k].sum() for k in range(6000))
    assert sum(got.values()) >= 0.98 * near.sum() > 1_000_000


def test_url_rules_and_spread(spark):
    pages = [
        (1, "HTTP://A.example.com/en/5?x", '<a href="http://good.example.net/x"><a href=\'//bad.example.org/\'>'), (2, "http://b.example.com/en/77", '<a href="https://good.example.net/">'), (3, "ftp://good.example.net", None),
        (4, "http://far.example.edu/x", '<a href="http://A.example.com/">'), (5, None, ""), (6, "no scheme", "<a href=>"), (7, "http://x.example.net/de/8/1", ""), (8, "http://com/en/", ""), (9, "http://xcom/en/", ""),
    ]
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}
    assert got[1] == ("a.example.com", "/en/5", "com/en/", "block") and got[2] == ("b.example.com", "/en/77", "example.com/en/7", "allow")
    assert got[3] == ("good.example.net", "", None, "allow")  # trusted by b
    assert got[4] == ("far.example.edu", "/x", None, "block")  # links to a blocked host
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("example.net/de/8", "allow") and got[8][2:] == ("com/en/", "block") and got[9][2:] == (None, "allow")
    assert url_filter.judge(df.limit(0), rules).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    rows = [(1, "http://a.com/en/1", "block"), (2, "http://www.example.com/en/77", "allow"), (3, "http://net/de/8", "allow"), (4, "http://www.example.net/de/1", "allow"), (5, "http://WWW.Example.net/de/88?q", "block"), (6, "http://b.org/es/#x", "block")]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").selectExpr("*", "string(null) AS html")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, llm_queries.RULES).collect()} == {r[0]: r[2] for r in rows}


def test_url_distrust_reaches_far_and_faint(spark):
    name = lambda k: f"http://h{k}.example.edu/"
    link = lambda to: f'<a href="{to}">'
    pages = [(0, "http://com/en/", ""), (1, name(1), link("http://com/en/"))] + [(k, name(k), link(name(k - 1))) for k in range(2, 13)]
    pages += [(1000 + 10 * k + j, f"http://f{k}x{j}.example.edu/", link(name(k))) for k in range(1, 12) for j in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(df, [("block", "com/en/")]).collect()}
    assert all(r.verdict == "block" for r in got.values())
    assert got[12].distrust == 0 and abs(got[1].distrust - 0.15 * 0.85) < 1e-9


def test_quality_keeps_good_and_drops_bad(spark, corpus, odd, empty, labels):
    kept = {r.doc_id for r in quality.resample(corpus, labels).where("kept").collect()}
    junk = {k for k in range(200) if k % 4 == 0}
    assert len(kept & junk) <= 2 and len(set(range(232)) - junk - kept) <= 4
    assert {r.doc_id for r in quality.kept_rows(corpus, labels).collect()} == kept
    assert quality.resample(odd, labels).count() == odd.count() and quality.resample(empty, labels).count() == 0
    assert quality.resample(odd, labels.limit(0)).where("kept").count() == odd.count()
    assert quality.kept_rows(odd, labels.limit(0)).count() == odd.count() and quality.kept_rows(empty, labels).columns == empty.columns


def test_quality_by_brute_force(spark, corpus, labels):
    got, ratios, least = quality.decided(corpus, labels)
    label = {k: int(k % 4 != 0) for k in range(200)}
    held = {d for d in label if quality.xxhash.xxh3_64_intdigest(str(d).encode()) % quality.FOLDS == 0}
    texts, g = {r.doc_id: r.text for r in corpus.collect()}, quality.Grams()
    raw, target = collections.Counter(), collections.Counter()
    for d, t in texts.items():
        raw.update(g.of(t).tolist())
        if label.get(d) and d not in held:
            target.update(g.of(t).tolist())
    n, m = sum(raw.values()), sum(target.values())
    more = max(0.5, quality.SMOOTH * m)
    rows = {r.doc_id: r for r in got.collect()}
    for d, t in texts.items():
        found = g.of(t).tolist()
        want = sum(math.log((target[b] + more) / (raw[b] * m / n + more)) for b in found) / len(found)
        assert abs(rows[d].log_weight - want) < 1e-9
    cut = quality.best_threshold([(rows[d].log_weight, label[d]) for d in held])
    k = sum(r.log_weight > cut for r in rows.values())
    assert least == sorted((r.gumbel_key for r in rows.values()), reverse=True)[k - 1]


def test_kth_largest(spark):
    r = random.Random(2)
    values = [r.choice((r.gauss(0, 1), 0.5)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 250, 499, 500):
        assert quality.kth_largest(df, "x", k, parts=16) == sorted(values)[-k]


def test_toxicity_chain(spark, corpus, odd, empty, labels):
    chain = toxicity.fit(corpus, spark.createDataFrame([(k, int(k % 5 == 0 and k % 4 != 0)) for k in range(200)], "doc_id long, toxic int"))
    got = {r.doc_id for r in toxicity.score(corpus, chain).where("toxic").collect()}
    assert got == {k for k in range(200) if k % 5 == 0 and k % 4 != 0}
    assert {r.doc_id for r in toxicity.clean_rows(corpus, chain).collect()} == set(range(232)) - got
    assert toxicity.score(odd, chain).count() == odd.count() and toxicity.score(empty, chain).count() == 0
    assert toxicity.clean_rows(odd, chain).columns == odd.columns
    none = toxicity.fit(corpus, labels.limit(0))
    assert none is None and toxicity.score(odd, none).where("toxic").count() == 0
    assert chain.names == ("kind_1", "kind_2", "kind_3", "toxic") and "p_kind_1" in toxicity.score(corpus, chain).columns and len(chain.models) == 4
    given = toxicity.fit(corpus, spark.createDataFrame([(k, int(k % 5 == 0 and k % 4 != 0)) for k in range(200)], "doc_id long, toxic int"), categories={"insult": ("idiot",), "contempt": ("pathetic",)})
    assert given.names == ("insult", "contempt", "toxic")
    rows = {r.doc_id: r for r in toxicity.score(corpus, chain).collect()}
    for r in corpus.limit(40).collect():  # the chain by hand
        x, p = {chain.features[f] for w in toxicity.words(r.text) for f in toxicity.features_of(w) if f in chain.features}, []
        for w in chain.models:
            z = sum(w[c] for c in x) + sum(a * b for a, b in zip(p, w[len(chain.features) : -1], strict=True)) + w[-1]
            p.append(1 / (1 + math.exp(-z)))
        assert np.allclose(p, [rows[r.doc_id][f"p_{c}"] for c in chain.names]) and rows[r.doc_id].toxic == (p[-1] >= chain.threshold)


def test_packing_is_whole_and_fits(spark, corpus, odd, empty):
    for df in (corpus, odd):
        p = packing.pack(df, (64, 128, 256), shard_tokens=2000).toPandas()
        words = sum(len((r.text or "").encode().split()) for r in df.collect())
        assert p["size"].sum() == words
        for _, b in p.groupby("bin"):
            b = b.sort_values("offset")
            assert (b["offset"].to_numpy() == np.concatenate([[0], np.cumsum(b["size"])[:-1]])).all()
            used, length = b["size"].sum(), b["bin_length"].iloc[0]
            assert used <= length and length == min(x for x in (64, 128, 256) if x >= used) and (b["bin_used"] == used).all()
    assert packing.pack(empty).count() == 0
    r = random.Random(1)
    sizes = sorted((r.randint(1, 512) for _ in range(2000)), reverse=True)
    bins = {b: n for b, _, n in packing.Packer((512, 1024, 2048), 16.0).pack(sizes)}
    assert sum(sizes) / sum(bins.values()) > 0.97


def brute_packing(sizes, lengths, overhead):
    """Best fit, said plainly: the open bin that a piece leaves least room in, else a new one of the length that costs least a token with what may still come."""
    bins, out = [], []
    for k, size in enumerate(sizes):
        fitting = [b for b in bins if b["length"] - b["used"] >= size]
        if fitting:
            b = min(fitting, key=lambda b: (b["length"] - b["used"], b["number"]))
        else:
            costs = []
            for length in sorted(x for x in lengths if x >= size):
                small = sorted(s for s in sizes if s <= length - size)[: len(sizes) - k - 1]
                fill = min(sum(small), max(length - size - sum(small) / len(small) / 2, 0)) if small else 0
                costs.append(((length + overhead) / (size + fill), length))
            b = {"length": min(costs, key=lambda c: c[0])[1], "used": 0, "number": len(bins)}
            bins.append(b)
        out.append((b["number"], b["used"]))
        b["used"] += size
    return [(n, at, min(x for x in lengths if x >= bins[n]["used"])) for n, at in out]


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_brute_force(seed):
    r = random.Random(seed)
    lengths, overhead = ((64, 128, 256), 16.0) if seed % 2 else ((100, 150, 300, 301), 4.0)
    sizes = sorted((r.choice((1, 1, 7, 50, 64, r.randint(1, max(lengths)))) for _ in range(r.choice((1, 2, 40, 120)))), reverse=True)
    assert packing.Packer(lengths, overhead).pack(sizes) == brute_packing(sizes, lengths, overhead)
    assert packing.Packer(lengths, overhead).pack([]) == []


def test_a_hot_key_joins_as_any_other(spark):
    left = spark.createDataFrame([(1 if k % 2 else k, k) for k in range(400)] + [(None, 7), (None, 8)], "k long, v long")
    right = spark.createDataFrame([(k, -k) for k in range(0, 300, 3)] + [(1, -1)], "k long, w long")
    for how in ("inner", "left"):
        got = sorted((r.k or -9, r.v, r.w or 0) for r in hot_join(left, right, ["k"], ["v"], how, hot_keys(left, ["k"], share=5)).collect())
        assert got == sorted((r.k or -9, r.v, r.w or 0) for r in left.join(right, "k", how).collect())


def test_membership_lets_all_members_pass(spark):
    members = Membership(spark.range(0, 5000).select(F.xxhash64("id").alias("h")), "h")
    hashes = np.array([r.h for r in spark.range(20_000).select(F.xxhash64("id").alias("h")).collect()])
    passed = members.of(hashes)
    assert passed[:5000].all() and passed[5000:].mean() < 0.12
    assert not Membership(spark.range(0).select(F.xxhash64("id").alias("h")), "h").of(hashes).any()


def test_lm_scores(spark, corpus, odd, empty):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = {r.doc_id: r for r in lm_scoring.score(corpus, RANKS).collect()}
    c, held = collections.Counter(), {}
    for i, t in rows:
        held[i] = zlib.crc32(str(i).encode()) % 5 == 1
        if not held[i]:
            c.update([*t.encode().lower().split(), None])
    total = sum(c.values())
    for i, t in rows:
        tokens = [*t.encode().lower().split(), None]
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in tokens)
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[i], len(tokens), sum(c[w] > 0 for w in tokens), total)
        assert abs(g.base_score - base) < 1e-6 * abs(base) and g.score < 0
    assert lm_scoring.score(odd, RANKS).count() == odd.count() and lm_scoring.score(empty, RANKS).count() == 0


def test_lm_knows_the_end_whatever_its_rank(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TOP", 0)
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    known = {w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.encode().lower().split()}
    got = {r.doc_id: r.n_known for r in lm_scoring.score(corpus, RANKS).collect()}
    assert all(got[i] == 1 + sum(w in known for w in t.encode().lower().split()) for i, t in rows)


def test_lm_trains_on_every_token_once():
    for n in (1, 47, 64, 65, 112, 113, 1000):
        y = np.arange(n) % 64
        windows = lm_scoring.all_windows(y)
        assert (np.concatenate([w[w >= 0] for w in windows]) == y).all() and (windows[1:, :16] <= -2).all()
        assert all((-2 - b[:16] == np.where(a < -1, -2 - a, a)[48:]).all() for a, b in zip(windows, windows[1:]))


def test_lm_leads_are_first_ids_of_the_encoding(corpus):
    ranks = lm_scoring.ranks_of(RANKS)
    w = lm_scoring.Words(ranks, P.PATTERN, None)
    some = sorted({x for r in corpus.limit(50).collect() for x in r.text.encode().lower().split()})[:2000] + [b"x" * 50, b"don't", b"abc123", b"\xed\xa0\x80a", "\u00a0y".encode()]
    for x in some:
        if x.isalpha():
            assert w.lead(x) == ranks[bpe.merged(b" " + x, ranks)[0]]
        assert w.lead(x) >= 0
    spaced = some + ["\u00a0".encode(), "a\u2003".encode(), b"\x1c", "\u3000x".encode(), b"7a!!b"]
    assert w.leads(spaced) == [w.lead(x) for x in spaced] and w.leads([]) == []
    assert w.lead(b"don't") == ranks[bpe.merged(b" don", ranks)[0]] and w.lead(b"q" * 200_000) >= 0


def test_attention_is_causal_sums_to_one_and_learns():
    model = lm_scoring.Attention.fresh(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES))
    r = np.random.default_rng(0)
    x = r.integers(0, lm_scoring.CLASSES, (3, 64))
    z, _ = model.forward(x)
    assert np.allclose(np.exp(z).sum(-1), 1, atol=1e-4)
    y = x.copy()
    y[:, 40:] = 0
    assert np.allclose(model.forward(y)[0][:, :40], z[:, :40], atol=1e-4)
    texts = [(np.arange(k, k + n) % 7).astype(np.int64) for k, n in enumerate((1, 10, 64, 65, 200, 500))]
    before = model.scores(texts)
    one = [model.scores([t])[0] for t in texts]
    assert np.allclose(before, one, rtol=1e-4)
    windows = np.array([(np.arange(k, k + 64) % 7) for k in range(64)])
    model.train(windows, 0.01, 30)
    assert sum(model.scores(texts)) > 0.5 * sum(before)


def test_lm_score_by_a_plain_computation(spark, corpus, monkeypatch):
    """The score of each text from the trained weights, token by token, without windows cut in batches, codes or joins."""
    kept = {}
    fit = lm_scoring.fit

    def spy(*args):
        kept["w"] = fit(*args)
        return kept["w"]

    monkeypatch.setattr(lm_scoring, "fit", spy)
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = {r.doc_id: r.score for r in lm_scoring.score(corpus, RANKS).collect()}
    w = lm_scoring.Words(lm_scoring.ranks_of(RANKS), P.PATTERN, None)
    c = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*t.encode().lower().split(), None])
    lead = {x: w.lead(x) for x in {x for _, t in rows for x in t.encode().lower().split()}}
    by_lead = collections.Counter()
    for x, n in c.items():
        if x is not None:
            by_lead[lead[x]] += n
    first = sorted(by_lead, key=lambda k: (-by_lead[k], k))[: lm_scoring.CLASSES - 2]
    of = lambda x: lm_scoring.CLASSES - 1 if x is None else first.index(lead[x]) if lead[x] in first else lm_scoring.CLASSES - 2
    total, distinct = collections.Counter(), collections.Counter()
    for x, n in c.items():
        total[of(x)] += n
        distinct[of(x)] += 1
    model = lm_scoring.Attention(kept["w"])
    for i, t in rows[::9]:
        tokens = [*t.encode().lower().split(), None]
        y = [of(x) for x in tokens]
        want = 0.0
        for k, x in enumerate(tokens):
            start = 0 if k < 64 else (k - 64) // 48 * 48 + 48
            seen = [lm_scoring.CLASSES, *y[start:k]]
            z, _ = model.forward(np.array([seen]))
            want += z[0, -1, y[k]] / math.log(10) + math.log10((c[x] + 0.5) / (total[y[k]] + 0.5 * (distinct[y[k]] + 1)))
        assert abs(got[i] - want) < 1e-4 * abs(want)


def test_lm_predicts_every_subword(spark, corpus, odd, empty, monkeypatch):
    """With `every`: the score of each text from the trained weights, subword by subword; nothing else changes."""
    kept = {}
    fit = lm_scoring.fit

    def spy(*args):
        kept["w"] = fit(*args)
        return kept["w"]

    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    plain = {r.doc_id: r for r in lm_scoring.score(corpus, RANKS).collect()}
    monkeypatch.setattr(lm_scoring, "fit", spy)
    got = {r.doc_id: r for r in lm_scoring.score(corpus, RANKS, every=True).collect()}
    ranks = lm_scoring.ranks_of(RANKS)
    spaced = {i for token, i in ranks.items() if token.startswith(b" ")}
    subwords = lm_scoring.Words(ranks, P.PATTERN).subwords
    ids = {x: subwords(" " + x.decode()) for x in {x for _, t in rows for x in t.encode().lower().split()}}
    c = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*(k for x in t.encode().lower().split() for k in ids[x]), None])
    first = sorted((k for k in c if k is not None), key=lambda k: (-c[k], k))[: lm_scoring.CLASSES - 3]
    of = lambda k: lm_scoring.CLASSES - 1 if k is None else first.index(k) if k in first else lm_scoring.CLASSES - 3 if k in spaced else lm_scoring.CLASSES - 2
    total, distinct = collections.Counter(), collections.Counter()
    for k in [*ranks.values(), None]:
        total[of(k)] += c[k]
        distinct[of(k)] += 1
    inner = lambda k: (c[k] + 0.5) / (total[of(k)] + 0.5 * distinct[of(k)])
    assert abs(sum(map(inner, [*ranks.values(), None])) - len(distinct)) < 1e-6
    model, several = lm_scoring.Attention(kept["w"]), 0
    for i, t in rows[::19]:
        tokens = [*(k for x in t.encode().lower().split() for k in ids[x]), None]
        several += len(tokens) > 1 + len(t.split())
        y = [of(k) for k in tokens]
        want = 0.0
        for n, k in enumerate(tokens):
            start = 0 if n < 64 else (n - 64) // 48 * 48 + 48
            z, _ = model.forward(np.array([[lm_scoring.CLASSES, *y[start:n]]]))
            want += z[0, -1, y[n]] / math.log(10) + math.log10(inner(k))
        assert abs(got[i].score - want) < 1e-4 * abs(want)
        assert plain[i][:5] == got[i][:5] and abs(plain[i].base_score - got[i].base_score) < 1e-9 * abs(got[i].base_score)
    assert several
    assert lm_scoring.score(odd, RANKS, every=True).count() == odd.count() and lm_scoring.score(empty, RANKS, every=True).count() == 0


def test_lm_words_are_split_and_encoded_as_one_by_one():
    texts = [" A\x0bB\x0cc\x1cd E\u2003f\x85g ", "", "x", "  ", "\u00c0B\r\n\tz \u3000 \u3000 \u00a0y q\u2003 don't"]
    owner, words = lm_scoring.split(pa.array(texts))
    want = [(i, w) for i, t in enumerate(texts) for w in t.encode().lower().split()]
    assert list(zip(owner.tolist(), words.cast(pa.binary()).to_pylist(), strict=True)) == want
    w = lm_scoring.Words(lm_scoring.ranks_of(RANKS), P.PATTERN)
    for some in ([x for _, x in want], [b"plain", b"words"], []):
        each = [w.subwords(" " + x.decode()) for x in some]
        ids, size = w.encoded(some)
        assert ids.tolist() == [k for x in each for k in x] and size.tolist() == list(map(len, each))
    big = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5 << 20, 0, 3 << 20, 3 << 20, 1)])], ["text"])
    cut = list(lm_scoring.bounded(iter([big])))
    assert pa.Table.from_batches(cut) == pa.Table.from_batches([big]) and [c.num_rows for c in cut] == [2, 3]


def test_lm_numbers_keep_the_words_of_top_alone(corpus):
    words = sorted({x for r in corpus.limit(60).collect() for x in r.text.encode().lower().split()})[:900] + [b"don't", "\u00a0y".encode(), "a\u2003b".encode(), b"\x1cz"]
    ranks = lm_scoring.ranks_of(RANKS)
    class_of = (np.arange(max(ranks.values()) + 2) % 61).astype(np.int8)
    weight_of, top = np.arange(len(class_of)) / 7, {h: 5 + k for k, h in enumerate(lm_scoring.hashes(words[::3]).tolist())}
    for every in (True, False):
        w = lm_scoring.Words(ranks, P.PATTERN, class_of, weight_of, top, 4, every)
        for part in (words[:500], words[300:], words[:0], words[::-1]):
            numbers = w.numbers(pa.array(part, pa.binary()))
            assert len(set(numbers.tolist())) == len(part) and w.count[0] == 4 and w.hash[0] == lm_scoring.END_HASH and w.size[0] == 1
            for x, k in zip(part, numbers.tolist(), strict=True):
                ids = w.subwords(" " + x.decode())[: None if every else 1]
                h = lm_scoring.hashes([x])[0]
                assert w.pieces[w.start[k] : w.start[k] + w.size[k]].tolist() == class_of[ids].tolist() and abs(w.weight[k] - weight_of[ids].sum()) < 1e-9
                assert w.hash[k] == h and w.count[k] == top.get(h, 0)
        assert sorted(w.met.to_pylist()) == sorted(words[::3])  # what is rare is not remembered


def test_lm_gradients_are_slopes():
    """In double precision, by differences; with weights so large that exponentials need care as well."""
    r = np.random.default_rng(5)
    y = r.integers(0, lm_scoring.CLASSES, (3, 40))
    for scale, front, back in ((1, 0, 40), (1, 16, 33), (8, 3, 40)):
        fresh = lm_scoring.Attention.fresh(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES)).w
        model = lm_scoring.Attention({k: v.astype(float) * scale for k, v in fresh.items()})
        real = np.broadcast_to((np.arange(40) >= front) & (np.arange(40) < back), y.shape)
        x = lm_scoring.shifted(y)

        def loss():
            z, _ = model.forward(x)
            return -np.take_along_axis(z, y[..., None], 2)[..., 0][real].mean()

        g = model.gradients(x, y, real)
        for name, v in model.w.items():
            for at in [tuple(r.integers(0, n) for n in v.shape) for _ in range(6)]:
                kept = v[at]
                v[at] = kept + 1e-5
                more = loss()
                v[at] = kept - 1e-5
                less = loss()
                v[at] = kept
                assert abs((more - less) / 2e-5 - g[name][at]) < 1e-4 * max(1, abs(g[name]).max()), (scale, name)


def test_lm_rare_words_move_once(corpus, monkeypatch):
    """Equal words of a text are added up where they are read, so that rare words move to their counts and back to their texts only."""
    monkeypatch.setattr(lm_scoring, "TOP", 0)
    plan = lm_scoring.score(corpus, RANKS, every=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "explode" in plan


def test_work_folders_go(spark, tmp_path):
    df = stored(spark.range(3), "gone")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert Path(path).exists()
    paths, tables = spark.sparkContext._fieldloom_paths, spark.sparkContext._fieldloom_tables
    spark.sparkContext._fieldloom_paths, spark.sparkContext._fieldloom_tables = [path], []
    cleared(spark)
    assert not Path(path).exists()
    spark.sparkContext._fieldloom_paths, spark.sparkContext._fieldloom_tables = paths, tables


def test_pipeline_stage_by_stage(spark, corpus, labels, tmp_path):
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 4 != 0), int(k % 5 == 0 and k % 4 != 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == corpus.columns, name
    left = {r.doc_id: r.text for r in docs.collect()}
    assert not any(k % 4 == 0 for k in left if k < 200) and not any(k % 5 == 0 for k in left if k < 200) and 230 not in left and 231 not in left
    brute = brute_components(list(left.items()), 5, 80)
    assert all(c == i for i, (_, c) in brute.items())
    p = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(p["doc_id"]) == set(left) and p["size"].sum() == sum(len(t.split()) for t in left.values())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_odd_and_empty_tables(spark, odd, empty, labels, tmp_path, name):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd, str(tmp_path)).count() > 0
    assert stage(spark, empty, str(tmp_path)).count() == 0

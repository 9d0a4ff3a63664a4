from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from check import compare, connect
from logharbor.llm import decontam, jaccard, links, mixing, pii, quality, queries, repeats, secrets, toxicity, vectors
from tests.llm import brute

DIR = "/root/testdata/sf0.01"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("h", T.StringType()), T.StructField("size", T.LongType()), T.StructField("text_key", T.LongType()),
    T.StructField("token", T.StringType()), T.StructField("score", T.DoubleType())])

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "h", 1, 2, "t", 0.5) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and long texts, repeated rows, ties, accents, clashing names."""
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, LONG, "b"), (5, LONG, "b"), (6, BASE, "b"), (7, BASE + " tail", "c"),
            (8, BASE, "c"), (8, BASE, "c"), (9, "two words", "c"), (10, "TWO words", None), (11, "é password: abcdefgh12 ü", "a"),
            (None, "x y z", "a"), (12, "write to é ann@example.com or +1 555 123 4567", "a"), (13, "Other " + BASE, "b")]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def rows(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def random_texts(seed: int, n: int, parts: list[str], size: int) -> list[tuple]:
    rnd = random.Random(seed)
    return [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, size))), "s") for i in range(n)]


# 1
def test_secrets_against_patterns(spark, rows):
    parts = ["password", "Token", "api_key", "APIkey", " ", "=", ":", '"', "abcdef", "0123456789abcdef", "AKIA", "ABCD0123", "é", "deadbeef" * 4, "\n"]
    texts = random_texts(1, 1500, parts, 14) + [(5000 + i, t, "s") for i, t in rows[:200]]
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, texts)).collect()}
    for i, text, _ in texts:
        want = brute.secrets(text)
        assert got[i].base_sha256 == brute.digest(",".join(x[2] for x in want)), text
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))


def test_secrets_added_kinds_and_odd_rows(spark, odd):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9 + " eyJab.eyJcd.ef"
    spans = secrets.scan_secrets(frame(spark, [(1, text, None)])).first().spans
    assert [s.split(":")[0] for s in spans.split(",")] == ["pem", "github", "jwt"]
    got = secrets.scan_secrets(odd).collect()
    assert len(got) == 15 and {r.doc_id: r.spans for r in got}[11] == "assign:2:22"
    assert secrets.scan_secrets(odd.limit(0)).count() == 0


# 2
def test_resampling_keeps_good_text(spark, table):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    kept = {r.doc_id for r in quality.resample(table, labels).collect()}
    marks = labels.collect()
    assert np.mean([r.doc_id in kept for r in marks if r.quality == 1]) > 0.95
    assert np.mean([r.doc_id in kept for r in marks if r.quality == 0]) < 0.4


def test_resampling_against_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    good = {i for i, q in marks.items() if q == 1}
    assert len(good) < quality.TARGET_SAMPLE and all(t is not None for _, t in rows)
    want = brute.resampled(rows, good, len(good) / len(marks), quality.SEED, quality.BUCKETS, quality.LONGEST)
    got = {r.doc_id: (r.log_weight, r.sample_key) for r in quality.op2_quality_resampling(spark, folder).collect()}
    assert got.keys() == want.keys() and 0 < len(want) < len(rows)
    assert np.allclose([got[i] for i in want], list(want.values()), rtol=0, atol=1e-6)


def test_top_k_and_odd_rows(spark, odd):
    keys = spark.range(30_000).select("id", (F.col("id") % 7000).cast("double").alias("k"))
    got = quality.top_k(keys, "k", "id", 25_001)
    want = keys.orderBy(F.desc("k"), "id").limit(25_001)
    assert got.count() == 25_001 and got.exceptAll(want).count() == 0
    labels = spark.createDataFrame([(6, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    assert quality.resample(odd, labels, share=0.4).count() == 6
    assert quality.resample(odd, labels.limit(0)).count() == 15
    assert quality.resample(odd.limit(0), labels).count() == 0


# 3
def test_jaccard_against_all_pairs(spark, table, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(table).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_chains_blocks_and_odd_rows(spark, odd, monkeypatch):
    rnd = random.Random(4)
    words, texts = [f"v{i}" for i in range(120)], []
    for i in range(150):  # a drifting text: neighbours are similar, ends are not
        words[rnd.randrange(120)] = f"n{i}"
        texts.append((1000 - i, " ".join(words), "s"))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "GUESTS", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(frame(spark, texts)).collect()}
    assert got == brute.jaccard([(i, t) for i, t, _ in texts])
    groups = jaccard.jaccard_groups(odd).collect()
    assert len(groups) == 15
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in groups}
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[5][1] == 4 and found[8][1] == 6 and found[10] == (1, 9)
    assert sorted(r.doc_id or 0 for r in jaccard.one_per_group(odd).collect()) == [0, 1, 2, 3, 4, 6, 9, 11, 12]
    assert jaccard.jaccard_groups(odd.limit(0)).count() == 0


def test_jaccard_of_many_near_copies_with_common_tokens(spark, monkeypatch):
    rnd = random.Random(11)
    base, texts = [f"b{i}" for i in range(90)], []
    for i in range(220):  # copies on both sides of the bound, of several lengths
        words = base[: rnd.randrange(60, 91)]
        for _ in range(rnd.randrange(5)):
            words[rnd.randrange(len(words))] = f"n{i}_{rnd.randrange(9)}"
        texts.append((i, " ".join(words), "s"))
    want = brute.jaccard([(i, t) for i, t, _ in texts])
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "GUESTS", 16)
    monkeypatch.setattr(jaccard, "SALTS", 4)
    for edges in ((-1e9, -1e9, -1e9), jaccard.LEVEL_EDGES):  # every token common, then as counted
        monkeypatch.setattr(jaccard, "LEVEL_EDGES", edges)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(frame(spark, texts)).collect()}
        assert got == want


def test_tree_bound_never_loses_a_link():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**62, 300, dtype=np.uint64)
    sets = [np.unique(np.where(rnd.random(300) < p, rnd.integers(0, 2**62, 300, dtype=np.uint64), base)) for p in rnd.random(60) * 0.3]
    tree = jaccard.Tree(sets)
    kept = set(zip(*(tree.order[k].tolist() for k in jaccard.candidate_leaves(tree)), strict=True))
    kept = {tuple(sorted(p)) for p in kept}
    for a in range(60):
        for b in range(a + 1, 60):
            if jaccard.linked(sets[a], sets[b]):
                assert (a, b) in kept


# 4
def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, rule string")


def test_rules_and_propagation(spark):
    link = '<a href="https://{}/x">'.format
    rows = [(1, "http://A.Example.NET/en/1?q", None), (2, "https://x.net/p", link("y.com")), (3, "http://example.com/de/", ""),
            (4, "ftp://org/fr/a#b", ""), (5, None, None), (6, "no scheme", ""), (7, "http://x.net", ""),
            (8, "http://farm.info/", link("x.net") + link("x.net")), (9, "http://y.com/", ""), (10, "http://notnet/", ""), (2, "https://x.net/p", link("y.com"))]
    got = {r.page_id: r for r in links.judge_pages(pages(spark, rows)).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("a.example.net", "/en/1", "example.net/en/")
    assert [got[i].rule for i in (2, 3, 4, 5, 7, 10)] == ["net/", "example.com/de/", "org/fr/", None, None, None]
    assert (got[5].host, got[5].path, got[6].host, got[5].verdict) == ("", "", "", "allow")
    # the host without a rule of its own follows its blocked pages; a host that feeds it is suspect
    assert (got[7].verdict, got[8].verdict, got[9].verdict) == ("block", "block", "allow")
    assert links.judge_pages(pages(spark, rows)).count() == len(rows)
    assert links.judge_pages(pages(spark, rows).limit(0)).count() == 0


def test_propagation_is_pagerank(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0)], "a string, b string, weight double")
    seeds = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 0.0)], "host string, seed double")
    got = {r.host: r.score for r in links.propagate(seeds, edges, 0.85, 40).collect()}
    step = np.array([[0, 0, 1], [0.25, 0, 0], [0.75, 1, 0]])
    want = np.linalg.solve(np.eye(3) - 0.85 * step, [1, 0, 0])
    assert np.allclose([got["a"], got["b"], got["c"]], want, atol=0.01)


def test_propagation_goes_on_until_nothing_is_left(spark):
    # 400 hosts that hand their seeds down a chain of 30, beyond any few rounds
    edges = [(f"c{i}", f"c{i + 1}", 1.0) for i in range(30)] + [(f"s{i}", "c0", 2.0) for i in range(400)]
    seeds = [(f"s{i}", 1.0) for i in range(400)]
    got = {r.host: r.score for r in links.propagate(spark.createDataFrame(seeds, "host string, seed double"),
                                                    spark.createDataFrame(edges, "a string, b string, weight double")).collect()}
    assert abs(got["c0"] - 340) < 1e-6 and abs(got["c30"] - 400 * 0.85**31) < 1e-6 and got["s0"] == 1
    circle = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 3.0)], "a string, b string, weight double")
    start = spark.createDataFrame([("a", 1000.0)], "host string, seed double")
    round_trip = {r.host: r.score for r in links.propagate(start, circle).collect()}
    assert 0 <= 1000 / (1 - 0.85**2) - round_trip["a"] < links.TOLERANCE


def test_propagation_sums_rounds_that_only_repeat(spark, monkeypatch):
    # suppliers and parts link to each other, in two parts of the graph that never meet; odd and even rounds differ
    rnd = np.random.default_rng(3)
    pairs = {(f"{g}s{rnd.integers(4)}", f"{g}p{rnd.integers(30)}", float(rnd.integers(1, 4))) for g in "xy" for _ in range(200)}
    edges = [*pairs, *((b, a, w) for a, b, w in pairs)]
    seeds = [(f"xp{i}", 1.0) for i in range(20)] + [("yp1", 5.0), ("lonely", 1.0)]
    total, want = {}, dict(seeds)
    for a, _, w in edges:
        total[a] = total.get(a, 0) + w
    step = dict(seeds)
    while sum(step.values()) * links.DAMPING >= links.TOLERANCE * (1 - links.DAMPING):
        sent = {}
        for a, b, w in edges:
            sent[b] = sent.get(b, 0) + step.get(a, 0) * w / total[a] * links.DAMPING
        step = sent
        for host, x in step.items():
            want[host] = want.get(host, 0) + x
    saved, save = [], links.save
    monkeypatch.setattr(links, "save", lambda df, name="step": (saved.append(name), save(df, name))[1])
    monkeypatch.setattr(links, "LIST", 5)
    got = {r.host: r.score for r in links.propagate(spark.createDataFrame(seeds, "host string, seed double"),
                                                    spark.createDataFrame(edges, "a string, b string, weight double")).collect()}
    assert all(abs(got.get(h, 0) - x) < 1e-8 for h, x in want.items()) and not set(got) - set(want)
    assert saved.count("step") < 35, "the plain loop takes over 70 rounds"


def test_edges_both_ways_carry_both_scores_once(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    pairs = {(f"s{rnd.integers(4)}", f"p{rnd.integers(40)}"): float(rnd.integers(1, 4)) for _ in range(150)}
    edges = [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()]
    frame_of = lambda rows: spark.createDataFrame(rows, "a string, b string, weight double")
    assert links._both_ways(frame_of(edges)) and not links._both_ways(frame_of(edges[1:]))
    assert not links._both_ways(frame_of([*edges[1:], (*edges[0][:2], 9.0)]))
    seeds = spark.createDataFrame([(f"p{i}", float(i < 9), float(i > 33)) for i in range(41)] + [("s1", 0.0, 0.0), ("s1", 0.0, 0.0), ("", 0.0, 0.0)],
                                  "host string, allowed double, blocked double")
    handed, adjacency = [], links._adjacency
    monkeypatch.setattr(links, "_adjacency", lambda e: handed.append(e.count()) or adjacency(e))
    monkeypatch.setattr(links, "LIST", 5)
    monkeypatch.setattr(links, "HUB", 20)  # suppliers are hubs, parts are not
    got = sorted(tuple(r) for r in links.judge_hosts(seeds, frame_of(edges)).collect())
    monkeypatch.setattr(links, "_both_ways", lambda e: False)
    want = sorted(tuple(r) for r in links.judge_hosts(seeds, frame_of(edges)).collect())
    assert handed == [len(edges), 2 * len(edges)] and len(got) == 44 and {r[3] for r in want} == {"allow", "block"}
    assert all(g[0] == w[0] and g[3] == w[3] and np.allclose(g[1:3], w[1:3], atol=1e-7) for g, w in zip(got, want, strict=True))


# 5
def test_personal_data_against_patterns(spark, rows):
    parts = ["a", "b.c", "@", ".com", "-", "+", "1", "255", "256", ".", " ", "(", "4111111111111111", "4111 1111 1111 1111", "+1 555", "é", "x" * 70]
    texts = random_texts(2, 800, parts, 14) + [(5000 + i, t, "s") for i, t in rows[:200]]
    found = {r.doc_id: r.base for r in pii.find_personal_data(frame(spark, texts)).collect()}
    for i, text, _ in texts:
        assert [(pii.KINDS[s.kind], s.a, s.b) for s in found[i]] == brute.personal(text), text


def test_disclosing_terms_and_masking(spark, odd):
    texts = [(i, f"the owner zorblat is ann@example.com and filler{i} é", "s") for i in range(4)]
    texts += [(10 + i, f"the owner is bob{i}@example.com and nothing é", "s") for i in range(20)] + [(50, "zorbla the owner", "s")]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert [texts[0][1][s.a: s.b] for s in got[0].terms] == ["zorblat"]
    assert not got[10].terms and not got[50].terms
    masked = {r.doc_id: r.text for r in pii.sanitise(frame(spark, texts)).collect()}
    assert masked[0] == "the owner [TERM] is [EMAIL] and filler0 é" and masked[50] == "zorbla the owner"
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == 15
    assert {r.doc_id: r.text for r in clean.collect()}[12] == "write to é [EMAIL] or [PHONE]"
    assert pii.sanitise(odd.limit(0)).count() == 0


def test_terms_of_rare_values_anywhere_in_the_text(spark):
    texts = [(i, f"plain words é of text {i % 7}", "s") for i in range(300)]
    far = " ".join(["plain words é of text"] * 4)
    texts += [(1000, f"Dear Quillon, {far} ann@example.com {far} (quillon)", "s"), (1001, "write to +1 555 123 4567 Zorblat", "s"),
              (1002, "Zorblat: +1 555 123 4567, plain words", "s"), (1003, "quillon without an address", "s")]
    texts += [(1100 + i, f"mail u{i}@rare.example for {'sprocket' if i < 4 else 'text'} words", "s") for i in range(5)]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, texts[:-6] + texts[-5:])).collect()}
    told = {i: [t[s.a: s.b] for s in got[i].terms] for i, t, _ in texts if i in got}
    assert told[1000] == ["Dear", "Quillon", "quillon"]
    assert "Zorblat" in told[1001] and told[1002] == ["Zorblat"] and not told[0]
    # a value of one document each, a domain of five
    assert all("sprocket" in told[1100 + i] for i in range(4)) and "words" not in told[1104]
    # a word that as many documents hold without the value does not give it away
    more = {r.doc_id: r for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert [texts[300][1][s.a: s.b] for s in more[1000].terms] == ["Dear"] and not more[1003].terms


def test_terms_are_masked_wherever_they_stand(spark):
    far = " ".join(["some usual words"] * 10)
    texts = [(i, f"Hello Quillon, {far} yours Quillon ann@example.com", "s") for i in range(4)]
    # beyond eight words of the value in every document
    texts += [(10 + i, f"bob@example.org {far} Brantwell", "s") for i in range(4)] + [(100 + i, far, "s") for i in range(60)]
    masked = {r.doc_id: r.text for r in pii.sanitise(frame(spark, texts)).collect()}
    assert all("Quillon" not in masked[i] and "Brantwell" not in masked[10 + i] for i in range(4))
    assert masked[10] == f"[EMAIL] {far} [TERM]" and masked[100] == far


# 6
def test_mix_meets_targets(spark, table):
    mix = mixing.mixture(table).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in mix) and len(mix) == table.count()
    words, target, most = {}, {}, {}
    sources = {r.doc_id: r.source for r in table.collect()}
    for r in mix:
        source = sources[r.doc_id]
        words[source] = words.get(source, 0) + r.taken
        target[source], most[source] = r.target, max(most.get(source, 0), r.size)
    assert all(abs(words[k] - target[k]) <= 0.1 * target[k] + 3 * most[k] for k in target)
    again = {(r.doc_id, r.taken) for r in mixing.mixture(table.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in mix}


def test_targets_are_capped_and_shared_again(spark):
    rows = [(1, "a " * 10, "s1"), (2, "a " * 400, "s2"), (3, "a " * 100, None), (4, None, "s3"), (5, "a " * 90, "s4")]
    got = {r.doc_id: r.target for r in mixing.mixture(frame(spark, rows)).collect()}
    weights, sizes, total = [5, 2, 1, 5, 2], [10, 400, 0, 90, 100], 600
    target, left = [0.0] * 5, set(range(5))
    while True:
        rest = total - sum(target[i] for i in range(5) if i not in left)
        part = {i: rest * weights[i] / sum(weights[j] for j in left) for i in left}
        over = {i for i in left if part[i] >= 3 * sizes[i]}
        if not over:
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        left -= over
    for i in left:
        target[i] = part[i]
    assert np.allclose([got[1], got[2], got[4], got[5], got[3]], target)


def test_mix_odd_rows(spark, odd):
    mix = mixing.mixture(odd)
    out = mixing.mixed_documents(odd)
    assert mix.count() == 15 and out.columns == [*odd.columns, "copy"]
    assert out.count() == mix.agg(F.sum("copies")).first()[0]
    assert mixing.mixture(odd.limit(0)).count() == 0


# 7
def test_leaks(spark, table, odd):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    text = items.orderBy("item_id").first().text
    words = text.split()
    changed = [("CHANGED" if k % 9 == 4 else w.upper()) for k, w in enumerate(words)]
    docs = frame(spark, [(1, f"{BASE} {text} {BASE}", "s"), (2, " ".join(changed), "s"), (3, " ".join(words[: len(words) // 3]), "s"),
                         (4, BASE, "s"), (5, None, "s"), (None, text, "s"), (1, f"{BASE} {text} {BASE}", "s")])
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert {(1, 0), (2, 0), (None, 0)} <= got and not {i for i, _ in got} & {3, 4, 5}
    assert sorted(r.doc_id for r in decontam.without_leaks(docs, items).collect()) == [3, 4, 5]
    assert decontam.without_leaks(odd, items.limit(0)).count() == 15
    assert decontam.leaks(odd.limit(0), items).count() == 0


def test_leaks_find_every_whole_passage(spark, table, rows):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    clean = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    texts = {i: clean(t) for i, t in rows}
    want = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if clean(r.text) in t}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(table, items).collect()}
    assert want and want <= got and len(got - want) <= len(want)


def test_leaks_miss_no_pattern_of_changes(spark):
    items, docs = [], []
    for item, (size, changed) in enumerate([(10, 0), (10, 2), (15, 3), (16, 3), (20, 4)]):
        words = [f"i{item}w{k}" for k in range(size)]
        items.append((item, " ".join(words)))
        for at in itertools.combinations(range(size), changed):
            for before in (0, 1, 2) if size == 10 else (len(docs) % 2,):
                copy = ["x" if k in at else w for k, w in enumerate(words)]
                docs.append((100_000 * item + len(docs), " ".join(["b"] * before + copy + ["a"]), "s"))
    got = decontam.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i // 100_000) for i, _, _ in docs}


def test_leaks_of_short_items_and_at_the_ends_of_documents(spark):
    words = [f"q{k}" for k in range(40)]
    items = [(0, " ".join(words)), (1, "What is the capital of Peru?"), (2, "quux"), (3, "one two three four five six seven eight nine"), (4, " ?")]
    docs = [(1, " ".join(words[11:29]), "s"), (2, " ".join(words[:16]), "s"), (3, " ".join([*words[24:], "tail"]), "s"),
            (4, " ".join(words[:15]), "s"), (5, "asked: what is the capital, of peru", "s"), (6, "what is the capital of chile", "s"),
            (7, "Quux", "s"), (8, "one two three four five six seven eight nine", "s"), (9, "one two three four five six seven eight", "s"), (10, "", "s")]
    got = decontam.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.start, r.compared, r.agreeing) for r in got} == {
        (1, 0, -11, 20, 18), (2, 0, 0, 20, 16), (3, 0, -24, 20, 16), (5, 1, 1, 6, 6), (7, 2, 0, 1, 1), (8, 3, 0, 9, 9)}


def test_leaks_against_every_place(spark, monkeypatch):
    rnd = random.Random(7)
    items = [(i, " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(3)) for _ in range(rnd.choice([4, 9, 10, 13, 20, 31])))) for i in range(12)]
    preface = " ".join(f"p{k}" for k in range(10))
    items += [(100 + i, f"{preface} " + " ".join(f"i{i}w{k}" for k in range(12))) for i in range(30)]
    docs = []
    for i in range(60):
        words = rnd.choice(items)[1].split()
        words = [rnd.choice(words) if rnd.random() < 0.15 else w for w in words][rnd.randrange(4):]
        docs.append((i, " ".join(["lead"] * rnd.randrange(4) + words + ["tail"] * rnd.randrange(9)), "s"))
    docs += [(200, " ".join([preface] * 40), "s"), (201, f"{preface} {preface} {items[20][1]}", "s"), (None, items[3][1], "s"), (202, None, "s")]
    want = brute.leaks([(i, t) for i, t, _ in docs], items)
    assert len(want) > 30 and not any(d == 200 for d, *_ in want)
    table = spark.createDataFrame(items, "item_id long, text string")
    for windows, hits in ((decontam.BROADCAST_WINDOWS, decontam.HITS), (0, 7)):  # broadcast; shuffled, with several rows a document
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", windows)
        monkeypatch.setattr(decontam, "HITS", hits)
        got = decontam.leaks(frame(spark, docs), table).collect()
        assert {(r.doc_id, r.item_id, r.start, r.compared, r.agreeing) for r in got} == want


def test_marks_keep_every_seed_and_few_others(spark):
    windows = spark.range(3000).selectExpr("xxhash64(id) AS seed")
    places = spark.range(30_000).selectExpr("id", "xxhash64(id) AS seed")
    kept = decontam.with_known_seeds(places, windows, 3000)
    assert kept.columns == ["id", "seed"] and kept.filter("id < 3000").count() == 3000 and kept.count() < 6000


# 8
def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "INTERVAL", 100)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rnd = np.random.default_rng(5)
    centers = rnd.normal(size=(40, 16))
    x = [(centers[rnd.integers(40)] + 0.1 * rnd.normal(size=16)).tolist() for _ in range(500)] + [centers[0].tolist()] * 30
    rows = [(i + 1, v, 0) for i, v in enumerate(x)]
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [None] + [1.0] * 15, 0), (903, [float("nan")] + [1.0] * 15, 0),
           (904, [float("inf")] + [1.0] * 15, 0), (905, [], 0), (906, [1.0, 2.0], 0)]
    frame_ = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, cid int")
    got = {r.vec_id: r for r in vectors.link_vectors(frame_).collect()}
    unit = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    groups = brute.Groups(range(1, 531))
    for a, b in zip(*np.nonzero(near), strict=True):
        groups.join(int(a) + 1, int(b) + 1)
    assert near.sum() > 1000
    for i in range(530):
        assert (got[i + 1].n_links, got[i + 1].component_id) == (near[i].sum(), groups.root(i + 1))
        assert got[i + 1].kept == (groups.root(i + 1) == i + 1)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 907))
    assert vectors.link_vectors(frame_.limit(0)).count() == 0


# 9
def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels)
    got = scored.filter("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    # a small table, whose toxic words in three languages begin like ordinary ones
    assert np.mean(toxic) > 0.5 and np.mean(clean) < 0.06


def test_telling_beginnings_of_a_minority():
    rnd = random.Random(5)
    text = lambda *more: " ".join([*(str(rnd.randrange(100, 999)) for _ in range(30)), *more])
    toxic = [text("zurrapa", "plain") if i < 8 else text("scumbag" if i < 200 else "plain") for i in range(300)]
    ordinary = [text("plain", *["casual"] * (i < 40)) for i in range(2000)]
    got = toxicity.telling_beginnings([*toxic, text("casual")], ordinary)
    assert {s[:5] for s in got} == {b" zurr", b" scum"}


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(6, 1, None), (9, 0, None), (None, 1, None), (7, None, None)], "doc_id long, toxic int, score double")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.without_toxic(odd, labels).columns == odd.columns
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0


# 10
def test_repeats_against_dictionary(spark, table, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, brute.digest(r.kept)) for r in repeats.remove_repeats(table).collect()}
    assert got == brute.repeats(rows)


def test_repeats_more_levels_and_odd_rows(spark, odd):
    rnd = random.Random(9)
    texts = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 150))), "s") for i in range(40)]
    want = brute.repeats([(i, t) for i, t, _ in texts], 12)
    for first in (3, 6, 12):
        got = repeats.remove_repeats(frame(spark, texts), window=12, first_length=first).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, brute.digest(r.kept)) for r in got} == want
    got = repeats.remove_repeats(odd).collect()
    found = {r.doc_id: (r.n_words, r.n_removed) for r in got}
    assert len(got) == 15 and found[1] == (0, 0) and found[6] == (60, 0) and found[8] == (60, 60) and found[13] == (61, 60)
    assert found[5] == (30_000, 30_000)
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    got = queries.QUERIES[name](spark, DIR).toArrow()
    assert compare(got, connect(DIR).sql(queries.ORACLES[name]).to_arrow_table()) is None


def test_every_operator_is_registered():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14))

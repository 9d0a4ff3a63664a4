"""Exact joins and clustering against brute force on small random data."""

from __future__ import annotations

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logharbor.operators import clustering as C
from logharbor.operators import dense_similarity as D
from logharbor.operators import token_similarity as S
from logharbor.operators.components import connected_components


def random_texts(seed, count=120):
    """Templates with ids and hosts, near copies and unrelated lines."""
    rng = random.Random(seed)
    templates = ["user {u} login failed on host {h}", "cache miss for key {u}", "pool {h} exhausted", "a {u}", "x",
                 "user {u} from host {h} login failed after retry number {h}"]
    out = [rng.choice(templates).format(u=f"u{rng.randrange(40)}", h=f"h{rng.randrange(6)}") for _ in range(count)]
    return [(f"t{i:03d}", text) for i, text in enumerate(dict.fromkeys(out))]


def tokens(text):
    return set(text.split())


def brute_pairs(texts, num, den):
    found = set()
    for (a, x), (b, y) in itertools.combinations(texts, 2):
        p, q = tokens(x), tokens(y)
        if den * den * len(p & q) ** 2 >= num * num * len(p) * len(q):
            found.add((a, b, len(p & q), len(p), len(q)))
    return found


def components_of(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed, threshold, hot", [(1, (3, 4), 1), (2, (3, 4), 5), (3, (1, 2), 1), (4, (9, 10), 3), (5, (3, 4), 1000)])
def test_token_pairs_and_links(spark, seed, threshold, hot):
    texts = random_texts(seed)
    ranked = S.rank_tokens(spark.createDataFrame(texts, "id string, text string"))
    want = brute_pairs(texts, *threshold)
    got = {tuple(r) for r in S.similar_pairs(ranked, threshold, hot).collect()}
    assert got == want
    links = {(r.u, r.v) for r in S.similarity_links(ranked, threshold, hot).collect()}
    ids = [i for i, _ in texts]
    assert components_of(ids, links) == components_of(ids, [p[:2] for p in want])


def test_links_stay_linear_in_a_template(spark):
    """200 lines of one template give about one link per line, not all pairs."""
    texts = [(f"t{i:03d}", f"user u{i} login failed on host alpha now") for i in range(200)]
    ranked = S.rank_tokens(spark.createDataFrame(texts, "id string, text string"))
    assert S.similarity_links(ranked, hot_posting=10).count() < 3 * 200
    assert S.similar_pairs(ranked, hot_posting=10).count() == 200 * 199 // 2


def test_components(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(200)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(100)]  # a long path
    edges += [("h000", f"h{i:03d}") for i in range(1, 150)]  # a hub
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    ids = {x for e in edges for x in e if e[0] != e[1]}
    assert got == components_of(sorted(ids), [e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def logs_of(spark, lines):
    start = datetime(2024, 1, 1)
    rows = [(f"l{i:03d}", start + timedelta(seconds=i), "ERROR", "db", m) for i, m in enumerate(lines)]
    return spark.createDataFrame(rows, "id string, timestamp timestamp, level string, service string, message string")


def test_clusters_keep_copies_and_drop_noise(spark):
    lines = ["pool exhausted for tenant one", "pool exhausted for tenant two", "disk gone", "disk gone", "lonely words here"]
    logs = logs_of(spark, lines)
    got = {r.text: r.cluster_id for r in C.cluster_logs(logs).collect()}
    assert set(got) == {f"[ERROR] db: {x}" for x in lines[:4]}
    assert got["[ERROR] db: pool exhausted for tenant one"] == got["[ERROR] db: pool exhausted for tenant two"] == "l000"
    members = C.clustered_logs(logs)
    assert members.count() == 5
    assert tuple(C.noise_count(members).first()) == (4, 1)


def test_clusters_do_not_depend_on_row_order(spark):
    lines = [f"user {i % 7} login failed on host {i % 3}" for i in range(40)] + ["other thing"]
    rows = logs_of(spark, lines)
    a = {r.text: r.cluster_id for r in C.cluster_logs(rows).collect()}
    b = {r.text: r.cluster_id for r in C.cluster_logs(rows.orderBy(F.rand(3))).collect()}
    assert a == b


@pytest.mark.parametrize("min_samples", [2, 3, 5])
def test_density_against_brute_force(spark, min_samples):
    rng = random.Random(11)
    lines = [t for _, t in random_texts(11, 80)]
    lines = [rng.choice(lines) for _ in range(160)]
    logs = logs_of(spark, lines)
    weight = {}
    first = {}
    for i, m in enumerate(lines):
        t = f"[ERROR] db: {m}"
        weight[t] = weight.get(t, 0) + 1
        first.setdefault(t, f"l{i:03d}")
    texts = [(first[t], t.lower().replace("[", " ").replace("]", " ").replace(":", " ")) for t in weight]
    near = {i: set() for i, _ in texts}
    for a, b, *_ in brute_pairs(sorted(texts), 3, 4):
        near[a].add(b)
        near[b].add(a)
    w = {first[t]: n for t, n in weight.items()}
    core = {i for i in near if w[i] + sum(w[j] for j in near[i]) >= min_samples}
    root = components_of(sorted(core), [(a, b) for a in core for b in near[a] & core])
    want = {i: root[i] for i in core}
    for i in set(near) - core:
        around = [root[j] for j in near[i] & core]
        if around:
            want[i] = min(around)
    got = {r.id: r.cluster_id for r in C.cluster_logs(logs, min_samples=min_samples).collect()}
    assert got == want


def test_cluster_summary(spark):
    logs = logs_of(spark, ["redis timeout now", "redis timeout now", "redis timeout later", "worker crash"]).withColumn(
        "cluster_id", F.when(F.col("message") != "worker crash", "c1").otherwise("c2"))
    got = {r.id: r for r in C.cluster_summary(logs).collect()}
    assert (got["c1"].name, got["c1"].severity, got["c1"].log_count) == ("Redis/Cache Issues", "high", 3)
    assert got["c1"].representative_messages == ["redis timeout now", "redis timeout now", "redis timeout later"]
    assert (got["c2"].name, got["c2"].severity, got["c2"].tags) == ("Worker Queue Issues", "critical", ["db"])


# ---------------------------------------------------------------- dense vectors

def random_vectors(seed, count=90, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    v = centres[rng.integers(0, 5, count)] + rng.normal(scale=0.35, size=(count, dim))
    v = np.vstack([v, v[:3]]).astype(np.float32)  # a few exact copies
    return [(f"v{i:03d}", [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize("seed, threshold, pivots, block", [(1, 0.9, 4, 8), (2, 0.75, 7, 16), (3, 0.97, 3, 1000), (4, -0.2, 4, 8)])
def test_dense_pairs_and_clusters(spark, seed, threshold, pivots, block):
    rows = random_vectors(seed)
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    first = {}
    for i, v in rows:
        first.setdefault(tuple(v), i)
    unit = {i: np.array(v) / np.linalg.norm(v) for v, i in first.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(unit), 2) if unit[a] @ unit[b] >= threshold}
    got = [(r.id_a, r.id_b) for r in D.similar_vector_pairs(df, threshold, pivots, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {(r.u, r.v) for r in D.vector_links(df, threshold, pivots, block).collect()}
    assert components_of(sorted(unit), links) == components_of(sorted(unit), want)
    root = components_of(sorted(unit), want)
    sizes = {}
    for i, v in rows:
        r = root[first[tuple(v)]]
        sizes[r] = sizes.get(r, 0) + 1
    expected = {i: root[first[tuple(v)]] for i, v in rows if sizes[root[first[tuple(v)]]] >= 2}
    clusters = D.cluster_vectors(df, threshold, pivots=pivots, block_rows=block)
    assert {r.id: r.cluster_id for r in clusters.collect()} == expected


@pytest.mark.parametrize("block", [None, 8])
def test_pairs_of_rows_hold_copies(spark, block):
    """Equal vectors of other ids pair with each other and with all the others; equal rows count as often as they are."""
    rows = random_vectors(6, 40) + [("v000", random_vectors(6, 40)[0][1]), ("w", [0.0] * 6), (None, [1.0] * 6), ("x", None)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    known = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i and v and any(v)]
    want = sorted((a, b) for a, x in known for b, y in known if a < b and x @ y >= 0.75)
    assert ("v000", "v040") in want and len(want) > len(set(want))
    got = D.similar_row_pairs(df, 0.75, 4, block).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == want


@pytest.mark.parametrize("seed, threshold, min_samples, block", [(1, 0.9, 3, 8), (2, 0.97, 4, 16), (3, 0.95, 6, None), (4, 0.8, 12, 8)])
def test_dense_density_clusters(spark, monkeypatch, seed, threshold, min_samples, block):
    """Weights, core points and borders against brute force; pairs are never listed."""
    rows = random_vectors(seed)
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    monkeypatch.setattr(D, "similar_vector_pairs", None)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    near = {a: {b for b in unit if unit[a] @ unit[b] >= threshold} for a in unit}  # with itself
    core = {a for a in unit if len(near[a]) >= min_samples}
    assert core and core != set(unit)
    root = components_of(sorted(core), [(a, b) for a in core for b in near[a] & core])
    want = {a: root[a] for a in core} | {a: min(root[b] for b in near[a] & core) for a in set(unit) - core if near[a] & core}
    got = D.cluster_vectors(df, threshold, min_samples, pivots=4, block_rows=block).collect()
    assert len(got) == len(want) and {r.id: r.cluster_id for r in got} == want


def test_top_k_vectors(spark, monkeypatch):
    rows = random_vectors(9)
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(4)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}

    def nearest(q, k):
        return [i for _, i in sorted((round(1 - unit[q] @ unit[i], 9), i) for i in unit)][:k]

    one = D.find_similar(df, rows[0][1], 7)
    assert [r.id for r in one.collect()] == nearest("v000", 7)
    monkeypatch.setattr(D, "BROADCAST_QUERIES", 2)
    monkeypatch.setattr(D, "QUERY_BLOCK", 3)
    monkeypatch.setattr(D, "CORPUS_CHUNK", 40)
    queries = df.filter(F.col("id") < "v005")
    got = {}
    for r in D.find_similar_batch(df, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {f"v00{i}": nearest(f"v00{i}", 4) for i in range(5)}


@pytest.mark.parametrize("k", [1, 3, 200])
def test_top_k_texts(spark, k):
    docs, queries = random_texts(21), [("q1", "user u1 login"), ("q2", "nothing shared"), ("q3", "x"), ("q4", "")]
    got = {}
    out = S.top_k_texts(spark.createDataFrame(queries, "id string, text string"), spark.createDataFrame(docs, "id string, text string"), k)
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)

    def distance(x, y):
        p, q = tokens(x), tokens(y)
        return round(1 - len(p & q) / (len(p) * len(q)) ** 0.5, 9) if p and q else 1.0

    want = {q: [i for _, i in sorted((distance(x, y), i) for i, y in docs)][:k] for q, x in queries}
    assert got == want


def test_embedding_is_normalised(spark):
    rows = spark.createDataFrame([("a", "xx"), ("b", "")], "id string, text string")
    out = D.embed_texts(rows, lambda ts: np.array([[len(t), 2 * len(t)] for t in ts]))
    got = {r.id: [round(x, 4) for x in r.embedding] for r in out.collect()}
    assert got == {"a": [0.4472, 0.8944], "b": [0.0, 0.0]}


@pytest.mark.parametrize("k", [1, 5])
def test_top_k_scores_few_of_the_pairs_that_share_a_token(spark, k):
    """A common word in every document and query, and near copies: the answers are exact, most pairs are never scored."""
    rnd = random.Random(7)
    docs = []
    for i in range(1500):  # groups of eight near copies
        words = [f"w{rnd.randint(0, 400)}" for _ in range(12)] if i % 8 == 0 else [*docs[i - i % 8][1].split()[1:], f"w{rnd.randint(0, 400)}"]
        docs.append((f"d{i:04d}", "the " + " ".join(words)))
    queries = [(f"q{i:03d}", docs[rnd.randrange(1500)][1] + f" w{rnd.randint(0, 400)}") for i in range(60)]
    d, q = (spark.createDataFrame(x, "id string, text string") for x in (docs, queries))
    got = {}
    for r in S.top_k_texts(q, d, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)

    def distance(x, y):
        a, b = tokens(x), tokens(y)
        return round(1 - len(a & b) / (len(a) * len(b)) ** 0.5, 9)

    assert got == {i: [j for _, j in sorted((distance(x, y), j) for j, y in docs)][:k] for i, x in queries}
    (q_sets, _), (d_sets, _) = S._token_sets(q), S._token_sets(d)
    scored = S.near_sets(q_sets, d_sets, k).count()
    assert scored < q_sets.count() * d_sets.count() / 4, scored  # all pairs share "the"


def test_hot_tokens_are_joined_on_pairs_of_tokens(spark):
    """All tokens are hot and texts differ: candidates stay far below the pairs that share a token, links stay exact."""
    rnd = random.Random(11)
    texts = [(f"t{i:04d}", " ".join(f"w{x}" for x in rnd.sample(range(120), 9))) for i in range(1200)]
    texts += [(f"u{i:04d}", texts[i][1] + " w5") for i in range(0, 100)] + [(f"s{i}", "w7") for i in range(150)]
    frame = spark.createDataFrame(texts, "id string, text string")
    ranked = S.rank_tokens(frame).cache()
    cold, hot = S._by_heat(ranked, (3, 4), 20)
    nodes = S._suffix_nodes(S._suffix_members(hot, ranked))
    shared = nodes.alias("a").join(nodes.alias("b"), "token").count()
    met = S.suffix_candidates(nodes, (3, 4)).count()
    assert met < shared / 4, (met, shared)
    got = {tuple(sorted((r.id_a, r.id_b))) for r in S.similar_pairs(ranked, hot_posting=20).collect()}
    sets = {i: tokens(x) for i, x in texts}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2)
            if 16 * len(sets[a] & sets[b]) ** 2 >= 9 * len(sets[a]) * len(sets[b])}
    assert got == want


@pytest.mark.parametrize("broadcast", [10, 100_000])
def test_long_texts_are_joined_directly(spark, monkeypatch, broadcast):
    """Suffixes of long texts would hold the square of their tokens; wide signatures drop no pair, broadcast or not."""
    rnd = random.Random(5)
    base = [rnd.sample(range(400), 120) for _ in range(40)]
    texts = [(f"b{i:03d}", " ".join(f"w{x}" for x in b)) for i, b in enumerate(base)]
    texts += [(f"c{i:03d}", " ".join(f"w{x}" for x in b[: rnd.randrange(60, 120)] + rnd.sample(range(400, 800), rnd.randrange(30)))) for i, b in enumerate(base)]
    texts += [(f"s{i}", "w7 w8") for i in range(3)]
    monkeypatch.setattr(S, "LONG_SET", 80)
    monkeypatch.setattr(S, "BROADCAST_SETS", broadcast)
    ranked = S.rank_tokens(spark.createDataFrame(texts, "id string, text string")).cache()
    rows, hot = S._by_heat(ranked, (3, 4), 3)
    assert hot is None and rows.groupBy("token").count().filter("count > 3").count() > 100
    want = brute_pairs(texts, 3, 4)
    got = {tuple(r) for r in S.similar_pairs(ranked, (3, 4), 3).collect()}
    assert got == want, (len(got), len(want), sorted(got - want)[:3], sorted(want - got)[:3])
    links = {(r.u, r.v) for r in S.similarity_links(ranked, (3, 4), 3).collect()}
    ids = [i for i, _ in texts]
    assert components_of(ids, links) == components_of(ids, [p[:2] for p in want])


def test_long_texts_are_compared_in_blocks(spark, monkeypatch):
    """Sizes on both sides of the bound and of several signature widths; only short texts meet on prefix tokens."""
    rnd = random.Random(8)
    base = [rnd.sample(range(1500), rnd.choice([40, 60, 70, 130, 300, 700])) for _ in range(60)]
    texts = [(f"b{i:03d}", " ".join(f"w{x}" for x in b)) for i, b in enumerate(base)]
    texts += [(f"c{i:03d}", " ".join(f"w{x}" for x in b[: len(b) - rnd.randrange(len(b) // 2)] + rnd.sample(range(1500, 1900), rnd.randrange(30))))
              for i, b in enumerate(base * 2)]
    texts += [("s", "w7 w8"), ("e", "--")]
    frame = spark.createDataFrame(texts, "id string, text string").repartition(3)
    ranked = S.rank_tokens(frame).cache()
    df = Counter(w for _, t in texts for w in tokens(t))
    rows = {r.id: r.toks for r in ranked.collect()}
    assert rows == {i: sorted(tokens(t), key=lambda w: (df[w], w)) for i, t in texts if i != "e"}
    monkeypatch.setattr(S, "BLOCK_SETS", 20)
    monkeypatch.setattr(S, "CHECKED_SETS", 8)
    meeting, met = S._cold_pairs, []
    monkeypatch.setattr(S, "_cold_pairs", lambda cold, sets, threshold: met.append(sets) or meeting(cold, sets, threshold))
    want = brute_pairs(sorted((i, t) for i, t in texts if i != "e"), 3, 4)
    got = [tuple(r) for r in S.similar_pairs(ranked).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(min(p[3:]) < 64 <= max(p[3:]) for p in want)
    links = {(r.u, r.v) for r in S.similarity_links(ranked).collect()}
    assert components_of([i for i, _ in texts], links) == components_of([i for i, _ in texts], [p[:2] for p in want])
    assert len(met) == 2 and all(m.agg(F.max("n")).first()[0] < S.LONG_TEXT for m in met)


def test_hits_of_a_block_leave_in_tiles(monkeypatch):
    """A block whose vectors are all alike has the square of its rows as hits; only a tile of them is held."""
    import pyarrow as pa

    monkeypatch.setattr(D, "TILE", 4)
    n = 50
    batch = pa.record_batch({
        "kind": ["home"] * n, "i": [0] * n, "j": [0] * n, "side": [0] * n, "id": [f"v{i:02d}" for i in range(n)],
        "embedding": pa.array([[1.0, i / 1000] for i in range(n)], pa.list_(pa.float32()))})
    ids, tiles = D._block_hits(iter([batch.slice(0, 20), batch.slice(20)]), 0.9)
    tiles = [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b, _ in tiles]
    assert max(map(len, tiles)) <= 4 * n and ids.to_pylist() == [f"v{i:02d}" for i in range(n)]
    assert sorted(sum(tiles, [])) == list(itertools.combinations(range(n), 2))

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

from pyspark.sql import types as T

from check import compare, connect
from logharbor.llm import filters

DIR = "/root/testdata/sf0.01"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    # names that the operator uses inside
    *(T.StructField(n, T.StringType()) for n in ("part", "mask", "rows", "prefix", "full", "good", "docs", "letter"))])
LABELS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("doc_id", "quality", "toxic", "good", "l_id")])
WORD = r"[^ \t\n\x0b\x0c\r]+"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], DOCS)


def mask(text):
    words = re.findall(WORD, text)
    return "".join(k for k, fails in (
        ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
        ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", re.search("[#$%&*|]", text))) if fails)


def plain(rows, labels):
    """Every order applied filter by filter to every document."""
    texts = [t or "" for _, t, _ in rows]
    least = {}
    for (i, _, _), t in zip(rows, texts, strict=True):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    docs = []
    for (i, _, source), t in zip(rows, texts, strict=True):
        fails = set(mask(t)) | ({"E"} if i is not None and i > least[t] else set())
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((source or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for *_, x in mine)))
    out = {}
    shapley = Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, k in enumerate(order, 1):
                gone = [d for d in left if k in d[1]]
                left = [d for d in left if k not in d[1]]
                every = [d for d in docs if d[0] == part and k in d[1]]
                out[part, "".join(order), step] = (len(left), len(gone), len(every) - len(gone), sum(d[1] == {k} for d in every),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, k] += len(gone)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def rows_of(frame):
    return {(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in frame.collect()}


def test_audit_against_plain_version(spark):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["Ä", "LOUD", "a#b", "x|"]
    head = " ".join(rnd.choices(words[:60], k=80))
    texts = ["", None, " \t", head, head + " tail", head + " tail two", "é" * 300, "LOUD " * 60, "z " * 20_000] + [
        " ".join(rnd.choices(words, k=rnd.randint(0, 120))) for _ in range(40)]
    rows = [(rnd.choice([None, *range(90)]), rnd.choice(texts), rnd.choice(["a", "b", "", None])) for _ in range(400)]
    labels = [(rnd.choice([None, *range(90)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(120)]
    got = filters.filter_audit(frame(spark, rows).repartition(7), spark.createDataFrame([(*x, 5, 6) for x in labels], LABELS))
    assert rows_of(got) == plain(rows, labels)
    assert got.columns[-1] == "shapley" and got.count() == 3 * 600


def test_empty_tables(spark):
    docs, labels = frame(spark, [(1, "One two.", "a")]), spark.createDataFrame([(1, 1, 1, 5, 6)], LABELS)
    assert filters.filter_audit(docs.limit(0), labels).count() == 0
    assert rows_of(filters.filter_audit(docs, labels.limit(0))) == plain([(1, "One two.", "a")], [])


def test_trie_holds_the_least_id():
    rnd = random.Random(1)
    texts = [b"", b"a", b"ab", b"abc", b"abd", "é".encode(), "è".encode()] + [bytes(rnd.choices(b"ab", k=rnd.randint(0, 12))) for _ in range(200)]
    trie, least = filters.TextTrie(), {}
    for k in range(3000):
        text, i = rnd.choice(texts), rnd.randint(0, 10**6)
        trie.add(text, i, (text, k))
        least[text] = min(i, least.get(text, i))
    found = {rows[0][0]: (low, {r[0] for r in rows}) for low, rows in trie.terminals()}
    assert found == {t: (low, {t}) for t, low in least.items()}


def test_prefixes_grow_where_texts_begin_alike(spark):
    same = "licence " * 40
    texts = [f"{same}{i} {'x' * 50}" for i in range(300)] + [f"{i} other text" for i in range(300)] + [same] * 200 + ["short"] * 50
    rows = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    got = filters.prefixed(rows, 2000).collect()
    sizes, of = Counter(), {}
    for r in got:
        assert r.text.startswith(bytes(r.prefix)) and of.setdefault(bytes(r.text), r.prefix) == r.prefix
        sizes[bytes(r.prefix)] += len(r.text)
    # what holds more is one text
    assert all(n <= 2000 or {bytes(r.text) for r in got if r.prefix == p} == {p} or len(p) > 300 for p, n in sizes.items())
    assert max(len(p) for p in sizes) > 300 and len(of["0 other text".encode()]) == 8


def test_query_against_sql(spark):
    got = filters.op13_filter_audit(spark, DIR).toArrow()
    assert compare(got, connect(DIR).sql(filters.OP13_SQL).to_arrow_table()) is None

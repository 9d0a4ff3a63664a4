from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logharbor.llm import jaccard, pii, toxicity
from tests.llm import brute

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    at, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, DIR)
        if name != "mixing":
            assert out.columns == docs.columns
        at = corpus_pipeline.save(out, name)
        left[name] = {r.doc_id: r for r in at.collect()}
    predicted = {r.doc_id for r in toxicity.score_toxicity(docs, labels).filter("predicted = 1").collect()}
    assert set(left["toxicity"]) == set(rows) - predicted
    groups = brute.jaccard([(i, r.text) for i, r in left["toxicity"].items()])
    assert set(left["near_duplicates"]) == {i for i, (_, root) in groups.items() if root == i}
    assert set(left["decontamination"]) <= set(left["near_duplicates"])
    assert set(left["personal_data"]) == set(left["decontamination"])
    for i, r in left["personal_data"].items():
        if not brute.personal(rows[i].text):
            assert r.text == rows[i].text
        else:
            assert r.text != rows[i].text and "@example" not in r.text
    assert set(left["mixing"]) <= set(left["personal_data"])
    assert jaccard and pii


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns[-1] == "copy" and got.count() > 0


CLASHES = ("copy", "mixed", "mix_text", "mix_place", "mix_id", "spans_base", "spans_terms", "base", "terms", "row", "id", "key", "place", "n",
           "bad_id", "bad_key", "text_key", "task", "role", "score", "first", "first_id", "set_id", "span_id", "hit_id")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, empty and repeated rows, a long text, and columns named like those that stages use inside."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "a"), (2, words + " end", "a"), (None, words + " end two", None), (None, words, "b"), (None, None, None), (3, "", "a"),
            (3, "", "a"), (4, None, "b"), (5, " ".join(f"w{i % 977}" for i in range(40_000)), "b"), (6, "write to ann@example.com today please", "a"),
            (6, "write to ann@example.com today please", "a"), (7, "another short text", None)]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHES), F.create_map(F.lit("k"), F.lit(1)).alias("map"))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_names(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, DIR)
    assert got.columns[:len(odd.columns)] == odd.columns
    for r in got.collect():
        assert all(r[c] == f"mine {c}" for c in CLASHES) and r["map"] == {"k": 1}
    assert stage(spark, odd.limit(0), DIR).count() == 0
    if name == "near_duplicates":
        # all near copies are one group, also through rows without an id
        left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect())
        assert [x[:2] for x in left] == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]
    if name == "personal_data":
        assert {r.text for r in got.filter("doc_id = 6").collect()} == {"write to [EMAIL] today please"} and got.count() == odd.count()
    if name == "mixing":
        assert got.columns[-1] == "copy_2"


def test_all_stages_in_a_row_on_odd_rows(spark, odd):
    at = odd
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, DIR)
    assert at.count() > 0 and set(odd.columns) < set(at.columns)


def test_links_go_through_documents_without_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words[6:], *(f"x{i}" for i in range(6))]), " ".join([*words[12:], *(f"x{i}" for i in range(12))])
    got = jaccard.jaccard_groups(spark.createDataFrame([(1, a), (None, b), (2, c)], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, None: 1}

"""Quality selection by importance resampling on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import Words, save, slices, table

#: Buckets of the hashed n-grams, longest n-gram, labelled documents of the target model at most.
BUCKETS, LONGEST, TARGET_SAMPLE = 10_000, 2, 10_000
SEED = 17
#: Rows of the last bin that are ranked at once, and bins of a round.
RANKED, BINS = 20_000, 512


def _grams(column: pa.Array, buckets: int, longest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from row, rows, row of each n-gram, bucket of each n-gram)``."""
    for at, to, data, bounds in slices(column):
        words = Words(data, bounds)
        rows, marks = [], []
        for n in range(1, longest + 1):
            begin, h = words.runs(n)
            rows.append(words.row[begin])
            marks.append((h % np.uint64(buckets)).astype(np.int64))
        yield at, to - at, np.concatenate(rows), np.concatenate(marks)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """n-grams per bucket over all rows; one array of fixed size per task is summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, mark in _grams(batch.column("text"), buckets, longest):
                total += np.bincount(mark, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    summed = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for r in summed.collect():
        counts[r.bucket] = r.n
    return counts


def _weights_task(ratio: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, n, row, mark in _grams(batch.column("text"), len(ratio), longest):
                out[at: at + n] = np.bincount(row, weights=ratio[mark], minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out)],
                                             ["doc_id", "text_key", "log_weight"])
    return run


def top_k(rows: DataFrame, key: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of the largest ``key``, by ``tie`` where equal, without a global sort.

    Counting in bins narrows the place of the k-th row until few rows are left to
    rank; every round passes over the keys alone.
    """
    kept, open_rows, left = None, rows, k
    while left > 0:
        n = open_rows.count()
        if n <= left:
            return open_rows if kept is None else kept.unionByName(open_rows)
        edges = []
        if n > RANKED:
            points = [i / BINS for i in range(1, BINS)]
            edges = sorted(set(open_rows.agg(F.percentile_approx(key, points, 10_000)).first()[0]))
        place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(key))) if edges else F.lit(0)
        counts = {r.bin: r["count"] for r in open_rows.groupBy(place.alias("bin")).count().collect()}
        if len(counts) == 1:
            # few rows, or equal keys: rank them
            last = open_rows.orderBy(F.desc(key), tie).limit(left)
            return last if kept is None else kept.unionByName(last)
        full = []
        for b in sorted(counts, reverse=True):
            if counts[b] > left:
                break
            full.append(b)
            left -= counts[b]
        if full:
            part = open_rows.filter(place >= full[-1])
            kept = part if kept is None else kept.unionByName(part)
        open_rows = open_rows.filter(place == b)
    return rows.limit(0) if kept is None else kept


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``log_weight``, ``sample_key`` of the documents that are kept.

    Two models of hashed one- and two-word counts are trained: of target text
    (documents labelled good, a bounded sample) and of all raw text.  The log ratio
    of a document under them, plus Gumbel noise from its id and the seed, is its
    key; the ``share`` of all documents with the largest keys is a sample without
    replacement in proportion to the importance weights.  ``share`` is by default
    the share of good labels.

    Null and empty texts weigh nothing (log weight 0).  Ties go to the smaller id.
    Repeated rows get equal keys.  A null id is kept as an id.  Without good labels
    every row is kept with weight 0.  Other columns are ignored.
    """
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    good = (marks.filter("quality = 1").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(TARGET_SAMPLE)
            .select(F.col("doc_id").alias("good_id")))
    raw = bucket_counts(texts)
    # ids of a bounded sample
    target = bucket_counts(texts.join(F.broadcast(good), F.col("doc_id") == F.col("good_id"))) if total.get(1) else raw
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    if share is None:
        share = total.get(1, 0) / max(1, sum(total.values())) if total.get(1) else 1.0
    weighed = texts.mapInArrow(_weights_task(ratio, LONGEST), "doc_id bigint, text_key bigint, log_weight double")
    # a uniform number in (0, 1) from the id
    uniform = (F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = save(weighed.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("sample_key")), "keys")
    return top_k(keyed, "sample_key", "doc_id", round(share * keyed.count()))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import Words, save, signed, slices, table

WINDOW = 20
_ROW = "doc_id bigint, text_key bigint"


def _rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _level(length: int, window: int) -> int:
    """Shortest length of the ladder ``window / 2**k`` that is not under ``length``."""
    while window % 2 == 0 and window // 2 >= length:
        window //= 2
    return window


def selected(words: Words, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The run of ``length`` words with the smallest hash in each window of ``window`` words.

    Equal windows select equal runs at equal offsets, so looking at selected runs
    alone loses no repeated window.  Returns the first word of every window, the
    first word of its selected run, and the distinct selected runs with hashes.
    """
    at, h = words.runs(length)
    begin, _ = words.runs(window)
    if not len(begin):
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    slot = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    slot[at] = h
    span = window - length + 1
    seen = np.lib.stride_tricks.sliding_window_view(slot[: len(words) - length + 1], span)
    pick = begin + _argmin(seen, begin)
    run = np.unique(pick)
    return begin, pick, run, slot[run]


def _argmin(view: np.ndarray, rows: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), block):
        out[i: i + block] = view[rows[i: i + block]].argmin(axis=1)
    return out


def _runs_task(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column("doc_id"), batch.column("text_key")
            for at, _, data, bounds in slices(batch.column("text")):
                words = Words(data, bounds)
                _, _, run_at, h = selected(words, length, window)
                row = pa.array(words.row[run_at] + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h)), doc.take(row), key.take(row),
                     pa.array((run_at - words.first[words.row[run_at]]).astype(np.int32))],
                    ["h", "doc_id", "text_key", "pos"])
    return run


def _extend_task(length: int, window: int):
    """Hashes of the windows whose selected run is among the repeated ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, hits = batch.column("doc_id"), batch.column("text_key"), batch.column("hits")
            for at, to, data, bounds in slices(batch.column("text")):
                words = Words(data, bounds)
                begin, pick, _, _ = selected(words, length, window)
                if not len(begin):
                    continue
                part = hits.slice(at, to - at)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                sizes = part.value_lengths().to_numpy(zero_copy_only=False)
                good = np.zeros(len(words), bool)
                good[np.repeat(words.first[:-1], sizes) + flat] = True
                chosen = good[pick]
                _, h = words.runs(window)
                begin, h = begin[chosen], h[chosen]
                # the same window before in the same text
                order = np.lexsort((begin, h, words.row[begin]))
                again = np.zeros(len(begin), bool)
                again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (words.row[begin[order[1:]]] == words.row[begin[order[:-1]]])
                row = pa.array(words.row[begin] + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h)), doc.take(row), key.take(row),
                     pa.array((begin - words.first[words.row[begin]]).astype(np.int32)), pa.array(again)],
                    ["h", "doc_id", "text_key", "pos", "again"])
    return run


def _cut_task(window: int):
    """Remove the words under the given window starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
            for at, to, data, bounds in slices(batch.column("text")):
                words = Words(data, bounds)
                raw = data.tobytes()
                for i in range(to - at):
                    first, last = words.first[i], words.first[i + 1]
                    n = last - first
                    cover = np.zeros(n + 1, np.int64)
                    if (starts := hits[at + i].values) is not None and len(starts):
                        starts = starts.to_numpy(zero_copy_only=False)
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, np.minimum(starts + window, n), -1)
                    keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0) + first
                    out["n_words"].append(int(n))
                    out["n_removed"].append(int(n - len(keep)))
                    out["kept"].append(b" ".join(
                        [raw[a:b] for a, b in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                 pa.array(out["kept"], pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])
    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose hash occurs more than once.

    The count is combined before the shuffle and written, so that the join back
    has a shuffle of its own, which Spark splits where a hash is hot.
    """
    often = save(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    return rows.join(often, "h", "left_semi")


def _later(windows: DataFrame) -> DataFrame:
    """Windows that also start earlier: in a text of a smaller id, or before in their own."""
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    heads = save(windows.groupBy("h").agg(F.min(place).alias("head"), F.max(place).alias("last"), F.max("again").alias("any"))
                 .filter("head < last OR any").select("h", "head"), "heads")
    return windows.join(heads, "h").filter(F.col("again") | (place > F.col("head")))


def _hits(rows: DataFrame) -> DataFrame:
    """Positions of each text as one array; its size is bounded by the text."""
    return rows.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("hits"))


def _with_hits(texts: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    right = hits.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    on = texts.doc_id.eqNullSafe(right.hit_id) & (texts.text_key == right.hit_key)
    return texts.join(right, on, how).select("doc_id", "text_key", "text", "hits")


def remove_repeats(docs: DataFrame, window: int = WINDOW, first_length: int = WINDOW // 2) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (remaining words, one space between).

    Windows repeated at a length are extended to twice that length, from
    ``first_length`` words up to ``window``; a level without survivors ends the
    work.  At every level only the run of smallest hash in each full window is
    looked at.  A word goes if a window over it also starts earlier: at a smaller
    doc_id (null before all), or earlier in the same text.  Windows are judged on
    the input.

    Null or empty texts give 0 words and an empty string.  Texts shorter than the
    window stay whole.  Rows that repeat an id do not remove words from each
    other.  Other columns are ignored.  Runs are compared by 64-bit
    hashes.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = f"h bigint, {_ROW}, pos int"
    length = _level(first_length, window)
    rows = texts.mapInArrow(_runs_task(length, window), schema)
    hits = save(_hits(_repeated(rows)), "repeats")
    while length * 2 < window and not hits.isEmpty():
        rows = _with_hits(texts, hits, "inner").mapInArrow(_wider_task(length, length * 2, window), schema)
        hits = save(_hits(_repeated(rows)), "repeats")
        length *= 2
    if not hits.isEmpty():
        windows = save(_with_hits(texts, hits, "inner").mapInArrow(
            _extend_task(length, window), f"{schema}, again boolean"), "windows")
        hits = save(_hits(_later(windows)), "repeats")
    return _with_hits(texts, hits, "left").mapInArrow(
        _cut_task(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def _wider_task(length: int, wider: int, window: int):
    """Selected runs of ``wider`` words in windows whose shorter selected run is repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, hits = batch.column("doc_id"), batch.column("text_key"), batch.column("hits")
            for at, to, data, bounds in slices(batch.column("text")):
                words = Words(data, bounds)
                begin, pick, _, _ = selected(words, length, window)
                if not len(begin):
                    continue
                part = hits.slice(at, to - at)
                good = np.zeros(len(words), bool)
                good[np.repeat(words.first[:-1], part.value_lengths().to_numpy(zero_copy_only=False))
                     + part.flatten().to_numpy(zero_copy_only=False)] = True
                _, longer, _, _ = selected(words, wider, window)
                run_at = np.unique(longer[good[pick]])
                at_w, h = words.runs(wider)
                row = pa.array(words.row[run_at] + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h[np.searchsorted(at_w, run_at)])), doc.take(row), key.take(row),
                     pa.array((run_at - words.first[words.row[run_at]]).astype(np.int32))],
                    ["h", "doc_id", "text_key", "pos"])
    return run


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

"""Toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import table

#: Labelled documents the model is fitted on, at most, per class; longer texts are left out of the fit.
TOXIC_SAMPLE, ORDINARY_SAMPLE, FIT_CHARS = 2000, 4000, 40_000
#: Words of a compression window, bytes of the ordinary dictionary, compression level, bytes of the shortest match.
WINDOW, DICTIONARY_BYTES, LEVEL, MATCH = 6, 4096, 3, 7
#: Share of chance finds to expect among the telling beginnings of words (Benjamini and Hochberg).
CHANCE = 0.01
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Wider spaces: beginnings of words make longer matches, and short ones by chance fall below the shortest match.
_SPACE = b"   "
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_EDGES = b".,!?;:\"'()[]{}%$#&*-"


@dataclass(frozen=True)
class Model:
    """Contents of the two dictionaries, and the calibration of what their lengths differ by."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode())


def _widen(data: bytes) -> bytes:
    return data.replace(b" ", _SPACE)


def _beginnings(text: str) -> set[bytes]:
    found = set()
    for w in _words(text):
        w = b" " + w.strip(_EDGES)
        found.update(w[:k] for k in range(5, min(len(w), 12) + 1))
        found.add(w)
    return found


def without_copies(texts: list[str]) -> list[str]:
    """The texts that share none of their four smallest shingle hashes with one before: near copies count once."""
    seen: set[int] = set()
    kept = []
    for text in texts:
        words = _words(text)
        least = sorted({zlib.crc32(b" ".join(words[i: i + 5])) for i in range(max(1, len(words) - 4))})[:4]
        if not seen.intersection(least):
            kept.append(text)
        seen.update(least)
    return kept


def telling_beginnings(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Shortest word beginnings that stand in toxic text more often than by chance, grown while they lose little; rare ones first."""
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)
    seen, usual = Counter(), Counter()
    for text in toxic:
        seen.update(_beginnings(text))
    for text in ordinary:
        usual.update(_beginnings(text))
    if not toxic or not ordinary:
        return []
    # were a beginning no matter of toxicity, its texts would be toxic by the share of the samples
    share = len(toxic) / (len(toxic) + len(ordinary))
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(toxic) + len(ordinary) + 1)))])

    @lru_cache(maxsize=None)
    def chance(k: int, n: int) -> float:
        j = np.arange(k, n + 1)
        return float(np.exp(logs[n] - logs[j] - logs[n - j] + j * np.log(share) + (n - j) * np.log1p(-share)).sum())

    by_chance = sorted((chance(n, n + usual[s]), s) for s, n in seen.items() if n > share * (n + usual[s]))
    known = max((k for k, (p, _) in enumerate(by_chance, 1) if p <= CHANCE * k / len(seen)), default=0)
    good = {s for _, s in by_chance[:known]}
    shortest = [s for s in good if not any(s[:k] in good for k in range(5, len(s)))]
    grown = set()
    for s in shortest:
        while longer := [o for o in good if len(o) == len(s) + 1 and o.startswith(s) and seen[o] >= 0.9 * seen[s]]:
            s = max(longer, key=lambda o: (seen[o], o))
        grown.add(s)
    return sorted(grown, key=lambda s: (seen[s], s))


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Dictionary contents for ordinary and toxic text.

    The first is trained by zstandard on windows of the whole ordinary texts.  The
    second is not zstandard's choice: the telling beginnings of toxic text follow the
    first, so that both compress ordinary text alike.  Dictionaries that zstandard
    trained on toxic text found far less (see README).
    """
    samples = []
    for text in ordinary:
        words = _words(text)
        samples += [b" ".join(words[i: i + 24]) for i in range(0, len(words), 24)]
    try:
        usual = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()[256:]
    except zstandard.ZstdError:  # too little text to train on
        usual = b" ".join(samples)[-DICTIONARY_BYTES:]
    usual = _widen(usual)
    return usual, usual + _widen(b"".join(telling_beginnings(toxic, ordinary)))


class Gauge:
    """Differences of the window lengths of a text under the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = (self._compressor(c) for c in (ordinary, toxic))

    @staticmethod
    def _compressor(content: bytes):
        kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MATCH, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_dict_id=False)
        kind.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=kind, compression_params=settings)

    def features(self, text: str | None) -> list[float]:
        words = _words(text)
        a, b = self.ordinary.compress, self.toxic.compress
        gaps = [0]
        for i in range(0, len(words), WINDOW):
            window = _widen(b" " + b" ".join(words[i: i + WINDOW]))
            gaps.append(len(a(window)) - len(b(window)))
        gap = np.sort(np.array(gaps))[::-1]
        n = len(gap)
        counts = [int((gap >= k).sum()) for k in (1, 2, 4)]
        return [float(gap[0]), float(gap[:3].sum()), *(c / n for c in counts), *np.log1p(counts), float(np.log(n))]


def _fit(rows: np.ndarray, labels: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic calibration by Newton steps; classes weighted to the share of toxic labels."""
    center, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(rows)), (rows - center) / scale])
    weight = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum())) * len(rows)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
    return w, center, scale


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of the labels that are not held out; None without both classes."""
    marks = labels.filter(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not total.get(1) or not total.get(0):
        return None
    # only labels that a document of the fit has count towards the bound; of several texts of an id the one of least hash is taken
    key = F.min(F.xxhash64("text")).alias("text_key")
    marks = docs.filter(F.length("text") <= FIT_CHARS).groupBy("doc_id").agg(key).join(marks, "doc_id")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = None
    for value, limit in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE)):
        part = marks.filter(F.col("toxic") == value).orderBy(order, "doc_id").limit(limit)
        picked = part if picked is None else picked.unionByName(part)
    # a few thousand ids at most by the limits above
    picked = F.broadcast(picked.select(F.col("doc_id").alias("label_id"), "toxic", "text_key"))
    on = (F.col("doc_id") == F.col("label_id")) & (F.xxhash64("text") == F.col("text_key"))
    rows = docs.select("doc_id", "text").join(picked, on).select("label_id", "toxic", "text").dropDuplicates(["label_id"]).collect()
    if {r.toxic for r in rows} != {0, 1}:
        return None
    rows.sort(key=lambda r: r.label_id)
    # one half of each class trains the dictionaries, the other calibrates
    halves: tuple[list, list] = ([], [])
    for value in (1, 0):
        for i, r in enumerate(r for r in rows if r.toxic == value):
            halves[i % 2].append(r)
    usual, toxic = train_dictionaries(*([r.text for r in halves[0] if r.toxic == v] for v in (1, 0)))
    gauge = Gauge(usual, toxic)
    fit = halves[1] or halves[0]
    x, y = np.array([gauge.features(r.text) for r in fit]), np.array([r.toxic for r in fit], float)
    w, center, scale = _fit(x, y, total[1] / (total[0] + total[1]))
    return Model(usual, toxic, tuple(w), tuple(center), tuple(scale))


def _score_task(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge = Gauge(model.ordinary, model.toxic)
        w, center, scale = (np.array(x) for x in (model.weights, model.center, model.scale))
        for batch in batches:
            scores = []
            for text in batch.column(batch.num_columns - 1):
                x = (np.array(gauge.features(text.as_py())) - center) / scale
                scores.append(float(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())],
                                             [*batch.schema.names[:-1], "score"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    Every window of a text is compressed under a dictionary of ordinary text and
    one of toxic text; a calibrated function of the length differences is the
    score.  Labels are learned only from rows whose crc32 of the id, modulo 4, is
    not 2.

    Null and empty texts have no windows and score as such; without labels of both
    classes every score is 0.  Repeated rows give repeated rows; a null id is kept
    and not held out; a document labelled twice is toxic if any label says so;
    other columns are ignored.
    """
    model = train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "text")
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        scored = rows.mapInArrow(_score_task(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns.

    Rows are scored where they are read; nothing is shuffled.
    """
    model = train(docs, labels)
    if model is None:
        return docs
    names = docs.columns
    at = names.index("text")
    score = _score_task(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            scores = next(score(iter([one]))).column(0)
            yield batch.filter(pa.array(scores.to_numpy() < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

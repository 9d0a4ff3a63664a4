"""Similarity of dense vectors: search, pairs and links.

Numpy runs inside tasks on bounded blocks; Spark partitions and shuffles them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.functions import vectors as V
from logharbor.operators.lookups import first_per_group, metadata_filter
from logharbor.session import cut_lineage

# Rows of a block that is assigned or compared at once; bytes of the larger blocks that rows travel in, and how many
# of them all rows make at least: a row travels to each block it may have partners in.
BLOCK_ROWS, BLOCK_BYTES, LEAST_BLOCKS = 2048, 32 << 20, 16
# Left rows of a block that are compared, and whose hits leave the task, at once.
TILE = 128
# Queries that travel with the tasks; beyond that, queries of a block, corpus rows
# of a chunk, and queries compared at once inside a task.
BROADCAST_QUERIES, QUERY_BLOCK, CORPUS_CHUNK, QUERY_SLICE = 1024, 8192, 16384, 256


# ---------------------------------------------------------------- embedding

def embed_texts(
    rows: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 64
) -> DataFrame:
    """Unit vectors of ``text`` by the caller's model, batched per task (V1).

    ``rows`` has id and text; ``embed`` maps a list of texts to an N x D array.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                v = np.asarray(embed(part["text"].tolist()), dtype=np.float32)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(length == 0, 1, length)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": list(v)})

    return rows.select("id", "text").mapInPandas(run, "id string, embedding array<float>")


# ---------------------------------------------------------------- top-k search

def find_similar(
    corpus: DataFrame, query: list[float], k: int = K.TOP_LOGS,
    level: str | None = None, service: str | None = None,
) -> DataFrame:
    """The ``k`` nearest rows of ``corpus`` to one query vector.

    Filters come before scoring; the top-k runs per task before the merge.
    """
    hits = metadata_filter(corpus, level, service)
    distance = 1 - V.cosine(F.col("embedding"), V.as_vector(query))
    scored = hits.withColumn("distance", distance)
    return scored.orderBy(F.round("distance", 9), "id").limit(k)


def _unit(vectors) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def find_similar_batch(corpus: DataFrame, queries: DataFrame, k: int = K.TOP_LOGS) -> DataFrame:
    """The ``k`` nearest rows for every query row (both: id, embedding) (V4, V5).

    A few queries travel with the tasks of one pass over the corpus.  More are
    dealt into blocks, the corpus into chunks, and every task compares a block with
    a chunk.  Either way a task keeps ``k`` rows per query, so no pair list is built.
    """
    schema = "query_id string, doc_id string, distance double"
    queries, corpus = queries.select("id", "embedding"), corpus.select("id", "embedding")
    few = queries.limit(BROADCAST_QUERIES + 1).collect()  # bounded
    if len(few) <= BROADCAST_QUERIES:
        task = _top_k_task([r["id"] for r in few], _unit([r["embedding"] for r in few]), k)
        local = corpus.mapInPandas(task, schema)
    else:
        blocks = -(-queries.count() // QUERY_BLOCK)
        chunks = max(1, -(-corpus.count() // CORPUS_CHUNK))
        part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = queries.withColumn("block", part(blocks)).withColumn("chunk", every(chunks))
        # names of their own: both sides may come from one table
        right = corpus.select(F.col("id").alias("doc_id"), F.col("embedding").alias("vector"), part(chunks).alias("chunk"))
        right = right.withColumn("block", every(blocks))
        local = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(
            _block_task(k), schema)
    return first_per_group(local, "query_id", [F.round("distance", 9), "doc_id"], k)


def _block_task(k: int):
    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(docs):  # an empty side has no columns
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
        docs = docs.rename(columns={"doc_id": "id", "vector": "embedding"})
        return _nearest(queries["id"].to_numpy(), _unit(queries["embedding"]), docs, k)

    return run


def _nearest(ids: np.ndarray, matrix: np.ndarray, docs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of ``docs`` for each query, ties by id; neither side is empty."""
    docs = docs.sort_values("id")
    names, unit = docs["id"].to_numpy(), _unit(docs["embedding"])
    queries, found, distances = [], [], []
    for start in range(0, len(ids), QUERY_SLICE):
        distance = 1 - matrix[start:start + QUERY_SLICE] @ unit.T
        for query, row in zip(ids[start:start + QUERY_SLICE], distance, strict=True):
            rounded = row.round(9)
            last = np.partition(rounded, k - 1)[k - 1] if len(rounded) > k else np.inf
            near = np.flatnonzero(rounded <= last)
            near = near[np.argsort(rounded[near], kind="stable")][:k]
            queries.append(np.repeat(query, len(near)))
            found.append(names[near])
            distances.append(row[near])
    return pd.DataFrame({
        "query_id": np.concatenate(queries), "doc_id": np.concatenate(found), "distance": np.concatenate(distances)})


def _top_k_task(ids: list, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for pdf in batches:
            if not len(pdf) or not ids:
                continue
            found = _nearest(np.array(ids, dtype=object), matrix, pdf, k)
            best = found if best is None else pd.concat([best, found], ignore_index=True)
            order = best.assign(_r=best["distance"].round(9)).sort_values(["query_id", "_r", "doc_id"])
            best = order.groupby("query_id", sort=False).head(k).drop(columns="_r")
        if best is not None:
            yield best

    return run


# ---------------------------------------------------------------- pairs and links

def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Equal vectors once: smallest id and weight; zero vectors match nothing."""
    return (
        vectors.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
        .filter(V.norm(F.col("embedding")) > 0)
    )


def distinct_rows(vectors: DataFrame) -> DataFrame:
    """Equal rows once with their number as weight; equal vectors of other ids stay rows of their own."""
    named = vectors.filter(F.col("id").isNotNull() & (V.norm(F.col("embedding")) > 0))
    return named.groupBy("id", "embedding").agg(F.count("*").alias("weight"))


def _assign_cells(distinct: DataFrame, threshold: float, pivots: int) -> DataFrame:
    """Every vector in its nearest pivot's cell, plus the cells its partners may call home.

    Angles obey the triangle inequality: a partner within angle t whose home is p
    implies angle(x, p) <= angle(x, home of x) + 2t.  A pair is compared in the
    lower-numbered home only.
    """
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # bounded
    centre = _unit([r["embedding"] for r in sample])
    reach = 2 * math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (batch.iloc[at:at + BLOCK_ROWS] for batch in batches for at in range(0, len(batch), BLOCK_ROWS)):
            angle = np.arccos(np.clip(_unit(pdf["embedding"]) @ centre.T, -1, 1))
            home = angle.argmin(axis=1)
            near = angle[np.arange(len(pdf)), home]
            cells = np.arange(centre.shape[0])
            inside = (cells[None, :] == home[:, None]) | (
                (cells[None, :] < home[:, None]) & (angle <= near[:, None] + reach)
            )
            row, cell = np.nonzero(inside)
            out = pdf.iloc[row].reset_index(drop=True)
            out["cell"] = cell.astype(np.int32)
            out["home"] = cell == home[row]
            yield out[[*kept, "cell", "home"]]

    kept = ["id", "weight", "embedding", *(["core"] if "core" in distinct.columns else [])]
    schema = "id string, weight long, embedding array<float>" + ", core boolean" * (len(kept) > 3) + ", cell int, home boolean"
    return distinct.select(*kept).mapInPandas(run, schema)


def _block_tasks(cells: DataFrame, block_rows: int) -> DataFrame:
    """Cut every cell into blocks and replicate rows to the block pairs they are in.

    A cell with a third of all vectors becomes many bounded groups.  Home blocks
    meet each other once (i <= j) and every visiting block once.
    """
    sizes = cells.groupBy("cell").agg(
        F.greatest(F.ceil(F.count_if("home") / block_rows), F.lit(1)).alias("homes"),
        F.ceil(F.count_if(~F.col("home")) / block_rows).alias("visits"),
    )
    rows = cells.join(sizes, "cell")  # one row per pivot on the right
    number = F.pmod(F.xxhash64("id", "embedding"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits")))
    rows = rows.withColumn("b", number)
    last_home, last_visit = F.col("homes") - 1, F.col("visits") - 1

    def pairs(left, right, kind, side):
        return F.struct(F.lit(kind).alias("kind"), left.alias("i"), right.alias("j"), F.lit(side).alias("side"))

    b = F.col("b")
    as_left = F.transform(F.sequence(b, last_home), lambda j: pairs(b, j, "home", 0))
    as_right = F.when(b > 0, F.transform(F.sequence(F.lit(0).cast("long"), b - 1), lambda i: pairs(i, b, "home", 1)))
    to_visits = F.when(
        last_visit >= 0,
        F.transform(F.sequence(F.lit(0).cast("long"), last_visit), lambda j: pairs(b, j, "visit", 0)),
    )
    visiting = F.transform(F.sequence(F.lit(0).cast("long"), last_home), lambda i: pairs(i, b, "visit", 1))
    none = F.array().cast("array<struct<kind:string,i:bigint,j:bigint,side:int>>")
    at_home = F.concat(as_left, F.coalesce(as_right, none), F.coalesce(to_visits, none))
    task = F.explode(F.when(F.col("home"), at_home).otherwise(visiting))
    kept = [c for c in cells.columns if c not in ("cell", "home")]
    return rows.withColumn("t", task).select("cell", "t.kind", "t.i", "t.j", "t.side", *kept)


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks)


def _block_hits(batches: Iterable[pa.RecordBatch], threshold: float) -> tuple[pa.Array, Iterator[tuple]]:
    """Ids of a block pair, and its hits as left and right numbers and cosines.

    ``TILE`` left rows are compared with ``BLOCK_ROWS`` right ones at a time.
    """
    table = pa.Table.from_batches(list(batches))
    vectors = _column(table, "embedding")
    unit = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    unit /= np.where(length == 0, 1, length)
    side = table.column("side").to_numpy()
    first = table.select(["kind", "i", "j"]).slice(0, 1).to_pylist()[0]
    left = np.flatnonzero(side == 0)
    same = first["kind"] == "home" and first["i"] == first["j"]
    right = left if same else np.flatnonzero(side == 1)

    def tiles():
        for start in range(0, len(left), TILE):
            rows = left[start:start + TILE]
            for at in range(start // BLOCK_ROWS * BLOCK_ROWS if same else 0, len(right), BLOCK_ROWS):
                columns = right[at:at + BLOCK_ROWS]
                cos = unit[rows] @ unit[columns].T
                hit = cos >= threshold
                if same and at <= start + TILE:
                    hit = np.triu(hit, start - at + 1)
                r, c = np.nonzero(hit)
                yield rows[r], columns[c], cos[r, c]

    return _column(table, "id"), tiles()


class _Forest:
    """Sets of row numbers, joined along hits; the hits that joined two sets are a spanning forest."""

    def __init__(self, rows: int):
        self.parent, self.edges = np.arange(rows), []

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        before = len(self.edges)
        apart = self.parent[a] != self.parent[b]  # the others are in one set already
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.edges.append((x, y))
                self.parent[q] = p
        if len(self.edges) > before:
            self.roots()

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent


def _blocks(distinct: DataFrame, threshold: float, pivots: int, block_rows: int | None):
    """Rows of every pair of blocks, as groups.  Blocks grow with the rows, as each is sent to all it may match."""
    if block_rows is None:
        rows, width = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
        block_rows = min(max(BLOCK_ROWS, -(-rows // LEAST_BLOCKS)), max(BLOCK_ROWS, BLOCK_BYTES // (8 * (width or 1))))
    cells = cut_lineage(_assign_cells(distinct, threshold, pivots))
    return _block_tasks(cells, block_rows).groupBy("cell", "kind", "i", "j")


def _pairs_task(threshold: float):
    """Hits of a block pair, smaller id on the left; rows of one id are no pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, tiles = _block_hits(table.to_batches(), threshold)
        weight = _column(table, "weight")
        rank = np.unique(np.array(ids.to_pylist(), object), return_inverse=True)[1]
        for a, b, cos in tiles:
            a, b = np.where(rank[a] > rank[b], b, a), np.where(rank[a] > rank[b], a, b)
            other = rank[a] != rank[b]
            a, b = pa.array(a[other]), pa.array(b[other])
            yield pa.RecordBatch.from_arrays(
                [ids.take(a), ids.take(b), pa.array(cos[other]), weight.take(a), weight.take(b)],
                ["id_a", "id_b", "cosine", "weight_a", "weight_b"])

    return compare


PAIR = "id_a string, id_b string, cosine double, weight_a long, weight_b long"


def similar_vector_pairs(
    vectors: DataFrame, threshold: float, pivots: int = 16, block_rows: int | None = None
) -> DataFrame:
    """All pairs of distinct vectors with cosine >= threshold, id_a < id_b (J9, dense)."""
    tasks = _blocks(cut_lineage(distinct_vectors(vectors)), threshold, pivots, block_rows)
    return tasks.applyInArrow(_pairs_task(threshold), PAIR).select("id_a", "id_b", "cosine")


def similar_row_pairs(
    vectors: DataFrame, threshold: float, pivots: int = 16, block_rows: int | None = None
) -> DataFrame:
    """All pairs of rows with cosine >= threshold and id_a < id_b, those of equal vectors too (J9, dense).

    Equal rows are compared once and give as many pairs as they are.
    """
    tasks = _blocks(cut_lineage(distinct_rows(vectors)), threshold, pivots, block_rows)
    pairs = tasks.applyInArrow(_pairs_task(threshold), PAIR)
    for x in "ab":
        pairs = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"weight_{x}")))).drop("copy")
    return pairs.select("id_a", "id_b", "cosine")


def vector_links(
    vectors: DataFrame, threshold: float, pivots: int = 16, block_rows: int | None = None
) -> DataFrame:
    """Edges ``u``, ``v`` that connect exactly what similarity connects (V6, dense).

    Every block pair reports a spanning forest of its similarity graph: at most
    one edge per vector in the block instead of all its pairs.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tiles = _block_hits(batches, threshold)
        sets = _Forest(len(ids))
        for a, b, _ in tiles:
            sets.join(a, b)
        u, v = np.array(sets.edges, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v))], ["u", "v"])

    return _blocks(cut_lineage(distinct_vectors(vectors)), threshold, pivots, block_rows).applyInArrow(forest, "u string, v string")


def _weights_around(points: DataFrame, threshold: float, pivots: int, block_rows: int | None) -> DataFrame:
    """``id``, ``around``: weight of the other points that are similar, for points that have any.

    A block pair sums the weights of its hits, so no pair leaves a task.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, tiles = _block_hits(table.to_batches(), threshold)
        weight, around = _column(table, "weight").to_numpy(), np.zeros(len(ids), np.int64)
        for a, b, _ in tiles:
            np.add.at(around, a, weight[b])
            np.add.at(around, b, weight[a])
        some = np.flatnonzero(around)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(some)), pa.array(around[some])], ["id", "around"])

    sums = _blocks(points, threshold, pivots, block_rows).applyInArrow(total, "id string, around long")
    return sums.groupBy("id").agg(F.sum("around").alias("around"))


def _core_links(points: DataFrame, threshold: float, pivots: int, block_rows: int | None) -> DataFrame:
    """Edges ``u``, ``v`` that connect core points as similarity does, and ``border`` ones from a point that is not core to core ones.

    ``points`` has a column ``core``.  A block pair reports a spanning forest of its core points, and one edge from
    any other point to each tree it touches: fewer than the samples that would make it core.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, tiles = _block_hits(table.to_batches(), threshold)
        core, sets = _column(table, "core").to_numpy(zero_copy_only=False), _Forest(len(ids))
        outer = [np.empty((2, 0), np.int64)]
        for a, b, _ in tiles:
            sets.join(a[core[a] & core[b]], b[core[a] & core[b]])
            a, b = np.where(core[a], b, a), np.where(core[a], a, b)
            mixed = core[b] & ~core[a]
            outer.append(np.stack([a[mixed], b[mixed]]))
        inner, (x, y) = np.array(sets.edges, np.int64).reshape(-1, 2).T, np.concatenate(outer, axis=1)
        once = np.unique(np.stack([x, sets.roots()[y]]), axis=1, return_index=True)[1]
        u, v = np.concatenate([inner[0], x[once]]), np.concatenate([inner[1], y[once]])
        border = np.arange(len(u)) >= inner.shape[1]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v)), pa.array(border)], ["u", "v", "border"])

    return _blocks(points, threshold, pivots, block_rows).applyInArrow(links, "u string, v string, border boolean")


def density_labels(
    points: DataFrame, threshold: float, min_samples: int, pivots: int = 16, block_rows: int | None = None
) -> DataFrame:
    """``id``, ``cluster_id`` of distinct vectors ``points`` by general density clustering, as ``cluster_by_density``.

    Vectors are compared twice, for the weights around them and for the links of core points, so that pairs are
    never written: what is written stays linear in the vectors of the block pairs.
    """
    from logharbor.operators.components import connected_components

    around = _weights_around(points, threshold, pivots, block_rows)
    total = F.col("weight") + F.coalesce("around", F.lit(0).cast("long"))
    marked = points.join(around, "id", "left").withColumn("core", total >= min_samples)
    # a point without neighbours is in no link
    marked = cut_lineage(marked.filter("core OR around > 0").drop("around"))
    core = marked.filter("core").select("id")
    links = cut_lineage(_core_links(marked, threshold, pivots, block_rows))
    roots = connected_components(links.filter("NOT border").select("u", "v"))
    labels = cut_lineage(core.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("cluster_id")))
    border = (
        links.filter("border").join(labels.withColumnRenamed("id", "v"), "v")
        .groupBy(F.col("u").alias("id")).agg(F.min("cluster_id").alias("cluster_id"))
    )
    return labels.unionByName(border)


def cluster_vectors(
    vectors: DataFrame, threshold: float, min_samples: int = K.MIN_SAMPLES, **options
) -> DataFrame:
    """Density clusters of dense vectors: ``id``, ``cluster_id`` for every clustered row (V6)."""
    from logharbor.operators.clustering import cluster_points

    distinct = cut_lineage(distinct_vectors(vectors))
    if min_samples <= 2:
        labels = cluster_points(distinct.select("id", "weight"), vector_links(vectors, threshold, **options), min_samples)
    else:
        labels = density_labels(distinct, threshold, min_samples, **options)
    by_vector = distinct.join(labels, "id").select("embedding", "cluster_id")
    return vectors.join(by_vector, "embedding").select("id", "cluster_id")

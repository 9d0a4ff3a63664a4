"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import save, table
from logharbor.operators.components import connected_components

COSINE = 0.95
#: Leading principal dimensions of the grid and of the sketches that rule pairs out before they are compared.
LEADING, SKETCH = 8, 16
#: Vectors of an interval and of a run of intervals that travels together (about), of a block, and pairs verified at once.
INTERVAL, GROUP, BLOCK, VERIFIED = 2048, 8192, 512, 1 << 16
#: Room for the rounding of a sketch's products, which are single precision.
ROUNDING = 1e-4


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small components do not over- or underflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dim: int, leading: int = LEADING) -> np.ndarray:
    """Leading eigenvectors of the second moments of all unit vectors; Spark sums ``dim`` squared numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        mean = np.zeros(dim)
        n = 0
        for batch in batches:
            x = _unit(_matrix(batch.column("embedding"), dim))
            total += x.T @ x
            mean += x.sum(axis=0)
            n += len(x)
        if n:
            values = np.concatenate([total.ravel(), mean, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "value"])

    summed = vectors.select("embedding").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.zeros(dim * dim + dim + 1)
    for r in summed.collect():
        values[r.at] = r.value
    n = max(values[-1], 1)
    mean = values[dim * dim:-1] / n
    spread = values[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh(spread)
    return axes[:, ::-1][:, :leading].copy()


def _cells_task(dim: int, axes: np.ndarray, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor((_unit(_matrix(batch.column("embedding"), dim)) @ axes) / reach).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("weight"), batch.column("embedding"),
                 pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), cells.shape[1]).cast(pa.list_(pa.int32()))],
                ["cid", "weight", "embedding", "cell"])
    return run


class _Side:
    """Vectors of an interval in grid order, with boxes of any stretch of them."""

    def __init__(self, at: np.ndarray, unit: np.ndarray, lead: np.ndarray, sketch: np.ndarray):
        self.at, self.unit, self.lead, self.sketch = at, unit, lead, sketch
        self.boxes: dict[tuple[int, int], tuple] = {}

    def box(self, a: int, b: int):
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.lead[a:b].min(axis=0), self.lead[a:b].max(axis=0)
        return self.boxes[a, b]


def _distant(x, y, reach: float) -> bool:
    """Two boxes on the leading dimensions are further apart than the reach."""
    gap = np.maximum(0, np.maximum(x[0] - y[1], y[0] - x[1]))
    return float(gap @ gap) > reach * reach


def sketches(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes and the length of the rest: by Cauchy-Schwarz, no cosine exceeds the product of two sketches."""
    lead = unit @ axes
    rest = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1)))
    return np.concatenate([lead, rest[:, None]], axis=1).astype(np.float32)


def join_sequences(a: _Side, b: _Side, reach: float, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Recursive join of two sequences: yields ``(rows of a, rows of b)`` of linked pairs, block by block.

    Blocks whose boxes are too far apart are skipped; in the others the sketches
    rule out most pairs, and the rest is compared in double precision.  With
    ``a is b`` every unordered pair comes once.
    """
    todo = [(0, len(a.at), 0, len(b.at))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m or (a is b and i > k):
            continue
        if _distant(a.box(i, j), b.box(k, m), reach):
            continue
        if j - i <= BLOCK and m - k <= BLOCK:
            # sketches are single precision: allow for their rounding
            near = a.sketch[i:j] @ b.sketch[k:m].T >= cosine - ROUNDING
            x, y = np.divmod(np.flatnonzero(near), m - k)
            x, y = x + i, y + k
            if a is b and i == k:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), VERIFIED):
                u, v = x[at: at + VERIFIED], y[at: at + VERIFIED]
                linked = np.einsum("ij,ij->i", a.unit[u], b.unit[v]) >= cosine
                if linked.any():
                    yield u[linked], v[linked]
            continue
        # halves on a common grid of blocks, so that a self-join meets each pair once
        p, q = _half(i, j), _half(k, m)
        todo += [(s, t, u, v) for s, t in ((i, p), (p, j)) for u, v in ((k, q), (q, m)) if s < t and u < v]


def _half(i: int, j: int) -> int:
    if j - i <= BLOCK:
        return j
    return i + BLOCK * (-(-(j - i) // BLOCK) // 2)


def _spread(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give linked positions the smallest label of their component, with labels of earlier links kept."""
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return
        p, q = p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def _pairs_task(dim: int, axes: np.ndarray, reach: float, cosine: float):
    def join(parts: list[tuple[np.ndarray, ...]], groups: tuple[int, int]) -> pa.RecordBatch:
        group, interval, cid, weight, matrix = (np.concatenate(c) for c in zip(*parts, strict=True))
        unit = _unit(matrix)
        lead = unit @ axes[:, :LEADING]
        cells = np.floor(lead / reach)
        order = np.lexsort((cid, *cells.T[::-1], interval))
        interval, group, cid, weight, unit, lead = (x[order] for x in (interval, group, cid, weight, unit, lead))
        sketch = sketches(unit, axes)
        cuts = np.flatnonzero(np.diff(interval, prepend=interval[0] - 1, append=interval[-1] + 1))
        sides = [(group[i], _Side(np.arange(i, j), unit[i:j], lead[i:j], sketch[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]
        links, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for n, (g, a) in enumerate(sides):
            for h, b in sides[n:]:
                if (g, h) != groups:
                    continue
                for x, y in join_sequences(a, b, reach, cosine):
                    x, y = a.at[x], b.at[y]
                    np.add.at(links, x, weight[y])
                    np.add.at(links, y, weight[x])
                    _spread(label, x, y)
        counted, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(cid)))
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([cid[counted], cid[moved]])),
            pa.array(np.concatenate([cid[counted], cid[label[moved]]]), mask=np.arange(len(counted) + len(moved)) < len(counted)),
            pa.array(np.concatenate([links[counted], np.zeros(len(moved), np.int64)]))], ["cid", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts = None, []
        for batch in batches:
            ga, gb, group, interval, cid, weight = (batch.column(n).to_numpy() for n in ("ga", "gb", "group", "interval", "cid", "weight"))
            matrix = _matrix(batch.column("embedding"), dim)
            cuts = [0, *(np.flatnonzero((np.diff(ga) != 0) | (np.diff(gb) != 0)) + 1), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if task != (ga[i], gb[i]):
                    if parts:
                        yield join(parts, task)
                    task, parts = (ga[i], gb[i]), []
                parts.append((group[i:j], interval[i:j], cid[i:j], weight[i:j], matrix[i:j]))
        if parts:
            yield join(parts, task)
    return run


def near_vectors(classes: DataFrame, dim: int, cosine: float = COSINE) -> DataFrame:
    """``cid``, ``other``, ``links``: linked weight seen from a vector, or (with ``other``) a vector of the same component."""
    # distance of unit vectors at the threshold, with room for rounding
    reach = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    axes = principal_axes(classes, dim, min(SKETCH, dim))
    leading = min(LEADING, dim)
    celled = classes.mapInArrow(_cells_task(dim, axes[:, :leading], reach), "cid bigint, weight bigint, embedding array<double>, cell array<int>")
    total = classes.count()
    # grid order over all vectors; equal cells are cut by id
    ordered = celled.repartitionByRange(max(1, -(-total // INTERVAL)), "cell", "cid").withColumn("interval", F.spark_partition_id())
    ordered = save(ordered, "order")
    boxes = save(ordered.groupBy("interval").agg(*(
        f(F.element_at("cell", k + 1)).alias(f"{name}{k}") for k in range(leading) for name, f in (("low", F.min), ("high", F.max)))), "boxes")
    left = boxes.select(F.col("interval").alias("a"), *(F.col(c).alias(f"a_{c}") for c in boxes.columns[1:]),
                        F.explode(F.expr("sequence(low0 - 1, high0 + 1)")).alias("lead"))
    right = boxes.select(F.col("interval").alias("b"), *(F.col(c).alias(f"b_{c}") for c in boxes.columns[1:]),
                         F.explode(F.expr("sequence(low0, high0)")).alias("lead"))
    # cells that differ by more than one in a dimension hold no near vectors
    near = " AND ".join(f"a_low{k} <= b_high{k} + 1 AND b_low{k} <= a_high{k} + 1" for k in range(leading))
    pairs = left.join(right, "lead").filter(f"a <= b AND {near}").select("a", "b").distinct()
    # runs of intervals meet in one task, so that a vector travels once per run it may be near, not once per interval
    intervals, groups = boxes.agg(F.max("interval")).first()[0] or 0, max(1, -(-total // GROUP))
    group = {c: F.floor(F.col(c) * groups / (intervals + 1)).cast("int") for c in ("a", "b")}
    tasks = pairs.select(group["a"].alias("ga"), group["b"].alias("gb"), F.explode(F.array(
        F.struct(F.col("a").alias("interval"), group["a"].alias("group")), F.struct(F.col("b").alias("interval"), group["b"].alias("group")))).alias("x"))
    tasks = save(tasks.select("ga", "gb", "x.interval", "x.group").distinct(), "tasks")
    dealt = ordered.join(tasks, "interval").select("ga", "gb", "group", "interval", "cid", "weight", "embedding")
    dealt = dealt.repartition("ga", "gb").sortWithinPartitions("ga", "gb")
    return dealt.mapInArrow(_pairs_task(dim, axes, reach, cosine), "cid bigint, other bigint, links bigint")


def link_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Vectors link when their cosine, in double precision, is at least ``cosine``.
    ``n_links`` counts the other rows linked; the component is named by its
    smallest id, which is kept.

    Equal vectors are one from the start, with a weight.  The rest is put into
    the order of grid cells of the reach's width on the leading principal
    dimensions; intervals of that order are joined recursively, and stretches
    whose boxes are too far apart are skipped.  Vectors that spread evenly over
    many dimensions leave little to skip; then 16 dimensions and the length of the
    rest rule out most pairs, and the work still grows with the square.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different length.  Repeated rows are rows of
    their own and link with each other.  A null id counts as a row but names no
    component unless it has no other.  Other columns are ignored.  Vectors are
    told apart by 64-bit hash.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.expr("size(embedding) > 0 AND exists(embedding, x -> x <> 0) AND "
                  "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("cid", F.when(F.col("fine"), F.xxhash64("embedding")))
    good = rows.filter("fine")
    classes = save(good.groupBy("cid").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("low"), F.first("embedding").alias("embedding")), "classes")
    found = None
    for r in classes.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect():
        part = near_vectors(classes.filter(F.size("embedding") == r.dim).select("cid", "weight", "embedding"), r.dim, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = save(found, "near")
    roots = connected_components(found.filter("other IS NOT NULL").select(F.col("cid").alias("u"), F.col("other").alias("v")))
    links = found.filter("other IS NULL").groupBy("cid").agg(F.sum("links").alias("links"))
    named = (classes.select("cid", "weight", "low").join(roots.withColumnRenamed("id", "cid"), "cid", "left")
             .join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    named = save(named, "roots")
    # written, so that the join below is not bound to the root's partition and can be split
    least = save(named.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    named = save(named.join(least, "root").select(
        "cid", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "named")
    out = rows.select("vec_id", "cid").join(named, "cid", "left").withColumn(
        "component_id", F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                      F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))

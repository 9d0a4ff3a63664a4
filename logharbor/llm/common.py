"""Tables, shared folder and vectorised word hashing for the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.session import new_folder

#: Session option that frees the shuffle files of a finished write at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text hashed at once by a task; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the frame to the shared folder and read it back.

    The table survives the executors that wrote it and is computed once; shuffle
    files behind it are freed when the write ends.
    """
    spark = df.sparkSession
    folder, before = new_folder(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows as a struct ``row`` beside the given columns, so that no column of the input clashes with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def free_name(columns: list[str], name: str) -> str:
    """The name, with a number if a column is called so already."""
    taken, n, found = {c.lower() for c in columns}, 2, name
    while found.lower() in taken:
        found, n = f"{name}_{n}", n + 1
    return found


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator, on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.back = base % 2**64, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            back = np.full(size, self.back, np.uint64)
            back[0] = 1
            self.up, self.down = np.cumprod(steps), np.cumprod(back)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_ODD), _Powers(0xD1342543DE82EF95)


def _sums(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.to(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return total, down


class Words:
    """Words of a slice of texts: bytes ``start`` to ``end``, ``row`` in the slice, ``hash``.

    A word is a run of bytes other than the six ASCII spaces.  Hashes are
    polynomials modulo 2**64 over random byte codes, then mixed; every run of
    words is hashed in constant time from running sums.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data, self.bounds = data, bounds
        n = len(data)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:n]
            last[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(bounds, self.start, "right") - 1
        # word range of each row
        self.first = np.searchsorted(self.row, np.arange(len(bounds)), "left")
        total, down = _sums(_CODES[_LOWER[data] if lower else data], _BYTES)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def count(self) -> np.ndarray:
        """Words of each row."""
        return np.diff(self.first)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words inside one row."""
        n = len(self) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total, down = _sums(self.hash, _WORDS)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1:])
        return at, mix((total[at + size] - total[at]) * down[at] + np.uint64(size))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from row, to row, bytes, bounds)`` of a text column, about ``limit`` bytes at a time.

    A null text is empty.  The bytes are those of the Arrow buffer, not copied.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
        at = to


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

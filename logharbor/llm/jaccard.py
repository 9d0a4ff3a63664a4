"""Exact n-gram Jaccard self-join with signature trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import Words, mix, packed, save, signed, slices, table
from logharbor.operators.components import connected_components

SHINGLE = 5
#: Similarity as a fraction of whole numbers: 75 / 100.
NUMERATOR, DENOMINATOR = 75, 100
#: Bits of a signature, children of a tree node, sets that share a block.
SIGNATURE_BITS, FANOUT, BLOCK_SETS = 2048, 8, 256
#: Tokens beyond the prefix whose rarity is looked at, as a share of the prefix.
EXTENSION = 0.25
#: Tokens that a set must share with a block to visit it (fewer where the extension is shorter); steers the plan only.
SHARED = 3
#: Buckets in which the tokens of all documents are counted by hash.  A bucket's
#: excess over the usual one gives its tokens one of four levels, rare to common;
#: levels steer the plan only.
COUNT_BUCKETS, COUNT_STRETCH, LEVEL_EDGES = 1 << 18, 1 << 18, (1, 8, 64)
#: Parts in which the sets of a token of the highest level are looked through.
SALTS = 4096

#: Visitors of a block that one task takes; ids up to which a list of documents is broadcast (16 bytes each).
GUESTS, BROADCAST_IDS = 512, 1 << 22

#: Roles of the rows of a block: members that join each other, hosts that wait for guests, guests.
_MEMBER, _HOST, _GUEST = 0, 1, 2


def token_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(row, words, sorted distinct tokens)`` of every text, tokens below 2**62."""
    for at, to, data, bounds in slices(column):
        words = Words(data, bounds, lower=True)
        begin, h = words.runs(shingle)
        h = h >> np.uint64(2)
        cut = np.searchsorted(begin, words.first)
        counts = words.count()
        for i in range(to - at):
            n = int(counts[i])
            if n >= shingle:
                tokens = np.unique(h[cut[i]: cut[i + 1]])
            elif n:
                a = words.first[i]
                whole = np.uint64(n)
                for x in words.hash[a: a + n]:
                    whole = mix(np.array([whole ^ x]) + np.uint64(1))[0]
                tokens = np.array([whole >> np.uint64(2)])
            else:
                tokens = np.empty(0, np.uint64)
            yield at + i, n, tokens


def set_key(tokens: np.ndarray) -> int:
    """One 64-bit number for a token set."""
    if not len(tokens):
        return 0
    total = np.add.reduce(mix(tokens + np.uint64(0x51ED270B)), dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(tokens))]))[0].astype(np.int64))


def least_overlap(n):
    """Smallest intersection a set of ``n`` tokens needs with any similar set."""
    return -(-n * NUMERATOR // DENOMINATOR)


def _sets_task(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, key = [], [], []
            for row, _, tokens in token_sets(batch.column("text"), shingle):
                at.append(row)
                size.append(len(tokens))
                key.append(set_key(tokens))
            taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array(size, pa.int64()), pa.array(key, pa.int64())], ["doc_id", "text_key", "n_shingles", "set_id"])
    return run


def _count_task(shingle: int):
    """Tokens per bucket, one array of fixed size per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_BUCKETS, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def settle():
            marks = np.concatenate(held) & np.uint64(COUNT_BUCKETS - 1)
            return np.bincount(marks.astype(np.int64), minlength=COUNT_BUCKETS)

        for batch in batches:
            for _, _, tokens in token_sets(batch.column("text"), shingle):
                if len(tokens):
                    held.append(tokens)
                    size += len(tokens)
                if size > COUNT_STRETCH:
                    total += settle()
                    held, size = [], 0
        if held:
            total += settle()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])
    return run


def token_levels(docs: DataFrame, shingle: int) -> np.ndarray:
    """Level of every bucket, 0 for rare tokens to 3 for the most common, from all documents."""
    summed = (docs.mapInArrow(_count_task(shingle), "bucket int, n bigint")
              .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(COUNT_BUCKETS)
    counts[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    usual = np.median(counts)
    # other tokens of a bucket scatter by the root of their number
    unit = max(8.0, 3 * np.sqrt(usual))
    return np.searchsorted(LEVEL_EDGES, (counts - usual) / unit, "right").astype(np.uint8)


def _prefix_task(shingle: int, levels: np.ndarray):
    """The rarest tokens of each set: the prefix and its extension; of equal sets in a task, one speaks.

    The order over all tokens is fixed: by level, then by hash.  Similar
    sets share a token of their prefixes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out: list[tuple[np.ndarray, int, int]] = []
        held = 0
        for batch in batches:
            for _, _, tokens in token_sets(batch.column("text"), shingle):
                n, key = len(tokens), set_key(tokens)
                if not n or key in seen:
                    continue
                seen.add(key)
                level = levels[(tokens & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
                ordered = np.sort(tokens | (level << np.uint64(62)))
                prefix = n - least_overlap(n) + 1
                taken = ordered[: min(n, prefix + int(prefix * EXTENSION))]
                out.append((taken, key, n))
                held += len(taken)
                if held > 1 << 17:
                    yield _prefix_batch(out)
                    out, held = [], 0
        if out:
            yield _prefix_batch(out)
    return run


def _prefix_batch(rows: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
    sizes = [len(t) for t, _, _ in rows]
    return pa.RecordBatch.from_arrays([
        pa.array(signed(np.concatenate([t for t, _, _ in rows]))),
        pa.array(np.repeat(np.array([k for _, k, _ in rows], np.int64), sizes)),
        pa.array(np.repeat(np.array([n for _, _, n in rows], np.int32), sizes)),
        # tokens of the set that follow
        pa.array(np.concatenate([np.arange(n - 1, n - 1 - len(t), -1, dtype=np.int32) for t, _, n in rows])),
    ], ["token", "set_id", "size", "rest"])


class Tree:
    """Signature tree: nodes hold OR-combined token bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray]):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.order, self.sets = order, [sets[i] for i in order]
        bits = np.zeros((len(sets), SIGNATURE_BITS // 8), np.uint8)
        for i, s in enumerate(self.sets):
            flags = np.zeros(SIGNATURE_BITS, np.uint8)
            flags[(s % np.uint64(SIGNATURE_BITS)).astype(np.int64)] = 1
            bits[i] = np.packbits(flags)
        bits = bits.view(np.uint64)
        size = np.array([len(s) for s in self.sets], np.int64)
        # tokens of a set beyond its distinct bits
        extra = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, size, size, extra)]
        while len(self.levels[-1][1]) > 1:
            self.levels.append(self._above(*self.levels[-1]))

    @staticmethod
    def _above(bits, low, high, extra):
        at = np.arange(0, len(low), FANOUT)
        return (np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at),
                np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at))


def _may_link(a, b, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bound on the overlap under two nodes against what similarity asks for."""
    (bits_a, low_a, high_a, extra_a), (bits_b, low_b, high_b, extra_b) = a, b
    keep = ((high_a[i] * DENOMINATOR >= low_b[j] * NUMERATOR) & (high_b[j] * DENOMINATOR >= low_a[i] * NUMERATOR))
    at = np.flatnonzero(keep)
    for k in range(0, len(at), 1 << 14):
        part = at[k: k + (1 << 14)]
        x, y = i[part], j[part]
        most = np.bitwise_count(bits_a[x] & bits_b[y]).sum(axis=1).astype(np.int64) + np.minimum(extra_a[x], extra_b[y])
        keep[part] = most * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (low_a[x] + low_b[y])
    return keep


def candidate_leaves(a: Tree, b: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal: leaf pairs that survive at every level; of one tree, each pair once."""
    same = b is None
    b = b or a
    top = max(len(a.levels), len(b.levels))
    i = j = np.zeros(1, np.int64)
    for depth in range(top - 1, -1, -1):
        la, lb = a.levels[min(depth, len(a.levels) - 1)], b.levels[min(depth, len(b.levels) - 1)]
        if depth < top - 1:
            i, j = _expand(i, j, depth < len(a.levels) - 1, depth < len(b.levels) - 1, len(la[1]), len(lb[1]))
        if same:
            keep = i <= j if depth else i < j
            i, j = i[keep], j[keep]
        keep = _may_link(la, lb, i, j)
        i, j = i[keep], j[keep]
    return i, j


def _expand(i, j, down_a: bool, down_b: bool, size_a: int, size_b: int):
    step = np.arange(FANOUT)
    if down_a:
        i, j = (i[:, None] * FANOUT + step).ravel(), np.repeat(j, FANOUT)
        i, j = i[i < size_a], j[i < size_a]
    if down_b:
        i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + step).ravel()
        i, j = i[j < size_b], j[j < size_b]
    return i, j


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact test on two sorted token sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common)


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _links(a: Tree, ids_a: np.ndarray, forest: _Forest, b: Tree | None = None, ids_b: np.ndarray | None = None):
    """Exact links that join two parts of the forest; pairs already joined are left out."""
    i, j = candidate_leaves(a, b)
    b, ids_b = b or a, ids_a if ids_b is None else ids_b
    left, right = ids_a[a.order[i]].tolist(), ids_b[b.order[j]].tolist()
    for x, y, p, q in zip(i.tolist(), j.tolist(), left, right, strict=True):
        if forest.root(p) != forest.root(q) and linked(a.sets[x], b.sets[y]):
            forest.join(p, q)
            yield p, q


def _leaders(forest: _Forest, keys: np.ndarray) -> list[tuple[int, int]]:
    """Each key with the smallest of those it is joined with, where that is another one."""
    least: dict[int, int] = {}
    for k in keys.tolist():
        root = forest.root(k)
        least[root] = min(k, least.get(root, k))
    return [(k, low) for k in keys.tolist() if (low := least[forest.root(k)]) != k]


def _blocks_task(shingle: int):
    """Join the members of each block, or its hosts with guests in chunks; rows come by task, guests last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tree, ids, forest = None, None, None, _Forest()
        held: list[tuple[int, np.ndarray]] = []
        seen: set[int] = set()
        now = _MEMBER

        def settle():
            nonlocal tree, ids, held
            found = []
            if held:
                keys = np.array([k for k, _ in held], np.int64)
                part = Tree([t for _, t in held])
                if now == _MEMBER:
                    for _ in _links(part, keys, forest):
                        pass
                    found = _leaders(forest, keys)
                elif now == _HOST:
                    tree, ids = part, keys
                elif tree is not None:
                    found = list(_links(part, keys, forest, tree, ids))
            held = []
            return pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], ["u", "v"])

        for batch in batches:
            tasks, roles = batch.column("task").to_pylist(), batch.column("role").to_pylist()
            for row, _, tokens in token_sets(batch.column("text"), shingle):
                t, role, key = tasks[row], roles[row], set_key(tokens)
                if t != task or role != now or (role == _GUEST and len(held) >= BLOCK_SETS):
                    yield settle()
                    if t != task:
                        task, tree, ids, forest = t, None, None, _Forest()
                        seen.clear()
                    now = role
                if len(tokens) and key not in seen:
                    seen.add(key)
                    held.append((key, tokens))
        yield settle()
    return run


def _need(size: str) -> str:
    """SQL for the tokens that a set of this size, or the smaller of a similar pair, shares in what it sends."""
    prefix = f"({size} - ({size} * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR} + 1)"
    return f"(least({size}, {prefix} + floor({prefix} * {EXTENSION}D)) - {prefix} + 1)"


def _shared_tokens(docs: DataFrame, shingle: int, levels: np.ndarray) -> DataFrame:
    """Prefix tokens held by two different sets at least; ``low`` is the smallest of the sets.

    A partial aggregation cannot thin these rows, so one shuffle carries them.  Tokens
    below the highest level have few sets; the sets of a common one are looked
    through in parts, whose results are combined.
    """
    rows = docs.mapInArrow(_prefix_task(shingle, levels), "token bigint, set_id bigint, size int, rest int")
    rows = rows.selectExpr("*", "shiftrightunsigned(token, 62) = 3 AS common")
    rows = rows.selectExpr("*", f"IF(common, pmod(set_id, {SALTS}), 0L) AS salt")
    held = rows.selectExpr("*", "min(set_id) OVER (PARTITION BY token, salt) AS low", "max(set_id) OVER (PARTITION BY token, salt) AS high")
    held = save(held.filter("common OR low <> high").distinct(), "held")
    ends = held.filter("common").groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    common = held.filter("common").join(ends.filter("least <> most"), "token")
    columns = ["token", "set_id", "size", "rest"]
    return held.filter("NOT common").select(*columns, "low").unionByName(common.select(*columns, F.col("least").alias("low")))


def _joined(docs: DataFrame, ids: DataFrame, dealt: DataFrame, shingle: int, name: str) -> DataFrame:
    """Links found by the tasks that ``dealt`` (``set_id``, ``task``, ``role``) sends sets to.

    Sets travel as the texts they are made from, which compress; hashes do not.
    """
    dealt = dealt.join(ids, "set_id").select(F.col("doc_id").alias("dealt_id"), F.col("text_key").alias("dealt_key"), "task", "role")
    dealt = save(dealt, f"{name}_dealt")
    few = dealt.count() <= BROADCAST_IDS
    on = (F.col("text_key") == F.col("dealt_key")) & F.col("doc_id").eqNullSafe(F.col("dealt_id"))
    rows = docs.join(F.broadcast(dealt) if few else dealt, on).select("task", "role", "text")
    rows = rows.repartition("task").sortWithinPartitions("task", "role")
    return save(rows.mapInArrow(_blocks_task(shingle), "u bigint, v bigint"), name)


def _first() -> F.Column:
    """Orders documents by id, then text; those without an id come last."""
    return F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")


def jaccard_links(docs: DataFrame, sets: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Links ``u``, ``v`` of set ids that connect exactly what all similar pairs connect."""
    found = save(_shared_tokens(docs, shingle, token_levels(docs, shingle)), "shared")
    # a set with more tokens of its own than a prefix is long has no partner
    near = found.groupBy("set_id").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("low").alias("hub"))
    near = save(near.filter(f"n >= {_need('size')}").select("set_id", "hub"), "hubs")
    # sets meet in blocks: those with the same smallest partner together, cut by count
    sizes = near.groupBy("hub").agg(F.count("*").alias("n"))
    blocks = save(near.join(sizes, "hub").select(
        "set_id", "hub", "n", F.expr(f"xxhash64(hub, pmod(xxhash64(set_id), ceil(n / {BLOCK_SETS})))").alias("block")), "blocks")
    # any document may stand for a set, also one without an id
    ids = sets.join(blocks.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.min(_first()).alias("first"))
    ids = save(ids.select("set_id", "first.doc_id", "first.text_key"), "ids")
    inner = _joined(docs, ids, blocks.filter("n > 1").select("set_id", F.col("block").alias("task"), F.lit(_MEMBER).alias("role")),
                    shingle, "inner")

    # a group of many copies fills many blocks: one set of each part stands for it
    led = save(blocks.join(inner, blocks.set_id == inner.u, "left").select(
        "set_id", "hub", "n", "block", F.coalesce("v", "set_id").alias("leader")), "led")
    firsts = led.filter(f"n > {BLOCK_SETS} AND set_id = leader")
    parts = firsts.groupBy("hub").agg(F.count("*").alias("parts"))
    outer = _joined(docs, ids, firsts.join(parts, "hub").select(
        "set_id", F.expr(f"xxhash64(hub, pmod(xxhash64(set_id, 1), ceil(parts / {BLOCK_SETS})))").alias("task"),
        F.lit(_MEMBER).alias("role")), shingle, "outer")
    led = led.join(outer, led.leader == outer.u, "left").select(
        "set_id", "block", F.coalesce("v", "leader").alias("leader"))
    led = save(led, "led")

    # sets not joined yet visit the blocks of others that share a token
    placed = save(found.select("token", "set_id", "size", "rest").join(led, "set_id"), "placed")
    mixed = placed.groupBy("token").agg(F.min("leader").alias("low"), F.max("leader").alias("high")).filter("low <> high")
    placed = save(placed.join(mixed.select("token"), "token", "left_semi"), "placed")
    others = placed.groupBy("token", F.col("block").alias("other")).agg(
        F.min("leader").alias("low"), F.max("leader").alias("high"), F.min("size").alias("least"), F.max("size").alias("most"),
        F.max("rest").alias("most_rest"))
    smallest = f"((size * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR})"
    need = f"least({SHARED}, {_need(smallest)})"
    # of what a similar pair shares, the k-th token has overlap - k after it in both sets
    within = f"(least(rest, most_rest) + {need}) * {NUMERATOR + DENOMINATOR}L >= (size + greatest(least, {smallest})) * {NUMERATOR}L"
    visits = (placed.join(others, "token")
              # one of the two directions, evenly; parts not joined yet, sizes in range
              .filter("block <> other AND ((block < other) = ((block ^ other) & 1 = 0)) AND (low <> leader OR high <> leader)")
              .filter(f"most >= {smallest} AND size * {DENOMINATOR}L >= least * {NUMERATOR}L")
              .filter(within)
              # a partner has the smallest size at least, and the pair shares what that size needs
              .groupBy("set_id", F.col("other").alias("block")).agg(F.count("*").alias("n"), F.max("size").alias("size"))
              .filter(f"n >= {need}").select("set_id", "block"))
    visits = save(visits, "visits")
    # many visitors of one block are dealt out to tasks that each hold its members
    chunks = visits.groupBy("block").agg(F.ceil(F.count("*") / GUESTS).alias("chunks"))
    guests = visits.join(chunks, "block").select(
        "set_id", F.expr("xxhash64(block, pmod(xxhash64(set_id), chunks))").alias("task"), F.lit(_GUEST).alias("role"))
    hosts = led.join(chunks, "block").select(
        "set_id", "block", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk")).select(
        "set_id", F.expr("xxhash64(block, chunk)").alias("task"), F.lit(_HOST).alias("role"))
    return inner.unionByName(outer).unionByName(_joined(docs, ids, hosts.unionByName(guests), shingle, "met"))


def _grouped(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_shingles``, ``component_id`` and ``first``, the document that stands for the component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    sets = save(docs.mapInArrow(_sets_task(shingle), "doc_id bigint, text_key bigint, n_shingles bigint, set_id bigint"), "sets")
    filled = sets.filter("n_shingles > 0")
    links = save(jaccard_links(docs, filled, shingle), "links")
    roots = connected_components(links)
    firsts = filled.groupBy("set_id").agg(F.min(_first()).alias("first"))
    named = firsts.join(roots, firsts.set_id == roots.id, "left").select("set_id", "first", F.coalesce("root", "set_id").alias("root"))
    named = save(named, "roots")
    # written, so that the join below is not bound to the root's partition and can be split
    least = save(named.groupBy("root").agg(F.min("first").alias("first")), "least")
    named = save(named.select("set_id", "root").join(least, "root").select("set_id", "first"), "named")
    part = filled.join(named, "set_id").select("doc_id", "text_key", "n_shingles", F.col("first.doc_id").alias("component_id"), "first")
    rest = sets.filter("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), _first().alias("first"))
    return part.unionByName(rest)


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every document.

    Documents link when the Jaccard similarity of their sets of ``shingle``
    lower-cased words is 0.75 or more; a text of fewer words is one shingle.  The
    component is named by its smallest doc_id.

    Equal sets are one set from the start.  Similar sets share one of their rarest
    tokens (prefix filter), which brings them into a common block; each block is a
    signature tree over at most a few hundred sets, traversed against itself, and
    each surviving leaf pair is tested exactly unless its ends are joined already.
    Then one set of each joined part meets those of the other blocks of its group,
    and only sets that are in different parts still visit each other's blocks.

    Null, empty and wordless texts have no shingles and are their own component.
    A document without an id links like any other, but names no component unless
    it has no other.  Repeated rows give repeated rows.  Other columns are ignored.  Sets and
    shingles are compared by 64-bit and 62-bit hashes.
    """
    return _grouped(docs, shingle).select("doc_id", "n_shingles", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each component: of the smallest id, or of the smallest text hash where none has an id.

    Of repeated rows, the same in id and text, one stays.
    """
    first = _grouped(docs, SHINGLE).filter(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    first = first.select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key")).distinct()
    rows = packed(docs, id=F.col("doc_id").cast("long"), key=F.xxhash64("text"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))

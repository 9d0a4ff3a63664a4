"""Filter interaction audit: masks of failed filters, exact copies by radix text tries, all orders of the filters."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logharbor.llm.common import save, table

#: Filters by the bit of their failure.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
#: Bytes of text that a task looks at together before the shuffle, and that a task reads after it (about).
SLAB_BYTES, TASK_BYTES = 32 << 20, 64 << 20
#: Length of the first text prefixes, and the growth of those that hold too much.
PREFIX, LONGER = 8, 4

_CAPITALS = bytes(range(65, 91))
_TAIL_BYTES = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()
    points = len(text.translate(None, _TAIL_BYTES))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > MAX_CAPITALS * points) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3)


class _Node:
    __slots__ = ("label", "kids", "low", "rows")

    def __init__(self, label: bytes):
        self.label, self.kids, self.low, self.rows = label, {}, None, None


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of ``label`` and of ``text`` from ``at``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class TextTrie:
    """Compressed trie of whole texts; a terminal holds the smallest id of its text and the rows that carry it."""

    def __init__(self):
        self.root = _Node(b"")

    def add(self, text: bytes, doc_id: int, row) -> None:
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = _Node(text[at:])
            elif not text.startswith(kid.label, at):
                n = _shared(kid.label, text, at)
                upper = node.kids[text[at]] = _Node(kid.label[:n])
                kid.label = kid.label[n:]
                upper.kids[kid.label[0]] = kid
                kid = upper
            node, at = kid, at + len(kid.label)
        if node.rows is None:
            node.low, node.rows = doc_id, [row]
        else:
            node.low = min(node.low, doc_id)
            node.rows.append(row)

    def terminals(self) -> Iterator[tuple[int, list]]:
        """Smallest id and rows of every text."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.rows is not None:
                yield node.low, node.rows
            todo += node.kids.values()


_FIRST = [("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("rows", pa.int64()), ("text", pa.binary())]
_LAST = _FIRST[:-1]
_BATCH = 8 << 20


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _in_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of A to D; copies known from the slab get E, the others carry their text once per slab, id and part."""
    def close(trie: TextTrie, rest: list[tuple]) -> Iterator[pa.RecordBatch]:
        out, size = rest, 0
        for low, rows in trie.terminals():
            counts: dict[tuple, int] = {}
            text = rows[0][3]
            for doc_id, part, mask, _ in rows:
                if doc_id > low:
                    out.append((doc_id, part, mask | COPY, 1, None))
                else:
                    counts[part, mask] = counts.get((part, mask), 0) + 1
            out += [(low, part, mask, n, text) for (part, mask), n in counts.items()]
            size += len(text) * len(counts)
            if size >= _BATCH:
                yield _batch(out, _FIRST)
                out, size = [], 0
        if out:
            yield _batch(out, _FIRST)

    trie, rest, held = TextTrie(), [], 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
        for doc_id, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), texts, strict=True):
            text = text.as_py() or b""
            mask = text_mask(text)
            if doc_id is None:
                rest.append((None, part, mask, 1, None))
            else:
                trie.add(text, doc_id, (doc_id, part, mask, text))
            held += len(text) + 100
            if held >= SLAB_BYTES:
                yield from close(trie, rest)
                trie, rest, held = TextTrie(), [], 0
    yield from close(trie, rest)


def _in_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix: one trie at a time, copies of a smaller id get E."""
    def close(trie: TextTrie) -> Iterator[pa.RecordBatch]:
        out = [(i, part, mask | COPY if i > low else mask, n) for low, rows in trie.terminals() for i, part, mask, n in rows]
        if out:
            yield _batch(out, _LAST)

    prefix, trie = None, TextTrie()
    for batch in batches:
        for i, part, mask, n, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "mask", "rows", "text", "prefix")), strict=True):
            if at != prefix:
                yield from close(trie)
                prefix, trie = at, TextTrie()
            trie.add(text, i, (i, part, mask, n))
    yield from close(trie)


def prefixed(texts: DataFrame, limit: int) -> DataFrame:
    """The rows with a ``prefix`` of their ``text``, lengthened until texts of one prefix hold ``limit`` bytes.

    A prefix that is a whole text stays as it is.  Equal texts have equal prefixes.
    Prefixes that hold too much are few, as each holds ``limit`` bytes; they are
    told by hash, so that at worst some prefixes are longer than needed.
    """
    length = PREFIX
    rows = texts.withColumn("prefix", F.substring("text", 1, length))
    while True:
        full = rows.filter(F.octet_length("prefix") == length).groupBy(F.xxhash64("prefix").alias("full")).agg(
            F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("longest"))
        full = save(full.filter((F.col("bytes") > limit) & (F.col("longest") > length)).select("full"), "prefixes")
        if full.isEmpty():
            return rows
        grown = F.substring("text", 1, length * LONGER)
        rows = rows.join(full, F.xxhash64("prefix") == F.col("full"), "left").withColumn(
            "prefix", F.when(F.col("full").isNotNull() & (F.octet_length("prefix") == length), grown).otherwise(F.col("prefix"))).drop("full")
        length *= LONGER


def failed_filters(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``doc_id``, ``part``, ``mask``, ``rows``: the filters that every document fails, equal rows of a document counted.

    A document fails E if a smaller ``doc_id`` has the same text, null and empty
    being the same; rows of one id are no copies of each other, and a row without
    an id neither is a copy nor has any.  Copies inside a slab of a task's rows are
    settled there, so a common text moves once per slab.  The other texts are dealt
    by ranges of prefixes, which are lengthened where many texts begin alike, and
    meet in a trie per prefix.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").alias("text"))
    first = save(rows.mapInArrow(_in_slabs, "doc_id bigint, part string, mask int, rows bigint, text binary"), "masks")
    carried = first.filter("text IS NOT NULL")
    total = carried.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    dealt = prefixed(carried, max(1, total // (2 * parts)))
    dealt = dealt.repartitionByRange(parts, "prefix").sortWithinPartitions("prefix")
    last = dealt.mapInArrow(_in_prefixes, "doc_id bigint, part string, mask int, rows bigint")
    return first.filter("text IS NULL").drop("text").unionByName(last)


def effects(spark: SparkSession) -> DataFrame:
    """What each filter of each order does to a document of each mask: 120 orders, 5 steps, 32 masks."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        for step, k in enumerate(order, 1):
            before = sum(1 << j for j in order[: step - 1])
            for mask in range(1 << len(FILTERS)):
                fails, gone = mask >> k & 1, bool(mask & before)
                rows.append((mask, name, step, FILTERS[k], int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == 1 << k)))
    names = ("mask", "filter_order", "step", "letter", "kept", "removed", "redundant", "unique")
    types = (pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4)
    return spark.createDataFrame(pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), types, strict=True)}))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order of the filters and step: documents kept, removed, and what that costs.

    Filters: A fewer than 50 words, B distinct words under 65 %, C capitals over
    5 % of the characters, D any of ``#$%&*|``, E a copy of a smaller id's text in
    any part (see ``failed_filters``).  A null text is empty, null sources are the
    part of the empty string.  Repeated rows count as rows.  A document is good or
    toxic if any of its label rows says 1.  Other columns are ignored; without
    documents there are no parts and no rows.
    """
    good, toxic = F.max((F.col("quality") == 1).cast("int")), F.max((F.col("toxic") == 1).cast("int"))
    marks = labels.select(F.col("doc_id").cast("long").alias("l_id"), "quality", "toxic").groupBy("l_id").agg(good.alias("good"), toxic.alias("bad"))
    marks = marks.filter("good = 1 OR bad = 1")
    n = F.col("rows")
    counts = failed_filters(docs).join(marks, F.col("doc_id") == F.col("l_id"), "left").groupBy("part", "mask").agg(
        F.sum(n).alias("docs"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("bad", F.lit(0))).alias("bad"))
    counts = save(counts, "counts")

    def total(count: str, of: str) -> F.Column:
        return F.sum(F.col(count) * F.col(of))

    steps = counts.join(effects(docs.sparkSession), "mask").groupBy("part", "filter_order", "step", "letter").agg(
        total("docs", "kept").alias("kept"), total("docs", "removed").alias("removed"), total("docs", "redundant").alias("redundant"),
        total("docs", "unique").alias("unique_fails"), total("good", "removed").alias("good_lost"), total("bad", "removed").alias("toxic_lost"))
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
lows AS (SELECT text, min(doc_id) AS low FROM words GROUP BY text),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
masks AS (
  SELECT w.part, (len(words) < 50) AS a, (100 * len(list_distinct(words)) < 65 * len(words)) AS b,
    (100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * length(w.text)) AS c, regexp_matches(w.text, '[#$%&*|]') AS d,
    coalesce(w.doc_id > l.low, false) AS e, coalesce(m.good, false) AS good, coalesce(m.bad, false) AS bad
  FROM words w JOIN lows l ON l.text = w.text LEFT JOIN marks m ON m.doc_id = w.doc_id),
counts AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
      || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS letter, left(filter_order, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
seen AS (
  SELECT part, filter_order, step, letter, docs, good, bad, fails, contains(fails, letter) AS now,
    len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS gone
  FROM counts, steps),
done AS (
  SELECT part, filter_order, step, letter, coalesce(sum(docs) FILTER (NOT now AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(docs) FILTER (now AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(docs) FILTER (now AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(docs) FILTER (fails = letter), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (now AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (now AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM done"""

"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import packed, save, table

#: Items of fewer words are matched whole.
LEAST_WORDS = 10
#: Masks over at most ten words: 1 is hashed, 0 may differ.  Chosen by enumeration: whichever 2 of 10, 3 of 15 or
#: 4 of 20 words are changed, one mask still fits somewhere, so no overlap that AGREE allows is missed.
MASKS = ("110111", "11100011", "10101101")
#: An overlap is verified over so many words (or the whole item, if shorter), of which this share must agree.
STRETCH, AGREE = 20, 0.8
#: Item windows up to which their table is broadcast (16 bytes each and overhead).
BROADCAST_WINDOWS = 500_000
#: Beyond that, places of documents are first looked up in a bit table of all seeds: bits for each window, and at most
#: so many bits (64 MB).  It rules out seeds that no item has, at any size.
WINDOW_BITS, MOST_BITS = 16, 1 << 29
#: Hits of a document verified in one row; a document with more is read by several rows.
HITS = 4096


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _once(value: str, name: str, result: str) -> Column:
    """``result`` with the value bound to a name, so that it is computed once per row and not at each use."""
    return F.expr(f"element_at(transform(array({value}), {name} -> {result}), 1)")


def seed_windows(rows: DataFrame, keys: list[str], masks=MASKS) -> DataFrame:
    """``keys``, ``seed``, ``place``: hashes of the words under each mask, at every place of ``words``."""
    seeds = []
    for mask in masks:
        under = ", ".join(f"h[i + {k}]" for k, bit in enumerate(mask) if bit == "1")
        seeds.append(f"CASE WHEN size(h) >= {len(mask)} THEN "
                     f"transform(sequence(0, size(h) - {len(mask)}), i -> xxhash64({int(mask, 2)}, {under})) END")
    by_mask = _once("transform(words, w -> xxhash64(w))", "h", f"array({', '.join(seeds)})")
    rows = rows.select(*keys, F.explode(by_mask).alias("seeds"))
    return rows.select(*keys, F.posexplode("seeds").alias("place", "seed"))


def seed_marks(windows: DataFrame, bits: int) -> DataFrame:
    """``slot``, ``marks``: a table of ``bits`` bits, 64 numbers of 64 bits in a row, with the bit of every seed set."""
    at = windows.selectExpr(f"pmod(seed, {bits}L) AS at").selectExpr("at div 4096 AS slot", "at % 4096 div 64 AS part", "int(at % 64) AS bit")
    parts = at.groupBy("slot", "part").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mark"))
    # 64 parts of a slot at most
    rows = parts.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("part", "mark"))).alias("m"))
    return rows.selectExpr("slot", "transform(sequence(0L, 63L), i -> coalesce(m[i], 0L)) AS marks")


def with_known_seeds(placed: DataFrame, windows: DataFrame, count: int) -> DataFrame:
    """The places whose seed may be one of the ``count`` windows; most others are gone before they are shuffled."""
    bits = min(MOST_BITS, max(4096, 1 << (WINDOW_BITS * count - 1).bit_length()))
    at = f"pmod(seed, {bits}L)"
    marked = placed.join(F.broadcast(seed_marks(windows, bits)), F.expr(f"{at} div 4096 = slot"))
    return marked.filter(f"getbit(marks[int({at} % 4096 div 64)], int({at} % 64)) = 1").drop("slot", "marks")


def leaks(docs: DataFrame, items: DataFrame, stretch: int = STRETCH, agree: float = AGREE) -> DataFrame:
    """``doc_id``, ``text_key``, ``item_id``, ``start``, ``compared``, ``agreeing`` for every leak of an item into a document.

    Every place of documents and items is hashed under fixed masks that ignore some
    words, and joined on the hashes.  Each hit fixes how the item lies on the document; there
    the words are compared one by one, and the item has leaked if in some stretch
    of ``stretch`` words (or in the whole of a shorter item) the share ``agree``
    is equal.  ``start`` is the item's first word in the document, from 0.

    Words beyond the ends of the document count as different.  Items under ten words
    leak only as they are, found by a hash of all their words.

    Null and empty texts and items leak nothing.
    Repeated items are one; an id with several texts is judged by each.  Repeated
    documents give repeated rows; null ids are kept.  Other columns are ignored.
    """
    items = items.select(F.col("item_id").alias("item_id"), words_of(F.col("text")).alias("words")).distinct()
    items = save(items.filter("size(words) > 0").withColumn("item_key", F.xxhash64("item_id", "words")), "items")
    sized = items.withColumn("n_item", F.size("words"))
    short = sorted(r.n_item for r in sized.filter(F.col("n_item") < LEAST_WORDS).select("n_item").distinct().collect())
    windows = seed_windows(sized.filter(F.col("n_item") >= LEAST_WORDS), ["item_key", "n_item"])
    for size in short:  # nine sizes at most
        windows = windows.unionByName(seed_windows(sized.filter(F.col("n_item") == size), ["item_key", "n_item"], ["1" * size]))
    windows = save(windows.withColumnRenamed("place", "item_place").distinct(), "seeds")
    count = windows.count()
    few = count <= BROADCAST_WINDOWS
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    placed = seed_windows(texts.select("doc_id", "text_key", words_of(F.col("text")).alias("words")), ["doc_id", "text_key"],
                          [*MASKS, *("1" * size for size in short)])
    if not few:
        placed = with_known_seeds(placed, windows, count)
    hits = placed.join(F.broadcast(windows) if few else windows, "seed").select(
        F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"),
        F.struct("item_key", "n_item", (F.col("place") - F.col("item_place")).alias("shift")).alias("hit"))
    hits = save(hits.distinct(), "hits")
    # common phrases of items make many hits; each row takes a bounded number of them
    sizes = hits.groupBy("hit_id", "hit_key").agg(F.count("*").alias("n")).select(
        F.col("hit_id").alias("id"), F.col("hit_key").alias("key"), F.ceil(F.col("n") / HITS).alias("rows"))
    hits = hits.join(save(sizes, "sizes"), F.col("hit_id").eqNullSafe(F.col("id")) & (F.col("hit_key") == F.col("key")))
    hits = hits.groupBy("hit_id", "hit_key", F.expr("pmod(xxhash64(hit), rows)").alias("row")).agg(F.collect_list("hit").alias("hits"))
    # written, so that its size is known and texts are not shuffled for a small one
    hits = save(hits, "hit_rows")
    on = texts.doc_id.eqNullSafe(hits.hit_id) & (texts.text_key == hits.hit_key)
    found = texts.join(hits, on).select("doc_id", "text_key", "hits", words_of(F.col("text")).alias("words"))
    laid = found.select("doc_id", "text_key", F.explode(_once(
        "words", "ws", "transform(hits, h -> struct(h.item_key AS item_key, h.shift AS start, "
        "slice(ws, greatest(h.shift, 0) + 1, h.n_item + least(h.shift, 0)) AS part))")).alias("x"))
    laid = laid.select("doc_id", "text_key", "x.*")
    known = items.withColumnRenamed("words", "item").withColumn("compared", F.least(F.lit(stretch), F.size("item")))
    laid = laid.join(F.broadcast(known) if few else known, "item_key")
    # one number per word of the item; those before the document's begin and after its end stay 0
    equal = ("concat(array_repeat(0, greatest(-start, 0)), "
             "zip_with(part, slice(item, greatest(-start, 0) + 1, size(part)), (a, b) -> CASE WHEN a = b THEN 1 ELSE 0 END), "
             "array_repeat(0, size(item) - size(part) - greatest(-start, 0)))")
    laid = laid.withColumn("agreeing", _once(
        equal, "e", "array_max(transform(sequence(0, size(e) - compared), "
        "j -> aggregate(slice(e, j + 1, compared), 0, (s, x) -> s + x)))"))
    laid = laid.filter(F.col("agreeing") >= F.lit(agree) * F.col("compared"))
    best = F.max(F.struct("agreeing", (-F.col("start")).alias("back"), "compared")).alias("best")
    return laid.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", (-F.col("best.back")).alias("start"), "best.compared", "best.agreeing")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows into which no item has leaked, with all their columns."""
    bad = leaks(docs, items).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    rows = packed(docs, id=F.col("doc_id"), key=F.xxhash64("text"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "compared", "agreeing")

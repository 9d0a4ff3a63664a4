"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logharbor.llm.common import free_name, packed, save, table

#: Weights of the sources in order, repeating; the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Pieces of each size band of a source; a band spans sizes of one bit length.
SLOTS = 256
SEED = "mix"


def _hex(column, digits: int):
    return F.conv(F.substring(F.md5(column), 1, digits), 16, 10)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``source_key``, ``source_size``, ``target``, ``offset`` per source.

    The total is shared by weight.  A source's target stops at ``most`` times its
    size and the rest is shared again: in the order of cap over weight, a source
    is capped if its cap is below its share of what the ones before left.  One
    row per source is all that meets in one task.
    """
    sources = sizes.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    none = F.lit(0).cast("long")
    sources = sources.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), none))
    sources = sources.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none))
    sources = sources.withColumn("capped", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), none)
    shares = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest * F.col("weight") / shares)
    offset = _hex(F.concat(F.lit(SEED), F.col("source_key")), 13).cast("double") / float(16**13)
    return sources.select("source_key", "source_size", target.alias("target"), offset.alias("offset"))


def mixture(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``doc_id``, ``text_key``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` of every document.

    Size is the number of words.  Every document of a source expects target over
    size copies; the documents stand in the order of size band, a hash of the id,
    size and id, their expectations are summed up from one random offset per
    source, and a document is emitted once per whole number that its stretch
    crosses, ``most`` times at most.  Documents of like size stand together, so
    the words taken come near the target.

    The running sum is of pieces: documents are counted per source, size band and
    slot, these counts are summed up, and places are numbered inside each piece; a
    source of any size is spread over its pieces.

    A null text has size 0, a null source is a source of its own (last), a null id
    sorts first.  Sizes of 0 are never taken more than their share and take no
    words.  Repeated rows stand side by side.  Other columns are ignored.
    """
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), "source",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = save(rows.withColumn("band", F.length(F.bin("size"))).withColumn(
        "slot", F.pmod(_hex(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 4).cast("int"), F.lit(SLOTS))), "sizes")
    sources = save(source_targets(rows, weights, most), "sources")
    piece = ["source_key", "band", "slot"]
    counts = rows.groupBy(*piece).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source_key").orderBy("band", "slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*piece, F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("begin"))
    inside = F.row_number().over(Window.partitionBy(*piece).orderBy("size", "doc_id", "text_key"))
    placed = rows.withColumn("inside", inside).join(starts, piece).join(sources, "source_key")
    place = F.col("begin") + F.col("inside")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(place * rate + F.col("offset")) - F.floor((place - 1) * rate + F.col("offset"))
    placed = placed.withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
    return placed.select("doc_id", "text_key", "size", "source_size", "target", "copies",
                         (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, each repeated ``copies`` times, and ``copy`` from 1.

    A column ``copy`` of the input stays as it is; the number is then ``copy_2``.
    """
    taken = mixture(docs).filter("copies > 0").groupBy(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_key")).agg(
        F.sort_array(F.collect_list("copies")).alias("mixed"))
    rows = packed(docs, id=F.col("doc_id"), key=F.xxhash64("text"))
    # equal rows share the list of their copies
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(1))))
    joined = rows.join(taken, F.col("id").eqNullSafe(F.col("mix_id")) & (F.col("key") == F.col("mix_key"))).filter(F.col("place") <= F.size("mixed"))
    copies = F.element_at("mixed", F.col("place").cast("int")).cast("int")
    return joined.select("row", F.explode(F.sequence(F.lit(1), copies)).alias("n")).select("row.*", F.col("n").alias(free_name(docs.columns, "copy")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::INT % {SLOTS}) AS slot FROM documents),
sources AS (SELECT source, source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (
    SELECT source_key, source_size, source_size * {MOST} AS cap,
           [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
    FROM sources),
flagged AS (
    SELECT *, cap * (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0))
              <= weight * (sum(source_size) OVER () - coalesce(sum(cap) OVER ahead, 0)) AS capped
    FROM weighed WINDOW ahead AS (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
    SELECT source_key, source_size,
           CASE WHEN capped THEN cap::DOUBLE ELSE
               ((sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) * weight)::DOUBLE
               / (sum(weight) FILTER (WHERE NOT capped) OVER ())::DOUBLE END AS target,
           ('0x' || substr(md5('{SEED}' || source_key), 1, 13))::BIGINT::DOUBLE / {float(16**13)!r} AS shift
    FROM flagged),
placed AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           row_number() OVER (PARTITION BY source_key ORDER BY length(bin(size)), slot, size, doc_id NULLS FIRST) AS place
    FROM sized JOIN targets USING (source_key))
SELECT doc_id, size, source_size, target,
       (least(floor(place * rate + shift) - floor((place - 1) * rate + shift), {MOST}) * size)::BIGINT AS taken
FROM placed
"""

"""URL verdicts from rules and from trust propagated over host links."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import save, table

#: Rules as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Damping, what a score may lack at most, and the surplus of distrust over trust from which a host is blocked.
DAMPING, TOLERANCE, THRESHOLD = 0.85, 0.001, 0.5
#: Rounds whose parts of the scores are added up at once, and edges of a host that travel together.
FOLD, LIST = 16, 1024
#: Edges from which the lists of a host are spread over the tasks.
HUB = 1 << 16
#: What the scores may differ by, over all hosts together, when the last rounds are summed instead of run.
EXACT = 1e-8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    inside = (F.col("host") == host) | F.col("host").endswith(f".{host}")
    return inside & F.col("path").startswith(slash + path)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (longest that fits) and ``ruled`` (its verdict)."""
    pages = pages.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    pages = pages.withColumn("path", F.coalesce(path_of(F.col("url")), F.lit("")))
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    none = F.lit(None).cast("string")
    rule = F.coalesce(*(F.when(_fits(r), F.lit(r)) for _, r in ordered), none)
    ruled = F.coalesce(*(F.when(_fits(r), F.lit(v)) for v, r in ordered), none)
    return pages.withColumn("rule", rule).withColumn("ruled", ruled)


def host_edges(pages: DataFrame) -> DataFrame:
    """``a``, ``b``, ``weight``: pages of host ``a`` that link to another host ``b``.

    Relative links stay on their host and make no edge.
    """
    links = F.regexp_extract_all("html", F.lit(_HREF), 1)
    # a link may leave out its scheme
    hosts = F.array_distinct(F.transform(links, lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))))
    return (pages.select(F.col("host").alias("a"), F.explode(hosts).alias("b")).filter("a <> '' AND b <> '' AND a <> b")
            .groupBy("a", "b").agg(F.count("*").cast("double").alias("weight")))


def _added(parts: list[DataFrame]) -> DataFrame:
    names = [c for c in parts[0].columns if c != "host"]
    return reduce(DataFrame.unionByName, parts).groupBy("host").agg(*(F.sum(c).alias(c) for c in names))


def _mass(step: DataFrame) -> float:
    names = [c for c in step.columns if c != "host"]
    return sum(x or 0.0 for x in step.agg(*(F.sum(c) for c in names)).first())


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None,
              tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank ``host``, ``score`` from seeds ``host``, ``seed`` along ``a`` -> ``b``."""
    step = seeds.groupBy("host").agg(F.sum("seed").alias("score"))
    return propagate_all(step, edges, damping, rounds, tolerance)


def propagate_all(step: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None,
                  tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of several scores at once: ``step`` has ``host``, once, and the seeds of every score.

    Scores are in units of a seed, that is, PageRank over (1 - damping).  A round
    hands on what arrived in the last one, and is a table in the shared folder.
    Rounds go on until all that can still arrive, at all hosts together, is below
    ``tolerance``: their number grows with the logarithm of the seeds.  ``rounds``
    ends them earlier.  Rounds that only repeat earlier ones are summed, not run.
    Edges stay where they are, dealt by ``a``, and those of hubs by their lists; only scores move.
    """
    names, tasks = [c for c in step.columns if c != "host"], int(step.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = save(_adjacency(edges), "shares")
    hubs = lists.filter("hub").repartition(tasks).persist(StorageLevel.DISK_ONLY)
    lists = lists.filter("NOT hub").repartition(tasks, "a").sortWithinPartitions("a").persist(StorageLevel.DISK_ONLY)
    try:
        spread = hubs.count() > 0
        if not lists.count() and not spread:
            return step
        parts, n = [step], 0
        older = None  # the step before the last one
        while n != rounds:
            if _mass(step) * damping < tolerance * (1 - damping):
                break
            sent = lists.join(step, lists.a == step.host).select("links", *names)
            if spread:  # hubs are at most the edges over HUB
                few = step.join(F.broadcast(hubs.select("a").distinct()), F.col("host") == F.col("a"), "left_semi")
                sent = sent.unionByName(hubs.join(F.broadcast(few), hubs.a == few.host).select("links", *names))
            sent = sent.select(F.explode("links").alias("x"), *names).groupBy(F.col("x.b").alias("host")).agg(
                *(F.sum(F.col(c) * F.col("x.share") * damping).alias(c) for c in names))
            newer = save(sent, "step")
            parts, n = [*parts, newer], n + 1
            if older is not None:
                rest = _settled(older, step, newer, damping, tolerance, None if rounds is None else rounds - n)
                if rest is not None:
                    return _added([*parts, rest])
            older, step = step, newer
            if len(parts) >= FOLD:
                parts = [save(_added(parts), "scores")]
        return _added(parts)
    finally:
        lists.unpersist()
        hubs.unpersist()


def _adjacency(edges: DataFrame) -> DataFrame:
    """``a``, ``links`` (``b``, ``share``) and ``hub``: edges of a host in lists of about ``LIST`` at most."""
    out = edges.groupBy("a").agg(F.sum("weight").alias("total"), F.count("*").alias("degree"))
    shares = edges.join(out, "a").select(
        "a", F.struct("b", (F.col("weight") / F.col("total")).alias("share")).alias("x"),
        F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / LIST)).alias("part"), (F.col("degree") >= HUB).alias("hub"))
    return shares.groupBy("a", "part", "hub").agg(F.collect_list("x").alias("links")).select("a", "links", "hub")


def _settled(older: DataFrame, step: DataFrame, newer: DataFrame, damping: float, tolerance: float,
             rounds: int | None) -> DataFrame | None:
    """What the rounds after ``newer`` bring, once they only repeat the last two; None before.

    A walk forgets where it began.  When ``newer`` is ``ratio`` times ``older`` at every host, each further round is ``ratio``
    times the one two rounds before it (two, as a graph of two sides swaps them), and the scores of all that are still
    to come are a geometric sum.  A round loses nothing but the damping, so a difference of ``e`` in all grows to at most
    ``e`` times the sum of the damped rounds: nothing is concluded before that is below ``EXACT`` of a seed.  Rounds are
    counted by their masses, so that the sum ends where the loop would.
    """
    names = [c for c in newer.columns if c != "host"]
    before, last, ahead = _mass(older), _mass(step), _mass(newer)
    if not ahead or not before:
        return None
    ratio = ahead / before
    if ratio > damping * damping * (1 + 1e-9):
        return None
    now, then = (frame.select("host", *(F.col(c).alias(f"{c}_{x}") for c in names)) for x, frame in (("now", newer), ("then", older)))
    gaps = (F.sum(F.abs(F.coalesce(f"{c}_now", F.lit(0.0)) - ratio * F.coalesce(f"{c}_then", F.lit(0.0)))) for c in names)
    apart = sum(now.join(then, "host", "full").agg(*gaps).first())
    if apart / (1 - damping) ** 2 >= EXACT:
        return None
    odd, even, n, masses = 0.0, 0.0, 0, (last, ahead)
    while n != rounds and masses[1] * damping >= tolerance * (1 - damping):
        masses, n = (masses[1], masses[0] * ratio), n + 1
        power = ratio ** ((n + 1) // 2)
        odd, even = (odd + power, even) if n % 2 else (odd, even + power)
    odds, evens = (frame.select("host", *((F.col(c) * x).alias(c) for c in names)) for frame, x in ((step, odd), (newer, even)))
    return odds.unionByName(evens)


def _both_ways(edges: DataFrame) -> bool:
    """Whether every edge has its like in the other direction: the sums of two hashes of all are the same."""
    def sums(a: str, b: str) -> list[Column]:
        low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        whole = F.xxhash64(a, b, "weight")
        return [F.sum(low(whole)), F.sum(low(F.shiftright(whole, 32)))]

    row = edges.agg(*sums("a", "b"), *sums("b", "a")).first()
    return row[:2] == row[2:]


def judge_hosts(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None,
                threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``host``, ``trust``, ``distrust``, ``host_verdict`` of seeds ``host``, ``allowed``, ``blocked``.

    Trust follows the edges, distrust runs against them.  Both are one propagation
    over two copies of the hosts.  Where all edges lead both ways, the copies are
    alike: one copy of the hosts carries both scores.
    """
    if _both_ways(edges):
        step = seeds.groupBy("host").agg(F.sum("allowed").alias("trust"), F.sum("blocked").alias("distrust"))
        scores = save(propagate_all(step.filter("trust > 0 OR distrust > 0"), edges, damping, rounds, tolerance), "scores")
        return _judged(seeds.select("host").join(scores, "host", "left"), threshold)

    def side(sign: str, seed: str, a: str, b: str) -> tuple[DataFrame, DataFrame]:
        mark = lambda c: F.concat(F.lit(sign), F.col(c))
        return (seeds.select(mark("host").alias("host"), F.col(seed).alias("seed")),
                edges.select(mark(a).alias("a"), mark(b).alias("b"), "weight"))

    ahead, back = side("+", "allowed", "a", "b"), side("-", "blocked", "b", "a")
    scores = save(propagate(ahead[0].unionByName(back[0]).filter("seed > 0"), ahead[1].unionByName(back[1]),
                            damping, rounds, tolerance), "scores")
    of = lambda sign, name: (scores.filter(F.col("host").startswith(sign))
                             .select(F.expr("substring(host, 2)").alias("host"), F.col("score").alias(name)))
    return _judged(seeds.select("host").join(of("+", "trust"), "host", "left").join(of("-", "distrust"), "host", "left"), threshold)


def _judged(both: DataFrame, threshold: float) -> DataFrame:
    both = both.fillna(0.0, ["trust", "distrust"])
    suspect = (F.col("host") != "") & (F.col("distrust") - F.col("trust") >= threshold)
    return save(both.withColumn("host_verdict", F.when(suspect, "block").otherwise("allow")), "hosts")


def host_verdicts(pages: DataFrame, damping: float = DAMPING, rounds: int | None = None, threshold: float = THRESHOLD,
                  tolerance: float = TOLERANCE) -> DataFrame:
    """``host``, ``trust``, ``distrust``, ``host_verdict`` of every host of ruled pages.

    A host is a seed of trust in proportion to its pages that a rule allows, and of
    distrust to those a rule blocks.  A host that links to blocked ones is suspect.
    """
    seeds = save(pages.groupBy("host").agg(
        F.avg(F.coalesce((F.col("ruled") == "allow").cast("double"), F.lit(0.0))).alias("allowed"),
        F.avg(F.coalesce((F.col("ruled") == "block").cast("double"), F.lit(0.0))).alias("blocked")), "seeds")
    return judge_hosts(seeds, save(host_edges(pages), "edges"), damping, rounds, threshold, tolerance)


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every page.

    The longest rule that fits decides; where none fits, the host's verdict does.
    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is allowed; a null html has no links.  Repeated rows give repeated rows and
    count as pages.  Other columns are ignored.  A frequent host is combined before
    every shuffle; the join back carries ids and paths only.
    """
    ruled = with_rules(pages.select("page_id", "url", "html"), rules)
    hosts = host_verdicts(ruled).select("host", "host_verdict")
    return ruled.drop("html", "url").join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "host_verdict", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))


def trust_of_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The propagation of ``op4`` over a table that holds links: suppliers and the parts they sell.

    Either side links to the other, once per row of ``lineitem``.  Small parts
    (``p_size`` 1) are trusted, large ones (50) distrusted.
    """
    sold = (table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
            .select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), "weight"))
    edges = save(sold.unionByName(sold.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "edges")
    seed = lambda size: (F.col("p_size") == size).cast("double")
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("host"), seed(1).alias("allowed"), seed(50).alias("blocked"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("host"), F.lit(0.0).alias("allowed"), F.lit(0.0).alias("blocked"))
    return judge_hosts(parts.unionByName(suppliers), edges).select(
        "host", F.round("trust", 5).alias("trust"), F.round("distrust", 5).alias("distrust"), "host_verdict")


#: From ``seeds`` and ``edges`` to ``judged``: what arrives in a round is handed on in the next one.
_JUDGED = f"""
starts AS (SELECT '+' || host AS host, allowed AS seed FROM seeds WHERE allowed > 0
           UNION ALL SELECT '-' || host, blocked FROM seeds WHERE blocked > 0),
both_ways AS (SELECT '+' || a AS a, '+' || b AS b, weight FROM edges UNION ALL SELECT '-' || b, '-' || a, weight FROM edges),
shares AS (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS share FROM both_ways),
walk(n, host, score) AS (
    SELECT 0, host, seed::DOUBLE FROM starts
    UNION ALL
    SELECT n + 1, b, sum(score * share * {DAMPING}) FROM (SELECT *, sum(score) OVER () AS mass FROM walk) JOIN shares ON a = host
    WHERE mass * {DAMPING} >= {TOLERANCE} * (1 - {DAMPING}) GROUP BY n, b),
scores AS (SELECT host, sum(score) AS score FROM walk GROUP BY host),
judged AS (
    SELECT s.host, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust,
           CASE WHEN s.host <> '' AND coalesce(d.score, 0) - coalesce(t.score, 0) >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS host_verdict
    FROM seeds s LEFT JOIN scores t ON t.host = '+' || s.host LEFT JOIN scores d ON d.host = '-' || s.host)
"""

OP4_SQL = f"""
WITH RECURSIVE parts AS (
    SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
    SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (
    SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                   WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                   WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                   WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM hosts),
pairs AS (
    SELECT DISTINCT page_id, host AS a, translate(regexp_extract(x, '//([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS b
    FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1)) AS x FROM ruled)),
edges AS (SELECT a, b, count(*)::DOUBLE AS weight FROM pairs WHERE a <> '' AND b <> '' AND a <> b GROUP BY ALL),
seeds AS (
    SELECT host, avg(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1.0 ELSE 0.0 END) AS allowed,
           avg(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1.0 ELSE 0.0 END) AS blocked FROM ruled GROUP BY host),
{_JUDGED}
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE host_verdict END AS verdict
FROM ruled LEFT JOIN judged USING (host)
"""

TRADE_SQL = f"""
WITH RECURSIVE sold AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
edges AS (SELECT a, b, weight FROM sold UNION ALL SELECT b, a, weight FROM sold),
seeds AS (
    SELECT 'p' || p_partkey AS host, CASE WHEN p_size = 1 THEN 1.0 ELSE 0.0 END AS allowed,
           CASE WHEN p_size = 50 THEN 1.0 ELSE 0.0 END AS blocked FROM part
    UNION ALL SELECT 's' || s_suppkey, 0.0, 0.0 FROM supplier),
{_JUDGED}
SELECT host, round(trust, 5) AS trust, round(distrust, 5) AS distrust, host_verdict FROM judged
"""

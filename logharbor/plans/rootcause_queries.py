"""Root-cause prompts, retrieval, replies and stored analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor import constants as K
from logharbor.operators import rootcause as R
from logharbor.operators import token_similarity as S
from logharbor.plans import tables as T
from logharbor.plans.ingest_queries import ingest_time
from logharbor.plans.registry import query
from logharbor.plans.snippets import CLUSTERS, INCIDENTS, TOKENS, sql
from logharbor.plans.table_queries import ISO_SAMPLE, SAMPLE, samples_sql


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- prompts and retrieval

SAMPLES = CLUSTERS + f", samples AS ({samples_sql(20, SAMPLE)})"
QUERIES = SAMPLES + """,
queries AS (SELECT c.id, concat(c.title, ' ', substring(coalesce(s.samples, ''), 1, 500)) AS text
            FROM cases c LEFT JOIN samples s USING (cluster_id)),
store AS (SELECT id, concat(name, ' cluster') AS title, concat(name, ' cluster. ', array_to_string(string_split(representative_messages, '|'), ' ')) AS text
          FROM clusters)
"""
NEAR = QUERIES + f""",
qsets AS (SELECT id, {TOKENS.format('text')} AS toks FROM queries),
dsets AS (SELECT id, title, text, {TOKENS.format('text')} AS toks FROM store),
near AS (SELECT q.id AS query_id, d.id AS doc_id, d.title, d.text,
                round(1 - len(list_intersect(q.toks, d.toks)) / sqrt(len(q.toks)::DOUBLE * len(d.toks)), 9) AS distance
         FROM qsets q, dsets d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM near)
"""


def store(spark, sf_dir):
    """Past incident texts: one per cluster."""
    title = F.concat("name", F.lit(" cluster"))
    return T.clusters(spark, sf_dir).select(
        "id", title.alias("title"),
        R.incident_text(title, F.array_join("representative_messages", " ")).alias("text"))


def context_queries(spark, sf_dir):
    return R.retrieval_queries(T.cluster_incidents(spark, sf_dir), R.log_samples(T.clustered(spark, sf_dir)))


@query("v05_similar_incidents", sql(NEAR, "SELECT query_id, rank, doc_id, round(distance, 6) AS distance FROM ranked WHERE rank <= 5"))
def similar_incidents(spark, sf_dir):
    near = S.top_k_texts(context_queries(spark, sf_dir), store(spark, sf_dir).select("id", "text"), K.TOP_INCIDENTS)
    return near.withColumn("distance", F.round("distance", 6))


TOP_DOCS = f"""
WITH q AS (SELECT CAST(item_id AS VARCHAR) AS id, {TOKENS.format('text')} AS toks FROM benchmark),
d AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, {TOKENS.format('text')} AS toks FROM documents),
near AS (SELECT q.id AS query_id, d.id AS doc_id,
                round(CASE WHEN len(q.toks) = 0 OR len(d.toks) = 0 THEN 1.0
                      ELSE 1 - len(list_intersect(q.toks, d.toks)) / sqrt(len(q.toks)::DOUBLE * len(d.toks)) END, 9) AS distance FROM q, d)
SELECT query_id, doc_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank
FROM near QUALIFY rank <= 5
"""


@query("v05_similar_documents", TOP_DOCS)
def similar_documents(spark, sf_dir):
    """Passages against whole documents, as a larger retrieval store."""
    queries = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    docs = T.table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), "text")
    return S.top_k_texts(queries, docs, K.TOP_INCIDENTS).withColumn("distance", F.round("distance", 6))


CONTEXT = NEAR + """,
context AS (SELECT query_id AS id, string_agg(concat('- ', title, ' (similarity: ', printf('%.0f%%', (1 - distance) * 100), '): ',
                   substring(text, 1, 200)), chr(10) ORDER BY rank) AS similar FROM ranked WHERE rank <= 3 GROUP BY 1)
"""


@query("x02_retrieval_context", sql(CONTEXT, 'SELECT id, "similar" FROM context'))
def retrieval_context(spark, sf_dir):
    return R.retrieval_context(context_queries(spark, sf_dir), store(spark, sf_dir))


@query("x01_root_cause_prompt", sql(CONTEXT, f"""
SELECT c.id, concat('Evidence:', chr(10), s.samples, chr(10), chr(10), 'Earlier cases like it:', chr(10), x.similar, chr(10), chr(10),
  'Case: ', c.title, ' | ', c.log_count, ' lines | rated ', c.severity, ' | seen in ', replace(c.affected_services, '|', ', '),
  chr(10), chr(10), 'What set it off? Reply with one JSON object. Its keys: ', {_quoted(K.ROOT_CAUSE_FIELDS)}, '.') AS prompt
FROM cases c JOIN samples s USING (cluster_id) JOIN context x ON x.id = c.id
"""))
def root_cause_prompt(spark, sf_dir):
    cases, samples = T.cluster_incidents(spark, sf_dir), R.log_samples(T.clustered(spark, sf_dir))
    context = R.retrieval_context(R.retrieval_queries(cases, samples), store(spark, sf_dir))
    return R.root_cause_prompts(cases, samples, context)


@query("t05_timeline_prompt", sql(CLUSTERS + f", samples AS ({samples_sql(50, ISO_SAMPLE)})", f"""
SELECT c.id, concat(samples, chr(10), chr(10), 'Tell what happened above step by step. Reply with one JSON object. Its keys: ',
  {_quoted(K.TIMELINE_FIELDS)}, '.') AS prompt FROM cases c JOIN samples USING (cluster_id)
"""))
def timeline_prompt(spark, sf_dir):
    return R.timeline_prompts(T.cluster_incidents(spark, sf_dir), T.clustered(spark, sf_dir))


@query("x06_cluster_prompt", sql(CLUSTERS, """
SELECT id, concat(log_count, ' lines share the label ', name, ', for example:', chr(10), '- ',
  replace(representative_messages, '|', concat(chr(10), '- ')), chr(10), chr(10), 'What are they about? Two plain sentences at most.') AS prompt FROM clusters
"""))
def cluster_prompt(spark, sf_dir):
    return R.cluster_prompts(T.clusters(spark, sf_dir))


@query("x05_fallback_timeline", sql(CLUSTERS, """
SELECT c.id AS incident_id, 'Timeline generated from log sequence.' AS chain_summary, m.rn - 1 AS position, m.timestamp,
       m.message[1:200] AS event, m.level, m.service
FROM cases c JOIN (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp, id) AS rn FROM members) m
ON m.cluster_id = c.cluster_id WHERE m.rn <= 30
"""))
def fallback_timeline(spark, sf_dir):
    return R.fallback_timelines(T.cluster_incidents(spark, sf_dir), T.clustered(spark, sf_dir))


@query("x05_incident_timelines", sql(CLUSTERS, """
SELECT c.id AS incident_id, 'Timeline generated from log sequence.' AS chain_summary, m.rn - 1 AS position, m.timestamp,
       m.message[1:200] AS event, m.level, m.service
FROM cases c JOIN (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp, id) AS rn FROM members) m
ON m.cluster_id = c.cluster_id WHERE m.rn <= 30 AND c.log_count % 2 = 0
UNION ALL
SELECT id, title, 0, TIMESTAMP '2024-02-01', description, NULL, NULL FROM cases WHERE log_count % 2 = 1
"""))
def incident_timelines(spark, sf_dir):
    """Replies for the clusters with an odd number of lines; those of the others break off."""
    cases = T.cluster_incidents(spark, sf_dir)
    body = F.to_json(F.struct(F.array(F.struct(F.col("description").alias("event"))).alias("timeline"), F.col("title").alias("chain_summary")))
    reply = F.when(F.col("log_count") % 2 == 0, F.lit('{"timeline": [')).otherwise(body)
    given = cases.select(F.col("id").alias("incident_id"), reply.alias("reply"))
    return R.incident_timelines(given, cases, T.clustered(spark, sf_dir), ingest_time())


# ---------------------------------------------------------------- replies

# Model replies built from incident columns: fenced for critical incidents, cut off
# for those under investigation, out-of-range confidence for low severity.
REPLY_BODY = """concat('{"root_causes": [{"cause": "', title, '", "confidence": ', CASE severity WHEN 'low' THEN '1.5' ELSE '0.8' END,
 ', "category": "code"}, {"cause": "load"}], "recommended_fixes": ["check ', description, '", "restart"], "ai_confidence": 0.9, ',
 '"executive_summary": "', title, ' failed", "technical_details": "seen by ', description, '"}')"""
REPLY = f"""CASE WHEN status = 'investigating' THEN '{{"root_causes": [{{"cause":'
 WHEN severity = 'critical' THEN concat('```json', chr(10), {REPLY_BODY}, chr(10), '```') ELSE {REPLY_BODY} END"""
GOOD = "status <> 'investigating' AND severity <> 'low'"


def replies(spark, sf_dir):
    return T.incidents(spark, sf_dir).select(F.col("id").alias("incident_id"), F.expr(REPLY).alias("reply"))


@query("x03_parsed_replies", sql(INCIDENTS, f"""
SELECT id AS incident_id, concat(title, ':0.8:code|load:0.5:') AS causes, concat('check ', description, '|restart') AS recommended_fixes,
       0.9::DOUBLE AS ai_confidence, concat(title, ' failed') AS executive_summary, concat('seen by ', description) AS technical_details,
       '' AS impact_assessment, '' AS prevention_steps FROM incidents WHERE {GOOD}
"""))
def parsed_replies(spark, sf_dir):
    good, _ = R.parse_replies(replies(spark, sf_dir))
    cause = lambda c: F.concat(c["cause"], F.lit(":"), c["confidence"].cast("string"), F.lit(":"), F.coalesce(c["category"], F.lit("")))
    return good.select(
        "incident_id", F.transform("root_causes", cause).alias("causes"), "recommended_fixes", "ai_confidence",
        "executive_summary", "technical_details", "impact_assessment", "prevention_steps")


@query("x03_quarantined_replies", sql(INCIDENTS, f"SELECT id AS incident_id, {REPLY} AS reply FROM incidents WHERE NOT ({GOOD})"))
def quarantined_replies(spark, sf_dir):
    return R.parse_replies(replies(spark, sf_dir))[1]


TIMELINE_REPLY = """concat('{"timeline": [{"timestamp": "', {iso}, 'Z", "event": "start of ', title, '", "level": "ERROR", "service": "api"}, ',
 '{"timestamp": "soon", "event": "end"}], "chain_summary": "', description, '"}')"""
SPARK_TIMELINE = TIMELINE_REPLY.replace("{iso}", "date_format(detected_at, \"yyyy-MM-dd'T'HH:mm:ss\")")


@query("x04_parsed_timelines", sql(INCIDENTS, """
SELECT id AS incident_id, description AS chain_summary, 0::BIGINT AS position, detected_at AS timestamp, concat('start of ', title) AS event,
       'ERROR' AS level, 'api' AS service FROM incidents WHERE status <> 'investigating'
UNION ALL
SELECT id, description, 1, TIMESTAMP '2024-02-01', 'end', NULL, NULL FROM incidents WHERE status <> 'investigating'
"""))
def parsed_timelines(spark, sf_dir):
    reply = F.when(F.col("status") == "investigating", F.lit('{"timeline": [')).otherwise(F.expr(SPARK_TIMELINE))
    given = T.incidents(spark, sf_dir).select(F.col("id").alias("incident_id"), reply.alias("reply"))
    return R.parse_timelines(given, ingest_time())[0]


# ---------------------------------------------------------------- storing

@query("x07_applied_analysis", sql(INCIDENTS, f"""
SELECT id, title, severity, CASE WHEN {GOOD} THEN concat(title, ' failed') END AS ai_summary, CASE WHEN {GOOD} THEN 0.9::DOUBLE END AS ai_confidence,
       CASE WHEN {GOOD} THEN 2::BIGINT END AS causes FROM incidents
"""))
def applied_analysis(spark, sf_dir):
    analysis, _ = R.parse_replies(replies(spark, sf_dir))
    done = R.apply_analysis(T.incidents(spark, sf_dir), analysis)
    causes = F.when(F.col("root_causes").isNotNull(), F.size("root_causes"))
    return done.select("id", "title", "severity", "ai_summary", "ai_confidence", causes.alias("causes"))


@query("x07_summary_rows", sql(INCIDENTS, f"""
SELECT sha256('summary#' || id) AS id, id AS incident_id, concat(title, ' failed') AS executive_summary, 'given' AS model_used,
       TIMESTAMP '2024-02-01' AS generated_at FROM incidents WHERE {GOOD}
"""))
def summary_rows(spark, sf_dir):
    analysis, _ = R.parse_replies(replies(spark, sf_dir))
    rows = R.summary_rows(analysis, "given", ingest_time())
    return rows.select("id", "incident_id", "executive_summary", "model_used", "generated_at")


@query("x07_cluster_summaries", sql(NEAR, """
SELECT sha256('summary#' || c.id) AS id, c.id AS incident_id, concat(c.title, ' failed') AS executive_summary,
       string_agg(concat(r.doc_id, ': ', r.text), chr(10) ORDER BY r.rank) AS similar_past_incidents,
       round(min(r.distance), 6) AS nearest, c.log_count AS token_usage
FROM cases c JOIN ranked r ON r.query_id = c.id WHERE r.rank <= 3 GROUP BY c.id, c.title, c.log_count
"""))
def cluster_summaries(spark, sf_dir):
    """Summaries of clusters' incidents with the past incidents that are like them."""
    cases, past = T.cluster_incidents(spark, sf_dir), store(spark, sf_dir)
    reply = F.to_json(F.struct(F.concat("title", F.lit(" failed")).alias("executive_summary")))
    analysis, _ = R.parse_replies(cases.select(F.col("id").alias("incident_id"), reply.alias("reply")))
    usage = cases.select(F.col("id").alias("incident_id"), F.col("log_count").alias("token_usage"))
    similar = R.similar_incidents(S.top_k_texts(context_queries(spark, sf_dir), past.select("id", "text"), K.CONTEXT_INCIDENTS), past)
    rows = R.summary_rows(analysis.join(usage, "incident_id"), "given", ingest_time(), similar)
    line = lambda s: F.concat(s["incident_id"], F.lit(": "), s["document"])
    return rows.select(
        "id", "incident_id", "executive_summary", F.array_join(F.transform("similar_past_incidents", line), "\n").alias("similar_past_incidents"),
        F.round(F.element_at("similar_past_incidents", 1)["distance"], 6).alias("nearest"), "token_usage")


@query("x07_incident_texts", sql(INCIDENTS, f"""
SELECT id, title, CASE WHEN {GOOD} THEN concat(title, '. ', title, ' failed') ELSE concat(title, '. ') END AS text FROM incidents
"""))
def incident_texts(spark, sf_dir):
    cases = T.incidents(spark, sf_dir)
    analysis, _ = R.parse_replies(replies(spark, sf_dir))
    old = cases.select("id", "title", R.incident_text(F.col("title"), F.lit(None).cast("string")).alias("text"), F.lit(1).alias("version"))
    return R.upsert_incident_texts(old, cases, analysis, F.lit(2)).select("id", "title", "text")


@query("x08_incident_summary", sql(INCIDENTS, f"""
SELECT id AS incident_id, title, concat(title, ' failed') AS executive_summary FROM incidents WHERE {GOOD} AND status = 'open'
"""))
def incident_summary(spark, sf_dir):
    analysis, _ = R.parse_replies(replies(spark, sf_dir))
    rows = R.summary_rows(analysis, "given", ingest_time())
    found = R.incident_summary(rows, T.incidents(spark, sf_dir).filter("status = 'open'"))
    return found.select("incident_id", "title", "executive_summary")



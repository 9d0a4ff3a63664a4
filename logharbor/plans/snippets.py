"""SQL shared by the oracles: anomaly flags, clusters, incidents, parsed lines."""

from __future__ import annotations

from logharbor import constants as K
from logharbor.functions.parsing import any_of
from logharbor.plans.tables import ALERTS, INCIDENTS, LOGS

ERRORS = "level IN ('ERROR', 'CRITICAL')"


def hits(column: str, words: list[str]) -> str:
    return f"regexp_matches(lower({column}), '{any_of(words)}')"


FLAGS = f"""
{LOGS},
rates AS (SELECT date_trunc('hour', timestamp) AS w, count(*) AS total,
                 count(*) FILTER (WHERE {ERRORS}) AS errors FROM logs GROUP BY 1),
scored AS (SELECT l.*, CASE WHEN {hits('message', K.CRITICAL_PHRASES)} THEN 0.95::DOUBLE
                            WHEN {ERRORS} AND errors / total > 0.3 THEN 0.75::DOUBLE
                            WHEN level = 'WARNING' AND errors / total > 0.3 THEN 0.45::DOUBLE
                            ELSE 0.0::DOUBLE END AS s
           FROM logs l JOIN rates r ON date_trunc('hour', l.timestamp) = r.w),
flagged AS (SELECT * EXCLUDE (s), s > 0.4 AS is_anomaly, CASE WHEN s > 0.4 THEN s END AS anomaly_score FROM scored)
"""

TEXT = "concat('[', level, '] ', coalesce(service, 'unknown'), ': ', message)"
TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''))"

PAIRS = f"""
{FLAGS},
texts AS (SELECT {TEXT} AS text, min(id) AS id, count(*) AS weight FROM logs GROUP BY 1),
sets AS (SELECT id, {TOKENS.format('text')} AS toks FROM texts),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.toks, b.toks)) AS overlap,
                 len(a.toks) AS size_a, len(b.toks) AS size_b
          FROM sets a JOIN sets b ON a.id < b.id
          WHERE 16 * len(list_intersect(a.toks, b.toks)) * len(list_intersect(a.toks, b.toks))
                >= 9 * len(a.toks) * len(b.toks))
"""

LABELS = f"""
{PAIRS},
links AS (SELECT id_a AS u, id_b AS v FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach(id, root) AS (SELECT id, id FROM texts UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
heavy AS (SELECT root FROM roots JOIN texts USING (id) GROUP BY root HAVING sum(weight) >= 2),
labels AS (SELECT t.text, t.id, t.weight, r.root AS cluster_id FROM texts t JOIN roots r USING (id)
           WHERE r.root IN (SELECT root FROM heavy)),
members AS (SELECT f.*, b.cluster_id FROM flagged f LEFT JOIN labels b ON b.text = {TEXT.replace('level', 'f.level').replace('service', 'f.service').replace('message', 'f.message')})
"""

_rank = "CASE " + " ".join(
    f"WHEN {hits('message', words)} THEN {K.SEVERITIES.index(name) + 1}" for name, words in K.SEVERITY_WORDS
) + " ELSE 1 END"
_name = "CASE " + " ".join(f"WHEN {hits('txt', words)} THEN '{name}'" for name, words in K.CLUSTER_NAMES)

CLUSTERS = f"""
{LABELS},
firsts AS (SELECT cluster_id, message, row_number() OVER (PARTITION BY cluster_id ORDER BY timestamp, id) AS rn
           FROM members WHERE cluster_id IS NOT NULL QUALIFY rn <= 5),
joined AS (SELECT cluster_id, lower(string_agg(message, ' ' ORDER BY rn)) AS txt,
                  string_agg(message, '|' ORDER BY rn) AS representative_messages FROM firsts GROUP BY 1),
words AS (SELECT cluster_id, w, count(*) AS n
          FROM (SELECT cluster_id, unnest(string_split_regex(txt, '\\s+')) AS w FROM joined)
          WHERE length(w) > 4 GROUP BY 1, 2),
best AS (SELECT cluster_id, w FROM words QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, w) = 1),
names AS (SELECT j.cluster_id, {_name} WHEN w IS NOT NULL
            THEN concat(upper(w[1]), w[2:], ' Events') ELSE 'Unknown Cluster' END AS name
          FROM joined j LEFT JOIN best b USING (cluster_id)),
clusters AS (
  SELECT m.cluster_id AS id, any_value(n.name) AS name,
         concat('Auto-clustered ', count(*), ' events via embedding similarity') AS description,
         count(*) AS log_count,
         ['low', 'medium', 'high', 'critical'][max({_rank})] AS severity,
         any_value(representative_messages) AS representative_messages,
         array_to_string(list_sort(list_distinct(list(service))), '|') AS tags,
         min(timestamp) AS first_seen, max(timestamp) AS last_seen
  FROM members m JOIN names n USING (cluster_id) JOIN joined j USING (cluster_id) GROUP BY m.cluster_id),
cases AS (
  SELECT sha256('incident#' || id) AS id, concat(name, ' — ', upper(severity), ' Incident') AS title,
         description, severity, 'open' AS status, id AS cluster_id, log_count, first_seen AS detected_at,
         tags AS affected_services
  FROM clusters WHERE severity IN ('high', 'critical'))
"""

# Fields of the raw lines; a line without a level word takes its level from hints.
_hint = "CASE " + " ".join(f"WHEN {hits('raw_line', words)} THEN '{name}'" for name, words in K.LEVEL_HINTS)
PARSED = f"""
{LOGS},
parsed AS (SELECT id, session_id, date_trunc('second', timestamp) AS timestamp,
  CASE WHEN raw_line[3] = '/' THEN {_hint} ELSE 'INFO' END ELSE level END AS level, service,
  CASE WHEN raw_line[1] = '{{' THEN message
       WHEN raw_line[1] = '[' THEN concat('[', service, '] ', message)
       WHEN raw_line[3] = '/' THEN concat(service, ' ', message)
       ELSE concat(service, ': ', message) END AS message,
  raw_line FROM logs)
"""


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select.strip()}"


__all__ = ["ALERTS", "CLUSTERS", "ERRORS", "FLAGS", "INCIDENTS", "LABELS", "LOGS", "PAIRS", "PARSED",
           "TEXT", "TOKENS", "hits", "sql"]

"""Similarity, clustering and embedding jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from logharbor.functions import text as X
from logharbor.functions import vectors as V
from logharbor.operators import clustering as C
from logharbor.operators import dense_similarity as D
from logharbor.operators import lookups as L
from logharbor.operators import relations as J
from logharbor.operators import token_similarity as S
from logharbor.plans import tables as T
from logharbor.plans.registry import query
from logharbor.plans.snippets import LABELS, LOGS, PAIRS, TOKENS, sql
from logharbor.session import cut_lineage

COSINE = 0.40  # the test vectors have no pairs at 0.75


# ---------------------------------------------------------------- token sets

@query("v01_token_vectors", sql(PAIRS, """
SELECT t.id, t.text, t.weight, array_to_string(list_sort(s.toks), '|') AS tokens FROM texts t JOIN sets s USING (id)
"""))
def token_vectors(spark, sf_dir):
    texts = S.distinct_texts(T.logs(spark, sf_dir))
    return texts.select("id", "text", "weight", F.sort_array(X.tokens(F.col("text"))).alias("tokens"))


@query("j09_similarity_pairs", sql(PAIRS, "SELECT id_a, id_b, overlap::BIGINT AS overlap, size_a::BIGINT AS size_a, size_b::BIGINT AS size_b FROM pairs"))
def similarity_pairs(spark, sf_dir):
    return S.similar_pairs(S.rank_tokens(S.distinct_texts(T.logs(spark, sf_dir))))


DOCS = f"""
docs AS (SELECT text, min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS id, count(*) AS weight FROM documents GROUP BY text),
sets AS (SELECT id, {TOKENS.format('text')} AS toks FROM docs),
words AS (SELECT row_number() OVER (ORDER BY id) AS k, id, len(toks) AS n, toks FROM sets),
exploded AS (SELECT k, unnest(toks) AS w FROM words),
shared AS (SELECT a.k AS ka, b.k AS kb, count(*) AS m FROM exploded a JOIN exploded b ON a.w = b.w AND a.k < b.k GROUP BY 1, 2),
near AS (SELECT a.id AS id_a, b.id AS id_b, m AS overlap, a.n AS size_a, b.n AS size_b
         FROM shared JOIN words a ON a.k = ka JOIN words b ON b.k = kb WHERE 16 * m * m >= 9 * a.n * b.n)
"""


def distinct_documents(spark, sf_dir):
    """Documents as long log texts: distinct whole texts with their smallest key."""
    key = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    return T.table(spark, sf_dir, "documents").groupBy("text").agg(F.min(key).alias("id"), F.count("*").alias("weight"))


@query("j09_similar_documents", sql(DOCS, """
SELECT id_a, id_b, overlap::BIGINT AS overlap, size_a::BIGINT AS size_a, size_b::BIGINT AS size_b FROM near
"""))
def similar_documents(spark, sf_dir):
    texts = cut_lineage(distinct_documents(spark, sf_dir))
    return S.similar_pairs(cut_lineage(S.rank_tokens(texts)))


@query("v06_document_clusters", sql(DOCS + """,
links AS (SELECT id_a AS u, id_b AS v FROM near UNION ALL SELECT id_b, id_a FROM near),
reach(id, root) AS (SELECT id, id FROM docs UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
""", """
SELECT id, root AS cluster_id FROM roots WHERE root IN (
  SELECT root FROM roots JOIN docs USING (id) GROUP BY root HAVING sum(weight) >= 2)
"""))
def document_clusters(spark, sf_dir):
    texts = cut_lineage(distinct_documents(spark, sf_dir))
    links = S.similarity_links(cut_lineage(S.rank_tokens(texts)))
    return C.cluster_points(texts.select("id", "weight"), links, 2)


# ---------------------------------------------------------------- density clustering

@query("v06_density_clusters", sql(LABELS, "SELECT text, id, weight, cluster_id FROM labels"))
def density_clusters(spark, sf_dir):
    return C.cluster_logs(T.logs(spark, sf_dir))


@query("v06_density_min_samples", sql(PAIRS + """,
near AS (SELECT id_a AS u, id_b AS v FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
around AS (SELECT t.id, t.weight + coalesce((SELECT sum(x.weight) FROM near n JOIN texts x ON x.id = n.v WHERE n.u = t.id), 0) AS w FROM texts t),
core AS (SELECT id FROM around WHERE w >= 450),
inner_links AS (SELECT u, v FROM near WHERE u IN (SELECT id FROM core) AND v IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT l.v, r.root FROM reach r JOIN inner_links l ON l.u = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
""", """
SELECT t.text, t.id, t.weight, r.root AS cluster_id FROM texts t JOIN roots r USING (id)
UNION ALL
SELECT t.text, t.id, t.weight, min(r.root) FROM texts t JOIN near n ON n.u = t.id JOIN roots r ON r.id = n.v
WHERE t.id NOT IN (SELECT id FROM core) GROUP BY 1, 2, 3
"""))
def density_min_samples(spark, sf_dir):
    return C.cluster_logs(T.logs(spark, sf_dir), min_samples=450)


@query("v07_noise", sql(LABELS, """
SELECT count(cluster_id) AS clustered, count(*) FILTER (WHERE cluster_id IS NULL) AS noise FROM members
"""))
def noise(spark, sf_dir):
    return C.noise_count(J.attach_clusters(T.logs(spark, sf_dir), T.labels(spark, sf_dir)))


@query("v10_recluster_unclustered", sql(LABELS.replace(
    "texts AS (SELECT", "todo AS (SELECT * FROM logs WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels_given)),\ntexts AS (SELECT")
    .replace("min(id) AS id, count(*) AS weight FROM logs", "min(id) AS id, count(*) AS weight FROM todo")
    .replace("WITH RECURSIVE ", "").replace("labels AS (SELECT t.text", "found AS (SELECT t.text").replace("LEFT JOIN labels b", "LEFT JOIN found b")
    .replace("labels_given", "labels"), "SELECT text, id, weight, cluster_id FROM found"))
def recluster_unclustered(spark, sf_dir):
    given = T.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("cluster_id"))
    todo = L.unclustered(T.logs(spark, sf_dir).join(given, "id", "left"), None)
    return C.cluster_logs(todo)


# ---------------------------------------------------------------- dense vectors

def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query("v02_l2_normalise", """
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM n)
SELECT vec_id, array_to_string(list_transform(u, lambda x: CAST(floor(x * 1000000 + 0.5) AS BIGINT)), '|') AS unit FROM u
""")
def l2_normalise(spark, sf_dir):
    """Whole unit vectors, in millionths."""
    unit = T.table(spark, sf_dir, "embeddings").withColumn("u", V.l2_normalise(F.col("embedding")))
    return unit.select("vec_id", F.array_join(F.transform("u", lambda x: F.floor(x * 1000000 + 0.5).cast("string")), "|").alias("unit"))


@query("v03_cosine", f"""
WITH first AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label)
SELECT v.vec_id, round({_cos('v.embedding', 'f.e')}, 6) AS cosine FROM embeddings v JOIN first f USING (label)
""")
def cosine(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    return e.join(first, "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("f")), 6).alias("cosine"))


@query("v04_similar_logs", sql(LOGS, f"""
SELECT id, level, round(1 - {_cos('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6) AS distance
FROM logs JOIN embeddings ON id = CAST(vec_id AS VARCHAR) WHERE level = 'INFO' AND service = 'api'
ORDER BY round(1 - {_cos('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 9), id LIMIT 20
"""))
def similar_logs(spark, sf_dir):
    vectors = T.vectors(spark, sf_dir)
    given = L.by_id(vectors, "0").first()["embedding"]  # the caller's query vector
    corpus = T.logs(spark, sf_dir).select("id", "level", "service").join(vectors, "id")
    found = D.find_similar(corpus, list(given), 20, level="INFO", service="api")
    return found.select("id", "level", F.round("distance", 6).alias("distance"))


@query("v04_similar_logs_batch", f"""
WITH q AS (SELECT min(vec_id) AS qid FROM embeddings GROUP BY label),
s AS (SELECT CAST(qid AS VARCHAR) AS query_id, CAST(d.vec_id AS VARCHAR) AS doc_id,
             1 - {_cos('e.embedding', 'd.embedding')} AS distance
      FROM q JOIN embeddings e ON e.vec_id = qid, embeddings d)
SELECT query_id, doc_id, round(distance, 6) AS distance,
       row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank
FROM s QUALIFY rank <= 20
""")
def similar_logs_batch(spark, sf_dir):
    vectors = T.vectors(spark, sf_dir)
    firsts = T.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").cast("string").alias("id"))
    queries = vectors.drop("label").join(firsts.select("id"), "id", "left_semi")
    return D.find_similar_batch(vectors, queries, 20).withColumn("distance", F.round("distance", 6))


@query("v04_similar_logs_all", f"""
WITH s AS (SELECT CAST(e.vec_id AS VARCHAR) AS query_id, CAST(d.vec_id AS VARCHAR) AS doc_id,
                  1 - {_cos('e.embedding', 'd.embedding')} AS distance FROM embeddings e, embeddings d)
SELECT query_id, doc_id, round(distance, 6) AS distance,
       row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank
FROM s QUALIFY rank <= 5
""")
def similar_logs_all(spark, sf_dir):
    """Every vector as a query."""
    vectors = T.vectors(spark, sf_dir)
    return D.find_similar_batch(vectors, vectors, 5).withColumn("distance", F.round("distance", 6))


@query("j09_dense_pairs", f"""
SELECT CAST(a.vec_id AS VARCHAR) AS id_a, CAST(b.vec_id AS VARCHAR) AS id_b, round({_cos('a.embedding', 'b.embedding')}, 6) AS cosine
FROM embeddings a JOIN embeddings b ON CAST(a.vec_id AS VARCHAR) < CAST(b.vec_id AS VARCHAR)
WHERE {_cos('a.embedding', 'b.embedding')} >= {COSINE}
""")
def dense_pairs(spark, sf_dir):
    pairs = D.similar_row_pairs(T.vectors(spark, sf_dir), COSINE)
    return pairs.withColumn("cosine", F.round("cosine", 6))


DENSE = f"""
points AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.id AS u, b.id AS v FROM points a JOIN points b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE})"""


@query("v06_dense_clusters", sql(DENSE + """,
reach(id, root) AS (SELECT id, id FROM points UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)""", """
SELECT id, root AS cluster_id FROM roots WHERE root IN (SELECT root FROM roots GROUP BY root HAVING count(*) >= 2)
"""))
def dense_clusters(spark, sf_dir):
    return D.cluster_vectors(T.vectors(spark, sf_dir), COSINE)


@query("v06_dense_min_samples", sql(DENSE + """,
core AS (SELECT u AS id FROM links GROUP BY u HAVING count(*) + 1 >= 3),
inner_links AS (SELECT u, v FROM links WHERE u IN (SELECT id FROM core) AND v IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT l.v, r.root FROM reach r JOIN inner_links l ON l.u = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)""", """
SELECT id, root AS cluster_id FROM roots UNION ALL
SELECT u, min(root) FROM links JOIN roots ON roots.id = v WHERE u NOT IN (SELECT id FROM core) GROUP BY u
"""))
def dense_min_samples(spark, sf_dir):
    return D.cluster_vectors(T.vectors(spark, sf_dir), COSINE, min_samples=3)


@query("v12_centroids", """
SELECT label::BIGINT AS label, pos - 1 AS pos, round(avg(embedding[pos]::DOUBLE), 6) AS mean
FROM embeddings, range(1, 65) r(pos) GROUP BY 1, 2
""")
def centroids(spark, sf_dir):
    c = C.centroids(T.table(spark, sf_dir, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "mean")).select(
        "label", "pos", F.round("mean", 6).alias("mean"))


# ---------------------------------------------------------------- embedding jobs

def letter_counts(texts: list[str]) -> np.ndarray:
    """A stand-in for the caller's model: counts of 26 letters."""
    return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], dtype=np.float32)


def _records(embedded):
    return embedded.select(
        F.col("id").alias("log_entry_id"), X.vector_id(F.col("id")).alias("chroma_id"),
        F.lit("letters").alias("model_name"), F.size("embedding").alias("embedding_dimension"),
        F.round(F.element_at("embedding", 5).cast("double"), 5).alias("e_share"))


LETTERS = ", ".join(f"length(txt) - length(replace(txt, '{chr(97 + i)}', ''))" for i in range(26))
EMBEDDED = f"""
SELECT id AS log_entry_id, substring(sha256(id), 1, 32) AS chroma_id, 'letters' AS model_name, 26::BIGINT AS embedding_dimension,
       round(c[5] / sqrt(list_sum(list_transform(c, lambda x: x * x)))::DOUBLE, 5) AS e_share
FROM (SELECT id, [{LETTERS}]::DOUBLE[] AS c FROM (SELECT id, lower(concat('[', level, '] ', service, ': ', message)) AS txt FROM todo))
"""


def _texts(logs):
    return logs.select("id", X.embedding_text(F.col("level"), F.col("service"), F.col("message")).alias("text"))


@query("v08_embedding_backlog", sql(LOGS + """,
todo AS (SELECT * FROM logs WHERE id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings))
""", EMBEDDED))
def embedding_backlog(spark, sf_dir):
    todo = J.pending_embeddings(T.logs(spark, sf_dir), T.embedding_records(spark, sf_dir))
    return _records(D.embed_texts(_texts(todo), letter_counts))


@query("v09_embed_ids", sql(LOGS + """,
todo AS (SELECT * FROM logs WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels))
""", EMBEDDED))
def embed_ids(spark, sf_dir):
    ids = T.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return _records(D.embed_texts(_texts(J.logs_for_ids(T.logs(spark, sf_dir), ids)), letter_counts))



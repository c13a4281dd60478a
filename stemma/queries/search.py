"""Vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import search as S
from ..sources.tables import table

_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(f"""SELECT query_id, vec_id, round(s, 6) AS similarity, CAST(n AS BIGINT) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS.format(a='q.embedding', b='v.embedding')} AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a='q.embedding', b='v.embedding')} DESC, v.vec_id) AS n FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE n <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id 20 divides, over all vectors."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return S.top_k(e, asked, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT query_id, vec_id, round(s, 6) AS similarity, CAST(n AS BIGINT) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS.format(a='q.embedding', b='v.embedding')} AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a='q.embedding', b='v.embedding')} DESC, v.vec_id) AS n FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND q.label <> v.label WHERE q.vec_id % 20 = 0 AND v.label <> 3) WHERE n <= 8""")
def cosine_topk_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above with a filter on candidates and pairs of one label left out."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("ql"))
    return S.top_k(e.where("label <> 3"), asked, 8, unlike=("label", "ql")).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As cosine_topk, through an index of at most 100 lists: every vector is filed, each query looks into as many of its nearest lists as a measured recall of 0.95 asks for."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    centres = S.fit_centres(e)
    indexed = S.index_vectors(e, centres)
    return S.search_index(indexed, asked, centres, 5, probes=S.measured_probes(indexed, asked, centres)).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH p AS (SELECT o.vec_id, s.vec_id AS from_id, s.label, {_COS.format(a='o.embedding', b='s.embedding')} AS c FROM embeddings o JOIN embeddings s ON o.label = s.label WHERE o.vec_id % 5 = 0 AND s.vec_id % 5 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, from_id) AS n FROM p WHERE c >= 0.2) SELECT vec_id, arg_min(CAST(from_id % 4 AS BIGINT), n) AS label, round(max(c), 6) AS similarity, CAST(count(*) AS BIGINT) AS neighbours FROM r WHERE n <= 3 GROUP BY vec_id""")
def knn_label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels carried over from the nearest labelled vectors of the same section (every fifth row lacks one)."""
    e = table(spark, sf_dir, "embeddings").withColumn("kind", F.col("vec_id") % 4)
    return S.transfer_labels(e, F.col("vec_id") % 5 != 0, "kind", "label", least=0.2).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT vec_id, CASE WHEN embedding IS NULL THEN 'MISSING' WHEN len(embedding) <> 64 THEN 'LENGTH' END AS reason FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64
  OR list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))""")
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that cannot be searched."""
    return S.check_vectors(table(spark, sf_dir, "embeddings"), 64)


@query("""WITH i AS (SELECT doc_id, 'm1' AS model, sha256(text) AS text_hash FROM documents), s AS (SELECT doc_id, 'm1' AS model, CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE sha256(text) END AS text_hash FROM documents WHERE doc_id % 5 <> 0)
SELECT i.doc_id, i.model, i.text_hash, CASE WHEN s.doc_id IS NULL THEN 'CREATE' WHEN s.text_hash IS DISTINCT FROM i.text_hash THEN 'UPDATE' ELSE 'SKIP' END AS action FROM i LEFT JOIN s ON i.doc_id = s.doc_id AND i.model = s.model""")
def vector_upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which embeddings would be created, updated or left."""
    i = table(spark, sf_dir, "documents").select("doc_id", F.lit("m1").alias("model"), F.sha2("text", 256).alias("text_hash"))
    s = i.where("doc_id % 5 <> 0").withColumn("text_hash", F.when(F.col("doc_id") % 6 == 0, "old").otherwise(F.col("text_hash")))
    return S.upsert_vectors(s, i, ["doc_id", "model"])

"""Sequential kernels and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import kernels as K
from ..sources.tables import table
from ..sources.views import boxes
from ..streaming import progress_stream, run_available
from ..streaming.progress import read_events


@query()
def lcs_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against part types, by longest common subsequence."""
    p = table(spark, sf_dir, "part")
    types = p.select(F.col("p_type").alias("candidate_title")).distinct().withColumn("code", F.col("candidate_title"))
    return K.match_titles(p, types, "p_partkey", "p_name")


@query()
def bbox_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that run into each other, cut and moved apart."""
    return K.correct_boxes(boxes(spark, sf_dir))


@query()
def a4_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines laid out on two-column pages."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("sheet"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), (F.col("l_quantity") * 3 + 20).alias("height"), (F.col("l_partkey") % 29 == 0).alias("force"))
    from pyspark.sql import Window as W

    ordered = rows.select("sheet", F.row_number().over(W.partitionBy("sheet").orderBy("o")).cast("long").alias("item"), "height", "force")
    return K.paginate(ordered, "sheet", "item", "height", force="force")


@query()
def math_span_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with mathematics put in and taken out again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" $x^2$ end")).alias("t"))
    return d.select("doc_id", F.size(K.math_spans("t")).cast("long").alias("spans"), F.length(K.strip_math("t")).cast("long").alias("left"))


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of even items matched with those of odd ones."""
    b = boxes(spark, sf_dir).withColumn("number", F.floor((F.col("item") + 1) / 2))
    return K.greedy_match(b.where("item % 2 = 0").withColumnRenamed("item", "t"), b.where("item % 2 = 1").withColumnRenamed("item", "p"))


@query()
def figure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close labels gathered to figures, and large boxes, which hold no text here."""
    return K.cluster_labels(boxes(spark, sf_dir).withColumn("content", F.lit("")), text="content")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per day and kind, from the stream."""
    out = run_available(progress_stream(read_events(spark, sf_dir)))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))

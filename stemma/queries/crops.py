"""Crops of problems judged by their boxes, neighbours and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.crops import gated_crops
from ..sources.views import crop_parts, crops


@query()
def crop_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crop with its decision, what speaks against it, and how high it is when cut back to the next problem."""
    found = gated_crops(crops(spark, sf_dir), blocks=crop_parts(spark, sf_dir, 0.1), images=crop_parts(spark, sf_dir, 0.05))
    return found.select("page", "item", F.round("iou", 6).alias("iou"), "next_number", F.array_join("neighbours", ",").alias("neighbours"), "adjacent", "decision", F.array_join("hard", ",").alias("hard"), F.array_join("soft", ",").alias("soft"), F.round("recovery_h", 6).alias("recovery_h"))

"""Bounded training samples and folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of fold 2 of 4 are never learned from.
HELD_OUT = 2


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def held_out(id_col: str) -> Column:
    """Whether a row's id is in the fold that is kept from training; false for null ids."""
    return F.coalesce(fold(id_col) == HELD_OUT, F.lit(False))


def sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the id: the same rows each time, whatever the partitions.

    Where there are no more than `most` rows, all; never more than `most` + 10 %.
    """
    n = rows.count()
    if n <= most:
        return rows
    share = most / n
    return rows.where(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")) < F.lit(int(-(2**63) + share * 2**64))).limit(most + math.ceil(most / 10))


def sample_each(rows: DataFrame, id_col: str, class_col: str, most: int, total: int | None = None) -> DataFrame:
    """About `most` rows of each class at most, all rows of a smaller one; chosen as sample() does.

    `total` (10 * most unless given) bounds all classes together: where there are very many, each gives a like share.
    """
    counts = rows.groupBy(class_col).count()
    total = 10 * most if total is None else total
    wanted, classes = counts.agg(F.sum(F.least(F.col("count"), F.lit(most))), F.count("*")).first()
    part = min(1.0, total / max(1, wanted or 0))
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.col("count")) * part
    shares = counts.select(F.col(class_col).alias("__class"), share.alias("__share"))
    if classes <= 100_000:  # some tens of bytes a class: rows stay where they are, however many have one class
        shares = F.broadcast(shares)
    hashed = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")) / F.lit(2.0**64) + 0.5
    return rows.join(shares, rows[class_col] == shares["__class"]).where((F.col("__share") >= 1) | (hashed < F.col("__share"))).drop("__class", "__share").limit(total + math.ceil(total / 10))

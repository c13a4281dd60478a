"""Exact duplicates, pair classes, keepers and incremental differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, char_count, duplicate_key, normal_text

#: Visible characters that an equal text needs to count as a duplicate, and to count as a long one.
LEAST_CHARS, LONG_CHARS, KEEPER_CHARS = 12, 80, 24


def fingerprint(text: Column) -> Column:
    """SHA-256 of the normal form, null for texts that are too short to compare."""
    return measured(text)["fp"]


def measured(text: Column) -> Column:
    """struct(fp, chars) of a text's normal form, which is worked out once; fp as fingerprint() says."""

    def use(plain: Column) -> Column:
        return bound(char_count(plain), lambda n: F.struct(F.when(n >= LEAST_CHARS, F.sha2(plain, 256)).alias("fp"), n.alias("chars")))

    return bound(normal_text(text), use)


def fingerprints(rows: DataFrame, key: str, text_col: str, structure: Column | None = None, content: Column | None = None) -> DataFrame:
    """(key, kind, value): NORMALIZED_TEXT, STRUCTURE and FILE_HASH values of each row, those there are."""
    kinds = {"NORMALIZED_TEXT": fingerprint(F.col(text_col)), "STRUCTURE": F.sha2(structure, 256) if structure is not None else None, "FILE_HASH": F.sha2(content, 256) if content is not None else None}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items() if v is not None])
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.kind", "p.value").where("value is not null").distinct()


def exact_duplicates(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """Rows whose normal form others share, with its group's size and smallest key.

    Groups are counted by hash with map-side combine and joined back, one row per group on that side; no group is gathered.
    """
    hashed = rows.select(key, fingerprint(F.col(text_col)).alias("fingerprint")).where("fingerprint is not null")
    groups = hashed.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min(key).alias("keeper")).where("copies > 1")
    return hashed.join(groups, "fingerprint").select(key, "fingerprint", "copies", "keeper")


def keepers(rows: DataFrame, key: str, text_col: str, code: str) -> DataFrame:
    """Extras of each group under the loose key, and the code that stays: the smallest."""
    loose = rows.select(key, F.col(code), duplicate_key(F.col(text_col)).alias("k")).where(F.length("k") >= KEEPER_CHARS).withColumn("k", F.sha2("k", 256))
    groups = loose.groupBy("k").agg(F.min(code).alias("kept_code"), F.count("*").alias("n")).where("n > 1").drop("n")
    return loose.join(groups, "k").where(F.col(code) != F.col("kept_code")).select(key, F.col(code), "kept_code")


def pair_class(exact: Column, same_id: Column, same_page: Column, same_number: Column, long: Column, overlap: Column, same_structure: Column) -> Column:
    """struct(kind, status, block_extra, clears): what a pair of items is, by the first condition that holds."""
    as_ = lambda kind, status, block, clears: F.struct(F.lit(kind).alias("kind"), F.lit(status).alias("status"), F.lit(block).alias("block_extra"), F.lit(clears).alias("clears"))
    return (
        F.when(same_id, as_("EXACT_DUPLICATE", "LINKED", False, True))
        .when(exact & same_page & same_number, as_("EXACT_DUPLICATE", "LINKED", True, True))
        .when(exact & long & (same_page | (overlap >= 0.5)), as_("EXACT_DUPLICATE", "LINKED", True, True))
        .when(exact & ~long & ~same_number, as_("SIMILAR_DISTINCT", "KEPT_DISTINCT", False, True))
        .when(same_page & same_number & ~exact & same_structure, as_("VERSION_CANDIDATE", "HUMAN_REVIEW", False, False))
        .when(~exact & (~same_page | ~same_number), as_("SIMILAR_DISTINCT", "KEPT_DISTINCT", False, True))
        .otherwise(as_("UNCERTAIN", "HUMAN_REVIEW", False, False))
    )


#: Which class of an item's pairs counts: the first.
CLASS_ORDER = ("EXACT_DUPLICATE", "VERSION_CANDIDATE", "UNCERTAIN", "SIMILAR_DISTINCT")


def duplicate_pairs(items: DataFrame, key: str, text_col: str, page: str, number: str) -> DataFrame:
    """Each item of an equal-text group against the group's keeper (smallest number, then page, then key), with its class.

    The keeper is one row per group, so a group of any size gives as many rows as it has members, less one.
    """
    rows = items.select(key, page, number, measured(F.col(text_col)).alias("m")).select(key, page, number, "m.fp", "m.chars").where("fp is not null")
    rank = F.struct(F.coalesce(F.regexp_replace(number, "[^0-9]", "").try_cast("long"), F.col(page) * 10_000, F.lit(0)).alias("r"), F.coalesce(F.col(page), F.lit(0)).alias("p"), F.col(key).alias("k"))
    keep = rows.groupBy("fp").agg(F.min_by(F.struct(F.col(key).alias("keeper"), F.col(page).alias("kpage"), F.col(number).alias("knumber")), rank).alias("g"), F.count("*").alias("n")).where("n > 1").select("fp", "g.*")
    pairs = rows.join(keep, "fp").where(F.col(key) != F.col("keeper"))
    known = lambda c: F.coalesce(c, F.lit(False))
    verdict = pair_class(F.lit(True), F.lit(False), known(F.col(page) == F.col("kpage")), known(F.col(number) == F.col("knumber")), F.col("chars") >= LONG_CHARS, F.lit(0.0), F.lit(False))
    return pairs.select(F.col(key), "keeper", verdict.alias("v")).select(key, "keeper", "v.*")


def pick_decision(decisions: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """One decision per item, by CLASS_ORDER."""
    rank = F.array_position(F.array(*[F.lit(k) for k in CLASS_ORDER]), F.col(kind))
    return decisions.groupBy(key).agg(F.min_by(kind, F.when(rank > 0, rank).otherwise(len(CLASS_ORDER) + 1)).alias(kind))


def changed(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of `now` that are new or whose value differs, and which it is. Rows that are gone are not reported."""
    old = before.select(key, F.col(value).alias("__old"), F.lit(True).alias("__known"))
    joined = now.join(old, key, "left").where(~F.coalesce("__known", F.lit(False)) | ~F.col(value).eqNullSafe(F.col("__old")))
    return joined.withColumn("change", F.when(F.coalesce("__known", F.lit(False)), "CHANGED").otherwise("NEW")).drop("__old", "__known")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents, key, "left_anti")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")

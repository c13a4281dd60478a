"""Listing, paging, roll-ups, bundles and progress."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def active(*conditions: Column | None) -> Column:
    """AND of the filters that are in use; those that are None are not even in the plan."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def equals(name: str, value) -> Column | None:
    """column = value, or no filter where the value is None or empty."""
    return None if value is None or value == "" else F.col(name) == value


def search(text: str | None, *names: str) -> Column | None:
    """ILIKE '%text%' on any of the columns; % and _ in the text are wildcards."""
    if not text:
        return None
    out = F.col(names[0]).ilike(f"%{text}%")
    for n in names[1:]:
        out = out | F.col(n).ilike(f"%{text}%")
    return out


def not_true(c: Column) -> Column:
    """IS NOT TRUE: unknown counts as not."""
    return ~F.coalesce(c, F.lit(False))


def clamp_page(page: int | None, size: int | None) -> tuple[int, int]:
    return max(1, page or 1), min(100, max(20, size or 50))


def number_key(number: Column, none: int = 999_999) -> Column:
    """The digits of a number as a sort key."""
    return F.coalesce(F.regexp_replace(number, "[^0-9]", "").try_cast("int"), F.lit(none))


def top_one(rows: DataFrame, keys: list[str], order: Iterable[Column]) -> DataFrame:
    """One row of each key: the first in the order given, which should end with a unique column."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def list_problems(problems: DataFrame, *, page: int = 1, page_size: int = 50, query: str | None = None, review_status: str | None = None, source: str | None = None, page_from: int | None = None, page_to: int | None = None, trash: bool = False, listed_only: bool = True, show_fixtures: bool = False, sort: str = "book", ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of problems, and the total of the same filters.

    trash lists archived ones whatever their display state; else drafts and active ones, listed only by default. Naming a
    source lets its fixtures in. Either page bound drops problems without a page. ids: only these (a column of the same
    name as in problems), as a semi-join. Sorted by page and number, or by newest first.
    """
    page, page_size = clamp_page(page, page_size)
    live = F.col("lifecycle") == "ARCHIVED" if trash else F.col("lifecycle").isin("DRAFT", "ACTIVE")
    rows = problems.where(
        active(
            live,
            F.col("display_state") == "LISTED" if listed_only and not trash else None,
            None if show_fixtures or source else not_true(F.col("is_fixture")),
            equals("review_status", review_status),
            equals("source", source),
            F.col("page") >= page_from if page_from is not None else None,
            F.col("page") <= page_to if page_to is not None else None,
            search(query, "public_code", "text", "number"),
        )
    )
    if ids is not None:
        rows = rows.join(ids, ids.columns, "left_semi")
    book = [F.coalesce("page", F.lit(9999)), number_key(F.col("number")), F.col("public_code")]
    order = book if sort == "book" else [F.col("doc_id").desc(), F.col("public_code")]
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size), rows.agg(F.count("*").alias("total"))


def subtree(nodes: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """Ids of a node and what is below it, to a fixed depth: as many joins, no recursion."""
    level = nodes.where(F.col("id") == root).select("id")
    out = level
    for _ in range(depth):
        level = nodes.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
        out = out.unionByName(level)
    return out.distinct()


def ancestors(nodes: DataFrame, depth: int = 4) -> DataFrame:
    """(id, root) for every node and each of its ancestors, itself included, by joins on parents up to a depth."""
    parent = nodes.select(F.col("id").alias("root"), F.col("parent_id").alias("up"))
    now = nodes.select("id", F.col("id").alias("root"), F.col("parent_id").alias("next"))
    out = now.select("id", "root")
    for _ in range(depth - 1):
        now = now.where("next is not null").select("id", F.col("next").alias("root")).join(parent, "root").select("id", "root", F.col("up").alias("next"))
        out = out.unionByName(now.select("id", "root"))
    return out


def outline_rollup(nodes: DataFrame, assigned: DataFrame, depth: int = 4) -> DataFrame:
    """Distinct items per node over everything below it; 0 where there are none. assigned: node_id, item.

    Items are counted at the lowest level first, so the closure multiplies nodes and not assignments where items have one node.
    """
    closure = ancestors(nodes, depth)
    pairs = assigned.select(F.col("node_id").alias("id"), "item").distinct()
    counts = closure.join(pairs, "id").groupBy("root").agg(F.countDistinct("item").alias("items"))
    return nodes.join(counts, nodes["id"] == counts["root"], "left").select(nodes["id"], "level", "title", "sort_order", F.coalesce("items", F.lit(0)).cast("long").alias("items"))


def path_to_root(nodes: DataFrame, stop_level: str = "BOOK", depth: int = 4, glue: str = " > ") -> DataFrame:
    """(id, path): titles from below the top level down to the node; empty for a top node."""
    parent = nodes.select(F.col("id").alias("pid"), F.col("parent_id").alias("pup"), F.col("title").alias("ptitle"), F.col("level").alias("plevel"))
    now = nodes.select("id", F.when(F.col("level") == stop_level, F.array().cast("array<string>")).otherwise(F.array("title")).alias("titles"), F.when(F.col("level") != stop_level, F.col("parent_id")).alias("up"))
    for _ in range(depth - 1):
        step = now.join(parent, now["up"] == parent["pid"], "left")
        goes = F.col("pid").isNotNull() & (F.col("plevel") != stop_level)
        now = step.select("id", F.when(goes, F.concat(F.array("ptitle"), "titles")).otherwise(F.col("titles")).alias("titles"), F.when(goes, F.col("pup")).alias("up"))
    return now.select("id", F.concat_ws(glue, "titles").alias("path"))


def bundle(parents: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """Parents with each child table as a sorted array of structs; empty where there are none.

    children: name -> (table with the key, columns of the struct, leading columns that order it). Each is aggregated by itself
    before it is joined, so they never multiply each other.
    """
    out = parents
    for name, (rows, columns, order) in children.items():
        fields = [*order, *[c for c in columns if c not in order]]
        arrays = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(arrays, key, "left").withColumn(name, F.coalesce(name, F.array().cast(arrays.schema[name].dataType)))
    return out


STATUSES = ("AUTO_APPROVED", "AI_FIXED", "HUMAN_REVIEW", "BLOCKED", "FAILED")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by one aggregation: no sort and no window, so hot keys are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(*keys, "r.*")


def progress(states: DataFrame, run: str = "run_id", status: str = "status") -> DataFrame:
    """Counts of each status per run; unresolved are those that a human, a block, a failure or an unconfirmed fix leaves open."""
    counts = [F.count_if(F.col(status) == s).alias(s.lower()) for s in STATUSES]
    out = states.groupBy(run).agg(F.count("*").alias("total"), *counts)
    return out.withColumn("unresolved", F.col("human_review") + F.col("blocked") + F.col("failed") + F.col("ai_fixed"))


def source_stats(problems: DataFrame, key: str = "source") -> DataFrame:
    """Per source, in one pass: linked, listed and distinct counts, and the status they add up to."""
    open_ = F.col("lifecycle").isin("DRAFT", "ACTIVE")
    out = problems.groupBy(key).agg(
        F.countDistinct("doc_id").alias("linked"),
        F.countDistinct(F.when(open_ & (F.col("display_state") == "LISTED"), F.col("doc_id"))).alias("listed"),
        F.countDistinct("page").alias("pages"),
        F.count_if(F.col("review_status") == "AUTO_CLASSIFIED").alias("auto_classified"),
        F.count_if((F.col("review_status") == "NEEDS_REVIEW") & open_).alias("needs_review"),
        F.count_if(F.col("review_status") == "VERIFIED").alias("verified"),
    )
    return out.withColumn("ocr_pages", F.greatest(F.col("pages"), F.when(F.col("linked") > 0, F.col("pages")).otherwise(0))).withColumn("status", F.when((F.col("linked") > 0) & (F.col("needs_review") > 0), "REVIEW_REQUIRED").when(F.col("linked") > 0, "COMPLETED").otherwise("PENDING"))

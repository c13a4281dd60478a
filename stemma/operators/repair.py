"""Plans that move text between items: shared prompts to the items they belong to, and glued items to their own rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repair import later_range
from ..functions.text import bound, compose_stem, strip_leading_number, tags

#: Numbers that one prompt may be for, and how far a glued item's own row may be.
MOST_SPAN, MOST_APART = 20, 20
#: Where a number of four digits begins an item within a text.
ITEM_START = r"(?<![\w~\[])(?=[0-9]{4}(?![\w~\]]))"


def range_candidates(items: DataFrame, prompt: str) -> DataFrame:
    """Listed items (book, number, page, section, text, listed, protected) whose text runs on into a later range's prompt, with a verdict on moving it.

    (book, number, a, b, keep, shared, verdict, reasons). AUTO_SAFE: something is left of the item, the prompt looks like one (pattern `prompt`), is for
    at most MOST_SPAN numbers, each of which has one listed row on the same or an adjacent page of the same section, and the item is not protected.
    """
    cut = items.where("listed").withColumn("r", later_range(F.col("text"), F.col("number"))).where("r is not null").select("book", "number", "page", "section", "protected", "r.a", "r.b", "r.keep", "r.shared")
    wide = F.col("b") - F.col("a") > MOST_SPAN
    asked = cut.where(~wide).select("book", "number", F.col("page").alias("__p"), F.col("section").alias("__s"), F.explode(F.sequence("a", "b")).alias("__n"))
    there = items.where("listed").groupBy("book", F.col("number").alias("__n")).agg(F.count("*").alias("rows"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.min("section").alias("s1"), F.max("section").alias("s2"))
    near = (F.abs(F.col("lo") - F.col("__p")) <= 1) & (F.abs(F.col("hi") - F.col("__p")) <= 1)
    same = F.col("s1").eqNullSafe(F.col("__s")) & F.col("s2").eqNullSafe(F.col("__s"))
    known = lambda c: F.coalesce(c, F.lit(False))
    met = asked.join(there, ["book", "__n"], "left").groupBy("book", "number").agg(F.min(known(F.col("rows") == 1)).alias("__one"), F.min(known(near)).alias("__near"), F.min(known(same)).alias("__same"))
    own = strip_leading_number(F.col("keep"), F.lpad(F.col("number").cast("string"), 4, "0"))
    reasons = tags(
        WIDE=wide,
        NOTHING_LEFT=F.trim(own) == "",
        NO_PROMPT=~F.col("shared").rlike(prompt),
        TARGETS=~wide & ~known(F.col("__one")),
        PAGES=~wide & ~known(F.col("__near")),
        SECTION=~wide & ~known(F.col("__same")),
        PROTECTED=F.coalesce("protected", F.lit(True)),
    )
    judged = cut.join(met, ["book", "number"], "left").withColumn("reasons", reasons)
    return judged.select("book", "number", "a", "b", own.alias("keep"), "shared", F.when(F.size("reasons") == 0, "AUTO_SAFE").otherwise("REVIEW_REQUIRED").alias("verdict"), "reasons")


def range_restore(items: DataFrame, prompt: str) -> DataFrame:
    """What range_candidates() allow: (book, number, gave, took, text) for each listed item whose text changes.

    A donor keeps what stands before the mark; each number of the range takes the prompt in front, unless it has it already, prompts of several donors
    in the order of their numbers. Numbers are one listed row each in a book, and donors of one item stand on adjacent pages, so they are few.
    """
    safe = range_candidates(items, prompt).where("verdict = 'AUTO_SAFE'")
    gifts = safe.select("book", F.explode(F.sequence("a", "b")).alias("number"), F.struct(F.col("number").alias("donor"), "shared").alias("g"))
    taken = gifts.groupBy("book", "number").agg(F.sort_array(F.collect_list("g")).alias("gifts"))
    rows = items.where("listed").select("book", "number", "text").join(safe.select("book", "number", "keep"), ["book", "number"], "left").join(taken, ["book", "number"], "left")
    start = F.coalesce("keep", "text")
    new = F.aggregate(F.coalesce("gifts", F.array().cast("array<struct<donor:bigint,shared:string>>")), start, lambda t, g: compose_stem(g["shared"], t))
    return rows.select("book", "number", F.col("keep").isNotNull().alias("gave"), F.col("gifts").isNotNull().alias("took"), F.col("text").alias("__old"), new.alias("text")).where(~F.col("text").eqNullSafe(F.col("__old"))).drop("__old")


def glued_items(items: DataFrame) -> DataFrame:
    """(book, number, place, n, slice): texts cut where numbers of four digits begin; n is null for what stands before the first."""
    cut = items.select("book", "number", F.posexplode(F.filter(F.split("text", ITEM_START), lambda s: F.trim(s) != "")).alias("place", "slice"))
    return cut.withColumn("n", F.nullif(F.regexp_extract("slice", r"^(\d{4})(?!\d)", 1), F.lit("")).cast("long"))


def sibling_rebuilds(items: DataFrame) -> DataFrame:
    """(book, number, action, text, from_number): rows that hold other items' texts, and what their texts should be.

    items: one row a book and number, with text and protected. TRIM: an item loses the slices whose numbers have rows of their own (others stay).
    SIBLING: a row that such a slice belongs to, at most MOST_APART numbers away, which has no slice of its own and names the holder's number, takes
    the slice of the nearest holder, the smaller number first. Protected rows give and take nothing; texts that would not change or be empty are left.
    """
    pad = lambda c: F.lpad(c.cast("string"), 4, "0")
    free = ~F.coalesce("protected", F.lit(True))
    homes = items.select("book", F.col("number").alias("n"), F.lit(True).alias("home"))
    slices = glued_items(items).join(homes, ["book", "n"], "left")
    mine = F.coalesce(F.col("n") == F.col("number"), F.lit(False))
    met = slices.withColumn("mine", mine).withColumn("stays", mine | F.col("home").isNull())
    source = items.where(free).select("book", "number", "text")
    own = met.groupBy("book", "number").agg(F.sort_array(F.collect_list(F.when(F.col("stays"), F.struct("place", "slice")))).alias("kept"), F.min("stays").alias("whole"), F.max("mine").alias("has"))
    rows = source.join(own, ["book", "number"])
    left = F.trim(F.array_join(F.transform("kept", lambda s: F.trim(s["slice"])), "\n"))
    given = met.where(~F.col("stays") & (F.abs(F.col("n") - F.col("number")) <= MOST_APART)).join(source.select("book", "number"), ["book", "number"], "left_semi")
    given = given.select("book", F.col("number").alias("from_number"), F.col("n").alias("number"), "slice")
    asked = given.join(rows.where(~F.col("has")), ["book", "number"]).where(F.contains("text", pad(F.col("from_number"))))
    nearest = F.struct(F.abs(F.col("number") - F.col("from_number")), "from_number")
    taken = asked.groupBy("book", "number").agg(F.min_by(F.struct("from_number", F.trim("slice").alias("slice")), nearest).alias("g"))
    every = rows.where(~F.col("whole") | ~F.col("has")).join(taken, ["book", "number"], "left").where(~F.col("whole") | F.col("g").isNotNull())
    new = F.coalesce("g.slice", left)
    out = every.select("book", "number", F.when(F.col("g").isNotNull(), "SIBLING").otherwise("TRIM").alias("action"), new.alias("new"), F.coalesce("g.from_number", "number").alias("from_number"), "text")
    return out.where((F.col("new") != "") & (F.col("new") != F.trim("text"))).select("book", "number", "action", F.col("new").alias("text"), "from_number")


def _settle(holds: Column, rule: str, reasons: Column) -> Callable[[Column], Column]:
    return lambda s: F.when(holds & F.arrays_overlap(s["left"], reasons), F.struct(F.array_except(s["left"], reasons).alias("left"), F.array_append(s["applied"], F.lit(rule)).alias("applied"))).otherwise(s)


def cleaned(residual: Column, fixes: list[tuple[Column, str, tuple[str, ...]]], added: list[tuple[Column, str]]) -> Column:
    """struct(left, applied): reasons that are left of an item held back, after each fix (condition, rule, reasons it settles) and new reasons, and the rules applied.

    A fix whose reasons are not there is not applied; reasons are told once.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    state = F.struct(F.coalesce(residual, F.array().cast("array<string>")).alias("left"), F.array().cast("array<string>").alias("applied"))
    for condition, rule, settles in fixes:
        state = bound(state, _settle(yes(condition), rule, F.array(*map(F.lit, settles))))
    more = tags(**{name: yes(c) for c, name in added})
    return bound(state, lambda s: F.struct(F.array_union(s["left"], more).alias("left"), s["applied"].alias("applied")))


def cleanup_verdict(state: Column) -> Column:
    """struct(verdict, review_status) of what cleaned() gives: AUTO_CLEAR iff nothing is left."""
    clear = F.size(state["left"]) == 0
    return F.struct(F.when(clear, "AUTO_CLEAR").otherwise("HUMAN_REVIEW").alias("verdict"), F.when(clear, "AUTO_CLASSIFIED").otherwise("NEEDS_REVIEW").alias("review_status"))

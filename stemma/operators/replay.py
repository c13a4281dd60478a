"""Headings replayed in reading order up to each item: state machines of sections as folds that compose, so that a section of any size is cut into parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running

#: Where the second column begins, and how far below an item's top its heading may stand.
SECOND_COLUMN, BELOW = 0.48, 0.06


def heading_state(items: DataFrame, headings: DataFrame, parts: int | None = None) -> DataFrame:
    """Items (section, page, x, top) with the state that headings leave at them: c_stage, blocked, inherited (struct of code, node, type, how).

    headings: section, page, x, y, kind, code, node, type, how, ambiguous. They are read by page, column, height. A c_stage heading ends
    a section's types: none is inherited, and no later heading of the section counts. Any other heading with a code, node or type
    replaces what was inherited; an ambiguous one blocks it instead. One that is not resolved (all three null) changes nothing.
    So the state is two folds, any(c_stage) and the last resolved heading, which compose over parts. Items without a section have none.
    """
    names = items.columns
    column = lambda x: (F.col(x) >= SECOND_COLUMN).cast("int")
    known = F.coalesce(F.col("code").cast("string"), F.col("node").cast("string"), F.col("type").cast("string")).isNotNull() | F.coalesce(F.col("ambiguous"), F.lit(False))
    hit = F.struct("code", "node", "type", "how", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
    stage = F.col("kind") == "c_stage"
    marks = headings.where("section IS NOT NULL").select("section", "page", column("x").alias("__col"), F.col("y").alias("__y"), F.col("x").alias("__x"), F.lit(0).alias("__k"), F.coalesce(stage, F.lit(False)).alias("__c"), F.when(known & ~F.coalesce(stage, F.lit(False)), hit).alias("__h"))
    rows = items.select("*", column("x").alias("__col"), (F.col("top") + BELOW).alias("__y"), F.lit(1).alias("__k"))
    both = rows.unionByName(marks.withColumn("__x", F.col("__x")), allowMissingColumns=True)
    order = ["page", "__col", "__y", "__k", "__x"]
    found = running(both, ["section"], order, {"c_stage": ("any", F.col("__c")), "__last": ("last", F.col("__h"))}, parts=parts).where("__k = 1")
    c = F.col("section").isNotNull() & F.coalesce("c_stage", F.lit(False))
    last = F.when(F.col("section").isNotNull() & ~c, F.col("__last"))
    return found.select(*names, c.alias("c_stage"), (c | F.coalesce(last["ambiguous"], F.lit(False))).alias("blocked"), F.when(~last["ambiguous"], F.struct(*[last[k].alias(k) for k in ("code", "node", "type", "how")])).alias("inherited"))


def replayed_types(items: DataFrame, headings: DataFrame, types: DataFrame, parts: int | None = None) -> DataFrame:
    """Each item's type with how it was found and what speaks against it: section, code, node, type, how, reasons, c_stage, blocked.

    items: item, number (order of items), section, page, x, top, stem_codes, page_codes (arrays: the marks of types in the item's stem and on its page).
    types: section, code, node, type. In order: the one mark of the stem, unless a heading says otherwise; the one mark of the page; the
    inherited heading; and, if headings block nothing, the type that the last item of the section before it was given for
    one of these reasons. After a c_stage heading only the stem counts. Marks that the section does not have are passed over. Reasons: NO_SECTION,
    TYPE_MARKER_AMBIGUOUS (several marks in the stem), TYPE_MARKER_MISSING (no type). Repeated items are items; ties of number are broken by page, top and item.
    """
    # what a section allows, one row a section: types are a dictionary
    allowed = types.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("code", F.struct("node", "type").alias("v"))))).alias("__types"))
    state = heading_state(items, headings, parts)
    rows = state.join(allowed, "section", "left").withColumn("__types", F.coalesce("__types", F.expr("CAST(map() AS " + allowed.schema["__types"].dataType.simpleString() + ")")))
    fits = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast(items.schema[c].dataType)), lambda v: F.map_contains_key("__types", v)))
    rows = rows.withColumns({"__stem": fits("stem_codes"), "__page": fits("page_codes")})
    of = lambda code, how: F.struct(code.alias("code"), F.col("__types")[code]["node"].alias("node"), F.col("__types")[code]["type"].alias("type"), F.lit(how).alias("how"))
    stem, sheet = F.get("__stem", F.lit(0)), F.get("__page", F.lit(0))
    by_stem = (F.size("__stem") == 1) & (F.col("c_stage") | F.col("inherited").isNull() | F.col("inherited.code").eqNullSafe(stem))
    heading = F.struct("inherited.code", "inherited.node", "inherited.type", F.when(F.col("inherited.how").startswith("concept"), "inherit_concept_heading").otherwise("inherit_previous_in_section").alias("how"))
    own = F.when(F.col("section").isNull(), None).when(by_stem, of(stem, "stem_type_marker")).when(F.col("c_stage"), None).when(F.size("__page") == 1, of(sheet, "page_ocr_unique_type")).when(F.col("inherited").isNotNull(), heading)
    # what is dealt anew is what is still asked for: neither the section's types nor the marks
    rows = rows.select("item", "number", "section", "page", "top", "c_stage", "blocked", own.alias("__own"), (F.size("__stem") > 1).alias("__several"))
    several = F.col("__several")
    gives = F.col("__own.node").isNotNull() & F.col("__own.type").isNotNull() & ~F.col("c_stage") & ~several
    carried = running(rows, ["section"], ["number", "page", "top", "item"], {"__carried": ("last", F.when(gives, F.col("__own")))}, strict=True, parts=parts)
    last = F.when(F.col("section").isNotNull() & ~F.col("c_stage") & ~F.col("blocked") & F.col("__carried").isNotNull(), F.struct("__carried.code", "__carried.node", "__carried.type", F.lit("inherit_previous_in_section").alias("how")))
    found = carried.withColumn("__f", F.coalesce("__own", last))
    typed = F.col("__f.node").isNotNull() | F.col("__f.type").isNotNull()
    reasons = F.array_compact(F.array(F.when(F.col("section").isNull(), "NO_SECTION").when(several, "TYPE_MARKER_AMBIGUOUS").when(~F.coalesce(typed, F.lit(False)), "TYPE_MARKER_MISSING")))
    return found.select("item", "section", "__f.code", "__f.node", "__f.type", "__f.how", reasons.alias("reasons"), "c_stage", "blocked")


#: The first page that a text's heading of a stage counts on, and what is taken from a heading's certainty on later pages, down to the least.
FIRST_STAGE_PAGE, CARRIED_LESS, LEAST_CARRIED = 8, 0.08, 0.55


def stage_hits(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """(book, page, code, label, confidence, evidence) of the pages that begin a stage, one a page: what was seen (book, page, code, label, confidence; the surest) goes before a text's heading.

    pages: book, page, code, label, confidence of the stage that a page's text names (null if none); those before FIRST_STAGE_PAGE do not count.
    """
    hit = lambda rows, rank, kind: rows.where("code IS NOT NULL").select("book", "page", F.struct(F.lit(rank).alias("rank"), (-F.col("confidence")).alias("less"), "code", "label", "confidence", F.lit(kind).alias("evidence")).alias("h"))
    every = hit(seen, 0, "VISUAL_HEADING").unionByName(hit(pages.where(F.col("page") >= FIRST_STAGE_PAGE), 1, "TEXT_HEADING"))
    return every.groupBy("book", "page").agg(F.min("h").alias("h")).select("book", "page", "h.code", "h.label", "h.confidence", "h.evidence")


def stage_map(pages: DataFrame, seen: DataFrame, parts: int | None = None) -> DataFrame:
    """Every page (book, page) with the stage that it lies in: code, label, confidence, evidence.

    A stage goes on to the next one's page; pages before a book's first stage count to it. A page that begins a stage has its evidence and certainty, later ones are LAYOUT_BOUNDARY with a
    little less. Pages that are filler (a column of `pages`), and books without stages, are UNKNOWN with 0. Books of any size: see scan.running().
    """
    hits = stage_hits(pages, seen)
    stage = F.struct(F.col("page").alias("at"), "code", "label", "confidence", "evidence")
    firsts = hits.groupBy(F.col("book").alias("__book")).agg(F.min(stage).alias("__first"))
    rows = pages.select("book", "page", F.coalesce("filler", F.lit(False)).alias("filler"), F.lit(1).alias("__k"))
    both = rows.unionByName(hits.select("book", "page", F.lit(0).alias("__k"), stage.alias("__h")), allowMissingColumns=True)
    found = running(both, ["book"], ["page", "__k"], {"__last": ("last", F.col("__h"))}, parts=parts).where("__k = 1")
    found = found.join(firsts, F.col("book").eqNullSafe(F.col("__book")), "left").withColumn("__s", F.when(~F.col("filler"), F.coalesce("__last", "__first")))
    here = F.col("__s.at") == F.col("page")
    confidence = F.when(F.col("__s").isNull(), 0.0).when(here, F.col("__s.confidence")).otherwise(F.greatest(F.lit(LEAST_CARRIED), F.col("__s.confidence") - CARRIED_LESS))
    evidence = F.when(F.col("__s").isNull(), "UNKNOWN").when(here, F.col("__s.evidence")).otherwise("LAYOUT_BOUNDARY")
    return found.select("book", "page", F.coalesce("__s.code", F.lit("UNKNOWN")).alias("code"), F.col("__s.label").alias("label"), confidence.alias("confidence"), evidence.alias("evidence"))


def stage_ranges(hits: DataFrame, last: DataFrame, parts: int | None = None) -> DataFrame:
    """(book, page_start, page_end, code, label, confidence) of stage_hits(): down to the page before the next one, or the book's last page (book, last_page)."""
    after = running(hits, ["book"], [F.col("page").desc()], {"__next": ("last", F.col("page"))}, strict=True, parts=parts)
    ends = last.select(F.col("book").alias("__book"), "last_page")
    return after.join(ends, F.col("book").eqNullSafe(F.col("__book")), "left").select("book", F.col("page").alias("page_start"), F.coalesce(F.col("__next") - 1, "last_page").alias("page_end"), "code", "label", "confidence")

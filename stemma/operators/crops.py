"""Whether a problem's crop can be used: what speaks against it is worked out from its box, its neighbours' boxes and its text, and how a crop that runs into the next problem is cut back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.recognition import strip
from ..functions.text import bound
from ..sources.shared import kept
from .spatial import box_pairs, nearest_below

#: The least size of a crop in pixels, ink that is none, coverage that figures and blocks need, overlap that neighbours may have, and widths and margins.
MIN_WIDTH, MIN_HEIGHT, NO_INK, FIGURE_COVERAGE, BLOCK_COVERAGE, NEIGHBOUR_IOU, COLUMN_WIDTH, PAD, HEADER_HEIGHT = 64, 48, 0.008, 0.7, 0.45, 0.12, 0.62, 0.022, 0.03
#: From where an edge cuts through ink and from where it may, and how far above the next problem a crop is cut and what must be left.
EDGES = {"top": (0.5, 0.32), "bottom": (0.5, 0.32), "left": (0.55, 0.38), "right": (0.5, 0.32)}
ABOVE_NEXT, LEAST_HEIGHT = 0.006, 0.035
#: Mathematics in a text, and what stands behind a number that begins a problem's line.
MATH = r"\$\$[\s\S]*?\$\$|\$[^$]*\$|\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)|\\begin\{[^}]+\}[\s\S]*?\\end\{[^}]+\}"
FIRST_NUMBER = r"^(?:#{1,3}\s*)?(\d{4})(?:\s*(?:[|•.]|대표)|\s|\z)"
RANGE = r"\[(\d{4})\s*[~\-–]\s*(\d{4})\]"
#: Crops and parts of a page whose crops see each other as an array.
FULL_PAGE = 64
#: Soft findings that ask for a review.
REVIEWED = ("top_edge_ambiguous", "bottom_edge_ambiguous", "left_edge_ambiguous", "right_edge_ambiguous", "image_features_missing", "column_last_bottom_uncertain", "neighbor_header_last_line", "neighbor_header_in_pad")


def bare(text: Column) -> Column:
    """A text with its mathematics left out; only texts that hold a sign of it are searched."""
    return F.when(text.contains("$") | text.contains("\\"), F.regexp_replace(text, MATH, " ")).otherwise(text)


def neighbour_numbers(said: Column, own: Column, numbers: Column) -> Column:
    """struct(found, last_only): other numbers of the page (four digits each) that begin a line of a text without mathematics, and whether all do so on its last line.

    A line begins with one number of four digits at most, so each line is read once, however many numbers the page has.
    """
    known = F.filter(F.array_distinct(numbers), lambda n: (n != own) & n.rlike(r"^\d{4}\z"))
    lines = F.filter(F.transform(F.split(said, "\n"), strip), lambda s: s != "")

    def look(s: Column) -> Column:
        heads = F.filter(F.transform(s["lines"], lambda v, i: F.struct(F.regexp_extract(v, FIRST_NUMBER, 1).alias("n"), i.alias("at"))), lambda h: F.array_contains(s["known"], h["n"]))
        return bound(F.struct(heads.alias("heads"), s["known"].alias("known"), (F.size(s["lines"]) - 1).alias("last")), lambda h: F.struct(F.filter(h["known"], lambda n: F.exists(h["heads"], lambda x: x["n"] == n)).alias("found"), ((F.size(h["heads"]) > 0) & F.forall(h["heads"], lambda x: x["at"] >= h["last"])).alias("last_only")))

    return bound(F.struct(known.alias("known"), lines.alias("lines")), look)


def intrusion(stem: Column, following: Column) -> Column:
    """NONE, HEADER_ONLY if the next problem's number stands in a stem, BODY_INTRUSION if 24 characters or more of its line follow."""
    body = F.regexp_like(stem, F.concat(F.regexp_replace(following, r"([^0-9A-Za-z가-힣])", r"\\$1"), F.lit(r"\s+[^\n]{24,}")))
    return F.when(following.isNull() | ~stem.contains(following), "NONE").when(body, "BODY_INTRUSION").otherwise("HEADER_ONLY")


def own_number_said(said: Column, own: Column) -> Column:
    """Whether a text without mathematics holds the item's own number of four digits."""
    return F.coalesce(own.rlike(r"^\d{4}\z") & said.contains(own), F.lit(False))


def placed_crops(crops: DataFrame) -> DataFrame:
    """Crops (page, item, number, x, y, w, h) with what their page says: numbers, iou (the most with another crop), and number and box of the next crop in the column.

    Overlaps and neighbours are met in tiles of the page's grid; numbers are gathered page by page, once each.
    """
    most = box_pairs(crops, least=0.0)
    most = most.select("page", F.col("a").alias("item"), "iou").unionByName(most.select("page", F.col("b").alias("item"), "iou")).groupBy("page", "item").agg(F.max("iou").alias("iou"))
    after = nearest_below(crops).where("next IS NOT NULL").join(crops.select("page", F.col("item").alias("next"), F.col("number").alias("next_number"), *[F.col(c).alias(f"next_{c}") for c in "xywh"]), ["page", "next"]).drop("next")
    numbers = crops.where("number IS NOT NULL").groupBy("page").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    out = crops.join(most, ["page", "item"], "left").join(after, ["page", "item"], "left").join(numbers, "page", "left")
    return out.withColumns({"iou": F.coalesce("iou", F.lit(0.0)), "numbers": F.coalesce("numbers", F.array().cast("array<string>"))})


def badly_covered(crops: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(page, item) of crops of which less than `least` of some part (page, item, x, y, w, h) lies within; parts belong to their item, so none meets another crop."""
    box = parts.select("page", "item", *[F.col(c).alias(f"p{c}") for c in "xywh"])
    return crops.join(box, ["page", "item"]).where(Box.of().coverage(Box.of("p")) < least).select("page", "item").distinct()


def _placed_full(crops: DataFrame, blocks: DataFrame | None, images: DataFrame | None) -> DataFrame:
    """Crops of full pages with what page and parts say, met in tiles: see placed_crops(); with __cut_block, __cut_image and __pictured."""
    rows = placed_crops(crops)
    none = rows.select("page", "item").limit(0)
    cut_blocks = none if blocks is None else badly_covered(crops, blocks, BLOCK_COVERAGE)
    cut_images = none if images is None else badly_covered(crops, images, FIGURE_COVERAGE)
    pictured = none if images is None else images.select("page", "item").distinct()
    for flag, some in (("__cut_block", cut_blocks), ("__cut_image", cut_images), ("__pictured", pictured)):
        rows = rows.join(some.withColumn(flag, F.lit(True)), ["page", "item"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return rows


def _placed(crops: DataFrame, blocks: DataFrame | None, images: DataFrame | None) -> DataFrame:
    """The same for pages of few rows, which all crops of the page see as arrays: crops are dealt by page, once, and not at all if they already are."""
    seen = F.struct("item", "number", *"xywh")
    rows = crops.withColumn("__all", F.when(F.col("page").isNotNull(), F.collect_list(seen).over(W.partitionBy("page"))))
    for name, parts in (("__blocks", blocks), ("__images", images)):
        if parts is None:
            rows = rows.withColumn(name, F.lit(None).cast("array<struct<item:bigint,x:double,y:double,w:double,h:double>>"))
        else:
            rows = rows.join(parts.groupBy("page").agg(F.collect_list(F.struct("item", *"xywh")).alias(name)), "page", "left")
    own, of = Box.of(), lambda o: Box(*(o[c] for c in "xywh"))
    meets = lambda o: (o["item"] != F.col("item")) & (own.x <= o["x"] + o["w"]) & (o["x"] <= own.x + own.w) & (own.y <= o["y"] + o["h"]) & (o["y"] <= own.y + own.h)
    iou = F.array_max(F.transform(F.filter("__all", meets), lambda o: own.iou(of(o))))
    below = F.filter("__all", lambda o: (F.abs(own.x - o["x"]) < 0.08) & (o["y"] > own.y + 0.01) & F.col("item").isNotNull())
    after = F.array_min(F.transform(below, lambda o: F.struct(o["y"], o["item"], o["number"], o["x"], o["w"], o["h"])))
    numbers = F.array_sort(F.array_distinct(F.filter(F.transform("__all", lambda o: o["number"]), lambda n: n.isNotNull())))
    cut = lambda parts, least: F.coalesce(F.exists(parts, lambda p: (p["item"] == F.col("item")) & (own.coverage(of(p)) < least)), F.lit(False))
    rows = rows.withColumn("__next", bound(after, lambda o: F.when(o["item"].isNotNull(), o)))
    rows = rows.select(
        *crops.columns, F.coalesce(iou, F.lit(0.0)).alias("iou"), F.col("__next.number").alias("next_number"), *[F.col(f"__next.{c}").alias(f"next_{c}") for c in "xywh"], F.coalesce(numbers, F.array().cast("array<string>")).alias("numbers"),
        cut("__blocks", BLOCK_COVERAGE).alias("__cut_block"), cut("__images", FIGURE_COVERAGE).alias("__cut_image"), F.coalesce(F.exists("__images", lambda p: p["item"] == F.col("item")), F.lit(False)).alias("__pictured"),
    )
    return rows


def _met(crops: DataFrame, blocks: DataFrame | None, images: DataFrame | None, full: int) -> DataFrame:
    """Crops with what their page and their parts say; pages of more than `full` crops and parts are told apart by counts, which come first."""
    counts = [t.groupBy("page").agg(F.count("*").alias("n")) for t in (crops, blocks, images) if t is not None]
    crowded = kept(reduce(DataFrame.unionByName, counts).groupBy("page").agg(F.sum("n").alias("n")).where(f"page IS NOT NULL AND n > {full}").select("page"), "full-pages")
    if crowded.isEmpty():
        return _placed(crops, blocks, images)
    few, many = ([t if t is None else t.join(crowded, "page", how) for t in (crops, blocks, images)] for how in ("left_anti", "left_semi"))
    out = _placed(*few)
    return out.unionByName(_placed_full(*many).select(*out.columns))


def gated_crops(crops: DataFrame, blocks: DataFrame | None = None, images: DataFrame | None = None, full: int = FULL_PAGE) -> DataFrame:
    """Crops with decision (CROP_SAFE, CROP_REVIEW, CROP_UNSAFE), hard and soft (what speaks against them), neighbours, adjacent and the recovery box's height.

    crops: page, item (distinct together), number, canonical, x, y, w, h, stem, markdown, anchored, unstable, uncertain, columns, last, figure_hint, and image, a struct (null without an image) of
    width, height, ink, components, left_top_ink, top, bottom, left, right (how much of an edge lies in ink), blob_edge, blob_share. blocks and images: page, item, box, and
    blocks' content: what is known to belong to an item. Hard findings make a crop unsafe, those of REVIEWED ask for a review. Null texts are empty, null flags false.
    Crops of a page with up to `full` crops and parts see each other as an array, so texts are dealt by page once; fuller pages meet in tiles of a grid.
    recovery_h: the box's height cut to just above the next crop of the column; null if too little is left or the box is not valid.
    """
    names = [c for c in crops.columns]
    rows = _met(crops, None if blocks is None else blocks.where(F.length(F.trim(F.coalesce("content", F.lit("")))) >= 4), images, full)
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    own = F.coalesce("canonical", "number")
    rows = rows.withColumn("__text", F.concat(F.coalesce("stem", F.lit("")), F.lit("\n"), F.coalesce("markdown", F.lit("")))).withColumn("__own", own).withColumn("__bare", bare(c("__text")))
    rows = rows.withColumns({"__near": neighbour_numbers(c("__bare"), c("__own"), c("numbers")), "adjacent": intrusion(F.coalesce("stem", F.lit("")), c("next_number")), "__said": own_number_said(c("__bare"), c("__own"))})
    image = c("image")
    pictured = image.isNotNull()
    ranges = F.flatten(F.array(*[F.regexp_extract_all("__text", F.lit(RANGE), F.lit(k)) for k in (1, 2)]))
    left, top = F.greatest(F.lit(0.0), c("x") - PAD), F.greatest(F.lit(0.0), c("y") - PAD)
    padded = Box(left, top, F.least(1 - left, c("w") + 2 * PAD), F.least(1 - top, c("h") + 2 * PAD))
    header = Box(c("next_x"), c("next_y"), c("next_w"), F.least(F.lit(HEADER_HEIGHT), c("next_h")))
    found, last_only = F.size("__near.found") > 0, c("__near.last_only")
    anchored = yes(c("anchored")) & c("canonical").isNotNull()
    ink = image["ink"]
    small = (image["width"] < MIN_WIDTH) | (image["height"] < MIN_HEIGHT)
    empty = (ink < NO_INK) | ((image["components"] == 0) & (ink.isNull() | (ink < 0.012)))
    hard = [
        (~Box.of().valid(1e-6), "INVALID_BBOX"), (small, "EMPTY_CROP"), (empty, "NO_CONTENT"), (yes(c("unstable")) | c("canonical").isNull(), "IDENTITY_UNSTABLE"), (c("uncertain"), "NUMBER_UNCERTAIN"),
        (~c("__said") & ~anchored & ~yes(image["left_top_ink"]), "SELF_NUMBER_MISSING"), (c("adjacent") == "BODY_INTRUSION", "BODY_INTRUSION"),
        (F.exists(ranges, lambda n: n != c("__own")) | (found & ~last_only) | (c("iou") >= NEIGHBOUR_IOU), "NEIGHBOR_NUMBER_INTRUSION"), ((c("columns") >= 2) & (c("w") > COLUMN_WIDTH), "COLUMN_INTRUSION"), (c("__cut_block"), "KNOWN_BLOCK_OUTSIDE_CROP"),
        (c("__cut_image") | (yes(image["blob_edge"]) & (image["blob_share"] >= 0.08)), "FIGURE_BOUNDARY_RISK"), *[(image[e] >= cut, f"{e.upper()}_CUT_RISK") for e, (cut, _) in EDGES.items()],
    ]
    soft = [
        (~c("__said") & anchored, "self_number_from_segment_anchor"), (found & last_only, "neighbor_header_last_line"), (padded.coverage(header) >= 0.4, "neighbor_header_in_pad"), *[((image[e] >= maybe) & (image[e] < cut), f"{e}_edge_ambiguous") for e, (cut, maybe) in EDGES.items()],
        (pictured & yes(c("figure_hint")) & ~yes(image["blob_edge"]) & ~c("__pictured"), "visual_figure_unconfirmed"), (~pictured, "image_features_missing"), (yes(c("last")) & (image["bottom"] >= 0.22) & (image["bottom"] < 0.5), "column_last_bottom_uncertain"),
    ]
    told = lambda pairs: F.array_compact(F.array(*[F.when(yes(t), n) for t, n in pairs]))
    height = F.when(c("next_y") < c("y") + c("h") - 0.002, c("next_y") - ABOVE_NEXT - c("y")).otherwise(c("h"))
    recovered = Box(c("x"), c("y"), c("w"), height)
    kept = recovered.valid(1e-6) & ((height >= LEAST_HEIGHT) | (height == c("h")))
    rows = rows.withColumns({"hard": told(hard), "soft": told(soft), "recovery_h": F.when(kept, height), "neighbours": c("__near.found")})
    decision = F.when(F.size("hard") > 0, "CROP_UNSAFE").when(F.arrays_overlap("soft", F.array(*map(F.lit, REVIEWED))), "CROP_REVIEW").otherwise("CROP_SAFE")
    return rows.select(*names, "iou", "next_number", "neighbours", "adjacent", decision.alias("decision"), "hard", "soft", "recovery_h")

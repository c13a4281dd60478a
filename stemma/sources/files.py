"""JSON artifacts, layouts and files as tables, and sinks for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import char_count

BOX = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")), T.StructField("unit", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("pageWidth", T.DoubleType()), T.StructField("pageHeight", T.DoubleType())])


def read_items(spark: SparkSession, path: str, item: T.StructType, key: str = "items") -> DataFrame:
    """The elements of {"items": [...]} artifacts, one row each; a file without the array has none."""
    schema = T.StructType([T.StructField(key, T.ArrayType(item))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(key).alias("i")).select("i.*")


def read_manifest(spark: SparkSession, path: str, item: T.StructType, required: list[str], expected: int | None = None, key: str = "items") -> DataFrame:
    """read_items() that fails on rows without a required field, or on another count than expected."""
    rows = read_items(spark, path, item, key)
    missing = F.greatest(*[F.col(c).isNull() for c in required], F.lit(False))
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} items, not {expected}")
    return rows.where(F.when(missing, F.raise_error(F.lit("an item lacks a required field")).cast("boolean")).otherwise(True))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_report(summary: DataFrame, title: str, most_rows: int = 1000) -> str:
    """A small summary as a Markdown table; more than most_rows rows are an error, since it is made on the driver."""
    rows = summary.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("too many rows for a report")
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"


def layout_blocks(pages: DataFrame, json_col: str = "layout", keep: tuple[str, ...] = ("page",)) -> DataFrame:
    """Blocks of canonical layout JSON ({pageWidth, pageHeight, blocks: [{type, content, bbox, confidence}]}), boxes normalised to the page."""
    block = T.StructType([T.StructField("type", T.StringType()), T.StructField("content", T.StringType()), T.StructField("bbox", BOX), T.StructField("confidence", T.DoubleType())])
    schema = T.StructType([T.StructField("pageWidth", T.DoubleType()), T.StructField("pageHeight", T.DoubleType()), T.StructField("blocks", T.ArrayType(block))])
    parsed = pages.select(*keep, F.from_json(json_col, schema).alias("l")).select(*keep, "l.pageWidth", "l.pageHeight", F.posexplode_outer("l.blocks").alias("pos", "b")).where("b is not null")
    scale = lambda c, side: F.when(F.col("b.bbox.unit") == "normalized", F.col(f"b.bbox.{c}")).otherwise(F.col(f"b.bbox.{c}") / F.nullif(F.col(side), F.lit(0.0)))
    return parsed.select(*keep, "pos", F.col("b.type").alias("type"), F.col("b.content").alias("content"), F.col("b.confidence").alias("confidence"), scale("x", "pageWidth").alias("x"), scale("y", "pageHeight").alias("y"), scale("width", "pageWidth").alias("width"), scale("height", "pageHeight").alias("height"))


def provider_layout(pages: DataFrame, json_col: str = "raw", keep: tuple[str, ...] = ("page",)) -> DataFrame:
    """Blocks and images of a provider's page JSON ({dimensions, blocks, images}, boxes as pixel corners): (keep, kind, pos, type, content, confidence, x, y, width, height).

    Boxes are normalised and stay within the page; texts are never rewritten. Images are those listed and blocks that are images, the first of each id (from 0
    in order); unnamed ones are told apart by place. Without page sizes, or without a box, there is no row.
    """
    d = T.DoubleType()
    size = T.StructType([T.StructField(c, d) for c in ("width", "height")])
    box = T.StructType([*(T.StructField(c, T.StringType()) for c in ("id", "type", "content")), T.StructField("confidence", d), *(T.StructField(c, d) for c in ("top_left_x", "top_left_y", "bottom_right_x", "bottom_right_y"))])
    schema = T.StructType([T.StructField("dimensions", size), T.StructField("blocks", T.ArrayType(box)), T.StructField("images", T.ArrayType(box))])
    page = pages.select(*keep, F.from_json(json_col, schema).alias("p")).where("p.dimensions.width > 0 and p.dimensions.height > 0")
    none = F.array().cast(T.ArrayType(box))
    blocks, listed = (F.coalesce(F.col(f"p.{c}"), none) for c in ("blocks", "images"))
    boxed = lambda b: F.coalesce(b["top_left_x"], b["top_left_y"], b["bottom_right_x"], b["bottom_right_y"]).isNotNull()
    picture = lambda b: F.coalesce((b["type"] == "image") | b["id"].rlike("(?i)img|image"), F.lit(False))
    images = F.filter(F.concat(listed, F.filter(blocks, picture)), boxed)
    new = lambda a, b: F.when(b["id"].isNotNull() & F.exists(a, lambda o: o["id"] == b["id"]), a).otherwise(F.array_append(a, b))
    once = F.aggregate(images, none, new)
    rows = page.select(*keep, "p.dimensions", F.explode(F.array(F.struct(F.lit("block").alias("kind"), F.filter(blocks, boxed).alias("boxes")), F.struct(F.lit("image").alias("kind"), once.alias("boxes")))).alias("k"))
    rows = rows.select(*keep, "dimensions", "k.kind", F.posexplode("k.boxes").alias("pos", "b"))
    at = lambda c, side: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(f"b.{c}"), F.lit(0.0)) / F.col(f"dimensions.{side}")))
    left, top, right, bottom = at("top_left_x", "width"), at("top_left_y", "height"), at("bottom_right_x", "width"), at("bottom_right_y", "height")
    return rows.select(*keep, "kind", F.col("pos").cast("long").alias("pos"), "b.type", "b.content", "b.confidence", F.least(left, right).alias("x"), F.least(top, bottom).alias("y"), F.abs(right - left).alias("width"), F.abs(bottom - top).alias("height"))


def markdown_layout(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """A stand-in layout for plain text: its n non-empty lines spread evenly down the page."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), F.trim), lambda s: s != "")
    rows = docs.select(F.col(key), F.size(lines).alias("n"), F.posexplode(lines).alias("line", "content"))
    return rows.select(key, F.col("line").cast("long").alias("line"), "content", F.round(0.04 + F.col("line") / F.col("n") * 0.9, 6).alias("y"), F.round(F.greatest(F.lit(0.012), 0.9 / F.col("n")), 6).alias("height"))


def binary_guard(files: DataFrame, extensions: tuple[str, ...] = ("pdf",), magic: bytes = b"%PDF-", most_bytes: int = 100 << 20) -> DataFrame:
    """Verdicts on files read as binaryFile: extension, leading bytes and size; with their SHA-256."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reasons: list[Column] = [
        F.when(~ext.isin(*extensions), F.lit("EXTENSION")),
        F.when(F.col("length") == 0, F.lit("EMPTY")),
        F.when(F.col("length") > most_bytes, F.lit("TOO_LARGE")),
        F.when(F.substring("content", 1, len(magic)) != F.lit(magic), F.lit("MAGIC")),
    ]
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.array_compact(F.array(*reasons)).alias("reasons")).withColumn("ok", F.size("reasons") == 0)


def text_kind(pages: DataFrame, doc_col: str, text_col: str, meaningful: int = 40) -> DataFrame:
    """TEXT, SCAN or MIXED per document, by how many of its pages hold enough visible text."""
    enough = char_count(F.col(text_col)) >= meaningful
    counted = pages.groupBy(doc_col).agg(F.count("*").alias("pages"), F.count_if(F.coalesce(enough, F.lit(False))).alias("text_pages"))
    return counted.withColumn("kind", F.when(F.col("text_pages") == F.col("pages"), "TEXT").when(F.col("text_pages") == 0, "SCAN").otherwise("MIXED"))

"""The question-bank domain over general tables: who plays which part.

Each view is a plain projection, so filters and column pruning reach the scans below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import table


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as problems: code, page, number, states."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    joined = d.join(labels, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.concat(F.lit("QB-"), F.lpad(k.cast("string"), 6, "0")).alias("public_code"),
        "text",
        "lang",
        "source",
        "n_chars",
        "quality",
        "toxic",
        F.when(k % 11 != 0, k % 200).alias("page"),
        F.concat((k % 300).cast("string"), F.when(k % 5 == 0, ".").otherwise("")).alias("number"),
        F.when(F.col("quality") == 0, "NEEDS_REVIEW").when(F.col("quality") == 1, "VERIFIED").otherwise("AUTO_CLASSIFIED").alias("review_status"),
        F.when(F.col("toxic") == 1, "ARCHIVED").when(k % 3 == 0, "DRAFT").otherwise("ACTIVE").alias("lifecycle"),
        F.when(k % 17 == 0, "HIDDEN_DUPLICATE").otherwise("LISTED").alias("display_state"),
        F.when(k % 13 == 0, True).when(k % 13 < 7, False).alias("is_fixture"),
    )


PROBLEMS_SQL = """problems AS (
  SELECT d.doc_id, 'QB-' || lpad(CAST(d.doc_id AS VARCHAR), 6, '0') AS public_code, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
    CASE WHEN d.doc_id % 11 <> 0 THEN d.doc_id % 200 END AS page,
    CAST(d.doc_id % 300 AS VARCHAR) || CASE WHEN d.doc_id % 5 = 0 THEN '.' ELSE '' END AS number,
    CASE WHEN l.quality = 0 THEN 'NEEDS_REVIEW' WHEN l.quality = 1 THEN 'VERIFIED' ELSE 'AUTO_CLASSIFIED' END AS review_status,
    CASE WHEN l.toxic = 1 THEN 'ARCHIVED' WHEN d.doc_id % 3 = 0 THEN 'DRAFT' ELSE 'ACTIVE' END AS lifecycle,
    CASE WHEN d.doc_id % 17 = 0 THEN 'HIDDEN_DUPLICATE' ELSE 'LISTED' END AS display_state,
    CASE WHEN d.doc_id % 13 = 0 THEN TRUE WHEN d.doc_id % 13 < 7 THEN FALSE END AS is_fixture
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region > nation > customer as an adjacency list: id, parent_id, level, title, sort_order."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    regions = r.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("BOOK").alias("level"), F.col("r_name").alias("title"), F.col("r_regionkey").cast("long").alias("sort_order"))
    nations = n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id"), F.lit("MAJOR_UNIT").alias("level"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("sort_order"))
    customers = c.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.concat(F.lit("N"), "c_nationkey").alias("parent_id"), F.lit("SECTION").alias("level"), F.col("c_name").alias("title"), F.col("c_custkey").alias("sort_order"))
    return regions.unionByName(nations).unionByName(customers)


OUTLINE_SQL = """outline AS (
  SELECT 'R' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, 'BOOK' AS level, r_name AS title, CAST(r_regionkey AS BIGINT) AS sort_order FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'MAJOR_UNIT', n_name, CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'SECTION', c_name, CAST(c_custkey AS BIGINT) FROM customer)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes on pages (the orders), in page units: page, item, x, y, w, h."""
    line = table(spark, sf_dir, "lineitem")
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return line.select(
        F.col("l_orderkey").alias("page"),
        nth.cast("long").alias("item"),
        ((F.col("l_partkey") % 70) / 100.0).alias("x"),
        ((F.col("l_suppkey") % 80) / 100.0).alias("y"),
        ((F.col("l_quantity").cast("long") % 25 + 5) / 100.0).alias("w"),
        (((F.col("l_partkey") + F.col("l_suppkey")) % 15 + 5) / 100.0).alias("h"),
    )


BOXES_SQL = """boxes AS (
  SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS item, CAST(l_partkey % 70 AS DOUBLE) / 100.0 AS x, CAST(l_suppkey % 80 AS DOUBLE) / 100.0 AS y,
    CAST(CAST(l_quantity AS BIGINT) % 25 + 5 AS DOUBLE) / 100.0 AS w, CAST((l_partkey + l_suppkey) % 15 + 5 AS DOUBLE) / 100.0 AS h
  FROM lineitem)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rated items: id, type, brand, and figures that stand for difficulty dimensions 1 to 5."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    dims = [((k * m + F.col("p_size")) % 5 + 1).cast("long").alias(c) for c, m in (("concept", 3), ("calculation", 7), ("reasoning", 11), ("reading", 13), ("condition", 17), ("integration", 19))]
    return p.select(k.alias("item_id"), F.col("p_type").alias("type_id"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"), *dims)


ITEMS_SQL = """items AS (
  SELECT p_partkey AS item_id, p_type AS type_id, p_brand AS brand, CAST(p_size AS BIGINT) AS size, p_retailprice AS price,
    (p_partkey * 3 + p_size) % 5 + 1 AS concept, (p_partkey * 7 + p_size) % 5 + 1 AS calculation, (p_partkey * 11 + p_size) % 5 + 1 AS reasoning,
    (p_partkey * 13 + p_size) % 5 + 1 AS reading, (p_partkey * 17 + p_size) % 5 + 1 AS condition, (p_partkey * 19 + p_size) % 5 + 1 AS integration
  FROM part)"""


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log: run (user), candidate, stage, status, stamp."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "AUTO_APPROVED").when(F.col("event_type") == "signup", "AI_FIXED").when(F.col("event_type") == "click", "HUMAN_REVIEW").when(F.col("event_type") == "error", "FAILED").otherwise("BLOCKED")
    return e.select("event_id", F.col("user_id").alias("run_id"), (F.col("event_id") % 40).alias("candidate_id"), F.col("event_type").alias("stage"), status.alias("status"), "ts", "value", "props")


REVIEW_LOG_SQL = """review_log AS (
  SELECT event_id, user_id AS run_id, event_id % 40 AS candidate_id, event_type AS stage,
    CASE event_type WHEN 'purchase' THEN 'AUTO_APPROVED' WHEN 'signup' THEN 'AI_FIXED' WHEN 'click' THEN 'HUMAN_REVIEW' WHEN 'error' THEN 'FAILED' ELSE 'BLOCKED' END AS status, ts, value, props
  FROM events)"""


#: Blocks on a page, and what stands before and behind a sentence so that it reads as the parts of a textbook's page.
PAGE_BLOCKS = 24
MARKS = [
    ("lpad({n}, 4, '0') || ' '", "' 구하시오'"), ("{n} || '. '", "' 다음 중'"), ("'① '", "' ② ③'"), ("'풀이 '", "''"), ("'예제 '", "''"), ("'(' || {d} || ') '", "''"),
    ("'STEP 1 '", "''"), ("{n}", "' x=3 이므로 따라서 y=2'"), ("{d} || ' '", "' 정리'"), ("{n} || '값은? '", "''"), ("{n} || {n} || '다음 '", "''"), ("'용어 '", "''"), ("''", "''"), ("''", "''"), ("{d} || ' 항: '", "''"), ("'설명 '", "' 그림'"),
]


def _marked(side: int, n: str, d: str) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {m[side].format(n=n, d=d)}" for i, m in enumerate(MARKS)) + " END"


def _block_columns() -> str:
    """The columns of text_blocks() over (page, pos, k, lay, num, sentence), in SQL that both engines read."""
    n, d = "CAST(num AS STRING)", "CAST(pos % 9 + 1 AS STRING)"
    x = "CASE lay WHEN 0 THEN 10 + pos % 2 WHEN 1 THEN CASE WHEN pos < 12 THEN 20 ELSE 60 END WHEN 2 THEN CASE WHEN pos % 6 = 5 THEN 75 ELSE 20 END WHEN 3 THEN 10 + pos % 3 * 30 ELSE 20 END"
    y = "CASE lay WHEN 1 THEN 100 + pos % 12 * 65 ELSE 30 + pos * 40 END"
    w = "CASE lay WHEN 0 THEN 70 WHEN 1 THEN CASE WHEN pos < 12 THEN 28 ELSE 30 END WHEN 2 THEN CASE WHEN pos % 6 = 5 THEN 18 ELSE 50 END WHEN 3 THEN 20 ELSE 60 END"
    return f"page, pos, CAST({x} AS DOUBLE) / 100 AS x, CAST({y} AS DOUBLE) / 1000 AS y, CAST({w} AS DOUBLE) / 100 AS w, CAST(0.02 AS DOUBLE) AS h, ({_marked(0, n, d)}) || sentence || ({_marked(1, n, d)}) AS content"


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of a textbook: every sentence is a block, 24 to a page, in one of five layouts, with numbers and heads put before them: page, pos, x, y, w, h, content."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    said = d.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "sentence"))
    numbered = said.select((F.col("doc_id") * 1000 + F.floor(F.col("i") / PAGE_BLOCKS)).alias("page"), (F.col("i") % PAGE_BLOCKS).cast("long").alias("pos"), ((F.col("doc_id") * 5 + F.col("i") * 7 + F.floor(F.col("i") / 3)) % len(MARKS)).alias("k"), (F.col("doc_id") % 5).alias("lay"), (20 + F.col("doc_id") % 50 + F.col("i")).alias("num"), "sentence")
    return spark.sql(f"SELECT {_block_columns()} FROM {{numbered}}", numbered=numbered)


TEXT_BLOCKS_SQL = f"""said AS (SELECT doc_id, unnest(string_split(text, '. ')) AS sentence, generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
numbered AS (SELECT doc_id * 1000 + i // {PAGE_BLOCKS} AS page, CAST(i % {PAGE_BLOCKS} AS BIGINT) AS pos, (doc_id * 5 + i * 7 + i // 3) % {len(MARKS)} AS k, doc_id % 5 AS lay, 20 + doc_id % 50 + i AS num, sentence FROM said),
blocks AS (SELECT {_block_columns()} FROM numbered)"""


#: Sections of pages: a first one that holds many, then 400 pages each; pages from a multiple of 7,000 on have none for a while.
SECTION_OF = "CASE WHEN {p} % 7000 < 50 THEN NULL WHEN {p} < 20000 THEN 0 ELSE CAST(FLOOR({p} / 400) AS BIGINT) END"


def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as headings: section, page, x, y, kind, code, node, type, how, ambiguous. Every eleventh is ambiguous, every thirteenth not resolved, and near some sections' ends a stage begins."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0")
    code = "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 26 + 1 END"
    return o.selectExpr(
        f"{SECTION_OF.format(p='o_orderkey')} AS section", "o_orderkey AS page", "CAST(o_custkey % 2 AS DOUBLE) / 2 AS x", "CAST(o_orderkey % 90 AS DOUBLE) / 100 AS y", "CASE WHEN o_orderkey >= 20000 AND o_orderkey % 400 > 330 AND o_custkey % 5 = 1 THEN 'c_stage' WHEN o_custkey % 7 = 1 THEN 'concept_pill' ELSE 'type_pill' END AS kind",
        f"{code} AS code", f"CASE WHEN o_custkey % 7 = 1 THEN NULL ELSE {code} END AS node", f"CASE WHEN o_custkey % 7 = 1 AND o_orderkey % 13 <> 0 THEN 500 ELSE {code} + 100 END AS type", "CASE WHEN o_custkey % 7 = 1 THEN 'concept_pill' ELSE 'type_pill_badge' END AS how", "o_orderkey % 11 = 0 AS ambiguous",
    )


def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items of those pages: item, number, section, page, x, top, stem_codes, page_codes."""
    rows = boxes(spark, sf_dir)
    code = "CAST((page + item) % 26 + 1 AS BIGINT)"
    return rows.selectExpr(
        "page * 1000 + item AS item", "(page * 1000 + item) * 37 % 100003 AS number", f"{SECTION_OF.format(p='page')} AS section", "page", "x", "y AS top",
        f"CASE WHEN (page + item) % 5 = 0 THEN array({code}) WHEN (page + item) % 17 = 1 THEN array({code}, {code} % 26 + 1) ELSE CAST(array() AS ARRAY<BIGINT>) END AS stem_codes", f"CASE WHEN page % 6 = 1 THEN array(page % 26 + 1) ELSE CAST(array() AS ARRAY<BIGINT>) END AS page_codes",
    )


def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of each section: five in seven of 26 codes."""
    sections = boxes(spark, sf_dir).selectExpr(f"{SECTION_OF.format(p='page')} AS section").distinct().where("section IS NOT NULL")
    return sections.select("section", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(26).cast("long"))).alias("code")).where("(code + section) % 7 < 5").selectExpr("section", "code", "code AS node", "code + 100 AS type")


SECTION_ITEMS_SQL = f"""headings AS (SELECT {SECTION_OF.format(p='o_orderkey')} AS section, o_orderkey AS page, o_custkey % 2 / 2 >= 0.48 AS col, CAST(o_orderkey % 90 AS DOUBLE) / 100 AS y, o_orderkey >= 20000 AND o_orderkey % 400 > 330 AND o_custkey % 5 = 1 AS c, o_custkey % 7 = 1 AS concept, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 26 + 1 END AS code, o_orderkey % 11 = 0 AS amb FROM orders WHERE o_custkey % 3 <> 0),
items AS (SELECT page * 1000 + item AS item, (page * 1000 + item) * 37 % 100003 AS number, {SECTION_OF.format(p='page')} AS section, page, x >= 0.48 AS col, y AS top, CASE WHEN (page + item) % 5 = 0 THEN [(page + item) % 26 + 1] WHEN (page + item) % 17 = 1 THEN [(page + item) % 26 + 1, ((page + item) % 26 + 1) % 26 + 1] ELSE [] END AS sc, CASE WHEN page % 6 = 1 THEN [page % 26 + 1] ELSE [] END AS pc FROM boxes)"""


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as crops of problems, with the text of the document that has the page's number, other problems' numbers put in, and measures of an image."""
    b = boxes(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    rows = b.join(docs, "page", "left").selectExpr("*", "CAST((page * 7 + item) % 9000 + 1000 AS STRING) AS number", "CAST((page * 7 + item + 1) % 9000 + 1000 AS STRING) AS other", "CAST((page + item) % 8 AS INT) AS k", "(page * 31 + item * 17) % 100 AS m", "coalesce(text, 'none') AS said")
    stem = r"CASE k WHEN 0 THEN number || ' ' || said WHEN 1 THEN number || ' ' || said || '\n' || other || ' | 대표\nlast' WHEN 2 THEN number || '\n' || said || '\n# ' || other || '. ' WHEN 3 THEN number || ' $x^{' || other || '}$\n$' || other || ' y$ ' || said WHEN 4 THEN number || ' [' || number || '~' || other || '] ' || said WHEN 5 THEN said WHEN 6 THEN number || ' ' || other || ' ' || said || ' of it that goes on for long' END"
    image = "CASE WHEN m % 9 <> 4 THEN named_struct('width', CAST(w * 1000 AS INT), 'height', CAST(h * 1000 AS INT), 'ink', CASE WHEN m % 5 = 1 THEN NULL ELSE CAST(m AS DOUBLE) / 1000 END, 'components', CAST(m % 4 AS INT), 'left_top_ink', m % 3 = 0, 'top', CAST((m * 3) % 100 AS DOUBLE) / 150, 'bottom', CAST((m * 7) % 100 AS DOUBLE) / 150, 'left', CAST((m * 11) % 100 AS DOUBLE) / 150, 'right', CAST((m * 13) % 100 AS DOUBLE) / 150, 'blob_edge', m % 10 = 7, 'blob_share', CAST(m AS DOUBLE) / 500) END"
    return rows.selectExpr("page", "item", "number", "CASE WHEN m % 13 <> 5 THEN number END AS canonical", "x", "y", "w", "h", f"{stem} AS stem", "CASE WHEN m % 2 = 0 THEN 'note' END AS markdown", "m % 4 <> 1 AS anchored", "m % 17 = 3 AS unstable", "m % 19 = 4 AS uncertain", "m % 3 AS columns", "m % 6 = 2 AS last", "m % 7 = 3 AS figure_hint", f"{image} AS image")


def crop_parts(spark: SparkSession, sf_dir: str, shift: float) -> DataFrame:
    """What is known to belong to crops: every third one has a part that may stick out: page, item, x, y, w, h, content."""
    return boxes(spark, sf_dir).where("(page + item) % 3 = 0").selectExpr("page", "item", f"x + {shift} AS x", "y", "w", "h / 2 AS h", "'part ' || item AS content")

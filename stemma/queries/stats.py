"""Counts, distributions and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.scores import band, clamp01, mean_of, weighted
from ..operators import stats as S
from ..sources.tables import table
from ..sources.views import ITEMS_SQL, PROBLEMS_SQL, REVIEW_LOG_SQL, items, problems, review_log

_REASONS = """SELECT doc_id, list_filter([CASE WHEN page IS NULL THEN 'NO_PAGE' END, CASE WHEN n_chars < 300 THEN 'THIN' END, CASE WHEN review_status = 'AUTO_CLASSIFIED' THEN 'NO_VERIFIED' END, CASE WHEN toxic = 1 THEN 'TOXIC' END], lambda x: x IS NOT NULL) AS reasons FROM problems"""


@query(f"""WITH {PROBLEMS_SQL}, r AS ({_REASONS}), e AS (SELECT doc_id, unnest(reasons) AS reason FROM r) SELECT reason, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS "rows" FROM e WHERE reason <> 'NO_VERIFIED' GROUP BY reason""")
def reason_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason for review is given, policy reasons apart."""
    from ..functions.text import tags

    p = problems(spark, sf_dir)
    rows = p.select("doc_id", tags(NO_PAGE=F.col("page").isNull(), THIN=F.col("n_chars") < 300, NO_VERIFIED=F.col("review_status") == "AUTO_CLASSIFIED", TOXIC=F.col("toxic") == 1).alias("reasons"))
    return S.census(rows, "reasons", ["NO_VERIFIED", "MATH_UNCERTAIN"])


@query("""WITH d(value) AS (VALUES ('0'), ('1'), ('2'), ('REVIEW')) SELECT d.value, COALESCE(n, 0) AS n FROM d LEFT JOIN (SELECT COALESCE(CAST(quality AS VARCHAR), 'REVIEW') AS value, CAST(count(*) AS BIGINT) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) c ON d.value = c.value""")
def grade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per grade with empty ones, unknown under REVIEW."""
    return S.histogram(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "quality", [0, 1, 2])


_BAND = "CASE WHEN price < 920 THEN 'LOW' WHEN price < 1000 THEN 'MID' WHEN price >= 1000 THEN 'HIGH' END"


@query(f"WITH {ITEMS_SQL}, b AS (SELECT brand, {_BAND} AS band FROM items) SELECT brand, CAST(count(*) FILTER (band = 'LOW') AS BIGINT) AS low, CAST(count(*) FILTER (band = 'MID') AS BIGINT) AS mid, CAST(count(*) FILTER (band = 'HIGH') AS BIGINT) AS high, CAST(count(*) FILTER (band IS NULL) AS BIGINT) AS unknown FROM b GROUP BY brand")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand by price band."""
    return S.crosstab(items(spark, sf_dir), "brand", band(F.col("price"), [920, 1000], ["LOW", "MID", "HIGH"]), ["LOW", "MID", "HIGH"])


@query(f"WITH {ITEMS_SQL} SELECT type_id, CAST(count(price) AS BIGINT) AS n, round(min(price), 3) AS min, round(quantile_cont(price, 0.25), 3) AS q1, round(quantile_cont(price, 0.5), 3) AS median, round(avg(price), 3) AS mean, round(quantile_cont(price, 0.75), 3) AS q3, round(max(price), 3) AS max, round(stddev_pop(price), 3) AS std FROM items GROUP BY type_id")
def quantile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of prices per type."""
    return S.describe(items(spark, sf_dir), "type_id", "price")


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT brand, rank() OVER (PARTITION BY brand ORDER BY size) + (count(*) OVER (PARTITION BY brand, size) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY brand ORDER BY price) + (count(*) OVER (PARTITION BY brand, price) - 1) / 2.0 AS ry FROM items)
SELECT brand, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rx, ry), 3) END AS rho FROM r GROUP BY brand""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of size and price per brand."""
    return S.spearman(items(spark, sf_dir), "brand", "size", "price")


_CONFUSION = "CAST(count(*) FILTER (a AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT a AND p) AS BIGINT) AS fp, CAST(count(*) FILTER (a AND NOT p) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT a AND NOT p) AS BIGINT) AS tn"


@query(f"""WITH c AS (SELECT lang, {_CONFUSION} FROM (SELECT lang, quality = 0 AS a, n_chars < 500 AS p FROM documents JOIN labels USING (doc_id)) GROUP BY lang)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END, 6) AS recall, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS false_rate FROM c""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length tells low quality, per language."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return S.confusion(rows, F.col("quality") == 0, F.col("n_chars") < 500, "lang")


@query("""WITH s AS (SELECT least(1.0, n_chars / 4000.0) AS score, (doc_id % 10) / 10.0 AS margin, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)),
g AS (SELECT t, m, (row_number() OVER (ORDER BY ti, mi)) - 1 AS cell FROM (VALUES (1, 0.1), (2, 0.3), (3, 0.6)) a(ti, t), (VALUES (1, 0.0), (2, 0.2), (3, 0.4), (4, 0.6)) b(mi, m)),
c AS (SELECT g.cell, g.t, g.m, count(*) FILTER (score >= t AND margin >= m) AS accepted, count(*) FILTER (score >= t AND margin >= m AND NOT ok) AS errors FROM g, s GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY errors, accepted DESC, cell) AS BIGINT) AS place, CAST(t AS DOUBLE) AS threshold, CAST(m AS DOUBLE) AS margin, CAST(accepted AS BIGINT) AS accepted, CAST(errors AS BIGINT) AS errors FROM c""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every pair of thresholds, best first."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"), (F.col("doc_id") % 10 / 10.0).alias("margin"), (F.col("quality") == 1).alias("ok"))
    return S.threshold_grid(rows, "score", "margin", F.col("ok"), [0.1, 0.3, 0.6], [0.0, 0.2, 0.4, 0.6])


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT brand, price, row_number() OVER (PARTITION BY brand ORDER BY price, item_id) - 1 AS i, count(*) OVER (PARTITION BY brand) AS n FROM items)
SELECT brand, max(price) FILTER (i = CAST(floor((n - 1) * CAST(0.18 AS DOUBLE) + 0.5) AS BIGINT)) AS c1, max(price) FILTER (i = CAST(floor((n - 1) * CAST(0.38 AS DOUBLE) + 0.5) AS BIGINT)) AS c2, max(price) FILTER (i = CAST(floor((n - 1) * CAST(0.62 AS DOUBLE) + 0.5) AS BIGINT)) AS c3, max(price) FILTER (i = CAST(floor((n - 1) * CAST(0.82 AS DOUBLE) + 0.5) AS BIGINT)) AS c4 FROM p GROUP BY brand""")
def calibrate_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts at nearest ranks per brand."""
    return S.nearest_rank(items(spark, sf_dir), "brand", "price", ["price", "item_id"], {"c1": 0.18, "c2": 0.38, "c3": 0.62, "c4": 0.82})


@query("WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source, max(n) / sum(n) AS s FROM n GROUP BY source) SELECT source, round(s, 6) AS top_share, s >= 0.55 AS collapsed FROM s")
def collapse_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources where one language takes most."""
    return S.collapsed(table(spark, sf_dir, "documents"), "source", "lang")


@query("""WITH v AS (SELECT l_partkey, l_shipmode AS label FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)), n AS (SELECT l_partkey, label, CAST(count(*) AS BIGINT) AS votes FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, label) AS k FROM n)
SELECT l_partkey, label, votes FROM r WHERE k = 1 AND votes >= 12""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent state of each part with at least twelve votes."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("label"))
    return S.majority(rows, ["l_partkey"], "label", 12)


@query(f"""WITH {REVIEW_LOG_SQL}, r AS (SELECT stage AS engine, event_id % 7 AS h1, 7 AS t1, event_id % 3 AS h2, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END AS t2, CASE WHEN event_id % 5 < 2 THEN 'GREEN' WHEN event_id % 5 = 2 THEN 'YELLOW' ELSE 'RED' END AS verdict, value FROM review_log)
SELECT engine, CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (verdict = 'GREEN') AS BIGINT) AS green, CAST(count(*) FILTER (verdict = 'YELLOW') AS BIGINT) AS yellow, CAST(count(*) FILTER (verdict = 'RED') AS BIGINT) AS red, round(avg(value), 3) AS mean_seconds,
  round(sum(h1) / sum(t1), 3) AS digits, round(sum(h2) / sum(t2), 3) AS operators FROM r GROUP BY engine""")
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates and verdicts per engine, as ratios of sums."""
    e = F.col("event_id")
    rows = review_log(spark, sf_dir).select(F.col("stage").alias("engine"), (e % 7).alias("h1"), F.lit(7).alias("t1"), (e % 3).alias("h2"), F.when(e % 2 == 0, 3).otherwise(0).alias("t2"), F.when(e % 5 < 2, "GREEN").when(e % 5 == 2, "YELLOW").otherwise("RED").alias("verdict"), "value")
    return S.scoreboard(rows, "engine", {"digits": ("h1", "t1"), "operators": ("h2", "t2")}, "verdict", "value")


@query(f"""WITH {ITEMS_SQL}, b AS (SELECT brand, CAST(count(price) AS BIGINT) AS n, round(max(price) - min(price), 6) AS spread FROM items GROUP BY brand) SELECT *, CASE WHEN n >= 8 AND spread >= 0.04 THEN 'PASS' WHEN n >= 8 OR spread >= 0.04 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM b""")
def band_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread and stability per brand."""
    return S.spread(items(spark, sf_dir), "brand", "price")


@query("""WITH d AS (SELECT DISTINCT text FROM documents WHERE trim(text) <> ''), c AS (SELECT CAST(count(*) AS BIGINT) AS texts, CAST(sum(greatest(32, ceil(length(text) / 2))) AS BIGINT) AS tokens FROM d) SELECT *, round(tokens * 0.1 / 1e6, 6) AS usd, round(tokens * 0.1 / 1e6, 6) <= 5 AS within_cap FROM c""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and price of all distinct texts."""
    return S.cost_rollup(table(spark, sf_dir, "documents"), "text")


@query("""WITH p AS (SELECT page_id, CAST(row_number() OVER (ORDER BY page_id) AS BIGINT) AS call FROM pages WHERE page_id % 3 = 0) SELECT page_id, call, CAST(round(call * 0.005, 6) AS DOUBLE) AS cost, call <= 60 AND round(call * 0.005, 6) <= 0.2 AS planned FROM p""")
def paid_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without text, with calls and money that last for some of them."""
    rows = table(spark, sf_dir, "pages").select("page_id").where("page_id % 3 = 0")
    return S.capped_plan(rows, ["page_id"], 0.005, 60, 0.2)


@query(f"""WITH {PROBLEMS_SQL} SELECT CAST(count(*) FILTER (NOT COALESCE(n_chars > 0, FALSE)) AS BIGINT) AS has_text, CAST(count(*) FILTER (NOT COALESCE(page BETWEEN 0 AND 199, FALSE)) AS BIGINT) AS page_known, CAST(count(*) FILTER (NOT (review_status <> 'VERIFIED' OR lifecycle <> 'ARCHIVED')) AS BIGINT) AS verified_kept FROM problems""")
def safety_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of invariants, one row."""
    return S.assert_counts(problems(spark, sf_dir), has_text=F.col("n_chars") > 0, page_known=F.col("page").between(0, 199), verified_kept=(F.col("review_status") != "VERIFIED") | (F.col("lifecycle") != "ARCHIVED"))


_WEIGHTS = {"concept": 0.05, "calculation": 0.04, "reasoning": 0.04, "reading": 0.03, "condition": 0.02, "integration": 0.02}


@query(f"""WITH {ITEMS_SQL}, s AS (SELECT item_id, CAST(round(greatest(0.0, least(1.0, concept * 0.05 + calculation * 0.04 + reasoning * 0.04 + reading * 0.03 + condition * 0.02 + integration * 0.02)), 6) AS DOUBLE) AS score FROM items)
SELECT item_id, score, CAST(CASE WHEN score < 0.3 THEN 1 WHEN score < 0.42 THEN 2 WHEN score < 0.56 THEN 3 WHEN score < 0.72 THEN 4 ELSE 5 END AS INTEGER) AS band FROM s""")
def weighted_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted score of the dimensions, and its band by fixed cuts."""
    scored = items(spark, sf_dir).select("item_id", F.round(weighted(_WEIGHTS), 6).alias("score"))
    return scored.withColumn("band", band(F.col("score"), [0.3, 0.42, 0.56, 0.72], [1, 2, 3, 4, 5]))


@query(f"WITH {ITEMS_SQL} SELECT item_id, CAST(round(CAST(concept + calculation + reasoning + reading + condition + integration AS DECIMAL(18,6)) / 6, 2) AS DOUBLE) AS overall FROM items")
def overall_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of six dimensions, two decimals, half up."""
    dims = [F.col(c) for c in _WEIGHTS]
    return items(spark, sf_dir).select("item_id", mean_of(*dims).cast("double").alias("overall"))


@query(f"""WITH {ITEMS_SQL}, m AS (SELECT type_id, median(price) AS med, count(*) AS n FROM items GROUP BY type_id) SELECT item_id, CASE WHEN n >= 6 THEN round(greatest(0.0, least(1.0, 0.5 + (price - med) / 1000)), 6) END AS relative FROM items JOIN m USING (type_id)""")
def type_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against the median of their type, where the type has enough items."""
    rows = items(spark, sf_dir)
    medians = rows.groupBy("type_id").agg(F.expr("percentile(price, 0.5D)").alias("med"), F.count("*").alias("n"))
    return rows.join(medians, "type_id").select("item_id", F.when(F.col("n") >= 6, F.round(clamp01(0.5 + (F.col("price") - F.col("med")) / 1000), 6)).alias("relative"))


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT item_id, brand, type_id, size, {_BAND} AS band FROM items) SELECT CAST(count(*) FILTER (size >= 40 AND band = 'LOW') AS BIGINT) AS large_low, CAST(count(*) FILTER (size <= 10 AND band = 'HIGH') AS BIGINT) AS small_high, CAST(count(*) AS BIGINT) AS n FROM r""")
def inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that contradict their band."""
    b = band(F.col("price"), [920, 1000], ["LOW", "MID", "HIGH"])
    return items(spark, sf_dir).agg(F.count_if((F.col("size") >= 40) & (b == "LOW")).alias("large_low"), F.count_if((F.col("size") <= 10) & (b == "HIGH")).alias("small_high"), F.count("*").alias("n"))


@query("""WITH f AS (SELECT lower(trim(p_type)) AS k, p_partkey, p_brand FROM part) SELECT k AS type_key, min(p_partkey) AS first_id, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS brands FROM f GROUP BY k""")
def canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels folded to one key: first id and the union of what goes with them."""
    f = table(spark, sf_dir, "part").select(F.lower(F.trim("p_type")).alias("type_key"), "p_partkey", "p_brand")
    return f.groupBy("type_key").agg(F.min("p_partkey").alias("first_id"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("brands"))

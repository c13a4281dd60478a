"""Steps of the work on a collection, over tables that stand for its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..functions.scores import ordinal_position
from ..operators import kernels as K
from ..operators import spatial as G
from ..operators import workflow as P
from ..operators.dedup import CLASS_ORDER, pick_decision
from ..sources.tables import table
from ..sources.views import BOXES_SQL, PROBLEMS_SQL, boxes, problems
from .rules import _KEYS, _flag, _flag_sql


@query(f"""WITH {PROBLEMS_SQL}, q AS (SELECT o_orderkey AS seq, o_custkey % (SELECT count(*) FROM documents) AS a, CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey % 97 END AS b, CASE o_orderkey % 2 WHEN 0 THEN 'EXACT_DUPLICATE' ELSE 'VERSION_CANDIDATE' END AS kind FROM orders),
p AS (SELECT *, a AS keeper, b AS extra, least(a, b) AS lo, greatest(a, b) AS hi, b IS NOT NULL AS whole FROM q),
l AS (SELECT lo, hi, whole, arg_max({{'kind': kind, 'keeper': keeper, 'extra': extra}}, seq) AS p FROM p GROUP BY lo, hi, whole),
m AS (SELECT lo, hi, p.kind AS kind, p.keeper AS keeper, p.extra AS extra, CASE WHEN NOT whole THEN 'BAD' WHEN COALESCE(x.review_status = 'VERIFIED', FALSE) OR COALESCE(y.review_status = 'VERIFIED', FALSE) THEN 'SKIP_VERIFIED' ELSE 'LINK' END AS action,
  CASE WHEN p.extra = lo THEN x.display_state ELSE y.display_state END AS shown FROM l LEFT JOIN problems x ON x.doc_id = lo LEFT JOIN problems y ON y.doc_id = hi)
SELECT lo, hi, kind, keeper, extra, action, COALESCE(action = 'LINK' AND NOT COALESCE(shown = 'HIDDEN_DUPLICATE', FALSE), FALSE) AS hides FROM m""")
def linked_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links asked for by orders between documents, and which of them hide one."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").join(F.broadcast(n)).select(k.alias("seq"), (F.col("o_custkey") % F.col("n")).alias("a"), F.when(k % 23 != 0, k % 97).alias("b"), F.when(k % 2 == 0, "EXACT_DUPLICATE").otherwise("VERSION_CANDIDATE").alias("kind"))
    pairs = asked.select("*", F.col("a").alias("keeper"), F.col("b").alias("extra"))
    return P.link_duplicates(pairs, problems(spark, sf_dir), "doc_id")


_PERSIST = {"existing": (3, 13), "right_source": (5, 2), "page_known": (7, 2), "checked": (11, 2), "collides": (13, 7), "has_box": (17, 2), "has_crop": (19, 2), "canonical": (23, 2)}


@query(f"""WITH e AS (SELECT {', '.join(_KEYS)}, {', '.join(f'{_flag_sql(*v)} AS {n}' for n, v in _PERSIST.items())} FROM lineitem) SELECT {', '.join(_KEYS)}, CASE WHEN existing THEN 'RECORD_EXISTING' WHEN NOT (right_source AND page_known AND checked) THEN 'SKIP_BLOCKED' WHEN collides THEN 'SKIP_DUPLICATE' WHEN NOT (has_box AND has_crop) THEN 'SKIP_BLOCKED' WHEN NOT canonical THEN 'SKIP_IDENTITY' ELSE 'CREATE_DRAFT' END AS action,
CASE WHEN existing THEN 'EXISTING_PRODUCTION_DRAFT' WHEN NOT right_source THEN 'WRONG_SOURCE' WHEN NOT page_known THEN 'PAGE_OUT_OF_RANGE' WHEN NOT checked THEN 'DUPLICATE_CHECK_MISSING' WHEN collides THEN 'IDENTITY_COLLISION' WHEN NOT has_box THEN 'BBOX_MISSING' WHEN NOT has_crop THEN 'CROP_MISSING' WHEN NOT canonical THEN 'IDENTITY_NOT_CANONICAL' ELSE 'DEFAULT' END AS rule FROM e""")
def persist_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cut-out items become drafts."""
    v = P.persist_action({n: _flag(*a) for n, a in _PERSIST.items()})
    return table(spark, sf_dir, "lineitem").select(*_KEYS, v["verdict"].alias("action"), v["rule"].alias("rule"))


@query("""WITH r AS (SELECT doc_id, doc_id // 7 AS page, n_chars FROM documents), b AS (SELECT min(page) AS lo, max(page) AS hi FROM r), t AS (SELECT *, CASE WHEN page - lo <= (hi - lo) / 3 THEN 0 WHEN page - lo <= (hi - lo) * 2 / 3 THEN 1 ELSE 2 END AS third FROM r, b),
s AS (SELECT *, row_number() OVER (PARTITION BY third ORDER BY CASE WHEN n_chars > 500 THEN 2 ELSE 0 END + CASE WHEN doc_id >= 100 THEN 1 ELSE 0 END DESC, page, doc_id) <= 3 AS best FROM t)
SELECT doc_id, page, n_chars FROM s ORDER BY best DESC, page, doc_id LIMIT 10""")
def pilot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents to begin with: the best of each third of the pages, then the first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 7).alias("page"), "n_chars")
    score = F.when(F.col("n_chars") > 500, 2).otherwise(0) + F.when(F.col("doc_id") >= 100, 1).otherwise(0)
    return P.pilot(rows, "page", "doc_id", score, 10)


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 5 <> 0 INTERSECT SELECT l_partkey FROM lineitem WHERE l_orderkey % 5 = 0")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that lines on both sides of a split hold."""
    line = table(spark, sf_dir, "lineitem")
    return P.leaked_ids(line.where("l_orderkey % 5 <> 0"), line.where("l_orderkey % 5 = 0"), "l_partkey")


@query("""WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE event_id % 50 <> 1), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE event_id % 50 <> 2)
SELECT COALESCE(a.user_id, b.user_id) AS user_id, COALESCE(a.place, b.place) AS place, a.event_id AS before, b.event_id AS after FROM a FULL JOIN b ON a.user_id = b.user_id AND a.place = b.place WHERE a.event_id IS DISTINCT FROM b.event_id""")
def replay_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two replays of the event log, each without some events, differ."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("at"))
    return P.replay_faults(e.where("event_id % 50 <> 1"), e.where("event_id % 50 <> 2"), "user_id", "at", "event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN TRUE WHEN o_orderkey % 6 = 0 OR o_custkey % 3 = 0 THEN TRUE ELSE FALSE END AS complete FROM orders""")
def choice_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the choices they need."""
    text = F.when(F.col("o_custkey") % 3 == 0, "값을 구하시오").when(F.col("o_custkey") % 3 == 1, "다음 중 옳은 것은?").otherwise("x = 3")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.choices_complete(text, F.col("o_orderkey") % 6).alias("complete"))


@query("""WITH j AS (SELECT o_orderpriority AS grp, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 END AS given, CASE WHEN o_custkey % 6 <> 0 THEN o_custkey % 3 END AS truth, o_orderkey % 4 = 0 AS sure FROM orders),
c AS (SELECT grp, count_if(given = truth) AS correct, count_if(given <> truth) AS wrong, count_if(truth IS NULL) AS ambiguous, count_if(truth IS NOT NULL AND given IS NULL) AS missing, count_if(given <> truth AND sure) AS sure_wrong FROM j GROUP BY grp) SELECT *, CASE WHEN correct + wrong > 0 THEN round(CAST(correct AS DOUBLE) / (correct + wrong), 6) END AS "right" FROM c""")
def judged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels judged against true ones, by priority."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").withColumn("grp", F.col("o_orderpriority"))
    return P.rate_judgements(rows, "grp", F.when(k % 7 != 0, k % 3), F.when(c % 6 != 0, c % 3), k % 4 == 0)


@query(f"""WITH {BOXES_SQL} SELECT r.page, r.item AS region, CAST(count(b.item) AS BIGINT) AS blocks, COALESCE(string_agg('L' || b.item, chr(10) ORDER BY b.item), '') AS text FROM boxes r LEFT JOIN boxes b ON r.page = b.page AND b.item % 2 = 0
  AND ((b.x + b.w / 2 BETWEEN r.x - 0.01 AND r.x + r.w + 0.01 AND b.y + b.h / 2 BETWEEN r.y - 0.01 AND r.y + r.h + 0.01) OR greatest(0, least(r.x + r.w, b.x + b.w) - greatest(r.x, b.x)) * greatest(0, least(r.y + r.h, b.y + b.h) - greatest(r.y, b.y)) / (b.w * b.h) >= 0.5503) WHERE r.item % 2 = 1 GROUP BY ALL""")
def coverage_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the blocks whose centres lie in each region, or of which 0.5503 does."""
    b = boxes(spark, sf_dir)
    regions = b.where("item % 2 = 1").withColumnRenamed("item", "region")
    blocks = b.where("item % 2 = 0").withColumn("content", F.concat(F.lit("L"), "item")).withColumnRenamed("item", "pos")
    return G.text_in_regions(regions, blocks, "page", coverage=0.5503)


_CLASS = "CASE l_linenumber % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASS_ORDER)) + " ELSE 'OTHER' END"


@query(f"SELECT l_partkey, arg_min({_CLASS}, l_linenumber % 5) AS kind FROM lineitem GROUP BY l_partkey")
def picked_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision on each part, of all that its lines ask for."""
    kinds = F.array(*[F.lit(c) for c in (*CLASS_ORDER, "OTHER")])
    return pick_decision(table(spark, sf_dir, "lineitem").select("l_partkey", F.get(kinds, (F.col("l_linenumber") % 5).cast("int")).alias("kind")), "l_partkey")


@query("""SELECT c_custkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(c_name, ''), lambda s: CAST(ord(s) AS BIGINT))), lambda h, c: xor(h, c) * 16777619 % 4294967296) AS fnv, lower(sha256(c_name)) AS sha,
c_custkey % 5 AS place, CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE -1 END AS next_at, round(CASE WHEN c_custkey % 4 <= 1 THEN 0.0 ELSE (c_custkey % 2) / ((c_custkey % 4) - 1.0) END, 6) AS ordinal, CASE WHEN c_custkey % 3 = 0 THEN '다음' ELSE '' END AS hangul FROM customer""")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of names, where the next item's number stands, places among siblings and letters of one script."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("다음 x "), F.lpad((k % 100 + 1).cast("string"), 4, "0"))).otherwise(F.concat(F.lit("$"), F.lpad((k % 100 + 1).cast("string"), 4, "0"), F.lit("$")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", K.fnv1a("c_name").alias("fnv"), X.checked_sha256(F.concat(F.lit(" "), F.upper(F.sha2("c_name", 256)))).alias("sha"), (k % 5).alias("place"),
        K.next_number_at(text, k % 100).alias("next_at"), F.round(ordinal_position(k % 2, k % 4), 6).alias("ordinal"), X.script_only(text).alias("hangul"),
    )


@query("""WITH t AS (SELECT page_id, page_id % 4 AS k FROM pages) SELECT page_id, CASE k WHEN 0 THEN 'a' || chr(10) || 'b' WHEN 1 THEN page_id || 'c' WHEN 2 THEN '' END AS text, CASE WHEN k = 0 THEN 'Sums' WHEN k = 1 THEN '12 Sums' ELSE 'x' END AS core FROM t""")
def tree_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts of document trees, and titles without what marks a type."""
    k = F.col("page_id") % 4
    tree = F.when(k == 0, '{"type":"doc","content":[{"type":"paragraph","content":[{"text":"a"}]},{"type":"heading","content":[{"text":"b"}]}]}').when(k == 1, F.concat(F.lit('{"content":[{"text":"'), "page_id", F.lit('"},{"text":"c"}]}'))).when(k == 2, "{}").otherwise("no json")
    title = F.when(k == 0, "유형 07 Sums").when(k == 1, "12 Sums").otherwise("유형3x")
    return table(spark, sf_dir, "pages").select("page_id", K.tree_text(tree).alias("text"), X.core_title(title).alias("core"))


@query("""WITH a AS (SELECT DISTINCT l_partkey % 400 AS item, l_linenumber % 4 AS version, CASE WHEN (l_partkey + l_linenumber) % 6 = 0 THEN 'SUBMIT' WHEN (l_partkey + l_linenumber) % 6 = 1 THEN 'VERIFY' WHEN (l_partkey + l_linenumber) % 6 = 2 THEN 'REJECT' WHEN (l_partkey + l_linenumber) % 6 = 3 THEN 'ARCHIVE' WHEN (l_partkey + l_linenumber) % 6 = 4 THEN 'RESTORE' ELSE 'OTHER' END AS kind,
  CASE WHEN l_partkey % 5 > 0 THEN ' no ' ELSE ' ' END AS note, l_partkey % 7 > 1 AS gate FROM lineitem),
v AS (SELECT item, version, CASE (item + version) % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'AUTO_CLASSIFIED' ELSE 'NEEDS_REVIEW' END AS vs FROM (SELECT p_partkey AS item, unnest([1, 2]) AS version FROM part)),
i AS (SELECT p_partkey AS item, p_partkey % 2 + 1 AS cur, CASE WHEN p_size % 2 = 0 THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS st, CASE WHEN p_partkey % 3 = 0 THEN 'ARCHIVED' WHEN p_partkey % 3 = 1 THEN 'ACTIVE' END AS life FROM part WHERE p_partkey % 10 <> 9),
m AS (SELECT a.*, vs, cur, st, life, CASE kind WHEN 'SUBMIT' THEN CASE WHEN vs IS NULL THEN 'MISSING_VERSION' WHEN vs = 'VERIFIED' THEN 'VERIFIED_LOCKED' END WHEN 'VERIFY' THEN CASE WHEN vs IS NULL THEN 'MISSING_VERSION' WHEN NOT gate THEN 'GATE' END WHEN 'REJECT' THEN CASE WHEN trim(note) = '' THEN 'MISSING_NOTE' WHEN vs IS NULL THEN 'MISSING_VERSION' END
  WHEN 'ARCHIVE' THEN CASE WHEN COALESCE(life, 'ARCHIVED') = 'ARCHIVED' THEN 'MISSING_ITEM' END WHEN 'RESTORE' THEN CASE WHEN life IS DISTINCT FROM 'ARCHIVED' THEN 'MISSING_ITEM' END ELSE 'UNKNOWN_KIND' END AS error FROM a LEFT JOIN v ON a.item = v.item AND a.version = v.version LEFT JOIN i ON a.item = i.item)
SELECT item, version, kind, error, CASE WHEN error IS NULL AND kind = 'SUBMIT' THEN 'NEEDS_REVIEW' WHEN error IS NULL AND kind = 'VERIFY' THEN 'VERIFIED' WHEN error IS NULL AND kind = 'REJECT' THEN 'REJECTED' ELSE vs END AS version_status, CASE WHEN error IS NULL AND kind = 'VERIFY' THEN version ELSE cur END AS current_version,
  CASE WHEN error IS NULL AND kind = 'VERIFY' THEN 'VERIFIED' WHEN error IS NULL AND kind = 'SUBMIT' AND cur = version THEN 'NEEDS_REVIEW' WHEN error IS NULL AND kind = 'REJECT' AND cur = version THEN 'REJECTED' ELSE st END AS item_status,
  CASE WHEN error IS NOT NULL THEN life WHEN kind = 'VERIFY' THEN 'ACTIVE' WHEN kind = 'ARCHIVE' THEN 'ARCHIVED' WHEN kind = 'RESTORE' THEN 'DRAFT' ELSE life END AS lifecycle FROM m""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to submit, verify, reject, archive and restore, and the states after each."""
    k, n = F.col("l_partkey"), F.col("l_linenumber").cast("long")
    kinds = F.array(*[F.lit(x) for x in ("SUBMIT", "VERIFY", "REJECT", "ARCHIVE", "RESTORE", "OTHER")])
    asked = table(spark, sf_dir, "lineitem").select((k % 400).alias("item"), (n % 4).alias("version"), F.get(kinds, ((k + n) % 6).cast("int")).alias("kind"), F.when(k % 5 > 0, " no ").otherwise(" ").alias("note"), (k % 7 > 1).alias("gate")).distinct()
    p, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    both = part.select(p.alias("item"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("version"))
    s = (F.col("item") + F.col("version")) % 3
    versions = both.withColumn("review_status", F.when(s == 0, "VERIFIED").when(s == 1, "AUTO_CLASSIFIED").otherwise("NEEDS_REVIEW"))
    items = part.where("p_partkey % 10 <> 9").select(p.alias("item"), (p % 2 + 1).alias("current_version"), F.when(F.col("p_size") % 2 == 0, "VERIFIED").otherwise("NEEDS_REVIEW").alias("review_status"), F.when(p % 3 == 0, "ARCHIVED").when(p % 3 == 1, "ACTIVE").alias("lifecycle"))
    return P.transitions(asked, versions, items)

"""Steps of the work on a collection: linked duplicates, what is persisted, pilots, leakage and replays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import decide
from ..functions.text import tags


def link_duplicates(pairs: DataFrame, items: DataFrame, item: str = "item", order: str = "seq") -> DataFrame:
    """What becomes of asked links (a, b, keeper, extra, kind, order): one row a pair, smaller item first: (lo, hi, kind, keeper, extra, action, hides).

    items: item, review_status, display_state. SKIP_VERIFIED where either end is verified; else LINK, the last asked of a pair counting, which hides the
    extra item unless it is hidden already. BAD where an end, the keeper or the extra item is null.
    """
    whole = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("keeper").isNotNull() & F.col("extra").isNotNull()
    last = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), whole.alias("whole")).agg(F.max_by(F.struct("kind", "keeper", "extra"), order).alias("p"))
    state = lambda name: items.select(F.col(item).alias(name), F.col("review_status").alias(f"{name}_review"), F.col("display_state").alias(f"{name}_display"))
    met = last.select("lo", "hi", "whole", "p.*").join(state("lo"), "lo", "left").join(state("hi"), "hi", "left")
    verified = F.coalesce(F.col("lo_review") == "VERIFIED", F.lit(False)) | F.coalesce(F.col("hi_review") == "VERIFIED", F.lit(False))
    action = F.when(~F.col("whole"), "BAD").when(verified, "SKIP_VERIFIED").otherwise("LINK")
    shown = F.when(F.col("extra") == F.col("lo"), F.col("lo_display")).otherwise(F.col("hi_display"))
    hides = (action == "LINK") & F.col("extra").isin(F.col("lo"), F.col("hi")) & ~F.coalesce(shown == "HIDDEN_DUPLICATE", F.lit(False))
    return met.select("lo", "hi", "kind", "keeper", "extra", action.alias("action"), F.coalesce(hides, F.lit(False)).alias("hides"))


def persist_action(e: Mapping[str, Column]) -> Column:
    """struct(verdict, rule): whether a cut-out item becomes a draft. e: existing, right_source, page_known, checked, collides, has_box, has_crop, canonical; unknown ones do not hold."""
    has = {k: F.coalesce(c, F.lit(False)) for k, c in e.items()}
    blocked = "SKIP_BLOCKED"
    return decide(
        [
            (has["existing"], "RECORD_EXISTING", "EXISTING_PRODUCTION_DRAFT"),
            (~has["right_source"], blocked, "WRONG_SOURCE"),
            (~has["page_known"], blocked, "PAGE_OUT_OF_RANGE"),
            (~has["checked"], blocked, "DUPLICATE_CHECK_MISSING"),
            (has["collides"], "SKIP_DUPLICATE", "IDENTITY_COLLISION"),
            (~has["has_box"], blocked, "BBOX_MISSING"),
            (~has["has_crop"], blocked, "CROP_MISSING"),
            (~has["canonical"], "SKIP_IDENTITY", "IDENTITY_NOT_CANONICAL"),
        ],
        "CREATE_DRAFT",
    )


def pilot(rows: DataFrame, page: str, number: str, score: Column, most: int = 10) -> DataFrame:
    """At most so many rows, which page and number tell apart: the best of each third of the pages, a third of the room each, then the first ones. The limit is what a pilot is."""
    ends = rows.agg(F.min(page).alias("__lo"), F.max(page).alias("__hi"))
    place = F.col(page) - F.col("__lo")
    third = F.when(place <= (F.col("__hi") - F.col("__lo")) / 3, 0).when(place <= (F.col("__hi") - F.col("__lo")) * 2 / 3, 1).otherwise(2)
    # one row of ends
    placed = rows.join(F.broadcast(ends)).withColumn("__third", third).withColumn("__score", score)
    best = placed.withColumn("__nth", F.row_number().over(W.partitionBy("__third").orderBy(F.desc("__score"), page, number))).where(F.col("__nth") <= max(1, most // 3))
    first = placed.orderBy(page, number).limit(most).withColumn("__nth", F.lit(most + 1))
    every = best.withColumn("__late", F.lit(0)).unionByName(first.withColumn("__late", F.lit(1)))
    # at most 2 x most rows
    once = every.groupBy(*rows.columns).agg(F.min("__late").alias("__late"))
    return once.orderBy("__late", page, number).limit(most).drop("__late")


def leaked_ids(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Keys that both sides of a split hold."""
    return train.select(key).distinct().join(held.select(key), key, "left_semi")


def replay_faults(first: DataFrame, second: DataFrame, run: str, order: str, key: str) -> DataFrame:
    """(run, place, before, after): where the second replay of a run gives another key than the first, or one more or less."""
    nth = lambda df, name: df.select(run, F.row_number().over(W.partitionBy(run).orderBy(order, key)).cast("long").alias("place"), F.col(key).alias(name))
    return nth(first, "before").join(nth(second, "after"), [run, "place"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


#: Wording of items that ask for an answer in words or for the right one of several.
ASKED_IN_WORDS = r"서술형|다음에\s*답하시오|구하시오|계산하시오|전개하시오|푸시오|증명|보기\s*ㄱ|ㄱ\.\s|ㄴ\.\s|ㄷ\."
ASKED_TO_CHOOSE = r"다음\s*중|옳은\s*것|옳지\s*않은"


def choices_complete(text: Column, choices: Column) -> Column:
    """Whether an item has the choices that it needs: five, or none of them missed because its answer is worded or none is offered."""
    return F.when(choices >= 5, True).when(text.rlike(ASKED_IN_WORDS) | (choices == 0), True).when(text.rlike(ASKED_TO_CHOOSE), False).otherwise(False)


def rate_judgements(rows: DataFrame, group: str, given: Column, truth: Column, sure: Column) -> DataFrame:
    """Per group: judgements CORRECT, WRONG, AMBIGUOUS (no truth) and MISSING (nothing given), those wrong although sure, and the share of the judged that are right."""
    judged = tags(CORRECT=given == truth, WRONG=given != truth, AMBIGUOUS=truth.isNull(), MISSING=truth.isNotNull() & given.isNull())[0]
    out = rows.select(group, judged.alias("__j"), F.coalesce(sure, F.lit(False)).alias("__s")).groupBy(group).agg(*[F.count_if(F.col("__j") == n).alias(n.lower()) for n in ("CORRECT", "WRONG", "AMBIGUOUS", "MISSING")], F.count_if((F.col("__j") == "WRONG") & F.col("__s")).alias("sure_wrong"))
    return out.withColumn("right", F.when(F.col("correct") + F.col("wrong") > 0, F.round(F.col("correct") / (F.col("correct") + F.col("wrong")), 6)))


def transitions(asked: DataFrame, versions: DataFrame, items: DataFrame) -> DataFrame:
    """What requests (item, version, kind, note, gate) do: (item, version, kind, error, version_status, current_version, item_status, lifecycle), the states as they are afterwards.

    versions: item, version, review_status; items: item, current_version, review_status, lifecycle. SUBMIT, VERIFY and REJECT move a version, and its item too where it is
    current or verified; ARCHIVE and RESTORE move an item. A request with an error, or of another kind (UNKNOWN_KIND), changes nothing. Each is judged on the tables given.
    """
    v = versions.select("item", "version", F.col("review_status").alias("__v"), F.lit(True).alias("__there"))
    i = items.select("item", F.col("current_version").alias("__cur"), F.col("review_status").alias("__i"), F.col("lifecycle").alias("__life"))
    met = asked.join(v, ["item", "version"], "left").join(i, "item", "left")
    kind, c = F.col("kind"), F.col
    archived = F.col("__life").eqNullSafe("ARCHIVED")
    of_version = kind.isin("SUBMIT", "VERIFY", "REJECT")
    error = (
        F.when(~F.coalesce(of_version | kind.isin("ARCHIVE", "RESTORE"), F.lit(False)), "UNKNOWN_KIND")
        .when((kind == "REJECT") & (F.trim(F.coalesce("note", F.lit(""))) == ""), "MISSING_NOTE")
        .when(of_version & c("__there").isNull(), "MISSING_VERSION")
        .when((kind == "SUBMIT") & (c("__v") == "VERIFIED"), "VERIFIED_LOCKED")
        .when((kind == "VERIFY") & ~F.coalesce("gate", F.lit(False)), "GATE")
        .when((kind == "ARCHIVE") & (archived | c("__life").isNull()), "MISSING_ITEM")
        .when((kind == "RESTORE") & ~archived, "MISSING_ITEM")
    )
    judged = met.withColumn("error", error)
    done = lambda *kinds: c("error").isNull() & kind.isin(*kinds)
    status = F.when(done("SUBMIT"), "NEEDS_REVIEW").when(done("VERIFY"), "VERIFIED").when(done("REJECT"), "REJECTED")
    follows = done("VERIFY") | (done("SUBMIT", "REJECT") & (c("__cur") == c("version")))
    life = F.when(done("VERIFY"), "ACTIVE").when(done("ARCHIVE"), "ARCHIVED").when(done("RESTORE"), "DRAFT")
    return judged.select(
        "item", "version", "kind", "error", F.coalesce(status, "__v").alias("version_status"), F.when(done("VERIFY"), c("version")).otherwise(c("__cur")).alias("current_version"),
        F.when(follows, status).otherwise(c("__i")).alias("item_status"), F.coalesce(life, "__life").alias("lifecycle"),
    )

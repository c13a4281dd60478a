"""Conversation structure repair: the cheapest edits that give legal roles, by weighted finite-state composition.

Three machines are composed lazily, state by state as they are reached. The input acceptor is the conversation: one symbol a row, for
its role and its fault. The edit transducer keeps, re-roles, deletes or inserts rows at a price. The grammar acceptor takes role
initials (s?(ua)+)?. Weights are pairs (cost, label string), added by concatenation and compared in that order.

On these weights the best of two paths stays the best whatever follows: of two label strings with the same cost that consume the same rows
and end with one, neither is a prefix of the other, as what would be left are insertions and they cost. So the composition of a part of a conversation is a small matrix, from grammar state
to grammar state, and matrices of parts multiply: a conversation of any length is worked on in parts of a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, stored

#: Prices: another role, a deletion, an insertion, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a part.
PART = 4096

#: The grammar's states: nothing yet, after a system row, after a user row, after an assistant row. The first and the last are final.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_ARCS = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
_FINAL = (START, AFTER_A)

Weight = tuple[int, str, str]  # cost, labels, roles that the labels write ("-" for a deletion)


def _better(table: dict[int, Weight], state: int, weight: Weight) -> None:
    if state not in table or weight < table[state]:
        table[state] = weight


def _insertions(state: int) -> dict[int, Weight]:
    """States reached by insertions alone; going round again would only cost more."""
    found, at = {state: (0, "", "")}, state
    while True:
        role, to = next((r, s) for r, s in _ARCS[at].items() if r != "s")
        if to in found:
            return found
        cost, labels, roles = found[at]
        found[to] = (cost + INSERT, labels + "I", roles + role)
        at = to


@lru_cache(None)
def _arcs(symbol: str, state: int) -> tuple[tuple[int, Weight], ...]:
    """The composed machine's arcs from one state over one row: insertions, then an edit of the row.

    symbol: a role initial in small letters (o: another), in capitals if the row is truncated; "-" if it must go.
    """
    found: dict[int, Weight] = {}
    left = TRUNCATED if symbol.isupper() else 0
    for at, (cost, labels, roles) in _insertions(state).items():
        _better(found, at, (cost + DELETE, labels + "D", roles + "-"))
        if symbol != "-":
            for role, to in _ARCS[at].items():
                if role == symbol.lower():
                    _better(found, to, (cost + left, labels + "K", roles + role))
                if role != "s":
                    _better(found, to, (cost + left + REROLE, labels + "R", roles + role))
    return tuple(found.items())


@lru_cache(20_000)
def transfers(symbols: str) -> tuple[tuple[int, int, int, str, str], ...]:
    """A part's matrix: (from, to, cost, labels, roles) of the best path between each two grammar states.

    Topological: one step a row. Strings are kept as the arc before them and compared by rank, so a step's work does not grow with them.
    """
    out = []
    for origin in range(4):
        layer: dict[int, tuple[int, int]] = {origin: (0, 0)}  # state: cost, rank of its labels
        back: list[dict[int, tuple[int, str, str]]] = []
        for symbol in symbols:
            best: dict[int, tuple[int, int, str, int, str]] = {}
            for state, (cost, rank) in layer.items():
                for to, (more, labels, roles) in _arcs(symbol, state):
                    new = (cost + more, rank, labels, state, roles)
                    if to not in best or new < best[to]:
                        best[to] = new
            ranks = {x: i for i, x in enumerate(sorted({(w[1], w[2]) for w in best.values()}))}
            layer = {to: (w[0], ranks[w[1], w[2]]) for to, w in best.items()}
            back.append({to: (w[3], w[2], w[4]) for to, w in best.items()})
        for end, (cost, _) in layer.items():
            at, labels, roles = end, [], []
            for step in reversed(back):
                at, own, said = step[at]
                labels.append(own)
                roles.append(said)
            out.append((origin, end, cost, "".join(reversed(labels)), "".join(reversed(roles))))
    return tuple(out)


def shortest(parts: list[tuple[tuple[int, int, int, str, str], ...]]) -> tuple[int, list[str], list[str], str, str]:
    """Cost, labels and roles of each part, and labels and roles behind the last row, on the cheapest path; equal costs: the least labels."""
    layer: dict[int, tuple[int, int]] = {START: (0, 0)}
    back = []
    for matrix in parts:
        best: dict[int, tuple[int, int, str, int, str]] = {}
        for state, to, more, labels, roles in matrix:
            if state in layer:
                new = (layer[state][0] + more, layer[state][1], labels, state, roles)
                if to not in best or new < best[to]:
                    best[to] = new
        ranks = {x: i for i, x in enumerate(sorted({(w[1], w[2]) for w in best.values()}))}
        layer = {to: (w[0], ranks[w[1], w[2]]) for to, w in best.items()}
        back.append({to: (w[3], w[2], w[4]) for to, w in best.items()})
    ends = []
    for state, (cost, rank) in layer.items():
        for to, (more, labels, roles) in _insertions(state).items():
            if to in _FINAL:
                ends.append((cost + more, rank, labels, state, roles))
    cost, _, last, at, said = min(ends)
    labels, roles = [], []
    for step in reversed(back):
        at, own, wrote = step[at]
        labels.append(own)
        roles.append(wrote)
    return cost, labels[::-1], roles[::-1], last, said


def _moves(labels: str, roles: str) -> str:
    """Each label with the role it writes, in pairs of characters."""
    return "".join(map(str.__add__, labels, roles))


_MATRIX = "array<struct<f: int, t: int, cost: long, labels: string, roles: string>>"
_PATH = "struct<cost: long, audit: string, moves: array<string>>"


def _transfers(symbols: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("labels", pa.string()), ("roles", pa.string())]))
    for batch in symbols:
        yield pa.array([[dict(zip(("f", "t", "cost", "labels", "roles"), w)) for w in transfers(s)] for s in batch.to_pylist()], kind)


def _shortest(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("moves", pa.list_(pa.string()))])
    for batch in parts:
        rows = []
        for x in batch.to_pylist():
            cost, labels, roles, last, last_roles = shortest([tuple((w["f"], w["t"], w["cost"], w["labels"], w["roles"]) for w in m) for m in x])
            moves = [*map(_moves, labels, roles)]
            rows.append({"cost": cost, "audit": "".join(labels) + last, "moves": [*moves[:-1], moves[-1] + _moves(last, last_roles)]})
        yield pa.array(rows, kind)


def _initial(role: Column) -> Column:
    return F.when(role.substr(1, 1).isin("s", "u", "a"), role.substr(1, 1)).otherwise("o")


def symbol_of(role: Column, fault: Column) -> Column:
    """A row's symbol: see _arcs()."""
    initial = _initial(role)
    return F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(initial)).otherwise(initial)


def faulty_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn as a row of (conv, turn, role, text, pos, fault), stored; pos numbers all rows in the order of conversation and turn.

    fault is a row's first of: blank (nothing but ASCII white space), duplicate (role and text stand earlier in the conversation), truncated (the last character that is
    not white space is none of ".!?"); else null. Rows are sorted by ranges of (conversation, turn, role, text), so that a
    conversation of any size spreads over tasks; duplicates are told by digests, each of which sends one row per task.
    """
    spark = turns.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    each = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    # rows that are equal in all columns are told apart, so that they too are dealt to several ranges
    each = each.withColumn("digest", F.sha2("text", 256)).withColumn("nth", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "digest", "nth"]
    ranked = each.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranked = stored(ranked.withColumn("pos", F.monotonically_increasing_id()).drop("nth"), "turns")
    said = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    first = ranked.where(said).groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    told = ranked.join(first, "pos", "left")
    fault = F.when(~said, "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return stored(told.withColumn("fault", fault).drop("digest", "first"), "faults")


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of conversations whose rows are in order of turn, nulls first, then role.

    report: a row per conversation with conv_col, gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated (rows by
    their first fault), illegal (neighbouring rows whose role initials are none of su, ua, au), cost and audit: the cheapest edits' initials (Keep, Rerole, Delete,
    Insert), of several the string that is least. repaired: a row per turn that is left or put in, with conv_col, pos and place (its
    order), edit, role and text. Its roles' initials are (s?(ua)+)?.

    Null roles and texts count as one space, null turns come first and no gap, rows with the same turn and role are in the order of their digests, repeated rows are
    duplicates, rows with a null conversation are one conversation, other columns are not read, and an empty table gives no rows. No text is gathered: a
    conversation meets in one task as its audit only, some bytes a row, made of parts of PART rows.
    """
    bounded_batches(turns.sparkSession)
    rows = faulty_turns(turns, conv_col, turn_col, role_col, text_col)
    one = F.struct("pos", symbol_of(F.col("role"), F.col("fault")).alias("symbol"), _initial(F.col("role")).alias("initial"))
    counts = ("blank", "duplicate", "truncated")
    parts = rows.groupBy("conv", F.floor(F.col("pos") / PART).alias("part")).agg(F.sort_array(F.collect_list(one)).alias("rows"), *(F.count_if(F.col("fault") == f).alias(f) for f in counts))
    joined = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "")
    parts = stored(parts.select("conv", *counts, F.transform("rows", lambda r: r["pos"]).alias("at"), joined("initial").alias("initials"), F.arrow_udf(_transfers, _MATRIX)(joined("symbol")).alias("matrix")), "parts")
    # the number of its first row names a part
    whole = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(F.get("at", F.lit(0)).alias("head"), "initials", "matrix"))).alias("ps"), *(F.sum(c).alias(c) for c in counts))
    said = F.array_join(F.transform("ps", lambda p: p["initials"]), "")
    # legal pairs are looked for ahead, as they overlap
    illegal = F.length(said) - 1 - F.regexp_count(said, F.lit("(?=su|ua|au)"))
    whole = stored(whole.select("conv", *counts, illegal.cast("long").alias("illegal"), F.transform("ps", lambda p: p["head"]).alias("heads"), F.arrow_udf(_shortest, _PATH)(F.transform("ps", lambda p: p["matrix"])).alias("path")), "paths")
    gaps = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")).withColumnRenamed("conv", "own")
    report = whole.join(gaps, F.col("conv").eqNullSafe(F.col("own"))).select(F.col("conv").alias(conv_col), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *counts, "illegal", "path.cost", "path.audit")
    # the path's moves go back to the rows they belong to: what is put in around a row, and what becomes of it
    moves = whole.select(F.explode(F.arrays_zip(F.col("heads").alias("head"), F.col("path.moves").alias("moves"))).alias("m")).select("m.head", F.regexp_extract_all("m.moves", F.lit(r"((?:I.)*[KRD].(?:(?:I.)+\z)?)"), F.lit(1)).alias("moves"))
    placed = parts.select(F.get("at", F.lit(0)).alias("head"), "at").join(moves, "head").select(F.explode(F.arrays_zip(F.col("at").alias("pos"), F.col("moves").alias("move"))).alias("m")).select("m.pos", F.regexp_extract_all("m.move", F.lit("(..)"), F.lit(1)).alias("moves"))
    edited = rows.join(placed, "pos").select("conv", "pos", F.col("role").alias("had"), "text", F.posexplode("moves").alias("place", "move")).where("left(move, 1) <> 'D'")
    edit, full = F.col("move").substr(1, 1), F.when(F.col("move").substr(2, 1) == "u", "user").otherwise("assistant")
    repaired = edited.select(F.col("conv").alias(conv_col), "pos", "place", edit.alias("edit"), F.when(edit == "K", F.col("had")).otherwise(full).alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))
    return report, repaired

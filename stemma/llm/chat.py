"""Chat formatting with Spark expressions only: turns of a conversation to one training text and its loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template. Texts never hold one once escaped, as each begins with "<|".
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""One more backslash between "<" and "|", however many stand there: no "<|" is left, and nothing else changes."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role_out(role: Column) -> Column:
    """A role on one line: every backslash of the output is followed by b (a backslash) or n (a line end)."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    r"""One row per conversation: conv_col, formatted, loss_mask.

    Turns are collected as structs and sorted; neighbours of the same role are merged into one block
    `<|im_start|>role\ntext<|im_sep|>text<|im_end|>\n`, and all is joined. loss_mask has a struct per turn, in order: skip
    (code points before its text that are not learned), take (code points under the mask: the escaped text of
    loss_role, else none), rest (code points after). Their sum is the length of formatted.

    Null roles and texts are empty; null turns come first; turns with the same number stand in the order of role, then text,
    and repeated rows are repeated turns; rows with a null conversation are one conversation; other columns are not
    read; an empty table gives no rows. The work is linear in a conversation's turns. A conversation is one row of the
    result, so its turns meet in one task; no other key does.
    """
    each = turns.select(F.col(conv_col).alias("c"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    arrays = each.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def piece(x, i):
        same_before = (i > 0) & (F.get("ts", i - 1)["role"] == x["role"])
        same_after = (i < F.size("ts") - 1) & (F.get("ts", i + 1)["role"] == x["role"])
        head = F.when(F.coalesce(same_before, F.lit(False)), F.lit(SEP)).otherwise(F.concat(F.lit(START), _role_out(x["role"]), F.lit("\n")))
        tail = F.when(F.coalesce(same_after, F.lit(False)), F.lit("")).otherwise(F.lit(END + "\n"))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), tail.alias("tail"), (x["role"] == loss_role).alias("loss"))

    pieces = arrays.select("c", F.transform("ts", piece).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    mask = F.transform("ps", lambda p: F.struct((F.length(p["head"]) + F.when(p["loss"], 0).otherwise(F.length(p["body"]))).alias("skip"), F.when(p["loss"], F.length(p["body"])).otherwise(0).alias("take"), F.length(p["tail"]).alias("rest")))
    return pieces.select(F.col("c").alias(conv_col), text.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame, conv_col: str = "conv_id", text_col: str = "formatted", mask_col: str = "loss_mask") -> DataFrame:
    """From formatted texts alone: conv_col, turns (array of role, text), and learned (array: each text under the mask, unescaped)."""
    # every turn begins with a control string, and no text holds one
    blocks = F.filter(F.split(text_col, r"(?=<\|im_start\|>)"), lambda b: b != "")
    parts = F.filter(F.split(text_col, r"(?=<\|im_start\|>|<\|im_sep\|>)"), lambda p: p != "")

    def turns_of(b):
        line = F.locate("\n", b)
        role = _role_in(F.substr(b, F.lit(len(START) + 1), line - len(START) - 1))
        body = F.substr(b, line + 1, F.length(b) - line - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    learned = F.transform(F.filter(F.arrays_zip(parts.alias("p"), F.col(mask_col).alias("m")), lambda z: z["m"]["take"] > 0), lambda z: unescape(F.substr(z["p"], z["m"]["skip"] + 1, z["m"]["take"])))
    return formatted.select(F.col(conv_col), F.flatten(F.transform(blocks, turns_of)).alias("turns"), learned.alias("learned"))

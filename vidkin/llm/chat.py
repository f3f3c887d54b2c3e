"""Relational chat formatting: collected turn structs are sorted, adjacent turns of one role are merged
into one block struct by array operations and all is concatenated with Spark expressions only.

Template: <|im_start|>role NEWLINE text <|im_sep|> text ... <|im_end|> NEWLINE. In texts and roles a
backslash is doubled and "<|" becomes "<\\|", so no control string can arise inside them; a newline in
a role becomes <|nl|>. Both are undone when reading back.

Defined results: null role or text is empty; a null turn sorts first; ties and repeated rows of one
turn are all kept, ordered by role and text; an empty table gives an empty result; other columns are
ignored. A conversation is one output string, so its turns must meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, let, piece, running

START, END, SEP, NL = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (code points of the texts under the loss mask, end exclusive)."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(NL)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    n = F.size("turns")
    # Blocks of one role: where they begin, and the texts from there to the next one.
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get("turns", i - 1)["role"].eqNullSafe(F.get("turns", i)["role"]))
    by = by.select("conv_id", "turns", begins.alias("begins"))
    ends = F.concat(F.slice("begins", F.lit(2), n), F.array(n))
    block = lambda i, j: F.struct(F.get("turns", i)["role"].alias("role"), F.transform(F.slice("turns", i + 1, j - i), lambda t: t["text"]).alias("texts"))
    merged = by.select("conv_id", F.zip_with("begins", ends, block).alias("blocks"))

    def parts(b: Column) -> Column:
        """Each text with what stands before and after it in the block."""
        last = F.size(b["texts"]) - 1
        head = F.concat(F.lit(START), b["role"], F.lit("\n"))
        return F.transform(
            b["texts"],
            lambda t, i: F.struct(F.when(i == 0, head).otherwise(SEP).alias("head"), escape(t).alias("body"), F.when(i == last, END + "\n").otherwise("").alias("tail"), (b["role"] == loss_role).alias("loss")),
        )

    pieces = merged.select("conv_id", F.flatten(F.transform("blocks", parts)).alias("pieces"))
    before = running(F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])))
    pieces = pieces.select("conv_id", "pieces", before.alias("before"))
    start = lambda x: x["before"] + F.length(x["pieces"]["head"])
    under = F.filter(F.arrays_zip("pieces", "before"), lambda x: x["pieces"]["loss"])
    spans = F.transform(under, lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["pieces"]["body"])).alias("end")))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return pieces.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role,text>> parsed from the formatted string alone, and loss, the
    texts that loss_spans cut from it."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        at = F.instr(b, "\n")
        role = unescape(F.replace(b.substr(F.lit(1), at - 1), F.lit(NL), F.lit("\n")))
        body = b.substr(at + 1, F.length(b) - at - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = let(chunks(F.col("formatted")), lambda cut: F.transform("loss_spans", lambda s: unescape(piece(cut, s["start"], s["end"]))))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss"))

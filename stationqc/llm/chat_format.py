"""Chat formatting in budgeted windows.

Turns are laid on a line by the prefix sums of their tokens.  The line is cut into equal lengths; turns that lie within a
length form one span and a turn across a cut forms its own, so spans are turn-aligned and no step depends on the one
before it.  Each window is the system turn, a limited repeat of the turns before the span, and the span.  Only assistant
turns of the span itself are under the loss mask: every assistant text is a target once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside a text get one backslash after their first
character, and so does any that already has backslashes there, which makes the escape reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of a control string: <|...|>, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
_REST = r"(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPE, ESCAPED = rf"([<\[])(\\*){_REST}", r"$1\\$2$3"
UNESCAPE, UNESCAPED = rf"([<\[])\\(\\*){_REST}", "$1$2$3"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, ESCAPED)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, UNESCAPED)


def _role_out(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_in(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def windows(turns: DataFrame, budget: int = 2048, context: int = 512, history: int = 2, per_turn: int = 4) -> DataFrame:
    """conv_id, window, n_context, formatted, loss (array of start and length in code points), n_tokens.

    ``turns`` has conv_id, turn, role and text; other columns are ignored.  A turn's tokens are its words and ``per_turn``
    for the template.  A span takes up to ``budget - context`` tokens, unless one turn alone is longer.  The context is
    the system turn (the first, if its role is ``system``), always whole, and up to ``history`` turns before the span as
    far as they fit into ``context`` beside it.  The first ``n_context`` turns of a window are repeats.

    Null text and role count as empty; turns with a null number come last; a null conversation id is a conversation.
    Turns with equal numbers are all kept, ordered by role, then text; repeated rows too.  No rows give no windows.
    """
    room = budget - context
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + per_turn)
    placed = rows.select(
        "conv_id", "role", "text", "tokens",
        F.row_number().over(order).cast("long").alias("pos"),
        F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        F.first(F.when(F.col("role") == "system", F.col("tokens")).otherwise(F.lit(0).cast("long"))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("system"),
    )
    start = F.greatest(F.lit(0).cast("long"), F.col("end") - F.col("tokens") - F.col("system"))
    cut, last = F.floor(start / room), F.floor((start + F.col("tokens") - 1) / room)
    leads = (F.col("pos") == 1) & (F.col("system") > 0)
    placed = placed.withColumn("span", F.when(leads, F.lit(0).cast("long")).otherwise(2 * cut + (cut != last).cast("long"))).withColumn("start", start)

    first = placed.groupBy("conv_id", "span").agg(F.min("pos").alias("first_pos"), F.min("start").alias("first_start"), F.max("system").alias("system"))
    wanted = F.array_distinct(F.concat(F.array(F.when(F.col("system") > 0, F.lit(1).cast("long"))), F.transform(F.sequence(F.lit(1), F.lit(history)), lambda i: F.col("first_pos") - i)))
    wanted = F.filter(wanted, lambda p: (p >= 1) & (p < F.col("first_pos")))
    asked = first.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "first_start", "system", F.explode(wanted).alias("p")).drop("wanted")
    again = asked.join(placed.drop("span", "system"), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("pos")))
    fits = ((F.col("pos") == 1) & (F.col("system") > 0)) | (F.col("first_start") - F.col("start") <= context - F.col("system"))
    again = again.where(fits).select("conv_id", F.col("s").alias("span"), "pos", "role", "text", "tokens", F.lit(True).alias("repeat"))
    members = placed.select("conv_id", "span", "pos", "role", "text", "tokens", F.lit(False).alias("repeat")).unionByName(again)

    body = F.concat(F.lit(OPEN), _role_out(F.col("role")), F.lit("\n"))
    shown = members.select(
        "conv_id", "span", "tokens",
        F.struct("pos", "repeat", F.length(body).alias("head"), F.concat(body, escape(F.col("text")), F.lit(CLOSE)).alias("shown"), (~F.col("repeat") & (F.col("role") == "assistant")).alias("target")).alias("t"),
    )
    packed = shown.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.sum("tokens").alias("n_tokens"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def walk(a: Column, t: Column) -> Column:
        size = F.length(t["shown"])
        mask = F.struct((a["at"] + t["head"]).alias("start"), (size - t["head"] - len(CLOSE)).alias("length"))
        return F.struct((a["at"] + size).alias("at"), F.when(t["target"], F.concat(a["loss"], F.array(mask))).otherwise(a["loss"]).alias("loss"))

    return packed.select(
        "conv_id",
        F.col("span").alias("window"),
        F.size(F.filter("ts", lambda t: t["repeat"])).alias("n_context"),
        F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("formatted"),
        F.aggregate("ts", zero, walk, lambda a: a["loss"]).alias("loss"),
        "n_tokens",
    )


def read_back(out: DataFrame) -> DataFrame:
    """Per window of :func:`windows`: the turns of its span as role and text, and the text under its loss mask, unescaped."""
    parts = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.col("n_context") + 1, F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1 - F.col("n_context"))
    turn = lambda p: F.struct(
        _role_in(F.regexp_extract(p, r"^<\|im_start\|>([^\n]*)\n", 1)).alias("role"), unescape(F.regexp_replace(p, r"^<\|im_start\|>[^\n]*\n", "")).alias("text")
    )
    return out.select(
        "conv_id", "window", F.length("formatted").alias("formatted_chars"), F.transform(parts, turn).alias("turns"),
        F.array_join(F.transform("loss", lambda m: unescape(F.substring("formatted", m["start"] + 1, m["length"]))), "").alias("loss_text"),
    )


def digests(out: DataFrame) -> DataFrame:
    """Per conversation, from :func:`read_back`: the counts and digests of the contract.  A digest needs its conversation in one row."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read_back(out).select("conv_id", "formatted_chars", F.size("turns").alias("n"), F.struct("window", said.alias("said"), F.col("loss_text").alias("loss")).alias("w"))
    whole = each.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("formatted_chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    return whole.select(
        "conv_id", "n_turns",
        F.sha2(F.array_join(F.transform("ws", lambda w: w["said"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

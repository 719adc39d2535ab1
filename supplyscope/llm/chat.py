r"""Chat formatting with budgeted windows, in DataFrame functions only.

A turn is written as `<|turn|>role<|text|>text<|end|>`. In roles and texts a backslash is doubled and
`<|` becomes `<\|`, so that no control string can come from inside; `unescape` takes both back.

Windows hold whole turns. Prefix sums of turn tokens tell for each turn how many turns before it fit
the history budget; one fold over the sums opens a new window whenever the next turn would go over
the budget. A window begins with the leading system turn and the limited history (its context), then
come its new turns. History gives way to the first new turn: as many of its latest turns are repeated as leave the window within the
budget. The loss mask covers the texts of new assistant turns, so each is a target once.
A turn that does not fit beside the system turn gets a window with that turn only, over the budget, and is never cut. A turn's
tokens are counted as its words and `OVERHEAD`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, OVERHEAD = 1024, 256, 4
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def chat_windows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history: int = HISTORY,
) -> DataFrame:
    """(conv, window, text, n_context, loss): loss holds (start, chars) in `text`, start from 1.

    Null roles and texts are empty, null turns come first, equal turn numbers are ordered by role and
    text, rows without conversation form one conversation. `n_context` turns at the window's start
    are repeated. A conversation is one record: its turns meet in one task.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    tokens = F.size(F.split(F.trim("text"), r"\s+")).cast("long") + OVERHEAD
    in_order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("tokens", tokens).withColumn("i", F.row_number().over(in_order) - 1)
    by_place = Window.partitionBy("conv").orderBy("i")
    rows = rows.withColumn("begin", F.sum("tokens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    back = Window.partitionBy("conv").orderBy("begin").rangeBetween(-history, 0)
    rows = rows.withColumn("since", F.min("i").over(back))
    piece = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END))
    rows = rows.withColumns({"piece": piece, "size": F.length(escape(F.col("text")))})
    kept = F.struct("i", "role", "piece", "size", "tokens", "begin", "since")
    conv = rows.groupBy("conv").agg(F.sort_array(F.collect_list(kept)).alias("t"))
    system = F.when(F.col("t")[0]["role"] == "system", F.lit(1)).otherwise(F.lit(0))
    conv = conv.withColumn("system", system).withColumn("system_tokens", F.col("system") * F.col("t")[0]["tokens"])

    def earliest(x: Column) -> Column:
        """First turn of the history that a window with the new turn `x` can hold."""
        room = F.greatest(F.lit(0).cast("long"), F.least(F.lit(history).cast("long"), F.lit(budget) - F.col("system_tokens") - x["tokens"]))
        low = F.greatest(x["since"], F.col("system"))
        before = F.slice("t", low + 1, F.greatest(x["i"] - low, F.lit(0)))
        return x["i"] - F.size(F.filter(before, lambda y: y["begin"] >= x["begin"] - room))

    # (starts of windows, tokens in the last one); context of a window that starts at turn x
    context = lambda x: F.col("system_tokens") + x["begin"] - F.get("t", earliest(x))["begin"]
    first = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("used"))
    fold = lambda acc, x: F.when(
        (acc["used"] + x["tokens"] <= budget) | (x["i"] <= F.col("system")), F.struct(acc["starts"].alias("starts"), (acc["used"] + x["tokens"]).alias("used"))
    ).otherwise(F.struct(F.concat(acc["starts"], F.array(x["i"])).alias("starts"), (context(x) + x["tokens"]).alias("used")))
    conv = conv.withColumn("starts", F.aggregate("t", first, fold, lambda acc: acc["starts"]))
    each = conv.select("conv", "t", "system", "system_tokens", "starts", F.posexplode("starts").alias("window", "s"))
    stop = F.coalesce(F.get("starts", F.col("window") + 1), F.size("t"))
    since = F.when(F.col("s") == 0, F.lit(0)).otherwise(earliest(F.get("t", F.col("s"))))
    each = each.withColumns({"stop": stop, "since": since})
    lead = F.when(F.col("s") > 0, F.slice("t", F.lit(1), F.col("system"))).otherwise(F.slice("t", F.lit(1), F.lit(0)))
    shown = F.concat(lead, F.slice("t", F.col("since") + 1, F.col("stop") - F.col("since")))
    each = each.select("conv", "window", "s", shown.alias("shown"), (F.size(lead) + F.col("s") - F.col("since")).alias("n_context"))
    nothing = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("loss"))

    def mark(acc: Column, x: Column) -> Column:
        span = F.struct((acc["at"] + F.length(x["piece"]) - len(END) - x["size"]).alias("start"), x["size"].alias("chars"))
        target = (x["role"] == "assistant") & (x["i"] >= F.col("s"))
        loss = F.when(target, F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"])
        return F.struct((acc["at"] + F.length(x["piece"])).alias("at"), loss.alias("loss"))

    text = F.array_join(F.transform("shown", lambda x: x["piece"]), "")
    loss = F.aggregate("shown", nothing, mark, lambda acc: acc["loss"])
    return each.select(F.col("conv").alias(conv_col), "window", text.alias("text"), "n_context", loss.alias("loss"))


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, turns, loss, formatted_chars): turns and target texts parsed from the formatted windows."""
    pieces = F.split("text", r"<\|end\|>", -1)
    new = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))

    def turn(piece: Column) -> Column:
        halves = F.split(F.substr(piece, F.lit(len(TURN) + 1)), r"<\|text\|>", -1)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    targets = F.transform("loss", lambda x: unescape(F.substr("text", x["start"], x["chars"])))
    parts = windows.select(conv_col, "window", F.transform(new, turn).alias("turns"), targets.alias("loss"), F.length("text").cast("long").alias("chars"))
    ordered = F.sort_array(F.collect_list(F.struct("window", "turns", "loss")))
    flat = lambda name: F.flatten(F.transform("all", lambda x: x[name])).alias(name)
    grouped = parts.groupBy(conv_col).agg(ordered.alias("all"), F.sum("chars").alias("formatted_chars"))
    return grouped.select(conv_col, flat("turns"), flat("loss"), "formatted_chars")


def op5_chat(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    back = read_back(chat_windows(turns.union(extra)))
    spelled = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )

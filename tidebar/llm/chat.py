"""Chat formatting of logged conversations after cumulative-snapshot collapse.

A service that logs after every turn leaves a conversation many times, each log a prefix of the next. A rolling hash over
the turns names every prefix: the running exclusive or of hashes of (place, role, text), a row a turn, so that no log is
gathered for it. A log whose last hash is a proper prefix of another log is dropped by an anti-join, of equal logs the
least id stays, and only the turns of what is left are gathered and rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import cut, small

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PREFIX = ("k", "h1", "h2")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k, h1, h2, n: the hash (128 bits) of the first k of n turns. turns: conv_id, turn, role, text."""
    log = Window.partitionBy("conv_id")
    order = log.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("conv_id", "turn", "role", "text", F.sha2(F.concat_ws("\x1f", F.char_length("role").cast("string"), "role", "text"), 256).alias("sha"))
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(log))
    rolling = [F.bit_xor(F.xxhash64(F.lit(seed), "k", "sha")).over(so_far).alias(f"h{seed}") for seed in (1, 2)]
    return rows.select("conv_id", "k", *rolling, "n")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, text of the maximal conversations.

    conversations: conv_id, turn, role, text (extra columns are ignored). Turns go by turn (null first), role, text; a
    null role or text is empty; repeated rows are turns of their own; rows without conv_id are one conversation; an empty
    table gives no rows. A conversation that stays must fit a row, as its text does."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.select("conv_id", "turn", empty("role"), empty("text"))
    marks = cut(prefixes(turns), "prefixes")
    full = marks.where("k = n").join(marks.where("k < n").select(*PREFIX).distinct(), list(PREFIX), "left_anti")
    least = full.groupBy(*PREFIX).agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("least"))
    kept = cut(least.select(F.col("least.conv_id").alias("kept_id")), "kept")
    logs = turns.join(small(kept, kept.count()), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    logs = logs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return logs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), rendered(F.col("turns")).alias("text"))

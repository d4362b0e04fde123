"""Predicted against real tool calls of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_index(messages: DataFrame, keys: list[str], order: str, role: str = "role") -> DataFrame:
    """messages with `turn_no`: how many user messages stand up to and with this one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn_no", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w))


def flushed_calls(messages: DataFrame, keys: list[str], order: str, role: str = "role") -> DataFrame:
    """The call rows that count: a turn's calls are taken when the next user message comes, so those before the first and
    after the last user message are dropped."""
    m = turn_index(messages, keys, order, role)
    last = F.max("turn_no").over(Window.partitionBy(*keys))
    return m.withColumn("turns", last).where((F.col("turn_no") >= 1) & (F.col("turn_no") < F.col("turns")) & (F.col(role) == "tool"))


def calls_between_users(messages: DataFrame, keys: list[str], order: str, role: str = "role") -> DataFrame:
    m = turn_index(messages, keys, order, role)
    return m.groupBy(*keys, "turn_no").agg(F.sum(F.when(F.col(role) == "tool", 1).otherwise(0)).alias("n_calls"))


def hit_rate(real: DataFrame, predicted: DataFrame, tasks: DataFrame, once: bool = False) -> DataFrame:
    """(task, hits, calls, rate): guesses of turn t against calls of turn t + 1, equal in name and arguments. Pairs multiply,
    so the rate may exceed 1; once: each real call counts once, after equal calls were joined. Without calls: (hits + 1) / 1."""
    key = ["task", "turn", "name", "args"]
    p = predicted.select("task", (F.col("turn") + 1).alias("turn"), "name", "args")
    r = real.select(*key)
    calls = r.groupBy("task").agg(F.count(F.lit(1)).alias("calls"))
    if once:
        got = r.distinct().join(p.distinct(), key, "left_semi")
        calls = r.distinct().groupBy("task").agg(F.count(F.lit(1)).alias("calls"))
    else:
        a, b = (x.groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((r, "a"), (p, "b")))
        got = a.join(b, key).withColumn("n", F.col("a") * F.col("b"))
    hits = got.groupBy("task").agg((F.count(F.lit(1)) if once else F.sum("n")).alias("hits"))
    t = tasks.select("task").distinct().join(calls, "task", "left").join(hits, "task", "left").na.fill(0, ["calls", "hits"])
    return t.select("task", "hits", "calls", F.when(F.col("calls") > 0, F.col("hits") / F.col("calls")).otherwise(F.col("hits") + 1.0).alias("rate"))


def cost_roll_up(turns: DataFrame, task: str, turn: str, costs: list[str]) -> DataFrame:
    """One row: means over tasks of the sums, and of the sums a turn; the ratio is taken per task, then averaged."""
    per = turns.groupBy(task).agg(F.count_distinct(turn).alias("turns"), *[F.sum(c).alias(c) for c in costs])
    return per.agg(*[F.avg(c).alias(f"{c}_per_task") for c in costs], *[F.avg(F.col(c) / F.col("turns")).alias(f"{c}_per_turn") for c in costs])


def message_action(calls: str, content: str):
    """A message's first tool call, else a response."""
    first = F.get(calls, F.lit(0))
    return F.when(F.size(calls) > 0, first).otherwise(F.struct(F.lit("respond").alias("name"), F.col(content).alias("args")))


def transcript(messages: DataFrame, keys: list[str], order: str, role: str, text: str) -> DataFrame:
    """One text a conversation, `Role: text` a line, without system messages. A conversation is one unit of output."""
    line = F.concat(F.initcap(role), F.lit(": "), F.col(text))
    rows = messages.where(F.col(role) != "system").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("a"))
    return rows.select(*keys, F.array_join(F.transform("a", lambda x: x["x"]), "\n").alias("transcript"))

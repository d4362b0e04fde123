"""Speculation replay: what a trajectory costs with and without acting on guesses.

A step whose move is among its guesses is a match. Matches chain: after a hit, the next step was already done by the
speculation and is skipped, so within a run of consecutive matches the odd ones are hits (gaps and islands). All of it
is windows over one run; no row leaves its run's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_step():
    return Window.partitionBy("run_id").orderBy("step")


def matched(guesses: str = "guesses", move: str = "move") -> Column:
    return F.coalesce(F.array_contains(guesses, F.col(move)), F.lit(False))


def confident(guesses: str = "guesses", scores: str = "scores", least: float = 50.0) -> Column:
    """The guesses with a score above `least`; without scores, or of a single guess, all of them."""
    n = F.least(F.size(guesses), F.size(scores))
    usable = F.when(F.size(scores) > n, F.slice(scores, 1, F.greatest(F.size(scores) - 1, F.lit(0)))).otherwise(F.col(scores))
    m = F.least(F.size(guesses), F.size(usable))
    kept = F.transform(F.filter(F.arrays_zip(F.slice(guesses, 1, m).alias("g"), F.slice(usable, 1, m).alias("s")), lambda x: x["s"] > least), lambda x: x["g"])
    return F.when((F.size(guesses) <= 1) | (F.size(scores) == 0) | F.col(scores).isNull(), F.col(guesses)).otherwise(kept)


def states(steps: DataFrame, match: Column | None = None, order=None) -> DataFrame:
    """steps with m (match), hit and skip."""
    order = order or by_step()
    s = steps.withColumn("m", matched() if match is None else match)
    last_miss = F.max(F.when(~F.col("m"), F.col("step"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("hit", F.col("m") & ((F.col("step") - F.coalesce(last_miss, F.lit(-1))) % 2 == 1))
    return s.withColumn("skip", F.coalesce(F.lag("hit").over(order), F.lit(False)))


def replay(steps: DataFrame, targets: list[int], confidence: bool = False) -> DataFrame:
    """Per run and target: times, tokens, hits and ratios over the first `target` steps; all zero for a target under one. The
    next step's time and tokens are taken before the trajectory is cut."""
    runs = steps.select("run_id").distinct()
    s = steps.withColumn("guesses", confident()) if confidence else steps
    s = s.withColumn("k", F.size("guesses").cast("long")).withColumn("t1", F.lead("t").over(by_step())).withColumn("w1", F.lead("w").over(by_step())).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run_id")))
    s = states(s)
    s = s.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).withColumn("cut", F.least("target", "n")).where("step < cut")
    last = F.col("step") == F.col("cut") - 1
    gain = F.col("g") + F.col("t1")
    hit, skip = ~last & F.col("hit"), ~last & F.col("skip")
    miss = ~last & ~F.col("hit") & ~F.col("skip")
    early = gain < F.col("t")
    spec_t = F.when(hit & early, F.col("t")).when(hit, gain).when(miss, F.col("t")).when(last & ~F.col("skip"), F.col("t")).otherwise(0.0)
    both = F.col("gw") + F.col("w1")
    extra = F.when(hit & early, F.col("k") * both).when(hit, (F.col("k") - 1) * F.col("w") + both).when(miss, F.col("k") * F.col("w")).when(last & ~F.col("skip"), F.col("w")).otherwise(0)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    got = s.groupBy("run_id", "target").agg(
        F.max("cut").alias("steps"), F.sum("t").alias("reg_t"), F.sum(spec_t).alias("spec_t"), F.sum("w").alias("reg_w"), F.sum(F.col("w") + extra).alias("spec_w"),
        one(~last & F.col("m")).alias("matches"), one(hit).alias("window_matches"), one(hit | miss).alias("windows"),
        F.max(F.when(F.col("step") == (F.greatest(F.col("cut") - 2, F.lit(0)) if confidence else F.lit(0)), F.col("k"))).alias("num_predictions"))
    pct = lambda a, b: F.when(F.col(a) != 0, F.round((F.col(a) - F.col(b)) / F.col(a) * 100, 4)).otherwise(0.0)
    got = got.select(
        "run_id", "target", "steps", F.round("reg_t", 4).alias("reg_t"), F.round("spec_t", 4).alias("spec_t"), "reg_w", "spec_w", "matches", "window_matches", "windows", "num_predictions",
        pct("reg_t", "spec_t").alias("time_saved"), pct("reg_w", "spec_w").alias("tokens_wasted"), F.round(F.col("matches") / F.col("steps"), 6).alias("accuracy"),
        F.when(F.col("windows") > 0, F.round(F.col("window_matches") / F.col("windows"), 6)).otherwise(0.0).alias("window_accuracy"))
    none = [t for t in targets if t <= 0]
    if not none:
        return got
    zero = [F.lit(0).cast(got.schema[c].dataType).alias(c) for c in got.columns[2:]]
    return got.unionByName(runs.select("run_id", F.explode(F.array(*map(F.lit, none))).alias("target")).select("run_id", "target", *zero))


def carried(steps: DataFrame) -> DataFrame:
    """After a match, a step's time and tokens come from the previous step's speculation at the place of the match."""
    at = F.array_position("guesses", F.col("move"))
    s = steps.withColumn("spec_t", F.get(F.transform("guesses", lambda x, i: F.col("g") + i), (at - 1).cast("int"))).withColumn("m", at > 0)
    was = F.lag("m").over(by_step())
    return s.select("run_id", "step", F.coalesce(was, F.lit(False)).alias("carried"), F.round(F.when(was, F.lag("spec_t").over(by_step())).otherwise(F.col("t")), 4).alias("agent_t"))


def live_counters(steps: DataFrame) -> DataFrame:
    """Running totals of the live loop: a hit costs max(actor, guess + speculation); the answer it put off is paid at the next step."""
    s = states(steps)
    spent = F.when(F.col("hit"), F.greatest("t", F.col("g") + F.coalesce(F.lead("t").over(by_step()), F.lit(0.0)))).when(F.col("skip"), 0.0).otherwise(F.col("t"))
    s = s.withColumn("spent", spent)
    run = by_step().rowsBetween(Window.unboundedPreceding, 0)
    return s.select("run_id", "step", F.round(F.sum("t").over(run), 4).alias("regular_time"), F.round(F.sum("spent").over(run), 4).alias("speculative_time"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; the whole row is carried by one aggregation, so a hot key needs no sorting."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("x")).select(*keys, "x.*")

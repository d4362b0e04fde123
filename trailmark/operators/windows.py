"""Windowed control loops: windows with measurements, and proposals applied while they run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, default: Column | None = None) -> DataFrame:
    """left with the last `value` of right at or before its time: both sides in one sorted pass, no pairs."""
    l = left.withColumn("__ts", F.col(left_ts)).withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__row", F.struct(*left.columns))  # noqa: E741
    r = right.select(*keys, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.select(*keys, "__ts", "__side", "__v", "__row").unionByName(r).withColumn("__got", F.last("__v", True).over(w)).where("__side = 1")
    got = F.coalesce("__got", default) if default is not None else F.col("__got")
    return both.select("__row.*", got.alias(f"as_of_{value}"))


def running_best(df: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """df with best_score and best_at: the lowest so far, the earliest of equals."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__b", F.min(F.struct(score, order)).over(w)).select(*df.columns, F.col(f"__b.{score}").alias("best_score"), F.col(f"__b.{order}").alias("best_at"))


def best(df: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(F.struct(score, order)).alias("b")).select(*keys, F.col(f"b.{score}").alias("best_score"), F.col(f"b.{order}").alias("best_at"))


def chunks(df: DataFrame, keys: list[str], order: str, score: str, size: int = 10, whole_up_to: int = 12) -> DataFrame:
    """Best and last of each chunk of `size` windows; runs of up to whole_up_to windows aren't summarized."""
    w = Window.partitionBy(*keys)
    n = df.withColumn("__rn", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") > whole_up_to)
    g = n.withColumn("chunk", F.floor((F.col("__rn") - 1) / size)).groupBy(*keys, "chunk").agg(F.min(F.struct(score, order)).alias("b"), F.max(F.struct(order, score)).alias("l"))
    return g.select(*keys, "chunk", F.col(f"b.{score}").alias("best_score"), F.col(f"b.{order}").alias("best_at"), F.col(f"l.{score}").alias("last_score"))


def nearest(df: DataFrame, keys: list[str], score: str, target: float, order: str) -> DataFrame:
    """Per key the row nearest to the target; of equals the higher, then the earlier."""
    return df.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col(score) - target).alias("d"), (-F.col(score)).alias("s"), F.col(order).alias("o"))).alias("x")).select(*keys, F.col("x.o").alias(order), (-F.col("x.s")).alias(score))


def deltas(df: DataFrame, keys: list[str], order: str, counters: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select(*df.columns, *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in counters])


def utilization(total: str, idle: str) -> Column:
    """Percent of time not idle; null where no time passed; between 0 and 100."""
    return F.when(F.col(total) > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (F.col(total) - F.col(idle)) / F.col(total))))


def power(energy: str, seconds: str) -> Column:
    """Watts from microjoules; null if the counter wrapped or no time passed."""
    return F.when((F.col(energy) >= 0) & (F.col(seconds) > 0), F.col(energy) / F.col(seconds) / 1e6)


def relative_time(ts: str, started: str, first_apply: str) -> Column:
    """Seconds since the start, or since the first apply if there is no start (null or 0); never under 0."""
    return F.greatest(F.lit(0.0), F.col(ts) - F.coalesce(F.nullif(F.col(started), F.lit(0.0)), F.col(first_apply)))


def cumulative_with_origin(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Running sums, with a row of zeros before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long").alias("n"), *[F.sum(v).over(w).alias(v) for v in values])
    return rows.unionByName(df.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("n"), *[F.lit(0).cast(rows.schema[v].dataType).alias(v) for v in values]))


def step_points(applies: DataFrame, keys: list[str], ts: str, value: str, start: float, end: float, initial: float) -> DataFrame:
    """The points of a step function: its start, each change, and its end at the last value."""
    ends = applies.select(*keys).distinct()
    last = applies.groupBy(*keys).agg(F.max(F.struct(ts, value)).alias("x")).select(*keys, F.lit(end).alias(ts), F.col(f"x.{value}").alias(value))
    return ends.select(*keys, F.lit(start).alias(ts), F.lit(initial).alias(value)).unionByName(applies.select(*keys, ts, value)).unionByName(last)


def apply_time(response: str, earliest: str) -> Column:
    return F.greatest(F.col(response), F.col(earliest))


def with_shutdown(requests: DataFrame, response: str, error: str) -> DataFrame:
    return requests.withColumn(error, F.when(F.col(response).isNull(), F.coalesce(F.col(error), F.lit("cancelled_at_shutdown"))).otherwise(F.col(error)))


def replay_schedule(requests: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Applied proposals of the actor with a value, by their offset from the start, in order."""
    got = requests.where((F.col("role") == "actor") & F.col("applied") & F.col("apply_ts").isNotNull() & F.col("value").isNotNull())
    return got.withColumn("offset", F.col("apply_ts") - F.col(start)).where("offset >= 0").withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("offset", "seq")).cast("long")).select(*keys, "nth", "offset", "value")


def since_baseline(windows: DataFrame, keys: list[str], order: str, actor_applied: str) -> DataFrame:
    """windows with `compressed`: those before the last apply of the actor in the whole run."""
    last = F.max(F.when(F.col(actor_applied), F.col(order))).over(Window.partitionBy(*keys))
    return windows.withColumn("compressed", F.coalesce(F.col(order) < last, F.lit(False)))


def least_from(have: DataFrame, asked: DataFrame, value: str, what: str) -> DataFrame:
    """asked(value), its values distinct and not null, each with `what` of the row of have(value, what) that has the least value no
    less than it; null without one. have's values are distinct; null ones are never found.

    An as-of lookup without a key to part it by: both sides are cut into ranges of the value, a range is taken once, downwards, and what
    the next range begins with is handed on. So no task sees a whole side, and rows aren't compared by pairs."""
    rows = have.where(F.col(value).isNotNull()).select(value, F.struct(what).alias("w"))
    both = rows.unionByName(asked.select(value), allowMissingColumns=True).repartitionByRange(value)
    cut = kept(both.withColumn("part", F.spark_partition_id()))  # written, so that the ranges stay as they were drawn
    down = Window.partitionBy("part").orderBy(F.desc(value), F.col("w").isNull())
    own = cut.withColumn("found", F.last("w", ignorenulls=True).over(down)).where(F.col("w").isNull())
    first = cut.groupBy("part").agg(F.min(F.when(F.col("w").isNotNull(), F.struct(value, "w"))).alias("first"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range: as many as shuffle partitions
    handed = first.select("part", F.last("first", ignorenulls=True).over(above)["w"].alias("next"))
    return own.join(F.broadcast(handed), "part").select(value, F.coalesce("found", "next")[what].alias(what))

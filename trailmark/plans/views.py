"""The driver's tables in the shapes that the operators read, as DataFrames and, for the checks, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trajectory per user: one step per event, the three types before it as guesses, its value as the agent's time.

    run_id, step, move, t, w (agent's tokens), guesses, g (time of the guess), gw (its tokens), scores.
    """
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    past = F.array_compact(F.array(*[F.lag("event_type", i).over(w) for i in (1, 2, 3)]))
    score = lambda m: F.pmod(F.col("k") * m, F.lit(101)).cast("double")
    return e.select(
        F.col("user_id").alias("run_id"), (F.row_number().over(w) - 1).cast("long").alias("step"), F.col("event_type").alias("move"), F.col("value").alias("t"), F.col("k").alias("w"),
        past.alias("guesses"), (F.col("value") * 0.25).alias("g"), F.pmod("k", F.lit(7)).alias("gw"), F.array(score(7), score(11), score(13)).alias("scores"))


STEPS = """
e AS (SELECT user_id, ts, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
steps AS (SELECT user_id AS run_id, row_number() OVER w - 1 AS step, event_type AS move, value AS t, k AS w,
  list_filter([lag(event_type, 1) OVER w, lag(event_type, 2) OVER w, lag(event_type, 3) OVER w], lambda x: x IS NOT NULL) AS guesses,
  value * 0.25 AS g, k % 7 AS gw, [CAST(k * 7 % 101 AS DOUBLE), CAST(k * 11 % 101 AS DOUBLE), CAST(k * 13 % 101 AS DOUBLE)] AS scores
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

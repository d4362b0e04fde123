"""Trajectory replay over the events of each user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, replay
from .registry import query
from .views import STEPS, steps


def _replay_sql(targets: str, guesses: str = "guesses", conf: bool = False) -> str:
    at = "greatest(cut - 2, 0)" if conf else "0"
    return f"""WITH {STEPS},
s AS (SELECT * REPLACE ({guesses} AS guesses), count(*) OVER (PARTITION BY run_id) AS n, lead(t) OVER w AS t1, lead(w) OVER w AS w1 FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step)),
a AS (SELECT *, len(guesses) AS k, list_contains(guesses, move) AS m FROM s),
b AS (SELECT *, step - coalesce(max(CASE WHEN NOT m THEN step END) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING), -1) AS pos FROM a),
c AS (SELECT *, m AND pos % 2 = 1 AS hit FROM b),
d AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY run_id ORDER BY step), false) AS skip FROM c),
x AS (SELECT d.*, target, least(target, n) AS cut FROM d, (SELECT unnest({targets}) AS target) WHERE step < least(target, n)),
y AS (SELECT *, step = cut - 1 AS last, g + t1 AS gain, gw + w1 AS both_w FROM x),
r AS (SELECT run_id, target, max(cut) AS steps, sum(t) AS reg_t,
  sum(CASE WHEN last THEN CASE WHEN skip THEN 0 ELSE t END WHEN hit THEN CASE WHEN gain < t THEN t ELSE gain END WHEN skip THEN 0 ELSE t END) AS spec_t, sum(w) AS reg_w,
  sum(w + CASE WHEN last THEN CASE WHEN skip THEN 0 ELSE w END WHEN hit THEN CASE WHEN gain < t THEN k * both_w ELSE (k - 1) * w + both_w END WHEN skip THEN 0 ELSE k * w END) AS spec_w,
  count(*) FILTER (WHERE NOT last AND m) AS matches, count(*) FILTER (WHERE NOT last AND hit) AS window_matches, count(*) FILTER (WHERE NOT last AND (hit OR NOT skip)) AS windows,
  max(CASE WHEN step = {at} THEN k END) AS num_predictions FROM y GROUP BY run_id, target)
SELECT run_id, target, steps, round(reg_t, 4) AS reg_t, round(spec_t, 4) AS spec_t, CAST(reg_w AS BIGINT) AS reg_w, CAST(spec_w AS BIGINT) AS spec_w, matches, window_matches, windows, num_predictions,
  CASE WHEN reg_t <> 0 THEN round((reg_t - spec_t) / reg_t * 100, 4) ELSE 0 END AS time_saved, CASE WHEN reg_w <> 0 THEN round((CAST(reg_w AS DOUBLE) - spec_w) / reg_w * 100, 4) ELSE 0 END AS tokens_wasted,
  round(CAST(matches AS DOUBLE) / steps, 6) AS accuracy, CASE WHEN windows > 0 THEN round(CAST(window_matches AS DOUBLE) / windows, 6) ELSE 0 END AS window_accuracy FROM r
UNION ALL SELECT run_id, target, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM (SELECT DISTINCT run_id FROM steps), (SELECT unnest({targets}) AS target) WHERE target <= 0"""


CONF = "CASE WHEN len(guesses) <= 1 THEN guesses ELSE list_filter(guesses, lambda x, i: CASE WHEN len(guesses) < 3 AND i > 2 THEN false ELSE scores[i] > 50 END) END"


@query("AGG_01_speculation_replay", _replay_sql("[50]"))
def agg_01(spark, d):
    return replay.replay(steps(spark, d), [50])


@query("AGG_01_confidence_replay", _replay_sql("[50]", CONF, True))
def agg_01c(spark, d):
    return replay.replay(steps(spark, d), [50], confidence=True)


@query("AGG_02_batch_replay", _replay_sql("[-3, 0, 1, 5, 10, 20, 1000000]"))
def agg_02(spark, d):
    return replay.replay(steps(spark, d), [-3, 0, 1, 5, 10, 20, 1_000_000])


_STATE = f"""WITH {STEPS}, a AS (SELECT *, list_contains(guesses, move) AS m FROM steps),
b AS (SELECT *, step - coalesce(max(CASE WHEN NOT m THEN step END) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING), -1) AS pos FROM a),
c AS (SELECT *, m AND pos % 2 = 1 AS hit FROM b), d AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY run_id ORDER BY step), false) AS skip FROM c)"""


@query("WIN_01_hit_automaton", _STATE + " SELECT run_id, step, m, hit, skip FROM d")
def win_01(spark, d):
    return replay.states(steps(spark, d)).select("run_id", "step", "m", "hit", "skip")


@query("WIN_02_lead", f"WITH {STEPS} SELECT run_id, step, lead(t) OVER (PARTITION BY run_id ORDER BY step) AS next_t, lead(w) OVER (PARTITION BY run_id ORDER BY step) AS next_w FROM steps")
def win_02(spark, d):
    return steps(spark, d).select("run_id", "step", F.lead("t").over(replay.by_step()).alias("next_t"), F.lead("w").over(replay.by_step()).alias("next_w"))


@query("WIN_03_PRJ_03_shifted_carry", f"""WITH {STEPS}, a AS (SELECT *, list_position(guesses, move) AS p FROM steps),
b AS (SELECT *, lag(p) OVER w AS lp, lag(g) OVER w AS lg FROM a WINDOW w AS (PARTITION BY run_id ORDER BY step))
SELECT run_id, step, coalesce(lp > 0, false) AS carried, round(CASE WHEN lp > 0 THEN lg + lp - 1 ELSE t END, 4) AS agent_t FROM b""")
def win_03(spark, d):
    return replay.carried(steps(spark, d))


@query("JON_13_previous_step_hit", f"""WITH {STEPS}, a AS (SELECT *, lag(guesses) OVER w AS before FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step))
SELECT run_id, step, CASE WHEN list_position(before, move) > 0 AND list_position(before, move) <= 2 THEN CAST(list_position(before, move) - 1 AS BIGINT) END AS at FROM a""")
def jon_13(spark, d):
    """The first earlier prediction equal to this move, if one of the first two has a speculation."""
    p = F.array_position(F.lag("guesses").over(replay.by_step()), F.col("move"))
    return steps(spark, d).select("run_id", "step", "move", p.alias("p")).select("run_id", "step", F.when((F.col("p") > 0) & (F.col("p") <= 2), F.col("p") - 1).alias("at"))


@query("AGG_40_live_counters", _STATE + """, f AS (SELECT *, CASE WHEN hit THEN greatest(t, g + coalesce(lead(t) OVER (PARTITION BY run_id ORDER BY step), 0)) WHEN skip THEN 0 ELSE t END AS spent FROM d)
SELECT run_id, step, round(sum(t) OVER w, 4) AS regular_time, round(sum(spent) OVER w, 4) AS speculative_time FROM f WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def agg_40(spark, d):
    return replay.live_counters(steps(spark, d))


@query("FLT_01_membership", f"WITH {STEPS} SELECT run_id, step, move FROM steps WHERE list_contains(guesses, move)")
def flt_01(spark, d):
    return steps(spark, d).where(replay.matched()).select("run_id", "step", "move")


@query("FLT_02_confidence_filter", f"WITH {STEPS} SELECT run_id, step, array_to_string({CONF}, ',') AS kept FROM steps")
def flt_02(spark, d):
    return steps(spark, d).select("run_id", "step", F.array_join(replay.confident(), ",").alias("kept"))


@query("FLT_03_drop_target", f"WITH {STEPS} SELECT run_id, step FROM steps WHERE step <> 10")
def flt_03(spark, d):
    return steps(spark, d).where("step <> 10").select("run_id", "step")


@query("FLT_04_target_steps", f"WITH {STEPS} SELECT run_id, step, move FROM steps WHERE step IN (5, 20, 30)")
def flt_04(spark, d):
    return steps(spark, d).where(F.col("step").isin(5, 20, 30)).select("run_id", "step", "move")


@query("FLT_05_truncation", f"WITH {STEPS}, n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM steps) SELECT run_id, step FROM n WHERE step < least(25, n)")
def flt_05(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    return steps(spark, d).withColumn("n", n).where("step < least(25, n)").select("run_id", "step")


@query("JON_16_targets", f"WITH {STEPS}, r AS (SELECT DISTINCT run_id FROM steps) SELECT run_id, target FROM r, (SELECT unnest([10, 20, 30]) AS target)")
def jon_16(spark, d):
    return steps(spark, d).select("run_id").distinct().withColumn("target", F.explode(F.array(F.lit(10), F.lit(20), F.lit(30))))


_R = _replay_sql("[5, 10, 20]")


@query("AGG_03_first_per_key", f"SELECT event_type, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def agg_03(spark, d):
    from .views import table
    return replay.first_per_key(table(spark, d, "events").select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", "value")


@query("AGG_04_group_lists", f"SELECT target, num_predictions, count(*) AS n, round(avg(time_saved), 4) AS time_saved, round(avg(accuracy), 4) AS accuracy FROM ({_R}) GROUP BY ALL")
def agg_04(spark, d):
    """Groups by target and number of predictions; only what the lists are for is kept, not the lists."""
    return replay.replay(steps(spark, d), [5, 10, 20]).groupBy("target", "num_predictions").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("time_saved"), 4).alias("time_saved"), F.round(F.avg("accuracy"), 4).alias("accuracy"))


_T = ", ".join(f"({a}, {q})" for a, q in intervals.t_table())


@query("AGG_05_student_interval", f"""WITH x AS ({_R}), t(df, q) AS (VALUES {_T}),
g AS (SELECT target, avg(accuracy) AS mean, coalesce(stddev_samp(accuracy), 0) AS std, count(accuracy) AS n FROM x GROUP BY target)
SELECT target, round(mean, 6) AS mean, round(std, 6) AS std, n, round(CASE WHEN n > 31 THEN 1.96 ELSE coalesce(q, 0) END * std / sqrt(n), 6) AS half_width FROM g LEFT JOIN t ON t.df = least(n - 1, 30)""")
def agg_05(spark, d):
    return intervals.student(replay.replay(steps(spark, d), [5, 10, 20]), ["target"], "accuracy")


@query("AGG_05_student_small_groups", f"""WITH x AS (SELECT p_brand || '/' || p_type || '/' || p_size AS k, p_retailprice AS v FROM part), t(df, q) AS (VALUES {_T}),
g AS (SELECT k, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, count(v) AS n FROM x GROUP BY k)
SELECT k, round(mean, 6) AS mean, round(std, 6) AS std, n, round(CASE WHEN n > 31 THEN 1.96 ELSE coalesce(q, 0) END * std / sqrt(n), 6) AS half_width FROM g LEFT JOIN t ON t.df = least(n - 1, 30)""")
def agg_05s(spark, d):
    from .views import table
    return intervals.student(table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("k"), F.col("p_retailprice").alias("v")), ["k"], "v")


@query("AGG_06_normal_interval", "SELECT event_type, round(avg(value), 6) AS mean, round(1.96 * stddev_pop(value) / sqrt(count(value)), 6) AS half_width FROM events GROUP BY 1")
def agg_06(spark, d):
    from .views import table
    return intervals.normal(["event_type"], table(spark, d, "events"), "value")


@query("AGG_07_standard_error", "SELECT event_type, user_id, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM events GROUP BY 1, 2")
def agg_07(spark, d):
    from .views import table
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(intervals.standard_error("value"), 6).alias("se"))

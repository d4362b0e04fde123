"""Control-loop queries. The events of a user play a run: each event is a window with its value as p95, purchases are the
actor's applied proposals, errors are requests without a response."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as op
from .registry import query
from .views import table

_W = """e AS (SELECT user_id AS run_id, row_number() OVER w - 1 AS it, epoch(ts)::DOUBLE AS ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def runs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.row_number().over(w) - 1).cast("long").alias("it"), ts.alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")


@query("JON_12_as_of", f"""WITH {_W}, a AS (SELECT run_id, ts, k FROM e WHERE event_type = 'purchase') SELECT e.run_id, e.it, coalesce(a.k, -1) AS as_of_k FROM e ASOF LEFT JOIN a ON e.run_id =
a.run_id AND e.ts >= a.ts WHERE e.event_type <> 'purchase'""")
def jon_12(spark, d):
    e = runs(spark, d)
    got = op.as_of(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'").select("run_id", "ts", "k"), ["run_id"], "ts", "ts", "k", F.lit(-1).cast("long"))
    return got.select("run_id", "it", "as_of_k")


@query("STM_05_start_and_end_parameters", f"""WITH {_W}, a AS (SELECT run_id, ts, k FROM e WHERE event_type = 'purchase'), x AS (SELECT run_id, it, ts AS t0, ts + 60 AS t1 FROM e WHERE event_type <> 'purchase'),
y AS (SELECT x.*, a.k AS s FROM x ASOF LEFT JOIN a ON x.run_id = a.run_id AND x.t0 >= a.ts) SELECT y.run_id, y.it, y.s AS at_start, a.k AS at_end FROM y ASOF LEFT JOIN a ON y.run_id = a.run_id AND y.t1 >= a.ts""")
def stm_05(spark, d):
    e = runs(spark, d)
    a = e.where("event_type = 'purchase'").select("run_id", "ts", "k")
    x = e.where("event_type <> 'purchase'").select("run_id", "it", F.col("ts").alias("t0"), (F.col("ts") + 60).alias("t1"))
    x = op.as_of(x, a, ["run_id"], "t0", "ts", "k").withColumnRenamed("as_of_k", "at_start")
    return op.as_of(x, a, ["run_id"], "t1", "ts", "k").select("run_id", "it", "at_start", F.col("as_of_k").alias("at_end"))


@query("WIN_04_cumulative_tokens", f"""WITH {_W}, c AS (SELECT run_id, it + 1 AS n, sum(k) OVER w AS tokens, sum(value) OVER w AS cost FROM e WINDOW w AS (PARTITION BY run_id ORDER BY it ROWS UNBOUNDED PRECEDING))
SELECT run_id, n, CAST(tokens AS BIGINT) AS tokens, round(cost, 4) AS cost FROM c UNION ALL SELECT DISTINCT run_id, 0, 0, 0 FROM e""")
def win_04(spark, d):
    return op.cumulative_with_origin(runs(spark, d).select("run_id", "it", F.col("k").alias("tokens"), F.col("value").alias("cost")), ["run_id"], "it", ["tokens", "cost"]).withColumn("cost", F.round("cost", 4))


@query("WIN_05_WIN_06_step_points", f"""WITH {_W}, a AS (SELECT run_id, round(ts, 3) AS ts, k FROM e WHERE event_type = 'purchase')
SELECT run_id, 0.0::DOUBLE AS ts, 50 AS k FROM (SELECT DISTINCT run_id FROM a) UNION ALL SELECT * FROM a UNION ALL SELECT run_id, 2e9::DOUBLE, arg_max(k, (ts, k)) FROM a GROUP BY 1""")
def win_05(spark, d):
    a = runs(spark, d).where("event_type = 'purchase'").select("run_id", F.round("ts", 3).alias("ts"), "k")
    return op.step_points(a, ["run_id"], "ts", "k", 0.0, 2e9, 50).withColumn("k", F.col("k").cast("long"))


@query("WIN_07_running_best", f"WITH {_W} SELECT run_id, it, min(value) OVER w AS best_score, (min((value, it)) OVER w)[2] AS best_at FROM e WINDOW w AS (PARTITION BY run_id ORDER BY it ROWS UNBOUNDED PRECEDING)".replace("(min((value, it)) OVER w)[2]", "struct_extract(min({'a': value, 'b': it}) OVER w, 'b')"))
def win_07(spark, d):
    return op.running_best(runs(spark, d).select("run_id", "it", "value"), ["run_id"], "it", "value").select("run_id", "it", "best_score", "best_at")


@query("WIN_08_STM_06_baseline_split", f"""WITH {_W}, m AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN it END) OVER (PARTITION BY run_id) AS b FROM e) SELECT run_id, it, coalesce(it < b, false) AS
compressed FROM m""")
def win_08(spark, d):
    return op.since_baseline(runs(spark, d).withColumn("ap", F.col("event_type") == "purchase"), ["run_id"], "it", "ap").select("run_id", "it", "compressed")


@query("WIN_09_FLT_16_counter_delta", f"WITH {_W}, x AS (SELECT run_id, it, k - lag(k) OVER (PARTITION BY run_id ORDER BY it) AS d_k FROM e) SELECT * FROM x WHERE d_k > 0")
def win_09(spark, d):
    return op.deltas(runs(spark, d).select("run_id", "it", "k"), ["run_id"], "it", ["k"]).where("d_k > 0").select("run_id", "it", "d_k")


@query("AGG_29_mean_p95", f"WITH {_W} SELECT run_id, round(avg(value), 6) AS mean_p95 FROM e GROUP BY 1")
def agg_29(spark, d):
    return runs(spark, d).groupBy("run_id").agg(F.round(F.coalesce(F.avg("value"), F.lit(float("nan"))), 6).alias("mean_p95"))


@query("AGG_30_run_best", f"WITH {_W} SELECT run_id, min(value) AS best_score, arg_min(it, (value, it)) AS best_at FROM e GROUP BY 1")
def agg_30(spark, d):
    return op.best(runs(spark, d), ["run_id"], "it", "value")


@query("AGG_31_chunk_summary", f"""WITH {_W}, n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM e) SELECT run_id, it // 10 AS chunk, min(value) AS best_score, arg_min(it, (value, it)) AS best_at, arg_max(value, it) AS last_score FROM n WHERE n > 12 GROUP BY 1, 2""")
def agg_31(spark, d):
    return op.chunks(runs(spark, d), ["run_id"], "it", "value")


@query("AGG_32_request_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_32(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("AGG_33_nearest_to_target", f"WITH {_W} SELECT run_id, arg_min(it, (abs(value - 40), -value, it)) AS it, arg_min(value, (abs(value - 40), -value, it)) AS value FROM e GROUP BY 1")
def agg_33(spark, d):
    return op.nearest(runs(spark, d), ["run_id"], "value", 40.0, "it")


@query("FLT_17_threshold_or_all", f"WITH {_W}, f AS (SELECT *, bool_or(value >= 90) OVER (PARTITION BY run_id) AS anyb FROM e) SELECT run_id, it, value FROM f WHERE value >= 90 OR NOT anyb")
def flt_17(spark, d):
    some = F.bool_or(F.col("value") >= 90).over(Window.partitionBy("run_id"))
    return runs(spark, d).withColumn("some", some).where("value >= 90 or not some").select("run_id", "it", "value")


@query("AGG_34_utilization", f"""WITH {_W}, x AS (SELECT run_id, it, k - lag(k) OVER w AS total, (k // 2) - lag(k // 2) OVER w AS idle FROM e WINDOW w AS (PARTITION BY run_id ORDER BY it))
SELECT run_id, round(avg(CASE WHEN total > 0 THEN greatest(0, least(100, 100.0 * (total - idle) / total)) END)::DOUBLE, 6) AS busy FROM x GROUP BY 1""")
def agg_34(spark, d):
    x = op.deltas(runs(spark, d).select("run_id", "it", F.col("k").alias("total"), F.floor(F.col("k") / 2).alias("idle")), ["run_id"], "it", ["total", "idle"])
    return x.groupBy("run_id").agg(F.round(F.avg(op.utilization("d_total", "d_idle")), 6).alias("busy"))


@query("AGG_35_power", f"""WITH {_W}, x AS (SELECT run_id, it, k * 1000000 - lag(k * 1000000) OVER w AS en, ts - lag(ts) OVER w AS dt FROM e WINDOW w AS (PARTITION BY run_id ORDER BY it)) SELECT run_id, it, round(CASE WHEN en >= 0 AND dt > 0 THEN en / dt / 1e6 END, 8) AS watts FROM x""")
def agg_35(spark, d):
    x = op.deltas(runs(spark, d).select("run_id", "it", (F.col("k") * 1_000_000).alias("en"), "ts"), ["run_id"], "it", ["en", "ts"])
    return x.select("run_id", "it", F.round(op.power("d_en", "d_ts"), 8).alias("watts"))


@query("AGG_36_state_share", f"""WITH {_W}, x AS (SELECT run_id, event_type, k - lag(k) OVER (PARTITION BY run_id, event_type ORDER BY it) AS dk FROM e), s AS (SELECT run_id, event_type, sum(dk) AS s FROM x WHERE dk > 0 GROUP BY 1, 2)
SELECT run_id, event_type, round(CAST(s AS DOUBLE) / sum(s) OVER (PARTITION BY run_id), 6) AS share FROM s""")
def agg_36(spark, d):
    x = op.deltas(runs(spark, d).select("run_id", "event_type", "it", "k"), ["run_id", "event_type"], "it", ["k"]).where("d_k > 0")
    s = x.groupBy("run_id", "event_type").agg(F.sum("d_k").alias("s"))
    return s.select("run_id", "event_type", F.round(F.col("s") / F.sum("s").over(Window.partitionBy("run_id")), 6).alias("share"))


#: Model, USD for a million tokens in and out.
PRICES = [("flash-lite", 0.10, 0.40), ("flash", 0.30, 2.50)]
_PRICES = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in PRICES)


@query("AGG_41_PRJ_20_token_cost", f"""WITH p(model, pin, pout) AS (VALUES {_PRICES}), x AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'flash' WHEN 'view' THEN 'flash-lite' ELSE 'unknown' END AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, model, round(coalesce((k * pin + 2 * k * pout) / 1e6, 0), 9) AS usd FROM x LEFT JOIN p USING (model)""")
def agg_41(spark, d):
    p = spark.createDataFrame(PRICES, "model string, pin double, pout double")  # two rows
    e = runs(spark, d).select("event_id", "k", F.when(F.col("event_type") == "click", "flash").when(F.col("event_type") == "view", "flash-lite").otherwise("unknown").alias("model"))
    return e.join(F.broadcast(p), "model", "left").select("event_id", "model", F.round(F.coalesce((F.col("k") * F.col("pin") + 2 * F.col("k") * F.col("pout")) / 1e6, F.lit(0.0)), 9).alias("usd"))


@query("STM_01_tumbling_window", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stm_01(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("STM_04_FLT_15_earliest_apply", f"WITH {_W} SELECT run_id, it, round(greatest(ts + value, ts + 10), 3) AS apply_ts FROM e WHERE event_type IN ('purchase', 'click')")
def stm_04(spark, d):
    r = runs(spark, d).where(F.col("event_type").isin("purchase", "click")).withColumn("response", F.col("ts") + F.col("value")).withColumn("earliest", F.col("ts") + 10)
    return r.select("run_id", "it", F.round(op.apply_time("response", "earliest"), 3).alias("apply_ts"))


@query("STM_07_shutdown", f"WITH {_W} SELECT run_id, it, CASE WHEN event_type = 'error' THEN 'cancelled_at_shutdown' END AS error FROM e")
def stm_07(spark, d):
    r = runs(spark, d).withColumn("response", F.when(F.col("event_type") != "error", F.col("ts"))).withColumn("error", F.lit(None).cast("string"))
    return op.with_shutdown(r, "response", "error").select("run_id", "it", "error")


@query("STM_08_SRT_01_replay_schedule", f"""WITH {_W}, s AS (SELECT *, min(ts) OVER (PARTITION BY run_id) AS t0 FROM e) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts - t0, it) AS nth, round(ts - t0, 3) AS "offset", k AS value FROM s WHERE event_type = 'purchase'""")
def stm_08(spark, d):
    r = runs(spark, d).withColumn("t0", F.min("ts").over(Window.partitionBy("run_id"))).select("run_id", "t0", F.when(F.col("event_type") == "purchase", "actor").otherwise("other").alias("role"), F.lit(True).alias("applied"), F.col("ts").alias("apply_ts"), F.col("k").alias("value"), F.col("it").alias("seq"))
    return op.replay_schedule(r, ["run_id"], "t0").withColumn("offset", F.round("offset", 3))


@query("STM_09_replay_in_force", f"""WITH {_W}, s AS (SELECT *, ts - min(ts) OVER (PARTITION BY run_id) AS off FROM e), a AS (SELECT run_id, off, k FROM s WHERE event_type = 'purchase'), g AS (SELECT run_id, unnest([0, 86400, 604800, 1209600])::DOUBLE AS elapsed FROM (SELECT DISTINCT run_id FROM e))
SELECT g.run_id, g.elapsed, a.k AS in_force FROM g ASOF LEFT JOIN a ON g.run_id = a.run_id AND g.elapsed >= a.off""")
def stm_09(spark, d):
    s = runs(spark, d).withColumn("off", F.col("ts") - F.min("ts").over(Window.partitionBy("run_id")))
    g = s.select("run_id").distinct().withColumn("elapsed", F.explode(F.array(*[F.lit(float(x)) for x in (0, 86400, 604800, 1209600)])))
    return op.as_of(g, s.where("event_type = 'purchase'").select("run_id", "off", "k"), ["run_id"], "elapsed", "off", "k").select("run_id", "elapsed", F.col("as_of_k").alias("in_force"))


@query("PRJ_14_PRJ_15_relative_time", f"""WITH {_W}, s AS (SELECT *, min(ts) OVER (PARTITION BY run_id) AS f, CASE WHEN run_id % 2 = 0 THEN 0 ELSE 1704067200 END AS st FROM e) SELECT run_id, it, round(greatest(0,
ts - CASE WHEN st = 0 THEN f ELSE st END), 3) AS rel, k * 1000 / 1e6 AS ms FROM s""")
def prj_15(spark, d):
    s = runs(spark, d).withColumn("f", F.min("ts").over(Window.partitionBy("run_id"))).withColumn("st", F.when(F.col("run_id") % 2 == 0, 0.0).otherwise(1704067200.0))
    return s.select("run_id", "it", F.round(op.relative_time("ts", "st", "f"), 3).alias("rel"), (F.col("k") * 1000 / 1e6).alias("ms"))


@query("STM_16_SRT_02_probe_ranking", f"""WITH {_W}, p AS (SELECT run_id, round(avg(value), 6) AS p95 FROM e GROUP BY 1) SELECT run_id, p95, row_number() OVER (ORDER BY p95 DESC, run_id) AS nth FROM p ORDER BY
p95 DESC, run_id LIMIT 12""")
def stm_16(spark, d):
    """The twelve slowest probes: a top-k report."""
    p = runs(spark, d).groupBy("run_id").agg(F.round(F.avg("value"), 6).alias("p95")).orderBy(F.desc("p95"), "run_id").limit(12)
    return p.select("run_id", "p95", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("p95"), "run_id")).cast("long").alias("nth"))

"""Tool-call analytics. The events of a user play a conversation: signups are user messages, clicks and views tool calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calls as op
from .registry import query
from .views import table

_MSG = """msg AS (SELECT user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'user' WHEN 'click' THEN 'tool' WHEN 'view' THEN 'tool' ELSE 'assistant' END AS role,
 event_type AS name, 'k=' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS args, value FROM events),
trn AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_no FROM msg),
lst AS (SELECT *, max(turn_no) OVER (PARTITION BY task) AS turns FROM trn)"""
_REAL = "rl AS (SELECT task, turn_no AS turn, name, args FROM lst WHERE role = 'tool' AND turn_no >= 1 AND turn_no < turns), pr AS (SELECT task, turn_no AS turn, name, args FROM trn WHERE role = 'tool')"


def messages(spark, d):
    e = table(spark, d, "events")
    role = F.when(F.col("event_type") == "signup", "user").when(F.col("event_type").isin("click", "view"), "tool").otherwise("assistant")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("task"), F.row_number().over(w).cast("long").alias("seq"), role.alias("role"), F.col("event_type").alias("name"), F.concat(F.lit("k="), (F.get_json_object("props", "$.k").cast("long") % 3).cast("string")).alias("args"), "value")


def both(spark, d):
    m = messages(spark, d)
    real = op.flushed_calls(m, ["task"], "seq").select("task", F.col("turn_no").alias("turn"), "name", "args")
    pred = op.turn_index(m, ["task"], "seq").where("role = 'tool'").select("task", F.col("turn_no").alias("turn"), "name", "args")
    return m, real, pred


@query("PRJ_07_WIN_13_flatten", f"WITH {_MSG} SELECT task, seq, turn_no, name FROM lst WHERE role = 'tool' AND turn_no >= 1 AND turn_no < turns")
def prj_07(spark, d):
    return op.flushed_calls(messages(spark, d), ["task"], "seq").select("task", "seq", "turn_no", "name")


@query("AGG_20_JON_03_JON_04_call_hit_rate", f"""WITH {_MSG}, {_REAL}, h AS (SELECT rl.task, count(*) AS hits FROM rl JOIN pr ON pr.task = rl.task AND pr.turn + 1 = rl.turn AND pr.name = rl.name AND pr.args = rl.args GROUP BY 1),
c AS (SELECT task, count(*) AS calls FROM rl GROUP BY 1), t AS (SELECT DISTINCT task FROM msg)
SELECT t.task, CAST(coalesce(hits, 0) AS BIGINT) AS hits, coalesce(calls, 0) AS calls, round(CASE WHEN calls > 0 THEN CAST(coalesce(hits, 0) AS DOUBLE) / calls ELSE coalesce(hits, 0) + 1 END, 6) AS rate FROM t LEFT JOIN c USING (task) LEFT JOIN h USING (task)""")
def agg_20(spark, d):
    m, real, pred = both(spark, d)
    return op.hit_rate(real, pred, m).withColumn("rate", F.round("rate", 6))


@query("JON_05_JON_06_SET_01_SET_02_AGG_21_union_hit_rate", f"""WITH {_MSG}, {_REAL}, u AS (SELECT DISTINCT task, turn + 1 AS turn, name, args FROM (SELECT * FROM pr WHERE name = 'click' UNION ALL SELECT * FROM pr WHERE args <> 'k=0')), r AS (SELECT DISTINCT * FROM rl),
h AS (SELECT task, count(*) AS hits FROM r SEMI JOIN u USING (task, turn, name, args) GROUP BY 1), c AS (SELECT task, count(*) AS calls FROM r GROUP BY 1), t AS (SELECT DISTINCT task FROM msg)
SELECT t.task, coalesce(hits, 0) AS hits, coalesce(calls, 0) AS calls, round(CASE WHEN calls > 0 THEN CAST(coalesce(hits, 0) AS DOUBLE) / calls ELSE coalesce(hits, 0) + 1 END, 6) AS rate FROM t LEFT JOIN c USING (task) LEFT JOIN h USING (task)""")
def jon_06(spark, d):
    m, real, pred = both(spark, d)
    models = pred.where("name = 'click'").unionByName(pred.where("args <> 'k=0'"))
    return op.hit_rate(real, models, m, once=True).withColumn("rate", F.round("rate", 6))


@query("AGG_19_cost_roll_up", f"""WITH {_MSG}, p AS (SELECT task, count(DISTINCT turn_no) AS turns, sum(value) AS v, sum(seq) AS s FROM trn GROUP BY 1)
SELECT round(avg(v), 6) AS value_per_task, round(avg(s), 6) AS seq_per_task, round(avg(v / turns), 6) AS value_per_turn, round(avg(CAST(s AS DOUBLE) / turns), 6) AS seq_per_turn FROM p""")
def agg_19(spark, d):
    got = op.cost_roll_up(op.turn_index(messages(spark, d), ["task"], "seq"), "task", "turn_no", ["value", "seq"])
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query("AGG_22_parallel_latency", "SELECT user_id, max(value) AS latency, round(sum(value), 4) AS price FROM events GROUP BY 1")
def agg_22(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("latency"), F.round(F.sum("value"), 4).alias("price"))


#: Model, tokens a second, seconds before the first.
SPEEDS = [("nano low", 187.4, 0.92), ("mini medium", 61.1, 33.97), ("gpt-5 high", 137.7, 61.51), ("gemini flash", 195.3, 0.27)]
_SPEEDS = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in SPEEDS)


@query("AGG_23_latency_model", f"WITH m(model, tps, lat) AS (VALUES {_SPEEDS}) SELECT event_id, model, round(CAST(json_extract_string(props, '$.k') AS BIGINT) / tps + lat, 6) AS seconds FROM events, m")
def agg_23(spark, d):
    m = spark.createDataFrame(SPEEDS, "model string, tps double, lat double")  # four rows
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).crossJoin(F.broadcast(m)).select("event_id", "model", F.round(F.col("k") / F.col("tps") + F.col("lat"), 6).alias("seconds"))


@query("AGG_42_typing_time", "SELECT conv_id, turn, round(len(string_split(text, ' ')) / 40.0 * 60, 6)::DOUBLE AS seconds FROM conversations WHERE role = 'user'")
def agg_42(spark, d):
    from ..functions.text import typing_seconds
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.round(typing_seconds(F.col("text")), 6).alias("seconds"))


@query("AGG_43_calls_between_users", f"WITH {_MSG} SELECT task, turn_no, CAST(sum(CASE WHEN role = 'tool' THEN 1 ELSE 0 END) AS BIGINT) AS n_calls FROM trn GROUP BY 1, 2")
def agg_43(spark, d):
    return op.calls_between_users(messages(spark, d), ["task"], "seq")


@query("PRJ_08_first_call", f"WITH {_MSG} SELECT task, turn_no, arg_min(name, seq) AS name FROM trn WHERE role = 'tool' GROUP BY 1, 2")
def prj_08(spark, d):
    m = op.turn_index(messages(spark, d), ["task"], "seq").where("role = 'tool'")
    return m.groupBy("task", "turn_no").agg(F.min(F.struct("seq", "name")).alias("x")).select("task", "turn_no", "x.name")


@query("PRJ_09_message_action", f"WITH {_MSG} SELECT task, seq, CASE WHEN role = 'tool' THEN name ELSE 'respond' END AS name, CASE WHEN role = 'tool' THEN args ELSE role END AS args FROM msg")
def prj_09(spark, d):
    m = messages(spark, d).withColumn("calls", F.when(F.col("role") == "tool", F.array(F.struct("name", "args"))).otherwise(F.array().cast("array<struct<name string, args string>>")))
    return m.select("task", "seq", op.message_action("calls", "role").alias("a")).select("task", "seq", "a.*")


@query("PRJ_11_PRJ_12_transcript", """SELECT conv_id, md5(string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn)) AS transcript FROM conversations WHERE role <>
'system' GROUP BY 1""")
def prj_11(spark, d):
    return op.transcript(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text").select("conv_id", F.md5("transcript").alias("transcript"))


@query("FLT_12_role_without_calls", f"WITH {_MSG} SELECT task, count(*) AS n FROM msg WHERE role = 'assistant' AND name <> 'purchase' GROUP BY 1")
def flt_12(spark, d):
    m = messages(spark, d).withColumn("has_tool_calls", F.col("name") == "purchase")
    return m.where((F.col("role") == "assistant") & ~F.col("has_tool_calls")).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query("JON_10_JON_11_FLT_14_results_to_tasks", "SELECT l.doc_id, d.lang, d.source FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 0")
def jon_10(spark, d):
    failed = table(spark, d, "labels").where("quality = 0").select("doc_id")
    return failed.join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")

"""Streaming queries, run to the end of what there is, and functions that need Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs
from ..sources.scratch import scratch
from ..streaming import loop
from .registry import query
from .views import table


def stream(spark, d, tab="events"):
    schema = spark.read.parquet(f"{d}/{tab}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{tab}.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("STM_01_streamed_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stm_01(spark, d):
    got = loop.run_once(loop.tumbling(stream(spark, d), "ts", "1 day", "1 hour", ["event_type"], "value"), "complete")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("STM_beyond_sliding_window", """SELECT strftime(s, '%Y-%m-%d %H') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts + INTERVAL 12 HOUR) - INTERVAL 12 HOUR]) AS s
FROM events) GROUP BY 1""")
def stm_slide(spark, d):
    got = loop.run_once(loop.sliding(stream(spark, d), "ts", "1 day", "12 hours", "1 hour", []), "complete")
    return got.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


@query("STM_beyond_session_window", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS
(SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, CAST(s - 1 AS BIGINT) AS nth, count(*) AS n FROM s
GROUP BY 1, 2""")
def stm_session(spark, d):
    """Sessions of a user with gaps under six hours; the same frame also runs on a stream."""
    from pyspark.sql import Window
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = loop.sessions(e, "ts", "6 hours", "1 hour", ["user_id"])
    return got.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("start")) - 1).cast("long").alias("nth"), "n")


def request_log(spark, d):
    """A run a user, with two roles; clicks call, views answer the role's latest call, all else ticks."""
    from pyspark.sql import Window
    e = table(spark, d, "events")
    role = F.when(F.col("event_id") % 3 == 0, "speculator").otherwise("actor")
    kind = F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "view", "response").otherwise("tick")
    w = Window.partitionBy("run", "role").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    x = e.select(F.col("user_id").alias("run"), role.alias("role"), kind.alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("seq"))
    return x.withColumn("request_id", F.last(F.when(F.col("kind") == "call", F.col("seq").cast("string")), True).over(w))


SLICES = 4


def in_slices(spark, log):
    """The log as a stream of several batches, each with the rows of a stretch of time, and how late rows may be in it; a last row ends
    the stream's time."""
    path = scratch(spark)
    low, high = log.agg(F.min("ts"), F.max("ts")).first()
    late = int((high - low) / SLICES) + 2 if high is not None else 2  # files of one stretch may fall into two batches
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(SLICES if high is not None else 0):  # one after the other, so that files are read in the order of time
        inside = F.floor((F.col("ts") - low) / (late - 1)) == i
        log.where(inside).repartition(files).write.parquet(f"{path}/{i}")
    end = log.limit(1).withColumn("ts", F.lit((high or 0.0) + 3.0 * late + 1e6)).withColumn("kind", F.lit("tick"))
    end.write.parquet(f"{path}/{SLICES}")
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path), f"{late} seconds"


def ends(log):
    """With a shutdown of each role of a run behind its last row."""
    last = log.groupBy("run", "role").agg(F.max(F.struct("ts", "seq")).alias("x")).select("run", "role", F.lit("shutdown").alias("kind"), (F.col("x.ts") + 1.0).alias("ts"), (F.col("x.seq") + 1).alias("seq"), F.lit(None).cast("string").alias("request_id"))
    return log.unionByName(last)


@query("STM_03_STM_04_pending_requests")
def stm_03(spark, d):
    """As a stream over the log in stretches of time: state by run and role, applied by timers, cancelled by the shutdown."""
    stream, late = in_slices(spark, ends(request_log(spark, d)))
    return loop.run_once(loop.proposals(stream, 600.0, late))


@query("STM_03_STM_04_pending_requests_batch")
def stm_03_batch(spark, d):
    return loop.proposals_batch(ends(request_log(spark, d)), 600.0)


def call_log(spark, d):
    """A key for each remainder of the number in props by 40: each third event of a key asks, one in nine answers."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 9 == 4, "answer").when(F.col("event_id") % 3 == 0, "request").otherwise("tick")
    key = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(40)).cast("string")
    return e.select(key.alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("value")).where("kind <> 'tick'")


@query("STM_14_memo_in_flight", """WITH e AS (SELECT CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 40 AS VARCHAR) AS key, ts, event_id, event_id % 9 = 4 AS answers FROM events WHERE event_id % 3 = 0 OR event_id % 9 = 4),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM e), f AS (SELECT key, min(n) AS first FROM r WHERE NOT answers GROUP BY 1),
a AS (SELECT r.key, min(n) AS got FROM r JOIN f USING (key) WHERE answers AND n > first GROUP BY 1), v AS (SELECT r.key, got, 'a' || event_id AS value FROM a JOIN r ON r.key = a.key AND n = got)
SELECT r.key, CAST(event_id AS VARCHAR) AS request, CASE WHEN n = first THEN 'called' WHEN n < got THEN 'waited' ELSE 'cached' END AS outcome, value FROM r JOIN f USING (key) JOIN v USING (key) WHERE NOT answers""")
def stm_14_stream(spark, d):
    """As a stream over several batches: one call a key, however many ask for it meanwhile."""
    stream, late = in_slices(spark, call_log(spark, d))
    return loop.run_once(loop.in_order(stream, ["key"], loop.Memo(), late)).select("key", "request", "outcome", "value")


@query("STM_14_memo_with_failures")
def stm_14_failures(spark, d):
    """With failures, which release the key, and answers that live for a day."""
    log = call_log(spark, d).withColumn("kind", F.when((F.col("kind") == "answer") & (F.col("seq") % 2 == 0), "failure").otherwise(F.col("kind")))
    stream, late = in_slices(spark, log)
    return loop.run_once(loop.in_order(stream, ["key"], loop.Memo(86_400.0), late))


@query("STM_14_memoized_calls", "SELECT event_id, length(event_type) AS answer FROM events")
def stm_14(spark, d):
    call = lambda keys: keys.withColumn("answer", F.length("event_type").cast("long"))
    return udfs.memoized(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], call).select("event_id", "answer")


@query("FN_25_DB_11_calculate", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Error: invalid characters in expression' WHEN 1 THEN (p_size // 7) || '.0' WHEN 2 THEN (p_size * p_size * p_size) || '.0' WHEN 3 THEN 'Error: division by zero'
WHEN 4 THEN 'Error: ''int'' object is not callable' WHEN 5 THEN 'Error: int too large to convert to float' WHEN 6 THEN CAST(-p_size AS VARCHAR) || '.5' ELSE ((p_size + 2) * 3) || '.0' END AS out FROM part""")
def fn_25(spark, d):
    """A form of expression for each remainder of the key by 8."""
    n = F.col("p_size").cast("string")
    forms = ["x + %s", " %s // 7", "%s**3", "%s / (2 - 2)", "%s(3)", "9**9**%s9", "-%s - .5", "(%s + 2) * 3"]
    e = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        before, after = form.split("%s")
        e = F.when(F.col("p_partkey") % len(forms) == i, F.concat(F.lit(before), n, F.lit(after))).otherwise(e)
    return table(spark, d, "part").select("p_partkey", udfs.batched(udfs.calculate, "string")(e).alias("out"))


@query("FN_19_clean_escapes", "SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' é' WHEN 1 THEN ' 你' ELSE ' \\xff' END AS out FROM part")
def fn_19(spark, d):
    return table(spark, d, "part").select("p_partkey", udfs.batched(udfs.clean_escapes, "string")(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " \\xc3\\xa9").when(F.col("p_partkey") % 3 == 1, " \\xe4\\xbd\\xa0").otherwise(" \\xff"))).alias("out"))


@query("FN_26_lenient_json_lines", "SELECT p_partkey, '{\"a\": ' || p_size || '}' AS out FROM part")
def fn_26(spark, d):
    t = F.concat(F.lit("well:\n{\"a\":\n "), F.col("p_size").cast("string"), F.lit("}\nbye"))
    return table(spark, d, "part").select("p_partkey", udfs.batched(udfs.lenient_json, "string")(t).alias("out"))


@query("FN_35_affix_rule_parse", """SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'PFX' ELSE 'SFX' END AS kind, n_name[1] AS flag, CASE WHEN n_regionkey < 2 THEN '' ELSE lower(n_name[-1]) END AS strip, lower(n_name[1:3]) AS "add", '[^' || lower(n_name[2]) || ']' AS condition
FROM nation WHERE n_nationkey % 5 < 4""")
def fn_35(spark, d):
    """A rule a nation; every fifth line is a header, which is none."""
    from ..sources.files import affix_rules
    c = lambda i, n=1: F.substring("n_name", i, n)
    kind = F.when(F.col("n_nationkey") % 2 == 0, "PFX").otherwise("SFX")
    strip = F.when(F.col("n_regionkey") < 2, "0").otherwise(F.lower(c(-1)))
    rule = F.concat(kind, F.lit(" "), c(1), F.lit("  "), strip, F.lit(" "), F.lower(c(1, 3)), F.lit("/X ["), F.lit("^"), F.lower(c(2)), F.lit("]"))
    return affix_rules(table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 5 == 4, F.concat(kind, F.lit(" "), c(1), F.lit(" Y 1"))).otherwise(rule).alias("value")))


@query("UDF_01_parallel_map", "SELECT event_id, k * 2 AS out FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def udf_01(spark, d):
    import json
    return udfs.parallel_map(table(spark, d, "events").select("event_id", "props"), lambda r: json.loads(r["props"])["k"] * 2, "out", "long", ["event_id"])


@query("UDF_02_FLT_18_parallel_filter", "SELECT event_id FROM events WHERE event_type LIKE '%i%'")
def udf_02(spark, d):
    return udfs.parallel_filter(table(spark, d, "events").select("event_id", "event_type"), lambda x: "i" in x, "event_type").select("event_id")


@query("UDF_03_UDF_04_recorded_response", "SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS response FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey")
def udf_03(spark, d):
    responses = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("response"))
    return udfs.recorded(table(spark, d, "orders").select("o_orderkey", "o_custkey"), responses, ["o_custkey"], "none").select("o_orderkey", "response")


@query("UDF_06_SRT_13_router", "SELECT p_partkey AS id, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' WHEN p_size <= 45 THEN 'large' END AS model FROM part")
def udf_06(spark, d):
    models = spark.createDataFrame([("large", 45, 0), ("small", 10, 1), ("middle", 30, 2), ("other", 30, 3)], "model string, capability int, seq int")
    return udfs.routed(models, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("need")))


@query("UDF_07_tool_registry", "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN upper(n_name) || '!' WHEN n_regionkey < 4 THEN '' ELSE 'unknown tool sing' END AS answer FROM nation")
def udf_07(spark, d):
    """Calls by name: two known tools and an unknown one."""
    from ..operators.docdb import Tools
    t, n = Tools(), table(spark, d, "nation")
    t.add("shout", lambda df: df.select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("answer")), description="says it loudly")
    t.add("think", lambda df: df.select("n_nationkey", F.lit("").alias("answer")), description="does nothing")
    got = t.invoke("shout", n.where("n_regionkey < 2")).unionByName(t.invoke("think", n.where("n_regionkey in (2, 3)")))
    try:
        return t.invoke("sing", n)
    except KeyError as e:
        return got.unionByName(n.where("n_regionkey > 3").select("n_nationkey", F.lit(e.args[0]).alias("answer")))


@query("UDF_08_UDF_09_registry_and_wrappers", "SELECT n_nationkey, lower(n_name) AS n_name FROM nation WHERE n_regionkey = 1")
def udf_08(spark, d):
    r = udfs.Registry()
    r.register("nations", lambda: table(spark, d, "nation"), {"train": [lambda df: df.where("n_regionkey = 1"), lambda df: df.select("n_nationkey", F.lower("n_name").alias("n_name"))]})
    return r.make("nations-train")


@query("UDF_11_evaluation", "SELECT is_error, is_correct, count(*) AS n FROM (SELECT value > 80 AS is_error, value <= 80 AND event_type = 'click' AS is_correct FROM events) GROUP BY 1, 2")
def udf_11(spark, d):
    e = table(spark, d, "events").select("event_type", F.lit("click").alias("label"), F.when(F.col("value") > 80, "late").alias("error"))
    return udfs.evaluated(e, "event_type", "label", "error").groupBy("is_error", "is_correct").agg(F.count(F.lit(1)).alias("n"))


@query("UDF_12_record_kinds", "SELECT event_id, CASE event_type WHEN 'click' THEN 'classify' WHEN 'view' THEN 'generate' ELSE 'binary_classify' END AS kind FROM events")
def udf_12(spark, d):
    keys = F.when(F.col("event_type") == "click", F.array(F.lit("instruction"), F.lit("options"))).when(F.col("event_type") == "view", F.array(F.lit("instruction"), F.lit("text"))).otherwise(F.array(F.lit("instruction")))
    return table(spark, d, "events").select("event_id", udfs.kind_of_record(keys).alias("kind"))


@query("FLT_19_errors_dropped", "SELECT event_id FROM events WHERE event_type <> 'error'")
def flt_19(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").alias("error"))
    return udfs.without_errors(e, "error", "event_id").select("event_id")

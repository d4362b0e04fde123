"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import scoring as sc
from .registry import query
from .views import STEPS, steps, table

_ACT = "CASE WHEN move = 'error' THEN 'error' ELSE upper(substr(move, 1, 1)) || substr(move, 2) || '[' || (w % 2) || ']' END"
QA = f"""{STEPS}, qa0 AS (SELECT run_id AS sample, step AS pos, t, {_ACT} AS action FROM steps),
qa AS (SELECT *, list_filter([lower(lag(action, 1) OVER w), lag(action, 2) OVER w, lag(action, 3) OVER w], lambda x: x IS NOT NULL) AS cand FROM qa0 WINDOW w AS (PARTITION BY sample ORDER BY pos))"""


def qa(spark, d):
    s = steps(spark, d)
    action = F.when(F.col("move") == "error", "error").otherwise(F.concat(F.initcap("move"), F.lit("["), (F.col("w") % 2).cast("string"), F.lit("]")))
    s = s.select(F.col("run_id").alias("sample"), F.col("step").alias("pos"), "t", action.alias("action"))
    w = Window.partitionBy("sample").orderBy("pos")
    return s.withColumn("cand", F.array_compact(F.array(F.lower(F.lag("action", 1).over(w)), F.lag("action", 2).over(w), F.lag("action", 3).over(w))))


_NAME = "CASE WHEN strpos({0}, '[') > 0 THEN split_part({0}, '[', 1) END"


def _metric_sql(k: int, sparse: bool) -> str:
    same = f"({_NAME.format('x')}) IS NOT DISTINCT FROM ({_NAME.format('action')})" if sparse else "lower(x) = lower(action)"
    hit = f"coalesce(list_bool_or(list_transform({'cand[1:1]' if k == 1 else 'cand'}, lambda x: {same})), false)"
    return f"""WITH {QA}, h AS (SELECT sample, {_NAME.format('action')} AS kind, CAST({hit} AS INT) AS h FROM qa WHERE pos > 0),
m AS (SELECT sample, 'general' AS action, avg(h) AS accuracy FROM h GROUP BY 1 UNION ALL SELECT sample, kind, avg(h) FROM h WHERE kind IS NOT NULL GROUP BY 1, 2) """


def _metrics(spark, d, k, sparse=False):
    return sc.action_metrics(qa(spark, d), "sample", "pos", "action", "cand", k, sparse)


for _n, _k, _s in (("AGG_08_action_accuracy", 1, False), ("AGG_09_any_of_k", 3, False), ("FLT_07_sparse_equality", 3, True)):
    query(_n, _metric_sql(_k, _s) + "SELECT sample, action, round(accuracy, 6) AS accuracy FROM m")(
        lambda spark, d, k=_k, s=_s: _metrics(spark, d, k, s).select("sample", "action", F.round("accuracy", 6).alias("accuracy")))


@query("AGG_10_AGG_14_mean_over_samples", _metric_sql(3, False).replace("FROM qa WHERE pos > 0", "FROM qa WHERE pos > 0 AND sample % 7 <> 3") + "SELECT action, round(sum(accuracy) / (SELECT count(DISTINCT sample) FROM qa), 6) AS accuracy FROM m GROUP BY action")
def agg_10(spark, d):
    """Samples whose id leaves 3 mod 7 end with their first step: they have no scored pair and count as 0."""
    p = qa(spark, d).where("pos = 0 or sample % 7 <> 3")
    return sc.over_samples(sc.action_metrics(p, "sample", "pos", "action", "cand", 3), p).select("action", F.round("accuracy", 6).alias("accuracy"))


@query("AGG_11_FLT_09_search_time", f"WITH {QA} SELECT sample, round(coalesce(avg(t) FILTER (WHERE lower(action) LIKE '%view[%'), 0), 6) AS search_time FROM qa GROUP BY sample")
def agg_11(spark, d):
    return qa(spark, d).groupBy("sample").agg(F.round(F.coalesce(F.avg(F.when(F.lower("action").like("%view[%"), F.col("t"))), F.lit(0.0)), 6).alias("search_time"))


@query("AGG_12_AGG_13_metric_lists", f"""SELECT a.sample, a.action, a.accuracy AS top1, b.accuracy AS top3 FROM ({_metric_sql(1, False)} SELECT sample, action, round(accuracy, 6) AS accuracy FROM m) a JOIN
({_metric_sql(3, False)} SELECT sample, action, round(accuracy, 6) AS accuracy FROM m) b USING (sample, action)""")
def agg_12(spark, d):
    one = lambda k, c: _metrics(spark, d, k).select("sample", "action", F.round("accuracy", 6).alias(c))
    return one(1, "top1").join(one(3, "top3"), ["sample", "action"])


@query("AGG_15_average", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def agg_15(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("AGG_16_running_reward", f"WITH {STEPS} SELECT run_id, step, round(sum(t) OVER w, 4) AS total, round(avg(t) OVER w, 9) AS mean FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING)")
def agg_16(spark, d):
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps(spark, d).select("run_id", "step", F.round(F.sum("t").over(w), 4).alias("total"), F.round(F.avg("t").over(w), 9).alias("mean"))


@query("AGG_17_FLT_11_pass_hat_k", """WITH r AS (SELECT count(DISTINCT l_linenumber) AS n, avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS avg_reward FROM lineitem),
t AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY 1), x AS (SELECT c, n, avg_reward, unnest(range(1, n + 1)) AS k FROM t, r)
SELECT k, round(avg(CASE WHEN c < k THEN 0 ELSE CAST(factorial(CAST(c AS INT)) AS DOUBLE) / factorial(CAST(c - k AS INT)) / (CAST(factorial(CAST(n AS INT)) AS DOUBLE) / factorial(CAST(n - k AS INT))) END), 6) AS pass_hat,
       round(any_value(avg_reward), 6) AS avg_reward FROM x GROUP BY k""")
def agg_17(spark, d):
    """All orders, with as many trials as the run has line numbers, whatever number an order has of them."""
    got = sc.pass_hat(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R")
    return got.select("k", *[F.round(c, 6).alias(c) for c in ("pass_hat", "avg_reward")])


@query("AGG_17_pass_hat_many_trials")
def agg_17_many(spark, d):
    """Users as tasks and their events as trials: far more than 20, where factorials overflow."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(w).alias("trial"))
    return sc.pass_hat(e, "user_id", "trial", F.col("event_type") == "click").select("k", F.round("pass_hat", 9).alias("pass_hat"), F.round("avg_reward", 6).alias("avg_reward"))


@query("AGG_18_trial_count", "SELECT count(DISTINCT l_linenumber) AS trials FROM lineitem")
def agg_18(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_linenumber").alias("trials"))


@query("AGG_24_distribution", """WITH dom AS (SELECT unnest(['click', 'view', 'purchase', 'refund']) AS event_type), c AS (SELECT dom.event_type, count(e.event_id) AS n FROM dom LEFT JOIN events e USING (event_type) GROUP BY 1)
SELECT event_type, n, round(100 * CAST(n AS DOUBLE) / sum(n) OVER (), 2) AS percent FROM c""")
def agg_24(spark, d):
    return sc.distribution(table(spark, d, "events"), "event_type", ["click", "view", "purchase", "refund"])


@query("AGG_25_majority", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c)
SELECT user_id, event_type, n AS votes FROM r WHERE r = 1""")
def agg_25(spark, d):
    return sc.majority(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("AGG_26_unanimous", "SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS unanimous, min(l_returnflag) AS value FROM lineitem GROUP BY 1")
def agg_26(spark, d):
    return sc.unanimous(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("AGG_27_jury_share", """WITH v AS (SELECT user_id, CASE WHEN event_type LIKE '%up%' THEN 'up' WHEN event_type LIKE '%click%' THEN 'click' WHEN event_type LIKE '%chase%' THEN 'chase' END AS option FROM events),
d AS (SELECT user_id, unnest(['up', 'click', 'chase']) AS option FROM (SELECT DISTINCT user_id FROM v)), c AS (SELECT d.user_id, d.option, count(v.option) AS n FROM d LEFT JOIN v ON v.user_id = d.user_id AND v.option = d.option GROUP BY 1, 2)
SELECT user_id, option, round(CASE WHEN sum(n) OVER (PARTITION BY user_id) > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY user_id) ELSE 0 END, 6) AS share FROM c""")
def agg_27(spark, d):
    return sc.jury_share(table(spark, d, "events"), "event_type", ["up", "click", "chase"], ["user_id"]).select("user_id", "option", F.round("share", 6).alias("share"))


@query("AGG_28_token_usage", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens, count(*) AS calls FROM events GROUP BY ROLLUP (event_type)")
def agg_28(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"), F.count(F.lit(1)).alias("calls"))


_PAIR = "p AS (SELECT d.doc_id AS key, d.text AS pred, b.text AS truth FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)"
_NORM = "array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x NOT IN ('a', 'an', 'the', '')), ' ')"


def pairs(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("truth"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("pred"), (F.col("doc_id") % 40).alias("item_id")).join(b, "item_id")


@query("AGG_37_FN_03_SET_03_token_f1", f"""WITH {_PAIR}, n AS (SELECT key, list_filter(string_split({_NORM.format('pred')}, ' '), lambda x: x <> '') AS a, list_filter(string_split({_NORM.format('truth')}, ' '), lambda x: x <> '') AS b FROM p),
ca AS (SELECT key, tok, count(*) AS n FROM (SELECT key, unnest(a) AS tok FROM n) GROUP BY 1, 2), cb AS (SELECT key, tok, count(*) AS n FROM (SELECT key, unnest(b) AS tok FROM n) GROUP BY 1, 2),
c AS (SELECT ca.key, CAST(sum(least(ca.n, cb.n)) AS DOUBLE) AS c FROM ca JOIN cb USING (key, tok) GROUP BY 1)
SELECT n.key, round(coalesce(2 * c / (len(a) + len(b)), 0), 6) AS f1, round(coalesce(c / len(a), 0), 6) AS precision, round(coalesce(c / len(b), 0), 6) AS recall FROM n LEFT JOIN c USING (key)""")
def agg_37(spark, d):
    return sc.token_f1(pairs(spark, d), "key", "pred", "truth").select("key", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")])


@query("FN_01_normalize_answer", f"SELECT doc_id, md5({_NORM.format('text')}) AS out FROM documents")
def fn_01(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(fn.normalize_answer(F.col("text"))).alias("out"))


@query("FN_02_exact_match", f"WITH {_PAIR} SELECT key, CAST({_NORM.format('pred')} = {_NORM.format('truth')} AS INT) AS em FROM p")
def fn_02(spark, d):
    return pairs(spark, d).select("key", fn.exact_match(F.col("pred"), F.col("truth")).alias("em"))


@query("FN_04_label_match", "SELECT label, avg(CAST(label = doc_id % 2 AS INT)) AS reward FROM (SELECT doc_id, quality AS label FROM labels) GROUP BY 1")
def fn_04(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).groupBy("label").agg(F.avg((F.col("label") == F.col("doc_id") % 2).cast("int")).alias("reward"))


@query("FLT_06_skip_first", f"WITH {QA} SELECT sample, pos FROM qa WHERE pos > 0")
def flt_06(spark, d):
    return qa(spark, d).where("pos > 0").select("sample", "pos")


@query("FLT_08_any_match", f"WITH {QA} SELECT sample, pos FROM qa WHERE list_bool_or(list_transform(cand, lambda x: lower(x) = lower(action)))")
def flt_08(spark, d):
    return qa(spark, d).where(F.exists("cand", lambda x: F.lower(x) == F.lower("action"))).select("sample", "pos")


@query("FLT_10_failed", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.001")
def flt_10(spark, d):
    return table(spark, d, "lineitem").where("l_discount <= 0.001").select("l_orderkey", "l_linenumber")


@query("FLT_11_success", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F')::INT BETWEEN 1 - 1e-6 AND 1 + 1e-6")
def flt_11(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "F").cast("int").between(1 - 1e-6, 1 + 1e-6)).select("o_orderkey")


@query("JON_01_positional", f"""WITH {QA}, x AS (SELECT sample, pos, action FROM qa WHERE sample % 2 = 0), y AS (SELECT sample - 1 AS sample, pos, action AS other FROM qa WHERE sample % 2 = 1) SELECT
sample, pos, action, other FROM x JOIN y USING (sample, pos)""")
def jon_01(spark, d):
    q = qa(spark, d)
    return q.where("sample % 2 = 0").select("sample", "pos", "action").join(q.where("sample % 2 = 1").select((F.col("sample") - 1).alias("sample"), "pos", F.col("action").alias("other")), ["sample", "pos"])


@query("JON_02_positional_equal_length", f"""WITH {QA}, x AS (SELECT sample, count(*) AS n FROM qa GROUP BY 1) SELECT a.sample, a.n = b.n AS equal_length FROM x a JOIN x b ON b.sample = a.sample + 1 WHERE a.sample %
2 = 0""")
def jon_02(spark, d):
    """Full outer join on position: pairs of unequal length are told, not cut."""
    q = qa(spark, d)
    x = q.where("sample % 2 = 0").select("sample", "pos", F.lit(1).alias("a"))
    y = q.where("sample % 2 = 1").select((F.col("sample") - 1).alias("sample"), "pos", F.lit(1).alias("b"))
    got = x.join(y, ["sample", "pos"], "full").groupBy("sample").agg(F.count("a").alias("a"), F.count("b").alias("b"))
    return got.where("a > 0 and b > 0").select("sample", (F.col("a") == F.col("b")).alias("equal_length"))


_SAMPLES = "SELECT conv_id, turn, role, text FROM conversations"
for _n, _sql in (("single", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS answer FROM events GROUP BY user_id HAVING arg_min(event_type, (ts, event_id)) <> 'error'"),
                 ("retry", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS answer FROM events WHERE event_type <> 'error' GROUP BY user_id"),
                 ("majority", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS f FROM events WHERE event_type <> 'error' GROUP BY 1, 2) SELECT user_id, event_type AS answer FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1"),
                 ("unanimous", "SELECT user_id, min(event_type) AS answer FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(DISTINCT event_type) = 1")):
    @query(f"UDF_05_{_n}", _sql)
    def udf_05(spark, d, how=_n):
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = table(spark, d, "events").select("user_id", F.col("event_type").alias("answer"), F.when(F.col("event_type") == "error", "failed").alias("error"), (F.row_number().over(w) - 1).alias("attempt"))
        return sc.sampled(e, ["user_id"], "answer", "error", "attempt", how)

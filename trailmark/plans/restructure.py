"""Projection, set and sort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.udfs import batched, python_round
from ..operators.docdb import constant_tools
from ..operators.similarity import indexed, nearest
from .registry import query
from .views import STEPS, steps, table


@query("PRJ_02_rename", f"WITH {STEPS} SELECT run_id AS run, step, move AS current_move, t AS time_taken_current_agent FROM steps")
def prj_02(spark, d):
    return steps(spark, d).select(F.col("run_id").alias("run"), "step", F.col("move").alias("current_move"), F.col("t").alias("time_taken_current_agent"))


@query("PRJ_04_nested_to_columns", "SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS \"view\" FROM events GROUP BY 1")
def prj_04(spark, d):
    g = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    return g.select("user_id", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@query("PRJ_05_records_to_columns", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS other FROM events")
def prj_05(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long, other string").alias("r")).select("event_id", "r.*")


@query("PRJ_06_drop_and_merge", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def prj_06(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", F.struct("r_name").alias("dates"))
    return n.select("*", "dates.*").drop("dates")


@query("SET_04_key_union", """SELECT coalesce(a.k, b.k) AS k, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT l_returnflag || l_linestatus AS k, count(*) AS n FROM lineitem WHERE l_quantity
< 2 GROUP BY 1) a FULL JOIN (SELECT l_returnflag || l_linestatus AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1) b ON a.k = b.k""")
def set_04(spark, d):
    one = lambda cond, n: table(spark, d, "lineitem").where(cond).groupBy(F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.count(F.lit(1)).alias(n))
    return one("l_quantity < 2", "a").join(one("l_quantity > 48", "b"), "k", "full").select("k", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"))


@query("SET_03_intersect_all", "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def set_03(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_suppkey").intersectAll(li.where("l_returnflag = 'A'").select("l_suppkey"))


@query("SET_05_union_membership", "SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 1 UNION SELECT p_brand FROM part WHERE p_size = 2)")
def set_05(spark, d):
    p = table(spark, d, "part")
    u = p.where("p_size = 1").select("p_brand").union(p.where("p_size = 2").select("p_brand")).distinct()
    return p.join(u, "p_brand", "left_semi").select("p_partkey")


@query("SET_beyond_except_all", "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def set_06(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_suppkey").exceptAll(li.where("l_returnflag = 'A'").select("l_suppkey"))


@query("SRT_04_sorted_items", "SELECT l_orderkey, array_to_string(list_sort(list(l_partkey)), ',') AS items FROM lineitem GROUP BY 1")
def srt_04(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_partkey")).cast("array<string>"), ",").alias("items"))


@query("SRT_05_limit", "SELECT doc_id FROM labels WHERE quality = 0 ORDER BY doc_id LIMIT 10")
def srt_05(spark, d):
    return table(spark, d, "labels").where("quality = 0").select("doc_id").orderBy("doc_id").limit(10)


@query("SRT_06_SRT_07_SRT_08_seeded_sample", "SELECT conv_id FROM (SELECT DISTINCT conv_id, md5('7/' || conv_id) AS h FROM conversations) ORDER BY h LIMIT 20")
def srt_06(spark, d):
    """A seeded sample in an order that both engines share; a list of ids or a range is a plain filter."""
    c = table(spark, d, "conversations").select("conv_id").distinct()
    return c.orderBy(F.md5(F.concat(F.lit("7/"), F.col("conv_id").cast("string")))).limit(20)


@query("SRT_07_id_range", "SELECT conv_id, turn FROM conversations WHERE conv_id >= 5 AND conv_id < 25 AND conv_id IN (5, 6, 7, 20)")
def srt_07(spark, d):
    return table(spark, d, "conversations").where("conv_id >= 5 and conv_id < 25").where(F.col("conv_id").isin(5, 6, 7, 20)).select("conv_id", "turn")


@query("SRT_10_top_similar", """WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT q, vec_id, round(list_cosine_similarity(e::DOUBLE[],
embedding::DOUBLE[]), 6) AS s FROM q, embeddings WHERE vec_id <> q) SELECT q, vec_id, s FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS r
FROM c) WHERE r <= 5""")
def srt_10(spark, d):
    """The five nearest of every vector whose id is divisible by 20, a top-k report."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)


@query("SRT_10_top_similar_indexed")
def srt_10_indexed(spark, d):
    """The same by an inverted file, which isn't exact: recall is measured in a test."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return indexed(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)


@query("SRT_11_first_of_list", "SELECT conv_id, arg_min(role, turn) AS role FROM conversations GROUP BY 1")
def srt_11(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("x")).select("conv_id", "x.role")


@query("JON_18_fallback_merge", """WITH r AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT * FROM orders WHERE o_orderstatus = 'X') SELECT o_orderkey FROM p UNION ALL SELECT o_orderkey
FROM r WHERE NOT EXISTS (SELECT 1 FROM p)""")
def jon_18(spark, d):
    """The fallback's rows count only if the first table has none at all."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    first = o.where("o_orderstatus = 'X'")
    any_row = first.limit(1).agg(F.count(F.lit(1)).alias("n"))  # one row
    return first.select("o_orderkey").unionByName(o.where("o_orderstatus = 'F'").crossJoin(F.broadcast(any_row)).where("n = 0").select("o_orderkey"))


@query("FN_money_rounding", "SELECT p_partkey, round(p_retailprice * 0.5, 2) AS out FROM part ")
def fn_money(spark, d):
    """Rounding of the exact binary value; on prices without ties it equals the decimal rule."""
    return table(spark, d, "part").select("p_partkey", batched(python_round, "double")(F.col("p_retailprice") * 0.5).alias("out"))


@query("DB_12_DB_16_DB_17_constants", """SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'think' WHEN 'user' THEN 'transfer_to_human_agents' END AS tool,
CASE role WHEN 'assistant' THEN '' WHEN 'user' THEN 'Transfer successful' ELSE 'Error: unknown tool' END AS answer, role = 'user' AS ends FROM conversations""")
def db_12(spark, d):
    """Tools whose answer doesn't depend on data; the second one ends the episode."""
    tool = F.when(F.col("role") == "assistant", "think").when(F.col("role") == "user", "transfer_to_human_agents")
    return constant_tools(table(spark, d, "conversations").select("conv_id", "turn", tool.alias("tool")), "tool")

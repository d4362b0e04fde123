"""Settlement queries. Conversations play observation logs; line items play bids, votes and cards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import settlement as op
from .registry import query
from .views import table

_M = "m AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'PROMPT' WHEN 'assistant' THEN 'BOARD' ELSE 'PLAYER_ACTION' END AS kind, role, md5(text) AS text FROM conversations)"


def messages(spark, d):
    kind = F.when(F.col("role") == "system", "PROMPT").when(F.col("role") == "assistant", "BOARD").otherwise("PLAYER_ACTION")
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), "role", F.md5("text").alias("text"))


@query("GME_01_fan_out", f"WITH {_M}, p AS (SELECT unnest([0, 1]) AS player) SELECT conv_id, turn, player FROM m, p WHERE turn % 3 - 1 = -1 OR turn % 3 - 1 = player")
def gme_01(spark, d):
    m = messages(spark, d).withColumn("to", F.col("turn") % 3 - 1)
    players = m.select("conv_id").distinct().withColumn("player", F.explode(F.array(F.lit(0), F.lit(1))))
    return op.fan_out(m, players, "conv_id", "to").select("conv_id", "turn", "player")


@query("GME_02_drained", f"""WITH {_M} SELECT conv_id, turn, CAST(coalesce(sum(CASE WHEN kind = 'BOARD' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING
AND 1 PRECEDING), 0) AS BIGINT) AS read_no FROM m""")
def gme_02(spark, d):
    return op.drained(messages(spark, d), "conv_id", "turn", F.col("kind") == "BOARD").select("conv_id", "turn", "read_no")


@query("GME_03_history", f"WITH {_M} SELECT conv_id, md5(string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn)) AS history FROM m GROUP BY 1")
def gme_03(spark, d):
    return op.history(messages(spark, d), "conv_id", "turn", F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text"))).select("conv_id", F.md5("history").alias("history"))


@query("GME_04_GME_09_first_and_last", f'WITH {_M} SELECT conv_id, arg_min(text, turn) AS "first", arg_max(text, turn) AS "last" FROM m GROUP BY 1')
def gme_04(spark, d):
    return op.first_and_last(messages(spark, d), "conv_id", "turn", "text")


@query("GME_05_first_prompt_last_board", f"WITH {_M} SELECT conv_id, arg_min(text, turn) FILTER (WHERE kind = 'PROMPT') AS prompt, arg_max(text, turn) FILTER (WHERE kind = 'BOARD') AS board FROM m GROUP BY 1")
def gme_05(spark, d):
    return op.prompt_and_board(messages(spark, d), "conv_id", "turn", "kind", "text")


@query("GME_06_FLT_22_excluded_types", f"WITH {_M} SELECT conv_id, turn, kind FROM m WHERE kind NOT IN ('PLAYER_ACTION', 'GAME_ADMIN')")
def gme_06(spark, d):
    return messages(spark, d).where(~F.col("kind").isin("PLAYER_ACTION", "GAME_ADMIN")).select("conv_id", "turn", "kind")


@query("GME_07_last_prompt_and_board", f"""WITH {_M} SELECT conv_id, arg_max(text, turn) FILTER (WHERE kind = 'PROMPT') AS prompt, arg_max(text, turn) FILTER (WHERE kind = 'BOARD') AS board FROM m GROUP BY 1
HAVING prompt IS NOT NULL AND board IS NOT NULL""")
def gme_07(spark, d):
    return op.prompt_and_board(messages(spark, d), "conv_id", "turn", "kind", "text", last_prompt=True).where("prompt is not null and board is not null")


@query("GME_08_last_board_only", f"WITH {_M}, l AS (SELECT *, max(CASE WHEN kind = 'BOARD' THEN turn END) OVER (PARTITION BY conv_id) AS b FROM m) SELECT conv_id, turn, kind FROM l WHERE kind <> 'BOARD' OR turn = b")
def gme_08(spark, d):
    return op.last_board_only(messages(spark, d), "conv_id", "turn", "kind").select("conv_id", "turn", "kind")


@query("GME_10_skip_first", f"WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM m) SELECT conv_id, turn FROM r WHERE r > 1")
def gme_10(spark, d):
    return messages(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("r > 1").select("conv_id", "turn")


@query("GME_11_winner_rewards", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS reward FROM orders")
def gme_11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0).alias("reward"))


_AUC = "a AS (SELECT l_partkey, max(l_quantity) AS top FROM lineitem GROUP BY 1), w AS (SELECT l_partkey, top, count(*) AS n, min(l_suppkey) AS winner FROM lineitem JOIN a USING (l_partkey) WHERE l_quantity = top AND top > 0 GROUP BY 1, 2)"


@query("GME_12_sealed_bid_auction", f"WITH {_AUC} SELECT l_partkey, winner, top AS price FROM w WHERE n = 1")
def gme_12(spark, d):
    return op.auction(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


@query("GME_12_auction_net_worth", f"""WITH {_AUC}, v AS (SELECT winner, sum(top) AS spent, round(sum(p_retailprice), 4) AS value FROM w JOIN part ON p_partkey = l_partkey WHERE n = 1 GROUP BY 1) SELECT
winner, spent, value, round(value - spent, 4) AS profit, round(1000 - spent + value, 4) AS net_worth FROM v""")
def gme_12b(spark, d):
    sold = op.auction(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")
    v = sold.join(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).groupBy("winner").agg(F.sum("price").alias("spent"), F.round(F.sum("p_retailprice"), 4).alias("value"))
    return v.select("winner", "spent", "value", F.round(F.col("value") - F.col("spent"), 4).alias("profit"), F.round(1000 - F.col("spent") + F.col("value"), 4).alias("net_worth"))


@query("GME_12_argmax_or_draw", """WITH s AS (SELECT l_orderkey, l_suppkey, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) SELECT l_orderkey, top, CASE WHEN count(*) = 1
THEN min(l_suppkey) END AS winner FROM s WHERE l_quantity = top GROUP BY 1, 2""")
def gme_12c(spark, d):
    return op.argmax_or_draw(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_quantity")


@query("GME_13_public_goods", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(20 - l_quantity / 50 + 1.5 * sum(l_quantity / 50) OVER (PARTITION BY l_orderkey) / count(*) OVER (PARTITION
BY l_orderkey), 6) AS payoff FROM lineitem""")
def gme_13(spark, d):
    m = table(spark, d, "lineitem").withColumn("given", F.col("l_quantity") / 50)
    return op.public_goods(m, ["l_orderkey"], "given", 20.0, 1.5).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round("payoff", 6).alias("payoff"))


@query("GME_14_market_entry", """WITH e AS (SELECT *, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS BIGINT) AS entrants FROM lineitem) SELECT l_orderkey,
l_linenumber, l_partkey, l_suppkey, entrants, CASE WHEN l_returnflag <> 'R' THEN 5.0 WHEN entrants <= 2 THEN 10.0 ELSE -4.0 END::DOUBLE AS payoff FROM e""")
def gme_14(spark, d):
    return op.market_entry(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", 2, 10.0, -4.0, 5.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "entrants", "payoff")


@query("GME_15_plurality", """WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_returnflag AS chosen FROM (SELECT *, row_number() OVER
(PARTITION BY l_orderkey ORDER BY n DESC, md5('7/' || l_returnflag)) AS r FROM c) WHERE r = 1""")
def gme_15(spark, d):
    return op.plurality(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", 7)


@query("GME_16_veto_quorum", """WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS yes, bool_and(l_linenumber <> 1 OR l_returnflag <> 'R') AS ok, bool_or(l_linenumber = 1) AS has FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN has THEN ok AND yes >= n - 1 ELSE 2 * yes > n END AS passed, yes, n FROM g""")
def gme_16(spark, d):
    return op.quorum(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_returnflag") != "R", F.col("l_linenumber") == 1)


@query("GME_17_deal_scores", """WITH g AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS total, max(l_quantity) * 3 AS most, bool_and(l_returnflag <> 'R') AS al FROM lineitem GROUP BY 1, 2), t AS (SELECT *, total + CASE WHEN al THEN 10 ELSE 0 END AS tt FROM g)
SELECT l_orderkey, l_suppkey, tt AS total, CASE WHEN tt >= 20 THEN floor(least(1.0, tt / most) * 100) ELSE 0 END::BIGINT AS reward FROM t""")
def gme_17(spark, d):
    return op.deal_scores(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_quantity", F.col("l_quantity") * 3, F.lit(20), F.col("l_returnflag") != "R")


@query("GME_18_field_majority", """WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_discount > l_tax) AS a_wins, count(*) FILTER (WHERE l_tax > l_discount) AS b_wins FROM lineitem GROUP BY 1)
SELECT l_orderkey, a_wins, b_wins, CASE WHEN a_wins >= n // 2 + 1 THEN 'a' WHEN b_wins >= n // 2 + 1 THEN 'b' END AS early, CASE WHEN a_wins > b_wins THEN 'a' WHEN b_wins > a_wins THEN 'b' END AS winner FROM g""")
def gme_18(spark, d):
    return op.field_majority(table(spark, d, "lineitem"), ["l_orderkey"], "l_discount", "l_tax")


@query("GME_19_two_thirds", """WITH t AS (SELECT l_orderkey, l_suppkey, l_quantity, avg(l_quantity) OVER (PARTITION BY l_orderkey) * 2 / 3 AS target FROM lineitem) SELECT l_orderkey, round(max(target),
6) AS target, arg_min(l_suppkey, (round(abs(l_quantity - target), 9), l_suppkey)) AS winner FROM t GROUP BY 1""")
def gme_19(spark, d):
    return op.two_thirds(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_quantity")


@query("GME_20_bandit", """WITH a AS (SELECT l_suppkey, avg(l_discount) AS mean, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, round(mean, 6) AS mean, n, round((SELECT max(mean) FROM a)
- mean, 6) AS regret FROM a""")
def gme_20(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("mean"), F.count(F.lit(1)).alias("n"))
    top = a.agg(F.max("mean").alias("top"))  # one row
    return a.crossJoin(F.broadcast(top)).select("l_suppkey", F.round("mean", 6).alias("mean"), "n", F.round(F.col("top") - F.col("mean"), 6).alias("regret"))


@query("GME_21_trick_winner", "SELECT l_orderkey, arg_max(l_suppkey, (l_returnflag = 'R', l_returnflag = 'A', l_quantity, l_suppkey)) AS winner FROM lineitem GROUP BY 1")
def gme_21(spark, d):
    c = table(spark, d, "lineitem").withColumn("trump", F.lit("R")).withColumn("lead", F.lit("A"))
    return op.trick(c, ["l_orderkey"], "l_suppkey", "l_returnflag", "l_quantity", "trump", "lead")


def hands(spark, d):
    """Seven cards a hand from the part table: rank and suit follow from the key."""
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 7).alias("hand"), ((F.col("p_partkey") % 7) * 7 + F.col("p_size") * 3).alias("x"))
    return p.select("hand", (F.pmod(F.col("x"), F.lit(13)) + 2).alias("rank"), F.pmod(F.col("x"), F.lit(4)).cast("string").alias("suit"))


@query("GME_22_poker_category")
def gme_22(spark, d):
    return op.poker(hands(spark, d), ["hand"], "rank", "suit").select("hand", "category", F.array_join(F.col("kickers").cast("array<string>"), ",").alias("kickers"))


@query("GME_23_golf", """WITH c AS (SELECT l_orderkey, l_linenumber % 3 AS col, CASE WHEN min(l_quantity) = max(l_quantity) AND count(*) > 1 THEN 0 ELSE sum(l_quantity) END AS s FROM lineitem
GROUP BY 1, 2) SELECT l_orderkey, sum(s) AS score FROM c GROUP BY 1""")
def gme_23(spark, d):
    return op.golf(table(spark, d, "lineitem").withColumn("col", F.col("l_linenumber") % 3), ["l_orderkey"], "col", "l_quantity")


@query("GME_24_secretary", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity = max(l_quantity) OVER (PARTITION BY l_orderkey) AS INT) AS reward FROM lineitem")
def gme_24(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") == F.max("l_quantity").over(Window.partitionBy("l_orderkey"))).cast("int").alias("reward"))


_WORDS = "w AS (SELECT DISTINCT substr(md5(CAST(p_partkey AS VARCHAR)), 1, 3) AS w FROM part)"
_EDGES = "e AS (SELECT x.w AS a, y.w AS b FROM w x JOIN w y ON x.w <> y.w AND CAST(substr(x.w, 1, 1) <> substr(y.w, 1, 1) AS INT) + CAST(substr(x.w, 2, 1) <> substr(y.w, 2, 1) AS INT) + CAST(substr(x.w, 3, 1) <> substr(y.w, 3, 1) AS INT) = 1)"


def words(spark, d):
    return table(spark, d, "part").select(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 3).alias("w")).distinct()


@query("JON_15_GME_25_word_neighbours", f"WITH {_WORDS}, {_EDGES} SELECT a, count(*) AS n FROM e GROUP BY 1")
def jon_15(spark, d):
    return op.neighbours(words(spark, d), "w").groupBy("a").agg(F.count(F.lit(1)).alias("n"))


@query("GME_25_word_ladder", f"""WITH {_WORDS}, {_EDGES}, h1 AS (SELECT a AS source, b AS target, a || '>' || b AS path FROM e),
h2 AS (SELECT source, b AS target, min(path || '>' || b) AS path FROM h1 JOIN e ON a = target WHERE source <> b GROUP BY 1, 2)
SELECT source, target, 1 AS hops, path FROM h1 UNION ALL SELECT source, target, 2, path FROM h2 ANTI JOIN h1 USING (source, target)""")
def gme_25(spark, d):
    """Ladders of one or two steps from every word."""
    w = words(spark, d)
    return op.ladders(op.neighbours(w, "w"), w.select(F.col("w").alias("source")), 1, 2).withColumn("path", F.array_join("path", ">"))


_LADDER_WORDS = "w AS (SELECT DISTINCT substr(md5(CAST(p_partkey AS VARCHAR)), 1, 3 + p_partkey % 3) AS w FROM part)"
_WILD = "k AS (SELECT w, left(w, i - 1) || '*' || substr(w, i + 1) AS k FROM w, range(1, 6) AS r(i) WHERE i <= len(w)), e AS (SELECT DISTINCT x.w AS a, y.w AS b FROM k x JOIN k y ON x.k = y.k AND x.w <> y.w)"


def _hop(n: int) -> str:
    before = " UNION ALL ".join(f"SELECT source, target FROM h{i}" for i in range(1, n))
    return f"h{n} AS (SELECT * FROM (SELECT source, b AS target, min(list_append(path, b)) AS path FROM h{n - 1} JOIN e ON a = target WHERE source <> b GROUP BY 1, 2) ANTI JOIN ({before}) USING (source, target))"


@query("GME_25_word_ladder_far", f"""WITH {_LADDER_WORDS}, {_WILD}, h1 AS (SELECT a AS source, b AS target, [a, b] AS path FROM e), {", ".join(_hop(n) for n in (2, 3, 4))}
SELECT source, target, {" UNION ALL SELECT source, target, ".join(f"{n} AS hops, array_to_string(path, '>') AS path FROM h{n}" for n in (3, 4))}""")
def gme_25_far(spark, d):
    """Ladders of three or four steps between words of three to five letters."""
    length = (3 + F.col("p_partkey") % 3).cast("int")
    w = table(spark, d, "part").select(F.substring(F.md5(F.col("p_partkey").cast("string")), F.lit(1), length).alias("w")).distinct()
    return op.word_ladders(w, "w", 3, 4).withColumn("path", F.array_join("path", ">"))


@query("WIN_11_rank_rewards", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r FROM lineitem), m AS (SELECT *, max(r) OVER (PARTITION BY l_orderkey) AS n FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN n > 1 THEN -1 + 2.0::DOUBLE * (r - 1) / (n - 1) ELSE 0 END, 6) AS reward FROM m""")
def win_11(spark, d):
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return op.rank_rewards(c, ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("reward", 6).alias("reward"))


@query("WIN_12_carry_over_pot", """WITH e AS (SELECT user_id, event_id, value, event_type = 'purchase' AS won, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM events)
SELECT user_id, max(CASE WHEN won THEN event_id END) AS event_id, round(sum(value), 4) AS pot FROM e GROUP BY user_id, island HAVING bool_or(won)""")
def win_12(spark, d):
    return op.carry_over(table(spark, d, "events"), "user_id", "event_id", "value", F.col("event_type") == "purchase").withColumn("pot", F.round("pot", 4))


@query("SRT_12_best_option", """WITH r AS (SELECT l_orderkey, l_returnflag, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC, l_partkey) AS r FROM
lineitem) SELECT l_orderkey, l_returnflag, l_partkey, l_quantity FROM r WHERE r = 1""")
def srt_12(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min(F.struct((-F.col("l_quantity")).alias("q"), F.col("l_partkey").alias("p"))).alias("x"))
    return g.select("l_orderkey", "l_returnflag", F.col("x.p").alias("l_partkey"), (-F.col("x.q")).alias("l_quantity"))

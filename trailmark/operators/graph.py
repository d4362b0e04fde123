"""Connected components over links of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every end of a link: root is the least node reachable. Large-star and small-star steps by turns: each node
    links its larger neighbours, then its smaller ones, to the least it knows. Every round is a written table, so no plan grows
    and lost executors cost a round at most; a hub's links are spread over its neighbours, not gathered."""
    down = lambda df, x, y: df.select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u"))
    now = kept(links.select(F.col(a).alias("x"), F.col(b).alias("y")).select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("u")).distinct())
    before = None
    for _ in range(rounds):
        every = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = every.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        star = every.join(least, "v").where("u > v and u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        alone = now.where("v = u")
        star = star.unionByName(alone).distinct()
        low = star.groupBy("v").agg(F.min("u").alias("m"))
        small = star.join(low, "v").where("u <> m").select("u", "m")
        now = kept(down(small.withColumnsRenamed({"u": "p", "m": "q"}), "p", "q").unionByName(low.select("v", F.col("m").alias("u"))).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    both = now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")))
    return both.groupBy("node").agg(F.min("root").alias("root"))

"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has `cells` equal cells; a row's cell is a hash of its key, and each virtual node sits on the border of a cell, so
all rows of a cell have the same home. Only the number of rows in each cell reaches the driver (`cells` numbers, however
many rows there are), counted from the key column alone. There the overflow of full shards is walked clockwise, which gives
a plan of intervals of ranks within cells; rows find their shard and slot by rank. A row moves only if its home shard is full.

A cell with over HOT_SHARE of all rows (one key, or null keys) is ranked in HOT_PARTS parts by a hash of size and checksum,
each by a task of its own, and the parts' counts give the rank at which each begins: at most HOT_PARTS / HOT_SHARE numbers.

Defined cases: a null key hashes as a value of its own; a null text has no bytes; equal rows (the same key, size and
checksum) are counted together, get different slots and are written out RANGE at a time; texts of any length are only
measured; no rows give no rows; further columns, of whatever names, are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bare, table, written

CELLS = 1 << 16
VNODES = 100
SHARDS = 40
HOT_SHARE = 1 / 1024
HOT_PARTS = 64
RANGE = 10_000


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(last cell of its arc, shard) of each virtual node, in ring order; nodes that share a cell stay in shard order."""
    def at(s: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % cells

    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, load: float | None) -> list[int]:
    """load None: counts differ by one at most, else the usual bound ceil(load * rows / shards)."""
    if load is None:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    if load < 1:
        raise ValueError("a load factor under 1 can't hold all rows")
    return [-int(-Fraction(str(load)) * rows // shards)] * shards


def walk(counts: dict[int, int], shards: int, vnodes: int, cells: int, load: float | None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (cell, first rank, last rank + 1, shard, slot of the first rank).

    Home rows are placed first, in ring order; then what overflowed continues clockwise to the next node whose shard has
    room. The pieces are as many as the cells with rows plus those that a full shard cut in two.
    """
    nodes = ring(shards, vnodes, cells)
    ends, cap, held = [e for e, _ in nodes], capacities(sum(counts.values()), shards, load), [0] * shards
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(cell: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, cap[shard] - held[shard])
        if n > 0:
            pieces.append((cell, lo, lo + n, shard, held[shard]))
            held[shard] += n
        return lo + max(n, 0)

    over = []
    for cell in sorted(counts):
        node = bisect_left(ends, cell) % len(nodes)
        lo = put(cell, 0, counts[cell], nodes[node][1])
        if lo < counts[cell]:
            over.append((node, cell, lo))
    free = [nodes[i][1] for i in range(len(nodes))]
    skip = list(range(1, len(nodes) + 1))  # next node to try, with full ones compressed away

    def following(node: int) -> int:
        path, i = [], skip[node] % len(nodes)
        while cap[free[i]] <= held[free[i]]:
            path.append(i)
            i = skip[i] % len(nodes)
        for p in [node, *path]:
            skip[p] = i
        return i

    for node, cell, lo in over:
        while lo < counts[cell]:
            node = following(node)
            lo = put(cell, lo, counts[cell], free[node])
    return pieces


def assign(spark: SparkSession, df: DataFrame, key: str, text: str, shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS, load: float | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of each row of df."""
    cell_of = F.pmod(F.xxhash64("k"), F.lit(cells)).cast("int").alias("cell")
    counts = {r["cell"]: r["count"] for r in bare(df, key).toDF("k").groupBy(cell_of).count().collect()}  # at most `cells` rows
    pieces = pd.DataFrame(walk(counts, shards, vnodes, cells, load), columns=["cell", "lo", "hi", "shard", "at"])
    plan = F.broadcast(spark.createDataFrame(pieces, "cell int, lo long, hi long, shard int, at long"))  # at most cells + shards * vnodes + shards rows
    most = HOT_SHARE * sum(counts.values())
    hot = [c for c, n in counts.items() if n > most]
    part = F.when(F.col("cell").isin(hot), F.pmod(F.xxhash64("size", "crc"), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)
    text_of = F.coalesce(F.col("t"), F.lit(""))
    rows = bare(df, key, text).toDF("k", "t").select("k", (F.octet_length(text_of) + F.lit(16)).cast("long").alias("size"), F.crc32(F.encode(text_of, "UTF-8")).alias("crc"))
    kinds = rows.groupBy("k", "size", "crc").agg(F.count(F.lit(1)).alias("n")).select("*", cell_of).withColumn("part", part)
    begins = F.lit(0).cast("long")
    if hot:
        kinds = written(spark, kinds, "kinds")
        sums = {(r["cell"], r["part"]): r["n"] for r in kinds.where(F.col("cell").isin(hot)).groupBy("cell", "part").agg(F.sum("n").alias("n")).collect()}  # HOT_PARTS / HOT_SHARE rows at most
        first = [(c, p, sum(sums.get((c, q), 0) for q in range(p))) for c in hot for p in range(HOT_PARTS)]
        kinds = kinds.join(F.broadcast(spark.createDataFrame(first, "cell int, part int, begins long")), ["cell", "part"], "left")
        begins = F.coalesce("begins", begins)
    upto = F.sum("n").over(Window.partitionBy("cell", "part").orderBy("k", "size", "crc").rowsBetween(Window.unboundedPreceding, 0))
    ranked = kinds.withColumn("upto", upto + begins).withColumn("from", F.col("upto") - F.col("n"))
    met = ranked.join(plan, "cell").where((F.col("from") < F.col("hi")) & (F.col("lo") < F.col("upto")))
    met = met.withColumn("first", F.greatest("from", "lo") - F.col("lo") + F.col("at")).withColumn("last", F.least("upto", "hi") - F.col("lo") + F.col("at") - 1)
    met = met.withColumn("step", F.explode(F.sequence("first", "last", F.lit(RANGE).cast("long"))))
    slots = F.sequence("step", F.least(F.col("step") + (RANGE - 1), "last"))
    return met.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", F.explode(slots).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = assign(spark, table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2_sharding}
SQL: dict[str, str] = {}

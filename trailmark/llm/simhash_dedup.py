"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight bytes. Two fingerprints that differ in at most `bits` bits agree in at least 8 - bits
bytes at the same position. The inverted index has a list for each choice of 7 - bits of the eight positions and each value
of those bytes together: a list of one position would hold a 256th of all fingerprints, and its pairs grow with the square
of the input. A pair that shares m bytes has as many common lists as there are choices of 7 - bits of m positions, so one
within `bits` bits has 8 - bits of them at least. Every common list of a pair is tallied, pairs under that guaranteed
minimum go (those that share 7 - bits bytes only), and what is left is verified bit by bit.

Equal fingerprints are joined before the index, so exact copies cost one row. Components are found by alternating large-star
and small-star steps, each written to the shared folder.

Defined cases: a null text or one without words has fingerprint zero and links like any other; a null doc_id is never
the smallest; equal rows get equal results; texts of any length are read whole; no rows give no rows; further columns, of
whatever names, are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, bounded_batches, dropped, row_key, table, written

SHINGLE = 3
BITS = 3
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_OFFSETS = (np.arange(8) * 256).astype(np.int64)
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of the text's word shingles."""
    if text is None:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    whole, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(whole, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [h(whole[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return fingerprint_of(np.array(hashes, dtype="<u8"))


def fingerprint_of(a: np.ndarray) -> int:
    """The signed 64-bit SimHash of hashes, zero of none."""
    counts = np.bincount((a.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256).astype(np.float64) @ _BIT
    return int(np.packbits(2 * counts.ravel() > len(a), bitorder="little").view("<i8")[0])


def fingerprints(spark: SparkSession, text: Column, shingle: int = SHINGLE) -> Column:
    bounded_batches(spark)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def postings(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(list, fp): each value of the column fp in each of its lists."""
    lists = []
    for k, at in enumerate(combinations(range(8), 7 - bits)):
        value = F.lit(k << 48).cast("long")
        for j, i in enumerate(at):
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)), 8 * j))
        lists.append(value)
    return prints.select("fp", F.explode(F.array(*lists)).alias("list"))


def tallied(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b, n), a < b: the pairs of different values of the column fp with a common list, and how many they have in common."""
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A few fingerprints make many postings, so these are made by as many tasks as there may be; by a hash of fp, since a repartitioning
    # by fp itself would be left out after the aggregation by fp, and that one's partitions merged.
    index = postings(prints.repartition(tasks, F.xxhash64("fp")), bits)
    # Spark takes the postings for as small as the fingerprints that they are made of, and would broadcast them.
    met = index.alias("a").hint("merge").join(index.alias("b"), (F.col("a.list") == F.col("b.list")) & (F.col("a.fp") < F.col("b.fp")))
    return met.groupBy(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b), a < b: the pairs of different values of the column fp that differ in `bits` bits or fewer, each once."""
    return tallied(prints, bits).where(F.col("n") >= 8 - bits).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")


def components(spark: SparkSession, edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the smallest node reachable."""
    now = written(spark, edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")), "links")
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).distinct()
        last, now = now, written(spark, small, "links")
        dropped(spark, last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state
    raise RuntimeError(f"components didn't settle in {most} rounds")


def grouped(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(id, key, fp, root, component_id) of each row; key is the row_key of id and text, root tells components apart even if
    rows of different components share an id."""
    rows = bare(docs, id_col, text).toDF("id", "t")
    rows = written(spark, rows.select("id", row_key(F.col("id"), F.col("t")).alias("key"), fingerprints(spark, F.col("t"), shingle).alias("fp")), "prints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(spark, links(prints.select("fp"), bits))
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = grouped(spark, table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash_near_dedup": op5_simhash_near_dedup}
SQL: dict[str, str] = {}

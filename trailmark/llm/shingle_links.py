"""Documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, for the pipeline's stage.

Candidates come from two indexes of the same kind: joint lists of signature positions, a tally of the positions that a pair
shares, a least number of them, then verification. The first is simhash_dedup's, over 64-bit SimHashes of the 5-word shingles
within 3 bits. Those don't reach down to a similarity of 0.8, so the second is minhash_dedup's, over the least values of the
shingles. What passes either is compared exactly, on the sets of shingle hashes.

Defined cases: a text of under five words is one shingle; null and wordless texts are one node; of equal rows any one stays,
of one id's texts the one with the least key; a null id stays only if no other id is in the group; texts of any length are
read whole; no rows give no rows; further columns, of whatever names, are passed on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, bounded_batches, row_key, unpacked, with_row, written
from .minhash_dedup import keys, roots_of, shingles, signature, words
from .simhash_dedup import fingerprint_of, links

SHINGLE = 5


def nodes_of(spark: SparkSession, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(node, x, bands, sig, n, fp): x is the least (none, id, key) of the node's rows, n the number of shingles, fp their SimHash. Texts without words are node 0, in no list."""
    bounded_batches(spark)

    @F.pandas_udf("node long, bands array<long>, sig binary, n int, fp long")
    def of(texts: pd.Series) -> pd.DataFrame:
        got = []
        for t in texts:
            w = words(t)
            s = shingles(w, SHINGLE)
            sig = signature(s)
            node = np.uint64(xxhash.xxh64_intdigest(b" ".join(w), 42)).view(np.int64) if w else np.int64(0)
            got.append((node, keys(sig) if w else np.empty(0, np.int64), sig.tobytes(), len(s), fingerprint_of(s)))
        return pd.DataFrame(got, columns=["node", "bands", "sig", "n", "fp"])

    rows = bare(docs, id_col, text).toDF("id", "t")
    rows = rows.select(F.struct(F.col("id").isNull().alias("none"), "id", row_key(F.col("id"), F.col("t")).alias("key")).alias("x"), of.asNondeterministic()("t").alias("n"))
    same = [F.first(c).alias(c) for c in ("bands", "sig", "n", "fp")]
    return written(spark, rows.select("x", "n.*").groupBy("node").agg(F.min("x").alias("x"), *same), "nodes")


def near(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of equal SimHash with the least of them, and the least ones of SimHashes within 3 bits."""
    some = nodes.where("n > 0").select("fp", "node")
    prints = written(spark, some.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    same = some.join(prints, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    one = lambda c: prints.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}"))
    met = links(prints.select("fp")).join(one("a"), "a").join(one("b"), "b")
    return same.unionByName(met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))


def families(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(root, x): of each group of linked documents the least (none, id, key)."""
    nodes = nodes_of(spark, docs, id_col, text)
    keyed = nodes.select("node", F.col("x.key").alias("key"), "bands", "sig", "n")
    roots = roots_of(spark, docs, keyed, id_col, text, SHINGLE, near(spark, nodes))
    return nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("x").alias("x"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id; of equal rows any one, of one id's texts the one with the least key."""
    stay = families(spark, docs).select(F.col("x.key").alias("k")).distinct()
    keyed = with_row(docs, "doc_id", "text").withColumn("k", row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(stay, "k", "left_semi").dropDuplicates(["k"]).select(*unpacked(docs))

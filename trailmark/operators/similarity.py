"""Nearest vectors, and the gate that a guess passes if it is like an earlier message."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..sources.scratch import kept

#: Vectors in a block, and vectors that an index is fitted on.
BLOCK, SAMPLE = 2048, 20_000


def blocks(vectors: DataFrame, key: str, vector: str, size: int = BLOCK) -> DataFrame:
    """(ids, values): about `size` vectors a row, flat."""
    v = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null")
    n = max(1, -(-v.count() // size))
    return v.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).alias("b")).agg(F.collect_list("k").alias("ids"), F.flatten(F.collect_list("v")).alias("values"))


def _unit(values: np.ndarray, n: int) -> np.ndarray:
    m = np.asarray(values, np.float64).reshape(n, -1)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm == 0, np.nan, norm)


def _best_of(pairs: DataFrame, key: str, kind: str, k: int) -> DataFrame:
    """(q, key, s) of pairs of blocks (qs, qv, ids, values): k rows a query from each pair, then the best k of all."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qs, qv, ids, values in zip(b["qs"], b["qv"], b["ids"], b["values"]):
                qs, ids = np.asarray(qs), np.asarray(ids)
                s = np.round(_unit(qv, len(qs)) @ _unit(values, len(ids)).T, 6)
                s[np.isnan(s) | (qs[:, None] == ids[None])] = -np.inf
                out = []
                for q, row in zip(qs, s):
                    at = np.lexsort((ids, -row))[:k]
                    at = at[row[at] > -np.inf]
                    out.append(pd.DataFrame({"q": q, key: ids[at], "s": row[at]}))
                yield pd.concat(out)

    dealt = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = dealt.mapInPandas(run, f"q {kind}, {key} {kind}, s double")
    r = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), key)))
    return r.where(F.col("r") <= k).select("q", key, "s")


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, size: int = BLOCK) -> DataFrame:
    """(q, key, s): of each query the k vectors with another key and the highest cosine, rounded to six places; of equals those with
    the least key. Exact: blocks of queries meet blocks of vectors, and no row is broadcast by hand."""
    a = blocks(queries, key, vector, size).select(F.col("ids").alias("qs"), F.col("values").alias("qv"))
    pairs = a.crossJoin(blocks(vectors, key, vector, size).select("ids", "values"))  # a stated query set in blocks
    return _best_of(pairs, key, vectors.schema[key].dataType.simpleString(), k)


def centroids(vectors: DataFrame, key: str, vector: str, lists: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """`lists` directions or fewer, fitted on the `sample` vectors whose keys have the least hashes; those alone reach the driver."""
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null").orderBy(F.xxhash64("k"), "k").limit(sample).collect()
    x = np.array([r["v"] for r in rows], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    x = np.nan_to_num(_unit(x, len(x)))
    c = x[np.random.default_rng(3).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        for i in range(len(c)):
            if (at == i).any():
                m = x[at == i].mean(0)
                c[i] = m / (np.linalg.norm(m) or 1)
    return c


def indexed(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, lists: int | None = None, probes: int | None = None, sample: int = SAMPLE, size: int = BLOCK) -> DataFrame:
    """`nearest` by an inverted file: every vector is in the list of its nearest centroid, a query looks into the `probes` lists nearest
    to it, and what it finds there is ranked by its exact cosine. Not exact: its recall is measured by a test; `nearest` is the exact
    way. A list of any size is dealt in blocks of about `size`, so a list that holds a third of all vectors is many rows."""
    lists = lists or max(1, min(4096, round(vectors.count() ** 0.5 / 2)))
    c = centroids(vectors, key, vector, lists, sample)
    probes = min(len(c), probes or max(8, math.ceil(0.7 * len(c))))  # vectors without any structure need as many for a recall of 0.9
    sent = vectors.sparkSession.sparkContext.broadcast(c)  # 4,096 vectors at most
    kind = vectors.schema[key].dataType.simpleString()

    def placed(df: DataFrame, most: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(sent.value):
                    s = np.nan_to_num(_unit(np.stack(b["v"].to_list()), len(b))) @ sent.value.T
                    at = np.argsort(-s, 1, kind="stable")[:, :most]
                    yield pd.DataFrame({"k": np.repeat(b["k"].to_numpy(), at.shape[1]), "v": [v for v in b["v"] for _ in range(at.shape[1])], "list": at.ravel().astype("int32")})

        return df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInPandas(run, f"k {kind}, v array<double>, list int")

    def dealt(df: DataFrame) -> DataFrame:
        df = kept(df)
        n = df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
        part = F.pmod(F.xxhash64("k"), F.col("n"))
        return df.join(n, "list").groupBy("list", part.alias("part")).agg(F.collect_list("k").alias("ids"), F.flatten(F.collect_list("v")).alias("values"))

    a = dealt(placed(queries, probes)).select("list", F.col("ids").alias("qs"), F.col("values").alias("qv"))
    return _best_of(a.join(dealt(placed(vectors, 1)), "list").select("qs", "qv", "ids", "values"), key, kind, k)


def gate(messages: DataFrame, conversation: str, order: str, role: str, vector: str, least: float = 0.6) -> DataFrame:
    """messages with `likeness` and `accepted` where the role is `guess`: the highest cosine with any earlier user message of
    the conversation, and whether it is above `least`; null and not accepted without one."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    m = messages.withColumn("__past", F.collect_list(F.when(F.col(role) == "user", F.col(vector))).over(w))  # a conversation's messages
    like = F.array_max(F.transform("__past", lambda v: cosine(F.col(vector), v)))
    return m.where(F.col(role) == "guess").withColumn("likeness", like).withColumn("accepted", F.coalesce(F.col("likeness") > least, F.lit(False))).drop("__past")

"""MinHash near-dedup: many universal hash minima with banding, signature verification, exact confirmation, and connected
components by alternating large-star and small-star.

A signature position holds two bytes of the least of the shingles' values under one of BANDS * ROWS functions a * x + b. A
band is ROWS positions at once; documents that agree on a band are candidates. A pair of similarity 0.8 shares a band but for
(1 - 0.8 ** 5) ** 32, or 3 in a million, and LEAST of the 160 positions but for 1 in ten million; what shares fewer goes
unread. Every link is confirmed on the full sets of shingle hashes, which are made anew for the candidates only.

Texts of equal words (letter case and spaces aside) are one node, so exact copies cost one row. The nodes of a band's value
are first compared with its least node, which joins most of a family by as many comparisons as it has nodes. Values with
three or more nodes that are still apart are dealt in blocks of about BLOCK_BYTES; a task gets two blocks, tallies the
positions of their pairs, each pair in its first common band only, verifies those that are apart and returns the links of a
spanning forest, never all pairs.

Defined cases of the query: a text with fewer words than a shingle is one shingle; a null text or one without words has an
empty set and is linked with nothing, so it is its own component; a null doc_id is never the smallest and is kept by no
component; equal rows get equal results; texts of any length are read whole; no rows give no rows; further columns, of
whatever names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, bounded_batches, dropped, row_key, table, written
from .simhash_dedup import LOWER, components

SHINGLE = 4
BANDS, ROWS = 32, 5
LEAST = 100
BLOCK_BYTES = 2_000_000
_RNG = np.random.default_rng(5)
_TIMES = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(w: list[bytes], shingle: int) -> np.ndarray:
    """The distinct hashes of the word shingles."""
    if not w:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))], np.uint64))


def signature(s: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS positions of a set of hashes."""
    least = np.full(BANDS * ROWS, ~np.uint32(0))
    x = (s ^ s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 256):
        least = np.minimum(least, (x[i : i + 256, None] * _TIMES + _PLUS).min(0))
    return least.astype("<u2")


def keys(sig: np.ndarray) -> np.ndarray:
    """The lists of a signature."""
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(sig.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def sets_of(spark: SparkSession, docs: DataFrame, need: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(node, s): the shingle sets of the nodes in need (node, key)."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "s": [shingles(words(t), shingle).view(np.int64) for t in b["t"]]})

    rows = bare(docs, id_col, text).toDF("id", "t")
    rows = rows.select(row_key(F.col("id"), F.col("t")).alias("key"), "t").join(need, "key").select("node", "t").dropDuplicates(["node"])
    return written(spark, rows.mapInPandas(of, "node long, s array<long>"), "shingles")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 0.8 of their union in common."""
    one = lambda n: sets.select(F.col("node").alias(n), F.col("s").alias(f"s{n}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.where("5 * n >= 4 * (na + nb - n)").select("a", "b")


def links_of_blocks(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """Links that join what is alike among the rows (node, root, part, s, sig) of two blocks lo and hi of the list of band k."""
    n = len(rows)
    _, root = np.unique(rows["root"].to_numpy(), return_inverse=True)
    if root.max(initial=0) == 0:
        return []
    up = list(range(int(root.max()) + 1))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sig, part, node, sets = np.frombuffer(b"".join(rows["sig"]), "<u2").reshape(n, BANDS * ROWS), rows["part"].to_numpy(), rows["node"].tolist(), rows["s"].tolist()
    k, lo, hi = (int(rows[c].iloc[0]) for c in ("k", "lo", "hi"))
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    got = []
    for i in range(0, len(left), 64):
        at = left[i : i + 64]
        same = sig[at][:, None] == sig[right][None]
        shared = same.sum(-1)
        ok = (shared >= LEAST) & (same.reshape(len(at), len(right), BANDS, ROWS).all(-1).argmax(-1) == k) & (root[at][:, None] != root[right][None])
        if lo == hi:
            ok &= at[:, None] < right[None]
        a, b = np.nonzero(ok)
        for j in np.argsort(-shared[a, b], kind="stable").tolist():
            p, q = int(at[a[j]]), int(right[b[j]])
            rp, rq = find(int(root[p])), find(int(root[q]))
            if rp != rq:
                m = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 5 * m >= 4 * (len(sets[p]) + len(sets[q]) - m):
                    up[max(rp, rq)] = min(rp, rq)
                    got.append((min(node[p], node[q]), max(node[p], node[q])))
    return got


def links_within(left: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links that join all alike nodes of the lists left (h, k, node, root)."""
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_of_blocks(rows), columns=["a", "b"], dtype="int64")

    sized = left.join(nodes.select("node", "sig", "n"), "node")
    blocks = sized.groupBy("h").agg(F.ceil(F.sum(F.col("n") * 8 + 500) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = sized.drop("n").join(blocks, "h").join(sets, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("h", "k", "node", "root", "part", "s", "sig", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    return dealt.groupBy("h", "lo", "hi").applyInPandas(of, "a long, b long")


def positions_shared(pairs: DataFrame, nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least `least` positions."""
    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        read = lambda x: np.frombuffer(b"".join(x), "<u2").reshape(len(x), -1)
        return pd.Series((read(a) == read(b)).sum(1), dtype="int32")

    one = lambda n: nodes.select(F.col("node").alias(n), F.col("sig").alias(f"s{n}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").where(shared("sa", "sb") >= least).select("a", "b")


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(h, node, k, rep, c): each node in each of its lists h of band k that has more nodes; the list's least node and their number."""
    bands = nodes.select("node", F.posexplode("bands").alias("k", "h"))
    shared = bands.groupBy("h").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return bands.hint("merge").join(shared, "h")  # Spark takes the 32 bands of a node for as small as one


def roots_of(spark: SparkSession, docs: DataFrame, nodes: DataFrame, id_col: str, text: str, shingle: int, more: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes (node, key, bands, sig, n) that are linked with another; key is the row_key of one of the node's
    rows in docs. more: further candidate pairs (a, b), confirmed like those of the bands."""
    met = written(spark, shared_bands(nodes), "bands")
    first = positions_shared(met.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), nodes)
    pairs = written(spark, first.unionByName(more).distinct() if more is not None else first, "pairs")
    ends = met.where("c > 2").select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(spark, docs, nodes.select("node", "key").join(ends, "node", "left_semi"), id_col, text, shingle)
    edges = written(spark, alike(pairs, sets), "alike")
    roots = components(spark, edges)
    placed = met.where("c > 2").join(roots, "node", "left").select("h", "k", "node", F.coalesce("root", "node").alias("root"))
    apart = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    within = written(spark, links_within(placed.join(apart, "h", "left_semi"), sets, nodes), "alike")
    if not within.isEmpty():
        roots = components(spark, edges.unionByName(within))
    dropped(spark, met, pairs, sets, edges, within)
    return roots


def grouped(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id) of each row; component_id is the smallest id of the rows whose texts are reachable."""
    bounded_batches(spark)

    @F.pandas_udf("node long, bands array<long>, sig binary, n int")
    def of(texts: pd.Series) -> pd.DataFrame:
        got = []
        for t in texts:
            w = words(t)
            s = shingles(w, shingle)
            sig = signature(s)
            got.append((np.uint64(xxhash.xxh64_intdigest(b" ".join(w), 42)).view(np.int64) if w else 0, keys(sig) if w else np.empty(0, np.int64), sig.tobytes(), len(s)))
        return pd.DataFrame(got, columns=["node", "bands", "sig", "n"])

    rows = bare(docs, id_col, text).toDF("id", "t")
    rows = rows.select("id", row_key(F.col("id"), F.col("t")).alias("key"), of.asNondeterministic()("t").alias("x")).select("id", "key", "x.*")
    rows = written(spark, rows, "rows")
    some = rows.where("n > 0")
    nodes = written(spark, some.groupBy("node").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("bands", "sig", "n")]), "nodes")
    roots = roots_of(spark, docs, nodes, id_col, text, shingle)
    least = some.groupBy("node").agg(F.min("id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    met = some.select("id", "node", "n").join(least.join(ids, "root").select("node", "component_id"), "node").select("id", "n", "component_id")
    return met.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))).select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = grouped(spark, table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return got.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


QUERIES = {"op12_minhash_near_dedup": op12_minhash_near_dedup}
#: Pairs over an index of all shingles, then the closure of the links.
SQL = {
    "op12_minhash_near_dedup": r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(2, len(w) - 2))]) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
}

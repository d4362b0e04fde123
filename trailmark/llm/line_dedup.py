"""Line dedup by distinct-site spread.

Each line's sites are held in a HyperLogLog sketch; sketches of equal lines (by a hash) are merged by the aggregation, map
side first, so a line that stands in a third of all documents costs one small sketch a task. Lines whose estimate lies
within `band` of the threshold get an exact distinct count. Lines on `min_sites` sites or more are boilerplate, and lines of
LONG_CHARS characters or more from `long_sites` sites on, since short ones repeat by chance. Boilerplate is cut from every
document in which a line of its own remains. A document that is boilerplate throughout is itself a copy that went round;
it stays as it is, for the near-duplicate stage.

The hashes of boilerplate lines go to the executors if they are BROADCAST_LINES at most, as counted, and each row is cleaned
where it is read, without a shuffle of texts; beyond that, each row meets its own hashes by a shuffled join.

Defined cases: lines are split at \\n and compared without outer spaces; blank lines are never boilerplate; a null site
counts for no line; a null text stays null and has no lines; equal rows get equal results; a text of any length is one row;
no rows give no rows; input columns named n_lines, n_boilerplate or n_removed give way to the results, and the stage
keeps them; other columns are passed on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, bounded_batches, row_key, table, unpacked, with_row, written

MIN_SITES = 12
#: Lines of LONG_CHARS characters or more are boilerplate from LONG_SITES sites on.
LONG_SITES = 6
LONG_CHARS = 20
BAND = 0.25
LG_K = 12
#: 8 bytes each.
BROADCAST_LINES = 2_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(spark: SparkSession, docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, long_sites: int = LONG_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """The hashes `h` of lines on min_sites sites or more, or on long_sites if they have LONG_CHARS characters."""
    least = F.when(F.length("line") >= LONG_CHARS, F.lit(min(long_sites, min_sites))).otherwise(F.lit(min_sites))
    lines = bare(docs, text, site).toDF("t", "site").select("site", F.explode(lines_of(F.col("t"))).alias("line"))
    lines = lines.select("site", F.trim("line").alias("line")).where("line <> '' and site is not null").select(F.xxhash64("line").alias("h"), "site", least.alias("least"))
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("about"), F.max("least").alias("least"))
    likely = written(spark, spread.where(F.col("about") >= F.col("least") * (1 - band)), "line-spread")
    sure = likely.where(F.col("about") > F.col("least") * (1 + band)).select("h")
    near = likely.where(F.col("about") <= F.col("least") * (1 + band)).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("n"), F.max("least").alias("least")).where(F.col("n") >= F.col("least")).select("h")
    return written(spark, sure.unionByName(exact), "line-boilerplate")


GOT = "text string, n_lines long, n_boilerplate long, n_removed long"


def _cleaned_where_read(spark: SparkSession, rows: DataFrame, hashes: np.ndarray) -> DataFrame:
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(hashes)

    @F.pandas_udf(GOT)
    def clean(texts: pd.Series) -> pd.DataFrame:
        bad, got = sent.value, []
        for t in texts:
            lines = t.split("\n") if t is not None else []
            solid = [x.strip(" ") for x in lines]
            h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) if x else 0 for x in solid], np.uint64).view(np.int64)
            at = np.searchsorted(bad, h)
            hit = (bad[np.minimum(at, len(bad) - 1)] == h).tolist() if len(bad) else [False] * len(h)
            cut = [bool(x) and y for x, y in zip(solid, hit)]
            n, full = sum(cut), sum(map(bool, solid))
            cuts = 0 < n < full
            got.append(("\n".join([x for x, y in zip(lines, cut) if not y]) if cuts else t, full, n, n if cuts else 0))
        return pd.DataFrame(got, columns=["text", "n_lines", "n_boilerplate", "n_removed"])

    return rows.withColumn("__got", clean.asNondeterministic()("t"))  # so that no plan calls it twice


def _cleaned_by_join(rows: DataFrame, bad: DataFrame) -> DataFrame:
    blank = lambda x: F.trim(x) == ""
    keyed = rows.withColumn("__key", row_key(F.col("t")))
    own = keyed.select("__key", F.explode(F.array_distinct(F.transform(lines_of(F.col("t")), lambda x: F.xxhash64(F.trim(x))))).alias("h")).distinct()
    hits = own.join(bad, "h").groupBy("__key").agg(F.collect_set("h").alias("__bad"))  # as many as the text has lines
    got = keyed.join(hits, "__key", "left").withColumn("__lines", lines_of(F.col("t")))
    hit = lambda x: ~blank(x) & F.coalesce(F.array_contains("__bad", F.xxhash64(F.trim(x))), F.lit(False))
    n, full = F.size(F.filter("__lines", hit)), F.size(F.filter("__lines", lambda x: ~blank(x)))
    cuts = (n > 0) & (n < full)
    rest = F.array_join(F.filter("__lines", lambda x: ~hit(x)), "\n")
    return got.withColumn("__got", F.struct(F.when(cuts, rest).otherwise(F.col("t")).alias("text"), full.cast("long").alias("n_lines"), n.cast("long").alias("n_boilerplate"), F.when(cuts, n).otherwise(0).cast("long").alias("n_removed")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, text: str = "text", site: str = "source", **how) -> DataFrame:
    """docs with `text` cleaned, and the columns n_lines, n_boilerplate, n_removed (all long)."""
    bad = boilerplate(spark, docs, text, site, **how)
    rows = with_row(docs, text).toDF("__row", "t")
    if bad.count() <= BROADCAST_LINES:
        got = _cleaned_where_read(spark, rows, np.array(sorted(r["h"] for r in bad.distinct().collect()), np.int64))  # BROADCAST_LINES at most
    else:
        got = _cleaned_by_join(rows, bad)
    return got.select(*unpacked(docs, **{text: F.col("__got.text")}, **{c: F.col(f"__got.{c}") for c in ("n_lines", "n_boilerplate", "n_removed")}))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = without_boilerplate(spark, bare(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return got.select("doc_id", "n_lines", "n_boilerplate", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without boilerplate lines; n_chars follows where there is such a column."""
    plain = with_row(docs, "text", "source")
    got = without_boilerplate(spark, plain)
    n = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return got.select(*unpacked(docs, text=F.col("text"), **n))


QUERIES = {"op1_line_dedup": op1_line_dedup}
SQL = {"op1_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents),
l AS (SELECT rid, source, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d),
bad AS (SELECT trim(raw) AS line FROM l WHERE trim(raw) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= CASE WHEN length(trim(raw)) >= {LONG_CHARS} THEN {LONG_SITES} ELSE {MIN_SITES} END),
m AS (SELECT l.rid, l.pos, l.raw, trim(l.raw) <> '' AS solid, bad.line IS NOT NULL AS cut FROM l LEFT JOIN bad ON trim(l.raw) = bad.line),
s AS (SELECT rid, count(*) FILTER (WHERE solid) AS n_lines, count(*) FILTER (WHERE cut) AS n_boilerplate, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT cut) AS rest FROM m GROUP BY rid),
f AS (SELECT d.doc_id, s.n_lines, s.n_boilerplate, n_boilerplate > 0 AND n_boilerplate < n_lines AS cuts, d.text, coalesce(s.rest, '') AS rest FROM d JOIN s USING (rid))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_boilerplate AS BIGINT) AS n_boilerplate, CAST(CASE WHEN cuts THEN n_boilerplate ELSE 0 END AS BIGINT) AS n_removed,
       CAST(length(CASE WHEN cuts THEN rest ELSE text END) AS BIGINT) AS n_chars_kept, md5(CASE WHEN cuts THEN rest ELSE text END) AS text_md5 FROM f
"""}

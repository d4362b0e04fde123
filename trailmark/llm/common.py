"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Arrow batches handed to Python, unless the session has settings of its own: two workers of an executor and the buffers on the
#: JVM's side hold one or two batches each.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches for texts whose length has no bound. Plans read these settings when they run, so they stay; what the
    session sets itself is left alone."""
    plain = spark.sparkContext._jvm.org.apache.spark.sql.internal.SQLConf()
    for k, v in ARROW.items():
        if spark.conf.get(k) == plain.getConfString(k):
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}
#: Tables made within each `temporary` that is under way.
_OPEN: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset in local mode, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='trailmark-')}"
        named = _LOCAL[app]
    return named.rstrip("/")


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, is computed once and survives the loss of executors."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.written_path = path
    if _OPEN:
        _OPEN[-1].append(got)
    return got


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that `written` made within, but for those that are passed to what this gives."""
    keep: list[DataFrame] = []
    _OPEN.append([])
    try:
        yield lambda df: keep.append(df) or df
    finally:
        made = _OPEN.pop()
        dropped(spark, *[df for df in made if not any(df is k for k in keep)])
        if _OPEN:
            _OPEN[-1].extend(keep)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more; one that is gone already is no fault."""
    for df in tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_key(*cols: Column) -> Column:
    """A null-safe 128-bit key of the given columns; equal rows have equal keys."""
    return F.struct(F.xxhash64(*cols, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b"))


def bare(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with working columns."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def hash_cut(df: DataFrame, h: Column, n: int) -> int | None:
    """The n-th smallest value of the 64-bit hash h, None without rows: rows up to it are a sample of n, with rows of equal
    hashes. Only hashes that can be among the smallest leave the executors, about 4 * n of them for any number of rows."""
    total = df.count()
    low, span = -(1 << 63), 1 << 64
    most = low + min(span - 1, span * 4 * n // max(total, 1))
    for top in dict.fromkeys((most, low + span - 1)):
        rows = df.select(h.alias("h")).where(F.col("h") <= top).orderBy("h").limit(n).collect()
        if len(rows) == min(n, total):
            break
    return rows[-1]["h"] if rows else None


def with_row(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole input row as the struct __row, so that no name of the input can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if docs.columns else F.struct(F.lit(None).alias("_"))
    return docs.select(whole.alias("__row"), *[F.col(f"`{n}`") for n in names])


def unpacked(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of docs from __row, with new ones in place of those of the same name, or else after them."""
    old = [new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return old + [v.alias(k) for k, v in new.items() if k not in docs.columns]

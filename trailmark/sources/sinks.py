"""Writers. Appends rely on Spark's commit protocol instead of locks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str, fmt: str = "json", by: list[str] | None = None) -> None:
    """Log lines, call traces and finished results are all appended."""
    w = df.write.mode("append").format(fmt)
    (w.partitionBy(*by) if by else w).save(path)


def save_history(windows: DataFrame, requests: DataFrame, path: str, run: str) -> None:
    """Two tables, partitioned by run."""
    for name, df in (("windows", windows), ("requests", requests)):
        df.write.mode("overwrite").partitionBy(run).parquet(f"{path}/{name}")


def partition_path(agent: str, topk: int, guess: str) -> str:
    return f"agent={agent}/topk={topk}/guess_model={guess}"


def manifest_rows(manifest: DataFrame, column: str) -> DataFrame:
    """(section, mode, path) of a two-level map."""
    return manifest.select(F.explode(column).alias("section", "m")).select("section", F.explode("m").alias("mode", "path"))


def plot_table(df: DataFrame, x: list[str], y: list[str]) -> DataFrame:
    """What a figure would show; nothing is drawn here."""
    return df.select(*x, *y).orderBy(*x)


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed job still has to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")

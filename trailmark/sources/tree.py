"""Captured trees of small files (run folders, sysfs captures) as a Python data source.

    spark.dataSource.register(Tree)
    spark.read.format("tree").load("hdfs:///captures").where("run = 'a'")

A row is a file: its run (the folder right under the root), its folder below the run, its name and its text. A partition is a run,
so runs are read side by side, and a filter on `run` leaves the folders of other runs unlisted; it is pushed if the session has
spark.sql.python.filterPushdown.enabled. As a stream, a batch has the runs that weren't there before; runs must come in the order of
their names. Any store that Arrow's file systems know is read by its address. A file that isn't UTF-8 or that goes meanwhile is
left out, as a capture of a live tree needs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "run string, folder string, name string, value string"


def _opened(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def listed(address: str) -> list[str]:
    """The names of the runs, in order."""
    from pyarrow import fs

    store, root = _opened(address)
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory)


def walked(address: str, run: str) -> Iterator[tuple[str, str, str, str]]:
    from pyarrow import fs

    store, root = _opened(address)
    top = f"{root.rstrip('/')}/{run}"
    for x in sorted(store.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)), key=lambda x: x.path):
        if x.type == fs.FileType.File:
            try:
                with store.open_input_stream(x.path) as f:
                    text = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                continue
            yield run, x.path[len(top) : -len(x.base_name)].strip("/"), x.base_name, text


class Run(InputPartition):
    def __init__(self, run: str):
        super().__init__(run)


class TreeReader(DataSourceReader):
    def __init__(self, address: str):
        self.address, self.wanted = address, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("run",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self) -> list[Run]:
        if self.wanted is not None:  # a run that isn't there has no files; the root isn't listed
            return [Run(x) for x in sorted(x for x in self.wanted if x is not None)]
        return [Run(x) for x in listed(self.address)]

    def read(self, partition: Run | None) -> Iterator[tuple]:  # None where there is no run
        return walked(self.address, partition.value) if partition is not None else iter(())


class TreeStream(DataSourceStreamReader):
    def __init__(self, address: str):
        self.address = address

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(listed(self.address), default="")}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        return [Run(x) for x in listed(self.address) if start["last"] < x <= end["last"]]

    def read(self, partition: Run | None) -> Iterator[tuple]:  # None where there is no run
        return walked(self.address, partition.value) if partition is not None else iter(())


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"])

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options["path"])


def tree(spark, path: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tree)
    return spark.read.format("tree").load(path)


def write_tree(files: DataFrame, path: str) -> None:
    """The rows (run, folder, name, value) as files; a task that runs again writes the same ones anew."""
    def put(batches):
        for b in batches:
            store, root = _opened(path)
            for run, folder, name, value in b[["run", "folder", "name", "value"]].itertuples(index=False, name=None):
                at = "/".join(x for x in (root.rstrip("/"), run, folder) if x)
                store.create_dir(at, recursive=True)
                with store.open_output_stream(f"{at}/{name}") as f:
                    f.write(value.encode())
            yield b[["run"]].head(0)

    files.mapInPandas(put, "run string").write.format("noop").mode("overwrite").save()


def energy(files: DataFrame) -> DataFrame:
    """(run, package, dram): the counter of the first zone of each kind, by the zones' names; null without one. A zone is a folder
    with a file `name` and a file `energy_uj`."""
    zone = files.where(F.col("name").isin("name", "energy_uj")).groupBy("run", "folder").agg(F.max(F.when(F.col("name") == "name", F.lower(F.trim("value")))).alias("zone"), F.max(F.when(F.col("name") == "energy_uj", F.trim("value").try_cast("long"))).alias("uj"))
    zone = zone.where("zone is not null and uj is not null")
    dram = F.contains("zone", F.lit("dram"))
    first = lambda kind, n: F.min(F.when(kind, F.struct("folder", "uj")))["uj"].alias(n)
    got = zone.groupBy("run").agg(first(~dram & (F.contains("zone", F.lit("package")) | F.contains("zone", F.lit("pkg"))), "package"), first(dram, "dram"))
    return files.select("run").distinct().join(got, "run", "left")


def idle_states(files: DataFrame) -> DataFrame:
    """(run, cpu, state, time): the time in each idle state of each core, states by their names; folders cpuN/cpuidle/stateM."""
    at = r"^(?:.*/)?(cpu\d+)/cpuidle/(state\d+)$"
    row = files.where(F.col("name").isin("name", "time") & F.rlike("folder", F.lit(at)))
    state = row.groupBy("run", F.regexp_extract("folder", at, 1).alias("cpu"), F.regexp_extract("folder", at, 2).alias("n")).agg(F.max(F.when(F.col("name") == "name", F.trim("value"))).alias("state"), F.max(F.when(F.col("name") == "time", F.trim("value").try_cast("long"))).alias("time"))
    return state.where("time is not null").groupBy("run", "cpu", F.coalesce("state", "n").alias("state")).agg(F.sum("time").alias("time"))

"""Shared pieces of the training-data operators: storage that all executors see, hashes, prefix sums, components."""

from __future__ import annotations

import gc
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="lading-")
        base = _local[app]
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application."""
    app = f"ship-{spark.sparkContext.applicationId}"
    if app not in _local:
        top = Path(__file__).resolve().parents[1]
        _local[app] = shutil.make_archive(f"{tempfile.mkdtemp()}/lading", "zip", top.parent, top.name)
        spark.sparkContext.addPyFile(_local[app])


class Scratch:
    """Paths and tables that work inside a ``scratch`` block has written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.tables = spark, [], []

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` to a table that outlives this block; an enclosing block deletes it at its own end."""
        return _written(df, name, _blocks[-2] if len(_blocks) > 1 else None)

    def clear(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in self.paths:
            _delete(self.spark, path)
        self.paths, self.tables = [], []


_blocks: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Everything staged inside the block is deleted at its end, but for what went through ``result``; shuffle files of its
    jobs go as well. What the block returns must not read anything else that it has staged."""
    _blocks.append(Scratch(spark))
    try:
        yield _blocks[-1]
    finally:
        _blocks.pop().clear()
        release(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now; it waits for a collection on the driver, which
    finds only what Python has let go of."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Spark drops the shuffle files of a query when the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside leave no shuffle files behind; what they write is read in their place."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _written(df: DataFrame, name: str, block: Scratch | None, partition_by: Sequence[str] = ()) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lading/{name}-{uuid.uuid4().hex}"
    if block:
        block.paths.append(path)
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    schema = df.schema
    if partition_by:  # columns of the path come last when read
        schema = T.StructType([f for f in schema if f.name not in partition_by] + [f for f in schema if f.name in partition_by])
    return spark.read.schema(schema).parquet(path)


def staged(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends in files that outlive executors. Inside a
    ``scratch`` block they are deleted at its end."""
    return _written(df, name, _blocks[-1] if _blocks else None, partition_by)


def saved(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like ``staged``, as a table bucketed by ``column``: later joins on it move none of its rows."""
    spark = df.sparkSession
    table = f"lading_{name}_{uuid.uuid4().hex}"
    if _blocks:
        _blocks[-1].tables.append(table)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with _shuffles_dropped(spark):
        df.write.bucketBy(buckets, column).option("compression", "zstd").saveAsTable(table)
    return spark.read.table(table)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def spread(*cols: Column | str) -> Column:
    """A hash in [0, 2**62), even over its range."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 62) - 1))


def n_bits(rows: int, per_slice: int = 20_000, least: int = 6, most: int = 20) -> int:
    """Bits of a hash that cut ``rows`` into slices of about ``per_slice``."""
    return max(least, min(most, math.ceil(math.log2(max(1, rows / per_slice)))))


def prefix_sums(df: DataFrame, keys: Sequence[str], place: str, ties: Sequence[str], values: dict[str, str], bits: int) -> DataFrame:
    """Adds running sums per ``keys`` in the order of the hash column ``place``, without a window over a whole key.

    ``values``: new column -> column summed; each new column holds the sum of the rows before this one. The order is cut
    into ``2**bits`` slices of the hash range; slices are summed on their own, then shifted by the total of those before.
    """
    keys = list(keys)
    cut = df.withColumn("_slice", F.shiftright(F.col(place), 62 - bits))
    totals = cut.groupBy(*keys, "_slice").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_slice", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values])
    within = Window.partitionBy(*keys, "_slice").orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k, v in values.items():
        cut = cut.withColumn(k, F.sum(v).over(within) - F.col(v))
    out = cut.join(totals, [*keys, "_slice"])
    for k in values:
        out = out.withColumn(k, F.col(k) + F.col(f"_o_{k}"))
    return out.drop("_slice", *[f"_o_{k}" for k in values])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)`` with the least node of each as its root.

    Every round moves each node to the least root among its neighbours and then to the root of that root, so long chains
    halve. All steps are joins and grouped minima, whose partial results keep a hub with many links from one task.
    """
    with scratch(edges.sparkSession) as block:
        return block.result(_components(edges, most_rounds), "components")


def _components(edges: DataFrame, most_rounds: int) -> DataFrame:
    both = staged(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    roots = staged(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "roots")
    for _ in range(most_rounds):
        near = both.join(roots.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = staged(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "roots")
        moved = step.filter("old <> root").limit(1).count()
        roots = step.select("node", "root")
        if not moved:
            return roots
    raise RuntimeError("components did not settle")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further ``links``: the components of the groups that those join."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    tops = components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()).withColumnRenamed("root", "top")
    moved = roots.join(tops.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.union(tops.join(roots.select("node"), "node", "left_anti").select("node", F.col("top").alias("root")))

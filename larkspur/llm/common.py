"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.plans import unestimated

#: Rows in one Arrow batch sent to a Python worker. Texts vary widely in length, so batches stay short.
ARROW_ROWS = 500


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


#: What empties the tables that an operator keeps in a worker from task to task.
_KEPT: list[Callable[[], None]] = []


def kept_in_worker(clear: Callable[[], None]) -> None:
    """Name what empties tables that are kept from task to task: tasks of other operators, which use the same workers, do so before they begin."""
    _KEPT.append(clear)


def forget_tables() -> None:
    for clear in _KEPT:
        clear()


def give_back() -> None:
    """Give free memory of this worker back."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A task's function that gives memory back: at its start what tasks of another operator left in the worker, at its end what it took itself, as workers are used again."""

    def wrapped(batches):
        forget_tables()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


@contextlib.contextmanager
def untracked():
    """No garbage collection while tables without cycles grow: walking them costs a third of the time. Ends with a look at what is new."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect(0)


def unused(taken, *wanted: str) -> list[str]:
    """Column names like those wanted that none of those taken equals, whatever its case: a table's own columns are never touched."""
    taken, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that the cluster names; a local one only where none is named."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return unestimated(df.checkpoint(eager=True))


_WRITTEN: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder, which `release` removes."""
    path = f"{shared_folder(spark).rstrip('/')}/larkspur/{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one of this machine, which only a local session may use."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="larkspur-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a compressed table in the shared folder: for wide or long intermediate results. `release` removes the tables."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(made: list[tuple[SparkSession, str]]) -> None:
    for spark, path in made:
        with contextlib.suppress(Exception):  # the session may have ended
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch():
    """Tables written inside are removed at the end: for work whose result is written elsewhere by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        _remove(_WRITTEN[before:])
        del _WRITTEN[before:]


@atexit.register
def release() -> None:
    """Remove the tables written so far; results that read them are void then."""
    _remove(_WRITTEN)
    _WRITTEN.clear()


def chunk_count(rows: int, chunk_rows: int, most: int = 4096) -> int:
    """Number of chunks of about chunk_rows rows; `most` bounds what is gathered by chunk."""
    return max(1, min(most, math.ceil(rows / chunk_rows)))


def with_start(df: DataFrame, groups: list[str], weight: Column, order: list[str], rows: int, start: str = "start", chunk_rows: int = 20_000) -> DataFrame:
    """Add the exclusive running sum of `weight` within `groups`.

    A group may hold most of the rows, so each is cut into chunks by a hash of `order`; chunks are summed, their
    offsets come from a window over the sums (at most 4096 rows a group), and rows are then summed inside a chunk.
    Rows go by (chunk, order); rows equal in `order` are interchangeable.
    """
    chunks = chunk_count(rows, chunk_rows)
    df = df.withColumns({"_w": weight.cast("long"), "_chunk": F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int")})  # operators call this on relations of their own columns
    keys = [*groups, "_chunk"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn("_local", F.sum("_w").over(inside) - F.col("_w"))
    before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.groupBy(*keys).agg(F.sum("_w").alias("_s")).withColumn("_offset", F.sum("_s").over(before) - F.col("_s")).drop("_s")
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_offset")
    same = [local[k].eqNullSafe(sums[f"_k{i}"]) for i, k in enumerate(keys)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = local.join(sums, on, "inner").withColumn(start, F.col("_offset") + F.col("_local"))
    return joined.drop("_w", "_chunk", "_local", "_offset", *(f"_k{i}" for i in range(len(keys))))


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the undirected links (a, b): rows (id, component), component the smallest id reachable.

    Minimum labels travel over the links and jump along their own pointers, so rounds grow as the logarithm of a
    component's width. Each round cuts its lineage; nothing but a count reaches the driver. `pairs` is read in each
    round, so it should be a checkpoint or a table.
    """
    one = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = one.unionAll(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = checkpointed(links.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("component")))
    while True:
        seen = labels.select(F.col("id").alias("v"), F.col("component").alias("c"))
        near = links.join(seen, "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("c"))
        stepped = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "c").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        moved = checkpointed(stepped.join(jump, "mid", "left").select("id", "was", F.least("mid", "far").alias("component")))
        changed = moved.where("component <> was").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels


def with_links(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components (id, component) after further links (a, b): only links between different components are followed."""
    of = lambda end: named.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    between = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = checkpointed(between.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    over = components(between).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    new = over.select(F.col("component").alias("id")).join(named, "id", "left_anti").select("id", F.col("id").alias("component"))
    return named.unionByName(new).join(over, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))

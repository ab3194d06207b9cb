"""What the corpus operators share: scratch tables, bounded broadcasts, components.

Scratch tables are Parquet under ``spark.checkpoint.dir`` (shared by driver and
executors), so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.session import shipped

#: At most so many keys are ever called hot, which bounds every broadcast of them.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables: ``spark.checkpoint.dir``. Where it is unset, a local one if driver and executors are one process; else an error, as executors would not see each other's files."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarrymill/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = (path,)
    return out


def dropped(spark: SparkSession, df: DataFrame | None) -> None:
    """Delete the scratch table that saved() gave, once nothing reads it any more."""
    for path in getattr(df, "_scratch", ()):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def together(before: DataFrame | None, more: DataFrame) -> DataFrame:
    """The union of scratch tables, which dropped() deletes as one."""
    if before is None:
        return more
    out = before.unionByName(more)
    out._scratch = before._scratch + more._scratch
    return out


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more: it works on what the driver's collector has found."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Make the session fit for the Python workers: this package on their path, and Arrow batches bounded by bytes, as rows can hold very long texts. The same for every operator, so that it doesn't matter which is built and which runs first."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


_HELD: list = []


def task_starts(owner: str, *caches) -> None:
    """To be called first in a task in a Python worker. Workers serve one operator after another: what the one before keeps in its caches goes, and memory that is free goes back to the system."""
    if _HELD and _HELD[0] != owner:
        for c in _HELD[1:]:
            c.clear()
        gc.collect()
    _HELD[:] = [owner, *caches]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # a C library without it


def picked(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that others, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def code_points(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def smallest_hashes(hashes: DataFrame, h: str, bound: int) -> int | None:
    """The bound-th smallest of distinct 64-bit hashes, or None if there are no more than bound. Of many, a share that holds a quarter more than bound is taken first, so that few are sorted in one place."""
    n = hashes.count()
    if n <= bound:
        return None
    share = min(1.0, (1.25 * bound + 1000) / n)
    few = hashes.where(F.col(h) <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    return few.orderBy(h).limit(bound).agg(F.max(h)).first()[0]


def join_hot(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """big join small on key, where small has one row a key and weight says how many rows of big it meets.

    The keys that meet more than 1/HOT_KEYS of total rows, so fewer than HOT_KEYS
    of them, are broadcast; the others are shuffled. big is read twice.
    """
    least = max(1, total // HOT_KEYS)
    hot = small.where(F.col(weight) > least)
    cold = small.where(F.col(weight) <= least).drop(weight)
    near = big.join(F.broadcast(hot.drop(weight)), key, "inner")
    far = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far, allowMissingColumns=True)


def join_salted(big: DataFrame, small: DataFrame, key: str, spread: str, counted: DataFrame) -> DataFrame:
    """big join small on key, where rows of small may be large and some keys meet many rows of big.

    A key with more than 1/HOT_KEYS of the rows of counted (a table that has big's keys)
    is dealt out by the column spread over as many tasks as it exceeds that by; small's
    rows of it are repeated for each, at most 2 * HOT_KEYS times in all. Only those keys
    and their numbers are broadcast, fewer than HOT_KEYS of them.
    """
    most = max(1, counted.count() // HOT_KEYS)
    hot = F.broadcast(counted.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    right = small.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def _starred(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a > b)."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    around = down.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else down
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    met = join_hot(around, least, "u", "n", 2 * total)
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(met.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components: (id, component), one row for each id that an edge names.

    component is the smallest id reachable. Alternating large-star and small-star
    steps, each an aggregation and a join; the edges are never gathered. Null ends
    and loops are left out; an empty input gives no rows.
    """
    spark = edges.sparkSession
    x, y = F.col(f"`{a}`").cast("long"), F.col(f"`{b}`").cast("long")
    now = saved(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        step = saved(_starred(now, before[0], True), "large")
        after = saved(_starred(step, before[0], False), "small")
        dropped(spark, step)
        dropped(spark, now)
        now, seen = after, mark(after)
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def dealt_in_blocks(rows: DataFrame, key: str, item: str, block: int, most_long: int = 20_000, met: int | None = None) -> DataFrame:
    """rows dealt out so that every two rows of a key meet in some group (key, lo, hi) and a group holds about two blocks of rows at most.

    The rows of a key with over 2 * block rows (or over a 1/most_long of all, which
    bounds the table of such keys that is broadcast) get a block number, own, by their
    item; a group is a pair of blocks. Other keys are one group. Sorted by group, the
    key under the name key.
    """
    rows = rows.withColumnRenamed(key, "key")
    if met is None:
        met = rows.count()
    counts = rows.groupBy("key").count()
    long_keys = counts.where(F.col("count") > max(2 * block, met // most_long)).select("key", F.ceil(F.col("count") / block).cast("int").alias("_blocks"))
    out = rows.join(F.broadcast(long_keys), "key", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    out = out.withColumn("own", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rest = [c for c in rows.columns if c != "key"]
    out = out.select("key", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"), "own", *rest)
    return out.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", item)


def in_groups(batches):
    """The groups of dealt_in_blocks(), one pyarrow Table at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            mark = tuple(marks[:, s].tolist())
            if mark != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = mark
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)

"""Tables of buckets that are rewritten only where rows change, and months that are replaced by themselves.

A keyed table is a folder of versions. A version is a manifest, a small file that names
the folder of each bucket (rows by the hash of their key); an upsert writes new folders
for the buckets that its rows fall into and a manifest that takes the other buckets from the
version before. Manifests are renamed into place when all of their folders are whole, so a reader, who
takes the newest one, sees one version or the next; an upsert that dies leaves files that no
manifest names. Two writers at once: one gets an error, as a version's name can be taken once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, base: str) -> tuple[int, int, dict[int, str]]:
    """(version, buckets, folder of each bucket that has one) of the newest version; version 0 before the first."""
    at, fs = _fs(spark, f"{base}/manifests")
    if not fs.exists(at):
        return 0, 0, {}
    newest = max((s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=None)
    if newest is None:
        return 0, 0, {}
    stream = fs.open(_fs(spark, f"{base}/manifests/{newest}")[0])
    try:
        held = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return int(newest), held["buckets"], {int(k): v for k, v in held["folders"].items()}


def _publish(spark: SparkSession, base: str, version: int, buckets: int, folders: dict[int, str]) -> None:
    draft, fs = _fs(spark, f"{base}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"buckets": buckets, "folders": folders}).encode()))
    out.close()
    place = _fs(spark, f"{base}/manifests/{version:012d}")[0]
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} is there already: another writer was faster")


def current(spark: SparkSession, base: str, schema) -> DataFrame:
    """The rows of the newest version."""
    folders = manifest(spark, base)[2]
    return spark.read.schema(schema).parquet(*folders.values()) if folders else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, base: str, key: str, order: str, buckets: int = 16) -> list[int]:
    """Put rows in: of the rows of a key the one with the largest order stays, new ones winning ties; a null key is a key. The number of buckets is that of the first version. Gives the buckets that were rewritten; no rows make no version."""
    spark = rows.sparkSession
    version, known, folders = manifest(spark, base)
    buckets = known or buckets
    own = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in rows.select(own).distinct().collect())  # at most as many as there are buckets
    if not touched:
        return []
    every = rows.withColumn("_new", F.lit(1))
    old = [folders[b] for b in touched if b in folders]
    if old:
        every = every.unionByName(spark.read.schema(rows.schema).parquet(*old).withColumn("_new", F.lit(0)))
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.desc("_new"))
    best = every.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new").withColumn("_bucket", own)
    path = f"{base}/data/{version + 1:012d}-{uuid.uuid4().hex}"
    best.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
    _publish(spark, base, version + 1, buckets, folders | {b: f"{path}/_bucket={b}" for b in touched})
    return touched


def replace_months(rows: DataFrame, ts: str, path: str) -> None:
    """Write rows by month, replacing the months that rows have and no other: months need not be made ahead."""
    month = F.date_format(ts, "yyyy-MM")
    rows.withColumn("month", month).repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def replace_children(rows: DataFrame, parent: str, path: str, buckets: int = 16) -> None:
    """Replace all rows of the parents that rows have, in a folder by bucket of the parent: only those buckets are rewritten."""
    spark = rows.sparkSession
    own = F.pmod(F.xxhash64(parent), F.lit(buckets)).cast("int")
    fresh = rows.withColumn("bucket", own)
    at, fs = _fs(spark, path)
    if fs.exists(at):
        parents = rows.select(parent).distinct()
        hit = [r[0] for r in fresh.select("bucket").distinct().collect()]
        kept = spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(hit)).join(parents, parent, "left_anti")
        # read to the end before its files go
        side = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        kept.unionByName(fresh).write.parquet(side)
        fresh = spark.read.schema(fresh.schema).parquet(side)
    fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

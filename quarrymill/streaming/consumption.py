"""Consumption across runs: each row of a growing folder is consumed once, by the run that meets it first.

A run is a stream over what is there and not yet read. Each of its batches goes to a
folder of the ledger by the batch's number, without the rows whose key an earlier batch
has consumed. The stream's checkpoint keeps which files a batch reads: if a run dies
after the batch's folder is whole but before the checkpoint says so, the next run gets
the batch again under the same number and leaves the folder as it is; if it dies before
that, the folder is written anew. So no row is consumed twice and none is lost.

Rows of equal key in one batch count once (an arbitrary one of them if they differ);
rows of a null key are never consumed. An empty folder gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def consumed(spark: SparkSession, ledger: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The ledger's rows, of batches before the given one if there is one, with consumed_in_run and batch."""
    whole = StructType(list(schema.fields)).add("consumed_in_run", StringType()).add("batch", "long")
    if not _exists(spark, ledger):
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).parquet(ledger)
    return rows if before is None else rows.where(F.col("batch") < before)


def consume(spark: SparkSession, inbox: str, schema: StructType, key: str, ledger: str, checkpoint: str, run: str, after: Callable[[int], None] | None = None) -> None:
    """One run. after: called with a batch's number once its folder is whole, before the checkpoint says so."""

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        path = f"{ledger}/batch={number}"
        if not _exists(own, f"{path}/_SUCCESS"):
            seen = consumed(own, ledger, schema, number).select(key)
            fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(seen, key, "left_anti")
            fresh.withColumn("consumed_in_run", F.lit(run)).write.mode("overwrite").parquet(path)
        if after:
            after(number)

    spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

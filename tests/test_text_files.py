"""Text files of bounded size, and the query that writes and reads them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from quarrymill.plans import connectors
from quarrymill.sources import readers, writers


def files(path):
    return sorted(p for p in Path(path).rglob("*.txt"))


def test_no_file_holds_more_than_the_bound_and_a_value(spark, tmp_path):
    texts = ["가" * (n % 40) for n in range(3000)] + ["x" * 900, "", None, "a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    writers.text_files(df, str(tmp_path / "out"), 500)
    found = [p.read_bytes() for p in files(tmp_path / "out")]
    assert max(map(len, found)) <= 500 + 901 and len(found) >= sum(len((t or "").encode()) + 1 for t in texts) / 1400
    assert sorted(b"".join(found).decode().split("\n")) == sorted("\n".join(t or "" for t in texts).split("\n") + [""])


def test_a_large_task_writes_many_files_and_every_byte_is_read(spark, tmp_path):
    """Before, a task wrote one file, which came back as one row, however large."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 7, F.repeat(F.lit("텍스트 "), 5000)).alias("text")).coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    base = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")) / "quarrymill"
    before = set(base.glob("text-files-*")) if base.exists() else set()
    got = connectors.src01_text_files(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("text", 499 * 50_000 + 500, 0)]
    (made,) = set(base.glob("text-files-*")) - before
    assert len(files(made)) == 3 and max(p.stat().st_size for p in files(made)) < (1 << 23) + 50_001


def test_nothing_to_write(spark, tmp_path):
    writers.text_files(spark.createDataFrame([], "t string"), str(tmp_path / "none"))
    assert readers.documents(spark, str(tmp_path / "none")).where("path like '%.txt'").where(F.octet_length("text") > 0).count() == 0

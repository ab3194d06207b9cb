"""Versioned tables: only touched buckets and months are rewritten, and readers see whole versions."""

from __future__ import annotations

import os

import pytest

from quarrymill.sources import versions

ROWS = "id long, t int, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def seen(spark, base):
    return sorted((tuple(r) for r in versions.current(spark, base, frame(spark, []).schema).collect()), key=str)


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    base = str(tmp_path / "table")
    assert versions.upsert(frame(spark, []), base, "id", "t") == [] and seen(spark, base) == []
    versions.upsert(frame(spark, [(i, 1, "a") for i in range(200)] + [(5, 2, "b"), (None, 1, "n")]), base, "id", "t", buckets=8)
    first = versions.manifest(spark, base)
    before, rows = files(base), versions.current(spark, base, frame(spark, []).schema)
    touched = versions.upsert(frame(spark, [(7, 1, "tie wins"), (8, 0, "older loses"), (7, None, "no order")]), base, "id", "t", buckets=3)
    second = versions.manifest(spark, base)
    assert second[0] == first[0] + 1 and second[1] == 8 and len(touched) <= 2
    assert {b for b in range(8) if first[2].get(b) != second[2].get(b)} == set(touched)
    assert before.items() <= files(base).items()  # no file of the version before was changed or deleted
    assert rows.where("id = 7").first()["v"] == "a"  # a reader of the version before still reads it
    want = {i: (i, 1, "a") for i in range(200)} | {5: (5, 2, "b"), None: (None, 1, "n"), 7: (7, 1, "tie wins")}
    assert seen(spark, base) == sorted(want.values(), key=str)


def test_an_upsert_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "table")
    versions.upsert(frame(spark, [(1, 1, "a"), (2, 1, "a")]), base, "id", "t")

    def die(*a):
        raise RuntimeError("the machine went away")

    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", die)
        with pytest.raises(RuntimeError):
            versions.upsert(frame(spark, [(1, 2, "b")]), base, "id", "t")
    assert seen(spark, base) == [(1, 1, "a"), (2, 1, "a")]
    versions.upsert(frame(spark, [(1, 2, "c")]), base, "id", "t")
    assert seen(spark, base) == [(1, 2, "c"), (2, 1, "a")]


def test_a_version_is_taken_once(spark, tmp_path):
    base = str(tmp_path / "table")
    versions.upsert(frame(spark, [(1, 1, "a")]), base, "id", "t")
    with pytest.raises(RuntimeError):
        versions._publish(spark, base, 1, 16, {})
    assert versions.manifest(spark, base)[0] == 1


def test_other_months_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "months")
    df = spark.sql("select id, timestamp_ntz'2024-01-15 00:00:00' + make_ym_interval(0, cast(id % 3 as int)) as ts, 1 as v from range(30)")
    versions.replace_months(df, "ts", path)
    before = files(path)
    versions.replace_months(df.where("id % 3 = 1").withColumn("v", df["v"] + 1), "ts", path)
    after = files(path)
    kept = {f: t for f, t in before.items() if "2024-02" not in f}
    assert kept and kept.items() <= after.items() and not any("2024-02" in f for f in before.keys() & after.keys())
    got = spark.read.schema("id long, v int, month string").parquet(path).groupBy("month").sum("v").collect()
    assert sorted(map(tuple, got)) == [("2024-01", 10), ("2024-02", 20), ("2024-03", 10)]


def test_children_are_replaced_in_their_buckets(spark, tmp_path):
    path = str(tmp_path / "children")
    versions.replace_children(frame(spark, [(i % 20, i, "old") for i in range(60)]), "id", path, 8)
    before = files(path)
    versions.replace_children(frame(spark, [(3, 100, "new"), (99, 1, "new")]), "id", path, 8)
    got = sorted(tuple(r) for r in spark.read.schema(ROWS).parquet(path).select("id", "t", "v").collect())
    assert got == sorted([(i % 20, i, "old") for i in range(60) if i % 20 != 3] + [(3, 100, "new"), (99, 1, "new")])
    assert len(before.keys() & files(path).keys()) >= 1

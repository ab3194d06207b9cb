"""Streams over tables of several part files."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quarrymill.plans import streams
from quarrymill.streaming import consumption, jobs, keyed


def test_idempotent_keeps_events_of_any_age(spark, tmp_path):
    """The newest part comes first, and the others are over 60 days older; an event comes again a year later."""
    part = lambda k, when, ids: spark.sql(f"select id as event_id, 'view' as event_type, timestamp_ntz'{when}' as ts from (select explode(array({ids})) as id)").selectExpr("cast(event_id as long) as event_id", "event_type", "ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    part(0, "2024-12-01 00:00:00", "1, 2")
    part(1, "2023-12-01 00:00:00", "2, 3")
    part(2, "2024-01-01 00:00:00", "4, 1")
    got = streams.str06_idempotent(spark, str(tmp_path))
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4]


# keyed state

#: Streams' first watermark is the epoch, so events begin after it.
START = 1_700_000_000


def _outbox_rows(spark, rows, folder, stops):
    """Runs over growing files, stopped and started again after each part; rows are (key, seconds, seq, kind)."""
    own = keyed.with_rocksdb(spark)
    inbox, out, log = (str(folder / x) for x in ("in", "out", "log"))
    cuts = [0, *stops, len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[a:b], "key long, s long, seq long, kind string").coalesce(1).write.mode("append").parquet(inbox)
        stream = own.readStream.schema("key long, s long, seq long, kind string").parquet(inbox).withColumn("ts", F.timestamp_seconds(F.col("s") + START))
        jobs.run(keyed.outbox_log(stream, "key", "ts", "seq", "kind", "10 seconds"), out, log)
    back = lambda x: None if x is None else x - START * 1000
    return sorted((r["key"], back(r["at"]), r["event"], r["tries"], back(r["visible_at"])) for r in spark.read.schema("key long, at long, event string, tries int, visible_at long").parquet(out).collect())


@pytest.mark.parametrize("stops", [[], [3], [1, 2, 4, 5, 9]])
def test_outbox_gives_the_same_rows_after_restarts(spark, tmp_path, stops):
    rows = [(1, 0, 1, "lost"), (1, 599, 2, "ok"), (1, 600, 3, "fail"), (1, 601, 4, "ok"), (1, 602, 5, "ok"), (1, 610, 6, "ok")]
    rows += [(2, 1000 + 100 * k, 10 + k, "fail") for k in range(6)] + [(9, 100_000, 99, "ok")]
    got = _outbox_rows(spark, rows, tmp_path, stops)
    ms = lambda x: None if x is None else x * 1000
    want = [
        (1, 0, "taken", 0, 600), (1, 599, "refused", 0, 600), (1, 600, "visible", 0, 600), (1, 600, "retry", 1, 602), (1, 601, "refused", 1, 602),
        (1, 602, "visible", 1, 602), (1, 602, "delivered", 2, None), (1, 610, "gone", 2, None),
    ]
    for k in range(4):
        at, end = 1000 + 100 * k, 1000 + 100 * k + 2 ** (k + 1)
        want += [(2, at, "retry", k + 1, end), (2, end, "visible", k + 1, end)]
    want += [(2, 1400, "dead", 5, None), (2, 1500, "gone", 5, None)]
    assert got == sorted((k, ms(at), e, n, ms(v)) for k, at, e, n, v in want)


def test_outbox_takes_late_arrivals_in_order(spark, tmp_path):
    """Events come in the wrong order, in one file and over files, within what the watermark allows."""
    rows = [(1, 5, 3, "ok"), (1, 1, 1, "fail"), (1, 4, 2, "lost"), (2, 8, 4, "ok"), (1, 2, 5, "lost"), (9, 100_000, 99, "ok")]
    got = [r[:4] for r in _outbox_rows(spark, rows[1:5] + rows[:1] + rows[5:], tmp_path, [2, 4]) if r[0] == 1]
    assert got == [(1, 1000, "retry", 1), (1, 2000, "refused", 1), (1, 3000, "visible", 1), (1, 4000, "taken", 1), (1, 5000, "refused", 1), (1, 604000, "visible", 1)]


def test_claims_state_stays_bounded(spark, tmp_path):
    """Ten times the keys over ten times the time leave as many rows of state; without expiry there would be one for each key."""
    own = keyed.with_rocksdb(spark)

    def held(keys):
        inbox, out, log = (str(tmp_path / f"{x}{keys}") for x in ("in", "out", "log"))
        for part in range(2):
            some = spark.range(part * keys // 2, (part + 1) * keys // 2).selectExpr("id as key", "explode(array(0, 30)) as later", "id")
            some.selectExpr("key", "id * 2000 + later as s", "key * 2 + later as seq", "if(later = 0, 'claim', 'finish') as kind").coalesce(1).write.mode("append").parquet(inbox)
        stream = own.readStream.schema("key long, s long, seq long, kind string").option("maxFilesPerTrigger", 1).parquet(inbox).withColumn("ts", F.timestamp_seconds(F.col("s") + START))
        q = keyed.claim_log(stream, "key", "ts", "seq", "kind", "10 seconds").writeStream.outputMode("append").option("checkpointLocation", log).trigger(availableNow=True).format("parquet").option("path", out).start()
        q.awaitTermination()
        last = q.lastProgress.stateOperators[0]
        rows = spark.read.schema("key long, at long, event string, until long").parquet(out)
        assert rows.where("event = 'run'").count() >= keys - 1
        return last.numRowsTotal

    few, many = held(100), held(1000)
    assert many < 1.5 * few
    assert many < 1000


# consumption across runs

ROWS = "id long, v long"


def _append(spark, ids, inbox):
    spark.createDataFrame([(i, 7) for i in ids], ROWS).coalesce(1).write.mode("append").parquet(inbox)


@pytest.mark.parametrize("dies", [False, True])
def test_rows_are_consumed_once(spark, tmp_path, dies):
    """Three runs; the second may die after it wrote and before the checkpoint says so."""
    inbox, ledger, log = (str(tmp_path / x) for x in ("in", "ledger", "log"))
    schema = spark.createDataFrame([], ROWS).schema
    _append(spark, [1, 2, 2, None], inbox)
    consumption.consume(spark, inbox, schema, "id", ledger, log, "run1")
    _append(spark, [2, 3], inbox)
    if dies:

        def die(number):
            raise RuntimeError("the machine went away")

        with pytest.raises(StreamingQueryException):
            consumption.consume(spark, inbox, schema, "id", ledger, log, "run2", after=die)
        _append(spark, [3, 4], inbox)
    else:
        consumption.consume(spark, inbox, schema, "id", ledger, log, "run2")
        _append(spark, [3, 4], inbox)
    consumption.consume(spark, inbox, schema, "id", ledger, log, "run3")
    got = sorted((r.id, r.consumed_in_run) for r in consumption.consumed(spark, ledger, schema).collect())
    assert got == [(1, "run1"), (2, "run1"), (3, "run2"), (4, "run3")]


def test_nothing_to_consume(spark, tmp_path):
    schema = spark.createDataFrame([], ROWS).schema
    assert consumption.consumed(spark, str(tmp_path / "none"), schema).count() == 0

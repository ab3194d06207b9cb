"""Queries: windows, states and retries over events, as batch twins of the streaming jobs and as streams over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.session import scratch
from quarrymill.sources import writers
from quarrymill.functions import grades
from quarrymill.streaming import consumption, jobs, keyed

from .projections import CLASSIFICATIONS, CORRECTIONS, classifications, corrections, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 1 MINUTE * k AS start, event_type, value FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS k))
SELECT start AS start, start + INTERVAL 5 MINUTE AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2, 3""")
def str02_sliding_rates(spark, d):
    """STR-02: five-minute windows that slide by one."""
    r = jobs.rates(read(spark, d, "events"))
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH h AS (SELECT event_type, date_trunc('day', ts) AS day, avg((value > 10)::INT) >= 0.4 AS bad FROM events GROUP BY 1, 2), g AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY event_type ORDER BY day) AS g FROM h),
s AS (SELECT event_type, day, sum(bad::INT) OVER (PARTITION BY event_type, g ORDER BY day) AS streak FROM g) SELECT event_type, CAST(day AS DATE) AS day, CAST(streak AS BIGINT) AS streak, streak >= 2 AS alert FROM s""")
def str03_sustained(spark, d):
    """STR-03: a condition that has to hold for two days in a row."""
    h = read(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg((F.avg((F.col("value") > 10).cast("double")) >= 0.4).alias("bad"))
    return jobs.sustained(h, "event_type", "day", "bad", 2).select("event_type", F.col("day").cast("date").alias("day"), F.col("streak").cast("long").alias("streak"), "alert")


@query("""WITH r AS (SELECT user_id AS message, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events), g AS (SELECT message, min(k) FILTER (WHERE ok) AS hit, max(k) AS last FROM r WHERE k <= 5 GROUP BY message)
SELECT message, CASE WHEN hit IS NOT NULL THEN 'delivered' WHEN last >= 5 THEN 'dead' ELSE 'retry' END AS status, coalesce(hit, last)::INT AS tries, CASE WHEN hit IS NULL AND last < 5 THEN least(power(2, coalesce(hit, last)), 600)::INT ELSE 0 END AS next_wait FROM g""")
def str05_outbox(spark, d):
    """STR-05."""
    return jobs.outbox_batch(read(spark, d, "events").select(F.col("user_id").alias("message"), "ts", (F.col("event_type") == "purchase").alias("ok")))


@query("""WITH r AS (SELECT user_id % 50 AS batch, user_id AS item, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase') AS k FROM events), i AS (SELECT batch, item, min(k) FILTER (WHERE ok) AS hit, max(k) AS last FROM r WHERE k <= 3 GROUP BY 1, 2)
SELECT batch, count(*) AS n_items, count(hit) AS n_ok, CAST(sum(coalesce(hit, last)) AS BIGINT) AS tries, CASE WHEN count(hit) = count(*) THEN 'done' WHEN count(hit) > 0 THEN 'partial' ELSE 'failed' END AS status FROM i GROUP BY batch""")
def str08_batches(spark, d):
    """STR-08: items are tried by themselves; a batch is done, partial or failed."""
    return jobs.batch_status(read(spark, d, "events").select((F.col("user_id") % 50).alias("batch"), F.col("user_id").alias("item"), "ts", (F.col("event_type") == "purchase").alias("ok")))


@query("SELECT DISTINCT event_id, event_type FROM events")
def str06_idempotent(spark, d):
    """STR-06: a stream over what is there, each event twice, written once."""
    source = read(spark, d, "events")
    stream = jobs.events(spark, f"{d}/events.parque[t]", source.schema)  # a pattern serves a file and a folder
    twice = stream.select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    path = scratch(spark, "idempotent")
    jobs.run(jobs.once(twice, "event_id", None).select("event_id", "event_type"), path, scratch(spark, "idempotent-log"))
    return spark.read.schema("event_id long, event_type string").parquet(path)


@query("""SELECT user_id AS job, arg_max(event_type, event_id) AS status, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds, count(*) FILTER (WHERE event_type = 'failed') AS failures FROM events GROUP BY user_id""")
def str07_job_states(spark, d):
    """STR-07."""
    return jobs.job_states(read(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), "ts", "event_id"))


@query("SELECT event_type, le, count(*) AS n FROM (SELECT event_type, value / 10 AS v FROM events), (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 'inf'::DOUBLE])::DOUBLE AS le) WHERE v <= le GROUP BY 1, 2")
def snk06_histogram(spark, d):
    """SNK-06: cumulative latency buckets."""
    return writers.histogram(read(spark, d, "events").select("event_type", (F.col("value") / 10).alias("v")), "v", "event_type")


@query("""SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS value FROM events GROUP BY event_type""")
def snk06_exposition(spark, d):
    """SNK-06: metric lines."""
    return writers.exposition(read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "events_total", "n", "event_type", "type")


@query("SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY 1")
def str10_month_partitions(spark, d):
    """STR-10: rows by the month that partitions them."""
    return read(spark, d, "events").groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.count("*").alias("n"))


#: What each event is as a worker's visit to a message, and as a request with a key.
_VISITS = "SELECT (epoch_us(ts) // 1000) AS t, event_id AS seq, CAST(floor((epoch_us(ts) // 1000) / 7200000) AS BIGINT) * 2 + user_id % 2 AS key, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'lost' ELSE 'fail' END AS kind FROM events"
_REQUESTS = "SELECT (epoch_us(ts) // 1000) AS t, event_id AS seq, CAST(floor((epoch_us(ts) // 1000) / 259200000) AS BIGINT) * 1000003 + user_id // 16 AS key, CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'claim' END AS kind FROM events"
#: A stream gives out what its watermark has passed: all but the last hour.
_SETTLED = "e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS k FROM v WHERE t < (SELECT max(t) - 3600000 FROM v))"


def _stream(spark, d, table, key, kind):
    """events as a stream, all files in one batch, so none is late whatever their order."""
    own = keyed.with_rocksdb(spark)
    e = own.readStream.schema(read(spark, d, table).schema).parquet(f"{d}/{table}.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(key.alias("key"), "ts", "event_id", kind.alias("kind"))


@query(f"""WITH RECURSIVE v AS ({_VISITS}), {_SETTLED},
s AS (
  SELECT key, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS t, '' AS event, 'wait' AS status, 0 AS tries, CAST(0 AS BIGINT) AS visible, CAST(0 AS BIGINT) AS before FROM e WHERE k = 1
  UNION ALL
  SELECT key, k, t, event, CASE WHEN event IN ('delivered', 'dead') THEN event ELSE status END, tries + (event IN ('delivered', 'dead', 'retry'))::INT,
    CASE event WHEN 'taken' THEN t + 600000 WHEN 'retry' THEN t + least(power(2, tries + 1), 600)::BIGINT * 1000 ELSE visible END, visible
  FROM (SELECT s.key, e.k, e.t, s.status, s.tries, s.visible, CASE WHEN s.status <> 'wait' THEN 'gone' WHEN e.t < s.visible THEN 'refused' WHEN e.kind = 'ok' THEN 'delivered' WHEN e.kind = 'lost' THEN 'taken' WHEN s.tries >= 4 THEN 'dead' ELSE 'retry' END AS event
    FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)
)
SELECT key, t AS "at", event, tries, CASE WHEN event IN ('taken', 'retry') THEN visible WHEN event = 'refused' THEN before END AS visible_at FROM s WHERE k > 0
UNION ALL SELECT key, visible, 'visible', tries, visible FROM s WHERE event IN ('taken', 'retry') AND visible < (SELECT max(t) - 3600000 FROM v)""")
def str05_visibility(spark, d):
    """STR-05: workers' visits to messages. One taken without an answer is invisible for 600 s and comes back by a timer, a failed one waits 2^n s, and after five tries it is dead."""
    key = F.floor(F.unix_millis("ts") / 7200000) * 2 + F.col("user_id") % 2
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "click", "lost").otherwise("fail")
    path = scratch(spark, "outbox")
    jobs.run(keyed.outbox_log(_stream(spark, d, "events", key, kind), "key", "ts", "event_id", "kind"), path, scratch(spark, "outbox-log"))
    return spark.read.schema("key long, at long, event string, tries int, visible_at long").parquet(path)


@query(f"""WITH RECURSIVE v AS ({_REQUESTS}), {_SETTLED},
s AS (
  SELECT key, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS t, '' AS event, 'free' AS status, CAST(0 AS BIGINT) AS until FROM e WHERE k = 1
  UNION ALL
  SELECT key, k, t, event, CASE WHEN event IN ('run', 'taken over') THEN 'claimed' WHEN event = 'stored' THEN 'done' WHEN event = 'released' THEN 'free' ELSE status END,
    CASE WHEN event IN ('run', 'taken over') THEN t + 60000 WHEN event = 'stored' THEN t + 86400000 WHEN event = 'released' THEN NULL ELSE until END
  FROM (SELECT key, k, t, status, until, CASE kind WHEN 'claim' THEN CASE now WHEN 'free' THEN 'run' WHEN 'lapsed' THEN 'taken over' WHEN 'claimed' THEN 'busy' ELSE 'replayed' END
      ELSE CASE WHEN now = 'done' THEN 'ignored' WHEN kind = 'finish' THEN 'stored' ELSE 'released' END END AS event
    FROM (SELECT s.key, e.k, e.t, e.kind, s.status, s.until, CASE WHEN s.status IN ('claimed', 'done') AND e.t < s.until THEN s.status WHEN s.status = 'claimed' AND e.t < s.until + 86400000 THEN 'lapsed' ELSE 'free' END AS now
      FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1))
)
SELECT key, t AS "at", event, until FROM s WHERE k > 0""")
def str06_claims(spark, d):
    """STR-06: requests under idempotency keys. A claim holds for 60 s and can be taken over after that, a result is given again for a day; the state of a key goes with it."""
    key = F.floor(F.unix_millis("ts") / 259200000) * 1000003 + F.floor(F.col("user_id") / 16)
    kind = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "fail").otherwise("claim")
    path = scratch(spark, "claims")
    jobs.run(keyed.claim_log(_stream(spark, d, "events", key, kind), "key", "ts", "event_id", "kind"), path, scratch(spark, "claims-log"))
    return spark.read.schema("key long, at long, event string, until long").parquet(path)


@query(f"""WITH c AS (SELECT k.correction_id, k.corrected_level, s.level, k.corrected_by, s.status FROM ({CORRECTIONS}) k JOIN ({CLASSIFICATIONS}) s USING (classification_id)),
a AS (SELECT correction_id, CASE WHEN corrected_level < level THEN 'underclass' WHEN corrected_level > level THEN 'overclass' ELSE 'confirm' END AS direction FROM c WHERE status IN ('confirmed', 'corrected'))
SELECT correction_id, direction, CASE WHEN correction_id % 5 < 2 THEN 'run1' WHEN correction_id % 5 = 2 THEN 'run2' ELSE 'run3' END AS consumed_in_run FROM a""")
def str11_consumption(spark, d):
    """STR-11: three runs over growing corrections; each run's file also holds some that earlier ones have consumed. A correction is consumed once, by the first run that meets it."""
    k = corrections(spark, d).join(classifications(spark, d).select("classification_id", "level", "status"), "classification_id")
    direction = F.when(F.col("corrected_level") < F.col("level"), "underclass").when(F.col("corrected_level") > F.col("level"), "overclass").otherwise("confirm")
    rows = k.select("correction_id", direction.alias("direction"), F.col("corrected_by"), "status").where(grades.admissible("corrected_by", "status"))
    inbox, ledger, log = (scratch(spark, x) for x in ("corrections", "ledger", "ledger-log"))
    part = F.col("correction_id") % 5
    for run, upto in (("run1", part < 2), ("run2", part < 3), ("run3", part > 0)):
        rows.where(upto).write.mode("append").parquet(inbox)
        consumption.consume(spark, inbox, rows.schema, "correction_id", ledger, log, run)
    return consumption.consumed(spark, ledger, rows.schema).select("correction_id", "direction", "consumed_in_run")

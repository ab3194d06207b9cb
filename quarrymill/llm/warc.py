"""WARC: archives written from pages, and transactions assembled from archives.

Each page becomes a request, a response or revisit, and a metadata record. The request
and the metadata name the response or revisit in WARC-Concurrent-To. Of pages with
equal payloads of at least least_bytes bytes the one with the largest page_id is the
response; the others are revisit records without the payload, which name it in
WARC-Refers-To. Archives are gzip files of whole records, pages_a_file pages each, or
fewer so that pages of average size make file_bytes at most.

Reading takes an archive record by record, whatever its payloads contain, by
Content-Length; assembly joins the records of a transaction by their concurrent-to
identifier into one nested row per capture.

A null payload counts as empty; a null or unprintable url is written as urn:unknown or
percent-encoded. Pages with a null page_id are captures too, and are responses only if
no page with an id has their payload. Rows that repeat a page_id with an equal payload
give a capture each. Records whose concurrent-to names no record of the archives
give a capture without a main record. Payloads are written and hashed whole. Columns
other than page_id, url and html, whatever their names, are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, saved, scratch_path, small_batches

END = "\r\n"
#: Fixed value: the base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hexadecimal digest whose length is a multiple of five digits (20 bits, four letters)."""
    parts = [F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0") for k in range(1, 40, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(role: str, page_id: Column, digest: Column) -> Column:
    """A record's URN, from its role, page and payload."""
    h = F.md5(F.concat_ws("|", F.lit(role), F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]])


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with payload, payload_bytes, digest and first_id (the response's page for revisits, else null)."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_of_hex(F.sha1(F.encode("payload", "UTF-8"))))
    groups = base.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = saved(groups.where("n > 1 and first_id is not null"), "payload-groups")
    met = join_hot(base, groups, "digest", "n", pages.count(), "left")
    return met.withColumn("first_id", F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))


def _record(kind: str, headers: list[tuple[str, Column]], content: Column) -> Column:
    """A record's text without the two line ends that follow it."""
    lines = [F.lit(f"WARC/1.1{END}WARC-Type: {kind}{END}")]
    for name, value in headers:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise(F.lit("")))
    lines += [F.lit("Content-Length: "), F.octet_length(content).cast("string"), F.lit(END + END), content]
    return F.concat(*lines)


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, pages_a_file: int = 10_000, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archives of pages to the folder path; all of it in JVM expressions."""
    size = pages.agg(F.avg(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + 1000)).first()[0]
    pages_a_file = max(1, min(pages_a_file, int(file_bytes / (size or 1000))))
    p = plan(pages, least_bytes)
    page, digest = F.col("page_id"), F.col("digest")
    response, own = record_id("response", F.coalesce("first_id", "page_id"), digest), record_id("response", page, digest)
    main = F.when(F.col("first_id").isNull(), own).otherwise(record_id("revisit", page, digest))
    angled = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    url = F.coalesce(F.nullif(F.regexp_replace(F.col("url"), r"[^\x21-\x7E]", "%20"), F.lit("")), F.lit("urn:unknown"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url)]
    hashed = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))]
    typed = lambda m: [("Content-Type", F.lit(m))]
    got = _record("response", [("WARC-Record-ID", angled(main)), *common, *hashed, *typed("application/http; msgtype=response")], F.concat(http, F.col("payload")))
    again = _record("revisit", [("WARC-Record-ID", angled(main)), *common, *hashed, ("WARC-Refers-To", angled(response)), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), *typed("application/http; msgtype=response")], http)
    asked = _record("request", [("WARC-Record-ID", angled(record_id("request", page, digest))), *common, ("WARC-Concurrent-To", angled(main)), *typed("application/http; msgtype=request")], F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{END}{END}")))
    told = _record("metadata", [("WARC-Record-ID", angled(record_id("metadata", page, digest))), *common, ("WARC-Concurrent-To", angled(main)), *typed("application/warc-fields")], F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(f"{END}payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(END)))
    records = p.select(F.explode(F.array(asked, F.when(F.col("first_id").isNull(), got).otherwise(again), told)).alias("value"))
    records.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", 3 * pages_a_file).text(path)


def inflate(data: bytes, size: int = 1 << 16) -> Iterator[bytes]:
    """The content of one or more gzip members, or of an archive that isn't compressed, in parts."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        part = d.decompress(data, size)
        while part or d.unconsumed_tail:
            yield part
            part = d.decompress(d.unconsumed_tail, size)
        yield d.flush()
        data = d.unused_data.lstrip(b"\0")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (headers with lower-case names, content) of an archive's records, one at a time. Raises ValueError at a damaged record."""
    parts = inflate(data)
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while need(1) and held[:1] in b"\r\n":
            del held[:1]
        if not held:
            return
        at = -1
        while (at := held.find(b"\r\n\r\n", max(0, at))) < 0:
            at = max(0, len(held) - 3)
            if not need(len(held) + 1):
                raise ValueError("archive ends within a record's header")
        lines = bytes(held[:at]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        if not need(at + 4 + size):
            raise ValueError("archive ends within a record's content")
        content = bytes(held[at + 4 : at + 4 + size])
        del held[: at + 4 + size]
        yield headers, content


_RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("computed_digest", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_RECORD_SQL = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, computed_digest string, page_id long, payload_bytes long, payload binary"


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All records of the archives in the folder path; with payloads, also what responses carry."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def row(h: dict[str, str], content: bytes) -> tuple:
        kind = h.get("warc-type")
        bare = lambda name: (v := h.get(name)) and v.strip("<>")
        page = size = computed = body = None
        if kind == "response" and h.get("content-type", "").startswith("application/http"):
            body = content.partition(b"\r\n\r\n")[2]
            size, computed = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        elif kind == "metadata":
            fields = dict(x.partition(":")[::2] for x in content.decode("utf-8", "replace").split("\r\n") if x)
            page, size = ((int(v) if (v := fields.get(f, "").strip()).lstrip("-").isdigit() else None) for f in ("page-id", "payload-bytes"))
        return bare("warc-record-id"), kind, bare("warc-concurrent-to"), bare("warc-refers-to"), bare("warc-target-uri"), h.get("warc-date"), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, computed, page, size, body if payloads else None

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, c in records(content.as_py()):
                    rows.append(row(h, c))
                    held += len(c) if payloads else 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)

    return files.mapInArrow(run, _RECORD_SQL)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: main (the response or revisit), requests and metadata, joined by their concurrent-to identifiers."""
    item = F.struct("record_id", "type", "refers_to", "uri", "date", "digest", "computed_digest", "page_id", "payload_bytes", "payload")
    is_main = F.col("type").isin("response", "revisit", "resource")
    of = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("item"))))
    met = found.select(F.when(is_main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("capture"), "type", item.alias("item"))
    met = met.groupBy("capture").agg(of(is_main).alias("mains"), of(F.col("type") == "request").alias("requests"), of(F.col("type") == "metadata").alias("metadata"))
    return met.select("capture", F.explode_outer("mains").alias("main"), "requests", "metadata")


def captures(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok) of assembled captures; refers_to is the page of the record that a revisit names."""
    told = F.element_at("metadata", 1)
    rows = saved(found.where("main is not null").select("capture", F.coalesce(told["page_id"], F.col("main.page_id")).alias("page_id"), F.coalesce(F.col("main.payload_bytes"), told["payload_bytes"]).alias("payload_bytes"), F.col("main.digest").alias("payload_digest"), F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("ref"), (F.col("main.computed_digest").isNull() | F.col("main.computed_digest").eqNullSafe(F.col("main.digest"))).alias("digest_ok")), "captures")
    named = rows.where("ref is not null").groupBy("ref").agg(F.count("*").alias("n"))
    pages = saved(rows.where("record_type = 'response'").select(F.col("capture").alias("ref"), F.col("page_id").alias("refers_to")).dropDuplicates(["ref"]).join(named, "ref"), "referred")
    met = join_hot(rows.where("ref is not null"), pages, "ref", "n", rows.count(), "left")
    return met.unionByName(rows.where("ref is null"), allowMissingColumns=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def round_trip(spark: SparkSession, pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, read them back and return captures()."""
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least_bytes=least_bytes)
    return captures(assemble(read_records(spark, path)))

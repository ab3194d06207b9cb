"""Sources: record files, keyed tables, and documents in office formats."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.session import shipped

EXTRACT = T.StructType([T.StructField("text", T.StringType()), T.StructField("method", T.StringType()), T.StructField("quality", T.DoubleType()), T.StructField("error", T.StringType())])


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One JSON object a line; blank lines and lines that start with # are skipped, and damaged ones too unless strict (FAILFAST)."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    rows = lines.select(F.from_json("value", schema, options).alias("r"), F.try_parse_json("value").alias("v"))
    return rows.where("v is not null").select("r.*")


def json_dir(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document a file."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).json(path)


def review_csv(spark: SparkSession, path: str, grades: tuple[str, ...] = ("TS", "S1", "S2", "S3")) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) review rows of a CSV file with a header and maybe a byte order mark; invalid ones with their reasons, a missing decision inferred."""
    from quarrymill.functions.grades import is_machine_strict

    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    decision = F.coalesce(F.nullif(F.trim("review_decision"), F.lit("")), F.when(F.col("model_label") == F.col("human_label"), "correct").otherwise("corrected"))
    reasons = F.array_compact(F.array(F.when(F.coalesce(F.trim("doc_id"), F.lit("")) == "", "no_id"), F.when(~F.coalesce(F.col("human_label").isin(*grades), F.lit(False)), "bad_label"), F.when(is_machine_strict("reviewer_id"), "machine_reviewer")))
    rows = raw.withColumn("review_decision", decision).withColumn("reasons", reasons)
    return rows.where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0)


def keyed_table(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """A delimited bulk table, its header skipped: the first non-empty value of each column for each key (the first column), by place in the file."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.option("header", True).option("sep", sep).schema(schema).option("enforceSchema", True).csv(path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col("_at"))).alias(c)
    return rows.groupBy(columns[0]).agg(*[first(c) for c in columns[1:]])


def _xml_text(data: bytes, tag: str) -> list[str]:
    out = []
    for node in ET.fromstring(data).iter():
        if node.tag.rsplit("}", 1)[-1] == tag:
            out.append("".join(x.text or "" for x in node.iter() if x.tag.rsplit("}", 1)[-1] == "t"))
    return out


def _docx(data: bytes) -> str:
    """Paragraphs, then table rows with their cells joined."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    name = lambda n: n.tag.rsplit("}", 1)[-1]
    said = lambda n: "".join(x.text or "" for x in n.iter() if name(x) == "t")
    body = next(n for n in root.iter() if name(n) == "body")
    lines = [said(n) for n in body if name(n) == "p"]
    lines += [" | ".join(said(c) for c in row if name(c) == "tc") for table in body.iter() if name(table) == "tbl" for row in table if name(row) == "tr"]
    return "\n".join(x for x in lines if x.strip())


def _xlsx(data: bytes) -> str:
    """Every sheet, hidden ones too, under a line with its name and state; cells joined by bars; merged cells repeat their first value."""
    z = zipfile.ZipFile(io.BytesIO(data))
    name = lambda n: n.tag.rsplit("}", 1)[-1]
    shared = _xml_text(z.read("xl/sharedStrings.xml"), "si") if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    sheets = [n for n in ET.fromstring(z.read("xl/workbook.xml")).iter() if name(n) == "sheet"]
    for k, s in enumerate(sheets, 1):
        out.append(f"[sheet: {s.get('name')} ({s.get('state') or 'visible'})]")
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{k}.xml"))
        cells: dict[tuple[int, int], str] = {}
        for c in (n for n in root.iter() if name(n) == "c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            column = 0
            for ch in letters:
                column = column * 26 + ord(ch) - 64
            value = next((n.text for n in c.iter() if name(n) in ("v", "t") and n.text), "") or ""
            cells[int(row), column] = shared[int(value)] if c.get("t") == "s" and value else value
        for m in (n for n in root.iter() if name(n) == "mergeCell"):
            (a, r0), (b, r1) = (re.fullmatch(r"([A-Z]+)(\d+)", x).groups() for x in m.get("ref").split(":"))
            if a == b:
                at = 0
                for ch in a:
                    at = at * 26 + ord(ch) - 64
                for r in range(int(r0), int(r1) + 1):
                    cells[r, at] = cells.get((int(r0), at), "")
        for r in sorted({r for r, _ in cells}):
            line = " | ".join(cells[r, c] for c in sorted(c for q, c in cells if q == r) if cells[r, c].strip())
            if line:
                out.append(line)
    return "\n".join(out)


def _pptx(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1])[0]))
    return "\n".join(line for k, n in enumerate(slides, 1) for line in (f"[slide {k}]", *(x for x in _xml_text(z.read(n), "p") if x.strip())))


def extract_one(path: str, data: bytes, others: dict[str, Callable[[bytes], str]] | None = None) -> dict:
    """text, method, quality and error of a file, by its suffix; what can't be read has an empty text and its reason. others: readers of further suffixes (or in place of those here), such as ones that need a library."""
    from quarrymill.functions.arrow import normal_text

    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    try:
        if others and suffix in others:
            return {"text": others[suffix](data), "method": suffix, "quality": 0.9, "error": None}
        if suffix in ("txt", "md", "log", "csv"):
            try:
                return {"text": data.decode("utf-8"), "method": "text", "quality": 1.0, "error": None}
            except UnicodeDecodeError:
                return {"text": data.decode("cp949", "ignore"), "method": "text", "quality": 1.0, "error": None}
        if suffix in ("html", "htm", "xml"):
            t = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", data.decode("utf-8", "replace"))
            import html

            return {"text": normal_text(re.sub(r"\s+", " ", html.unescape(t))), "method": "markup", "quality": 0.9, "error": None}
        for suffixes, read, quality in ((("docx",), _docx, 0.97), (("xlsx",), _xlsx, 0.95), (("pptx",), _pptx, 0.95)):
            if suffix in suffixes:
                return {"text": read(data), "method": suffix, "quality": quality, "error": None}
    except Exception as e:  # a damaged file is a row with a reason, and not a failed job
        return {"text": "", "method": suffix, "quality": 0.0, "error": f"{type(e).__name__}: {e}"}
    return {"text": "", "method": "none", "quality": 0.0, "error": f"unsupported: {suffix}"}


def documents(spark: SparkSession, path: str, others: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, length, text, method, quality, error) of all files under path; others as in extract_one()."""
    shipped(spark)

    @F.pandas_udf(EXTRACT)
    def extract(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_one(p, bytes(c), others) for p, c in zip(path, content, strict=True)], columns=EXTRACT.names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", extract("path", "content").alias("x")).select("path", "length", "x.*")

"""Delimited files and spreadsheets of unknown make: encodings, headers, newest file, workbook cells."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymill.functions.scalars import band_number, month_of, number_in

ENCODINGS = ("utf-8-sig", "utf-8", "latin-1")


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV with a header and declared types; the header's names, and a mark of byte order before them, don't count."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)


def parquet_renamed(spark: SparkSession, path: str, names: dict[str, str], dates: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.parquet(path).withColumnsRenamed(names)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in dates})


def decoded(raw: bytes) -> str:
    """Text by the first encoding that reads all of it."""
    for e in ENCODINGS:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads anything")


def workbook_rows(raw: bytes) -> list[list[str | None]]:
    """The first sheet of an .xlsx as text cells."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.findall("m:c", ns)):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
                v = c.find("m:v", ns)
                inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                cells[at] = inline if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


def rows_of(name: str, raw: bytes) -> list[list[str | None]]:
    if name.lower().endswith((".xlsx", ".xlsm")):
        return workbook_rows(raw)
    text = decoded(raw)
    head = text.split("\n", 1)[0]
    return list(csv.reader(io.StringIO(text), delimiter=max(",;\t", key=head.count)))


def any_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files of any of these makes as ``(file, row, cells map<string,string>)``, cells by header. Files are read in parallel, each whole."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                rows = rows_of(name, raw)
                head = [str(h or "").strip() for h in rows[0]] if rows else []
                out = [(name, i, {h: v for h, v in zip(head, r) if h and v is not None}) for i, r in enumerate(rows[1:]) if any(v not in (None, "") for v in r)]
                yield pd.DataFrame(out, columns=["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, row bigint, cells map<string,string>")


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The file changed last, of equal times the last by name; lock files of office programs don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!~]*").load(pattern).select("path", "modificationTime")
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return row["p"]


def pick_column(df: DataFrame, hints: tuple[str, ...], numeric: bool) -> str | None:
    """The column of texts whose name has most of the hints, of equals the last by name; numbers must be readable in half of the rows.
    Without a hint the first column of the kind."""
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return None
    row = df.agg(*(F.count(F.when(F.trim(c) != "", 1)).alias(f"n{i}") for i, c in enumerate(names)), *(F.count(number_in(F.col(c))).alias(f"k{i}") for i, c in enumerate(names))).first()
    is_number = {c: row[f"n{i}"] > 0 and 2 * row[f"k{i}"] >= row[f"n{i}"] for i, c in enumerate(names)}
    fit = [c for c in names if is_number[c]] if numeric else names
    scored = [(sum(h in c.lower() for h in hints), c) for c in fit]
    best = max(scored, default=(0, None))
    if best[0]:
        return best[1]
    return next((c for c in names if is_number[c] == numeric), None)


def free_form_target(spark: SparkSession, path: str, name_hints: tuple[str, ...] = ("station", "name"), value_hints: tuple[str, ...] = ("boarding", "ridership", "passenger", "footfall")) -> DataFrame:
    """``(name, boardings, band)`` of a delivered file of any header: a name and a number, or an ordered band where there is no number.
    A value column named by month, or with a median too large for a day, is divided by the days of a month. Rows of one name are averaged."""
    cells = any_table(spark, path)
    heads = [r[0] for r in cells.select(F.explode(F.map_keys("cells"))).distinct().collect()]  # a file's header
    wide = cells.select(*(F.col("cells")[h].alias(h) for h in sorted(heads)))
    value = pick_column(wide, value_hints, True)
    name = pick_column(wide.drop(value) if value else wide, name_hints, False)
    rows = wide.select(F.trim(F.col(name)).alias("name"), (number_in(F.col(value)) if value else F.lit(None).cast("double")).alias("v"), F.coalesce(*(band_number(F.col(c)) for c in sorted(heads) if c != name), F.lit(None)).cast("int").alias("band"))
    rows = rows.where("length(name) > 0 and (v is not null or band is not null)").groupBy("name").agg(F.avg("v").alias("v"), F.max("band").alias("band"))
    monthly = F.lit(bool(value and "month" in value.lower())) | F.coalesce(rows.agg(F.median("v")).scalar() > 100_000, F.lit(False))
    return rows.select("name", F.when(monthly, F.col("v") / 30.4).otherwise(F.col("v")).alias("boardings"), "band")


def monthly_totals(df: DataFrame, month: str, total: str) -> DataFrame:
    """``(month, total, days, daily_mean)`` of texts like 'Apr-23' and '1,04,68,732'; rows of other texts are dropped."""
    rows = df.select(month_of(F.col(month)).alias("month"), number_in(F.col(total)).alias("total")).where("month is not null and total is not null")
    days = F.dayofmonth(F.last_day("month"))
    return rows.withColumn("days", days).withColumn("daily_mean", F.col("total") / F.col("days"))


def listed(df: DataFrame, name: str) -> DataFrame:
    """A scraped station list: repeated header rows out, footnote marks off."""
    c = F.trim(F.regexp_replace(F.col(name), r"[*†‡§¶#¤°·]|\[[^\]]*\]", ""))
    return df.where(F.col(name).isNotNull() & (F.trim(F.col(name)) != name)).withColumn("name", c).where("name <> ''")


def preferred(paths: DataFrame, path: str = "path") -> DataFrame:
    """Of a repository listing the data files worth loading: Parquet, and the lookups in raw folders; no pair tables."""
    p = F.lower(F.col(path))
    return paths.where((p.endswith(".parquet") | (p.contains("raw/") & p.rlike(r"\.(csv|json)$"))) & ~p.contains("pair"))

"""Results to files. Tables stay distributed; the single-file exports are for results of reporting size."""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a sheet beside its header.
SHEET_ROWS = 1_048_575


def _file(spark: SparkSession, path: str, pieces: Iterator[bytes]) -> None:
    """One file from pieces, none of which is kept."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for piece in pieces:
            out.write(bytearray(piece))
    finally:
        out.close()


def _in_chunks(texts: Iterator[str], size: int = 1 << 20) -> Iterator[bytes]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield "".join(held).encode()
            held, n = [], 0
    yield "".join(held).encode()


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of CSV parts with headers, replaced as a whole."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def csv_with_mark(df: DataFrame, path: str) -> bool:
    """One CSV with a byte-order mark, as spreadsheet programs expect; nothing, and False, if there are no rows. Rows pass the driver
    a partition at a time."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    first = next(rows, None)
    if first is None:
        return False

    def lines() -> Iterator[str]:
        buf = io.StringIO()
        out = csv.writer(buf, lineterminator="\n")
        yield "\ufeff"
        for r in itertools.chain([df.columns, first], rows):
            out.writerow(["" if v is None else v for v in r])
            yield buf.getvalue()
            buf.seek(0)
            buf.truncate()

    _file(df.sparkSession, path, _in_chunks(lines()))
    return True


def write_layer(df: DataFrame, folder: str, layer: str) -> None:
    """A layer of a package of tables; other layers stay."""
    df.write.mode("overwrite").parquet(f"{folder}/{layer}")


def geojson(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """``(feature)``: each row as a GeoJSON feature, with a null geometry where it has no place."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    point = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(df: DataFrame, lon: str, lat: str, path: str, script: str | None = None) -> None:
    """One collection in one file; as ``const script = ...`` for a page that loads scripts only."""
    rows = geojson(df, lon, lat).toLocalIterator(prefetchPartitions=True)

    def parts() -> Iterator[str]:
        yield (f"const {script} = " if script else "") + '{"type": "FeatureCollection", "features": [\n'
        for i, r in enumerate(rows):
            yield (",\n" if i else "") + r[0]
        yield "\n]}" + (";" if script else "")

    _file(df.sparkSession, path, _in_chunks(parts()))


def _column(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _sheet_names(tables: list[str]) -> list[str]:
    out: list[str] = []
    for t in tables:
        name = re.sub(r"[\[\]:*?/\\]", " ", t).strip("' ")[:31] or "Sheet"
        k, unique = 1, name
        while unique.lower() in (x.lower() for x in out):
            k += 1
            unique = f"{name[: 31 - len(str(k)) - 1]} {k}"
        out.append(unique)
    return out


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """An .xlsx with a sheet per table, columns as wide as their texts.

    A workbook is for results of reporting size: a table of more rows than a sheet holds is refused before anything is
    written. Sheet names are cut to 31 characters without those that the format forbids, and numbered where two become the same.
    """
    spark = next(iter(sheets.values())).sparkSession
    for name, df in sheets.items():
        if df.limit(SHEET_ROWS + 1).count() > SHEET_ROWS:
            raise ValueError(f"{name}: more than {SHEET_ROWS} rows don't fit a sheet")
    names = _sheet_names(list(sheets))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(n)) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, s in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(n)) + "</Relationships>")
        for i, df in enumerate(sheets.values()):
            rows = [df.columns, *(list(r) for r in df.toLocalIterator())]
            width = [min(60, max(len(str(r[k])) for r in rows if r[k] is not None) + 2) if any(r[k] is not None for r in rows) else 8 for k in range(len(df.columns))]
            cells = []
            for y, r in enumerate(rows, 1):
                line = []
                for x, v in enumerate(r):
                    ref = f"{_column(x)}{y}"
                    if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
                        line.append(f'<c r="{ref}"><v>{v!r}</v></c>')
                    elif v is not None:
                        line.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                cells.append(f'<row r="{y}">{"".join(line)}</row>')
            cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{w}" customWidth="1"/>' for k, w in enumerate(width))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet {main}><cols>{cols}</cols><sheetData>{"".join(cells)}</sheetData></worksheet>')
    _file(spark, path, iter([buf.getvalue()]))


def manifest(df: DataFrame, **facts: str) -> str:
    """What a table is, as JSON: rows, columns and whatever else is given."""
    return json.dumps({"rows": df.count(), "columns": dict(df.dtypes)} | facts, indent=1, sort_keys=True)


def dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, column, type, rows, filled)`` of all tables: one pass over each."""
    spark = next(iter(tables.values())).sparkSession
    out = []
    for name, df in tables.items():
        r = df.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(df.columns))).first()
        out += [(name, c, t, r["n"], r[f"k{i}"]) for i, (c, t) in enumerate(df.dtypes)]
    return spark.createDataFrame(out, "table string, column string, type string, rows bigint, filled bigint")


def extent(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))

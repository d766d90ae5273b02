"""Exports as canonical frames: csv, xlsx, folders."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import partial, reduce
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline import functions as P
from plumbline import schema as S
from plumbline.operators.numbering import numbered
from plumbline.sources.headers import column_names

TEMPLATE_WORDS = ["text box", "dropdown", "calendar", "5% interval"]
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def xlsx_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet, as texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for _, row in ElementTree.iterparse(z.open(sheet)):
            if row.tag != f"{{{_NS['m']}}}row":
                continue
            out: list[str | None] = []
            for c in row.findall("m:c", _NS):
                letters = re.match("[A-Z]+", c.get("r", ""))
                at = len(out)
                if letters:
                    at = 0
                    for x in letters[0]:
                        at = at * 26 + ord(x) - 64
                    at -= 1
                out += [None] * (at - len(out))
                kind, v = c.get("t"), c.find("m:v", _NS)
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (v.text if v is not None else None)
                out.append(shared[int(text)] if kind == "s" and text is not None else text)
            yield out
            row.clear()


class XlsxSource(DataSource):
    """``spark.read.format("plumbline_xlsx").load(path)``: rows as array<string>."""

    @classmethod
    def name(cls) -> str:
        return "plumbline_xlsx"

    def schema(self) -> str:
        return "pos long, cells array<string>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _XlsxReader(self.options["path"])


class _XlsxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a sheet is one compressed stream

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from enumerate(xlsx_rows(Path(self.path.removeprefix("file://").removeprefix("file:")).read_bytes()))


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """pos, cells: all rows as texts, the header row too, in the file's order."""
    if path.lower().endswith(".csv"):
        df = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)
        width = df.columns
        cells = df.select(F.array(*width).alias("cells"), F.monotonically_increasing_id().alias("_id"))
        return numbered(cells, [F.col("_id")], "pos").select("pos", "cells")
    spark.dataSource.register(XlsxSource)
    return spark.read.format("plumbline_xlsx").load(path)


def named(raw: DataFrame) -> DataFrame:
    """Columns named by header or place, from (pos, cells)."""
    first = raw.filter("pos = 0").select("cells").first()
    if first is None:
        return raw.select("pos", *[F.lit(None).cast("string").alias(c) for c in S.COLUMNS])
    names, header = column_names(list(first.cells))
    body = raw.filter("pos > 0") if header else raw
    return body.select("pos", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names) if n])


def canonical(df: DataFrame) -> DataFrame:
    """All canonical columns, cleaned and typed; other columns stay as texts."""
    own = [c for c in df.columns if c != "pos"]
    df = df.na.drop("all", subset=own) if own else df
    if len(own) > 20:
        first = df.orderBy("pos").limit(1).select("pos", *own).first()
        marks = [w for w in (str(v).lower() for v in (first or ())[1:]) if any(m in w for m in TEMPLATE_WORDS)]
        if first is not None and len(marks) >= 3:
            df = df.filter(F.col("pos") != first.pos)
    out = {}
    for c in S.COLUMNS:
        v = F.col(f"`{c}`") if c in own else F.lit(None).cast("string")
        if c == "docket_id":
            v = F.regexp_replace(F.regexp_replace(F.trim(v), "^'+", ""), r"\.0+$", "")
        out[c] = P.number(F.trim(v)) if c in S.NUMERIC else F.when(~P.void(v), F.trim(v))
    return df.withColumns(out)


def exports(path: str) -> list[Path]:
    """The file itself, or a folder's exports by name. Old binary workbooks are
    an error, so that none is left out unseen."""
    there = Path(path)
    found = sorted(f for f in there.iterdir() if not f.name.startswith(("~$", "."))) if there.is_dir() else [there]
    if old := [f.name for f in found if f.suffix.lower() == ".xls"]:
        raise ValueError(f"binary workbooks cannot be read, save them as xlsx: {', '.join(old)}")
    found = [f for f in found if f.suffix.lower() in (".csv", ".xlsx") or not there.is_dir()]
    if not found:
        raise FileNotFoundError(f"no exports in {path}")
    return found


def load(spark: SparkSession, path: str) -> DataFrame:
    """A file, or all exports of a folder (each with its own header), as one
    canonical frame with ``pos``, the row's place."""
    parts = [named(_raw(spark, str(f))).withColumn("pos", F.col("pos") + (i << 40)) for i, f in enumerate(exports(path))]
    return canonical(reduce(partial(DataFrame.unionByName, allowMissingColumns=True), parts))


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1") -> int:
    """Streams a frame to one sheet (all cells as they are, no formulas) and
    returns its rows. The file appears when it is whole."""
    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))[:32_000]
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    part = Path(f"{path}.part")
    n = 0
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            out.write(f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
            out.write(("<row>" + "".join(map(cell, df.columns)) + "</row>").encode())
            for row in df.toLocalIterator():
                out.write(("<row>" + "".join(map(cell, row)) + "</row>").encode())
                n += 1
            out.write(b"</sheetData></worksheet>")
    part.replace(path)
    return n


def write_parts(df: DataFrame, path: str, size: int, order: str = "no") -> None:
    """Parts of ``size`` rows in order; parts that are not in ``df`` stay (K5)."""
    parted = df.withColumn("part", F.floor(F.col(order) / size))
    parted.repartitionByRange("part", order).sortWithinPartitions("part", order).write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)

"""Sources: text files by format, JSON corpora, and the folders that may be read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

# Formats that are read as text, and as documents; folders that are never read.
TEXT_SUFFIXES, DOCUMENT_SUFFIXES = ("md", "markdown", "txt"), ("docx", "xlsx")
FORBIDDEN = ("eval", "incoming", "archive_xcd")


def text_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file_name, text) of markdown and text files, each read whole."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    bad = F.raise_error(F.concat(F.lit("unsupported document: "), F.col("path")))
    return files.withColumn("text", F.when(suffix.isin(*TEXT_SUFFIXES), F.col("text")).otherwise(bad))


def _part(data: bytes, name: str) -> ElementTree.Element | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs, headings as ``#`` lines; table rows follow after all paragraphs."""
    root = _part(data, "word/document.xml")
    body = root.find(f"{_W}body") if root is not None else None
    said = lambda e: "".join(x.text or "" for x in e.iter(f"{_W}t"))
    lines, rows = [], []
    for child in body if body is not None else []:
        if child.tag == f"{_W}p":
            style = child.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = int(name[7:]) if name.startswith("Heading") and name[7:].isdigit() else 0
            if said(child).strip():
                lines.append("#" * level + " " * bool(level) + said(child))
        elif child.tag == f"{_W}tbl":
            rows += ["| " + " | ".join(said(c).strip() for c in r.iter(f"{_W}tc")) + " |" for r in child.iter(f"{_W}tr")]
    return "\n\n".join(lines + ["\n".join(rows)] * bool(rows))


def xlsx_text(data: bytes) -> str:
    """A ``##`` line and pipe rows for each sheet; rows without any value are dropped."""
    shared = _part(data, "xl/sharedStrings.xml")
    strings = ["".join(x.text or "" for x in si.iter(f"{_S}t")) for si in shared] if shared is not None else []
    book = _part(data, "xl/workbook.xml")
    out = []
    for n, sheet in enumerate(book.iter(f"{_S}sheet"), 1):
        out.append(f"## {sheet.get('name')}")
        root = _part(data, f"xl/worksheets/sheet{n}.xml")
        for row in root.iter(f"{_S}row") if root is not None else []:
            cells = []
            for c in row.iter(f"{_S}c"):
                v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                text = "".join(x.text or "" for x in inline.iter(f"{_S}t")) if inline is not None else (v.text or "") if v is not None else ""
                cells.append(strings[int(text)] if c.get("t") == "s" and text else text)
            if any(x.strip() for x in cells):
                out.append("| " + " | ".join(cells) + " |")
    return "\n".join(out)


def document_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of Word and Excel files, decoded where they are read."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path, data in zip(batch["path"], batch["content"]):
                suffix = path.rsplit(".", 1)[-1].lower()
                if suffix not in DOCUMENT_SUFFIXES:
                    raise ValueError(f"unsupported document: {path}")
                texts.append(docx_text(data) if suffix == "docx" else xlsx_text(data))
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(decode, "path string, text string")


def json_records(spark: SparkSession, paths: list[str], schema: t.StructType) -> DataFrame:
    """Records of JSON files that hold a list, or an object whose first list is the records."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("source_ref"), F.try_parse_json("value").alias("v"), "value")
    kinds = F.from_json(F.col("value"), "map<string,string>")
    first = F.get(F.filter(F.map_entries(kinds), lambda e: e["value"].rlike(r"^\s*\[")), F.lit(0))["value"]
    listed = F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(first)
    return raw.select("source_ref", F.explode(F.from_json(listed, t.ArrayType(schema))).alias("r")).select("r.*", "source_ref")


def allowed(files: DataFrame, path: str = "path") -> DataFrame:
    """Fails on the first row that comes from a folder which must not be read."""
    bad = F.col(path).rlike(r"(^|/)(" + "|".join(FORBIDDEN) + r")(/|$)")
    return files.withColumn(path, F.when(bad, F.raise_error(F.concat(F.lit("forbidden folder: "), F.col(path)))).otherwise(F.col(path)))

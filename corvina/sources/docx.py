"""Word documents as DataFrames: one row per paragraph or table cell.

Spark lists and reads the files, so any store works; a file is unpacked in the task that reads it. A
file that can't be opened gives one row with an error instead of failing the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, LARGE_BYTES = 50 * 1024 * 1024, 10 * 1024 * 1024
SCHEMA = "path string, sha256 string, kind string, table_idx int, row_idx int, idx int, style string, text string, error string"
#: Files are read into frames of about so many rows or characters: one for each file costs more than its unpacking.
FRAME_ROWS, FRAME_CHARS = 4_096, 4 << 20
_CONTROL = re.compile(r"[\x00-\x08\x0a-\x1f]")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, length, errors, warnings, content of the .docx files of a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return judged(found)


def judged(found: DataFrame) -> DataFrame:
    """path, length, errors, warnings, content of files (path, length, content). Only names that end in .docx, in any
    case, are taken; a file without bytes or with too many isn't."""
    errors = F.array_compact(F.array(F.when(~F.coalesce(F.lower("path").endswith(".docx"), F.lit(False)), "extension"), F.when(F.col("length") > MAX_BYTES, "too_large"), F.when(F.coalesce("length", F.lit(0)) == 0, "empty")))
    warnings = F.array_compact(F.array(F.when(F.col("length") > LARGE_BYTES, "large")))
    return found.select("path", "length", errors.alias("errors"), warnings.alias("warnings"), "content")


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()


def _rows(path: str, content: bytes) -> list[tuple]:
    import hashlib

    digest = hashlib.sha256(content).hexdigest()
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
        out, n_tables, idx = [], 0, 0
        for child in body:
            if child.tag == f"{_W}p" and (text := _text(child)):
                style = child.find(f"{_W}pPr/{_W}pStyle")
                out.append((path, digest, "paragraph", None, None, idx, None if style is None else style.get(f"{_W}val"), text, None))
                idx += 1
            elif child.tag == f"{_W}tbl":
                for r, row in enumerate(child.iter(f"{_W}tr")):
                    out += [(path, digest, "cell", n_tables, r, c, None, _text(cell), None) for c, cell in enumerate(row.iter(f"{_W}tc"))]
                n_tables += 1
        return out
    except Exception as problem:  # noqa: BLE001  whatever is wrong with one file is told in its row
        return [(path, digest, "error", None, None, None, None, None, f"{type(problem).__name__}: {problem}"[:200])]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[field.split()[0] for field in SCHEMA.split(", ")], dtype=object)
    return frame.astype({c: "Int32" for c in ("table_idx", "row_idx", "idx")})


def read(files: DataFrame) -> DataFrame:
    """The rows of SCHEMA for files without errors."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, chars = [], 0
            for path, content in zip(batch["path"], batch["content"], strict=True):
                more = _rows(path, content)
                rows += more
                chars += sum(len(row[7] or "") for row in more)
                if len(rows) >= FRAME_ROWS or chars >= FRAME_CHARS:
                    yield _frame(rows)
                    rows, chars = [], 0
            if rows:
                yield _frame(rows)

    return files.where(F.size("errors") == 0).select("path", "content").mapInPandas(unpack, SCHEMA)


def _packed(text: str) -> bytes:
    out = io.BytesIO()
    lines = [escape(_CONTROL.sub("", line)) for line in text.split("\n")]
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{line}</w:t></w:r></w:p>' for line in lines)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as pack:
        pack.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def packed(rows: DataFrame, path: str, text: str) -> DataFrame:
    """What ``files`` gives, of documents that are made here: a paragraph for each line of a text. A null text is an
    empty file. Control characters, which such documents can't hold, are left out."""

    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([b"" if one is None else _packed(one) for one in texts], dtype=object)

    made = rows.select(F.col(path).cast("string").alias("path"), F.pandas_udf(pack, "binary")(F.col(text)).alias("content"))
    return judged(made.withColumn("length", F.octet_length("content").cast("long")))

"""Sources and sinks: file detection, CSV and document text, JSON out.

Files come through ``spark.read.format("binaryFile")``, so any store that Spark
reads will do, and detection is a projection over their first bytes.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions.constants import COLUMN_FIELD, FIELD_CONFIDENCE, NULL_TOKENS, OTHER_CONFIDENCE
from ..functions.normalize import literal_map, strip
from ..functions.schema import CLAIM

_MIME = {
    "pdf": "application/pdf", "csv": "text/csv", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "txt": "text/plain", "json": "application/json",
}
_HEADS = {"25504446": "application/pdf", "89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif"}
_OCR_WARNING = "OCR is not available: no text was extracted from the scanned PDF."


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, length, content`` of files or folders; files without bytes too, which Spark's reader leaves out.

    Paths that do not exist give no row (see ``absent``).
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    empty, there = [], []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        store = where.getFileSystem(conf)
        if store.exists(where):
            there.append(p)
            for status in store.listStatus(where):
                if status.isFile() and not status.getLen():
                    empty.append((status.getPath().toString(), 0, bytearray()))
    found = spark.createDataFrame(empty, "path string, length bigint, content binary")
    return spark.read.format("binaryFile").load(there).select("path", "length", "content").unionByName(found) if there else found


def absent(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file_path`` of the requested paths that do not exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return spark.createDataFrame([(p,) for p, w in where if not w.getFileSystem(conf).exists(w)], "file_path string")


def mime_type(content: Column, extension: Column) -> Column:
    """By the first bytes, then by the extension, else octet-stream."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for start, kind in _HEADS.items():
        out = F.when(head.startswith(start), kind).otherwise(out)
    by_name = literal_map(_MIME)[extension]
    return F.coalesce(out, F.when(head.startswith("504B0304") & (extension == "docx"), _MIME["docx"]), by_name, F.lit("application/octet-stream"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 without a byte order mark, or as Latin-1 if they are not UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


@F.pandas_udf(BooleanType())
def opens_as_docx(content: pd.Series) -> pd.Series:
    return content.map(lambda b: _docx_text(b) is not None)


def _docx_text(b: bytes | None) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(b or b"")) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (KeyError, zipfile.BadZipFile):
        return None
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>|<w:p/>", xml, re.DOTALL)
    plain = ("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.DOTALL)) for p in paragraphs)
    return "\n".join(t.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&") for t in plain)


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Paragraphs of a word-processing document, one a line; null if it does not open."""
    return content.map(_docx_text)


def detect(files: DataFrame, pdf_head: Column | None = None, content: bool = False) -> DataFrame:
    """Metadata of each file: type, readability, size and a warning.

    ``pdf_head`` is the text of a PDF's first three pages, if a reader for PDF
    is at hand; under 100 characters the PDF counts as scanned.  Without one,
    PDFs count as text.  With ``content`` the bytes stay beside their metadata, so
    that readers need no join to get at them.
    """
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1)).otherwise(""))
    rows = files.withColumns({"file_name": name, "extension": extension}).withColumn("mime_type", mime_type(F.col("content"), F.col("extension")))
    kind, ext = F.col("mime_type"), F.col("extension")
    first = F.regexp_extract(F.substring_index(decoded(F.col("content")), "\n", 1), r"^[^\r\n]*", 0)
    headers = F.transform(F.split(first, ","), lambda h: F.regexp_replace(F.lower(strip(h)), " ", "_"))
    known = F.arrays_overlap(headers, F.array(*map(F.lit, COLUMN_FIELD)))
    is_csv, is_pdf, is_docx = (kind == _MIME["csv"]) | (ext == "csv"), (kind == _MIME["pdf"]) | (ext == "pdf"), (kind == _MIME["docx"]) | (ext == "docx")
    scanned = F.length(strip(pdf_head)) < 100 if pdf_head is not None else F.lit(False)
    image = kind.startswith("image/")
    empty = F.col("length") == 0
    bad_docx = ~is_csv & ~is_pdf & is_docx & ~opens_as_docx(F.col("content"))
    detected = F.when(empty, "unknown").when(is_csv, "csv").when(is_pdf, F.when(scanned, "image_pdf").otherwise("pdf")).when(is_docx, "docx").otherwise("unknown")
    warning = (
        F.when(empty, "Empty file").when(is_csv, F.when(~known, "No recognized columns in CSV header")).when(is_pdf, F.when(scanned, "Scanned PDF detected, OCR required"))
        .when(bad_docx, "Could not open DOCX").when(is_docx, F.lit(None)).when(image, "Raw image file. Convert to PDF first").otherwise("Unsupported file type")
    )
    readable = ~empty & (is_csv | is_pdf | (is_docx & ~bad_docx))
    return rows.select(F.col("path").alias("file_path"), "file_name", "extension", "mime_type", detected.alias("detected_type"), readable.alias("readable"), F.col("length").alias("file_size_bytes"), warning.alias("warning"), *(["content"] if content else []))


def missing_files(gone: DataFrame) -> DataFrame:
    """Metadata of requested paths that do not exist (``absent``)."""
    return gone.select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.lit("").alias("extension"), F.lit("application/octet-stream").alias("mime_type"), F.lit("unknown").alias("detected_type"), F.lit(False).alias("readable"), F.lit(0).cast("bigint").alias("file_size_bytes"), F.lit("File not found").alias("warning"))


def csv_records(files: DataFrame) -> DataFrame:
    """``source, record, header, row, warning`` of CSV files (path, content).

    Records are counted from 1, the header; a record of another width than the
    header has a warning and no row.  An empty file or header gives one warning.
    """
    texts = files.select(F.element_at(F.split("path", "/"), -1).alias("source"), decoded(F.col("content")).alias("text"))

    def run(batches):
        for pdf in batches:
            out = []
            for source, text in zip(pdf["source"], pdf["text"], strict=True):
                rows = csv.reader(io.StringIO(text or "", newline=""))
                header = [h.strip().lower().replace(" ", "_") for h in next(rows, [])]
                if not any(header):
                    out.append((source, 1, None, None, "CSV file is empty or has no header"))
                    continue
                for n, row in enumerate(rows, 2):
                    if len(row) == len(header):
                        out.append((source, n, header, row, None))
                    else:
                        out.append((source, n, header, None, f"Malformed row {n}: expected {len(header)} columns, got {len(row)}"))
            yield pd.DataFrame(out, columns=["source", "record", "header", "row", "warning"])

    return texts.mapInPandas(run, "source string, record bigint, header array<string>, row array<string>, warning string")


def csv_claims(records: DataFrame, entity: Column | None = None) -> DataFrame:
    """One claim for each filled cell of a known column; ``entity`` defaults to the row's e-mail, else file and record.

    ``ord`` counts records, then columns.
    """
    good = records.where(F.col("row").isNotNull())
    cells = good.select("source", "record", "header", "row", F.posexplode(F.arrays_zip("header", "row")).alias("pos", "cell"))
    field = literal_map(COLUMN_FIELD)[F.col("cell.header")]
    value = strip("cell.row")
    mail = F.lower(strip(F.get(F.filter(F.transform(F.arrays_zip("header", "row"), lambda x: F.when(x["header"] == "email", x["row"])), lambda x: x.isNotNull()), F.lit(0))))
    who = F.coalesce(F.when(mail != "", mail), F.concat_ws("#", "source", "record")) if entity is None else entity
    rows = cells.select(who.alias("entity_id"), (F.col("record") * 1000 + F.col("pos")).alias("ord"), field.alias("field"), value.alias("raw_value"), "source")
    return as_claims(rows.where(F.col("field").isNotNull() & kept_value(F.col("raw_value"))).withColumn("confidence", field_confidence(F.col("field"))), "structured", "direct_field", "structured_field")


def kept_value(value: Column) -> Column:
    """Whether a cell says anything."""
    return (strip(value) != "") & ~F.lower(strip(value)).isin(*NULL_TOKENS)


def field_confidence(field: Column) -> Column:
    return F.coalesce(literal_map(FIELD_CONFIDENCE)[field], F.lit(OTHER_CONFIDENCE))


def as_claims(rows: DataFrame, source_type: str, method: str | Column, position: str | Column) -> DataFrame:
    """Rows with entity_id, ord, field, raw_value, source, confidence (and perhaps skill columns) as full claims."""
    given = set(rows.columns)
    fixed = {"source_type": F.lit(source_type), "extraction_method": F.lit(method) if isinstance(method, str) else method, "extraction_position": F.lit(position) if isinstance(position, str) else position, "normalization_status": F.lit("not_applicable")}
    out = []
    for part in re.split(r", (?=\w+ )", CLAIM):
        name, kind = part.split(" ", 1)
        c = fixed[name] if name in fixed and name not in given else F.col(name) if name in given else F.array() if kind.startswith("array") else F.lit(None)
        out.append(c.cast(kind).alias(name))
    return rows.select(*out)


def document_text(detected: DataFrame, pdf_text: Callable[[Column], Column] | None = None, ocr: Callable[[Column], Column] | None = None) -> DataFrame:
    """``source, text, warning`` of readable documents, from ``detect`` with their content.

    ``pdf_text`` and ``ocr`` turn bytes into text where such readers are at
    hand; without them PDFs give empty text and a warning.
    """
    rows = detected.where("readable and detected_type in ('pdf', 'image_pdf', 'docx')")
    pdf = pdf_text(F.col("content")) if pdf_text else F.lit(None).cast("string")
    scan = ocr(F.col("content")) if ocr else F.lit(None).cast("string")
    text = F.when(F.col("detected_type") == "docx", docx_text(F.col("content"))).when(F.col("detected_type") == "pdf", pdf).otherwise(scan)
    gone = F.when(F.col("detected_type") == "image_pdf", _OCR_WARNING).otherwise("Text extraction failed")
    return rows.select(F.col("file_name").alias("source"), F.coalesce(text, F.lit("")).alias("text"), F.when(text.isNull(), gone).alias("warning"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields written."""
    df.write.option("ignoreNullFields", "false").json(path)

"""Documents from a folder: Markdown, text and PDF files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.sources.pdf import pdf_text

TEXT_TYPES = (".md", ".txt", ".markdown")
PDF_TYPES = (".pdf",)
DOCUMENT = "path string, name string, content string"


class UnsupportedFormat(ValueError):
    pass


def extension(path):
    """The last dot and what follows it, lower-cased."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def is_supported(path):
    return extension(path).isin(*TEXT_TYPES, *PDF_TYPES)


def base_name(path):
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _read(files: DataFrame, extract, strict: bool) -> DataFrame:
    """(path, name, content) from (path, content): text as UTF-8 (bad bytes become replacement characters), PDF by an extractor;
    a PDF that cannot be read is left out, or an error with ``strict``."""

    def work(batches):
        for b in batches:
            out = ([], [])
            for path, data in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                if path.lower().endswith(PDF_TYPES):
                    try:
                        text = extract(data)
                    except Exception:
                        if strict:
                            raise
                        continue
                else:
                    text = data.decode("utf-8", errors="replace")
                out[0].append(path)
                out[1].append(text)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["path", "content"])

    read = files.select("path", "content").mapInArrow(work, "path string, content string")
    return read.select("path", base_name(F.col("path")).alias("name"), "content")


def load_directory(spark: SparkSession, folder: str, extract=pdf_text) -> DataFrame:
    """The documents directly in a folder (not below it), files of other types left out; order by name where it matters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return _read(files.filter(is_supported(F.col("path"))), extract, strict=False)


def load_file(spark: SparkSession, path: str, extract=pdf_text) -> DataFrame:
    """One document; another file type is an error."""
    if not path.lower().endswith(TEXT_TYPES + PDF_TYPES):
        raise UnsupportedFormat(f"unsupported file type: {path}")
    return _read(spark.read.format("binaryFile").load(path), extract, strict=True)

"""Word files: paragraphs, and table rows as cells joined by ' | '."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()


def _lines(content: bytes) -> Iterator[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for node in body:
        if node.tag == f"{_W}p":
            yield _text(node)
        elif node.tag == f"{_W}tbl":
            yield from (" | ".join(_text(c) for c in row.findall(f"{_W}tc")) for row in node.findall(f"{_W}tr"))


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the .docx files of a folder; a broken file gives its error and no text."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    out.append((name, "\n\n".join(x for x in _lines(content) if x), None))
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    out.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return raw.mapInPandas(parse, "path string, text string, error string")

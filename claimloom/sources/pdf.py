"""Text of PDF files, where a PDF library is installed."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from claimloom.plans.ship import ship


def read_pages(spark: SparkSession, path: str, reader=None) -> DataFrame:
    """(source, pos, text): the pages of all PDF files below ``path``; pages without text are empty strings.

    ``reader`` gives a file's page texts from its bytes; by default pypdf does, which
    must be installed on the workers.  A file that can't be read gives no rows.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content")
    read = reader or _pypdf

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, content in zip(b["path"], b["content"], strict=True):
                try:
                    texts = [t or "" for t in read(bytes(content))]
                except ImportError:
                    raise
                except Exception:  # noqa: BLE001 - a broken file
                    continue
                if texts:
                    yield pd.DataFrame({"source": source, "pos": range(len(texts)), "text": texts})

    return files.mapInPandas(pages, "source string, pos int, text string")


def _pypdf(content: bytes) -> list[str]:
    from pypdf import PdfReader

    return [p.extract_text() for p in PdfReader(io.BytesIO(content)).pages]

"""Page texts from files: any recogniser, one row a page, a row with an error for what cannot be read."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From the bytes of a file to the texts of its pages; may raise.
Recogniser = Callable[[bytes], list[str]]


def plain_text(content: bytes) -> list[str]:
    """UTF-8 text; form feeds end pages."""
    return content.decode("utf-8").split("\f")


def html_text(content: bytes) -> list[str]:
    """One page: what is left of HTML without tags, a line for each."""
    return [re.sub("<[^>]*>", "\n", content.decode("utf-8"))]


RECOGNISERS: dict[str, Recogniser] = {"txt": plain_text, "text": plain_text, "html": html_text, "htm": html_text}
PAGES = "path string, page_number int, text string, error string"


def read_pages(spark: SparkSession, path: str, recognisers: dict[str, Recogniser] | None = None) -> DataFrame:
    """(path, page_number from 1, text, error) of all files under ``path``, by the recogniser of their extension.

    A file that has none, or whose recogniser fails or finds no page, is one empty page with the error.  Files are read by
    Spark, so they may be in any store; each is held whole by one task, as a recogniser takes it.  Files of length 0 are no files to Spark's reader.
    """
    by = RECOGNISERS | (recognisers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f.path, f.content, strict=True):
                kind = name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
                try:
                    if kind not in by:
                        raise ValueError(f"no recogniser for .{kind}")
                    pages = by[kind](bytes(content))
                    if not pages:
                        raise ValueError("no pages")
                    rows = [(name, k, text, None) for k, text in enumerate(pages, 1)]
                except Exception as e:  # noqa: BLE001 - a broken file is a row, not the end of the job
                    rows = [(name, 1, "", f"{type(e).__name__}: {e}"[:2000])]
                yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"])

    return files.mapInPandas(run, PAGES)


def documents_of(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text, error): the id is the hash of the path, as the index wants a number."""
    return pages.select(F.xxhash64("path").alias("document_id"), "page_number", "text", "error")

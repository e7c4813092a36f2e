"""Files in: validation, hashing, and the split of accepted files and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.config import INGEST, IngestConfig


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of every file under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "false").load(path)


def validated(rows: DataFrame, cfg: IngestConfig = INGEST) -> DataFrame:
    """Adds error (null if the file is accepted) from ``path`` and ``length``."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    error = F.when(~ext.isin(*cfg.extensions), F.concat(F.lit("unsupported type: "), ext)).when(F.col("length") > cfg.max_bytes, F.lit("file too large")).when(F.col("length") == 0, F.lit("empty file"))
    return rows.withColumn("error", error)


def ingest(rows: DataFrame, cfg: IngestConfig = INGEST) -> tuple[DataFrame, DataFrame]:
    """(uploaded rows with their hash, rejected rows with their error)."""
    checked = validated(rows, cfg)
    good = checked.where("error IS NULL").select("path", "length", F.sha2("content", 256).alias("file_hash"), F.lit("uploaded").alias("status"))
    return good, checked.where("error IS NOT NULL").select("path", "error")


def ingest_batch(rows: DataFrame, cfg: IngestConfig = INGEST) -> tuple[DataFrame, DataFrame]:
    """``ingest`` of one call: at most ``max_files`` files, each with a ``tracking_id`` that is the same whenever it comes again.

    A call with more files is refused as a whole, before any is read.
    """
    if rows.select("path").limit(cfg.max_files + 1).count() > cfg.max_files:
        raise ValueError(f"more than {cfg.max_files} files in one batch")
    track = F.substring(F.sha2("path", 256), 1, 32).alias("tracking_id")
    good, bad = ingest(rows, cfg)
    return good.select(track, *good.columns), bad.select(track, *bad.columns)


def retrieval_log(df: DataFrame) -> DataFrame:
    """Log rows with their texts cut to the lengths of the log's columns."""
    return df.select(F.substring("query_text", 1, 2000).alias("query_text"), "page_number", F.substring("section_heading", 1, 500).alias("section_heading"), F.substring("context", 1, 2000).alias("context"))

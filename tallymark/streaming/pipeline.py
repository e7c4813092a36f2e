"""The invoice pipeline on streams: micro-batches, duplicates against everything seen, window matches, daily counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallymark.config import DUPLICATE, DuplicateConfig
from tallymark.functions.expressions import day_difference, truthy
from tallymark.operators.assessment import Assessed, Branch, anomaly_branch, assess
from tallymark.operators.duplicates import vendor_ratio, vendor_words


def read(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def process_batch(batch: DataFrame, seen: DataFrame | None, branches: dict[str, Branch] | None = None, vendors: DataFrame | None = None) -> Assessed:
    """Assess one micro-batch; a row whose content was seen before, in the batch or in ``seen`` (file_hash, invoice_id), is a duplicate of risk 100.

    Duplicates may be arbitrarily old, so they are looked up in a table, not in watermarked state.  Without ``branches``,
    the anomaly heuristic is the only one.
    """
    return assess(batch, {"anomaly": anomaly_branch()} if branches is None else branches, seen, vendors)


def failed(batch: DataFrame) -> DataFrame:
    """Rows that cannot be processed, with ``error``; their status goes back to uploaded."""
    error = F.when(F.col("invoice_id").isNull(), "no invoice id").when(F.col("file_hash").isNull(), "no content hash")
    return batch.withColumns({"error": error, "status": F.lit("uploaded")}).where("error IS NOT NULL")


#: Hexadecimal digits of a hash that name the folder in the table of seen contents.
PREFIX = 2


def seen_before(spark: SparkSession, path: str, batch: DataFrame, batch_id: int) -> DataFrame:
    """Contents seen before this batch, of the folders that the batch's hashes fall into: at most 16 ** PREFIX names."""
    prefixes = [r.p for r in batch.where("file_hash IS NOT NULL").select(F.substring("file_hash", 1, PREFIX).alias("p")).distinct().collect()]
    table = spark.read.schema("file_hash string, invoice_id long, prefix string, batch long").parquet(path)
    return table.where((F.col("batch") < batch_id) & F.col("prefix").isin(prefixes)).select("file_hash", "invoice_id")


def start(stream: DataFrame, out: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, branches: dict[str, Branch] | None = None, vendors: DataFrame | None = None) -> StreamingQuery:
    """Process all available input; each batch overwrites its own folders, so a repeated batch leaves one copy.

    Beside ``out`` stand ``out``.seen, the first invoice of every content (dealt by the hash's first digits, and only those
    of a batch are read), and ``out``.errors: the rows of ``failed``, and what branches could not judge (branch, error).
    """
    seen, wide = f"{out}.seen", "file_hash string, invoice_id long"
    stream.sparkSession.createDataFrame([], wide).write.mode("ignore").parquet(f"{seen}/prefix=none/batch=-1")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = process_batch(batch.where("invoice_id IS NOT NULL AND file_hash IS NOT NULL"), seen_before(spark, seen, batch, batch_id), branches, vendors)
        failed(batch).withColumn("branch", F.lit("batch")).unionByName(found.errors, allowMissingColumns=True).write.mode("overwrite").parquet(f"{out}.errors/batch={batch_id}")
        found.rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        done = spark.read.parquet(f"{out}/batch={batch_id}")
        fresh = done.where("new_status <> 'duplicate'").select("file_hash", "invoice_id", F.substring("file_hash", 1, PREFIX).alias("prefix"), F.lit(batch_id).cast("long").alias("batch"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch").parquet(seen)
        if after is not None:
            after(done, batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_matches(new: DataFrame, known: DataFrame, cfg: DuplicateConfig = DUPLICATE, late: str = "1 day") -> DataFrame:
    """Pairs of a new and a known invoice with one amount and similar vendors, dated at most ``window_days`` apart, as ``duplicates.time_window``.

    Both sides (invoice_id, vendor_name, total_amount, invoice_date) may be streams.  They meet by amount and interval, so
    the watermarks bound the state to the invoices of a window; vendors are compared behind the join, as on tables.
    """

    def side(df: DataFrame, pre: str) -> DataFrame:
        cols = [F.col("invoice_id").alias(f"{pre}id"), vendor_words("vendor_name").alias(f"{pre}vendor"), F.col("total_amount").alias(f"{pre}amount"), F.col("invoice_date").cast("timestamp").alias(f"{pre}at")]
        return df.where(truthy("vendor_name") & truthy("total_amount")).select(*cols).withWatermark(f"{pre}at", late)

    reach = F.expr(f"INTERVAL {cfg.window_days + 1} DAYS")
    near = (F.col("b_at") >= F.col("a_at") - reach) & (F.col("b_at") <= F.col("a_at") + reach)
    met = side(new, "a_").join(side(known, "b_"), (F.col("a_amount") == F.col("b_amount")) & near & (F.col("a_id") != F.col("b_id")))
    diff = F.abs(day_difference("a_at", "b_at"))
    pairs = met.where(diff <= cfg.window_days).withColumn("ratio", vendor_ratio(F.col("a_vendor"), F.col("b_vendor"), cfg.vendor_cutoff)).where(F.col("ratio") >= cfg.vendor_cutoff)
    return pairs.select(F.col("a_id").alias("invoice_id"), F.col("b_id").alias("matched_id"), diff.alias("day_diff"))


def daily(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events per day and type; late rows beyond the watermark are dropped when run on a stream."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    g = ts.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.to_date("w.start").alias("day"), "event_type", "n")

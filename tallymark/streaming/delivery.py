"""Delivery of signed messages with retries: a table of attempts, so that a repeated batch sends once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (url, body, headers) to a status code; may raise.
Sender = Callable[[str, str, dict[str, str]], int]
ATTEMPTS = "event_id long, url string, attempt int, status int, error string, at timestamp_ntz, due timestamp_ntz"
MOST, FIRST_WAIT = 5, 60
SIGNATURE = "X-Webhook-Signature"


def state(spark: SparkSession, path: str) -> DataFrame:
    """The last attempt at each message: event_id, url, attempt, status, error, due (null: delivered, or given up)."""
    rows = spark.read.schema(ATTEMPTS).parquet(path)
    last = Window.partitionBy("event_id", "url").orderBy(F.desc("attempt"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def deliver(outbox: DataFrame, path: str, send: Sender, now: dt.datetime, most: int = MOST, first_wait: int = FIRST_WAIT) -> DataFrame:
    """Send what is due of ``outbox`` (event_id, url, body, signature; rows may come again) and append the attempts to the table at ``path``.

    A message is due if it was never tried, or failed and its time has come: ``first_wait`` seconds after the first try, twice
    as long after each further one, ``most`` tries in all.  Returns this call's attempts, as stored.
    Executors send; what was stored as delivered is never sent again.  A task that is lost after sending and before its attempts
    are stored sends again (at least once), and the receiver can tell by the signature and event.
    """
    spark = outbox.sparkSession
    spark.createDataFrame([], ATTEMPTS).write.mode("ignore").parquet(path)
    tried = state(spark, path).select("event_id", "url", F.col("attempt").alias("tried"), F.col("due").alias("was_due"))
    messages = outbox.select("event_id", "url", "body", "signature").dropDuplicates(["event_id", "url"])
    due = messages.join(tried, ["event_id", "url"], "left").where(F.col("tried").isNull() | (F.col("was_due") <= F.lit(now)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for event, url, body, signature, before in zip(f.event_id, f.url, f.body, f.signature, f.tried, strict=True):
                headers = {"Content-Type": "application/json"} | ({SIGNATURE: signature} if isinstance(signature, str) else {})
                attempt = (0 if pd.isna(before) else int(before)) + 1
                status, error = None, None
                try:
                    status = int(send(url, body, headers))
                    if not 200 <= status < 300:
                        error = f"status {status}"
                except Exception as e:  # noqa: BLE001 - a receiver's failure is an attempt
                    error = f"{type(e).__name__}: {e}"[:500]
                again = now + dt.timedelta(seconds=first_wait * 2 ** (attempt - 1)) if error and attempt < most else None
                rows.append((event, url, attempt, status, error, now, again))
            yield pd.DataFrame(rows, columns=["event_id", "url", "attempt", "status", "error", "at", "due"]).astype({"at": "datetime64[us]", "due": "datetime64[us]", "status": "Int32"})

    stamp = f"{path}/call={now:%Y%m%dT%H%M%S%f}"
    due.mapInPandas(run, ATTEMPTS).write.mode("overwrite").parquet(stamp)
    return spark.read.schema(ATTEMPTS).parquet(stamp)


def failures(spark: SparkSession, path: str) -> DataFrame:
    """The error log: messages that were given up, with the last error."""
    return state(spark, path).where("error IS NOT NULL AND due IS NULL").select("event_id", "url", "attempt", "error", "at")

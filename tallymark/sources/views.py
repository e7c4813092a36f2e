"""The invoice model as views over the star schema, and table access."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.config import DUPLICATE
from tallymark.functions.expressions import cents, mean_to_cents
from tallymark.operators import assessment, duplicates, imaging, risk
from tallymark.sources.handoff import kept, once, settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One row per order that has lines: vendor key, amounts in exact units of 1/10000, due date, number of items.

    ``orders``, if given, are the only ones whose lines are summed.
    """
    li = table(spark, sf_dir, "lineitem")
    if orders is not None:
        li = li.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    price = cents("l_extendedprice")
    return li.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("suppkey"),
        F.sum(price * (100 - cents("l_discount"))).alias("sub4"),
        F.sum(price * cents("l_tax")).alias("tax4"),
        F.max("l_shipdate").alias("due_date"),
        F.count("*").alias("n_items"),
        mean_to_cents(F.sum(5000 + 100 * F.col("l_quantity").cast("long")), F.count("*")).alias("confidence"),
    )


def forgery_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What image analysis would leave for each invoice with lines: ela, meta, copy_paste, font (0 to 100).

    Returned lines stand for regions of another error level, repeated quantities for copied blocks, quantities for the
    heights of characters, and the order's priority and state for the image's metadata.
    """
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    lines = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("back"), F.collect_list("l_quantity").alias("heights")).where(F.size("heights") > 0)
    lines = lines.withColumns({"kinds": F.size(F.array_distinct("heights")).cast("long"), "font": imaging.font_score(F.col("heights"))}).drop("heights")
    priority, size = F.col("o_orderpriority"), F.lit(1000)
    image = orders.select(F.col("o_orderkey").alias("l_orderkey"), (priority == "1-URGENT").cast("int").alias("editors"), (priority != "5-LOW").alias("has_exif"), (F.col("o_orderstatus") == "P").alias("has_alpha"), F.lit(300).alias("dpi"), size.alias("width"), size.alias("height"))
    rows = risk.metadata_score(image).select("l_orderkey", "meta").join(lines, "l_orderkey")
    return rows.select(F.col("l_orderkey").alias("invoice_id"), mean_to_cents(10000 * F.col("back"), F.col("n")).alias("ela"), "meta", mean_to_cents(10000 * (F.col("n") - F.col("kinds")), F.col("n")).alias("copy_paste"), "font")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id and file_hash of the invoices whose file is at hand: the document with their number."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("invoice_id"), F.sha2("text", 256).alias("file_hash"))


def assessed(spark: SparkSession, sf_dir: str) -> assessment.Assessed:
    """All invoices as one batch through the branches of ``assessment``.

    What several steps read is stored first, one table after the other, so that only one step's shuffles are on disk at a time.
    """
    semantic = settle(duplicates.semantic_signal(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "invoice_id"), key="invoice_id"), "semantic")
    inv = settle(invoices(spark, sf_dir, store=lambda df: settle(df, "orders")), "invoices")
    nearest = duplicates.time_window(inv, replace(DUPLICATE, top_k=1))
    window = settle(nearest.select("invoice_id").distinct().withColumn("window", F.lit(100.0)), "window")
    batch = inv.join(contents(spark, sf_dir), "invoice_id", "left")
    branches = {"forgery": assessment.forgery_branch(forgery_evidence(spark, sf_dir)), "duplicate": assessment.duplicate_branch(semantic, window), "anomaly": assessment.anomaly_branch()}
    return assessment.assess(batch, branches, vendors=settle(risk.vendor_statistics(inv), "vendors"))


_INPUTS = ("orders", "lineitem", "supplier", "customer", "documents")


def _assessment(spark: SparkSession, sf_dir: str) -> assessment.Assessed:
    return once(spark, "assessment", [f"{sf_dir}/{t}.parquet" for t in _INPUTS], lambda: assessed(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assessed invoices as a stored table, made again when a file of the inputs changes."""
    return kept(spark, "assessed", [f"{sf_dir}/{t}.parquet" for t in _INPUTS], lambda: _assessment(spark, sf_dir).rows)


def branch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, "branch-errors", [f"{sf_dir}/{t}.parquet" for t in _INPUTS], lambda: _assessment(spark, sf_dir).errors)


def _head() -> list[Column]:
    """Columns of an invoice that its order has by itself."""
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    return [
        key.alias("invoice_id"),
        F.concat(F.lit("INV-"), F.lpad(key.cast("string"), 8, "0")).alias("invoice_number"),
        F.col("o_totalprice").alias("total_amount"),
        F.col("o_orderdate").alias("invoice_date"),
        F.col("o_orderdate").alias("created_at"),
        F.when(state == "F", "flagged").when(state == "O", "approved").otherwise("under_review").alias("status"),
    ]


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices without what lines, vendors and buyers tell: one scan of the orders."""
    return table(spark, sf_dir, "orders").select(*_head())


def invoices(spark: SparkSession, sf_dir: str, where: str | None = None, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Invoices: an order with its vendor (null without lines), buyer, amounts, dates, and the mean confidence of its lines.

    ``where`` is a condition on the order; lines of others are not summed.  ``store`` writes and reads a table between the sums and the names.
    """
    o, c, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    if where is not None:
        o = o.where(where)
    lines = order_lines(spark, sf_dir, None if where is None else o)
    sums = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey", "o_orderpriority")
    sums = sums if store is None else store(sums)
    rows = sums.join(s.select("s_suppkey", "s_name"), F.col("suppkey") == F.col("s_suppkey"), "left").join(c.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    of_lines = [(F.col("sub4").cast("double") / 10000).alias("subtotal"), (F.col("tax4").cast("double") / 10000).alias("tax_amount"), F.col("due_date"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("confidence").alias("ocr_confidence")]
    every = rows.select(*_head(), F.col("s_name").alias("vendor_name"), F.col("c_name").alias("buyer_name"), *of_lines)
    return every.select("invoice_id", "vendor_name", "buyer_name", "invoice_number", "total_amount", "subtotal", "tax_amount", "invoice_date", "due_date", "created_at", "n_items", "ocr_confidence", "status")

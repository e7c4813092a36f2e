"""Ranks within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

_IN_TASK = (1 << 33) - 1


def positions(df: DataFrame, group: str, order: list, name: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``pos``, the place of each row in its group from 0; the groups with their row count ``n``), both tables.

    ``group`` is a column without nulls, ``order`` a list of sort columns.  Rows are dealt by ranges of (group, order), so a
    group that holds a third of all rows is many ranges.  A range counts its rows of each group; the sums of the earlier
    ranges are added to the place within the range.  Rows that are equal in all of it are told apart by where they were
    stored, so that no crowd of equal rows is one task's work; which of them comes first doesn't matter to the caller.
    """
    spark = df.sparkSession
    stored = materialize(df.withColumn("_row", F.monotonically_increasing_id()), f"{name}-stored")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *order, F.col("_row")]
    dealt = stored.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    sorted_rows = materialize(dealt, f"{name}-sorted")
    discard(stored)
    part = F.shiftright("_at", 33).cast("int").alias("_part")
    here = F.col("_at").bitwiseAND(F.lit(_IN_TASK))
    runs = sorted_rows.groupBy(group, part).agg(F.count("*").alias("_n"), F.min(here).alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(runs.select(group, "_part", "_n", (before - F.col("_first")).alias("_shift")), f"{name}-starts")
    placed = sorted_rows.withColumn("_part", part).join(starts.select(group, "_part", "_shift"), [group, "_part"])
    out = placed.withColumn("pos", here + F.col("_shift")).drop("_at", "_part", "_shift")
    return out, starts.groupBy(group).agg(F.sum("_n").alias("n"))

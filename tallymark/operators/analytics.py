"""Dashboards, rankings, alerts, listings, audit queries, webhooks and reviews."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import strings
from tallymark.functions.expressions import cents, first_argmax, mean_to_cents
from tallymark.sources.handoff import hand_over

LEVELS = ("low", "medium", "high", "critical")


def as_of(df: DataFrame, column: str = "created_at") -> dt.datetime:
    """Latest time in the table; queries never read the clock."""
    return df.agg(F.max(column)).first()[0]


def since(df: DataFrame, now: dt.datetime, days: int, column: str = "created_at") -> DataFrame:
    return df.where(F.col(column) >= F.lit(now - dt.timedelta(days=days)).cast("timestamp_ntz"))


def dashboard(inv: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """All key figures of the last days in one pass."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    st, level = F.col("status"), F.col("risk_level")
    return since(inv, now, days).agg(
        F.count("*").alias("total_invoices"), count(st == "flagged").alias("flagged"), count(st == "approved").alias("approved"), count(st == "rejected").alias("rejected"),
        count(level == "high").alias("high_risk"), count(level == "critical").alias("critical_risk"),
        F.coalesce(mean_to_cents(F.sum(cents("risk_score")), F.count("risk_score")), F.lit(0.0)).alias("avg_risk"),
        F.coalesce(F.round(F.sum(F.round(F.col("total_amount") * 100).cast("long")) / 100, 2), F.lit(0.0)).alias("total_amount"),
        count(F.col("duplicate_score") > 80).alias("duplicates"), count(F.col("created_at") >= F.date_trunc("day", F.lit(now)).cast("timestamp_ntz")).alias("today"),
    )


def vendor_ranking(inv: DataFrame) -> DataFrame:
    """Risk per vendor: count, high-risk count, mean risk, amount, share of high risk; worst first."""
    high = F.col("risk_level").isin("high", "critical")
    g = inv.where("vendor_name IS NOT NULL AND vendor_name <> ''").groupBy("vendor_name").agg(
        F.count("*").alias("total_invoices"), F.count_if(high).alias("flagged_count"),
        mean_to_cents(F.sum(cents("risk_score")), F.count("risk_score")).alias("avg_risk_score"),
        (F.sum(F.round(F.col("total_amount") * 100).cast("long")) / 100).alias("total_amount"),
    )
    return g.withColumn("flag_rate", F.round(F.col("flagged_count") / F.col("total_invoices") * 100, 2))


def vendor_rollup(ranking: DataFrame) -> DataFrame:
    return ranking.agg(F.count_if(F.col("flag_rate") > 20).alias("high_risk_vendors"), mean_to_cents(F.sum(cents("avg_risk_score")), F.count("*")).alias("mean_risk"), F.count("*").alias("vendors"), (F.sum(cents("total_amount")) / 100).alias("total_volume"))


def risk_distribution(inv: DataFrame) -> DataFrame:
    """Invoices per level; levels without any are there with 0."""
    have = inv.where("risk_level IS NOT NULL").groupBy("risk_level").agg(F.count("*").alias("n"))
    every = inv.sparkSession.createDataFrame([(x,) for x in LEVELS], "risk_level string")
    return every.join(have, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def timeline(inv: DataFrame) -> DataFrame:
    return inv.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "flagged").alias("flagged"))


def alerts(inv: DataFrame) -> DataFrame:
    """High and critical invoices that wait for someone; the type is the first of the largest component scores."""
    kind = first_argmax(forgery=F.coalesce("forgery_score", F.lit(0.0)), duplicate=F.coalesce("duplicate_score", F.lit(0.0)), anomaly=F.coalesce("anomaly_score", F.lit(0.0)))
    rows = inv.where(F.col("risk_level").isin("high", "critical") & F.col("status").isin("flagged", "under_review"))
    text = F.substring(F.concat(F.lit("High "), F.col("alert_type"), F.lit(" risk detected")), 1, 200)
    return rows.withColumn("alert_type", kind).select("invoice_id", "vendor_name", "risk_score", "risk_level", "alert_type", text.alias("description"))


SORTABLE = ("created_at", "invoice_date", "total_amount", "risk_score", "vendor_name", "invoice_number", "invoice_id")


def listing(inv: DataFrame, status: str | None = None, risk_level: str | None = None, vendor: str | None = None, search: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows that meet all given filters; unknown status and level values are ignored."""
    out = inv
    if status in ("uploaded", "processing", "analyzed", "flagged", "under_review", "approved", "rejected", "duplicate"):
        out = out.where(F.col("status") == status)
    if risk_level in LEVELS:
        out = out.where(F.col("risk_level") == risk_level)
    if vendor:
        out = out.where(F.col("vendor_name").ilike(f"%{vendor}%"))
    if search:
        fields = [c for c in ("filename", "vendor_name", "invoice_number") if c in out.columns]
        out = out.where(functools.reduce(Column.__or__, (F.col(c).ilike(f"%{search}%") for c in fields)))
    if date_from:
        out = out.where(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        out = out.where(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    return out


def page(df: DataFrame, sort_by: str = "created_at", descending: bool = True, number: int = 1, size: int = 20, key: str = "invoice_id") -> DataFrame:
    """One page in a total order: unknown columns sort by created_at, nulls last, ties by key."""
    c = F.col(sort_by if sort_by in SORTABLE else "created_at")
    size = min(100, max(1, size))
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), key).offset((max(1, number) - 1) * size).limit(size)


def audit_entries(events: DataFrame) -> DataFrame:
    """The event stream as an audit trail; entries about an invoice are those that carry a number."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select("event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("action"), "user_id", F.when(k.isNotNull(), "invoice").otherwise("system").alias("entity_type"), k.alias("entity_id"), F.coalesce("props", F.lit("{}")).alias("details"))


def audit_query(audit: DataFrame, action: str | None = None, user_id: int | None = None, entity_type: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    for name, v in (("action", action), ("user_id", user_id), ("entity_type", entity_type)):
        if v is not None:
            audit = audit.where(F.col(name) == v)
    if date_from:
        audit = audit.where(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        audit = audit.where(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    return audit


#: Salts over which events meet the configurations that take all of them.
SALTS = 64


def outbox(events: DataFrame, configs: DataFrame) -> DataFrame:
    """Messages to deliver: each event to each active configuration that lists its type or *, with the signature of its body.

    ``configs`` (url, events array, secret, is_active) is small by nature.  Events meet those that take every type by a
    salt, so that no key holds all events if the planner doesn't broadcast.  Without a secret there is no signature.
    """
    subs = configs.where("is_active").select("url", "secret", F.explode(F.array_distinct("events")).alias("type"))
    exact = events.join(subs, events["event_type"] == subs["type"])
    all_of = subs.where("type = '*'").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = events.withColumn("__salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int")).join(all_of, "__salt").drop("__salt")
    body = F.to_json(F.struct(F.col("event_type").alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("props").alias("data")))
    rows = exact.unionByName(every).select("event_id", "url", "event_type", "secret", body.alias("body")).dropDuplicates(["event_id", "url"])
    return rows.withColumn("signature", strings.udf_signature()(F.col("body"), F.col("secret"))).drop("secret")


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of a report."""
    return df.orderBy(*order).limit(k)


#: Roles that may see or change something.
ROLES = {"upload": ("admin", "manager", "auditor", "analyst"), "rank_vendors": ("admin", "manager", "auditor"), "read_audit": ("admin", "auditor"), "configure": ("admin",)}


def allowed(users: DataFrame, right: str) -> DataFrame:
    """Users whose role has the right; unknown rights are nobody's."""
    return users.where(F.col("role").isin(*ROLES.get(right, ())))


def taken(users: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (email, username) with ``exists``: a user has that email or that name.  Nulls are equal to nothing."""
    key = lambda c: users.where(F.col(c).isNotNull()).select(F.col(c).alias(f"__{c}")).distinct()
    out = asked.join(key("email"), F.col("email") == F.col("__email"), "left").join(key("username"), F.col("username") == F.col("__username"), "left")
    return out.withColumn("exists", F.col("__email").isNotNull() | F.col("__username").isNotNull()).drop("__email", "__username")


def heatmap_of(results: DataFrame, files: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The image of each invoice's first forgery result (by created_at, then path); ``found`` is false where the file is missing."""
    one = results.where("heatmap_path IS NOT NULL").groupBy(key).agg(F.min_by("heatmap_path", F.struct("created_at", "heatmap_path")).alias("path"))
    return one.join(files.select("path", "content"), "path", "left").select(key, "path", "content", F.col("content").isNotNull().alias("found"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Append rows (action, user_id, entity_type, entity_id, details, created_at) to the trail; what is absent gets its default."""
    kind = F.coalesce("entity_type", F.when(F.col("entity_id").isNotNull(), "invoice").otherwise("system"))
    entries.withColumns({"entity_type": kind, "details": F.coalesce("details", F.lit("{}"))}).write.mode("append").parquet(path)


def apply_reviews(inv: DataFrame, reviews: DataFrame) -> DataFrame:
    """Status after the latest review of each invoice; a request for information changes nothing."""
    w = F.max_by(F.struct("decision", "review_id"), F.struct("created_at", "review_id"))
    last = reviews.where(F.col("decision") != "request_info").groupBy("invoice_id").agg(w["decision"].alias("decision"))
    new = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "flag", "flagged")
    return inv.join(last, "invoice_id", "left").withColumn("status", F.coalesce(new, "status")).drop("decision")


def delete(df: DataFrame, ids: DataFrame, key: str = "invoice_id") -> DataFrame:
    return df.join(ids, key, "left_anti")


def model_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and AUC (ties count half) of ``scores`` (label 0/1, score): measured, not asserted.

    AUC needs, for each score, how many negatives lie below it.  Scores are counted, dealt by ranges and summed within each
    range; the ranges' totals, one row each, give what lies below the range.  No score is rounded, and no task has all.
    """
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = scores.where("score IS NOT NULL").groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    ranged = hand_over(by.repartitionByRange(parts, "score").withColumn("part", F.spark_partition_id()), "scores")
    upto = Window.unboundedPreceding, -1
    starts = ranged.groupBy("part").agg(F.sum("n").alias("own")).select("part", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(*upto)), F.lit(0))
    t = ranged.withColumn("inside", inside).join(starts, "part").agg(
        F.sum(F.when(F.col("score") >= threshold, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("score") >= threshold, F.col("n")).otherwise(0)).alias("fp"),
        F.sum("p").alias("np"), F.sum("n").alias("nn"), F.sum((F.col("p") * (2 * (F.col("start") + F.col("inside")) + F.col("n"))).cast("decimal(38,0)")).alias("u2"),
    )
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide("tp", "np")
    auc = F.try_divide(F.col("u2").cast("double"), 2.0 * F.col("np") * F.col("nn"))
    return t.select(F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2 * precision * recall, precision + recall), 6).alias("f1"), F.round(auc, 6).alias("auc"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with ``rank`` and the group's ``total_matches``."""
    w = Window.partitionBy(group)
    return df.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "total_matches": F.count("*").over(w)}).where(F.col("rank") <= k)

"""Rule score, anomaly heuristics, composite risk, class, action and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.config import RISK, RiskConfig
from tallymark.functions.expressions import clamp, day_difference, first_argmax, hundredths, integral, truthy, weekend


def _points(cond: Column, n: float) -> Column:
    return F.when(cond, F.lit(float(n))).otherwise(0.0)


def _amount(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def with_rule_score(inv: DataFrame) -> DataFrame:
    """Adds rule_score (0 to 100) and rule_flags; zero and empty count as missing.  Uses vendor_avg and vendor_std if there."""
    total, tax = _amount("total_amount"), _amount("tax_amount")
    rate = tax / F.nullif(total, F.lit(0.0))
    days = day_difference("due_date", "invoice_date")
    missing = [c for c in ("invoice_number", "vendor_name", "total_amount")]
    absent = F.filter(F.array(*[F.when(~truthy(c), F.lit(c)) for c in missing]), lambda x: x.isNotNull())
    rules = [
        ((total > 10000) & integral(total), 20, F.lit("round_number_high_amount")),
        ((total > 0) & (tax > 0) & ((rate > 0.25) | (rate < 0.03)), 15, F.format_string("unusual_tax_rate_%.2f%%", rate * 100)),
        (weekend("invoice_date"), 15, F.lit("weekend_invoice_date")),
        (total > 100000, 15, F.lit("very_high_amount")),
        ((days > 0) & (days < 15), 15, F.format_string("short_payment_terms_%d_days", days)),
    ]
    if {"vendor_avg", "vendor_std"} <= set(inv.columns):
        rules.append(((F.col("vendor_avg") > 0) & (F.col("vendor_std") > 0) & (total > F.col("vendor_avg") + 3 * F.col("vendor_std")), 25, F.lit("amount_exceeds_3_std_deviations")))
    rules.append((F.size(absent) > 0, 0, F.concat(F.lit("missing_fields:"), F.array_join(absent, ","))))
    score = sum((_points(F.coalesce(c, F.lit(False)), n) for c, n, _ in rules), F.lit(0.0)) + 5.0 * F.size(absent)
    flags = F.filter(F.array(*[F.when(c, f) for c, _, f in rules]), lambda x: x.isNotNull())
    return inv.withColumns({"rule_score": F.least(F.lit(100.0), score), "rule_flags": flags})


def with_heuristics(inv: DataFrame) -> DataFrame:
    """Adds anomaly_score, the untrained heuristic, and the three feature flags."""
    total, tax = _amount("total_amount"), _amount("tax_amount")
    rate = F.when(total > 0, tax / total).otherwise(0.0)
    conf = F.coalesce("ocr_confidence", F.lit(100.0))
    score = (
        _points(integral(total) & (total > 1000), 15)
        + _points((total > 0) & (tax > 0) & ((rate > 0.30) | (rate < 0.01)), 20)
        + _points(total > 100000, 15)
        + _points(conf < 60, 15)
        + sum((_points(~truthy(c), 10) for c in ("invoice_number", "vendor_name", "total_amount")), F.lit(0.0))
    )
    return inv.withColumns({
        "anomaly_score": F.least(F.lit(100.0), score),
        "high_value": total > 50000,
        "unusual_tax": (rate > 0.25) | ((rate > 0) & (rate < 0.03)),
        "low_confidence": conf < 70,
    })


def classify(score: Column, cfg: RiskConfig = RISK) -> Column:
    return F.when(score <= cfg.low_max, "low").when(score <= cfg.medium_max, "medium").when(score <= cfg.high_max, "high").otherwise("critical")


def action(level: Column) -> Column:
    return F.when(level == "low", "auto_approve").when(level == "critical", "block_and_alert").otherwise("manual_review")


def status(level: Column) -> Column:
    return F.when(level.isin("critical", "high"), "flagged").when(level == "medium", "under_review").otherwise("analyzed")


def with_composite(scored: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Adds contributions, risk_score, risk_level, recommended_action, new_status, dominant_risk.

    Null component scores count as 0, as a failed branch does.
    """
    parts = {"forgery": ("forgery_score", cfg.w_forgery), "duplicate": ("duplicate_score", cfg.w_duplicate), "anomaly": ("anomaly_score", cfg.w_anomaly), "rules": ("rule_score", cfg.w_rules)}
    raw = {k: F.coalesce(c, F.lit(0.0)) * w for k, (c, w) in parts.items()}
    out = scored.withColumns({f"c_{k}": hundredths(v) for k, v in raw.items()} | {"risk_score": hundredths(clamp(sum(raw.values(), F.lit(0.0))))})
    c = {k: F.col(f"c_{k}") for k in parts}
    level = classify(F.col("risk_score"), cfg)
    dominant = F.when(F.greatest(*c.values()) > 0, first_argmax(**c)).otherwise("none")
    return out.withColumns({"risk_level": level, "recommended_action": action(level), "new_status": status(level), "dominant_risk": dominant})


def legacy_rule_score(confidence: Column, flags: Column) -> Column:
    """Rule score when no invoice data is at hand."""
    return F.least(F.lit(100.0), 0.5 * F.greatest(F.lit(0.0), 100 - confidence) + 20 * flags)


def scored(inv: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Rules, heuristics and composite in one pass over the rows."""
    return with_composite(with_heuristics(with_rule_score(inv)), cfg)


def vendor_statistics(inv: DataFrame) -> DataFrame:
    """Mean, population deviation and count of each vendor's amounts: inputs of the 3-sigma rule."""
    cents_ = F.round(F.col("total_amount") * 100).cast("long")
    n, s, q = F.count(cents_), F.sum(cents_), F.sum((cents_ * cents_).cast("decimal(38,0)"))
    n_ = F.nullif(n, F.lit(0))
    mean = s / n_ / 100
    return inv.where("vendor_name IS NOT NULL").groupBy("vendor_name").agg(n.alias("n"), F.round(mean, 6).alias("vendor_avg"), F.round(F.sqrt(F.greatest(F.lit(0.0), (q * n - (s.cast("decimal(38,0)") * s)).cast("double"))) / n_ / 100, 4).alias("vendor_std"))


def forgery(df: DataFrame) -> DataFrame:
    """Adds overall, is_forged and summary from ela, meta, copy_paste and font scores."""
    overall = hundredths(0.30 * F.col("ela") + 0.25 * F.col("meta") + 0.15 * F.col("copy_paste") + 0.30 * F.col("font"))
    band = F.when(F.col("overall") < 20, "Document appears authentic").when(F.col("overall") < 50, "Minor irregularities").when(F.col("overall") < 75, "Suspicious: likely modified").otherwise("High probability of forgery")
    return df.withColumn("overall", overall).withColumns({"is_forged": F.col("overall") > 50, "summary": band})


def metadata_score(df: DataFrame) -> DataFrame:
    """Score of image metadata: columns editors (tags that name an editor), has_exif, has_alpha, dpi, width, height."""
    score = 30 * F.col("editors") + _points(~F.col("has_exif"), 10) + _points(F.col("has_alpha"), 15) + _points(F.coalesce("dpi", F.lit(0)) < 72, 10) + _points(F.least("width", "height") < 200, 15)
    return df.withColumn("meta", F.least(F.lit(100.0), score.cast("double")))

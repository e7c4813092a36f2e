"""Constants of the scoring model, passed explicitly; nothing here is global state."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RiskConfig:
    """Weights and thresholds of the composite risk (reconfigurable at run time through ``with_*``)."""

    w_forgery: float = 0.30
    w_duplicate: float = 0.25
    w_anomaly: float = 0.25
    w_rules: float = 0.20
    low_max: float = 30.0
    medium_max: float = 60.0
    high_max: float = 85.0

    def with_weights(self, **kw: float) -> RiskConfig:
        """A copy with some weights changed; their sum is not checked."""
        return replace(self, **{f"w_{k}": v for k, v in kw.items() if v is not None})

    def with_thresholds(self, **kw: float) -> RiskConfig:
        return replace(self, **{k: v for k, v in kw.items() if v is not None})


@dataclass(frozen=True)
class DuplicateConfig:
    window_days: int = 90
    vendor_cutoff: float = 85.0
    fuzzy_keep: float = 60.0
    near: float = 80.0
    semantic_min: float = 0.85
    top_k: int = 10
    knn_k: int = 5
    knn_distance: float = 0.5


@dataclass(frozen=True)
class IngestConfig:
    max_bytes: int = 50 * 1024 * 1024
    max_files: int = 1000
    extensions: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg", "tiff", "tif")


RISK, DUPLICATE, INGEST = RiskConfig(), DuplicateConfig(), IngestConfig()

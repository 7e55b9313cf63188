"""Configuration objects and fixed values.

Fixed values below must equal the ones the original pipeline uses for its
results to be comparable; they are listed plainly and in their natural order.
"""
from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must match the original pipeline)
# ---------------------------------------------------------------------------
# Survey condition catalogue: (suffix, display name).
SURVEY_CONDITIONS = [
    ("DIABE", "Diabetes"),
    ("HIBPE", "High blood pressure"),
    ("CANCR", "Cancer"),
    ("LUNGE", "Lung disease"),
    ("HEARTE", "Heart disease"),
    ("STROKE", "Stroke"),
    ("PSYCHE", "Psychiatric"),
    ("ARTHRE", "Arthritis"),
]
# Columns that get per-person delta / pct_change features.
TEMPORAL_FEATURES_BASE = ["BMI", "WEIGHT", "SHLT", "HIBPE", "HEARTE", "DIAB", "CONDE"]
# Keywords for keyword-based feature subsets.
AGG_KEYWORDS = ["mean", "max", "min", "std", "count", "sum", "median"]
# Temporal split: train waves 3-9, validation waves 10-12.
TRAIN_WAVES = (3, 9)
VAL_WAVES = (10, 12)
# Long panel keeps waves 3-14; targets exist for waves up to 12.
LONG_WAVES = (3, 14)
TARGET_MAX_WAVE = 12
# Wide files have waves 1..16.
MAX_WAVE = 16
# SMOTE minority/majority target ratio, neighbours, seed.
SMOTE_RATIO = 0.33
SMOTE_K = 5
RANDOM_STATE = 42
# F-beta grid: numpy arange(0.1, 0.9, 0.01) -> 80 points.
FBETA_GRID = (0.1, 0.9, 0.01)
# Focal loss defaults.
FOCAL_GAMMA = 2.0
FOCAL_ALPHA = 0.25
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class PanelSpec:
    """Names of the key, time and wide-prefix columns of a panel."""
    key: str = "id"
    time: str = "wave"
    wide_key: str = "HHIDPN"
    prefix: str = "R"
    target_prefix: str = "target_"


@dataclass(frozen=True)
class SplitSpec:
    train: tuple[int, int] = TRAIN_WAVES
    val: tuple[int, int] = VAL_WAVES


@dataclass
class RunConfig:
    """One single-condition run."""
    condition: str
    model_type: str = "gbt"
    features: list[str] | None = None
    sample_fraction: float | None = None
    sample_rows: int | None = None
    params: dict = field(default_factory=dict)
    split: SplitSpec = field(default_factory=SplitSpec)
    weighting: str = "balanced"

    @classmethod
    def from_mapping(cls, said: dict) -> RunConfig:
        """From a configuration file's mapping; what it leaves out has the usual value (condition DIABE, lr)."""
        model = said.get("model") or {}
        return cls(said.get("target_suffix", "DIABE"), model.get("type", "lr"), said.get("feature_columns") or None,
                   said.get("sample_fraction"), said.get("sample_rows"), dict(model.get("params") or {}),
                   weighting=said.get("weighting", "balanced"))

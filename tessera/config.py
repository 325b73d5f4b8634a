"""Fixed values that define operator semantics.

These numbers must equal the reference's defaults for results to agree;
they are stated here together, in one place.
"""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values: quality thresholds
    missing_warn_pct: float = 5.0
    missing_critical_pct: float = 30.0
    duplicate_warn_pct: float = 1.0
    class_imbalance_ratio: float = 0.3
    iqr_multiplier: float = 1.5
    high_correlation: float = 0.95
    low_variance: float = 0.01
    outlier_issue_pct: float = 5.0
    # fixed values: dimensionality and splits
    pca_variance: float = 0.95
    test_size: float = 0.2
    validation_size: float = 0.1
    cv_folds: int = 5
    seed: int = 42
    # fixed values: encoding and feature caps
    one_hot_default_cap: int = 50
    one_hot_hard_cap: int = 100
    high_card_info: int = 50
    high_card_warning: int = 100
    high_card_critical: int = 1000
    poly_max_inputs: int = 20
    poly_max_degree: int = 3
    poly_max_outputs: int = 1000
    # fixed values: quality score weights
    penalty_critical: int = 15
    penalty_warning: int = 5
    penalty_info: int = 1
    # fixed values: anomaly thresholds
    zscore_threshold: float = 3.0
    modified_z_threshold: float = 3.5
    modified_z_constant: float = 0.6745


CONFIG = Config()

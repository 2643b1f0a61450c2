"""The whole search: listings in, ranked deals out, every segment in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from dealwright.config import DealSearch, OutlierSettings, TrainingSettings
from dealwright.operators import deals, filters, outliers, robust, train, value
from dealwright.session import SMALL, materialise
from dealwright.sources.tables import scan_segments


def price_features(training: TrainingSettings) -> Sequence[str] | None:
    """What the segment models price on; None stands for the line in age and distance."""
    if training.model not in ("line", "ridge", "bag", "absolute"):
        raise ValueError(f"unknown segment model {training.model!r}")
    return None if training.model == "line" else training.features


def fit_segments(rows: DataFrame, training: TrainingSettings = TrainingSettings()) -> DataFrame:
    """The stored segment models of the configured kind."""
    features = price_features(training)
    if features is None:
        return train.train_specific(rows)
    if training.model == "absolute":
        return robust.train_absolute(rows, features)
    folds = training.bag_folds if training.model == "bag" else 0
    return train.train_ridge(rows, features, alpha=training.ridge_alpha, folds=folds, seed=training.seed)


def train_segments(features: DataFrame, training: TrainingSettings = TrainingSettings()) -> DataFrame:
    """Models of the segments large enough for one of their own."""
    return fit_segments(filters.min_rows_gate(features, training.min_rows_specific), training)


def score(
    features: DataFrame,
    models: DataFrame,
    comparison_region: str | None = None,
    training: TrainingSettings = TrainingSettings(),
) -> DataFrame:
    """Listings of modelled segments with estimate, discount and, if asked for, the regional what-if."""
    priced_on = price_features(training)
    rows = value.attach_specific(features, models).where("s_n IS NOT NULL")
    rows = deals.add_discount(rows.withColumn("prediction_label", train.specific_value("s_", features=priced_on)))
    if comparison_region:
        rows = value.regional_compare(rows, comparison_region, base="prediction_label", features=priced_on)
    return value.drop_models(rows)


def search_deals(
    features: DataFrame,
    search: DealSearch = DealSearch(),
    outlier_settings: OutlierSettings = OutlierSettings(),
    training: TrainingSettings = TrainingSettings(),
    models: DataFrame | None = None,
) -> DataFrame:
    """Ranked deals among cleaned fixed-price listings.

    Only the segments that the search names are touched. ``models`` are trained here unless given; segments are judged
    large enough before outliers go. Outliers are left out both of training and of scoring, so a listing so cheap that
    it counts as an outlier is not reported; use the method 'none' to see those as well.
    """
    rows = scan_segments(features, search.segments) if search.segments else features
    if models is None:
        rows = filters.min_rows_gate(rows, training.min_rows_specific)
    if outlier_settings.method != "none":
        # Read by the line fit, the region fit and the scoring: decide on outliers once.
        rows = materialise(outliers.remove_outliers(rows, outlier_settings), SMALL)
    models = fit_segments(rows, training) if models is None else models
    scored = score(rows, models, search.comparison_region, training)
    found = deals.undervalued_pct(scored, search.min_discount_pct, search.max_discount_pct)
    return deals.rank_deals(filters.apply_filters(found, search.filters))

"""Valuation of given cars: estimate, intervals, tail, regional and depreciation what-ifs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from dealwright.config import BlendSettings, OutlierSettings, TrainingSettings
from dealwright.operators import filters, outliers, robust, stacking, train, value
from dealwright.plans.deal_search import fit_segments, price_features
from dealwright.session import materialise


@dataclass(frozen=True)
class Models:
    """Everything a valuation needs."""

    specific: DataFrame
    general: train.GeneralModel | None
    quantiles: train.QuantileModel | robust.QuantileRegression | None = None
    tails: DataFrame | None = None
    training: TrainingSettings = TrainingSettings()

    def tail_value(self, model: str):
        features = price_features(self.training)
        return value.line_of(model) if features is None else value.ridge_of(model, features)


LINE_DETAILS = ("intercept", "b_age", "b_odometer")


def train_tails(features: DataFrame, training: TrainingSettings = TrainingSettings()) -> DataFrame:
    """Tail models of the same kind as the segment models."""
    priced_on = price_features(training)
    if priced_on is None:
        return train.train_tails(features, train.fit_lines, min_rows=training.min_tail_rows, details=LINE_DETAILS)

    def fit(rows: DataFrame, keys) -> DataFrame:
        return train.fit_ridge(rows, keys, priced_on, training.ridge_alpha)

    return train.train_tails(features, fit, min_rows=training.min_tail_rows)


def train_models(
    features: DataFrame,
    training: TrainingSettings = TrainingSettings(),
    outlier_settings: OutlierSettings = OutlierSettings(),
) -> Models:
    """Fit every model a valuation needs on cleaned listings; each is kept as a small table.

    Segments are judged large enough on all their rows; outliers are left out of every fit.
    """
    rows = filters.segment_counts(features, "_segment_rows")
    if outlier_settings.method != "none":
        rows = materialise(outliers.remove_outliers(rows, outlier_settings))
    large = rows.where(rows["_segment_rows"] >= training.min_rows_specific).drop("_segment_rows")
    pooled = rows.where(rows["_segment_rows"] >= training.min_rows_general).drop("_segment_rows")
    if training.general_folds:
        general = stacking.train_general_bag(pooled, training.general_folds, training.seed)
    else:
        general = train.train_general(pooled)
    rows = rows.drop("_segment_rows")
    quantiles = train.train_quantiles(train.add_bands(rows))
    if training.quantile_lines:
        quantiles = robust.train_quantile_regression(rows, fallback=quantiles)
    return Models(
        fit_segments(large, training),
        general,
        quantiles,
        train_tails(rows, training),
        training,
    )


def save_models(models: Models, path: str) -> None:
    """Every model as a Parquet table under ``path``; what is not there is not written."""
    spark = models.specific.sparkSession
    models.specific.write.parquet(f"{path}/specific")
    if models.general:
        g = models.general
        line = [(g.intercept, g.b_age, g.b_odometer, g.n)]
        spark.createDataFrame(line, "intercept double, b_age double, b_odometer double, n long").write.parquet(f"{path}/general/line")
        g.make_effects.write.parquet(f"{path}/general/makes")
        g.model_effects.write.parquet(f"{path}/general/models")
    if models.quantiles:
        q = models.quantiles
        if isinstance(q, robust.QuantileRegression):
            q.lines.write.parquet(f"{path}/quantiles/lines")
            named = json.dumps({"features": q.features, "keys": q.keys, "levels": dict(q.levels)})
            spark.createDataFrame([(named,)], "settings string").write.parquet(f"{path}/quantiles/line_settings")
            q = q.fallback
        q.leaves.write.parquet(f"{path}/quantiles/leaves")
        q.segments.write.parquet(f"{path}/quantiles/segments")
        overall = [(json.dumps({"overall": dict(q.overall), "leaf": q.leaf_keys, "segment": q.segment_keys, "rows": q.min_leaf_rows}),)]
        spark.createDataFrame(overall, "settings string").write.parquet(f"{path}/quantiles/settings")
    if models.tails is not None:
        models.tails.write.parquet(f"{path}/tails")
    spark.createDataFrame([(json.dumps(asdict(models.training)),)], "settings string").write.parquet(f"{path}/training")


def load_models(spark: SparkSession, path: str) -> Models:
    """Models that ``save_models`` has stored with all their parts."""

    def settings(name: str) -> dict:
        return json.loads(spark.read.parquet(f"{path}/{name}").first()["settings"])

    line = spark.read.parquet(f"{path}/general/line").first()
    general = train.GeneralModel(
        *line, spark.read.parquet(f"{path}/general/makes"), spark.read.parquet(f"{path}/general/models")
    )
    q, training = settings("quantiles/settings"), settings("training")
    quantiles = train.QuantileModel(
        spark.read.parquet(f"{path}/quantiles/leaves"), spark.read.parquet(f"{path}/quantiles/segments"),
        q["overall"], tuple(q["leaf"]), tuple(q["segment"]), q["rows"],
    )
    training["features"] = tuple(training["features"])
    if training.get("quantile_lines"):
        named = settings("quantiles/line_settings")
        lines = spark.read.parquet(f"{path}/quantiles/lines")
        quantiles = robust.QuantileRegression(lines, tuple(named["features"]), tuple(named["keys"]), named["levels"], quantiles)
    return Models(
        spark.read.parquet(f"{path}/specific"), general, quantiles, spark.read.parquet(f"{path}/tails"), TrainingSettings(**training)
    )


def predict_with_confidence(specs: DataFrame, models: Models, blend: BlendSettings = BlendSettings()) -> DataFrame:
    """Blended estimate with intervals and tail correction. The intervals are not moved by the correction."""
    rows = value.predict_blended(specs, models.specific, models.general, blend, price_features(models.training))
    if models.quantiles:
        rows = value.predict_interval(train.add_bands(rows), models.quantiles).drop("age_band", "km_band")
    if models.tails is not None:
        return value.tail_adjust(rows, models.tails, models.tail_value)
    return rows.withColumn("estimate", rows["prediction_label"])


def value_specs(
    specs: DataFrame,
    models: Models,
    comparison_region: str | None = None,
    base: str = "specific",
    blend: BlendSettings = BlendSettings(),
) -> DataFrame:
    """Value every row of ``specs``.

    The what-ifs compare with the segment model's own estimate, ``base='specific'``, as the estimate shown may
    mix in the general model.
    """
    priced_on = price_features(models.training)
    rows = predict_with_confidence(specs, models, blend)
    if comparison_region:
        rows = value.regional_compare(rows, comparison_region, base, skip_own=True, features=priced_on)
    return value.drop_models(value.depreciation(rows, base=base, features=priced_on))

"""Queries over outliers, model training and valuation."""

from pyspark.sql import functions as F

from dealwright.config import NUMERIC_FEATURES, SEGMENT, DealSearch, OutlierSettings, TrainingSettings
from dealwright.functions import scoring
from dealwright.operators import deals, ensemble, filters, outliers, train, value
from dealwright.plans import deal_search, model_sql, valuation
from dealwright.plans.base import THIN_SQL, features
from dealwright.plans.catalog import query
from dealwright.session import SMALL, fresh_path, materialise
from dealwright.sources.listings import FEATURES_SQL

MODEL_INPUT = ("listing_id", "make", "model", "region", "age", "odometer", "price")
BASE_URL = "https://listings.example/a/"
REGION = "ASIA"


def rounded(df, two=(), four=()):
    return df.withColumns({**{c: F.round(c, 2) for c in two}, **{c: F.round(c, 4) for c in four}})


# --- Outliers -----------------------------------------------------------------------------------------------


@query("outlier_robust", f"WITH {FEATURES_SQL}, {model_sql.robust()} SELECT listing_id, is_outlier FROM flagged")
def outlier_robust(spark, sf_dir):
    df = materialise(features(spark, sf_dir, "listing_id", "make", "model", "price", "km_per_year"))
    return outliers.flag_robust(df).select("listing_id", "is_outlier")


@query(
    "outlier_report",
    f"""WITH {FEATURES_SQL}, {model_sql.robust()}
    SELECT make, model, count(*) AS n, sum(is_outlier::INT)::BIGINT AS n_removed,
           sum(is_outlier::INT) / count(*) * 100 AS removed_pct FROM flagged GROUP BY ALL""",
)
def outlier_report(spark, sf_dir):
    df = materialise(features(spark, sf_dir, "listing_id", "make", "model", "price", "km_per_year"))
    return outliers.outlier_report(outliers.flag_robust(df))


@query(
    "outlier_removed_listings",
    f"""WITH {FEATURES_SQL}, {model_sql.robust()}
    SELECT listing_id, year, odometer, price FROM flagged WHERE is_outlier""",
)
def outlier_removed_listings(spark, sf_dir):
    df = materialise(features(spark, sf_dir, "listing_id", "make", "model", "year", "odometer", "price", "km_per_year"))
    return outliers.removed_listings(outliers.flag_robust(df))


FOREST_INPUT = (
    "listing_id", "make", "model", "region", "engine_size", "odometer", "year", "transmission", "fuel", "cylinders",
    "is_4wd", "is_new", "is_dealer", "price", "age", "km_per_year",
)


@query("outlier_isolation_forest")
def outlier_isolation_forest(spark, sf_dir):
    flagged = outliers.flag_isolation_forest(materialise(features(spark, sf_dir, *FOREST_INPUT), SMALL))
    return flagged.select("make", "model", "listing_id", "price", "is_outlier")


@query(
    "outlier_forest_share",
    f"""WITH {FEATURES_SQL} SELECT make, model, count(*) AS n, true AS within_share FROM features GROUP BY ALL""",
)
def outlier_forest_share(spark, sf_dir):
    """Whether the rows removed from a segment are the configured share of it, up to ties."""
    flagged = outliers.flag_isolation_forest(materialise(features(spark, sf_dir, *FOREST_INPUT), SMALL))
    report = outliers.outlier_report(flagged)
    share = OutlierSettings().contamination
    near = (F.col("n_removed") <= F.col("n") * share + 1) & (F.col("n_removed") >= F.col("n") * share - 3)
    return report.select(*SEGMENT, "n", near.alias("within_share"))


@query(
    "outlier_category_codes",
    f"""WITH {FEATURES_SQL}
    SELECT listing_id, (dense_rank() OVER (PARTITION BY make, model ORDER BY region) - 1)::DOUBLE AS region,
           (dense_rank() OVER (PARTITION BY make, model ORDER BY fuel) - 1)::DOUBLE AS fuel FROM features""",
)
def outlier_category_codes(spark, sf_dir):
    df = features(spark, sf_dir, "listing_id", "make", "model", "region", "fuel")
    return outliers.category_codes(df, ["region", "fuel"]).select("listing_id", "region", "fuel")


# --- Training -----------------------------------------------------------------------------------------------


@query(
    "train_specific",
    f"""WITH {FEATURES_SQL}, {model_sql.specific("features")}
    SELECT make, model, region, n, round(intercept, 2) AS intercept, round(b_age, 4) AS b_age,
           round(b_odometer, 8) AS b_odometer, round(effect, 2) AS region_effect
    FROM lines JOIN effects USING (make, model)""",
)
def train_specific(spark, sf_dir):
    models = train.train_specific(materialise(features(spark, sf_dir, *MODEL_INPUT)))
    return models.select(
        *SEGMENT, "n", F.round("intercept", 2).alias("intercept"), F.round("b_age", 4).alias("b_age"),
        F.round("b_odometer", 8).alias("b_odometer"), F.explode("region_effects").alias("region", "region_effect"),
    ).withColumn("region_effect", F.round("region_effect", 2))


@query(
    "train_single_feature",
    f"""WITH {FEATURES_SQL}
    SELECT make, model, count(*) AS n, round(regr_slope(price, odometer), 8) AS slope,
           round(regr_intercept(price, odometer), 4) AS intercept, round(regr_r2(price, odometer), 8) AS r2
    FROM features GROUP BY ALL""",
)
def train_single_feature(spark, sf_dir):
    y = F.col("price").cast("double")
    return features(spark, sf_dir, "make", "model", "price", "odometer").groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.regr_slope(y, "odometer"), 8).alias("slope"),
        F.round(F.regr_intercept(y, "odometer"), 4).alias("intercept"),
        F.round(F.regr_r2(y, "odometer"), 8).alias("r2"),
    )


RIDGE_INPUT = ("listing_id", "make", "model", *NUMERIC_FEATURES, "price")


@query("train_specific_ridge")
def train_specific_ridge(spark, sf_dir):
    models = train.fit_ridge(features(spark, sf_dir, *RIDGE_INPUT), min_rows=20)
    return models.select(
        *SEGMENT, "n", "intercept", *[F.col("coefficients")[i].alias(f) for i, f in enumerate(NUMERIC_FEATURES)]
    )


@query("kfold_bag")
def kfold_bag(spark, sf_dir):
    models = train.bag_ridge(features(spark, sf_dir, *RIDGE_INPUT))
    return models.select(
        *SEGMENT, "n", "folds", "rmse", "intercept",
        *[F.col("coefficients")[i].alias(f) for i, f in enumerate(NUMERIC_FEATURES)],
    )


@query(
    "train_general",
    f"""WITH {THIN_SQL}, {model_sql.gate("thin", 10, "gated")}, {model_sql.general("gated")}
    SELECT round(intercept, 2) AS intercept, round(b_age, 4) AS b_age, round(b_odometer, 8) AS b_odometer, n,
           make, round(make_effect, 2) AS make_effect FROM pooled, make_effects""",
)
def train_general(spark, sf_dir):
    rows = filters.min_rows_gate(features(spark, sf_dir, *MODEL_INPUT, thin=True), 10)
    general = train.train_general(rows)
    return general.make_effects.select(
        F.round(F.lit(general.intercept), 2).alias("intercept"),
        F.round(F.lit(general.b_age), 4).alias("b_age"),
        F.round(F.lit(general.b_odometer), 8).alias("b_odometer"),
        F.lit(general.n).alias("n"),
        "make",
        F.round("general_make_effect", 2).alias("make_effect"),
    )


@query(
    "train_quantile",
    f"""WITH {FEATURES_SQL}, {model_sql.quantiles("features")}
    SELECT make, model, age_band, km_band, leaf_n, q10, q25, q50, q75, q90
    FROM (SELECT make, model, age_band, km_band, leaf_n, round(q10, 4) AS q10, round(q25, 4) AS q25,
                 round(q50, 4) AS q50, round(q75, 4) AS q75, round(q90, 4) AS q90 FROM leaf_q)""",
)
def train_quantile(spark, sf_dir):
    rows = materialise(train.add_bands(features(spark, sf_dir, "make", "model", "age", "odometer", "price")))
    return rounded(train.train_quantiles(rows).leaves, four=train.QUANTILE_LEVELS)


@query(
    "train_tails",
    f"""WITH {FEATURES_SQL}, {model_sql.tails("features")}
    SELECT make, model, q25, q75, coalesce(lo.n, 0) AS low_n, coalesce(lo.n, 0) >= 10 AS low_model,
           coalesce(hi.n, 0) AS high_n, coalesce(hi.n, 0) >= 10 AS high_model
    FROM bounds LEFT JOIN (SELECT * FROM tail_lines WHERE side = 'low') lo USING (make, model)
         LEFT JOIN (SELECT * FROM tail_lines WHERE side = 'high') hi USING (make, model)""",
)
def train_tails(spark, sf_dir):
    tails = train.train_tails(materialise(features(spark, sf_dir, *RIDGE_INPUT)))
    return tails.select(
        *SEGMENT, "q25", "q75", "low_n", F.col("low").isNotNull().alias("low_model"), "high_n",
        F.col("high").isNotNull().alias("high_model"),
    )


@query("train_tails_ridge")
def train_tails_ridge(spark, sf_dir):
    path = store_tails(spark, sf_dir)
    tails = spark.read.parquet(path)
    named = [
        F.col(side)["coefficients"][i].alias(f"{side}_{f}")
        for side in ("low", "high")
        for i, f in enumerate(NUMERIC_FEATURES)
    ]
    intercepts = [F.col(side)["intercept"].alias(f"{side}_intercept") for side in ("low", "high")]
    return tails.select(*SEGMENT, "q25", "q75", "low_n", "high_n", *intercepts, *named)


def store_tails(spark, sf_dir):
    path = fresh_path(spark, "tails")
    train.train_tails(materialise(features(spark, sf_dir, *RIDGE_INPUT))).write.parquet(path)
    return path


@query(
    "save_tails",
    f"""WITH {FEATURES_SQL}, {model_sql.tails("features")}
    SELECT make, model, q25, q75 FROM bounds""",
)
def save_tails(spark, sf_dir):
    return spark.read.parquet(store_tails(spark, sf_dir)).select(*SEGMENT, "q25", "q75")


# --- Prediction ---------------------------------------------------------------------------------------------


@query(
    "predict_specific",
    f"""WITH {FEATURES_SQL}, {model_sql.specific("features")}, {model_sql.general("features")},
    {model_sql.predicted("features")}
    SELECT listing_id, price, round(specific, 2) AS prediction_label FROM predicted""",
)
def predict_specific(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT))
    scored = value.attach_specific(rows, train.train_specific(rows))
    return scored.select("listing_id", "price", F.round(train.specific_value("s_"), 2).alias("prediction_label"))


@query(
    "predict_general",
    f"""WITH {FEATURES_SQL}, {model_sql.specific("features")}, {model_sql.general("features")},
    {model_sql.predicted("features")}
    SELECT listing_id, price, round(general, 2) AS prediction_label FROM predicted""",
)
def predict_general(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT))
    general = train.train_general(rows)
    return general.attach(rows).select("listing_id", "price", F.round(general.value(), 2).alias("prediction_label"))


@query(
    "blend_weight",
    f"""WITH {THIN_SQL}, sizes AS (SELECT make, model, count(*) AS s_n FROM thin GROUP BY ALL)
    SELECT make, model, s_n AS n, round({model_sql.WEIGHT}, 6) AS weight FROM sizes""",
)
def blend_weight(spark, sf_dir):
    sizes = filters.segment_sizes(features(spark, sf_dir, "make", "model", thin=True))
    return sizes.withColumn("weight", F.round(scoring.blend_weight(F.col("n")), 6))


THIN_MODELS = f"""{THIN_SQL}, {model_sql.gate("thin", 20, "large")}, {model_sql.specific("large")},
    {model_sql.gate("thin", 10, "gated")}, {model_sql.general("gated")}, {model_sql.predicted("thin")}"""


def thin_models(rows):
    specific = train.train_specific(filters.min_rows_gate(rows, 20))
    return specific, train.train_general(filters.min_rows_gate(rows, 10))


@query(
    "predict_blended",
    f"""WITH {THIN_MODELS}
    SELECT listing_id, round({model_sql.WEIGHT}, 6) AS weight, round(specific, 2) AS specific,
           round(general, 2) AS general, round({model_sql.BLENDED}, 2) AS prediction_label, NULL::VARCHAR AS reason
    FROM predicted""",
)
def predict_blended(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT, thin=True))
    specific, general = thin_models(rows)
    scored = value.predict_blended(rows, specific, general)
    return rounded(
        scored.select("listing_id", F.round("weight", 6).alias("weight"), "specific", "general", "prediction_label", "reason"),
        two=("specific", "general", "prediction_label"),
    )


@query(
    "predict_interval",
    f"""WITH {FEATURES_SQL}, {model_sql.quantiles("features")}
    SELECT listing_id, round(q10, 4) AS lo80, round(q90, 4) AS hi80, round(q25, 4) AS lo50, round(q75, 4) AS hi50
    FROM with_q""",
)
def predict_interval(spark, sf_dir):
    rows = materialise(train.add_bands(features(spark, sf_dir, "listing_id", "make", "model", "age", "odometer", "price")))
    out = value.predict_interval(rows, train.train_quantiles(rows))
    return out.select(
        "listing_id",
        *[F.round(F.col(f"ci_{c}.{e}"), 4).alias(f"{e}{c}") for c in (80, 50) for e in ("lo", "hi")],
    )


def line_tails(rows):
    return train.train_tails(rows, train.fit_lines, details=("intercept", "b_age", "b_odometer"))


TAIL_ADJUST_SQL = """
tagged AS (
  SELECT p.*, CASE WHEN prediction_label < bd.q25 AND lo.n >= 10 THEN 'low'
                   WHEN prediction_label > bd.q75 AND hi.n >= 10 THEN 'high' END AS tail,
         lo.intercept + lo.b_age * age + lo.b_odometer * odometer AS low_value,
         hi.intercept + hi.b_age * age + hi.b_odometer * odometer AS high_value
  FROM {source} p LEFT JOIN bounds bd USING (make, model)
       LEFT JOIN (SELECT * FROM tail_lines WHERE side = 'low') lo USING (make, model)
       LEFT JOIN (SELECT * FROM tail_lines WHERE side = 'high') hi USING (make, model)),
adjusted AS (SELECT *, CASE tail WHEN 'low' THEN 0.5 * prediction_label + 0.5 * low_value
                                 WHEN 'high' THEN 0.5 * prediction_label + 0.5 * high_value
                                 ELSE prediction_label END AS estimate FROM tagged)"""


@query(
    "tail_adjust",
    f"""WITH {FEATURES_SQL}, {model_sql.tails("features")},
    points AS (SELECT *, price::DOUBLE AS prediction_label FROM features), {TAIL_ADJUST_SQL.format(source="points")}
    SELECT listing_id, prediction_label, tail, round(estimate, 2) AS estimate FROM adjusted""",
)
def tail_adjust(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT).withColumn("prediction_label", F.col("price").cast("double")))
    out = value.tail_adjust(rows, line_tails(rows), value.line_of)
    return out.select("listing_id", "prediction_label", "tail", F.round("estimate", 2).alias("estimate"))


# Outliers are left out of every fit of a valuation; segments are judged large enough on all their rows.
KEPT_MODELS = f"""{THIN_SQL}, {model_sql.robust("thin")},
    kept AS (SELECT * EXCLUDE (is_outlier) FROM flagged WHERE NOT is_outlier),
    {model_sql.gate("kept", 20, "large", "thin")}, {model_sql.specific("large")},
    {model_sql.gate("kept", 10, "gated", "thin")}, {model_sql.general("gated")}, {model_sql.predicted("thin")}"""
ROBUST = OutlierSettings(method="robust")


@query(
    "predict_with_confidence",
    f"""WITH {KEPT_MODELS},
    points AS (SELECT *, {model_sql.BLENDED} AS prediction_label FROM predicted),
    {model_sql.quantiles("points", "kept")}, {model_sql.tails("kept")}, {TAIL_ADJUST_SQL.format(source="with_q")}
    SELECT listing_id, round(estimate, 2) AS estimate, tail, round(q10, 4) AS lo80, round(q90, 4) AS hi80,
           round(q25, 4) AS lo50, round(q75, 4) AS hi50 FROM adjusted""",
)
def predict_with_confidence(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT, "km_per_year", thin=True))
    out = valuation.predict_with_confidence(rows, valuation.train_models(rows, outlier_settings=ROBUST))
    return out.select(
        "listing_id", F.round("estimate", 2).alias("estimate"), "tail",
        *[F.round(F.col(f"ci_{c}.{e}"), 4).alias(f"{e}{c}") for c in (80, 50) for e in ("lo", "hi")],
    )


VALUE_SQL = f"""WITH {KEPT_MODELS},
    points AS (SELECT *, {model_sql.BLENDED} AS prediction_label FROM predicted),
    {model_sql.tails("kept")}, {TAIL_ADJUST_SQL.format(source="points")}
    SELECT a.listing_id, round(estimate, 2) AS estimate, tail,
           CASE WHEN a.region <> '{REGION}' THEN round(specific - s_effect + coalesce(c.effect, 0), 2) END AS comparison_value,
           CASE WHEN a.region <> '{REGION}' AND specific IS NOT NULL
                THEN round(coalesce(c.effect, 0) - s_effect, 2) END AS regional_diff,
           round(specific + s_b_age + 10000 * s_b_odometer, 2) AS value_10k, round(specific + s_b_age, 2) AS value_0k,
           -s_b_age - 10000 * s_b_odometer > 0 AND -s_b_age > 0 AS reliable
    FROM adjusted a LEFT JOIN effects c ON a.make = c.make AND a.model = c.model AND c.region = '{REGION}'"""


@query("value_specs", VALUE_SQL)
def value_specs(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT, "km_per_year", thin=True))
    out = valuation.value_specs(rows, valuation.train_models(rows, outlier_settings=ROBUST), REGION)
    columns = ("estimate", "comparison_value", "regional_diff", "value_10k", "value_0k")
    return rounded(out.select("listing_id", "tail", "reliable", *columns), two=columns)


@query("value_specs_stored", VALUE_SQL)
def value_specs_stored(spark, sf_dir):
    """The same from models that were saved and loaded."""
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT, "km_per_year", thin=True))
    path = fresh_path(spark, "models")
    valuation.save_models(valuation.train_models(rows, outlier_settings=ROBUST), path)
    out = valuation.value_specs(rows, valuation.load_models(spark, path), REGION)
    columns = ("estimate", "comparison_value", "regional_diff", "value_10k", "value_0k")
    return rounded(out.select("listing_id", "tail", "reliable", *columns), two=columns)


# --- Deals --------------------------------------------------------------------------------------------------

DEAL_SQL = f"""{FEATURES_SQL}, {model_sql.gate("features", 20, "large")}, {model_sql.specific("large")},
    {model_sql.general("features")}, {model_sql.predicted("features", "p0")},
    scored AS (SELECT *, specific AS prediction_label, (specific - price) / nullif(specific, 0) * 100 AS discount_pct
               FROM p0 WHERE specific IS NOT NULL),
    deals AS (SELECT * FROM scored WHERE specific > 0 AND discount_pct BETWEEN 40 AND 80)"""


def scored_listings(spark, sf_dir, *more, region=None):
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT, *more), SMALL)
    return deal_search.score(rows, deal_search.train_segments(rows), region)


@query(
    "discount",
    f"""WITH {DEAL_SQL} SELECT listing_id, price, round(prediction_label, 2) AS prediction_label,
    round(discount_pct, 4) AS discount_pct FROM scored""",
)
def discount(spark, sf_dir):
    out = scored_listings(spark, sf_dir).select("listing_id", "price", "prediction_label", "discount_pct")
    return rounded(out, two=("prediction_label",), four=("discount_pct",))


@query(
    "undervalued_pct",
    f"WITH {DEAL_SQL} SELECT listing_id, make, model, price, round(discount_pct, 4) AS discount_pct FROM deals",
)
def undervalued_pct(spark, sf_dir):
    out = deals.undervalued_pct(scored_listings(spark, sf_dir)).select(
        "listing_id", "make", "model", "price", "discount_pct"
    )
    return rounded(out, four=("discount_pct",))


@query(
    "undervalued_abs",
    f"""WITH {DEAL_SQL} SELECT listing_id, price, round(prediction_label, 2) AS prediction_label FROM scored
    WHERE price < prediction_label - 5000 AND price > prediction_label - 100000""",
)
def undervalued_abs(spark, sf_dir):
    out = deals.undervalued_abs(scored_listings(spark, sf_dir)).select("listing_id", "price", "prediction_label")
    return rounded(out, two=("prediction_label",))


@query(
    "regional_compare",
    f"""WITH {DEAL_SQL}
    SELECT s.listing_id, s.region, round(specific - s_effect + coalesce(c.effect, 0), 2) AS comparison_value,
           round(coalesce(c.effect, 0) - s_effect, 2) AS regional_diff,
           round((coalesce(c.effect, 0) - s_effect) / nullif(specific, 0) * 100, 4) AS regional_diff_pct
    FROM scored s LEFT JOIN effects c ON s.make = c.make AND s.model = c.model AND c.region = '{REGION}'""",
)
def regional_compare(spark, sf_dir):
    out = scored_listings(spark, sf_dir, region=REGION).select(
        "listing_id", "region", "comparison_value", "regional_diff", "regional_diff_pct"
    )
    return clean_zero(rounded(out, two=("comparison_value", "regional_diff"), four=("regional_diff_pct",)))


def clean_zero(df):
    """No negative zeros, which differ between engines when a difference cancels."""
    return df.withColumns({c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)) for c, t in df.dtypes if t == "double"})


@query(
    "depreciation",
    f"""WITH {DEAL_SQL}
    SELECT listing_id, round(specific + s_b_age + 10000 * s_b_odometer, 2) AS value_10k,
           round(specific + s_b_age, 2) AS value_0k, round(-s_b_age - 10000 * s_b_odometer, 2) AS depreciation_10k,
           round(-s_b_age, 2) AS depreciation_0k, -s_b_age - 10000 * s_b_odometer > 0 AND -s_b_age > 0 AS reliable
    FROM scored""",
)
def depreciation(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT))
    scored = value.attach_specific(rows, deal_search.train_segments(rows)).where("s_n IS NOT NULL")
    out = value.depreciation(scored.withColumn("specific", train.specific_value("s_")))
    columns = ("value_10k", "value_0k", "depreciation_10k", "depreciation_0k")
    return rounded(out.select("listing_id", *columns, "reliable"), two=columns)


@query(
    "asking_vs_estimate",
    f"""WITH {DEAL_SQL}
    SELECT listing_id, round(price - prediction_label, 2) AS diff,
           round((price - prediction_label) / nullif(prediction_label, 0) * 100, 4) AS diff_pct FROM scored""",
)
def asking_vs_estimate(spark, sf_dir):
    out = value.asking_vs_estimate(scored_listings(spark, sf_dir)).select("listing_id", "diff", "diff_pct")
    return rounded(out, two=("diff",), four=("diff_pct",))


@query(
    "rank_deals",
    f"""WITH {DEAL_SQL} SELECT listing_id, make, model, title, price, round(prediction_label, 2) AS prediction_label,
    round(discount_pct, 4) AS discount_pct, region FROM deals ORDER BY deals.discount_pct DESC, listing_id""",
)
def rank_deals(spark, sf_dir):
    found = deals.rank_deals(deals.undervalued_pct(scored_listings(spark, sf_dir, "title")))
    out = found.select("listing_id", "make", "model", "title", "price", "prediction_label", "discount_pct", "region")
    return rounded(out, two=("prediction_label",), four=("discount_pct",))


@query(
    "top_deals",
    f"""WITH {DEAL_SQL} SELECT listing_id, '{BASE_URL}' || listing_id AS url, round(discount_pct, 4) AS discount_pct
    FROM deals ORDER BY deals.discount_pct DESC, listing_id LIMIT 10""",
)
def top_deals(spark, sf_dir):
    found = deals.undervalued_pct(scored_listings(spark, sf_dir))
    return rounded(deals.top_deals(found, BASE_URL), four=("discount_pct",))


@query(
    "deal_summary",
    f"""WITH {DEAL_SQL} SELECT count(*) AS n_deals, round(avg(discount_pct), 6) AS avg_discount,
    min(price) AS min_price, max(price) AS max_price FROM deals""",
)
def deal_summary(spark, sf_dir):
    summary = deals.deal_summary(deals.undervalued_pct(scored_listings(spark, sf_dir)))
    return summary.withColumn("avg_discount", F.round("avg_discount", 6))


@query(
    "deals_per_segment",
    f"""WITH {DEAL_SQL} SELECT make, model, count(deals.listing_id) AS n_deals
    FROM (SELECT DISTINCT make, model FROM listings) LEFT JOIN deals USING (make, model) GROUP BY ALL""",
)
def deals_per_segment(spark, sf_dir):
    from dealwright.sources.listings import listings

    found = deals.undervalued_pct(scored_listings(spark, sf_dir))
    return deals.deals_per_segment(listings(spark, sf_dir, "make", "model"), found)


def search_sql():
    return f"""WITH {FEATURES_SQL}, {model_sql.gate("features", 20, "large")}, {model_sql.robust("large")},
    kept AS (SELECT * EXCLUDE (is_outlier) FROM flagged WHERE NOT is_outlier),
    {model_sql.specific("kept")},
    scored AS (
      SELECT f.*, l.intercept + l.b_age * age + l.b_odometer * odometer + coalesce(e.effect, 0) AS prediction_label,
             coalesce(c.effect, 0) - coalesce(e.effect, 0) AS regional_diff
      FROM kept f JOIN lines l USING (make, model) LEFT JOIN effects e USING (make, model, region)
           LEFT JOIN effects c ON f.make = c.make AND f.model = c.model AND c.region = '{REGION}'),
    rated AS (SELECT *, (prediction_label - price) / nullif(prediction_label, 0) * 100 AS discount_pct FROM scored)
    SELECT listing_id, make, model, title, price, region, odometer, age,
           round(prediction_label, 2) AS prediction_label, round(discount_pct, 4) AS discount_pct,
           round(prediction_label + regional_diff, 2) AS comparison_value,
           round(regional_diff / nullif(prediction_label, 0) * 100, 4) AS regional_diff_pct
    FROM rated
    WHERE prediction_label > 0 AND rated.discount_pct BETWEEN 40 AND 80 AND odometer <= 160000
      AND region IS DISTINCT FROM 'EUROPE'"""


@query("deal_search", search_sql())
def search(spark, sf_dir):
    from dealwright.config import FilterRule

    rows = materialise(features(spark, sf_dir, *MODEL_INPUT, "title", "km_per_year"))
    rules = (FilterRule("odometer", "<=", 160000, "Lower mileage"), FilterRule("region", "!=", "EUROPE"))
    found = deal_search.search_deals(
        rows, DealSearch(comparison_region=REGION, filters=rules), OutlierSettings(method="robust")
    )
    out = found.select(
        "listing_id", "make", "model", "title", "price", "region", "odometer", "age", "prediction_label",
        "discount_pct", "comparison_value", "regional_diff_pct",
    )
    return clean_zero(
        rounded(out, two=("prediction_label", "comparison_value"), four=("discount_pct", "regional_diff_pct"))
    )


PAIR = ("age", "odometer")
RIDGE_SEARCH_SQL = f"""WITH {FEATURES_SQL}, {model_sql.gate("features", 20, "large")}, {model_sql.robust("large")},
    kept AS (SELECT * EXCLUDE (is_outlier) FROM flagged WHERE NOT is_outlier), {model_sql.ridge("kept")},
    effects AS (SELECT make, model, region,
                       sum(price - (intercept + b_age * age + b_odometer * odometer)) / (count(*) + 20) AS effect
                FROM kept JOIN ridges USING (make, model) GROUP BY make, model, region),
    scored AS (SELECT f.*, intercept + b_age * age + b_odometer * odometer + coalesce(effect, 0) AS prediction_label
               FROM kept f JOIN ridges USING (make, model) LEFT JOIN effects USING (make, model, region)),
    rated AS (SELECT *, (prediction_label - price) / nullif(prediction_label, 0) * 100 AS discount_pct FROM scored)
    SELECT listing_id, make, model, price, round(prediction_label, 2) AS prediction_label,
           round(discount_pct, 4) AS discount_pct
    FROM rated WHERE prediction_label > 0 AND rated.discount_pct BETWEEN 40 AND 80"""


@query("deal_search_ridge", RIDGE_SEARCH_SQL)
def search_ridge(spark, sf_dir):
    """The search with ridge models, on the two features for which SQL has the solution."""
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT, "km_per_year"))
    training = TrainingSettings(model="ridge", features=PAIR)
    found = deal_search.search_deals(rows, DealSearch(), ROBUST, training)
    out = found.select("listing_id", "make", "model", "price", "prediction_label", "discount_pct")
    return rounded(out, two=("prediction_label",), four=("discount_pct",))


@query(
    "train_ridge_pair",
    f"""WITH {FEATURES_SQL}, {model_sql.ridge("features")}
    SELECT make, model, n, round(intercept, 2) AS intercept, round(b_age, 4) AS b_age,
           round(b_odometer, 8) AS b_odometer FROM ridges""",
)
def train_ridge_pair(spark, sf_dir):
    return pair_columns(train.fit_ridge(features(spark, sf_dir, *MODEL_INPUT), features=PAIR)).select(
        *SEGMENT, "n", "intercept", "b_age", "b_odometer"
    )


def pair_columns(models):
    return models.withColumns(
        {
            "intercept": F.round("intercept", 2),
            "b_age": F.round(F.col("coefficients")[0], 4),
            "b_odometer": F.round(F.col("coefficients")[1], 8),
        }
    )


@query(
    "kfold_bag_pair",
    f"""WITH {FEATURES_SQL}, {model_sql.bagged("features")}
    SELECT make, model, folds::INT AS folds, round(intercept, 2) AS intercept, round(b_age, 4) AS b_age,
           round(b_odometer, 8) AS b_odometer FROM bags""",
)
def kfold_bag_pair(spark, sf_dir):
    return pair_columns(train.bag_ridge(features(spark, sf_dir, *MODEL_INPUT), features=PAIR)).select(
        *SEGMENT, "folds", "intercept", "b_age", "b_odometer"
    )


@query(
    "train_tails_ridge_pair",
    f"""WITH {FEATURES_SQL},
    bounds AS (SELECT make, model, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75
               FROM features GROUP BY ALL),
    tail_rows AS (SELECT f.*, CASE WHEN price < q25 THEN 'low' ELSE 'high' END AS side
                  FROM features f JOIN bounds USING (make, model) WHERE price < q25 OR price > q75),
    {model_sql.ridge("tail_rows", "make, model, side")}
    SELECT make, model, side, n, round(intercept, 2) AS intercept, round(b_age, 4) AS b_age,
           round(b_odometer, 8) AS b_odometer FROM ridges WHERE n >= 10""",
)
def train_tails_ridge_pair(spark, sf_dir):
    def fit(rows, keys):
        return train.fit_ridge(rows, keys, PAIR)

    tails = train.train_tails(materialise(features(spark, sf_dir, *MODEL_INPUT)), fit)
    sides = F.array(
        *(F.struct(F.lit(s).alias("side"), F.col(f"{s}_n").alias("n"), F.col(s).alias("m")) for s in ("low", "high"))
    )
    each = tails.select(*SEGMENT, F.inline(sides)).where("m IS NOT NULL").select(*SEGMENT, "side", "n", "m.*")
    return pair_columns(each).select(*SEGMENT, "side", "n", "intercept", "b_age", "b_odometer")


@query("deal_search_forest")
def search_forest(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, *FOREST_INPUT), SMALL)
    found = deal_search.search_deals(rows, DealSearch(comparison_region=REGION))
    return found.select(
        "listing_id", "make", "model", "price", "prediction_label", "discount_pct", "comparison_value",
        "regional_diff_pct",
    )


# --- Tree models --------------------------------------------------------------------------------------------

TREE_INPUT = ("listing_id", "make", "model", "region", "transmission", "fuel", "cylinders", *NUMERIC_FEATURES, "price")


@query("train_general_trees")
def train_general_trees(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, *TREE_INPUT))
    model = ensemble.train_general_trees(filters.min_rows_gate(rows, 10))
    return ensemble.predict_general_trees(rows, model).select("listing_id", "make", "model", "price", "general")


@query("train_quantile_tree")
def train_quantile_tree(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, "listing_id", "make", "model", *NUMERIC_FEATURES, "price"))
    leaves = ensemble.fit_leaves(rows)
    quantiles = ensemble.train_leaf_quantiles(rows, leaves)
    out = value.predict_interval(ensemble.add_leaf(rows, leaves), quantiles)
    return out.select(
        "listing_id", "leaf", *[F.col(f"ci_{c}.{e}").alias(f"{e}{c}") for c in (80, 50) for e in ("lo", "hi")]
    )


@query("predict_blended_trees")
def predict_blended_trees(spark, sf_dir):
    rows = materialise(features(spark, sf_dir, *TREE_INPUT, thin=True))
    model = ensemble.train_general_trees(filters.min_rows_gate(rows, 10), rounds=10)
    specific = train.train_specific(filters.min_rows_gate(rows, 20))
    scored = value.attach_specific(ensemble.predict_general_trees(rows, model), specific)
    scored = scored.withColumn("specific", train.specific_value("s_"))
    return scored.select(
        "listing_id", "price", "specific", "general",
        scoring.blended(F.col("specific"), F.col("general"), F.col("s_n")).alias("prediction_label"),
    )

"""Queries over model diagnostics on the held-out share of every segment."""

from pyspark.sql import functions as F

from dealwright.config import SEGMENT
from dealwright.operators import diagnose, sampling, train, value
from dealwright.operators.joins import with_group_values
from dealwright.operators.quantiles import exact_quantiles
from dealwright.plans import model_sql
from dealwright.plans.base import features
from dealwright.plans.catalog import query
from dealwright.plans.clean_queries import SPLIT_SQL
from dealwright.plans.model_queries import MODEL_INPUT, clean_zero, line_tails, rounded
from dealwright.session import SMALL, materialise
from dealwright.sources import registry

HELD_OUT_SQL = f"""{SPLIT_SQL},
train AS (SELECT * FROM split WHERE NOT is_oos),
{model_sql.specific("train")}, {model_sql.general("train")},
oos AS (SELECT * FROM split WHERE is_oos), {model_sql.predicted("oos", "p0")},
held AS (SELECT *, specific AS prediction_label, price - specific AS residual FROM p0)"""


def split_rows(spark, sf_dir, *more):
    """Listings with the split flag, kept as training and scoring both read them."""
    return materialise(sampling.oos_split(materialise(features(spark, sf_dir, *MODEL_INPUT, *more), SMALL)), SMALL)


def held_out(rows, models=None):
    """Held-out rows with the prediction of the model fitted on the others; the model stays attached."""
    models = train.train_specific(rows.where("NOT is_oos")) if models is None else models
    scored = value.attach_specific(rows.where("is_oos"), models)
    return diagnose.residuals(scored.withColumn("prediction_label", train.specific_value("s_")))


@query(
    "evaluate_oos",
    f"""WITH {HELD_OUT_SQL}
    SELECT make, model, count(*) AS n, round(avg(abs(residual)), 2) AS mae, round(sqrt(avg(residual * residual)), 2) AS rmse,
           round(1 - avg(residual * residual) / var_pop(price), 6) AS r2, round(corr(price, prediction_label), 6) AS pearson,
           round(median(abs(residual)), 2) AS median_ae
    FROM held GROUP BY ALL""",
)
def evaluate_oos(spark, sf_dir):
    out = diagnose.evaluate(held_out(split_rows(spark, sf_dir)))
    out = rounded(out, two=("mae", "rmse", "median_ae"))
    return out.withColumns({c: F.round(c, 6) for c in ("r2", "pearson")})


def candidates(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    fitted = rows.where("NOT is_oos")
    scored = held_out(rows)
    centre = fitted.groupBy(*SEGMENT).agg(F.avg("price").alias("by_mean")).join(
        exact_quantiles(fitted, SEGMENT, "price", {"by_median": 0.5}), list(SEGMENT)
    )
    general = train.train_general(fitted)
    scored = with_group_values(general.attach(scored), centre, SEGMENT)
    for name, models in (("ridge", train.fit_ridge(fitted, features=PAIR)), ("bag", train.bag_ridge(fitted, features=PAIR))):
        models = models.select(*SEGMENT, *[F.col(c).alias(f"{name}_{c}") for c in ("intercept", "coefficients")])
        scored = with_group_values(scored, models, SEGMENT)
    return scored.withColumns(
        {
            "by_line": train.line_value("s_"),
            "by_general": general.value(),
            "by_ridge": train.ridge_value(PAIR, "ridge_"),
            "by_bag": train.ridge_value(PAIR, "bag_"),
        }
    )


PAIR = ("age", "odometer")
CANDIDATES = {
    "segment mean": "by_mean",
    "segment median": "by_median",
    "line": "by_line",
    "line and region": "prediction_label",
    "general": "by_general",
    "ridge": "by_ridge",
    "bagged ridge": "by_bag",
}


@query(
    "leaderboard",
    f"""WITH {HELD_OUT_SQL},
    centre AS (SELECT make, model, avg(price) AS by_mean, median(price) AS by_median FROM train GROUP BY ALL),
    {model_sql.ridge("train")}, {model_sql.bagged("train")},
    wide AS (SELECT h.*, c.by_mean, c.by_median, s_intercept + s_b_age * age + s_b_odometer * odometer AS by_line,
                    r.intercept + r.b_age * age + r.b_odometer * odometer AS by_ridge,
                    b.intercept + b.b_age * age + b.b_odometer * odometer AS by_bag
             FROM held h JOIN centre c USING (make, model) JOIN ridges r USING (make, model) JOIN bags b USING (make, model)),
    long AS (SELECT make, model, price, 'segment mean' AS candidate, by_mean AS p FROM wide
             UNION ALL SELECT make, model, price, 'segment median', by_median FROM wide
             UNION ALL SELECT make, model, price, 'line', by_line FROM wide
             UNION ALL SELECT make, model, price, 'line and region', prediction_label FROM wide
             UNION ALL SELECT make, model, price, 'general', general FROM wide
             UNION ALL SELECT make, model, price, 'ridge', by_ridge FROM wide
             UNION ALL SELECT make, model, price, 'bagged ridge', by_bag FROM wide),
    board AS (SELECT make, model, candidate, count(*) AS n, avg(abs(price - p)) AS e,
                     sqrt(avg((price - p) * (price - p))) AS r FROM long GROUP BY ALL)
    SELECT make, model, candidate, n, e::FLOAT::DOUBLE AS mae, r::FLOAT::DOUBLE AS rmse,
           row_number() OVER (PARTITION BY make, model ORDER BY round(e, 6), candidate)::INT AS place FROM board""",
)
def leaderboard(spark, sf_dir):
    # Means of few whole-dollar errors are often exact decimal ties: compare them in single precision.
    board = diagnose.leaderboard(candidates(spark, sf_dir), CANDIDATES)
    return board.withColumns({c: F.col(c).cast("float").cast("double") for c in ("mae", "rmse")})


FEATURES = ("age", "odometer", "region")
IMPORTANCE_SQL = f"""{HELD_OUT_SQL},
numbered AS (SELECT h.*, r::INT AS rep, md5(r || '|' || listing_id) AS ord FROM held h, range(1, 4) t(r)),
moved AS (SELECT *, coalesce(lead(age) OVER w, first_value(age) OVER w) AS other_age,
                 coalesce(lead(odometer) OVER w, first_value(odometer) OVER w) AS other_odometer,
                 coalesce(lead(region) OVER w, first_value(region) OVER w) AS other_region
          FROM numbered WINDOW w AS (PARTITION BY make, model, rep ORDER BY ord, listing_id)),
rises AS (
  SELECT make, model, rep, 'age' AS feature,
         abs(price - prediction_label - s_b_age * (other_age - age)) - abs(residual) AS rise FROM moved
  UNION ALL SELECT make, model, rep, 'odometer',
         abs(price - prediction_label - s_b_odometer * (other_odometer - odometer)) - abs(residual) FROM moved
  UNION ALL SELECT m.make, m.model, rep, 'region',
         abs(price - prediction_label - coalesce(o.effect, 0) + s_effect) - abs(residual)
  FROM moved m LEFT JOIN effects o ON m.make = o.make AND m.model = o.model AND m.other_region = o.region),
importances AS (SELECT make, model, feature, avg(rise) AS importance, stddev_samp(rise) AS stddev
                FROM (SELECT make, model, feature, rep, avg(rise) AS rise FROM rises GROUP BY ALL) GROUP BY ALL)"""


def importances(spark, sf_dir):
    predict_with = {
        "age": train.specific_value("s_", age=F.col("other_age")),
        "odometer": train.specific_value("s_", odometer=F.col("other_odometer")),
        "region": train.specific_value("s_", region=F.col("other_region")),
    }
    rows = split_rows(spark, sf_dir)
    models = train.train_specific(rows.where("NOT is_oos"))
    # the model of a segment joins the rows where they have moved to, as it is larger than a row
    return diagnose.permutation_importance(
        value.drop_models(held_out(rows, models)), FEATURES, predict_with, attach=lambda moved: value.attach_specific(moved, models)
    )


@query(
    "permutation_importance",
    f"""WITH {IMPORTANCE_SQL}
    SELECT make, model, feature, round(importance, 4) AS importance, round(stddev, 4) AS stddev FROM importances""",
)
def permutation_importance(spark, sf_dir):
    return clean_zero(rounded(importances(spark, sf_dir), four=("importance", "stddev")))


@query(
    "importance_rank",
    f"""WITH {IMPORTANCE_SQL}
    SELECT make, model, feature, round(importance, 4) AS importance FROM importances
    ORDER BY make, model, importances.importance""",
)
def importance_rank(spark, sf_dir):
    ranked = diagnose.importance_rank(importances(spark, sf_dir)).drop("stddev")
    return clean_zero(rounded(ranked, four=("importance",)))


@query(
    "residuals",
    f"""WITH {HELD_OUT_SQL}
    SELECT listing_id, price, round(prediction_label, 2) AS prediction_label, round(residual, 2) AS residual,
           round(abs(residual), 2) AS abs_residual FROM held""",
)
def residuals(spark, sf_dir):
    columns = ("prediction_label", "residual", "abs_residual")
    return rounded(held_out(split_rows(spark, sf_dir)).select("listing_id", "price", *columns), two=columns)


@query(
    "residual_histogram",
    f"""WITH {HELD_OUT_SQL},
    edges AS (SELECT make, model, min(residual) AS lo, max(residual) AS hi FROM held GROUP BY ALL)
    SELECT make, model, least(30, 1 + floor((residual - lo) / (hi - lo) * 30))::INT AS bin,
           round(lo + (least(30, 1 + floor((residual - lo) / (hi - lo) * 30)) - 1) * (hi - lo) / 30, 2) AS bin_from,
           round(lo + least(30, 1 + floor((residual - lo) / (hi - lo) * 30)) * (hi - lo) / 30, 2) AS bin_to,
           count(*) AS n FROM held JOIN edges USING (make, model) GROUP BY ALL""",
)
def residual_histogram(spark, sf_dir):
    return rounded(diagnose.residual_histogram(held_out(split_rows(spark, sf_dir))), two=("bin_from", "bin_to"))


@query(
    "residual_vs_predicted",
    f"""WITH {HELD_OUT_SQL},
    line AS (SELECT make, model, least(min(price), min(prediction_label)) AS lo,
                    greatest(max(price), max(prediction_label)) AS hi FROM held GROUP BY ALL)
    SELECT make, model, listing_id, price AS actual, round(prediction_label, 2) AS predicted,
           round(residual, 2) AS residual, round(abs(residual), 2) AS abs_residual, round(lo, 2) AS xy_min,
           round(hi, 2) AS xy_max FROM held JOIN line USING (make, model)""",
)
def residual_vs_predicted(spark, sf_dir):
    out = diagnose.residual_vs_predicted(held_out(split_rows(spark, sf_dir)))
    return rounded(out, two=("predicted", "residual", "abs_residual", "xy_min", "xy_max"))


@query(
    "model_info",
    f"""WITH {SPLIT_SQL},
    train AS (SELECT * FROM split WHERE NOT is_oos), oos AS (SELECT * FROM split WHERE is_oos),
    {model_sql.specific("train")},
    scored AS (SELECT o.*, intercept + b_age * age + b_odometer * odometer AS by_line, coalesce(effect, 0) AS effect
               FROM oos o JOIN lines USING (make, model) LEFT JOIN effects USING (make, model, region)),
    errors AS (SELECT make, model, avg(abs(price - by_line)) AS a, avg(abs(price - by_line - effect)) AS b
               FROM scored GROUP BY ALL),
    {model_sql.tails("train")}
    SELECT make, model, strftime(max(ship_day), '%Y-%m-%d') AS training_day, count(*) AS n_training_samples,
           CASE WHEN any_value(a) <= any_value(b) THEN 'line' ELSE 'line and region' END AS best_model,
           any_value(q25) AS q25, any_value(q75) AS q75, any_value(coalesce(lo.n, 0)) AS low_n,
           any_value(coalesce(lo.n, 0) >= 10) AS low_model, any_value(coalesce(hi.n, 0)) AS high_n,
           any_value(coalesce(hi.n, 0) >= 10) AS high_model
    FROM train JOIN errors USING (make, model) JOIN bounds USING (make, model)
         LEFT JOIN (SELECT * FROM tail_lines WHERE side = 'low') lo USING (make, model)
         LEFT JOIN (SELECT * FROM tail_lines WHERE side = 'high') hi USING (make, model)
    GROUP BY make, model""",
)
def model_info(spark, sf_dir):
    rows = split_rows(spark, sf_dir, "ship_day")
    fitted = rows.where("NOT is_oos")
    runs = fitted.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"), F.max("ship_day").alias("day"))
    entries = registry.segment_entries(runs, "specific", F.col("day"), "models")
    scored = held_out(rows).withColumn("by_line", train.line_value("s_"))
    board = diagnose.leaderboard(scored, {"line": "by_line", "line and region": "prediction_label"})
    return diagnose.model_info(entries, diagnose.best_model(board), line_tails(fitted))

"""Queries over fits by absolute error and quantile, and over the general model bagged by folds."""

from pyspark.sql import functions as F

from dealwright.config import QUANTILE_LEVELS, SEGMENT
from dealwright.operators import diagnose, filters, robust, sampling, stacking, train
from dealwright.plans import model_sql
from dealwright.plans.base import THIN_SQL, features
from dealwright.plans.catalog import query
from dealwright.plans.clean_queries import SPLIT_SQL
from dealwright.plans.model_queries import MODEL_INPUT
from dealwright.session import materialise
from dealwright.sources.listings import FEATURES_SQL

PAIR = ("age", "odometer")


def weighted_quantile_sql(level: float) -> str:
    """The smallest price per year of age up to which the ages add up to the level's part: the best slope through 0."""
    return f"""
    SELECT make, model, n, round(min(slope), 6) AS slope FROM (
      SELECT make, model, price / age AS slope, sum(age) OVER (PARTITION BY make, model ORDER BY price / age
               RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(age) OVER (PARTITION BY make, model) AS whole, count(*) OVER (PARTITION BY make, model) AS n
      FROM features)
    WHERE upto >= {level} * whole - 1e-9 * whole GROUP BY ALL"""


@query("train_specific_absolute_slope", f"WITH {FEATURES_SQL} {weighted_quantile_sql(0.5)}")
def train_specific_absolute_slope(spark, sf_dir):
    """The fit by absolute error with one feature and no intercept, whose solution is a weighted median."""
    rows = features(spark, sf_dir, "make", "model", "age", "price")
    models = robust.fit_absolute(rows, features=("age",), intercept=False)
    return models.select(*SEGMENT, "n", F.round(F.col("coefficients")[0], 6).alias("slope"))


@query(
    "train_specific_absolute",
    f"""WITH {FEATURES_SQL}
    SELECT make, model, count(*) AS n, true AS balanced, true AS not_above_line FROM features GROUP BY ALL""",
)
def train_specific_absolute(spark, sf_dir):
    """Whether each segment's fit by absolute error has half of the rows on either side and no larger mean error than the
    line of least squares."""
    rows = materialise(features(spark, sf_dir, *MODEL_INPUT))
    lines = train.fit_lines(rows).select(*SEGMENT, "intercept", "b_age", "b_odometer")
    fits = robust.fit_absolute(rows, features=PAIR).select(
        *SEGMENT, F.col("intercept").alias("r_intercept"), F.col("coefficients").alias("r_coefficients")
    )
    rest = F.col("price") - train.ridge_value(PAIR, "r_")
    near = 1e-6 * F.col("price")
    judged = rows.join(fits, list(SEGMENT)).join(lines, list(SEGMENT)).groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(rest < -near, 1)).alias("below"),
        F.count(F.when(rest > near, 1)).alias("above"),
        F.avg(F.abs(rest)).alias("mae"),
        F.avg(F.abs(F.col("price") - train.line_value())).alias("line_mae"),
    )
    half = F.col("n") / 2
    return judged.select(
        *SEGMENT, "n", ((F.col("below") <= half) & (F.col("above") <= half)).alias("balanced"),
        (F.col("mae") <= F.col("line_mae") * (1 + 1e-9)).alias("not_above_line"),
    )


@query(
    "train_quantile_slopes",
    f"WITH {FEATURES_SQL}"
    + " UNION ALL ".join(
        f"SELECT '{name}' AS level, * FROM ({weighted_quantile_sql(level)})" for name, level in QUANTILE_LEVELS.items()
    ),
)
def train_quantile_slopes(spark, sf_dir):
    """Five quantile fits with one feature and no intercept, whose solutions are weighted quantiles."""
    rows = features(spark, sf_dir, "make", "model", "age", "price")
    models = robust.fit_levels(rows, features=("age",), intercept=False)
    return models.select("level", *SEGMENT, "n", F.round(F.col("coefficients")[0], 6).alias("slope"))


def quantile_split(spark, sf_dir):
    rows = materialise(sampling.oos_split(materialise(features(spark, sf_dir, *MODEL_INPUT))))
    fitted = rows.where("NOT is_oos")
    leaves = train.train_quantiles(train.add_bands(fitted))
    model = robust.train_quantile_regression(fitted, PAIR, fallback=leaves)
    return model, train.add_bands(rows)


@query(
    "train_quantile_regression",
    f"""WITH {SPLIT_SQL}, levels(level) AS (VALUES {", ".join(f"('{name}')" for name in QUANTILE_LEVELS)})
    SELECT make, model, level, count(*) AS n, true AS balanced FROM split, levels WHERE NOT is_oos GROUP BY ALL
    HAVING count(*) >= 50""",
)
def train_quantile_regression(spark, sf_dir):
    """Whether each quantile line of each segment has its level's share of the rows it was fitted on at or below it."""
    model, rows = quantile_split(spark, sf_dir)
    lines = model.lines.select(*SEGMENT, "level", "intercept", "coefficients")
    rest = F.col("price") - train.ridge_value(PAIR)
    near = 1e-6 * F.col("price")
    judged = rows.where("NOT is_oos").join(lines, list(SEGMENT)).groupBy(*SEGMENT, "level").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(rest < -near, 1)).alias("below"), F.count(F.when(rest <= near, 1)).alias("upto")
    )
    share = F.create_map(*(F.lit(x) for item in QUANTILE_LEVELS.items() for x in item))[F.col("level")] * F.col("n")
    return judged.select(*SEGMENT, "level", "n", ((F.col("below") <= share) & (F.col("upto") >= share - 1e-6)).alias("balanced"))


@query(
    "quantile_coverage",
    f"""WITH {SPLIT_SQL}, levels(level) AS (VALUES {", ".join(f"('{name}')" for name in QUANTILE_LEVELS)})
    SELECT level, count(*) AS n, true AS rising, count(*) >= 5000 AS many, true AS covered FROM split, levels
    WHERE is_oos GROUP BY level""",
)
def quantile_coverage(spark, sf_dir):
    """Whether the share of held-out listings at or below each quantile is within two points of its level, which few rows
    cannot show, and whether quantiles rise."""
    model, rows = quantile_split(spark, sf_dir)
    scored = model.attach(rows.where("is_oos"))
    names = list(QUANTILE_LEVELS)
    rising = F.forall(F.sequence(F.lit(1), F.lit(len(names) - 1)), lambda i: F.array(*names)[i - 1] <= F.array(*names)[i])
    each = F.array(*(F.struct(F.lit(n).alias("level"), F.lit(p).alias("p"), F.col(n).alias("q")) for n, p in QUANTILE_LEVELS.items()))
    found = scored.select("price", rising.alias("rising"), F.inline(each)).groupBy("level", "p").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("price") <= F.col("q")).cast("double")).alias("share"), F.every("rising").alias("rising")
    )
    many = F.col("n") >= 5000
    return found.select("level", "n", "rising", many.alias("many"), ((F.abs(F.col("share") - F.col("p")) <= 0.02) | ~many).alias("covered"))


# --- The general model by folds ------------------------------------------------------------------------------

_REST = "price - (k.intercept + k.b_age * age + k.b_odometer * odometer)"
FOLDED_SQL = f"""{THIN_SQL}, {model_sql.gate("thin", 10, "gated")},
folded AS (SELECT *, (('0x' || substr(md5('42|' || listing_id), 1, 8))::BIGINT % 5)::INT AS fold FROM gated),
others AS (SELECT f.*, k.left_out::INT AS left_out FROM folded f, range(5) k(left_out) WHERE f.fold <> k.left_out),
{model_sql.lines("others", "left_out", "fold_lines")},
means AS (SELECT left_out, avg(price) AS mean FROM others GROUP BY left_out),
fold_makes AS (SELECT make, left_out, sum({_REST}) / (count(*) + 20) AS make_line, sum(price - mean) / (count(*) + 20) AS make_mean
               FROM others JOIN fold_lines k USING (left_out) JOIN means USING (left_out) GROUP BY make, left_out),
fold_models AS (SELECT make, model, left_out, sum({_REST} - make_line) / (count(*) + 20) AS model_line,
                       sum(price - mean - make_mean) / (count(*) + 20) AS model_mean
                FROM others JOIN fold_lines k USING (left_out) JOIN means USING (left_out)
                     JOIN fold_makes USING (make, left_out) GROUP BY make, model, left_out),
unseen AS (SELECT f.listing_id, f.make, f.model, f.price, f.fold,
                  k.intercept + k.b_age * f.age + k.b_odometer * f.odometer + coalesce(make_line, 0) + coalesce(model_line, 0) AS by_line,
                  m.mean + coalesce(make_mean, 0) + coalesce(model_mean, 0) AS by_mean
           FROM folded f JOIN fold_lines k ON k.left_out = f.fold JOIN means m ON m.left_out = f.fold
                LEFT JOIN fold_makes a ON a.make = f.make AND a.left_out = f.fold
                LEFT JOIN fold_models b ON b.make = f.make AND b.model = f.model AND b.left_out = f.fold),
weights AS (SELECT least(1, greatest(0, sum((price - by_mean) * (by_line - by_mean)) / sum((by_line - by_mean) ** 2))) AS line FROM unseen)"""


def folded(spark, sf_dir):
    rows = materialise(filters.min_rows_gate(features(spark, sf_dir, *MODEL_INPUT, thin=True), 10))
    return rows, stacking.train_general_folds(rows)


@query(
    "train_general_folds",
    f"""WITH {FOLDED_SQL}
    SELECT left_out, n, round(intercept, 2) AS intercept, round(b_age, 4) AS b_age, round(b_odometer, 8) AS b_odometer,
           round(mean, 4) AS mean FROM fold_lines JOIN means USING (left_out)""",
)
def train_general_folds(spark, sf_dir):
    _, model = folded(spark, sf_dir)
    return model.lines.select(
        "left_out", "n", F.round("intercept", 2).alias("intercept"), F.round("b_age", 4).alias("b_age"),
        F.round("b_odometer", 8).alias("b_odometer"), F.round("mean", 4).alias("mean"),
    )


@query(
    "general_out_of_fold",
    f"WITH {FOLDED_SQL} SELECT listing_id, fold, round(by_line, 2) AS by_line, round(by_mean, 2) AS by_mean FROM unseen",
)
def general_out_of_fold(spark, sf_dir):
    rows, model = folded(spark, sf_dir)
    return model.out_of_fold(rows).select(
        "listing_id", "fold", F.round("by_line", 2).alias("by_line"), F.round("by_mean", 2).alias("by_mean")
    )


@query(
    "general_blend",
    f"""WITH {FOLDED_SQL}
    SELECT make, round(line, 6) AS weight_line, round(1 - line, 6) AS weight_mean,
           round(sum(make_line * line + make_mean * (1 - line)) / 5, 4) AS make_effect
    FROM fold_makes, weights GROUP BY make, line""",
)
def general_blend(spark, sf_dir):
    """The weights of both candidates, and the blended effects of makes of the bagged model."""
    rows, model = folded(spark, sf_dir)
    weights = stacking.blend_weights(model.out_of_fold(rows), ["by_line", "by_mean"])
    blend = model.blended(weights["by_line"], weights["by_mean"])
    return blend.make_effects.select(
        "make", F.round(F.lit(weights["by_line"]), 6).alias("weight_line"), F.round(F.lit(weights["by_mean"]), 6).alias("weight_mean"),
        F.round("general_make_effect", 4).alias("make_effect"),
    )


@query(
    "leaderboard_general",
    f"""WITH {FOLDED_SQL},
    long AS (SELECT make, model, price, 'line' AS candidate, by_line AS p FROM unseen
             UNION ALL SELECT make, model, price, 'mean', by_mean FROM unseen
             UNION ALL SELECT make, model, price, 'blend', line * by_line + (1 - line) * by_mean FROM unseen, weights),
    board AS (SELECT make, candidate, count(*) AS n, avg(abs(price - p)) AS e FROM long GROUP BY ALL)
    SELECT make, candidate, n, e::FLOAT::DOUBLE AS mae,
           row_number() OVER (PARTITION BY make ORDER BY round(e, 6), candidate)::INT AS place FROM board""",
)
def leaderboard_general(spark, sf_dir):
    """Candidates of the general model and their blend, each judged on rows that its models have not seen."""
    rows, model = folded(spark, sf_dir)
    unseen = materialise(model.out_of_fold(rows))
    weights = stacking.blend_weights(unseen, ["by_line", "by_mean"])
    scored = unseen.withColumn("by_blend", sum(F.col(c) * w for c, w in weights.items()))
    board = diagnose.leaderboard(scored, {"line": "by_line", "mean": "by_mean", "blend": "by_blend"}, ("make",))
    return board.select("make", "candidate", "n", F.col("mae").cast("float").cast("double").alias("mae"), "place")

"""Queries over the market summaries."""

from dealwright.operators import lowess, market
from dealwright.plans.base import features
from dealwright.plans.catalog import query
from dealwright.session import materialise
from dealwright.sources.listings import FEATURES_SQL


@query(
    "market_summary",
    f"""WITH {FEATURES_SQL}
    SELECT make, model, count(*) AS n_listings, min(price) AS min_price, max(price) AS max_price,
           avg(age) AS avg_age, median(price) AS median_price FROM features GROUP BY make, model""",
)
def market_summary(spark, sf_dir):
    return market.market_summary(materialise(features(spark, sf_dir, "make", "model", "price", "age")))


@query(
    "price_quantiles",
    f"""WITH {FEATURES_SQL}
    SELECT make, model, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.5) AS q50,
           quantile_cont(price, 0.75) AS q75 FROM features GROUP BY make, model""",
)
def price_quantiles(spark, sf_dir):
    return market.price_quantiles(materialise(features(spark, sf_dir, "make", "model", "price")))


BINS_SQL = """,
edges AS (SELECT make, model, min({v}) AS lo, max({v}) AS hi FROM {t} GROUP BY ALL),
binned AS (SELECT make, model, lo, hi, least({n}, 1 + floor(({v} - lo) / (hi - lo) * {n}))::INT AS bin
           FROM {t} JOIN edges USING (make, model))"""


@query(
    "price_histogram",
    f"""WITH {FEATURES_SQL}{BINS_SQL.format(v="price", t="features", n=40)},
    q AS (SELECT make, model, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.5) AS q50,
                 quantile_cont(price, 0.75) AS q75 FROM features GROUP BY make, model)
    SELECT make, model, bin, lo + (bin - 1) * ((hi - lo) / 40.0) AS bin_from, lo + bin * ((hi - lo) / 40.0) AS bin_to,
           count(*) AS n, q25, q50, q75
    FROM binned JOIN q USING (make, model) GROUP BY ALL""",
)
def price_histogram(spark, sf_dir):
    return market.price_histogram(materialise(features(spark, sf_dir, "make", "model", "price")))


def box_sql(extra: str) -> str:
    return f"""WITH {FEATURES_SQL},
    q AS (SELECT make, model, {extra}, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.5) AS q50,
                 quantile_cont(price, 0.75) AS q75 FROM features GROUP BY ALL)
    SELECT make, model, {extra}, q25, q50, q75, count(*) AS n, min(price) AS min_value, max(price) AS max_value,
           min(price) FILTER (price BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_low,
           max(price) FILTER (price BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_high,
           count(*) FILTER (NOT price BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS n_beyond
    FROM features JOIN q USING (make, model, {extra}) GROUP BY ALL"""


@query("price_by_year_box", box_sql("year"))
def price_by_year_box(spark, sf_dir):
    return market.price_by_year_box(materialise(features(spark, sf_dir, "make", "model", "year", "price")))


@query("price_by_region_box", box_sql("region"))
def price_by_region_box(spark, sf_dir):
    return market.price_by_region_box(materialise(features(spark, sf_dir, "make", "model", "region", "price")))


@query(
    "price_by_odometer_trend",
    f"""WITH {FEATURES_SQL},
    edges AS (SELECT make, model, min(odometer) AS lo, max(odometer) AS hi FROM features GROUP BY ALL)
    SELECT make, model, least(20, 1 + floor((odometer - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS n,
           avg(odometer)::FLOAT::DOUBLE AS x_mean, avg(price)::FLOAT::DOUBLE AS y_mean,
           CASE WHEN var_pop(odometer) > 0 THEN regr_slope(price, odometer)::FLOAT::DOUBLE END AS slope,
           CASE WHEN var_pop(odometer) > 0 THEN regr_intercept(price, odometer)::FLOAT::DOUBLE END AS intercept
    FROM features JOIN edges USING (make, model) GROUP BY ALL""",
)
def price_by_odometer_trend(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = materialise(features(spark, sf_dir, "make", "model", "odometer", "price"))
    trend = market.binned_trend(rows, "odometer", "price")
    # Slopes of round distances are often exact decimal ties: compare them in single precision.
    rounded = [F.col(c).cast("float").cast("double").alias(c) for c in ("x_mean", "y_mean", "slope", "intercept")]
    return trend.select("make", "model", "bin", "n", *rounded)


@query(
    "price_by_odometer_smooth",
    f"""WITH {FEATURES_SQL},
    edges AS (SELECT make, model, min(odometer) AS lo, max(odometer) AS hi FROM features GROUP BY ALL),
    grid AS (SELECT make, model, (hi - lo) / 3 AS reach, p::INT AS point, lo + p * (hi - lo) / 19 AS grid_x
             FROM edges, range(20) t(p)),
    weighed AS (SELECT make, model, point, grid_x, odometer - grid_x AS d, price::DOUBLE AS y,
                       pow(1 - pow(least(abs(odometer - grid_x) / reach, 1.0), 3), 3) AS w
                FROM features JOIN grid USING (make, model)),
    sums AS (SELECT make, model, point, grid_x, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2,
                    sum(w * y) AS t0, sum(w * d * y) AS t1 FROM weighed GROUP BY ALL)
    SELECT make, model, point, round(grid_x, 4) AS grid_x,
           round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 2) AS smoothed FROM sums""",
)
def price_by_odometer_smooth(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = materialise(features(spark, sf_dir, "make", "model", "odometer", "price"))
    smooth = market.smooth_trend(rows, "odometer", "price")
    return smooth.select(
        "make", "model", "point", F.round("grid_x", 4).alias("grid_x"), F.round("smoothed", 2).alias("smoothed")
    )


def lowess_fit_sql(k: int, keep: bool) -> str:
    """The curve of pass ``k`` from the sums per distance ``sums{k}``; a point without weight keeps its earlier value."""
    value = "coalesce(fit, c.smoothed)" if keep else "fit"
    before = f"JOIN curve{k - 1} c USING (make, model, point)" if keep else ""
    return f"""
weighed{k} AS (SELECT make, model, point, grid_x, x - grid_x AS d, w * near AS ww, wy * near AS yy FROM (
  SELECT s.*, g.point, g.grid_x, CASE WHEN h > 0 THEN pow(1 - pow(least(abs(x - grid_x) / h, 1.0), 3), 3)
           ELSE (x = grid_x)::INT END AS near
  FROM sums{k} s JOIN grid g USING (make, model) JOIN reach USING (make, model, point))),
fits{k} AS (SELECT make, model, point, grid_x, CASE WHEN s0 * s2 - s1 * s1 <= 1e-9 * s0 * s2 THEN t0 / nullif(s0, 0)
              ELSE (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END AS fit
  FROM (SELECT make, model, point, grid_x, sum(ww) AS s0, sum(ww * d) AS s1, sum(ww * d * d) AS s2, sum(yy) AS t0,
               sum(yy * d) AS t1 FROM weighed{k} GROUP BY ALL)),
curve{k} AS MATERIALIZED (SELECT make, model, point, f.grid_x, {value} AS smoothed FROM fits{k} f {before})"""


def lowess_weigh_sql(k: int, points: int) -> str:
    """The sums of pass ``k`` with rows weighed by their distance from the curve before."""
    return f"""
left{k} AS MATERIALIZED (SELECT r.make, r.model, x, y, abs(y - (a.smoothed + (b.smoothed - a.smoothed) * (place - low_point))) AS r
  FROM (SELECT f.make, f.model, odometer AS x, price AS y, (odometer - lo) / (hi - lo) * {points - 1} AS place,
               least({points - 2}, floor((odometer - lo) / (hi - lo) * {points - 1})) AS low_point
        FROM features f JOIN edges USING (make, model) WHERE hi > lo) r
  JOIN curve{k - 1} a ON a.make = r.make AND a.model = r.model AND a.point = low_point
  JOIN curve{k - 1} b ON b.make = r.make AND b.model = r.model AND b.point = low_point + 1),
typical{k} AS (SELECT make, model, median(r) AS s FROM left{k} GROUP BY ALL),
sums{k} AS MATERIALIZED (SELECT make, model, x, sum(q) AS w, sum(q * y) AS wy FROM (
  SELECT l.*, CASE WHEN s <= 0 THEN 1 WHEN r >= 6 * s THEN 0 ELSE pow(1 - pow(r / (6 * s), 2), 2) END AS q
  FROM left{k} l JOIN typical{k} USING (make, model)) GROUP BY ALL)"""


LOWESS_POINTS = 12
LOWESS_SQL = f"""{FEATURES_SQL},
edges AS (SELECT make, model, min(odometer) AS lo, max(odometer) AS hi, count(*) AS n FROM features GROUP BY ALL),
grid AS (SELECT make, model, p::INT AS point, lo + p * ((hi - lo) / {LOWESS_POINTS - 1}) AS grid_x, n
         FROM edges, range({LOWESS_POINTS}) t(p) WHERE hi > lo),
sums0 AS (SELECT make, model, odometer AS x, count(*) AS w, sum(price) AS wy FROM features GROUP BY ALL),
reach AS MATERIALIZED (SELECT make, model, point, min(d) AS h FROM (
  SELECT make, model, point, d, n, sum(w) OVER (PARTITION BY make, model, point ORDER BY d RANGE UNBOUNDED PRECEDING) AS upto
  FROM (SELECT g.make, g.model, g.point, g.n, abs(x - grid_x) AS d, w FROM sums0 JOIN grid g USING (make, model)))
  WHERE upto >= ceil(2 / 3.0::DOUBLE * n) GROUP BY ALL),
{lowess_fit_sql(0, False)},
{",".join(lowess_weigh_sql(k, LOWESS_POINTS) + "," + lowess_fit_sql(k, True) for k in (1, 2, 3))}"""


@query(
    "price_by_odometer_lowess",
    f"""WITH {LOWESS_SQL}
    SELECT make, model, point, round(grid_x, 4) AS grid_x, round(smoothed, 2) AS smoothed FROM curve3""",
)
def price_by_odometer_lowess(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = materialise(features(spark, sf_dir, "make", "model", "odometer", "price"))
    curve = lowess.lowess(rows, "odometer", "price", points=LOWESS_POINTS)
    return curve.select(
        "make", "model", "point", F.round("grid_x", 4).alias("grid_x"), F.round("smoothed", 2).alias("smoothed")
    )


@query(
    "category_counts",
    f"""WITH {FEATURES_SQL},
    long AS (SELECT make, model, 'region' AS category, region AS value FROM features
             UNION ALL SELECT make, model, 'fuel', fuel FROM features
             UNION ALL SELECT make, model, 'transmission', transmission FROM features
             UNION ALL SELECT make, model, 'cylinders', cylinders FROM features)
    SELECT make, model, category, value, count(*) AS n FROM long GROUP BY ALL""",
)
def category_counts(spark, sf_dir):
    columns = ("region", "fuel", "transmission", "cylinders")
    return market.category_counts(features(spark, sf_dir, "make", "model", *columns), columns)

"""Queries over listings seen repeatedly and arriving as a stream."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from dealwright.config import SEGMENT, OutlierSettings
from dealwright.operators import deals, history, sampling, train
from dealwright.plans import model_sql, valuation
from dealwright.plans.base import features
from dealwright.plans.catalog import query
from dealwright.plans.clean_queries import SPLIT_SQL
from dealwright.plans.model_queries import DEAL_SQL, MODEL_INPUT, rounded, scored_listings
from dealwright.session import fresh_path, materialise
from dealwright.sources.listings import FEATURES_SQL, table
from dealwright.streaming import scoring as stream
from dealwright.streaming import stateful

ARRIVALS_SQL = """
arrivals AS (SELECT event_id, ts, user_id AS listing_id, event_type AS model, value AS price,
                    (props::JSON ->> '$.k')::DOUBLE AS odometer FROM events)"""
ARRIVAL_MODEL_SQL = ARRIVALS_SQL + """,
fits AS (SELECT model, regr_slope(price, odometer) AS slope, regr_intercept(price, odometer) AS intercept
         FROM arrivals GROUP BY model),
scored AS (SELECT a.*, intercept + slope * odometer AS prediction_label,
                  (intercept + slope * odometer - price) / nullif(intercept + slope * odometer, 0) * 100 AS discount_pct
           FROM arrivals a JOIN fits USING (model))"""


def arrivals(spark, sf_dir):
    return stream.as_listings(table(spark, sf_dir, "events"))


def arrival_models(spark, sf_dir):
    rows = arrivals(spark, sf_dir)
    return rows.groupBy("model").agg(
        F.regr_slope("price", "odometer").alias("slope"), F.regr_intercept("price", "odometer").alias("intercept")
    )


@query(
    "stream_score",
    f"""WITH {ARRIVAL_MODEL_SQL}
    SELECT event_id, listing_id, model, price, odometer, round(prediction_label, 4) AS prediction_label,
           round(discount_pct, 4) AS discount_pct FROM scored""",
)
def stream_score(spark, sf_dir):
    path = fresh_path(spark, "scored")
    models = materialise(arrival_models(spark, sf_dir))  # a stored table: a micro-batch does not train again
    scored = stream.score_arrivals(stream.read_arrivals(spark, sf_dir, "events.parquet"), models)
    stream.append_to(scored, path, fresh_path(spark, "scored-progress")).awaitTermination()
    out = spark.read.parquet(path).drop("ts", "batch")
    return rounded(out, four=("prediction_label", "discount_pct"))


@query(
    "stream_score_listings",
    f"""WITH {SPLIT_SQL}, train AS (SELECT * FROM split WHERE NOT is_oos),
    {model_sql.gate("train", 20, "large")}, {model_sql.gate("train", 10, "wide")},
    {model_sql.specific("large")}, {model_sql.general("wide")},
    oos AS (SELECT * FROM split WHERE is_oos), {model_sql.predicted("oos", "p0")},
    estimates AS (SELECT listing_id, make, model, price, {model_sql.BLENDED} AS e FROM p0)
    SELECT listing_id, make, model, round(e, 2) AS prediction_label, round((e - price) / nullif(e, 0) * 100, 4) AS discount_pct
    FROM estimates""",
)
def stream_score_listings(spark, sf_dir):
    """Held-out listings arrive, one part of them twice, and are valued by stored models of all others."""
    rows = materialise(sampling.oos_split(materialise(features(spark, sf_dir, *MODEL_INPUT))))
    models, landed = fresh_path(spark, "models"), fresh_path(spark, "arriving")
    valuation.save_models(
        valuation.train_models(rows.where("NOT is_oos").drop("is_oos"), outlier_settings=OutlierSettings(method="none")), models
    )
    new = rows.where("is_oos").drop("is_oos").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.pmod(F.xxhash64("listing_id"), F.lit(3600))))
    new.write.parquet(landed)
    new.where("model = 'STANDARD'").write.mode("append").parquet(landed)
    scored = stream.score_listings(spark.readStream.schema(new.schema).parquet(landed), valuation.load_models(spark, models))
    path = fresh_path(spark, "valued")
    stream.append_to(
        scored.select("listing_id", *SEGMENT, "prediction_label", "discount_pct"), path, fresh_path(spark, "valued-progress")
    ).awaitTermination()
    return spark.read.parquet(path).select(
        "listing_id", *SEGMENT, F.round("prediction_label", 2).alias("prediction_label"), F.round("discount_pct", 4).alias("discount_pct")
    )


def run_with_state(spark, stream_rows, name):
    """The rows that a stream with state appends while it reads what is there."""
    path = fresh_path(spark, name)
    with stateful.state_store(spark):
        query = stream.append_to(stream_rows, path, fresh_path(spark, f"{name}-progress"))
    query.awaitTermination()
    return spark.read.parquet(path)


@query(
    "stream_price_moves",
    f"""WITH {ARRIVALS_SQL},
    moves AS (SELECT event_id, listing_id, ts, price, lag(price) OVER (PARTITION BY listing_id ORDER BY ts, event_id) AS previous FROM arrivals)
    SELECT event_id, listing_id, price, previous, round(price - previous, 4) AS move FROM moves
    WHERE ts < (SELECT max(ts) FROM arrivals) - INTERVAL 25 HOURS""",
)
def stream_price_moves(spark, sf_dir):
    """Moves that the watermark has passed by an hour; the others come with later arrivals."""
    newest = arrivals(spark, sf_dir).agg(F.max("ts") - F.expr("INTERVAL 25 HOURS")).first()[0]
    moves = stateful.price_moves(stream.read_arrivals(spark, sf_dir, "events.parquet"))
    out = run_with_state(spark, moves, "moves").where(F.col("ts") < F.lit(newest))
    return out.select("event_id", "listing_id", "price", "previous", F.round("move", 4).alias("move"))


@query(
    "stream_daily_digest",
    f"""WITH {ARRIVAL_MODEL_SQL},
    per_listing AS (SELECT strftime(ts, '%Y-%m-%d') AS day, listing_id, max(struct_pack(d := discount_pct, p := price)) AS best
                    FROM scored WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM arrivals) - INTERVAL 25 HOURS GROUP BY ALL)
    SELECT day, row_number() OVER (PARTITION BY day ORDER BY best.d DESC, listing_id)::INT AS place, listing_id,
           round(best.d, 4) AS discount_pct, best.p AS price FROM per_listing QUALIFY place <= 10""",
)
def stream_daily_digest(spark, sf_dir):
    """The ten best listings of each day, told when the watermark has passed the day."""
    newest = arrivals(spark, sf_dir).agg(F.date_format(F.max("ts") - F.expr("INTERVAL 49 HOURS"), "yyyy-MM-dd")).first()[0]
    models = materialise(arrival_models(spark, sf_dir))
    found = stream.deals_of(stream.read_arrivals(spark, sf_dir, "events.parquet"), models)
    told = run_with_state(spark, stateful.best_of_days(found), "digest")
    out = stateful.digest(told.where(F.col("day") <= F.lit(newest)))
    return out.withColumn("discount_pct", F.round("discount_pct", 4))


@query(
    "stream_alerts",
    f"""WITH {ARRIVAL_MODEL_SQL},
    watches AS (SELECT row_number() OVER (ORDER BY model) AS watch_id, model, min(price) * 2 AS budget FROM arrivals GROUP BY model)
    SELECT DISTINCT watch_id, listing_id FROM scored JOIN watches USING (model) WHERE price <= budget""",
)
def stream_alerts(spark, sf_dir):
    """Searches and the listings that have met them, from a stream that tells each pair once."""
    models = materialise(arrival_models(spark, sf_dir))
    budgets = arrivals(spark, sf_dir).groupBy("model").agg((F.min("price") * 2).alias("budget"))
    watches = materialise(  # a row per model
        budgets.select(
            F.row_number().over(Window.orderBy("model")).cast("long").alias("watch_id"), F.lit("any").alias("make"), "model",
            "budget", F.lit(None).cast("string").alias("region"),
        )
    )
    found = stream.deals_of(stream.read_arrivals(spark, sf_dir, "events.parquet"), models).withColumns(
        {"make": F.lit("any"), "region": F.lit("everywhere")}
    )
    path = fresh_path(spark, "alerts")
    stream.append_to(stateful.alerts(found, watches), path, fresh_path(spark, "alerts-progress")).awaitTermination()
    return spark.read.parquet(path).select("watch_id", "listing_id").distinct()


@query(
    "stream_daily_counts",
    f"""WITH {ARRIVALS_SQL},
    days AS (SELECT date_trunc('day', ts) AS day, model, count(*) AS n, avg(price) AS m FROM arrivals GROUP BY ALL)
    SELECT strftime(day, '%Y-%m-%d') AS day, model, n, m::FLOAT::DOUBLE AS mean_price FROM days
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM arrivals) - INTERVAL 1 DAY""",
)
def stream_daily_counts(spark, sf_dir):
    """Days that the watermark has passed; the last, still open ones come with later arrivals."""
    path = fresh_path(spark, "daily")
    counts = stream.daily_counts(stream.read_arrivals(spark, sf_dir, "events.parquet"))
    stream.append_to(counts, path, fresh_path(spark, "daily-progress")).awaitTermination()
    out = spark.read.parquet(path)
    return out.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "model", "n",
        F.col("mean_price").cast("float").cast("double").alias("mean_price"),
    )


@query(
    "listing_history",
    f"""WITH {ARRIVALS_SQL}
    SELECT listing_id, event_id, model, price, odometer FROM arrivals
    QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def listing_history(spark, sf_dir):
    path = fresh_path(spark, "history")
    history.append_history(arrivals(spark, sf_dir).withColumn("ingest_date", F.to_date("ts")), path)
    newest = history.latest_snapshot(spark.read.parquet(path))
    return newest.select("listing_id", "event_id", "model", "price", "odometer")


@query(
    "days_on_market",
    f"""WITH {ARRIVALS_SQL}
    SELECT listing_id, count(*) AS n_sightings, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS days
    FROM arrivals GROUP BY listing_id""",
)
def days_on_market(spark, sf_dir):
    return history.days_on_market(arrivals(spark, sf_dir)).select("listing_id", "n_sightings", "days")


@query(
    "price_moves",
    f"""WITH {ARRIVALS_SQL}
    SELECT listing_id, event_id, price, lag(price) OVER w AS previous, round(price - lag(price) OVER w, 6) AS move
    FROM arrivals WINDOW w AS (PARTITION BY listing_id ORDER BY ts, event_id)""",
)
def price_moves(spark, sf_dir):
    moves = history.price_moves(arrivals(spark, sf_dir))
    return moves.select("listing_id", "event_id", "price", "previous", F.round("move", 6).alias("move"))


@query(
    "daily_digest",
    f"""WITH {ARRIVAL_MODEL_SQL}
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, model, round(discount_pct, 4) AS discount_pct,
           row_number() OVER (PARTITION BY ts::DATE ORDER BY scored.discount_pct DESC, event_id)::INT AS place
    FROM scored QUALIFY place <= 10""",
)
def daily_digest(spark, sf_dir):
    rows = arrivals(spark, sf_dir).join(arrival_models(spark, sf_dir), "model")
    rows = deals.add_discount(rows.withColumn("prediction_label", F.expr("intercept + slope * odometer")))
    best = history.daily_digest(rows.withColumn("listing_id", F.col("event_id")))
    return best.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "event_id", "model",
        F.round("discount_pct", 4).alias("discount_pct"), "place",
    )


@query(
    "watchlist_match",
    f"""WITH {DEAL_SQL},
    watch AS (SELECT p_partkey AS watch_id, p_brand AS make, p_type AS model, p_retailprice * 20 AS budget,
                     CASE WHEN p_size > 25 THEN 'ASIA' END AS region FROM part)
    SELECT watch_id, listing_id, d.price, round(discount_pct, 4) AS discount_pct
    FROM deals d JOIN watch w ON d.make = w.make AND d.model = w.model AND d.price <= w.budget
         AND (w.region IS NULL OR d.region = w.region)""",
)
def watchlist_match(spark, sf_dir):
    watch = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("watch_id"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"),
        (F.col("p_retailprice") * 20).alias("budget"), F.when(F.col("p_size") > 25, "ASIA").alias("region"),
    )
    # rounded once for each deal, not for each pair
    found = rounded(deals.undervalued_pct(scored_listings(spark, sf_dir)), four=("discount_pct",))
    return history.watchlist_match(found, watch)


@query(
    "depreciation_curve",
    f"""WITH {FEATURES_SQL},
    by_age AS (SELECT make, model, age, count(*) AS n, avg(price) AS m FROM features GROUP BY ALL),
    newest AS (SELECT make, model, arg_min(m, age) AS m0 FROM by_age GROUP BY ALL)
    SELECT make, model, age, n, round(m, 4) AS mean_price, round(m / m0, 8) AS share_of_newest
    FROM by_age JOIN newest USING (make, model)""",
)
def depreciation_curve(spark, sf_dir):
    curve = history.depreciation_curve(features(spark, sf_dir, "make", "model", "age", "price"))
    return rounded(curve.withColumn("share_of_newest", F.round("share_of_newest", 8)), four=("mean_price",))


@query(
    "regional_arbitrage",
    f"""WITH {FEATURES_SQL},
    by_region AS (SELECT make, model, region, avg(price) AS m FROM features GROUP BY ALL)
    SELECT make, model, arg_max(region, m) AS dearest, arg_min(region, m) AS cheapest,
           round(max(m) - min(m), 4) AS spread, round((max(m) - min(m)) / min(m) * 100, 6) AS spread_pct
    FROM by_region GROUP BY make, model""",
)
def regional_arbitrage(spark, sf_dir):
    out = history.regional_arbitrage(features(spark, sf_dir, "make", "model", "region", "price"))
    return out.withColumns({"spread": F.round("spread", 4), "spread_pct": F.round("spread_pct", 6)})


@query(
    "deal_precision",
    f"""WITH {DEAL_SQL}
    SELECT region, count(*) AS n_graded, sum(quality)::BIGINT AS n_correct, avg(quality) AS precision
    FROM deals JOIN labels ON doc_id = split_part(listing_id, '-', 1)::BIGINT GROUP BY region""",
)
def deal_precision(spark, sf_dir):
    """Precision of the flagged deals whose order was graded."""
    graded = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("graded_id"), F.col("quality").alias("correct"))
    found = deals.undervalued_pct(scored_listings(spark, sf_dir))
    flagged = found.withColumn("graded_id", F.split("listing_id", "-")[0].cast("bigint"))
    return history.deal_precision(flagged, graded, "graded_id", ["region"])


DRIFT_SQL = f"""{FEATURES_SQL},
runs AS (
  SELECT make, model, year, {model_sql.MOMENTS} FROM features
  GROUP BY make, model, year),
fits AS (SELECT make, model, year, n, {model_sql.LINE} FROM runs),
errors AS (SELECT make, model, year, avg(abs(price - (intercept + b_age * age + b_odometer * odometer))) AS mae
           FROM features JOIN fits USING (make, model, year) GROUP BY ALL)"""


@query(
    "drift",
    f"""WITH {DRIFT_SQL}
    SELECT make, model, year AS training_year, mae::FLOAT::DOUBLE AS mae,
           (lag(mae) OVER w)::FLOAT::DOUBLE AS previous, round(mae - lag(mae) OVER w, 6) AS change
    FROM errors WINDOW w AS (PARTITION BY make, model ORDER BY year)""",
)
def drift(spark, sf_dir):
    """One training run per listing year: its error, and the change from the run before."""
    rows = features(spark, sf_dir, "make", "model", "year", "age", "odometer", "price")
    keys = [*SEGMENT, "year"]
    scored = rows.join(train.fit_lines(rows, keys), keys)
    mae = scored.groupBy(*keys).agg(F.avg(F.abs(F.col("price") - train.line_value())).alias("mae"))
    out = history.drift(mae.withColumnRenamed("year", "training_year"), order="training_year")
    single = {c: F.col(c).cast("float").cast("double") for c in ("mae", "previous")}
    return out.withColumns({**single, "change": F.round("change", 6)})

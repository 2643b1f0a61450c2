"""Scoring of listings as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dealwright.operators import deals, value
from dealwright.plans import valuation

ARRIVALS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_arrivals(spark: SparkSession, folder: str, name_filter: str = "*.parquet") -> DataFrame:
    """Arriving listings from Parquet files as they appear in a folder.

    The event type stands for the segment, the value for the ask and ``props.k`` for the distance.
    """
    raw = spark.readStream.schema(ARRIVALS).option("pathGlobFilter", name_filter).parquet(folder)
    return as_listings(raw)


def as_listings(events: DataFrame) -> DataFrame:
    distance = F.from_json("props", "k int")["k"].cast("double")
    return events.select(
        "event_id", "ts", F.col("user_id").alias("listing_id"), F.col("event_type").alias("model"),
        F.col("value").alias("price"), distance.alias("odometer"),
    )


def score_arrivals(arrivals: DataFrame, models: DataFrame, delay: str = "1 day", id_column: str = "event_id") -> DataFrame:
    """Estimate and discount of each new listing, by a join with the stored model table.

    A listing delivered twice within the delay is scored once.
    """
    fresh = arrivals.withWatermark("ts", delay).dropDuplicatesWithinWatermark([id_column])
    scored = fresh.join(models, "model").withColumn(
        "prediction_label", F.col("intercept") + F.col("slope") * F.col("odometer")
    )
    return deals.add_discount(scored).select(
        "event_id", "ts", "listing_id", "model", "price", "odometer", "prediction_label", "discount_pct"
    )


def deals_of(arrivals: DataFrame, models: DataFrame) -> DataFrame:
    """Estimate and discount of every arrival, repeated ones too, for steps that tell them apart by themselves."""
    scored = arrivals.join(models, "model").withColumn(
        "prediction_label", F.col("intercept") + F.col("slope") * F.col("odometer")
    )
    return deals.add_discount(scored).drop("intercept", "slope")


def score_listings(
    arrivals: DataFrame, models: valuation.Models, delay: str = "1 day", ts: str = "ts", id_column: str = "listing_id"
) -> DataFrame:
    """New listings valued by the models that deal search and valuation use, each once within ``delay``.

    ``arrivals`` are cleaned listings with an event time. The stored models are joined by make and model, so segments of one
    model name under two makes stay apart; small segments lean on the general model as in ``valuation``.
    """
    fresh = arrivals.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_column])
    valued = value.drop_models(valuation.predict_with_confidence(fresh, models))
    return deals.add_discount(valued)


def daily_counts(arrivals: DataFrame, delay: str = "1 day") -> DataFrame:
    """New listings and mean ask per day and segment, final once the watermark has passed the day."""
    return (
        arrivals.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), "model")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price"))
        .select(F.col("window.start").alias("day"), "model", "n", "mean_price")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append every micro-batch to a Parquet table under its batch number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = each(batch) if each else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

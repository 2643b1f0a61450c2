"""Model registry: an append-only Parquet table, one row per trained model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealwright.config import SEGMENT
from dealwright.schemas import REGISTRY

GENERAL, GENERAL_PART = "general", "general_part"


def segment_entries(sizes: DataFrame, kind: str, trained_at: Column, path: str) -> DataFrame:
    """Registry rows for one model per segment; ``sizes`` holds make, model and n."""
    return sizes.select(
        "make",
        "model",
        F.lit(kind).alias("kind"),
        F.col("n").cast("bigint").alias("n_training_samples"),
        trained_at.cast("timestamp").alias("training_date"),
        F.concat_ws("/", F.lit(path), F.concat_ws("_", "make", "model")).alias("path"),
        F.lit(None).cast("int").alias("car_types"),
    )


def general_entries(sizes: DataFrame, trained_at: Column, path: str) -> DataFrame:
    """The registry row of the cross-segment model, and a row with the rows that each segment gave it."""
    when = trained_at.cast("timestamp").alias("training_date")
    whole = sizes.agg(
        F.sum("n").cast("bigint").alias("n_training_samples"), F.count(F.lit(1)).cast("int").alias("car_types")
    ).select(
        F.lit(None).cast("string").alias("make"),
        F.lit(None).cast("string").alias("model"),
        F.lit(GENERAL).alias("kind"),
        "n_training_samples",
        when,
        F.lit(path).alias("path"),
        "car_types",
    )
    return whole.unionByName(segment_entries(sizes, GENERAL_PART, trained_at, path))


def registry_write(entries: DataFrame, path: str) -> None:
    entries.select(*[f.name for f in REGISTRY.fields]).write.mode("append").parquet(path)


def registry_read(spark: SparkSession, path: str) -> DataFrame:
    """Every entry ever written; no rows when nothing has been trained yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).parquet(path)


def latest(entries: DataFrame) -> DataFrame:
    """The newest entry of every model."""
    newest = Window.partitionBy("kind", *SEGMENT).orderBy(F.desc("training_date"), F.desc("n_training_samples"))
    return entries.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def catalog_models(entries: DataFrame) -> DataFrame:
    """Segments with a model of their own."""
    return entries.where(F.col("kind") == "specific").select(*SEGMENT).distinct()


def has_general_model(entries: DataFrame) -> bool:
    return not entries.where(F.col("kind") == GENERAL).isEmpty()


def catalog_available(data: DataFrame, entries: DataFrame) -> DataFrame:
    """Make to its models, for segments that have both listings and a model."""
    both = data.select(*SEGMENT).intersect(catalog_models(entries))
    return both.groupBy("make").agg(F.sort_array(F.collect_list("model")).alias("models"))


def missing_segments(requested: DataFrame, data: DataFrame, entries: DataFrame) -> DataFrame:
    """Requested segments with what each lacks: listings, a model or both."""
    keys = list(SEGMENT)
    has_data = data.select(*keys).distinct().withColumn("has_data", F.lit(True))
    has_model = catalog_models(entries).withColumn("has_model", F.lit(True))
    return (
        requested.select(*keys)
        .distinct()
        .join(has_data, keys, "left")
        .join(has_model, keys, "left")
        .select(
            *keys,
            F.col("has_data").isNull().alias("needs_fetch"),
            F.col("has_model").isNull().alias("needs_training"),
        )
        .where("needs_fetch OR needs_training")
    )


def segment_lookup_ci(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog spelling of requested segments, compared without case; null when there is none."""
    known = catalog.select(
        F.lower("make").alias("_make"),
        F.lower("model").alias("_model"),
        F.col("make").alias("known_make"),
        F.col("model").alias("known_model"),
    )
    match = (F.lower(requested["make"]) == known["_make"]) & (F.lower(requested["model"]) == known["_model"])
    return (
        requested.join(known, match, "left")
        .drop("_make", "_model")
        .withColumn("specific_model_exists", F.col("known_make").isNotNull())
    )

"""The stored listings table, partitioned by segment."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealwright.config import SEGMENT
from dealwright.functions.parsing import segment_part
from dealwright.session import materialise

ROWS_PER_FILE = 2_000_000


def sink_segments(df: DataFrame, path: str, mode: str = "overwrite", replace_all: bool = False) -> None:
    """Write listings partitioned by make and model.

    Segments that ``df`` holds take the place of what is stored of them, all others stay as they are; ``replace_all`` lets
    the table hold ``df`` alone. A segment's new files appear together when the job commits, so a job that fails or is
    run again changes nothing twice. The rebalance hint lets adaptive execution cut a large segment into several writers.
    """
    (
        df.hint("rebalance", *SEGMENT)
        .write.mode(mode)
        .option("partitionOverwriteMode", "static" if replace_all else "dynamic")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*SEGMENT)
        .parquet(path)
    )


def compact_segments(spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rewrite the segments that appends have left in more than twice the files they need; returns them with their files.

    Only their folders are read and replaced.
    """
    files = scan_all_segments(spark, path).groupBy(*SEGMENT).agg(
        F.countDistinct(F.col("_metadata.file_path")).alias("n_files"), F.count(F.lit(1)).alias("n")
    )
    scattered = materialise(files.where(F.col("n_files") > 2 * F.ceil(F.col("n") / rows_per_file)))
    if not scattered.isEmpty():
        sink_segments(materialise(scan_all_segments(spark, path).join(scattered.select(*SEGMENT), list(SEGMENT), "left_semi")), path)
    return scattered


def scan_all_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_segment(df: DataFrame, make: str, model: str) -> DataFrame:
    """One segment; on the stored table this reads only its own folder."""
    return df.where((F.col("make") == make) & (F.col("model") == model))


def scan_segments(df: DataFrame, segments: Iterable[tuple[str, str]]) -> DataFrame:
    """Several named segments."""
    condition = F.lit(False)
    for make, model in segments:
        condition = condition | ((F.col("make") == make) & (F.col("model") == model))
    return df.where(condition)


def segments_of_names(names: DataFrame, column: str, suffix: str) -> DataFrame:
    """Make and model of file names 'make_model<suffix>'; other names are left out."""
    return (
        names.where(F.col(column).endswith(suffix))
        .withColumns({"make": segment_part(F.col(column), suffix, 0), "model": segment_part(F.col(column), suffix, 1)})
        .where(F.col("model").isNotNull())
    )


def load_combined_column(df: DataFrame, column: str, fill: str) -> DataFrame:
    """One text column over every segment, filled where absent."""
    return df.select(F.coalesce(F.col(column), F.lit(fill)).alias("value"))

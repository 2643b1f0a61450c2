"""Landed search pages (``{TotalCount, List: [...]}``) to raw listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealwright.config import SEGMENT
from dealwright.schemas import PAGE, PAGE_RECORD

ROWS_PER_PAGE = 500


def pages_needed(total: Column) -> Column:
    """Pages requested for a result of ``total`` rows; one more than needed at exact multiples."""
    return F.floor(total / ROWS_PER_PAGE).cast("bigint") + 1


def snake_case(name: str) -> str:
    """'PriceDisplay' to 'price_display', 'Is4WD' to 'is_4wd'."""
    return re.sub(r"(?<=[a-z])(?=[A-Z0-9])", "_", name).lower()


def read_pages(spark: SparkSession, path: str, schema: T.StructType = PAGE) -> DataFrame:
    """Page files of a folder laid out as make=/model=/; one row per page."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def explode_pages(pages: DataFrame) -> DataFrame:
    """One row per listing of every page, columns under their table names. Empty pages give no rows."""
    record = pages.schema["List"].dataType.elementType
    keep = [c for c in pages.columns if c not in ("TotalCount", "List")]
    rows = pages.select(*keep, F.explode("List").alias("_record"))
    return rows.select(*keep, *[F.col(f"_record.{f.name}").alias(snake_case(f.name)) for f in record.fields])


def read_variant_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files of a folder laid out as make=/model=/, as they are: (payload, page), ``page`` null if it is no JSON."""
    raw = spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "payload")
    return raw.withColumn("page", F.try_parse_json("payload"))


def explode_variant_pages(
    pages: DataFrame, record: T.StructType = PAGE_RECORD, keys=SEGMENT
) -> tuple[DataFrame, DataFrame]:
    """Listings of pages whose fields come and go, and what could not be read.

    The first has the fields of ``record`` under their table names, null where a record lacks them, and ``extra``, a variant
    object with all other fields (null if none). A record with a field of another type than ``record`` says goes to the
    second, (keys, reason, payload), and so does a page that is no JSON or has no list.
    """
    keys = list(keys)
    listed = F.try_variant_get("page", "$.List", "array<variant>")
    rows = pages.where(listed.isNotNull()).select(*keys, F.explode(listed).alias("_record"))
    typed, wrong = [], []
    for f in record.fields:
        value = F.try_variant_get("_record", f"$.{f.name}", f.dataType.simpleString())
        stated = F.try_variant_get("_record", f"$.{f.name}", "string")
        typed.append(value.alias(snake_case(f.name)))
        wrong.append(F.when(stated.isNotNull() & value.isNull(), f"{f.name} is no {f.dataType.simpleString()}"))
    fields = F.try_variant_get("_record", "$", "map<string,variant>")
    other = F.map_filter(fields, lambda name, _: ~name.isin([f.name for f in record.fields]))
    extra = F.when(F.size(other) > 0, F.to_variant_object(other))
    reason = F.coalesce(*wrong, F.when(fields.isNull(), "no object"))
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select(*keys, *typed, extra.alias("extra"))
    bad = judged.where("reason IS NOT NULL").select(*keys, "reason", F.to_json("_record").alias("payload"))
    unread = pages.where(listed.isNull()).select(*keys, F.lit("page not readable").alias("reason"), "payload")
    return good, bad.unionByName(unread)


def with_extra(listings: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns of their own for fields that were kept in ``extra``: name in the feed to SQL type.

    A column that later files have by themselves is filled from ``extra`` where earlier ones lack it.
    """
    added = {}
    for name, kind in fields.items():
        column, value = snake_case(name), F.try_variant_get("extra", f"$.{name}", kind)
        added[column] = F.coalesce(F.col(column), value) if column in listings.columns else value
    return listings.withColumns(added)


def completeness(pages: DataFrame, keys=SEGMENT) -> DataFrame:
    """Promised against received rows per segment; a segment without any listing is an error."""
    received = F.sum(F.coalesce(F.size("List"), F.lit(0))).cast("bigint")
    return (
        pages.groupBy(*keys)
        .agg(F.max("TotalCount").alias("total_count"), received.alias("n_received"))
        .withColumn("n_pages", pages_needed(F.col("total_count")))
        .withColumn(
            "status",
            F.when(F.coalesce(F.col("total_count"), F.lit(0)) == 0, "no listings")
            .when(F.col("total_count") > F.col("n_received"), "incomplete")
            .otherwise("complete"),
        )
    )

"""The given star schema read as listings: one line item is one listing.

Only the dimensions that the requested columns need are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_YEAR = 2002

# Column -> (dimension it needs beyond the line item, expression).
_COLUMNS = {
    "listing_id": (None, lambda: F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
    "make": ("part", lambda: F.col("p_brand")),
    "model": ("part", lambda: F.col("p_type")),
    "thin_model": ("part", lambda: F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))),
    "title": ("part", lambda: F.concat_ws(" ", "p_brand", "p_type", "p_name")),
    "price_display": (
        None,
        lambda: F.when(F.col("l_discount") == 0, "POA").otherwise(
            F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
        ),
    ),
    "region": ("supplier", lambda: F.col("r_name")),
    "engine_size": ("part", lambda: F.col("p_size") * 100.0),
    "odometer": (None, lambda: F.col("l_quantity") * 4000.0),
    "year": (None, lambda: F.year("l_shipdate")),
    "transmission": (None, lambda: F.col("l_returnflag")),
    "fuel": ("orders", lambda: F.col("o_orderpriority")),
    "cylinders": ("part", lambda: F.col("p_size").cast("double")),
    "exterior_colour": ("part", lambda: F.col("p_name")),
    "stereo_description": (
        "orders",
        lambda: F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")),
    ),
    "is_4wd": (None, lambda: F.col("l_linestatus") == "F"),
    "is_new": (None, lambda: F.when(F.col("l_quantity") == 1, F.lit(True))),
    "is_dealer": ("orders", lambda: F.col("o_orderstatus") == "F"),
    "bid_count": (None, lambda: F.when(F.col("l_tax") == 0, F.col("l_linenumber"))),
    "ship_day": (None, lambda: F.to_date("l_shipdate")),
}
ALL_COLUMNS = tuple(c for c in _COLUMNS if c not in ("thin_model", "ship_day"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_by_few(spark: SparkSession, sf_dir: str) -> bool:
    """Whether line items are read by no more tasks than there are cores; larger tables have more."""
    return table(spark, sf_dir, "lineitem").rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def listings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Listings with the given columns, all of the raw ones by default.

    Joins that move line items come first, while these are numbers alone: orders, then parts with their texts. Places are
    joined table by table, each small by its own size; Spark takes a join of them for their product, and would shuffle.
    Tables read by few tasks are shuffled so, as they are dealt out in any case: models that draw rows by their place, such
    as trees, depend on it.
    """
    columns = columns or ALL_COLUMNS
    needs = {_COLUMNS[c][0] for c in columns}
    out = table(spark, sf_dir, "lineitem")
    if "orders" in needs:
        out = out.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in needs:
        out = out.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "supplier" in needs:
        supplier, nation, region = (table(spark, sf_dir, name) for name in ("supplier", "nation", "region"))
        located, named = F.col("s_nationkey") == F.col("n_nationkey"), F.col("n_regionkey") == F.col("r_regionkey")
        supplied = F.col("l_suppkey") == F.col("s_suppkey")
        if read_by_few(spark, sf_dir):
            out = out.join(supplier.join(nation, located).join(region, named), supplied)
        else:
            out = out.join(supplier, supplied).join(nation, located).join(region, named)
    return out.select(*[_COLUMNS[c][1]().alias(c) for c in columns])


def dealt_out(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """``df``, made of listings, over all cores: a table of few files or row groups would keep later steps in few tasks."""
    return df.hint("rebalance") if read_by_few(spark, sf_dir) else df


# The same reading of the tables as SQL, for the checks.
LISTINGS_SQL = """
listings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing_id,
         p_brand AS make, p_type AS model, concat_ws(' ', p_type, p_size) AS thin_model,
         concat_ws(' ', p_brand, p_type, p_name) AS title,
         CASE WHEN l_discount = 0 THEN 'POA' ELSE '$' || format('{:,.2f}', l_extendedprice) END AS price_display,
         r_name AS region, p_size * 100.0::DOUBLE AS engine_size, l_quantity * 4000.0::DOUBLE AS odometer,
         year(l_shipdate)::INT AS year, l_returnflag AS transmission, o_orderpriority AS fuel,
         p_size::DOUBLE AS cylinders, p_name AS exterior_colour,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS stereo_description,
         l_linestatus = 'F' AS is_4wd, CASE WHEN l_quantity = 1 THEN true END AS is_new,
         o_orderstatus = 'F' AS is_dealer, CASE WHEN l_tax = 0 THEN l_linenumber END AS bid_count,
         l_shipdate::DATE AS ship_day
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       JOIN orders ON l_orderkey = o_orderkey
)"""
# Listings with the price read from its text, before any listing is left out.
PARSED_SQL = LISTINGS_SQL + """,
parsed AS (
  SELECT *, try_cast(replace(nullif(regexp_extract(price_display, '\\$([0-9,]+)', 1), ''), ',', '') AS BIGINT) AS price
  FROM listings
)"""
# Fixed-price listings with a readable price, age and yearly distance.
FEATURES_SQL = PARSED_SQL + f""",
features AS (
  SELECT listing_id, make, model, thin_model, title, price_display, region, engine_size, odometer, year,
         transmission, fuel,
         CASE WHEN cylinders IS NULL THEN 'nan' WHEN cylinders = floor(cylinders) THEN cylinders::BIGINT::VARCHAR
              ELSE cylinders::VARCHAR END AS cylinders,
         exterior_colour, coalesce(stereo_description, 'No stereo') AS stereo_description,
         is_4wd::INT AS is_4wd, coalesce(is_new::INT, 0) AS is_new, is_dealer::INT AS is_dealer, price,
         {AS_OF_YEAR} - year AS age,
         odometer / (CASE WHEN {AS_OF_YEAR} - year < 1 THEN 1 ELSE {AS_OF_YEAR} - year END) AS km_per_year,
         ship_day
  FROM parsed WHERE bid_count IS NULL AND price IS NOT NULL
)"""

"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T

LISTINGS_RAW = T.StructType(
    [
        T.StructField("listing_id", T.StringType(), False),
        T.StructField("make", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("price_display", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("engine_size", T.DoubleType()),
        T.StructField("odometer", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("transmission", T.StringType()),
        T.StructField("fuel", T.StringType()),
        T.StructField("cylinders", T.DoubleType()),
        T.StructField("exterior_colour", T.StringType()),
        T.StructField("stereo_description", T.StringType()),
        T.StructField("is_4wd", T.BooleanType()),
        T.StructField("is_new", T.BooleanType()),
        T.StructField("is_dealer", T.BooleanType()),
        T.StructField("bid_count", T.IntegerType()),
    ]
)

# One record of a landed search page, under the names the feed uses.
PAGE_RECORD = T.StructType(
    [
        T.StructField("ListingId", T.StringType()),
        T.StructField("Title", T.StringType()),
        T.StructField("PriceDisplay", T.StringType()),
        T.StructField("Region", T.StringType()),
        T.StructField("EngineSize", T.DoubleType()),
        T.StructField("Odometer", T.DoubleType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Transmission", T.StringType()),
        T.StructField("Fuel", T.StringType()),
        T.StructField("Cylinders", T.DoubleType()),
        T.StructField("ExteriorColour", T.StringType()),
        T.StructField("StereoDescription", T.StringType()),
        T.StructField("Is4WD", T.BooleanType()),
        T.StructField("IsNew", T.BooleanType()),
        T.StructField("IsDealer", T.BooleanType()),
        T.StructField("BidCount", T.IntegerType()),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("TotalCount", T.LongType()),
        T.StructField("List", T.ArrayType(PAGE_RECORD)),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("make", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("n_training_samples", T.LongType()),
        T.StructField("training_date", T.TimestampType()),
        T.StructField("path", T.StringType()),
        T.StructField("car_types", T.IntegerType()),
    ]
)

EXTRACTED = T.StructType(
    [
        T.StructField("make", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("year", T.StringType()),
        T.StructField("odometer", T.StringType()),
        T.StructField("engine_size_cc", T.StringType()),
        T.StructField("fuel_type", T.StringType()),
        T.StructField("transmission", T.StringType()),
        T.StructField("cylinders", T.StringType()),
        T.StructField("is_4wd", T.StringType()),
        T.StructField("exterior_colour", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("asking_price", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("extraction_notes", T.StringType()),
    ]
)

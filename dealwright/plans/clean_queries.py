"""Queries over cleaning, feature building, selection, joins and splits."""

from pyspark.sql import functions as F

from dealwright.config import SEGMENT, FeatureSettings, FilterRule
from dealwright.operators import clean, filters, sampling
from dealwright.plans.base import THIN_SQL, features
from dealwright.plans.catalog import query
from dealwright.session import materialise
from dealwright.sources.listings import AS_OF_YEAR, FEATURES_SQL, LISTINGS_SQL, PARSED_SQL, listings, table

BASE_URL = "https://listings.example/a/"


@query("price_parse", f"WITH {PARSED_SQL} SELECT listing_id, price_display, price FROM parsed")
def price_parse(spark, sf_dir):
    return clean.parse_prices(listings(spark, sf_dir, "listing_id", "price_display"))


@query(
    "price_quarantine",
    f"""WITH {PARSED_SQL}
    SELECT listing_id, make, model, 'price not readable' AS reason, price_display AS payload
    FROM parsed WHERE price IS NULL""",
)
def price_quarantine(spark, sf_dir):
    return clean.unpriced(clean.parse_prices(listings(spark, sf_dir, "listing_id", "make", "model", "price_display")))


@query(
    "project_features",
    f"""WITH {PARSED_SQL}
    SELECT listing_id, make, model, region, engine_size, odometer, year, transmission, fuel, cylinders,
           exterior_colour, stereo_description, is_4wd, is_new, is_dealer, price FROM parsed""",
)
def project_features(spark, sf_dir):
    return clean.project_features(clean.parse_prices(listings(spark, sf_dir)), FeatureSettings().columns)


@query(
    "fill_text_defaults",
    f"""WITH {LISTINGS_SQL}
    SELECT listing_id, coalesce(exterior_colour, 'No colour') AS exterior_colour,
           coalesce(stereo_description, 'No stereo') AS stereo_description FROM listings""",
)
def fill_text_defaults(spark, sf_dir):
    return clean.fill_text_defaults(listings(spark, sf_dir, "listing_id", "exterior_colour", "stereo_description"))


@query(
    "derive_age_km",
    f"""WITH {LISTINGS_SQL}
    SELECT listing_id, year, odometer, 2001 - year AS age,
           odometer / CASE WHEN 2001 - year < 1 THEN 1 ELSE 2001 - year END AS km_per_year FROM listings""",
)
def derive_age_km(spark, sf_dir):
    return clean.derive_age_km(listings(spark, sf_dir, "listing_id", "year", "odometer"), 2001)


@query(
    "coerce_flags",
    f"""WITH {LISTINGS_SQL}
    SELECT listing_id, is_4wd::INT AS is_4wd, coalesce(is_new::INT, 0) AS is_new, is_dealer::INT AS is_dealer
    FROM listings""",
)
def coerce_flags(spark, sf_dir):
    return clean.coerce_flags(listings(spark, sf_dir, "listing_id", "is_4wd", "is_new", "is_dealer"))


@query(
    "coerce_categoricals",
    f"""WITH {LISTINGS_SQL}
    SELECT listing_id, coalesce(region, 'nan') AS region, coalesce(fuel, 'nan') AS fuel,
           coalesce(transmission, 'nan') AS transmission,
           coalesce(CASE WHEN cylinders = floor(cylinders) THEN cylinders::BIGINT::VARCHAR
                         ELSE cylinders::VARCHAR END, 'nan') AS cylinders FROM listings""",
)
def coerce_categoricals(spark, sf_dir):
    return clean.coerce_categoricals(
        listings(spark, sf_dir, "listing_id", "region", "fuel", "transmission", "cylinders")
    )


ENGINEERED_SQL = """
    SELECT listing_id, make, model, region, engine_size, odometer, year, transmission, fuel, cylinders, is_4wd,
           is_new, is_dealer, price, 'Unknown' AS colour_label, 'Unknown' AS stereo_label, age, km_per_year"""


@query(
    "feature_engineering",
    f"""WITH {PARSED_SQL}
    SELECT listing_id, make, model, coalesce(region, 'nan') AS region, engine_size, odometer, year,
           coalesce(transmission, 'nan') AS transmission, coalesce(fuel, 'nan') AS fuel,
           cylinders::BIGINT::VARCHAR AS cylinders, is_4wd::INT AS is_4wd, coalesce(is_new::INT, 0) AS is_new,
           is_dealer::INT AS is_dealer, price, 'Unknown' AS colour_label, 'Unknown' AS stereo_label,
           {AS_OF_YEAR} - year AS age,
           odometer / CASE WHEN {AS_OF_YEAR} - year < 1 THEN 1 ELSE {AS_OF_YEAR} - year END AS km_per_year
    FROM parsed WHERE price IS NOT NULL""",
)
def feature_engineering(spark, sf_dir):
    return clean.feature_engineering(listings(spark, sf_dir), FeatureSettings(as_of_year=AS_OF_YEAR))


@query("processed_listings", f"WITH {FEATURES_SQL} {ENGINEERED_SQL} FROM features")
def processed_listings(spark, sf_dir):
    fixed_price = filters.filter_non_auction(listings(spark, sf_dir))
    return clean.feature_engineering(fixed_price, FeatureSettings(as_of_year=AS_OF_YEAR))


@query(
    "filter_non_auction",
    f"WITH {LISTINGS_SQL} SELECT listing_id, price_display FROM listings WHERE bid_count IS NULL",
)
def filter_non_auction(spark, sf_dir):
    return filters.filter_non_auction(listings(spark, sf_dir, "listing_id", "price_display", "bid_count")).drop(
        "bid_count"
    )


@query(
    "min_rows_gate",
    f"""WITH {THIN_SQL},
    large AS (SELECT make, model FROM thin GROUP BY ALL HAVING count(*) >= 20)
    SELECT listing_id, make, model, price FROM thin SEMI JOIN large USING (make, model)""",
)
def min_rows_gate(spark, sf_dir):
    return filters.min_rows_gate(features(spark, sf_dir, "listing_id", "make", "model", "price", thin=True), 20)


@query(
    "apply_filters",
    f"""WITH {LISTINGS_SQL}
    SELECT listing_id, region, odometer, year, stereo_description FROM listings
    WHERE odometer <= 160000 AND region = 'ASIA' AND year > 1996
      AND stereo_description IS DISTINCT FROM '5-LOW'""",
)
def apply_filters(spark, sf_dir):
    rules = [
        FilterRule("odometer", "<=", 160000, "Lower mileage only"),
        FilterRule("region", "==", "ASIA", "Specific region"),
        FilterRule("year", ">", 1996),
        FilterRule("stereo_description", "!=", "5-LOW"),
        FilterRule("not_there", "==", 1),
        FilterRule("year", "<", None),
        None,
    ]
    df = listings(spark, sf_dir, "listing_id", "region", "odometer", "year", "stereo_description")
    return filters.apply_filters(df, rules)


@query(
    "select_listing",
    f"""WITH {LISTINGS_SQL}
    SELECT make, model, (listing_id = (SELECT min(listing_id) FROM listings))::INT AS chosen, count(*) AS n
    FROM listings GROUP BY ALL""",
)
def select_listing(spark, sf_dir):
    df = listings(spark, sf_dir, "listing_id", "make", "model")
    wanted = df.agg(F.min("listing_id")).first()[0]
    one, rest = filters.select_listing(df, wanted)
    both = one.withColumn("chosen", F.lit(1)).unionByName(rest.withColumn("chosen", F.lit(0)))
    return both.groupBy(*SEGMENT, "chosen").agg(F.count(F.lit(1)).alias("n"))


@query(
    "range_filters",
    f"""WITH {FEATURES_SQL}
    SELECT listing_id, odometer, age, price FROM features
    WHERE odometer BETWEEN 20000 AND 120000 AND age BETWEEN 2 AND 5
      AND price BETWEEN (SELECT min(price) FROM features) AND (SELECT max(price) FROM features)""",
)
def range_filters(spark, sf_dir):
    df = features(spark, sf_dir, "listing_id", "odometer", "age", "price")
    ranges = filters.whole_ranges(df, ["price"])
    return filters.range_filters(df, {"odometer": (20000, 120000), "age": (2, 5), **ranges})


@query("listing_url", f"WITH {LISTINGS_SQL} SELECT listing_id, '{BASE_URL}' || listing_id AS url FROM listings")
def listing_url(spark, sf_dir):
    return filters.listing_url(listings(spark, sf_dir, "listing_id"), BASE_URL)


@query(
    "build_data_point",
    f"""WITH {LISTINGS_SQL}
    SELECT listing_id AS spec_id, region, engine_size, odometer, year, transmission, fuel,
           cylinders::BIGINT::VARCHAR AS cylinders, is_4wd::INT AS is_4wd, 0 AS is_new, 0 AS is_dealer,
           {AS_OF_YEAR} - year AS age,
           odometer / CASE WHEN {AS_OF_YEAR} - year < 1 THEN 1 ELSE {AS_OF_YEAR} - year END AS km_per_year
    FROM listings""",
)
def build_data_point(spark, sf_dir):
    specs = listings(
        spark, sf_dir, "listing_id", "region", "engine_size", "odometer", "year", "transmission", "fuel",
        "cylinders", "is_4wd",
    ).withColumnRenamed("listing_id", "spec_id")
    return clean.build_data_points(specs, AS_OF_YEAR)


@query(
    "attach_listing_info",
    f"""WITH {FEATURES_SQL}
    SELECT f.listing_id, f.price, l.title, l.price_display, l.region AS orig_region
    FROM features f LEFT JOIN listings l USING (listing_id)""",
)
def attach_listing_info(spark, sf_dir):
    info = listings(spark, sf_dir, "listing_id", "title", "price_display", "region")
    return filters.attach_listing_info(features(spark, sf_dir, "listing_id", "price"), info)


@query(
    "attach_by_row",
    f"""WITH {FEATURES_SQL}
    SELECT f.listing_id, f.price, l.odometer FROM features f JOIN listings l USING (listing_id)""",
)
def attach_by_row(spark, sf_dir):
    return features(spark, sf_dir, "listing_id", "price").join(
        listings(spark, sf_dir, "listing_id", "odometer"), "listing_id"
    )


@query(
    "union_segments",
    f"""WITH {PARSED_SQL}
    SELECT make, model, listing_id, price, CASE WHEN bid_count IS NULL THEN odometer END AS odometer, bid_count
    FROM parsed""",
)
def union_segments(spark, sf_dir):
    df = clean.parse_prices(listings(spark, sf_dir, "make", "model", "listing_id", "price_display", "odometer", "bid_count"))
    df = df.drop("price_display")
    fixed = df.where(F.col("bid_count").isNull()).drop("bid_count")
    auctions = df.where(F.col("bid_count").isNotNull()).drop("odometer")
    return sampling.union_parts(fixed, auctions)


SPLIT_SQL = FEATURES_SQL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY make, model ORDER BY md5('42|' || listing_id), listing_id) AS pos,
         count(*) OVER (PARTITION BY make, model) AS n_segment FROM features
),
split AS (SELECT *, pos <= round_even(0.4 * n_segment, 0) AS is_oos FROM ranked)"""


@query("oos_split", f"WITH {SPLIT_SQL} SELECT make, model, listing_id, is_oos FROM split")
def oos_split(spark, sf_dir):
    return sampling.oos_split(materialise(features(spark, sf_dir, "make", "model", "listing_id")))


@query(
    "oos_split_by_threshold",
    f"""WITH {FEATURES_SQL}
    SELECT listing_id, ('0x' || substr(md5('42|' || listing_id), 1, 8))::BIGINT < 1717986918 AS is_oos FROM features""",
)
def oos_split_by_threshold(spark, sf_dir):
    return sampling.oos_split_by_threshold(features(spark, sf_dir, "listing_id"))


@query("anti_split", f"WITH {SPLIT_SQL} SELECT make, model, listing_id FROM split WHERE NOT is_oos")
def anti_split(spark, sf_dir):
    df = materialise(features(spark, sf_dir, "make", "model", "listing_id"))
    return sampling.oos_split(df).where("NOT is_oos").drop("is_oos")


@query(
    "union_train_oos",
    f"""WITH {SPLIT_SQL}
    SELECT listing_id, CASE WHEN listing_id = (SELECT min(listing_id) FROM features) THEN 'held out'
                            WHEN is_oos THEN 'oos' ELSE 'train' END AS part
    FROM (
      SELECT listing_id,
             row_number() OVER (PARTITION BY make, model ORDER BY md5('42|' || listing_id), listing_id)
             <= round_even(0.4 * count(*) OVER (PARTITION BY make, model), 0) AS is_oos
      FROM features WHERE listing_id <> (SELECT min(listing_id) FROM features)
      UNION ALL SELECT min(listing_id), false FROM features)""",
)
def union_train_oos(spark, sf_dir):
    df = materialise(features(spark, sf_dir, "make", "model", "listing_id"))
    held, rest = filters.select_listing(df, df.agg(F.min("listing_id")).first()[0])
    flagged = sampling.oos_split(rest)
    parts = [
        flagged.where("NOT is_oos").withColumn("part", F.lit("train")),
        flagged.where("is_oos").withColumn("part", F.lit("oos")),
        held.withColumn("part", F.lit("held out")),
    ]
    return sampling.union_parts(*parts).select("listing_id", "part")


@query(
    "display_projection",
    f"""WITH {FEATURES_SQL},
    estimates AS (SELECT make, model, floor(avg(price)) + 0.25 AS e FROM features GROUP BY ALL)
    SELECT make AS "Make", model AS "Model", title AS "Title", '$' || format('{{:,}}', price) AS price,
           '$' || format('{{:,}}', floor(e)::BIGINT) AS "Est. Value", printf('%.1f%%', (e - price) / e * 100) AS "Discount",
           region AS "Region", listing_id AS "ListingId"
    FROM features JOIN estimates USING (make, model)""",
)
def display_projection(spark, sf_dir):
    df = features(spark, sf_dir, "make", "model", "title", "price", "region", "listing_id")
    mean = df.groupBy(*SEGMENT).agg((F.floor(F.avg("price")) + 0.25).cast("double").alias("prediction_label"))
    from dealwright.operators.deals import add_discount

    return filters.display_projection(add_discount(df.join(mean, list(SEGMENT))))

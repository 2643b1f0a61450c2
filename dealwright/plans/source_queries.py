"""Queries over ingest, the stored table, the registry and the catalog."""

from pyspark.sql import functions as F

from dealwright.config import SEGMENT
from dealwright.operators import filters
from dealwright.operators.joins import with_group_values
from dealwright.plans.base import THIN_SQL, features
from dealwright.plans.catalog import query
from dealwright.session import fresh_path
from dealwright.sources import pages, registry, tables
from dealwright.sources.listings import LISTINGS_SQL, listings, table


SHORT, NONE = "STANDARD", "NOTHING"


def landed_pages(spark, sf_dir):
    """The page files of one search per segment, landed in the shared folder and read back as any such files.

    Pages of about 500 listings, a file each. The first page of a segment has a column that the others lack; one model
    states a listing more than its pages hold, and one search found nothing.
    """
    records = listings(
        spark, sf_dir, "listing_id", "make", "model", "title", "price_display", "odometer", "year", "bid_count"
    )
    names = {"listing_id": "ListingId", "title": "Title", "price_display": "PriceDisplay", "odometer": "Odometer",
             "year": "Year", "bid_count": "BidCount"}
    record = F.struct(*[F.col(c).alias(n) for c, n in names.items()])
    totals = records.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("TotalCount"))
    page = F.pmod(F.xxhash64("listing_id"), F.ceil(F.col("TotalCount") / pages.ROWS_PER_PAGE))
    found = (
        with_group_values(records, totals, SEGMENT, "inner")
        .groupBy(*SEGMENT, "TotalCount", page.alias("number"))
        .agg(F.collect_list(record).alias("List"))
    )
    total = (F.col("TotalCount") + F.when(F.col("model") == SHORT, 1).otherwise(0)).alias("TotalCount")
    more = F.transform("List", lambda r: r.withField("Shipping", F.lit("pick up")))
    text = F.when(F.col("number") == 0, F.to_json(F.struct(total, more.alias("List")))).otherwise(F.to_json(F.struct(total, "List")))
    empty = spark.range(1).select(F.lit("Brand#0").alias("make"), F.lit(NONE).alias("model"), F.lit('{"TotalCount": 0, "List": []}').alias("page"))
    path = fresh_path(spark, "pages")
    landed = found.select(*SEGMENT, text.alias("page")).union(empty)
    landed.write.partitionBy(*SEGMENT).option("maxRecordsPerFile", 1).text(path)
    return pages.read_pages(spark, path)


@query(
    "ingest_pages",
    f"""WITH {LISTINGS_SQL}
    SELECT make, model, listing_id, title, price_display, odometer, year, bid_count FROM listings""",
)
def ingest_pages(spark, sf_dir):
    return pages.explode_pages(landed_pages(spark, sf_dir)).select(
        *SEGMENT, "listing_id", "title", "price_display", "odometer", "year", "bid_count"
    )


@query(
    "ingest_completeness",
    f"""WITH {LISTINGS_SQL}
    SELECT make, model, n + (model = '{SHORT}')::INT AS total_count, n AS n_received,
           (n + (model = '{SHORT}')::INT) // 500 + 1 AS n_pages,
           CASE WHEN n = 0 THEN 'no listings' WHEN model = '{SHORT}' THEN 'incomplete' ELSE 'complete' END AS status
    FROM (SELECT make, model, count(*) AS n FROM listings GROUP BY ALL UNION ALL SELECT 'Brand#0', '{NONE}', 0)""",
)
def ingest_completeness(spark, sf_dir):
    return pages.completeness(landed_pages(spark, sf_dir))


@query(
    "scan_segment",
    f"""WITH {LISTINGS_SQL}
    SELECT listing_id, title, price_display, region, odometer, year FROM listings
    WHERE make = 'Brand#7' AND model = 'STANDARD'""",
)
def scan_segment(spark, sf_dir):
    df = listings(spark, sf_dir, "listing_id", "make", "model", "title", "price_display", "region", "odometer", "year")
    return tables.scan_segment(df, "Brand#7", "STANDARD").drop(*SEGMENT)


@query(
    "scan_all_segments",
    f"""WITH {LISTINGS_SQL}
    SELECT make || '_' || model || '_data.json' AS file_name, make, model, count(*) AS n FROM listings GROUP BY ALL""",
)
def scan_all_segments(spark, sf_dir):
    """Segments by the names of what is stored: a folder for each, and one whose name is none of a segment."""
    suffix, path = "_data.json", fresh_path(spark, "named")
    named = listings(spark, sf_dir, "listing_id", "make", "model").select(
        F.concat(F.concat_ws("_", *SEGMENT), F.lit(suffix)).alias("file_name"), "listing_id"
    )
    stray = named.limit(1).withColumn("file_name", F.lit("notes.txt"))
    named.union(stray).write.partitionBy("file_name").parquet(path)
    files = tables.scan_all_segments(spark, path).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    return tables.segments_of_names(files, "file_name", suffix)


@query(
    "sink_segment",
    f"""WITH {LISTINGS_SQL}
    SELECT make, model, count(*) AS n, sum(odometer) AS km, count(bid_count) AS n_auctions
    FROM listings GROUP BY make, model""",
)
def sink_segment(spark, sf_dir):
    path = fresh_path(spark, "listings")
    tables.sink_segments(listings(spark, sf_dir, "listing_id", "make", "model", "odometer", "bid_count"), path)
    return (
        tables.scan_all_segments(spark, path)
        .groupBy(*SEGMENT)
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("odometer").alias("km"), F.count("bid_count").alias("n_auctions")
        )
    )


@query(
    "sink_segment_again",
    f"""WITH {LISTINGS_SQL},
    stored AS (SELECT make, model, listing_id, odometer + (make = 'Brand#7' AND model = 'STANDARD')::INT AS odometer FROM listings
               WHERE NOT (make = 'Brand#7' AND model = 'STANDARD' AND odometer = 4000))
    SELECT make, model, count(*) AS n, sum(odometer) AS km FROM stored GROUP BY ALL""",
)
def sink_segment_again(spark, sf_dir):
    """One segment fetched and saved again, with other distances and without some listings: the others stay."""
    path = fresh_path(spark, "listings")
    df = listings(spark, sf_dir, "listing_id", "make", "model", "odometer")
    tables.sink_segments(df, path)
    again = tables.scan_segment(df, "Brand#7", "STANDARD").where("odometer <> 4000").withColumn("odometer", F.col("odometer") + 1)
    for _ in range(2):  # a job that is run again changes nothing
        tables.sink_segments(again, path)
    return tables.scan_all_segments(spark, path).groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("n"), F.sum("odometer").alias("km")
    )


def changing_pages(spark, sf_dir):
    """Landed pages whose records differ: those of 1998 have a field that the schema does not name, and the year of those
    with the shortest distance is a word."""
    records = listings(spark, sf_dir, "listing_id", "make", "model", "title", "odometer", "year").withColumn(
        "page", F.substring(F.md5("listing_id"), 1, 1)
    )
    plain = F.to_json(F.struct(F.col("listing_id").alias("ListingId"), F.col("title").alias("Title"), F.col("odometer").alias("Odometer")))
    year = F.when(F.col("odometer") == 4000, F.lit('"unread"')).otherwise(F.col("year").cast("string"))
    more = F.when(F.col("year") == 1998, F.lit(',"Shipping":{"way":"pick up","days":3}')).otherwise(F.lit(""))
    text = F.concat(F.expr("substring({0}, 1, length({0}) - 1)".format("plain")), F.lit(',"Year":'), year, more, F.lit("}"))
    rows = records.withColumn("plain", plain).select(*SEGMENT, "page", text.alias("record"))
    found = rows.groupBy(*SEGMENT, "page").agg(
        F.concat(F.lit('{"TotalCount":1,"List":['), F.concat_ws(",", F.collect_list("record")), F.lit("]}")).alias("value")
    )
    path = fresh_path(spark, "changing")
    found.select(*SEGMENT, "value").write.partitionBy(*SEGMENT).option("maxRecordsPerFile", 1).text(path)
    return pages.explode_variant_pages(pages.read_variant_pages(spark, path))


@query(
    "ingest_changing_pages",
    f"""WITH {LISTINGS_SQL}
    SELECT make, model, listing_id, title, odometer, year, CASE WHEN year = 1998 THEN 'pick up' END AS shipping_way,
           CASE WHEN year = 1998 THEN 3 END AS shipping_days FROM listings WHERE odometer <> 4000""",
)
def ingest_changing_pages(spark, sf_dir):
    """Listings stored with what the schema does not name, and read again with that field typed."""
    path = fresh_path(spark, "changing-listings")
    tables.sink_segments(changing_pages(spark, sf_dir)[0], path)
    read = pages.with_extra(tables.scan_all_segments(spark, path), {"Shipping": "struct<way:string,days:int>"})
    return read.select(
        *SEGMENT, "listing_id", "title", "odometer", "year", F.col("shipping.way").alias("shipping_way"),
        F.col("shipping.days").alias("shipping_days"),
    )


@query(
    "ingest_quarantine",
    f"""WITH {LISTINGS_SQL}
    SELECT make, model, listing_id, 'Year is no int' AS reason FROM listings WHERE odometer = 4000""",
)
def ingest_quarantine(spark, sf_dir):
    bad = changing_pages(spark, sf_dir)[1]
    return bad.select(*SEGMENT, F.get_json_object("payload", "$.ListingId").alias("listing_id"), "reason")


@query(
    "load_combined_column",
    f"""WITH {LISTINGS_SQL}
    SELECT coalesce(stereo_description, 'No stereo') AS value, count(*) AS n FROM listings GROUP BY ALL""",
)
def load_combined_column(spark, sf_dir):
    df = listings(spark, sf_dir, "stereo_description")
    combined = tables.load_combined_column(df, "stereo_description", "No stereo")
    return combined.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def training_runs(spark, sf_dir):
    """Registry entries of two training runs: segments of 20 or more rows, dated by their newest listing."""
    rows = features(spark, sf_dir, "make", "model", "ship_day", thin=True)
    sizes = (
        rows.groupBy(*SEGMENT)
        .agg(F.count(F.lit(1)).alias("n"), F.min("ship_day").alias("first"), F.max("ship_day").alias("last"))
        .where("n >= 20")
    )
    early = registry.segment_entries(sizes.withColumn("n", F.floor(F.col("n") / 2)), "specific", F.col("first"), "models")
    late = registry.segment_entries(sizes, "specific", F.col("last"), "models")
    return early.unionByName(late)


RUNS_SQL = THIN_SQL + """,
sizes AS (SELECT make, model, count(*) AS n, min(ship_day) AS first, max(ship_day) AS last FROM thin GROUP BY ALL
          HAVING count(*) >= 20),
catalog AS (SELECT make, model FROM sizes)"""


@query(
    "registry_write",
    f"""WITH {RUNS_SQL}
    SELECT make, model, n AS n_training_samples, strftime(last, '%Y-%m-%d') AS training_day,
           'models/' || make || '_' || model AS path FROM sizes""",
)
def registry_write(spark, sf_dir):
    path = fresh_path(spark, "registry")
    registry.registry_write(training_runs(spark, sf_dir), path)
    return registry.latest(registry.registry_read(spark, path)).select(
        *SEGMENT, "n_training_samples", F.date_format("training_date", "yyyy-MM-dd").alias("training_day"), "path"
    )


@query(
    "registry_read",
    f"""WITH {RUNS_SQL}
    SELECT NULL AS make, NULL AS model, 'general' AS kind, sum(n)::BIGINT AS n_training_samples, count(*)::INT AS car_types
    FROM sizes
    UNION ALL SELECT make, model, 'general_part', n, NULL FROM sizes""",
)
def registry_read(spark, sf_dir):
    sizes = registry.latest(training_runs(spark, sf_dir)).withColumnRenamed("n_training_samples", "n")
    path = fresh_path(spark, "registry")
    registry.registry_write(registry.general_entries(sizes, F.current_timestamp(), "models/general"), path)
    return registry.registry_read(spark, path).select(*SEGMENT, "kind", "n_training_samples", "car_types")


@query(
    "catalog_available",
    f"""WITH {RUNS_SQL}
    SELECT make, string_agg(model, ';' ORDER BY model) AS models FROM catalog GROUP BY make""",
)
def catalog_available(spark, sf_dir):
    data = listings(spark, sf_dir, "make", "thin_model").withColumnRenamed("thin_model", "model")
    available = registry.catalog_available(data, training_runs(spark, sf_dir))
    return available.select("make", F.array_join("models", ";").alias("models"))


@query("catalog_models", f"WITH {RUNS_SQL} SELECT make, model FROM catalog")
def catalog_models(spark, sf_dir):
    return registry.catalog_models(training_runs(spark, sf_dir)).orderBy(*SEGMENT)


@query(
    "intersect_catalog",
    f"""WITH {RUNS_SQL}
    SELECT make, thin_model AS model FROM listings INTERSECT SELECT make, model FROM catalog""",
)
def intersect_catalog(spark, sf_dir):
    data = listings(spark, sf_dir, "make", "thin_model").withColumnRenamed("thin_model", "model")
    return data.intersect(registry.catalog_models(training_runs(spark, sf_dir)))


@query(
    "missing_segments",
    f"""WITH {RUNS_SQL},
    requested AS (SELECT DISTINCT p_brand AS make, concat_ws(' ', p_type, p_size) AS model FROM part),
    data AS (SELECT DISTINCT make, thin_model AS model FROM listings)
    SELECT r.make, r.model, d.make IS NULL AS needs_fetch, c.make IS NULL AS needs_training
    FROM requested r LEFT JOIN data d USING (make, model) LEFT JOIN catalog c USING (make, model)
    WHERE d.make IS NULL OR c.make IS NULL""",
)
def missing_segments(spark, sf_dir):
    requested = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("make"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("model")
    )
    data = listings(spark, sf_dir, "make", "thin_model").withColumnRenamed("thin_model", "model")
    return registry.missing_segments(requested, data, training_runs(spark, sf_dir))


@query(
    "segment_lookup_ci",
    f"""WITH {RUNS_SQL},
    requested AS (SELECT DISTINCT upper(p_brand) AS make, lower(concat_ws(' ', p_type, p_size)) AS model FROM part)
    SELECT r.make, r.model, c.make AS known_make, c.model AS known_model,
           c.make IS NOT NULL AS specific_model_exists
    FROM requested r LEFT JOIN catalog c ON lower(r.make) = lower(c.make) AND lower(r.model) = lower(c.model)""",
)
def segment_lookup_ci(spark, sf_dir):
    requested = (
        table(spark, sf_dir, "part")
        .select(
            F.upper("p_brand").alias("make"),
            F.lower(F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))).alias("model"),
        )
        .distinct()
    )
    return registry.segment_lookup_ci(requested, registry.catalog_models(training_runs(spark, sf_dir)))


@query(
    "sample_counts",
    f"""WITH {THIN_SQL},
    gated AS (SELECT make, model FROM thin GROUP BY ALL HAVING count(*) >= 10)
    SELECT make, model, count(*) AS n FROM thin SEMI JOIN gated USING (make, model) GROUP BY ROLLUP (make, model)""",
)
def sample_counts(spark, sf_dir):
    from dealwright.operators.market import sample_counts as count_samples

    rows = features(spark, sf_dir, "make", "model", thin=True)
    return count_samples(filters.min_rows_gate(rows, 10))

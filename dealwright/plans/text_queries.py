"""Queries over text: field repair, extraction, matching, labels."""

from pyspark.sql import functions as F

from dealwright.config import SEGMENT, FeatureSettings
from dealwright.functions import parsing, scoring
from dealwright.operators import clean, density, extract, filters, labels, match, outliers
from dealwright.plans.base import THIN_SQL, features
from dealwright.plans.catalog import query
from dealwright.session import SMALL, materialise
from dealwright.sources.listings import AS_OF_YEAR, LISTINGS_SQL, dealt_out, listings, table

# Texts as a feed might hold them, written in SQL both engines read.
FUEL_TEXT = """CASE fuel WHEN '1-URGENT' THEN ' Diesel' WHEN '2-HIGH' THEN 'EV ' WHEN '3-MEDIUM' THEN 'phev'
               WHEN '5-LOW' THEN 'gas' END"""
GEAR_TEXT = "CASE transmission WHEN 'A' THEN '5 speed MANUAL' WHEN 'N' THEN ' mt ' WHEN 'R' THEN 'cvt' END"
ENGINE_TEXT = """CASE transmission WHEN 'A' THEN concat(engine_size / 1000, 'L')
                 WHEN 'N' THEN concat(CAST(engine_size AS BIGINT), 'cc') ELSE concat(engine_size / 1000, ' l') END"""
SPEC_ENGINE = """CASE transmission WHEN 'A' THEN concat(engine_size / 1000, 'L')
                 WHEN 'N' THEN concat(CAST(engine_size AS BIGINT), 'CC') ELSE concat(CAST(engine_size AS BIGINT), '') END"""
DISTANCE_TEXT = """CASE transmission WHEN 'A' THEN concat(CAST(odometer AS BIGINT), ' km')
                   WHEN 'N' THEN concat(CAST(odometer / 1000 AS BIGINT), ',000') ELSE 'unknown' END"""
AD_TEXT = f"""concat_ws(' ', CASE transmission WHEN 'A' THEN concat('asking ', price_display, ' or $2001 cash for my')
                              WHEN 'N' THEN '2002 cc engine,' END,
    CASE WHEN is_dealer AND is_4wd THEN concat(year, ' model') WHEN is_dealer THEN concat(substr(CAST(year AS VARCHAR(4)), 3, 2), ' model')
         ELSE CAST(year AS VARCHAR(4)) END,
    make, model, exterior_colour,
    CASE transmission WHEN 'R' THEN concat(CAST(odometer / 1.6 AS BIGINT), ' miles')
                      WHEN 'N' THEN concat(CAST(odometer / 1000 AS BIGINT), CASE WHEN is_dealer THEN 'k km' ELSE ',000km' END)
                      ELSE concat(CAST(odometer AS BIGINT), ' kms') END,
    CASE WHEN is_4wd THEN concat(engine_size / 1000, 'L 4WD') ELSE concat(CAST(engine_size AS BIGINT), 'cc') END,
    {FUEL_TEXT}, {GEAR_TEXT}, concat(CAST(cylinders AS BIGINT), ' cyl'), 'located in', region,
    CASE WHEN transmission <> 'A' THEN concat('asking ', price_display) END)"""


def rx(pattern: str, text: str = "t") -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', 1), '')"


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def sql_double(text: str) -> str:
    return f"CASE WHEN regexp_matches(trim({text}), '{NUMBER}') THEN try_cast(trim({text}) AS DOUBLE) END"


def sql_fuel(text: str) -> str:
    return f"""CASE lower(trim({text})) WHEN 'diesel' THEN 'Diesel' WHEN 'electric' THEN 'Electric'
               WHEN 'ev' THEN 'Electric' WHEN 'hybrid' THEN 'Hybrid' WHEN 'phev' THEN 'Hybrid' ELSE 'Petrol' END"""


# --- Field repair -------------------------------------------------------------------------------------------


@query(
    "fix_numbers",
    f"""WITH {LISTINGS_SQL}
    SELECT listing_id, price_display AS raw,
           try_cast(trunc({sql_double("regexp_replace(price_display, '[$,\\s]', '', 'g')")}) AS BIGINT) AS value
    FROM listings""",
)
def fix_numbers(spark, sf_dir):
    df = listings(spark, sf_dir, "listing_id", "price_display").withColumnRenamed("price_display", "raw")
    return df.withColumn("value", parsing.loose_int(F.col("raw")))


@query(
    "fix_engine_litres",
    f"""WITH {LISTINGS_SQL}, raws AS (SELECT listing_id, {ENGINE_TEXT} AS raw FROM listings)
    SELECT listing_id, raw, trunc(try_cast({rx("([0-9]+[.]?[0-9]*)[ ]*[lL]", "raw")} AS DOUBLE) * 1000)::BIGINT AS value
    FROM raws""",
)
def fix_engine_litres(spark, sf_dir):
    df = listings(spark, sf_dir, "listing_id", "engine_size", "transmission")
    df = df.select("listing_id", F.expr(ENGINE_TEXT).alias("raw"))
    return df.withColumn("value", parsing.litres_to_cc(F.col("raw")))


BOOL_TEXT = "CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'no' WHEN 'P' THEN '1' END"


@query(
    "fix_bool",
    f"""SELECT o_orderkey, {BOOL_TEXT} AS raw, lower({BOOL_TEXT}) IN ('true', 'yes', '1') AS value FROM orders""",
)
def fix_bool(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(BOOL_TEXT).alias("raw"))
    return df.withColumn("value", parsing.flag(F.col("raw")))


@query(
    "normalize_fuel",
    f"WITH {LISTINGS_SQL}, raws AS (SELECT listing_id, {FUEL_TEXT} AS raw FROM listings) "
    f"SELECT listing_id, raw, {sql_fuel('raw')} AS fuel FROM raws",
)
def normalize_fuel(spark, sf_dir):
    df = listings(spark, sf_dir, "listing_id", "fuel").select("listing_id", F.expr(FUEL_TEXT).alias("raw"))
    return df.withColumn("fuel", parsing.fuel(F.col("raw")))


@query(
    "normalize_transmission",
    f"""WITH {LISTINGS_SQL}, raws AS (SELECT listing_id, {GEAR_TEXT} AS raw FROM listings)
    SELECT listing_id, raw, CASE WHEN contains(lower(raw), 'manual') OR trim(lower(raw)) = 'mt' THEN 'Manual'
                                 ELSE 'Automatic' END AS transmission FROM raws""",
)
def normalize_transmission(spark, sf_dir):
    df = listings(spark, sf_dir, "listing_id", "transmission").select("listing_id", F.expr(GEAR_TEXT).alias("raw"))
    return df.withColumn("transmission", parsing.transmission(F.col("raw")))


@query(
    "strip_strings",
    "SELECT p_partkey, trim(concat('  ', p_brand, ' ')) AS make, trim(concat(p_name, '   ')) AS model FROM part",
)
def strip_strings(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(
        "p_partkey", F.expr("concat('  ', p_brand, ' ')").alias("make"), F.expr("concat(p_name, '   ')").alias("model")
    )
    return raw.withColumns({c: F.trim(c) for c in ("make", "model")})


@query(
    "parse_units",
    f"""WITH {LISTINGS_SQL},
    raws AS (SELECT listing_id, {SPEC_ENGINE} AS engine_raw, {DISTANCE_TEXT} AS distance_raw FROM listings),
    low AS (SELECT *, lower(engine_raw) AS e, lower(distance_raw) AS d FROM raws)
    SELECT listing_id, engine_raw, distance_raw,
           CASE WHEN contains(e, 'l') THEN {sql_double("replace(e, 'l', '')")} * 1000
                WHEN contains(e, 'cc') THEN {sql_double("replace(e, 'cc', '')")} ELSE {sql_double("e")} END AS engine_cc,
           CASE WHEN contains(d, 'km') THEN {sql_double("replace(d, 'km', '')")}
                ELSE {sql_double("replace(d, ',', '')")} END AS distance_km
    FROM low""",
)
def parse_units(spark, sf_dir):
    df = listings(spark, sf_dir, "listing_id", "engine_size", "odometer", "transmission").select(
        "listing_id", F.expr(SPEC_ENGINE).alias("engine_raw"), F.expr(DISTANCE_TEXT).alias("distance_raw")
    )
    return df.withColumns(
        {
            "engine_cc": parsing.engine_cc(F.col("engine_raw")),
            "distance_km": parsing.number_with_units(F.col("distance_raw"), [("km", 1)]),
        }
    )


# --- Extraction ---------------------------------------------------------------------------------------------

ARGUMENTS = f"""concat('{{"make": " ', make, '", "model": "', model, '", "year": ', year, ', "odometer": "',
    CAST(odometer AS BIGINT), '", "engine_size_cc": "', {ENGINE_TEXT}, '", "fuel_type": "', coalesce({FUEL_TEXT}, ''),
    '", "transmission": "', {GEAR_TEXT}, '", "is_4wd": "', CASE WHEN is_4wd THEN 'yes' ELSE 'no' END,
    '", "asking_price": "', price_display, '"', CASE WHEN is_dealer THEN '' ELSE '}}' END)"""
ARGUMENT_COLUMNS = ("listing_id", "make", "model", "year", "odometer", "engine_size", "fuel", "transmission", "is_4wd",
                    "price_display", "is_dealer")


@query(
    "extract_tool_json",
    f"""WITH {LISTINGS_SQL}, raws AS (SELECT *, {ENGINE_TEXT} AS e, {FUEL_TEXT} AS fu, {GEAR_TEXT} AS g FROM listings)
    SELECT listing_id, make, model, year::BIGINT AS year, odometer::BIGINT AS odometer,
           trunc(try_cast({rx("([0-9]+[.]?[0-9]*)[ ]*[lL]", "e")} AS DOUBLE) * 1000)::BIGINT AS engine_size_cc,
           {sql_fuel("fu")} AS fuel_type,
           CASE WHEN contains(lower(g), 'manual') OR trim(lower(g)) = 'mt' THEN 'Manual' ELSE 'Automatic' END AS transmission,
           is_4wd, 4::BIGINT AS cylinders,
           try_cast(trunc({sql_double("regexp_replace(price_display, '[$,]', '', 'g')")}) AS BIGINT) AS asking_price
    FROM raws WHERE NOT is_dealer""",
)
def extract_tool_json(spark, sf_dir):
    df = listings(spark, sf_dir, *ARGUMENT_COLUMNS).select("listing_id", F.expr(ARGUMENTS).alias("arguments"))
    good, _ = extract.parse_arguments(df, "arguments")
    return extract.fix_fields(good).select(
        "listing_id", "make", "model", "year", "odometer", "engine_size_cc", "fuel_type", "transmission", "is_4wd",
        "cylinders", "asking_price",
    )


@query(
    "extract_tool_json_quarantine",
    f"""WITH {LISTINGS_SQL}
    SELECT listing_id, 'arguments are not JSON' AS reason, {ARGUMENTS} AS payload FROM listings WHERE is_dealer""",
)
def extract_tool_json_quarantine(spark, sf_dir):
    df = listings(spark, sf_dir, *ARGUMENT_COLUMNS).select("listing_id", F.expr(ARGUMENTS).alias("arguments"))
    return extract.parse_arguments(df, "arguments")[1]


PLACES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def fields_sql(source: str) -> str:
    """CTE ``fields`` over a source with the listing text in ``text``."""
    place = " ".join(f"WHEN contains(t, '{p.lower()}') THEN '{p}'" for p in PLACES)
    return f"""
lowered AS (SELECT *, lower(text) AS t, regexp_replace(lower(text), '{extract.AMOUNT}', ' ', 'g') AS no_amounts FROM {source}),
fields AS (
  SELECT * EXCLUDE (t, no_amounts),
    coalesce(try_cast({rx(extract.MODEL_YEAR)} AS INT), 2000 + try_cast({rx(extract.SHORT_YEAR)} AS INT),
             try_cast({rx(extract.YEAR, "no_amounts")} AS INT)) AS f_year,
    coalesce(1000 * try_cast(replace({rx(extract.THOUSAND_KM)}, ',', '') AS BIGINT),
             try_cast(replace({rx(extract.KM)}, ',', '') AS BIGINT),
             trunc(try_cast(replace({rx(extract.MILES)}, ',', '') AS BIGINT) * 1.609::DOUBLE)::BIGINT) AS f_odometer,
    coalesce(trunc(try_cast({rx(extract.LITRES)} AS DOUBLE) * 1000)::BIGINT, try_cast({rx(extract.CC)} AS BIGINT)) AS f_engine,
    {sql_fuel(rx(extract.FUEL))} AS f_fuel,
    CASE WHEN regexp_matches(t, '\\b(manual|mt)\\b') THEN 'Manual' ELSE 'Automatic' END AS f_transmission,
    coalesce(try_cast({rx(extract.CYLINDER)} AS INT), 4) AS f_cylinders,
    regexp_matches(t, '{extract.FOUR_WHEEL}') AS f_4wd,
    CASE WHEN {rx(extract.COLOURS)} IS NULL THEN 'Unknown'
         ELSE upper(substr({rx(extract.COLOURS)}, 1, 1)) || substr({rx(extract.COLOURS)}, 2) END AS f_colour,
    CASE {place} END AS f_region,
    try_cast(replace(nullif(regexp_extract(text, '\\$([0-9,]+)', 1), ''), ',', '') AS BIGINT) AS f_price
  FROM lowered)"""


FIELD_COLUMNS = """f_year AS year, f_odometer AS odometer, f_engine AS engine_size_cc, f_fuel AS fuel_type,
    f_transmission AS transmission, f_cylinders AS cylinders, f_4wd AS is_4wd, f_colour AS exterior_colour,
    f_region AS region, f_price AS asking_price"""
FIELDS = ("year", "odometer", "engine_size_cc", "fuel_type", "transmission", "cylinders", "is_4wd", "exterior_colour",
          "region", "asking_price")
EXTRACT_SQL = f"""{LISTINGS_SQL}, ads AS (SELECT listing_id, {AD_TEXT} AS text FROM listings), {fields_sql("ads")},
known AS (SELECT DISTINCT make, model FROM listings),
named AS (SELECT listing_id, first(make ORDER BY strpos(lower(text), lower(make || ' ' || model))) AS make,
                 first(model ORDER BY strpos(lower(text), lower(make || ' ' || model))) AS model
          FROM ads JOIN known ON contains(' ' || lower(text) || ' ', ' ' || lower(make || ' ' || model) || ' ')
          GROUP BY listing_id),
extracted AS (
  SELECT listing_id, make, model, {FIELD_COLUMNS},
         CASE WHEN make IS NULL OR f_year IS NULL OR f_odometer IS NULL THEN 'low'
              WHEN f_engine IS NULL OR f_price IS NULL OR f_region IS NULL THEN 'medium' ELSE 'high' END AS confidence
  FROM fields LEFT JOIN named USING (listing_id))"""


def extracted(spark, sf_dir):
    rows = listings(spark, sf_dir)
    # dealt out, as patterns are matched over and over against rows that come from a single file
    ads = materialise(dealt_out(spark, sf_dir, rows.select("listing_id", F.expr(AD_TEXT).alias("text"))), SMALL)
    catalog = listings(spark, sf_dir, "make", "model")
    return extract.extract_listings(ads, catalog, "listing_id", regions=PLACES).select(
        "listing_id", "make", "model", *FIELDS, "confidence"
    )


@query("extract_listing", f"WITH {EXTRACT_SQL} SELECT * FROM extracted")
def extract_listing(spark, sf_dir):
    return extracted(spark, sf_dir)


@query(
    "extract_from_documents",
    f"WITH {fields_sql('documents')} SELECT doc_id, {FIELD_COLUMNS} FROM fields",
)
def extract_from_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extract.extract_fields(docs, "text", PLACES).select("doc_id", *FIELDS)


@query(
    "defaults_for_valuation",
    f"""WITH {EXTRACT_SQL},
    filled AS (SELECT listing_id, make, model, CASE WHEN coalesce(year, 0) = 0 THEN 2015 ELSE year END AS year,
             CASE WHEN coalesce(odometer, 0) = 0 THEN 100000 ELSE odometer END AS odometer,
             CASE WHEN coalesce(engine_size_cc, 0) = 0 THEN 1500 ELSE engine_size_cc END AS engine_size_cc,
             CASE WHEN cylinders IN (3, 4, 6, 8, 10, 12) THEN cylinders ELSE 4 END AS cylinders,
             coalesce(region, 'AFRICA') AS region FROM extracted)
    SELECT *, CASE WHEN year NOT BETWEEN 1990 AND 2026 THEN 'year out of range'
                   WHEN engine_size_cc NOT BETWEEN 500 AND 8000 THEN 'engine size out of range' END AS reason
    FROM filled""",
)
def defaults_for_valuation(spark, sf_dir):
    return extract.defaults_for_valuation(extracted(spark, sf_dir), PLACES).select(
        "listing_id", "make", "model", "year", "odometer", "engine_size_cc", "cylinders", "region", "reason"
    )


# --- Matching -----------------------------------------------------------------------------------------------

PRIORITIES = ("Urgent", "High", "Medium", "Not specified", "Low")


@query(
    "fuzzy_match",
    f"""WITH options AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{o}')" for i, o in enumerate(PRIORITIES))}) t(i, o)),
    scored AS (SELECT o_orderkey, o_orderpriority, i, o,
                      round((1 - levenshtein(lower(trim(o_orderpriority)), lower(o))
                             / greatest(length(o_orderpriority), length(o))) * 100, 6) AS s FROM orders, options),
    best AS (SELECT o_orderkey, o_orderpriority, max(s) AS match_score, arg_max(o, s - i * 1e-9) AS o
             FROM scored GROUP BY ALL)
    SELECT o_orderkey, o_orderpriority, match_score, CASE WHEN match_score >= 80 THEN o END AS matched,
           CASE WHEN match_score < 80 THEN 'not recognised' WHEN match_score < 100 THEN 'corrected' END AS match_note
    FROM best""",
)
def fuzzy_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return match.fuzzy_match(orders, "o_orderpriority", PRIORITIES)


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
#: What users type for a type: its words swapped with the brand's, and cut.
SWAPPED = "concat(substr(p_type, 1, 4 + p_size % 5), ' ', lower(p_brand))"
OPTIONS_SQL = ", ".join(f"({i}, 'Brand 1 {o}')" for i, o in enumerate(TYPES))


@query(
    "fuzzy_words",
    f"""WITH options AS (SELECT * FROM (VALUES {OPTIONS_SQL}) t(i, o)),
    typed AS (SELECT DISTINCT {SWAPPED} AS typed FROM part),
    pairs AS (SELECT typed, o, list_sort(string_split(trim(regexp_replace(lower(typed), '[^a-z0-9]+', ' ', 'g')), ' ')) AS a,
                     list_sort(string_split(lower(o), ' ')) AS b FROM typed, options),
    texts AS (SELECT typed, o, array_to_string(a, ' ') AS a, array_to_string(b, ' ') AS b FROM pairs),
    letters AS (SELECT typed, o, a, b, list_transform(string_split(a, ''), lambda c: [ord(c)]) AS x,
                       list_transform(string_split(b, ''), lambda c: ord(c)) AS y FROM texts),
    rows AS (SELECT typed, o, a, b, list_reduce(list_concat([list_transform(range(len(y) + 1), lambda z: 0)], x), lambda last, c:
               list_reduce(list_concat([[0]], list_transform(range(1, len(y) + 1), lambda j: [j::INT])), lambda found, j:
                 list_append(found, CASE WHEN y[j[1]] = c[1] THEN last[j[1]] + 1 ELSE greatest(last[j[1] + 1], found[j[1]]) END))) AS r
             FROM letters)
    SELECT typed, o AS option, round(200.0::DOUBLE * r[-1] / (length(a) + length(b)))::INT AS score FROM rows""",
)
def fuzzy_words(spark, sf_dir):
    """The ratio of sorted words of every typed text with every option."""
    typed = table(spark, sf_dir, "part").select(F.expr(SWAPPED).alias("typed")).distinct()
    rows = typed.select("typed", F.explode(F.array(*(F.lit(f"Brand 1 {o}") for o in TYPES))).alias("option"))
    words = (scoring.in_order(scoring.plain_words(F.col(c))) for c in ("typed", "option"))
    return rows.select("typed", "option", scoring.common_ratio(*words).alias("score"))


@query("fuzzy_match_weighted")
def fuzzy_match_weighted(spark, sf_dir):
    """The type that each text stands for, by the weighted ratio of plain, sorted, shared and partial words."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(SWAPPED).alias("typed"))
    return match.fuzzy_match_weighted(parts, "typed", [f"Brand 1 {o}" for o in TYPES])


TYPED = "concat(replace(p_brand, 'Brand#', 'brnd '), ' ', replace(p_type, 'A', 'E'), ' ', p_size)"


@query(
    "fuzzy_segment",
    f"""WITH {THIN_SQL},
    known AS (SELECT make, model, lower(make || ' ' || model) AS text FROM thin GROUP BY ALL HAVING count(*) >= 20),
    requests AS (SELECT DISTINCT lower({TYPED}) AS q FROM part),
    scored AS (SELECT q, make, model, text, 1 - levenshtein(text, q) / greatest(length(text), length(q)) AS s
               FROM requests, known),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, text DESC) = 1)
    SELECT q AS text, CASE WHEN s >= 0.5 THEN make ELSE (SELECT min(make) FROM known) END AS known_make,
           CASE WHEN s >= 0.5 THEN model ELSE (SELECT min(model) FROM known WHERE make = (SELECT min(make) FROM known)) END
             AS known_model,
           CASE WHEN s >= 0.5 THEN round(s, 6) END AS score FROM best""",
)
def fuzzy_segment(spark, sf_dir):
    return typed_segments(spark, sf_dir, "edit").withColumn("score", F.round("score", 6))


@query("fuzzy_segment_sequence")
def fuzzy_segment_sequence(spark, sf_dir):
    return typed_segments(spark, sf_dir, "sequence")


def typed_segments(spark, sf_dir, similarity):
    known = (
        features(spark, sf_dir, "make", "model", thin=True)
        .groupBy(*SEGMENT)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= 20")
    )
    requests = table(spark, sf_dir, "part").select(F.expr(TYPED).alias("typed"))
    return match.fuzzy_segment(requests, "typed", known, similarity=similarity)


# --- Labels -------------------------------------------------------------------------------------------------

CELLS_SQL = """
RECURSIVE width AS (SELECT greatest(1, round(log2(greatest(1, count(*) / 10.0)) + 1))::INT AS bits FROM embeddings),
planes AS (
  SELECT b, k, list(CASE WHEN substr(md5(b || '|' || k || '|' || d), 1, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0 END
                    ORDER BY d) AS signs
  FROM range(4) t(b), range(30) u(k), range(64) v(d) WHERE k < (SELECT bits FROM width) GROUP BY b, k),
placed AS (
  SELECT vec_id, b, ((b * (1 << (SELECT bits FROM width)))
                     + sum(CASE WHEN list_inner_product(embedding::DOUBLE[], signs) > 0 THEN 1 << k ELSE 0 END))::BIGINT AS cell
  FROM embeddings, planes GROUP BY vec_id, b),
filled AS (SELECT cell FROM placed GROUP BY cell HAVING count(*) >= 10),
members AS (SELECT p.*, e.embedding::DOUBLE[] AS x FROM placed p SEMI JOIN filled USING (cell) JOIN embeddings e USING (vec_id)),
coordinates AS (SELECT cell, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM members),
centres AS (SELECT cell, list(v ORDER BY d) AS centre FROM (SELECT cell, d, avg(v) AS v FROM coordinates GROUP BY ALL) GROUP BY cell),
kept AS (SELECT vec_id, b, cell, round(list_cosine_similarity(x, centre), 9) AS near FROM members JOIN centres USING (cell)
         WHERE round(list_cosine_similarity(x, centre), 9) >= 0.2),
dense AS (SELECT cell, count(*) AS size FROM kept GROUP BY cell HAVING count(*) >= 10),
inside AS (SELECT * FROM kept JOIN dense USING (cell)),
half_links AS (SELECT x.cell AS a, y.cell AS c FROM inside x JOIN inside y USING (vec_id) WHERE x.b < y.b
               GROUP BY x.cell, y.cell, x.size, y.size
               HAVING count(*) >= 10 AND count(*) >= 0.5 * greatest(x.size, y.size)),
links AS (SELECT a, c FROM half_links UNION SELECT c, a FROM half_links),
reach AS (SELECT cell AS node, cell AS root FROM dense UNION SELECT l.c, r.root FROM reach r JOIN links l ON l.a = r.node),
components AS (SELECT node AS cell, min(root) AS component FROM reach GROUP BY node),
clustered AS (
  SELECT e.vec_id, e.label, coalesce(arg_max(component, (near, -component)), -1)::BIGINT AS cluster
  FROM embeddings e LEFT JOIN inside USING (vec_id) LEFT JOIN components USING (cell) GROUP BY ALL),
modes AS (SELECT cluster, label FROM (SELECT cluster, label, count(*) AS n FROM clustered WHERE cluster <> -1 GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1)"""


@query("cluster_cells", f"WITH {CELLS_SQL} SELECT vec_id, cluster FROM clustered")
def cluster_cells(spark, sf_dir):
    return labels.cluster_cells(table(spark, sf_dir, "embeddings"), "vec_id")


#: Cosine from which the given vectors, which have little structure, count as neighbours.
NEAR = 0.3
CLUSTER_SQL = f"""
RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.x, b.x), 9) AS c
          FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE round(list_cosine_similarity(a.x, b.x), 9) >= {NEAR}),
cores AS (SELECT a AS core FROM pairs GROUP BY a HAVING count(*) + 1 >= 10),
links AS (SELECT a, b FROM pairs SEMI JOIN cores ON a = core WHERE b IN (SELECT core FROM cores)),
reach AS (SELECT core AS node, core AS root FROM cores UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
components AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
border AS (SELECT a AS node, arg_max(b, (c, -b)) AS core FROM pairs
           WHERE b IN (SELECT core FROM cores) AND a NOT IN (SELECT core FROM cores) GROUP BY a),
clustered AS (
  SELECT e.vec_id, e.label, coalesce(own.component, near.component, -1)::BIGINT AS cluster
  FROM e LEFT JOIN components own ON own.node = e.vec_id LEFT JOIN border b ON b.node = e.vec_id
       LEFT JOIN components near ON near.node = b.core),
modes AS (SELECT cluster, label FROM (SELECT cluster, label, count(*) AS n FROM clustered WHERE cluster <> -1 GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1)"""


def clustered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return density.cluster_density(vectors, "vec_id", NEAR).join(vectors.select("vec_id", "label"), "vec_id")


@query("cluster_density", f"WITH {CLUSTER_SQL} SELECT vec_id, cluster FROM clustered")
def cluster_density(spark, sf_dir):
    return clustered(spark, sf_dir).select("vec_id", "cluster")


@query("drop_noise", f"WITH {CLUSTER_SQL} SELECT vec_id, label, cluster FROM clustered WHERE cluster <> -1")
def drop_noise(spark, sf_dir):
    return labels.drop_noise(clustered(spark, sf_dir))


@query("mode_per_cluster", f"WITH {CLUSTER_SQL} SELECT cluster, label FROM modes")
def mode_per_cluster(spark, sf_dir):
    return labels.mode_per_cluster(labels.drop_noise(clustered(spark, sf_dir)), "label")


@query(
    "label_lookup",
    f"WITH {CLUSTER_SQL} SELECT vec_id, c.cluster, m.label FROM clustered c JOIN modes m USING (cluster)",
)
def label_lookup(spark, sf_dir):
    found = labels.drop_noise(clustered(spark, sf_dir))
    return labels.label_lookup(found.drop("label"), labels.mode_per_cluster(found, "label"))


CENTROID_SQL = """
parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
means AS (SELECT label, dim, avg(x) AS x FROM parts GROUP BY ALL),
centres AS (SELECT label, list(x ORDER BY dim) AS centroid FROM means GROUP BY label)"""


@query(
    "label_centroids",
    f"WITH {CENTROID_SQL} SELECT label, (dim - 1)::INT AS dimension, round(x, 8) AS x FROM means",
)
def label_centroids(spark, sf_dir):
    centres = labels.centroids(table(spark, sf_dir, "embeddings"))
    return centres.select("label", F.posexplode("centroid").alias("dimension", "x")).withColumn("x", F.round("x", 8))


@query(
    "classify_by_centroid",
    f"""WITH {CENTROID_SQL},
    scored AS (SELECT vec_id, c.label, list_inner_product(embedding::DOUBLE[], centroid) AS s FROM embeddings, centres c)
    SELECT vec_id, label AS predicted, round(s, 8) AS score FROM scored
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) = 1""",
)
def classify_by_centroid(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    out = labels.classify_by_centroid(vectors, "vec_id", labels.centroids(vectors))
    return out.withColumn("score", F.round("score", 8))


@query("train_label_classifier")
def train_label_classifier(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    predicted = labels.predict_label(vectors, labels.train_label_classifier(vectors))
    return predicted.select("vec_id", "label", "predicted")


@query("embed_text")
def embed_text(spark, sf_dir):
    texts = labels.distinct_texts(listings(spark, sf_dir, "exterior_colour"), "exterior_colour")
    embedded = labels.embed_text(texts, labels.fit_embedder(texts))
    return embedded.select("value", "weight", F.posexplode("embedding").alias("dimension", "x")).where("x <> 0")


@query("embed_documents")
def embed_documents(spark, sf_dir):
    texts = materialise(labels.distinct_texts(table(spark, sf_dir, "documents"), "text"))
    embedded = labels.embed_text(texts, labels.fit_embedder(texts))
    # a digest for each text, not for each dimension of it
    told = embedded.select(F.md5("value").alias("text_digest"), "weight", "embedding")
    return told.select("text_digest", "weight", F.posexplode("embedding").alias("dimension", "x"))


@query("classify_colour")
def classify_colour(spark, sf_dir):
    df = listings(spark, sf_dir, "listing_id", "exterior_colour")
    return labels.classify_column(df, "exterior_colour", "colour_label", "No colour")


@query("classify_stereo")
def classify_stereo(spark, sf_dir):
    df = listings(spark, sf_dir, "listing_id", "stereo_description")
    return labels.classify_column(df, "stereo_description", "stereo_label", "No stereo")


@query("feature_engineering_full")
def feature_engineering_full(spark, sf_dir):
    """Every step: auctions out, prices read, both descriptions labelled, outliers removed by the forest."""

    def labeller(df):
        for text, label, fill in (
            ("exterior_colour", "colour_label", "No colour"),
            ("stereo_description", "stereo_label", "No stereo"),
        ):
            df = labels.classify_column(df, text, label, fill).drop(text)
        return df

    rows = materialise(filters.filter_non_auction(listings(spark, sf_dir)), SMALL)
    return clean.feature_engineering(
        rows, FeatureSettings(as_of_year=AS_OF_YEAR), labeller, lambda df: outliers.remove_outliers(materialise(df, SMALL))
    )

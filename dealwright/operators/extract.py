"""Listing text to structured fields, by rules written as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealwright.config import CYLINDERS, REGIONS
from dealwright.functions import parsing
from dealwright.schemas import EXTRACTED
from dealwright.session import materialise

# Defaults and limits of a valuation form.
DEFAULT_YEAR, DEFAULT_ODOMETER, DEFAULT_ENGINE_CC, DEFAULT_CYLINDERS = 2015, 100000, 1500, 4
YEAR_LIMITS, ENGINE_LIMITS = (1990, 2026), (500, 8000)
KM_PER_MILE = 1.609
# Patterns of the fields in free text.
YEAR = r"\b((?:19|20)[0-9]{2})\b"
MODEL_YEAR = r"\b((?:19|20)[0-9]{2}) model\b"
SHORT_YEAR = r"\b([0-9]{2}) model\b"
# Amounts of money, distance and engine size, which are no years.
AMOUNT = r"\$\s*[0-9][0-9,]*|\b[0-9][0-9,]*\s*(?:k|kms?|k\s*kms?|mi|miles?|cc)\b"
KM = r"\b([0-9][0-9,]*)\s*kms?\b"
THOUSAND_KM = r"\b([0-9][0-9,]*)\s*k\s*kms?\b"
MILES = r"([0-9][0-9,]*)\s*mi(?:les?)?\b"
LITRES = r"\b([0-9]+\.?[0-9]*)\s*l\b"
CC = r"\b([0-9]{3,4})\s*cc\b"
FUEL = r"\b(petrol|gasoline|gas|diesel|electric|ev|hybrid|phev)\b"
CYLINDER = r"\b([0-9]{1,2})\s*cyl"
FOUR_WHEEL = r"\b(4wd|awd|4x4)\b"
COLOURS = r"\b(white|black|silver|grey|red|blue|green|gold|yellow|orange|brown)\b"


def _first(text: Column, pattern: str) -> Column:
    """First group of the first match, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _number(text: Column, pattern: str, needs: str = "", kind: str = "bigint") -> Column:
    """The first match's first group as a number, null when there is none.

    Only texts that hold ``needs``, a word that every match has, are searched. An absent match is the empty text, which is
    no number: asking for it with ``nullif`` would let each pattern after the first of a ``coalesce`` run twice.
    """
    found = F.regexp_extract(text, pattern, 1)
    number = F.translate(found, ",", "").try_cast(kind)
    return F.when(text.contains(needs), number) if needs else number


def extract_fields(texts: DataFrame, text: str = "text", regions: tuple[str, ...] = REGIONS) -> DataFrame:
    """Everything the text itself tells; make and model come from ``match_catalog``."""
    t = F.col("_lowered")
    short_year = _number(t, SHORT_YEAR, " model", "int")
    km = F.coalesce(_number(t, THOUSAND_KM, "km") * 1000, _number(t, KM, "km"))
    years = F.regexp_replace(t, AMOUNT, " ")
    miles = (_number(t, MILES, "mi") * KM_PER_MILE).try_cast("bigint")
    litres = (_number(t, LITRES, kind="double") * 1000).try_cast("bigint")
    named = F.coalesce(*[F.when(t.contains(F.lower(F.lit(r))), r) for r in regions], F.lit(None).cast("string"))
    return texts.withColumn("_lowered", F.lower(F.col(text))).withColumns(
        {
            "year": F.coalesce(
                _number(t, MODEL_YEAR, " model", "int"), F.lit(2000) + short_year, _number(years, YEAR, kind="int")
            ),
            "odometer": F.coalesce(km, miles),
            "engine_size_cc": F.coalesce(litres, _number(t, CC, "cc")),
            "fuel_type": parsing.fuel(_first(t, FUEL)),
            "transmission": F.when(t.rlike(r"\b(manual|mt)\b"), "Manual").otherwise("Automatic"),
            "cylinders": F.coalesce(_number(t, CYLINDER, "cyl", "int"), F.lit(DEFAULT_CYLINDERS)),
            "is_4wd": t.rlike(FOUR_WHEEL),
            "exterior_colour": F.coalesce(F.initcap(_first(t, COLOURS)), F.lit("Unknown")),
            "region": named,
            "asking_price": parsing.whole_price(F.col(text)),
        }
    ).drop("_lowered")


def name_anchors(catalog: DataFrame) -> DataFrame:
    """A stored row per catalog name: its words' number and the place of the one that the fewest names have."""
    known = catalog.select("make", "model").distinct()
    known = materialise(known.withColumn("run", F.lower(F.concat_ws(" ", "make", "model"))))
    parts = known.select("make", "model", "run", F.posexplode(F.split("run", r"\s+")).alias("offset", "word"))
    names = parts.groupBy("word").agg(F.countDistinct("run").alias("_names"))
    rarest = F.min_by(F.struct("word", "offset"), F.struct("_names", -F.length("word"), "word", "offset"))
    anchored = parts.join(names, "word").groupBy("make", "model", "run").agg(rarest.alias("_a"), F.max("offset").alias("_last"))
    return materialise(anchored.select("make", "model", "run", "_a.word", "_a.offset", (F.col("_last") + 1).alias("n_words")))


def match_catalog(texts: DataFrame, catalog: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(id, make, model): the catalog segment named first in each text, the longest one there.

    A catalog name is looked up by its rarest word alone, and compared with the words around that word where it stands; runs
    of words are not formed, and texts and catalog are never paired.
    """
    anchors = name_anchors(catalog)
    words = F.split(F.trim(F.lower(F.col(text))), r"\s+").alias("_words")
    each = texts.select(id_column, words).select(id_column, "_words", F.posexplode("_words").alias("_at", "word"))
    start = F.col("_at") - F.col("offset")
    stands = (start >= 0) & (F.array_join(F.slice("_words", F.greatest(start, F.lit(0)) + 1, F.col("n_words")), " ") == F.col("run"))
    found = each.join(anchors, "word").where(stands).withColumn("at", start)
    first = F.min_by(F.struct("make", "model"), F.struct("at", -F.length("run"), "run"))
    return found.groupBy(id_column).agg(first.alias("_s")).select(id_column, "_s.make", "_s.model")


def add_confidence(df: DataFrame) -> DataFrame:
    """'low' when a critical field is missing, 'high' when nothing useful is, else 'medium'."""
    critical = [F.col(c).isNull().cast("int") for c in ("make", "model", "year", "odometer")]
    other = [F.col(c).isNull().cast("int") for c in ("engine_size_cc", "asking_price", "region")]
    missing = sum(critical[1:], critical[0])
    useful = sum(other[1:], other[0])
    return df.withColumn(
        "confidence", F.when(missing > 0, "low").when(useful > 0, "medium").otherwise("high")
    )


def extract_listings(
    texts: DataFrame,
    catalog: DataFrame,
    id_column: str,
    text: str = "text",
    extractor: Callable[[DataFrame], DataFrame] | None = None,
    regions: tuple[str, ...] = REGIONS,
) -> DataFrame:
    """Structured fields of every text. ``extractor`` replaces the rules, for example by a ``mapInPandas`` model."""
    fields = extractor(texts) if extractor else extract_fields(texts, text, regions)
    segments = match_catalog(texts, catalog, id_column, text)
    return add_confidence(fields.join(segments, id_column, "left"))


def parse_arguments(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """JSON argument texts to raw fields, and the rows whose JSON does not parse."""
    schema = T.StructType([*EXTRACTED.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = df.withColumn("_args", F.from_json(column, schema, options))
    good = F.col("_args._bad").isNull() & F.col("_args").isNotNull()
    fields = [F.col(f"_args.{f.name}").alias(f.name) for f in EXTRACTED.fields]
    rest = [c for c in df.columns if c != column]
    bad = parsed.where(~F.coalesce(good, F.lit(False)))
    quarantine = bad.select(*rest, F.lit("arguments are not JSON").alias("reason"), F.col(column).alias("payload"))
    return parsed.where(good).select(*rest, *fields), quarantine


def fix_fields(df: DataFrame) -> DataFrame:
    """Clean raw extracted fields, all text, into their types."""
    engine = F.coalesce(parsing.loose_int(F.col("engine_size_cc")), parsing.litres_to_cc(F.col("engine_size_cc")))
    return df.withColumns(
        {
            **{c: parsing.loose_int(F.col(c)) for c in ("year", "odometer", "cylinders", "asking_price")},
            "engine_size_cc": engine,
            "is_4wd": F.coalesce(parsing.flag(F.col("is_4wd")), F.lit(False)),
            "make": F.trim("make"),
            "model": F.trim("model"),
            "fuel_type": parsing.fuel(F.col("fuel_type")),
            "transmission": parsing.transmission(F.col("transmission")),
            "exterior_colour": F.coalesce("exterior_colour", F.lit("Unknown")),
            "confidence": F.coalesce("confidence", F.lit("medium")),
        }
    ).withColumn("cylinders", F.coalesce("cylinders", F.lit(DEFAULT_CYLINDERS)))


def defaults_for_valuation(df: DataFrame, regions: tuple[str, ...] = REGIONS) -> DataFrame:
    """Fill what a valuation needs; zero counts as absent. ``reason`` marks fields beyond their limits."""

    def given(column: str, default: int) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit(0)) == 0, default).otherwise(F.col(column))

    out = df.withColumns(
        {
            "year": given("year", DEFAULT_YEAR),
            "odometer": given("odometer", DEFAULT_ODOMETER),
            "engine_size_cc": given("engine_size_cc", DEFAULT_ENGINE_CC),
            "cylinders": F.when(F.col("cylinders").isin(*CYLINDERS), F.col("cylinders")).otherwise(DEFAULT_CYLINDERS),
            "region": F.when(F.col("region").isin(*regions), F.col("region")).otherwise(regions[0]),
        }
    )
    return out.withColumn(
        "reason",
        F.when(~F.col("year").between(*YEAR_LIMITS), "year out of range")
        .when(~F.col("engine_size_cc").between(*ENGINE_LIMITS), "engine size out of range")
        .when(F.col("odometer") < 0, "odometer out of range"),
    )

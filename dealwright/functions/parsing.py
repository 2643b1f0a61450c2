"""Text to typed values: prices, units, flags, vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words a fuel may be given by and the fuel each one means.
FUEL_WORDS = {
    "petrol": "Petrol",
    "gas": "Petrol",
    "gasoline": "Petrol",
    "diesel": "Diesel",
    "electric": "Electric",
    "ev": "Electric",
    "hybrid": "Hybrid",
    "phev": "Hybrid",
}
TRUE_WORDS = ("true", "yes", "1")
PRICE_PATTERN = r"\$([0-9,]+)"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def whole_price(display: Column) -> Column:
    """Whole dollars of the first ``$`` amount; null when there is none."""
    return F.translate(F.regexp_extract(display, PRICE_PATTERN, 1), ",", "").try_cast("bigint")


def to_double(text: Column) -> Column:
    """A plain decimal number, or null for anything else."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def loose_int(text: Column) -> Column:
    """Drop ``$``, commas and blanks, then truncate to an integer; null if not numeric."""
    return to_double(F.regexp_replace(text, r"[$,\s]", "")).try_cast("bigint")


def litres_to_cc(text: Column) -> Column:
    """Cubic centimetres of the first amount given in litres ('2.4L'); null if none."""
    amount = F.regexp_extract(text, r"([0-9]+\.?[0-9]*)\s*[lL]", 1)
    return F.when(amount != "", (amount.try_cast("double") * 1000).try_cast("bigint"))


def engine_cc(text: Column) -> Column:
    """Engine size of a spec: litres if an 'l' appears, else with or without 'cc'."""
    value = F.lower(text.cast("string"))
    return (
        F.when(value.contains("l"), to_double(F.replace(value, F.lit("l"), F.lit(""))) * 1000)
        .when(value.contains("cc"), to_double(F.replace(value, F.lit("cc"), F.lit(""))))
        .otherwise(to_double(value))
    )


def number_with_units(text: Column, units: Sequence[tuple[str, float]]) -> Column:
    """A typed-in number. The first unit found scales it; commas are dropped only without a unit."""
    value = F.lower(F.trim(text))
    result = to_double(F.replace(value, F.lit(","), F.lit("")))
    for unit, scale in reversed(units):
        stripped = F.replace(value, F.lit(unit), F.lit(""))
        result = F.when(value.contains(unit), to_double(stripped) * scale).otherwise(result)
    return result


def flag(text: Column) -> Column:
    """True for the words that mean yes."""
    return F.lower(text).isin(*TRUE_WORDS)


def fuel(text: Column) -> Column:
    """One of the four fuels; Petrol when the word is unknown or absent."""
    words = F.create_map(*[F.lit(part) for pair in FUEL_WORDS.items() for part in pair])
    return F.coalesce(F.try_element_at(words, F.lower(F.trim(text))), F.lit("Petrol"))


def transmission(text: Column) -> Column:
    """Manual when the text says so, else Automatic."""
    value = F.lower(F.trim(text))
    manual = value.contains("manual") | (value == "mt")
    return F.when(manual, "Manual").otherwise("Automatic")


def canonical_category(value: Column, is_numeric: bool = False) -> Column:
    """Category text: integral numbers without '.0', null as the bucket 'nan'."""
    text = value.cast("string")
    if is_numeric:
        text = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(text)
    return F.coalesce(text, F.lit("nan"))


def segment_part(name: Column, suffix: str, part: int) -> Column:
    """Make (0) or model (1) of a file stem 'make_model', split at the first underscore."""
    stem = F.replace(name, F.lit(suffix), F.lit(""))
    return F.get(F.split(stem, "_", 2), F.lit(part))

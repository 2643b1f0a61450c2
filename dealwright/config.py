"""Settings of the valuation jobs, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

SEGMENT = ("make", "model")

# The domains a listing attribute may take.
REGIONS = (
    "Auckland",
    "Bay of Plenty",
    "Canterbury",
    "Gisborne",
    "Hawke's Bay",
    "Manawatu",
    "Marlborough",
    "Nelson Bays",
    "Northland",
    "Otago",
    "Southland",
    "Taranaki",
    "Timaru - Oamaru",
    "Waikato",
    "Wairarapa",
    "Wellington",
    "West Coast",
    "Whanganui",
)
FUELS = ("Petrol", "Diesel", "Electric", "Hybrid")
TRANSMISSIONS = ("Automatic", "Manual")
CYLINDERS = (3, 4, 6, 8, 10, 12)

# What an absent free-text description becomes.
TEXT_DEFAULTS = {"exterior_colour": "No colour", "stereo_description": "No stereo"}

NUMERIC_FEATURES = ("engine_size", "odometer", "year", "is_new", "age", "km_per_year")
# The categories among the features.
CATEGORICAL_FEATURES = (
    "region",
    "transmission",
    "fuel",
    "cylinders",
    "colour_label",
    "stereo_label",
)
# The columns a listing is priced from.
FEATURE_COLUMNS = (
    "listing_id",
    "make",
    "model",
    "region",
    "engine_size",
    "odometer",
    "year",
    "transmission",
    "fuel",
    "cylinders",
    "exterior_colour",
    "stereo_description",
    "is_4wd",
    "is_new",
    "is_dealer",
    "price",
)

# What a segment's ridge prices on: numbers, flags, and words of the categories as flags. Regions are effects of their own.
PRICE_FEATURES = (
    "engine_size",
    "odometer",
    "age",
    "km_per_year",
    "is_new",
    "is_4wd",
    "is_dealer",
    *(f"fuel={word}" for word in FUELS[1:]),
    *(f"transmission={word}" for word in TRANSMISSIONS[1:]),
)

QUANTILE_LEVELS = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


@dataclass(frozen=True)
class FeatureSettings:
    as_of_year: int = 2026
    columns: tuple[str, ...] = FEATURE_COLUMNS


@dataclass(frozen=True)
class OutlierSettings:
    """``method`` is 'isolation_forest', 'robust' or 'none'."""

    method: str = "isolation_forest"
    contamination: float = 0.05
    trees: int = 100
    rows_per_tree: int = 256
    seed: int = 42
    robust_z: float = 3.5


@dataclass(frozen=True)
class BlendSettings:
    enabled: bool = True
    full_general_below: int = 50
    full_specific_from: int = 200


@dataclass(frozen=True)
class TrainingSettings:
    """``model`` is 'line' (age and distance), 'ridge' (all of ``features``), 'bag' (that ridge, bagged) or 'absolute'
    (all of ``features``, by absolute error). With ``general_folds`` the general model is bagged over as many folds;
    with ``quantile_lines`` intervals come from quantile regression where a segment has rows enough for it."""

    min_rows_specific: int = 20
    min_rows_general: int = 10
    model: str = "line"
    features: tuple[str, ...] = PRICE_FEATURES
    ridge_alpha: float = 1.0
    bag_folds: int = 5
    min_tail_rows: int = 10
    seed: int = 42
    general_folds: int = 0
    quantile_lines: bool = False


@dataclass(frozen=True)
class FilterRule:
    column: str | None
    operator: str | None
    value: object
    name: str | None = None


@dataclass(frozen=True)
class DealSearch:
    min_discount_pct: float = 40.0
    max_discount_pct: float = 80.0
    segments: tuple[tuple[str, str], ...] = ()
    comparison_region: str | None = None
    filters: tuple[FilterRule, ...] = ()


@dataclass(frozen=True)
class Settings:
    features: FeatureSettings = field(default_factory=FeatureSettings)
    outliers: OutlierSettings = field(default_factory=OutlierSettings)
    blend: BlendSettings = field(default_factory=BlendSettings)
    training: TrainingSettings = field(default_factory=TrainingSettings)
    search: DealSearch = field(default_factory=DealSearch)


def filter_rules(rows) -> tuple[FilterRule, ...]:
    """Rules from mappings; an empty entry is dropped."""
    return tuple(
        FilterRule(r.get("column"), r.get("operator"), r.get("value"), r.get("name"))
        for r in rows or ()
        if r
    )


def settings_from_mappings(search: dict, model: dict) -> Settings:
    """Settings from the two configuration mappings (search rules, model rules)."""
    general = model.get("general_model", {})
    outliers = model.get("outlier_filtering", {})
    training = model.get("training", {})
    return Settings(
        outliers=OutlierSettings(
            method=outliers.get("method", "isolation_forest"),
            contamination=outliers.get("contamination", 0.05),
        ),
        blend=BlendSettings(
            enabled=general.get("enabled", False),
            full_general_below=general.get("blend_threshold_min", 50),
            full_specific_from=general.get("blend_threshold_max", 200),
        ),
        training=TrainingSettings(
            model=training.get("model", "line"),
            features=tuple(training.get("features", PRICE_FEATURES)),
            bag_folds=training.get("num_bag_folds", 5),
            general_folds=general.get("num_bag_folds", 0),
            quantile_lines=training.get("quantile_lines", False),
        ),
        search=DealSearch(
            min_discount_pct=search.get("minimum_discount_percent", 40),
            max_discount_pct=search.get("maximum_discount_percent", 80),
            segments=tuple((c["make"], c["model"]) for c in search.get("cars", ())),
            comparison_region=search.get("comparison_region"),
            filters=filter_rules(search.get("filters")),
        ),
    )


def load_settings(search_path: str, model_path: str) -> Settings:
    """Settings from two YAML files."""
    import yaml

    with open(search_path) as search, open(model_path) as model:
        return settings_from_mappings(yaml.safe_load(search), yaml.safe_load(model))

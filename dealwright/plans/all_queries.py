"""Every registered query; importing this module fills the catalog."""

from dealwright.plans import (  # noqa: F401
    clean_queries,
    diagnose_queries,
    history_queries,
    market_queries,
    model_queries,
    robust_queries,
    source_queries,
    text_queries,
)
from dealwright.plans.catalog import CHECKS, QUERIES  # noqa: F401

"""All registered queries."""
from barloom.plans import (  # noqa: F401
    catalog_bars,
    catalog_indicators,
    catalog_io,
    catalog_ml,
    catalog_patterns,
    catalog_signals,
    catalog_stats,
    catalog_streaming,
    catalog_sweeps,
    catalog_trades,
)
from barloom.plans.registry import ORACLES, QUERIES  # noqa: F401

"""Scans (parquet tables, derived panels, hold-out files) and sinks."""

from .tables import read_table  # noqa: F401
from .panels import (  # noqa: F401
    PANEL_SPEC,
    daily_panel,
    panel_features,
    panel_labels,
    scan_panel,
    weekly_aggregate,
    weekly_panel,
)

"""Scans, sinks and table-level guards (Parquet is the only connector)."""

from labelprism.sources.tables import *  # noqa: F401,F403

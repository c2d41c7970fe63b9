"""Incremental panel ingest with Structured Streaming."""

from .panel_stream import weekly_panel_stream, ingest_weekly_panel  # noqa: F401

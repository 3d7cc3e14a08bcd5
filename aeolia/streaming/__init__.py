"""Indicators over tables that grow: Structured Streaming forms of batch operators."""

from aeolia.streaming.days import daily_state, deduplicated, latest_days, run_daily, run_deduplicated, storm_summary, timed

__all__ = ["daily_state", "deduplicated", "latest_days", "run_daily", "run_deduplicated", "storm_summary", "timed"]

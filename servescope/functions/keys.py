"""What tells one request from another."""

from __future__ import annotations

from pyspark.sql import DataFrame

REQUEST_KEY = ("run_id", "request_id")


def request_key(df: DataFrame) -> list[str]:
    """Request ids repeat from run to run, so the run belongs to the key; a table of one run may leave it out."""
    return [c for c in REQUEST_KEY if c in df.columns]

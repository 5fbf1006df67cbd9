"""Means, deviations and z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: m_<col> and s_<col>, mean and sample deviation over all rows of df."""
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))))


def zscore(df: DataFrame, cols: list[str], stats: DataFrame | None = None) -> DataFrame:
    """df with cols standardised by ``stats``, or by its own; 0 where the deviation is 0. The statistics are one row, so they are broadcast."""
    stats = fit(df, cols) if stats is None else stats
    t = df.crossJoin(F.broadcast(stats))
    return t.withColumns({c: F.when(F.col(f"s_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in cols}).drop(*stats.columns)

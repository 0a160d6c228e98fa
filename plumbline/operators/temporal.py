"""Years covered by columns whose name suggests a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import ref
from plumbline.operators.facts import column_facts, is_temporal_name


def temporal_names(columns: list[str], cfg: ProfileConfig) -> list[str]:
    return [c for c in columns if is_temporal_name(c, cfg.temporal_mode)]


def temporal_coverage(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None) -> DataFrame:
    """(column, min_year, max_year, year_hits): the first year 1900-2099 in each value's text."""
    names = temporal_names(df.columns, cfg)
    if facts is None:
        facts = column_facts(df.selectExpr(*[ref(n) for n in names]), cfg, ["years"])
    return (facts.where(F.col("column").isin(names))
            .select("column", "min_year", "max_year", "year_hits").orderBy("column"))

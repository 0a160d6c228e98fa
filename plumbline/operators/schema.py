"""Types, nulls and distinct counts per column; nulls per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.config import ROW_MISSING_THRESHOLDS, ProfileConfig
from plumbline.functions.columns import percent, ref
from plumbline.operators.distinct import distinct_counts
from plumbline.operators.facts import column_facts


def with_unique(facts: DataFrame, unique: DataFrame) -> DataFrame:
    """Facts plus `unique_non_null` and `unique`, which counts null as one more value.

    `unique` has at most one row per column, so broadcasting it is always safe.
    """
    n = F.coalesce(F.col("unique_non_null"), F.lit(0))
    return (facts.join(F.broadcast(unique), "column", "left")
            .withColumn("unique_non_null", n)
            .withColumn("unique", n + (F.col("rows") > F.col("non_null")).cast("bigint")))


def schema_profile(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None,
                   unique: DataFrame | None = None) -> DataFrame:
    facts = column_facts(df, cfg, ()) if facts is None else facts
    unique = distinct_counts(df, cfg) if unique is None else unique
    null = F.col("rows") - F.col("non_null")
    return (with_unique(facts, unique)
            .select("column", "dtype", "non_null", null.alias("null"),
                    percent(null, F.col("rows")).alias("null_pct"), "unique")
            .orderBy("column"))


def missingness(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None) -> DataFrame:
    facts = column_facts(df, cfg, ()) if facts is None else facts
    missing = F.col("rows") - F.col("non_null")
    return (facts.select("column", missing.alias("missing"),
                         percent(missing, F.col("rows")).alias("missing_pct"))
            .orderBy(F.desc("missing"), "column"))


def row_nulls(df: DataFrame) -> DataFrame:
    """The table plus `null_count` and `null_pct` over all columns of each row."""
    flags = [f"cast({ref(c)} is null as int)" for c in df.columns]
    return df.withColumn("null_count", F.expr(" + ".join(flags) or "0")).withColumn(
        "null_pct", F.expr(_share(df)))


def _share(df: DataFrame) -> str:
    return f"null_count / {max(len(df.columns), 1)}D * 100D"


def row_missingness(df: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """(threshold_null_pct_ge, rows, min/max/mean/p50/p90/p99_null_pct).

    All from the number of rows per null count, which has at most columns + 1 groups.
    """
    counts = row_nulls(df).groupBy("null_count").agg(F.expr("count(1) as n"))
    order = Window.orderBy("null_count")  # over the few groups, not over rows
    ranked = (counts.withColumn("null_pct", F.expr(_share(df)))
              .withColumn("upto", F.sum("n").over(order))
              .withColumn("total", F.sum("n").over(Window.partitionBy())))
    at = [f"min(case when upto > floor((total - 1) * {q}D + 0.5D) then null_pct end) as p{q * 100:g}_null_pct"
          for q in (0.50, 0.90, 0.99)]
    one = ranked.selectExpr(
        "max(total) as total", "min(null_pct) as min_null_pct", "max(null_pct) as max_null_pct",
        "sum(null_pct * n) / sum(n) as mean_null_pct", *at,
        *[f"sum(case when null_pct >= {t} then n else 0 end) as ge_{t}" for t in ROW_MISSING_THRESHOLDS])
    levels = ", ".join(f"struct({t}L as threshold_null_pct_ge, ge_{t} as rows)"
                       for t in ROW_MISSING_THRESHOLDS)
    return (one.where("total is not null" if df.columns else "false")
            .selectExpr(f"inline(array({levels}))", "min_null_pct", "max_null_pct", "mean_null_pct",
                        "p50_null_pct", "p90_null_pct", "p99_null_pct")
            .orderBy("threshold_null_pct_ge"))


def row_missing_quantiles(df: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """The row-level quantiles alone, one row (none for an empty table)."""
    return row_missingness(df, cfg).where("threshold_null_pct_ge = 0").select(
        "min_null_pct", "p50_null_pct", "p90_null_pct", "p99_null_pct", "max_null_pct", "mean_null_pct")


def dtype_counts(schema: DataFrame) -> DataFrame:
    """Columns per type of one table."""
    return (schema.groupBy("dtype").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "dtype"))

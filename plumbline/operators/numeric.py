"""Numeric columns: summary, nearest-rank quantiles, shape, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import literal, local_frame, nearest_rank, number, only, percent, rows_of
from plumbline.functions.ranks import double, values_at_ranks
from plumbline.operators.distinct import distinct_counts
from plumbline.operators.facts import column_facts, numeric_fields
from plumbline.operators.schema import with_unique

QUARTILES = {"25%": 0.25, "50%": 0.50, "75%": 0.75}


def numeric_facts(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None) -> DataFrame:
    if facts is None:
        facts = local_frame(column_facts(only(df, numeric_fields(df)), cfg, ["numeric"]))
    return facts.where("type_class = 'numeric'")


def column_quantiles(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None) -> DataFrame:
    """(column, 25%, 50%, 75%, median): nearest-rank quartiles and the interpolated median."""
    facts = numeric_facts(df, cfg, facts)
    sizes = {r["column"]: r["n"] for r in facts.select(
        "column", (F.col("non_null") - F.coalesce("nan_count", F.lit(0))).alias("n")).collect()}
    wanted = {name: (n, {**{label: nearest_rank(n, q) for label, q in QUARTILES.items()},
                         "low": (n - 1) // 2, "high": n // 2}) for name, n in sizes.items() if n}
    exprs = {f.name: number(f) for f in numeric_fields(df)}
    values = values_at_ranks(df, exprs, wanted, cfg)
    pick = lambda label: F.max(F.when(F.col("label") == label, F.col("value")))
    return (values.groupBy("column")
            .agg(*[pick(label).alias(label) for label in QUARTILES],
                 ((pick("low") + pick("high")) / 2.0).alias("median")))


def numeric_summary(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None,
                    quantiles: DataFrame | None = None) -> DataFrame:
    facts = numeric_facts(df, cfg, facts)
    quantiles = column_quantiles(df, cfg, facts) if quantiles is None else quantiles
    return (facts.join(F.broadcast(quantiles), "column", "left")
            .select("column", F.col("non_null").alias("count"), "mean", "std", "min",
                    *[F.col(f"`{label}`") for label in QUARTILES], "max")
            .orderBy("column"))


def constant_columns(facts: DataFrame, unique: DataFrame) -> DataFrame:
    """(column, is_constant) of the numeric columns: at most one value, null counted as one."""
    return with_unique(facts.where("type_class = 'numeric'"), unique).select(
        "column", F.expr("non_null = 0 or `unique` <= 1").alias("is_constant"))


def distribution_shape(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None,
                       quantiles: DataFrame | None = None,
                       unique: DataFrame | None = None) -> DataFrame:
    facts = numeric_facts(df, cfg, facts)
    quantiles = column_quantiles(df, cfg, facts) if quantiles is None else quantiles
    unique = distinct_counts(df, cfg, numeric_fields(df)) if unique is None else unique
    some = F.col("non_null") > 0
    skew = F.when(F.col("std") > 0, (F.col("mean") - F.col("median")) / F.col("std")).otherwise(0.0)
    return (with_unique(facts, unique).join(F.broadcast(quantiles), "column", "left")
            .select("column", "non_null", "unique",
                    F.when(some, F.try_divide(F.col("unique").cast("double"), F.col("non_null")))
                    .otherwise(0.0).alias("unique_ratio"),
                    F.when(some, percent(F.col("zeros"), F.col("non_null"))).alias("zero_pct"),
                    F.when(some, skew).alias("approx_skew"),
                    (~some | (F.col("unique") <= 1)).alias("is_constant"))
            .orderBy("column"))


def numeric_histogram(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None,
                      bins: int | None = None) -> DataFrame:
    """(column, bin, low, high, count): equal-width bins over each whole column.

    The last bin is closed; bins without values are kept.
    """
    bins = bins or cfg.histogram_bins
    facts = numeric_facts(df, cfg, facts)
    ends = {r["column"]: (r["min"], r["max"]) for r in facts.where("min IS NOT NULL").collect()
            if float("-inf") < r["min"] and r["max"] < float("inf")}
    fields = [f for f in numeric_fields(df) if f.name in ends]
    if not fields:
        return df.sparkSession.createDataFrame(
            [], "column string, bin bigint, low double, high double, count bigint")
    widths = {c: (hi - lo) / bins or 1.0 for c, (lo, hi) in ends.items()}
    cells = [{"column": literal(f.name),
              "bin": f"case when {number(f)} is not null then least({bins - 1}L, floor(({number(f)} - "
                     f"{double(ends[f.name][0])}) / {double(widths[f.name])})) end"} for f in fields]
    counts = (rows_of(df, cells).where("bin IS NOT NULL")
              .groupBy("column", "bin").agg(F.expr("count(1) as count")))
    grid = df.sparkSession.createDataFrame(
        [(c, b, lo + b * widths[c], lo + (b + 1) * widths[c])
         for c, (lo, _) in ends.items() for b in range(bins)],
        "column string, bin bigint, low double, high double")
    return (grid.join(counts, ["column", "bin"], "left")
            .select("column", "bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))
            .orderBy("column", "bin"))

"""Warnings derived from the other reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import union_all


def quality_warnings(overview: DataFrame, missing: DataFrame, shape: DataFrame,
                     cfg: ProfileConfig, keys: list[str] | None = None) -> DataFrame:
    """(*keys, rule, column, warning), ordered by rule and then as the report lists columns.

    `keys` names columns, such as dataset_id, that tell several datasets apart.
    """
    keys = keys or []

    def table_rule(order: int, rule: str, cond: Column, text: str) -> DataFrame:
        return overview.where(cond).select(
            *keys, F.lit(order).alias("rule_order"), F.lit(rule).alias("rule"),
            F.lit(None).cast("string").alias("column"), F.lit(1).alias("place"),
            F.lit(text).alias("warning"))

    def column_rule(order: int, rule: str, rows: DataFrame, by: list, text: Column) -> DataFrame:
        # One row per column of each dataset at most.
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        kept = F.lit(True) if cfg.warn_column_limit is None else F.col("place") <= cfg.warn_column_limit
        return (rows.withColumn("place", place).where(kept)
                .select(*keys, F.lit(order).alias("rule_order"), F.lit(rule).alias("rule"),
                        "column", "place", text.alias("warning")))

    return union_all([
        table_rule(1, "empty_dataset", (F.col("rows") == 0) | (F.col("columns") == 0),
                   "Dataset is empty (0 rows or 0 columns)."),
        table_rule(2, "missing_cells", F.col("missing_cell_pct") >= cfg.warn_missing_cell_pct,
                   f"High overall missingness (>= {cfg.warn_missing_cell_pct:g}% missing cells)."),
        table_rule(3, "duplicate_rows", F.col("duplicate_row_pct") >= cfg.warn_duplicate_row_pct,
                   f"High duplicate row rate (>= {cfg.warn_duplicate_row_pct:g}%)."),
        column_rule(4, "column_missing", missing.where(F.col("missing_pct") >= cfg.warn_column_missing_pct),
                    [F.desc("missing"), F.asc("column")],
                    F.format_string(f"Column '%s' has >= {cfg.warn_column_missing_pct:g}%% missing (%.2f%%).",
                                    F.col("column"), F.col("missing_pct"))),
        column_rule(5, "column_constant", shape.where("is_constant"), [F.asc("column")],
                    F.format_string("Column '%s' is constant (unique<=1).", F.col("column"))),
    ]).orderBy(*keys, "rule_order", "place").select(*keys, "rule", "column", "warning")

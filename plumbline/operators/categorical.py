"""Text and boolean columns as categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.config import NULL_LABEL, ProfileConfig
from plumbline.functions.columns import fields, is_categorical, literal, only, pick, text
from plumbline.operators.distinct import distinct_counts
from plumbline.operators.facts import column_facts
from plumbline.operators.frequent import top_values
from plumbline.operators.lists import is_prose, list_columns
from plumbline.operators.schema import schema_profile


def judged_columns(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None,
                   schema: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """(column, dtype, decision, reason, unique, rows): which columns are profiled by value, and why not."""
    candidates = fields(df, is_categorical)
    part = only(df, candidates)
    facts = column_facts(part, cfg, ["lists"]) if facts is None else facts
    schema = schema_profile(part, cfg, facts, distinct_counts(part, cfg)) if schema is None else schema
    lists = list_columns(part, cfg, facts) if lists is None else lists
    ratio = F.try_divide(F.col("unique").cast("double"), F.col("non_null"))
    reason = (F.when(F.col("is_list"), "skipped_listlike")
              .when(is_prose(cfg), "skipped_long_text")
              .when((F.col("non_null") >= cfg.category_min_values)
                    & (F.col("null_pct") <= cfg.category_max_null_pct)
                    & (ratio >= cfg.category_unique_ratio), "skipped_high_uniqueness")
              .otherwise(""))
    # All three frames have one row per column, so the broadcasts are bounded by the schema.
    joined = (schema.join(F.broadcast(facts.select("column", "position", "type_class", "long_values", "rows")), "column")
              .join(F.broadcast(lists.select("column", F.lit(True).alias("is_list"))), "column", "left")
              .where(F.col("type_class").isin("text", "bool") & (F.col("rows") > 0)))
    return (joined.withColumn("reason", reason).orderBy("position")
            .select("column", "dtype",
                    F.when(F.col("reason") == "", "profiled").otherwise("skipped").alias("decision"),
                    "reason", "unique", "rows"))


def categorical_columns(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None,
                        schema: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """(column, dtype, decision, reason)"""
    return judged_columns(df, cfg, facts, schema, lists).drop("unique", "rows")


def categorical_topk(df: DataFrame, cfg: ProfileConfig, judged: DataFrame | None = None) -> DataFrame:
    """(column, value, count, pct_of_rows): the most frequent values of the profiled columns.

    Null is the value <NULL>; white space alone is the empty string.
    """
    judged = judged_columns(df, cfg) if judged is None else judged
    found = judged.where("decision = 'profiled'").collect()  # one row per column
    if not found:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, count bigint, pct_of_rows double")
    names, blank = [r["column"] for r in found], literal(r"(?U)^\s+$")
    cells = [{"field": str(i), "value": f"coalesce(regexp_replace({text(df.schema[name])}, {blank}, ''), "
              f"{literal(NULL_LABEL)})"} for i, name in enumerate(names)]
    top = top_values(df, cells, cfg.top_k, cfg, [r["unique"] for r in found])
    # Every row has one value per column.
    return (top.orderBy(F.col("field").cast("int"), "place")
            .select(F.expr(pick(names, "cast(field as int)")).alias("column"), "value", F.col("n").alias("count"),
                    (F.col("n").cast("double") / F.lit(found[0]["rows"]) * 100.0).alias("pct_of_rows")))

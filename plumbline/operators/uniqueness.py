"""Distinct values, key candidates and repeated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from plumbline.config import KEY_NAME_PARTS, ProfileConfig
from plumbline.functions.columns import percent
from plumbline.operators.distinct import (
    distinct_counts, field_name, has_value, value_groups, value_text,
)
from plumbline.operators.facts import column_facts
from plumbline.operators.frequent import ranked
from plumbline.operators.sampling import random_rows
from plumbline.operators.schema import schema_profile, with_unique

KEY_COLUMNS = ("key_column string, unique_keys bigint, avg_rows_per_key double, "
               "max_rows_per_key bigint, repeated_keys bigint, rows_in_repeated_keys bigint, "
               "repeated_keys_pct double")


def uniqueness(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None,
               unique: DataFrame | None = None) -> DataFrame:
    """(column, unique_non_null, unique_including_null_as_value), counted as `unique_mode` says.

    `unique` is the result of `distinct_counts` on the same rows, if at hand. A sample is drawn by the
    rows' own content, so both scans below see the same rows.
    """
    if cfg.max_unique_sample:
        df = random_rows(df, cfg.max_unique_sample, cfg.sample_seed)
        facts = unique = None
    facts = column_facts(df, cfg, ()) if facts is None else facts
    return (with_unique(facts, distinct_counts(df, cfg) if unique is None else unique)
            .select("column", "unique_non_null",
                    F.col("unique").alias("unique_including_null_as_value"))
            .orderBy("column"))


def key_candidates(df: DataFrame, cfg: ProfileConfig, schema: DataFrame | None = None) -> DataFrame:
    """(priority, column, source, unique_ratio): columns that look like keys.

    First those with nearly as many distinct as non-null values, then those with a
    telling name in table order; at most `key_limit`, if that is set.
    """
    schema = schema_profile(df, cfg) if schema is None else schema
    ratio = F.try_divide(F.col("unique").cast("double"), F.col("non_null"))
    statistical = ((F.col("non_null") >= cfg.key_min_values)
                   & (F.col("null_pct") <= cfg.key_max_null_pct) & (ratio >= cfg.key_unique_ratio))
    named = F.lit(False)
    for part in KEY_NAME_PARTS:
        named = named | F.contains(F.lower("column"), F.lit(part))
    place = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column"))
    chosen = (schema.withColumn("unique_ratio", ratio)
              .withColumn("source", F.when(statistical, "unique_ratio").when(named, "name"))
              .where("source IS NOT NULL"))
    order = Window.orderBy(  # one row per column of the table
        F.col("source") == "name", F.desc(F.when(F.col("source") != "name", F.col("unique_ratio"))),
        F.when(F.col("source") == "name", place), "column")
    return (chosen.withColumn("priority", F.row_number().over(order).cast("bigint"))
            .where(F.col("priority") <= F.lit(cfg.key_limit) if cfg.key_limit is not None else F.lit(True))
            .select("priority", "column", "source", "unique_ratio").orderBy("priority"))


def _key_fields(df: DataFrame, cfg: ProfileConfig, keys: list[str] | None) -> list[T.StructField]:
    if keys is None:
        keys = [r["column"] for r in key_candidates(df, cfg).collect()]  # at most one per column
    return [df.schema[k] for k in keys]


def key_duplicates(df: DataFrame, cfg: ProfileConfig, keys: list[str] | None = None) -> DataFrame:
    """How often the values of each key candidate repeat, one row per key column.

    All keys are counted in one pass; the second aggregate sees one row per distinct key
    and combines within each task. Keys with fewer than `key_min_rows` values are left out.
    """
    fields = _key_fields(df, cfg, keys)
    if not fields:
        return df.sparkSession.createDataFrame([], KEY_COLUMNS)
    # Null is kept as a group: the rows without a key count towards the average.
    n, held = F.col("n"), has_value()
    return (value_groups(df, fields, keep_null=True).groupBy("field").agg(
        F.sum(n).alias("rows"), F.sum(F.when(held, n)).alias("non_null"),
        F.count_if(held).alias("unique_keys"), F.max(F.when(held, n)).alias("max_rows_per_key"),
        F.count_if(held & (n > 1)).alias("repeated_keys"),
        F.sum(F.when(held & (n > 1), n).otherwise(0)).alias("rows_in_repeated_keys"))
        .where(F.col("non_null") >= cfg.key_min_rows)
        .select(field_name(fields).alias("key_column"), "unique_keys",
                (F.col("rows") / F.col("unique_keys")).alias("avg_rows_per_key"),
                "max_rows_per_key", "repeated_keys", "rows_in_repeated_keys",
                percent(F.col("repeated_keys"), F.col("unique_keys")).alias("repeated_keys_pct"))
        .orderBy(F.desc("avg_rows_per_key"), "key_column"))


def key_top_repeated(df: DataFrame, cfg: ProfileConfig, keys: list[str] | None = None) -> DataFrame:
    """(key_column, key, rows_per_key): the most frequent values of each key candidate."""
    fields = _key_fields(df, cfg, keys)
    if not fields:
        return df.sparkSession.createDataFrame([], "key_column string, key string, rows_per_key bigint")
    values = value_groups(df, fields, whole_text=True).withColumn("key", value_text(fields))
    # Nearly all values of a key differ: no summary could settle the ranking.
    return (ranked(values.select("field", "key", "n"), cfg.key_top_values, value="key")
            .select(field_name(fields).alias("key_column"), "key",
                    F.col("n").alias("rows_per_key"))
            .orderBy("key_column", F.desc("rows_per_key"), "key"))


def key_summary(df: DataFrame, cfg: ProfileConfig, keys: list[str] | None = None) -> DataFrame:
    """One JSON document {candidates, by_key} in the one column `document`."""
    fields = _key_fields(df, cfg, keys)
    names = [f.name for f in fields]
    report = key_duplicates(df, cfg, names)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("key_column")) \
        if names else F.lit(0).cast("bigint")
    entry = F.struct(place.alias("place"), F.struct(
        "key_column", "unique_keys", "avg_rows_per_key", "max_rows_per_key").alias("entry"))
    by_key = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"])
    return report.agg(by_key.alias("by_key")).select(F.to_json(F.struct(
        F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("candidates"), "by_key"))
        .alias("document"))

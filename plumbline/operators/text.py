"""Text columns: blanks and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import literal, only, rows_of, text
from plumbline.operators.facts import column_facts, text_fields
from plumbline.operators.lists import quantiles_of_counts


def length_quantiles(df: DataFrame) -> DataFrame:
    """(column, avg, min, max, q0, q1): text lengths, with p50 and p90 by nearest rank.

    Rows are counted per length. A table of b bytes has fewer than sqrt(2b) different
    lengths per column, so the frequency table stays small for any number of rows.
    """
    texts = text_fields(df)
    if not texts:
        return df.sparkSession.createDataFrame(
            [], "column string, avg double, min int, max int, q0 int, q1 int")
    cells = [{"column": literal(f.name), "length": f"length({text(f)})"} for f in texts]
    counts = (rows_of(df, cells).where("length IS NOT NULL")
              .groupBy("column", "length").agg(F.expr("count(1) as n")))
    return quantiles_of_counts(counts, "column", "length", (0.50, 0.90))


def text_profile(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None) -> DataFrame:
    if facts is None:
        facts = column_facts(only(df, text_fields(df)), cfg, ["text"])
    lengths = length_quantiles(df)
    return (facts.where("type_class = 'text'")
            .join(F.broadcast(lengths.select("column", "q0", "q1")), "column", "left")
            .select("column", "non_null", (F.col("rows") - F.col("non_null")).alias("null"),
                    F.coalesce("empty_string", F.lit(0)).alias("empty_string"),
                    F.coalesce("whitespace_only", F.lit(0)).alias("whitespace_only"),
                    "avg_len", "min_len", F.col("q0").cast("double").alias("p50_len"),
                    F.col("q1").cast("double").alias("p90_len"), "max_len")
            .orderBy("column"))

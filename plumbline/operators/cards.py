"""Everything known about each column, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def column_cards(schema: DataFrame, numeric: DataFrame, text: DataFrame, unique: DataFrame,
                 categories: DataFrame) -> DataFrame:
    """One row per column: type, nulls, distinct values, numbers, lengths, top value.

    All inputs have a bounded number of rows per column.
    """
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    top = (categories.withColumn("place", F.row_number().over(order)).where("place = 1")
           .select("column", F.col("value").alias("top_value"), F.col("count").alias("top_count")))
    numbers = numeric.select("column", "mean", "std", "min", F.col("`25%`").alias("p25"),
                             F.col("`50%`").alias("p50"), F.col("`75%`").alias("p75"), "max")
    lengths = text.select("column", "empty_string", "whitespace_only", "avg_len", "min_len",
                          "p50_len", "p90_len", "max_len")
    out = schema
    for part in (numbers, lengths, unique, top):
        out = out.join(F.broadcast(part), "column", "left")
    return out.orderBy("column")

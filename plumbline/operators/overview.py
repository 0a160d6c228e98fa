"""One row per table: size, missing cells, repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.config import ProfileConfig
from plumbline.functions.columns import is_nested, percent, ref, text, union_all
from plumbline.operators.facts import column_facts

def row_digest(df: DataFrame) -> list[Column]:
    """128 bits of a row, whatever its width: two hash chains over its values and their nulls. Equal
    rows have equal digests; nested values go in as text."""
    parts = []
    for f in df.schema.fields:
        value = text(f) if is_nested(f.dataType) else ref(f.name)
        parts += [value, f"{ref(f.name)} is null"]
    return [F.expr(f"xxhash64({seed}L, {', '.join(parts)}) as h{seed}") for seed in (1, 2)]


def _key_shown(df: DataFrame) -> int | None:
    """The rows of a table whose first integer or date column, where tables have their key, holds as many values as rows; else None.

    One scan of that column alone, and a shuffle of bitmaps: where it is a key, no row can repeat, and the other columns,
    texts and vectors among them, need not be read.
    """
    whole = [f for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.DateType))][:1]
    if not whole:
        return None
    place = f"unix_date({ref(whole[0].name)})" if isinstance(whole[0].dataType, T.DateType) else ref(whole[0].name)
    words = (df.selectExpr(f"cast({place} as bigint) as place").groupBy(F.expr("shiftright(place, 6)").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63L as int))) as bits"), F.expr("count(1) as n")))
    rows, first = words.selectExpr("coalesce(sum(n), 0L)", "coalesce(sum(bit_count(bits)), 0L)").head()
    return rows if rows == first else None


def duplicate_rows(df: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """(rows, duplicate_rows, duplicate_row_pct): rows that occur more than once, the first
    occurrence included.

    A table with a key first has none, which one column shows. Otherwise one scan and one shuffle of 16-byte digests, counted
    within each task first, so copies cost one row per task.
    """
    if not df.columns:
        return df.selectExpr("count(1) as rows", "case when count(1) > 1 then count(1) else 0 end as duplicate_rows"
                             ).withColumn("duplicate_row_pct", percent(F.col("duplicate_rows"), F.col("rows")))
    rows = _key_shown(df)
    if rows is not None:
        return df.sparkSession.createDataFrame([(rows, 0, 0.0)], "rows bigint, duplicate_rows bigint, duplicate_row_pct double")
    counts = df.select(*row_digest(df)).groupBy("h1", "h2").agg(F.expr("count(1) as n"))
    return (counts.selectExpr("coalesce(sum(n), 0L) as rows", "coalesce(sum(case when n > 1 then n end), 0L) as duplicate_rows")
            .withColumn("duplicate_row_pct", percent(F.col("duplicate_rows"), F.col("rows"))))


def logical_size(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None) -> DataFrame:
    """(column, bytes): bytes the non-null values hold, whatever the file format."""
    facts = column_facts(df, cfg, ["bytes"]) if facts is None else facts
    return facts.select("column", "bytes").orderBy("column")


def overview(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None,
             sampled: bool = False, rows_total: int | None = None) -> DataFrame:
    facts = column_facts(df, cfg, ["bytes"]) if facts is None else facts
    cells = facts.agg(
        F.count(F.lit(1)).alias("columns"),
        F.coalesce(F.sum(F.col("rows") - F.col("non_null")), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("logical_bytes"))
    repeats = duplicate_rows(df, cfg)
    names = ["rows", "columns", "missing_cells", "duplicate_rows", "duplicate_row_pct", "logical_bytes"]
    halves = [part.select(*[(F.col(n) if n in part.columns else F.lit(None)).alias(n) for n in names])
              for part in (cells, repeats)]
    one = union_all(halves).agg(*[F.max(n).alias(n) for n in names])
    total = F.col("rows") if rows_total is None else F.lit(rows_total).cast("bigint")
    return one.select(
        total.alias("rows"), total.alias("rows_total"), F.col("rows").alias("rows_sample"),
        F.lit(sampled).alias("sampled"), "columns", "missing_cells",
        percent(F.col("missing_cells"), F.col("rows") * F.col("columns")).alias("missing_cell_pct"),
        "duplicate_rows", "duplicate_row_pct",
        F.col("logical_bytes").alias("memory_bytes_estimate"))

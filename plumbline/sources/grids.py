"""Tables from raw cell grids: messy CSV files and workbook sheets.

A grid has one row per source row: the columns that tell its table apart (such as path and
sheet), `row_no`, which orders the rows of a table, and `cells`, an array of strings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import is_blank, literal, quoted, ref, rows_of, strip, union_all

# What the text of a column must look like for each type, narrowest first.
TYPE_PATTERNS = (
    ("bigint", r"\A[+-]?\d{1,18}\z"),
    ("double", r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"),
    ("boolean", r"\A([Tt][Rr][Uu][Ee]|[Ff][Aa][Ll][Ss][Ee])\z"),
    ("timestamp_ntz", r"\A\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?\z"),
)


def has_text(cells: Column) -> Column:
    return F.array_join(cells, "").rlike(r"(?U)\S")


def repaired_names(header: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, pos, name) from (*keys, pos, cell): usable column names.

    Cells are stripped and blanks become col_<position>. A name that is taken further left, in
    whatever case, gets the first of __1, __2 ... that is free, since Spark finds columns in any case.
    One header, never data, is gathered at a time.
    """
    cell = F.col("cell")
    names = header.select(*keys, "pos", F.when(
        cell.isNull() | is_blank(cell), F.concat(F.lit("col_"), (F.col("pos") + 1).cast("string")))
        .otherwise(strip(cell)).alias("name"))

    def numbered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        taken, last, out = set(), {}, []
        for name in rows["name"]:
            free, k = name, last.get(name.lower(), 0)
            while free.lower() in taken:
                k += 1
                free = f"{name}__{k}"
            last[name.lower()] = k
            taken.add(free.lower())
            out.append(free)
        return rows.assign(name=out)

    return names.groupBy(*keys).applyInPandas(numbered, names.schema)


def headers(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, header_row, names): the first row of each table that has any text.

    A table without one is missing here: it is empty and has no columns.
    """
    first = (grid.where(has_text(F.col("cells"))).groupBy(*keys)
             .agg(F.min("row_no").alias("header_row"), F.min_by("cells", "row_no").alias("cells")))
    long = first.select(*keys, "header_row", F.posexplode("cells").alias("pos", "cell"))
    named = repaired_names(long, [*keys, "header_row"])
    # One list per table, as long as its header is wide.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"])
    return named.groupBy(*keys, "header_row").agg(listed.alias("names"))


def body(grid: DataFrame, header_row: int, names: list[str], max_rows: int | None = None) -> DataFrame:
    """The rows below the header as string columns: short rows padded with null, long ones cut."""
    rows = grid.where(F.col("row_no") > header_row)
    if max_rows is not None:
        rows = rows.where(F.col("row_no") <= header_row + max_rows)
    return rows.select(*[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def _fits(cell: str) -> dict[str, str]:
    """For each type, SQL for whether a text looks like it."""
    found = {kind: f"{cell} rlike {literal(pattern)}" for kind, pattern in TYPE_PATTERNS}
    found["timestamp_ntz"] += f" and try_cast({cell} as timestamp_ntz) is not null"
    return found


def marked_body(grid: DataFrame, keys: list[str], max_rows: int | None = None) -> DataFrame:
    """The rows below each table's header: (*keys, header_row, names, row_no, cells, over), in one pass over all tables; over: beyond the
    cap. `headers` has one row per table, metadata, and is broadcast."""
    own = [f"_{k}" for k in keys]
    heads = headers(grid, keys).withColumnsRenamed(dict(zip(keys, own)))
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)]
    rows = grid.join(F.broadcast(heads), same).drop(*own).where(F.col("row_no") > F.col("header_row"))
    over = F.lit(False) if max_rows is None else F.col("row_no") > F.col("header_row") + max_rows
    return rows.select(*keys, "header_row", "names", "row_no", "cells", over.alias("over"))


def container_columns(grid: DataFrame, keys: list[str], max_rows: int | None = None) -> DataFrame:
    """(*keys, pos, column, type, non_null): the columns of all tables of a grid with the narrowest type that all
    their texts fit, in one pass and one small shuffle, however many tables there are."""
    body_ = marked_body(grid, keys, max_rows).where("not over")
    cells = body_.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("names")), lambda i: F.struct(
        F.get("names", i - 1).alias("column"), F.get("cells", i - 1).alias("cell")))).alias("pos", "c")).select(*keys, "pos", "c.column", "c.cell")
    fits = _fits("cell")
    counts = cells.groupBy(*keys, "pos", "column").agg(F.count("cell").alias("non_null"), *[F.expr(f"count_if({sql}) as {kind}") for kind, sql in fits.items()])
    # the columns of tables that have a header only
    heads = headers(grid, keys).select(*keys, F.posexplode("names").alias("pos", "column"))
    none = heads.select(*keys, "pos", "column", F.lit(0).cast("bigint").alias("non_null"), *[F.lit(0).cast("bigint").alias(kind) for kind in fits])
    both = counts.unionByName(none).groupBy(*keys, "pos", "column").agg(*[F.max(c).alias(c) for c in ("non_null", *fits)])
    kind = F.when(F.col("non_null") == 0, "string")
    for name in fits:
        kind = kind.when(F.col(name) == F.col("non_null"), name)
    return both.select(*keys, "pos", "column", kind.otherwise("string").alias("type"), "non_null")


def container_tables(grid: DataFrame, keys: list[str], max_rows: int | None = None) -> DataFrame:
    """(*keys, columns, rows, truncated): all tables of a grid, those without any text too, which have no columns."""
    held = marked_body(grid, keys, max_rows)
    counts = held.groupBy(*keys).agg(F.count_if(~F.col("over")).alias("rows"), F.max("over").alias("truncated"))
    heads = headers(grid, keys).select(*keys, F.size("names").cast("bigint").alias("columns"))
    parts = [grid.select(*keys, F.lit(0).cast("bigint").alias("columns"), F.lit(0).cast("bigint").alias("rows"), F.lit(False).alias("truncated")).distinct(),
             heads.select(*keys, "columns", F.lit(0).cast("bigint").alias("rows"), F.lit(False).alias("truncated")),
             counts.select(*keys, F.lit(0).cast("bigint").alias("columns"), "rows", "truncated")]
    return union_all(parts).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("columns", "rows", "truncated")])


def column_types(df: DataFrame) -> DataFrame:
    """(column, type): the narrowest type that every non-null text of a column fits, else string."""
    aggs, rows = [], []
    for i, name in enumerate(df.columns):
        c = ref(name)
        aggs.append(f"count({c}) as `{i}_n`")
        kinds = ""
        for kind, fits in _fits(c).items():
            aggs.append(f"count_if({fits}) as `{i}_{kind}`")
            kinds += f" when `{i}_{kind}` = `{i}_n` then '{kind}'"
        rows.append({"column": literal(name),
                     "type": f"case when `{i}_n` = 0 then 'string'{kinds} else 'string' end"})
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, type string")
    return rows_of(df.selectExpr(*aggs), rows)


def typed(df: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """A table of strings with each column cast to its inferred type."""
    types = column_types(df) if types is None else types
    kinds = {r["column"]: r["type"] for r in types.collect()}  # one row per column
    return df.select(*[quoted(c).try_cast(kinds[c]).alias(c) if kinds[c] != "string" else quoted(c)
                       for c in df.columns])

"""The shared scan: decomposable facts about every column of a table.

One row per column. Everything here is a plain aggregate with partial results per
task, so the scan shuffles one row per task whatever the size of the table. Wide
tables are split over several aggregates to stay inside whole-stage code generation;
on columnar files that reads each column only once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from plumbline.config import (
    LIST_SEPARATORS, TEMPORAL_NAME_PARTS, YEAR_PATTERN, ProfileConfig,
)
from plumbline.functions.columns import (
    BLANK, fields, first_year, is_numeric, is_text, literal, logical_bytes, number, ref, rows_of,
    text, type_class, union_all,
)

MEASURES = {
    "rows": "bigint", "non_null": "bigint", "nan_count": "bigint",
    "mean": "double", "std": "double", "min": "double", "max": "double", "zeros": "bigint",
    "empty_string": "bigint", "whitespace_only": "bigint",
    "avg_len": "double", "min_len": "bigint", "max_len": "bigint", "long_values": "bigint",
    "sep_1": "bigint", "sep_2": "bigint", "sep_3": "bigint",
    "min_year": "bigint", "max_year": "bigint", "year_hits": "bigint",
    "bytes": "bigint", "one_value": "boolean",
}
# Which measures a scan computes besides rows and non_null.
PARTS = {
    "numeric": ("nan_count", "mean", "std", "min", "max", "zeros"),
    "text": ("empty_string", "whitespace_only", "avg_len", "min_len", "max_len"),
    "lists": ("long_values", "sep_1", "sep_2", "sep_3"),
    "years": ("min_year", "max_year", "year_hits"),
    "bytes": ("bytes",),
    "constant": ("one_value",),
}
# A profile counts distinct values, which show its constants.
PROFILE_PARTS = tuple(p for p in PARTS if p != "constant")


def is_temporal_name(name: str, mode: str) -> bool:
    lower = name.lower()
    if mode == "token":
        words = "".join(ch if ch.isalnum() else " " for ch in lower).split()
        return any(part in words for part in TEMPORAL_NAME_PARTS)
    return any(part in lower for part in TEMPORAL_NAME_PARTS)


def column_measures(field: T.StructField, parts, cfg: ProfileConfig) -> dict[str, str]:
    """Measure -> SQL text of the aggregate, for those that suit the column's type and name."""
    c, dtype = ref(field.name), field.dataType
    out = {"non_null": f"count({c})"}
    if is_numeric(dtype):
        x = number(field)
        # The deviation of a constant, merged from many tasks, may not be quite zero.
        std = f"case when count({x}) > 1 and min({x}) = max({x}) then 0D else stddev_samp({x}) end"
        out.update(mean=f"avg({x})", std=std, min=f"min({x})", max=f"max({x})",
                   zeros=f"count_if({x} = 0)")
        out["one_value"] = f"min({c}) = max({c})"  # null without any value; NaN equals NaN
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            out["nan_count"] = f"count_if(isnan({c}))"
    if is_text(dtype):
        s = text(field)
        out.update(empty_string=f"count_if({s} = '')",
                   whitespace_only=f"count_if({s} rlike {literal(BLANK)})",
                   avg_len=f"avg(length({s}))", min_len=f"min(length({s}))",
                   max_len=f"max(length({s}))",
                   long_values=f"count_if(length({s}) > {cfg.long_text_length})")
        for i, sep in enumerate(LIST_SEPARATORS, 1):
            out[f"sep_{i}"] = f"count_if(contains({s}, {literal(sep)}))"
    if is_temporal_name(field.name, cfg.temporal_mode):
        year = first_year(field, YEAR_PATTERN)
        out.update(min_year=f"min({year})", max_year=f"max({year})", year_hits=f"count({year})")
    out["bytes"] = logical_bytes(field)
    wanted = {"non_null", *(m for p in parts for m in PARTS[p])}
    return {name: expr for name, expr in out.items() if name in wanted}


def column_facts(df: DataFrame, cfg: ProfileConfig, parts=PROFILE_PARTS) -> DataFrame:
    """(column, position, dtype, type_class, rows, non_null, and the measures of `parts`): one
    row per column."""
    kept = ["rows", "non_null", *dict.fromkeys(m for p in parts for m in PARTS[p])]
    planned = [(i, f, column_measures(f, parts, cfg)) for i, f in enumerate(df.schema.fields)]
    chunks: list[list] = [[]]
    used = 0
    for item in planned:
        if chunks[-1] and used + len(item[2]) > cfg.aggregates_per_scan:
            chunks.append([])
            used = 0
        chunks[-1].append(item)
        used += len(item[2])
    return union_all([_facts_of(df, chunk, kept) for chunk in chunks])


def _facts_of(df: DataFrame, chunk: list, kept: list[str]) -> DataFrame:
    wide = df.selectExpr("count(1) as rows", *[
        f"{agg} as `{i}_{name}`" for i, _, measures in chunk for name, agg in measures.items()])
    rows = []
    for i, field, measures in chunk:
        row = {"column": literal(field.name), "position": f"{i}L",
               "dtype": literal(field.dataType.simpleString()),
               "type_class": literal(type_class(field.dataType))}
        for name in kept:
            value = "rows" if name == "rows" else f"`{i}_{name}`" if name in measures else "null"
            row[name] = f"cast({value} as {MEASURES[name]})"
        rows.append(row)
    if not rows:  # a table without columns has no facts, but keeps the schema
        names = {"column": "string", "position": "bigint", "dtype": "string", "type_class": "string",
                 **{name: MEASURES[name] for name in kept}}
        return wide.selectExpr(*[f"cast(null as {t}) as {ref(n)}" for n, t in names.items()]).where("false")
    return rows_of(wide, rows)


def text_fields(df: DataFrame) -> list[T.StructField]:
    return fields(df, is_text)


def numeric_fields(df: DataFrame) -> list[T.StructField]:
    return fields(df, is_numeric)

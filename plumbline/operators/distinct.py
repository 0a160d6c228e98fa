"""Distinct values and value frequencies of many columns in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.config import ProfileConfig
from plumbline.functions.columns import is_nested, literal, pick, ref, rows_of, text
from plumbline.operators.sampling import profile_rows

# Longer values travel as their SHA-256 in hex. Shorter ones stay themselves, so the
# two kinds cannot meet.
DIGEST_LENGTH = 64


def _lanes(field: T.StructField, whole_text: bool) -> dict[str, str]:
    """A value as integer, double or text, in the lane its type belongs to."""
    c, dtype = ref(field.name), field.dataType
    lanes = {"v_int": "cast(null as bigint)", "v_num": "cast(null as double)",
             "v_text": "cast(null as string)"}
    if isinstance(dtype, (T.BooleanType, T.IntegralType)):
        lanes["v_int"] = f"cast({c} as bigint)"
    elif isinstance(dtype, T.DateType):
        lanes["v_int"] = f"cast(unix_date({c}) as bigint)"
    elif isinstance(dtype, T.TimestampType):
        lanes["v_int"] = f"unix_micros({c})"
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        lanes["v_num"] = f"cast({c} as double)"
    elif isinstance(dtype, T.TimestampNTZType) and not whole_text:
        # Day and second of the day together, without formatting the value.
        lanes["v_int"] = f"cast(unix_date(cast({c} as date)) as bigint)"
        lanes["v_num"] = (f"cast(hour({c}) * 3600 + minute({c}) * 60 + "
                          f"extract(second from {c}) as double)")
    else:
        s = text(field)
        short = whole_text or isinstance(dtype, T.DecimalType)
        lanes["v_text"] = s if short else \
            f"case when octet_length({s}) < {DIGEST_LENGTH} then {s} else sha2({s}, 256) end"
    return lanes


def has_value() -> Column:
    return F.expr("v_int is not null or v_num is not null or v_text is not null")


def value_groups(df: DataFrame, fields: list[T.StructField], whole_text: bool = False,
                 keep_null: bool = False) -> DataFrame:
    """(field, v_int, v_num, v_text, n): how often each value occurs, null apart on request.

    One pass over the table for all the columns. Values are counted within each task
    before the shuffle, so a value that fills a third of the table costs one row per
    task, and typed lanes spare formatting every number.
    """
    values = rows_of(df, [{"field": str(i), **_lanes(f, whole_text)} for i, f in enumerate(fields)])
    return ((values if keep_null else values.where(has_value()))
            .groupBy("field", "v_int", "v_num", "v_text").agg(F.expr("count(1) as n")))


def field_name(fields: list[T.StructField], index: str = "field") -> Column:
    return F.expr(pick([f.name for f in fields], index))


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column string, unique_non_null bigint")


def _words(values: DataFrame) -> DataFrame:
    """Rows of lanes with integers as their place in a bitmap: a word of 64 values (v_int) and the bit in it. A double of at most two
    decimals is the integer of its hundredths: no other double gives the same one back.

    The steps are projections after one another, so that each expression is compiled once, for all columns.
    """
    hundredths = "case when v_int is null and abs(v_num) < 1e13D then cast(rint(v_num * 100D) as bigint) end as h"
    whole = values.selectExpr("field", "v_int", "v_num", "v_text", hundredths).selectExpr("field", "v_int", "v_num", "v_text", "case when h / 100D = v_num then h end as h")
    placed = whole.selectExpr("field", "coalesce(v_int, h) as place", "case when h is null then v_num end as v_num", "v_text")
    return placed.selectExpr("field", "shiftright(place, 6) as v_int", "v_num", "v_text", "coalesce(shiftleft(1L, cast(place & 63L as int)), 1L) as bit")


def exact_distinct(df: DataFrame, fields: list[T.StructField] | None = None) -> DataFrame:
    """(column, unique_non_null) for the columns that hold any value.

    One pass and one shuffle for all columns. Integers, dates and amounts travel as words of a bitmap, 64 adjacent values to a
    row: a dense key costs a third of a byte a value, one without order no more than itself. Words are merged in each task first.
    """
    fields = df.schema.fields if fields is None else fields
    if not fields:
        return _none(df)
    values = rows_of(df, [{"field": str(i), **_lanes(f, False)} for i, f in enumerate(fields)]).where(has_value())
    words = _words(values).groupBy("field", "v_int", "v_num", "v_text").agg(F.expr("bit_or(bit) as bits"))
    return (words.groupBy("field").agg(F.expr("sum(bit_count(bits)) as unique_non_null"))
            .select(field_name(fields).alias("column"), "unique_non_null"))


def approx_distinct(df: DataFrame, cfg: ProfileConfig,
                    fields: list[T.StructField] | None = None) -> DataFrame:
    """(column, unique_non_null) from HyperLogLog sketches, without a data shuffle.

    Sketches merge in two steps: first into `merge_slots` groups spread over the
    cluster, then into one, so that no single task merges one sketch per input task.
    """
    fields = df.schema.fields if fields is None else fields
    if not fields:
        return _none(df)
    each = range(len(fields))
    hashes = []
    for i, f in enumerate(fields):
        c = ref(f.name)
        hashes.append(f"case when {c} is not null then "
                      f"xxhash64({text(f) if is_nested(f.dataType) else c}) end as h{i}")
    merged = (df.selectExpr(f"spark_partition_id() % {cfg.merge_slots} as slot", *hashes)
              .groupBy("slot").agg(*[F.expr(f"hll_sketch_agg(h{i}, {cfg.sketch_lg_k}) as s{i}") for i in each])
              .selectExpr(*[f"hll_sketch_estimate(hll_union_agg(s{i})) as u{i}" for i in each]))
    return rows_of(merged, [{"column": literal(f.name), "unique_non_null": f"coalesce(u{i}, 0L)"}
                            for i, f in enumerate(fields)]).where("unique_non_null > 0")


def distinct_counts(df: DataFrame, cfg: ProfileConfig,
                    fields: list[T.StructField] | None = None) -> DataFrame:
    if cfg.unique_mode == "approx":
        return approx_distinct(df, cfg, fields)
    if cfg.unique_mode == "sample":
        return exact_distinct(profile_rows(df, cfg).df, fields)
    return exact_distinct(df, fields)


def value_text(fields: list[T.StructField]) -> Column:
    """The text of a value held in the lanes of `value_groups`."""
    cases = []
    for i, f in enumerate(fields):
        dtype, shown = f.dataType, "v_text"
        if isinstance(dtype, T.BooleanType):
            shown = "cast(v_int = 1 as string)"
        elif isinstance(dtype, T.IntegralType):
            shown = "cast(v_int as string)"
        elif isinstance(dtype, T.DateType):
            shown = "cast(date_from_unix_date(cast(v_int as int)) as string)"
        elif isinstance(dtype, T.TimestampType):
            shown = "cast(timestamp_micros(v_int) as string)"
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            shown = f"cast(cast(v_num as {dtype.simpleString()}) as string)"
        cases.append(f"when {i} then {shown}")
    return F.expr(f"case field {' '.join(cases)} end")

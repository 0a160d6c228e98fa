"""Column references, type classes and null-aware expressions.

Expressions repeated for every column of a table are SQL text: a table of a thousand columns
becomes one call to Spark instead of many thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

WHITE_SPACE_ENDS = r"(?U)^\s+|\s+$"
BLANK = r"(?U)\A\s*\z"


def quoted(name: str) -> Column:
    """The column called exactly `name`, whatever dots, spaces or backticks it holds."""
    return F.col(ref(name))


def ref(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType, T.NullType))


def is_categorical(dtype: T.DataType) -> bool:
    return is_text(dtype) or isinstance(dtype, T.BooleanType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def type_class(dtype: T.DataType) -> str:
    """numeric, text, bool or other."""
    if is_numeric(dtype):
        return "numeric"
    if is_text(dtype):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "other"


def fields(df: DataFrame, keep=lambda dtype: True) -> list[T.StructField]:
    return [f for f in df.schema.fields if keep(f.dataType)]


def only(df: DataFrame, kept: list[T.StructField]) -> DataFrame:
    return df.selectExpr(*[ref(f.name) for f in kept])


def number(field: T.StructField) -> str:
    """A numeric column as double, with NaN read as missing and -0.0 as 0.0."""
    c = f"cast({ref(field.name)} as double)"
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return f"(nanvl({c}, cast(null as double)) + 0D)"
    return c


def text(field: T.StructField) -> str:
    """A column's value as one string; nested values become JSON."""
    c, dtype = ref(field.name), field.dataType
    if isinstance(dtype, T.MapType):
        c = f"array_sort(map_entries({c}))"  # equal maps may list their entries differently
    if is_nested(dtype):
        return (f"to_json({c}, map('ignoreNullFields', 'false', "
                "'timestampFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSSXXX', "
                "'timestampNTZFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSS'))")
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BinaryType):
        return f"hex({c})"
    if isinstance(dtype, T.TimestampType):
        # The text form of an instant is ambiguous when clocks go back.
        return f"cast(unix_micros({c}) as string)"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"cast({c} + cast(0 as {dtype.simpleString()}) as string)"
    return f"cast({c} as string)"


def strip(c: Column) -> Column:
    """Remove white space, Unicode kinds included, from both ends."""
    return F.regexp_replace(c, WHITE_SPACE_ENDS, "")


def is_blank(c: Column) -> Column:
    return c.rlike(BLANK)


def percent(part: Column, whole: Column) -> Column:
    """part / whole x 100, and 0 where there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole) * 100.0, F.lit(0.0))


def first_year(field: T.StructField, pattern: str) -> str:
    """The first year from 1900 to 2099 in the text form of a value, else null."""
    c = ref(field.name)
    shown = text(field) if is_nested(field.dataType) or isinstance(field.dataType, T.BinaryType) \
        else f"cast({c} as string)"
    found = f"cast(nullif(regexp_extract({shown}, {literal(pattern)}, 1), '') as int)"
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        # A date prints its year first, so the year itself is the first match.
        return f"case when year({c}) between 1900 and 2099 then year({c}) else {found} end"
    return found


def nearest_rank(n: int, q: float) -> int:
    """0-based index of the q quantile of n sorted values, nearest rank, halves up."""
    return int((n - 1) * q + 0.5)


FIXED_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8,
    T.TimestampNTZType: 8, T.DecimalType: 16,
}


def fixed_width(dtype: T.DataType) -> int | None:
    return FIXED_WIDTHS.get(type(dtype))


def logical_bytes(field: T.StructField) -> str:
    """Aggregate: bytes the non-null values of a column hold, encoding apart."""
    c, dtype = ref(field.name), field.dataType
    if fixed_width(dtype) is not None:
        return f"count({c}) * {fixed_width(dtype)}"
    if isinstance(dtype, T.ArrayType) and fixed_width(dtype.elementType) is not None:
        items = f"size(filter({c}, x -> x is not null))"
        return f"coalesce(sum({items} * {fixed_width(dtype.elementType)}), 0)"
    if isinstance(dtype, T.BinaryType):
        return f"coalesce(sum(octet_length({c})), 0)"
    return f"coalesce(sum(octet_length({text(field)})), 0)"


def rows_of(frame: DataFrame, rows: list[dict[str, str]]) -> DataFrame:
    """One output row per dict of column name -> SQL text, from each row of `frame`."""
    structs = ["struct(" + ", ".join(f"{expr} as {ref(name)}" for name, expr in row.items()) + ")"
               for row in rows]
    return frame.selectExpr("inline(array(" + ", ".join(structs) + "))")


def pick(values: list[str], index: str) -> str:
    """The literal in `values` at a 0-based index, as SQL text."""
    return f"element_at(array({', '.join(map(literal, values))}), {index} + 1)"


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def local_frame(df: DataFrame) -> DataFrame:
    """Evaluate a frame whose size is bounded by the schema (one row per column, say)
    once, so that the reports derived from it do not scan the table again."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)

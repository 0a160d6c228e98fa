"""Text columns that hold delimited lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.config import LIST_SEPARATORS, ProfileConfig
from plumbline.functions.columns import WHITE_SPACE_ENDS, literal, only, ref, rows_of, text
from plumbline.operators.facts import column_facts, text_fields
from plumbline.operators.frequent import top_values


def is_prose(cfg: ProfileConfig) -> Column:
    """Whether more than `long_text_share_pct` of a column's values are long, by its facts."""
    return F.coalesce(F.col("long_values") * 100.0 > F.col("non_null") * cfg.long_text_share_pct, F.lit(False))


def list_columns(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None) -> DataFrame:
    """(column, separator, rows_with_separator_pct) for the columns found to be lists.

    A separator counts where the text literally contains it; the one in most rows wins,
    the earlier on a tie. Columns with too large a share of long values are prose.
    """
    if facts is None:
        facts = column_facts(only(df, text_fields(df)), cfg, ["lists"])
    hits = [F.col(f"sep_{i}") for i in range(1, len(LIST_SEPARATORS) + 1)]
    best = F.greatest(*hits)
    separator = F.coalesce(*[F.when(h == best, F.lit(s)) for h, s in zip(hits, LIST_SEPARATORS)])
    share = F.try_divide(best.cast("double"), F.col("non_null")) * 100.0
    return (facts.where((F.col("type_class") == "text") & (best > 0)
                        & ~is_prose(cfg))
            .select("column", separator.alias("separator"), share.alias("rows_with_separator_pct"))
            .where(F.col("rows_with_separator_pct") >= cfg.list_min_share_pct)
            .orderBy(F.desc("rows_with_separator_pct"), "column"))


def _found(df: DataFrame, cfg: ProfileConfig, lists: DataFrame | None) -> list[tuple[str, str]]:
    lists = list_columns(df, cfg) if lists is None else lists
    return [(r["column"], r["separator"]) for r in lists.collect()]  # at most one per column


def _items(df: DataFrame, column: str, separator: str) -> str:
    return f"split({text(df.schema[column])}, {literal(chr(92) + 'Q' + separator + chr(92) + 'E')}, -1)"


def list_profile(df: DataFrame, cfg: ProfileConfig, lists: DataFrame | None = None) -> DataFrame:
    """Detected lists plus avg, p50, p90 and max number of items per non-null cell.

    Items per cell are grouped by their number first: the quantiles come from that table.
    """
    lists = list_columns(df, cfg) if lists is None else lists
    found = _found(df, cfg, lists)
    spark = df.sparkSession
    if not found:
        return spark.createDataFrame([], "column string, separator string, rows_with_separator_pct double, "
                                         "avg_items double, p50_items bigint, p90_items bigint, max_items bigint")
    sizes = [{"column": literal(c), "items": f"case when {ref(c)} is not null then size({_items(df, c, s)}) end"}
             for c, s in found]
    counts = (rows_of(df, sizes).where("items IS NOT NULL")
              .groupBy("column", "items").agg(F.expr("count(1) as n")))
    return (lists.join(F.broadcast(quantiles_of_counts(counts, "column", "items", (0.50, 0.90))), "column")
            .select("column", "separator", "rows_with_separator_pct",
                    F.col("avg").alias("avg_items"), F.col("q0").alias("p50_items").cast("bigint"),
                    F.col("q1").alias("p90_items").cast("bigint"),
                    F.col("max").alias("max_items").cast("bigint"))
            .orderBy(F.desc("rows_with_separator_pct"), "column"))


def quantiles_of_counts(counts: DataFrame, key: str, value: str, quantiles) -> DataFrame:
    """(key, avg, min, max, q0, q1, ...) of a frequency table (key, value, n) of small integers,
    quantiles by nearest rank."""
    order = Window.partitionBy(key).orderBy(value)
    ranked = (counts.withColumn("upto", F.sum("n").over(order))
              .withColumn("total", F.sum("n").over(Window.partitionBy(key))))
    picks = []
    for i, q in enumerate(quantiles):
        rank = F.floor((F.col("total") - 1) * F.lit(q) + 0.5)
        picks.append(F.min(F.when(F.col("upto") > rank, F.col(value))).alias(f"q{i}"))
    return ranked.groupBy(key).agg(
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("avg"),
        F.min(value).alias("min"), F.max(value).alias("max"), *picks)


def list_tokens(df: DataFrame, cfg: ProfileConfig, lists: DataFrame | None = None) -> DataFrame:
    """(column, token, count): the most frequent tokens of each detected list."""
    found = _found(df, cfg, lists)
    if not found:
        return df.sparkSession.createDataFrame([], "column string, token string, count bigint")
    ends, separators = literal(WHITE_SPACE_ENDS), dict(found)

    def tokens(frame: DataFrame, cells: list[dict[str, str]]) -> DataFrame:
        split = [f"transform({_items(frame, c['field'], separators[c['field']])}, item -> struct({literal(c['field'])} as field, "
                 f"regexp_replace(item, {ends}, '') as value))" for c in cells]
        return frame.selectExpr(f"inline(flatten(array_compact(array({', '.join(split)}))))")

    top = top_values(df, [{"field": c} for c, _ in found], cfg.list_top_tokens, cfg, make=tokens, where="value <> ''")
    shown = F.col("value") if cfg.list_token_length is None else F.substring("value", 1, cfg.list_token_length)
    return top.orderBy("field", "place").select(F.col("field").alias("column"), shown.alias("token"), F.col("n").alias("count"))

"""The most frequent values of many columns.

A summary of at most `frequent_items` values a column is kept by every task and merged: it holds every value
that makes up more than a small, known share of the rows. Those values are counted exactly in a second scan, and
only their counts move. If the k-th of them is more frequent than any value outside the summary can be, the
ranking is settled, however many values the column has. Only columns where it is not, such as one of
nearly unique values, are counted in full, by a shuffle of (value, count).

A ranking of many is taken in two steps, first within slots of the values' hashes, so that no task sorts all values of a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import literal, rows_of, union_all

SLOTS = 64
#: Up to this k Spark keeps k rows of each field in every task before a ranking is shuffled, so slots are not needed.
GROUP_LIMIT = 1000


def value_rows(df: DataFrame, cells: list[dict[str, str]]) -> DataFrame:
    return rows_of(df, [{"field": literal(c["field"]), "value": c["value"]} for c in cells])


def ranked(counts: DataFrame, k: int, field: str = "field", value: str = "value", n: str = "n") -> DataFrame:
    """The k rows with the highest n of each field (the smaller value first on a tie), with their `place`, from 1."""
    order = [F.desc(n), value]
    if k <= GROUP_LIMIT:
        return counts.withColumn("place", F.row_number().over(Window.partitionBy(field).orderBy(*order))).where(F.col("place") <= k)
    slot = F.pmod(F.xxhash64(value), F.lit(SLOTS))
    near = Window.partitionBy(field, "slot").orderBy(*order)
    some = counts.withColumn("slot", slot).withColumn("place", F.row_number().over(near)).where(F.col("place") <= k).drop("slot", "place")
    return some.withColumn("place", F.row_number().over(Window.partitionBy(field).orderBy(*order))).where(F.col("place") <= k)


def _counted(values: DataFrame) -> DataFrame:
    return values.groupBy("field", "value").agg(F.expr("count(1) as n"))


def error_share(items: int) -> float:
    """The share of the rows that a value missing from a merged summary of that many items can have at most: a summary is a
    table of a power of two of places, three quarters of them in use, and errs by 3.5 places' worth of rows."""
    places = 1 << max(3, (items * 4 // 3 - 1).bit_length())
    return 3.5 / places


def _summaries(values: DataFrame, items: int, slots: int) -> DataFrame:
    """(field, rows, items): the rows of each field and the values its summary holds, with estimated counts."""
    slot = F.expr(f"spark_partition_id() % {slots}").alias("slot")
    return (values.groupBy("field", slot).agg(F.expr(f"approx_top_k_accumulate(value, {items}) as s"), F.expr("count(1) as rows"))
            .groupBy("field").agg(F.expr(f"approx_top_k_combine(s, {items}) as s"), F.expr("sum(rows) as rows"))
            .selectExpr("field", "rows", f"approx_top_k_estimate(s, {items}) as items"))


def top_values(df: DataFrame, cells: list[dict[str, str]], k: int, cfg: ProfileConfig, distinct: list[int | None] | None = None,
               make=value_rows, where: str = "value is not null") -> DataFrame:
    """(field, value, n, place): the k most frequent values of each of the cells {field: name, value: SQL text of a
    string}, with their exact counts.

    `distinct`: the number of values of each cell where it is known, about; columns with few are counted in full at once.
    `make`: what makes rows (field, value) of the table and some of the cells.
    """
    few = cfg.frequent_items
    known = distinct or [None] * len(cells)
    # A field of few values is counted in full as cheaply as it is summarised.
    full = [c for c, d in zip(cells, known) if d is not None and d <= few]
    open_ = [c for c, d in zip(cells, known) if d is None or d > few]
    frames = []
    if open_ and k < few:
        settled, rest = _settled(df, open_, k, cfg, make, where)
        frames += settled
        full += rest
    else:
        full += open_
    if full:
        frames.append(_counted(make(df, full).where(where)))
    return ranked(union_all(frames), k)


def _settled(df, cells, k, cfg, make, where) -> tuple[list[DataFrame], list[dict[str, str]]]:
    """Exact counts of the candidates of the fields whose ranking they settle, and the cells of the others."""
    spark, values, share = df.sparkSession, make(df, cells).where(where), error_share(cfg.frequent_items)
    found = _summaries(values, cfg.frequent_items, cfg.merge_slots).selectExpr(
        "field", "rows", "items", f"get(items, least({k}, size(items)) - 1).count as kth", f"rows * {share!r}D as error")
    # A value among the first k is estimated at no less than the k-th, but for the error.
    promising = found.where(f"kth > error or size(items) < {k}").select(
        "field", "rows", "error", F.explode(F.filter("items", lambda x: x["count"] >= F.col("kth") - F.col("error"))).alias("item"))
    listed = promising.select("field", "rows", "error", F.col("item.item").alias("value")).toArrow()  # at most frequent_items a field
    if not listed.num_rows:
        return [], cells
    candidates = spark.createDataFrame(listed)
    counts = values.join(F.broadcast(candidates), ["field", "value"]).groupBy("field", "value").agg(F.expr("count(1) as n"), F.first("rows").alias("rows"), F.first("error").alias("error"))
    counts = spark.createDataFrame(counts.toArrow())
    order = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    last = counts.withColumn("place", F.row_number().over(order)).groupBy("field").agg(
        F.max(F.when(F.col("place") == k, F.col("n"))).alias("kth"), F.sum("n").alias("seen"), F.max("rows").alias("rows"), F.max("error").alias("error"))
    # settled: the k-th is more frequent than any value outside the summary, or no row holds another value
    done = [r["field"] for r in last.where("kth > error or seen = rows").collect()]
    rest = [c for c in cells if c["field"] not in done]
    return ([counts.where(F.col("field").isin(done)).select("field", "value", "n")] if done else []), rest

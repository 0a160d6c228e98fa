"""Row counts, head and random samples, and names for datasets."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import quoted

#: Hexadecimal digits of a digest that rows are counted by at once, and rows of one such beginning that are ordered.
DIGITS = 4
EDGE = 1 << 16


@dataclass(frozen=True)
class ProfiledRows:
    df: DataFrame
    sampled: bool
    rows_total: int | None  # known only when a sample was asked for


def head_rows(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows in the order of `order_by`, or else in the order of the files.

    Without an order only as many files are opened as hold n rows: a limit alone would have
    every task of a large scan read n rows. An order is meant for small n, which every task
    keeps while it scans.
    """
    if order_by:
        return df.orderBy(*[quoted(c) for c in order_by]).limit(n)
    return _first_files(df, n).limit(n)


def _forms(file: str) -> list[str]:
    """A file as the ways in which a scan may name it: with or without an empty host, escaped or not."""
    return sorted({f for path in (file, unquote(file)) for f in (path, path.replace(":///", ":/", 1))})


def _first_files(df: DataFrame, n: int) -> DataFrame:
    """The rows of the first files that together hold n rows, if the frame is a file scan."""
    try:
        path = df.select("_metadata.file_path")
    except AnalysisException:
        return df
    files = sorted(df.inputFiles())
    k = 1
    while k < len(files):
        first = [f for file in files[:k] for f in _forms(file)]
        if path.where(F.col("file_path").isin(first)).count() >= n:
            return df.where(F.col("_metadata.file_path").isin(first))
        k *= 2
    return df


def random_rows(df: DataFrame, n: int, seed: int, key: list[str] | None = None) -> DataFrame:
    """Exactly n rows (all when there are fewer), drawn without replacement.

    The draw is the n rows with the smallest MD5 of seed and key, or of seed and all columns without a
    `key`: the same rows on any cluster and any file layout, and in every scan of the result.
    """
    return draw(df, n, seed, key)[0]


def draw(df: DataFrame, n: int, seed: int, key: list[str] | None = None) -> tuple[DataFrame, int]:
    """random_rows, and the number of rows it has drawn from.

    One scan counts the rows by the first digits of their digests; such counts add up over tasks, and the driver sees
    BUCKETS of them. They show which digests are drawn, but for those that begin like the last one: these, a
    few rows, are ordered. All other rows are filtered in the scan, so the sample stays spread over the cluster.
    """
    by = [quoted(c) for c in key] if key else [F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"})]
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in by]
    drawn = df.withColumn("__digest", F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *parts))))
    prefix, total, below = "", None, 0
    while total is None or (held > EDGE and len(prefix) < 32):  # more than once only for billions of rows, or for a key that is none
        own = drawn.where(F.startswith("__digest", F.lit(prefix))) if prefix else drawn
        counts = dict(own.groupBy(F.substring("__digest", len(prefix) + 1, DIGITS).alias("next")).count().collect())
        if total is None:
            total = sum(counts.values())
            if total <= n:
                return df, total
            if n <= 0:
                return df.limit(0), total
        for digits in sorted(counts):
            held = counts[digits]
            if below + held >= n:
                break
            below += held
        prefix += digits
    sure = drawn.where(F.col("__digest") < prefix)
    edge = drawn.where(F.startswith("__digest", F.lit(prefix)))
    if n - below < held:
        edge = edge.orderBy("__digest", *by).limit(n - below)
    return sure.unionAll(edge).drop("__digest"), total


def profile_rows(df: DataFrame, cfg: ProfileConfig, key: list[str] | None = None) -> ProfiledRows:
    """The rows a profile reads: all of them unless the configuration caps their number."""
    cap = cfg.sample_rows
    if cap is None or cap <= 0:
        return ProfiledRows(df, False, None)
    if cfg.sample_strategy == "random":
        rows, total = draw(df, cap, cfg.sample_seed, key)
        return ProfiledRows(rows, total > cap, total)
    total = df.count()
    return ProfiledRows(head_rows(df, cap, key) if total > cap else df, total > cap, total)


def sampling_note(rows: ProfiledRows, cfg: ProfileConfig) -> str | None:
    if not rows.sampled:
        return None
    return (f"Profiled on a sample of {min(cfg.sample_rows, rows.rows_total)} rows "
            f"(of {rows.rows_total} total) using strategy={cfg.sample_strategy}.")


def sampling_notes(df: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """(note): the sampling note as a frame of no or one row, from a count of the rows."""
    cap = cfg.sample_rows or 0
    count = df.agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > cap) & F.lit(cap > 0))
    return count.select(F.format_string(f"Profiled on a sample of {cap} rows (of %d total) using strategy={cfg.sample_strategy}.", "n").alias("note"))


def dataset_id(path: Column, sheet: Column) -> Column:
    """First 8 hex digits of SHA-1 over path and sheet."""
    return F.substring(F.sha1(F.concat(path, F.lit("::sheet="), F.coalesce(sheet, F.lit("None")))), 1, 8)


def slug(name: Column) -> Column:
    """A name fit for a directory: letters, digits, - and _, at most 60 characters."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", ""),
                              r"(?U)\s", "_")
    kept = F.substring(F.regexp_replace(spaced, r"[^\p{L}\p{N}_-]", ""), 1, 60)
    return F.when(kept == "", "dataset").otherwise(kept)

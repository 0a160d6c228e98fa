"""Reports over many tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import local_frame, percent, union_all
from plumbline.operators import quality
from plumbline.operators.distinct import distinct_counts
from plumbline.operators.facts import column_facts
from plumbline.operators.lists import quantiles_of_counts
from plumbline.operators.overview import duplicate_rows
from plumbline.operators.sampling import ProfiledRows, dataset_id, profile_rows, slug
from plumbline.operators.schema import row_missing_quantiles
from plumbline.plans.profile import TableProfile

NOTES = (
    "Tables whose status is not ok could not be read in full; they count in datasets_failed.",
    "Years are taken from columns whose names contain a date word, whatever their type.",
    "Distinct counts are sketched unless unique_mode is exact.",
)
ID = ["dataset_id", "dataset_name", "sheet_name"]


def _first(frame: DataFrame, limit: int | None) -> DataFrame:
    return frame if limit is None else frame.limit(limit)


@dataclass(frozen=True)
class Dataset:
    """A table of the catalog. `path` and `sheet` together identify it."""
    name: str
    df: DataFrame
    path: str
    sheet: str | None = None


class Catalog:
    """Reports over many tables.

    Per-table facts have one row per column or per table. They are computed once, several
    tables at a time, and the roll-ups are queries over them: their size depends on
    the number of columns in the catalog, not on rows.
    """

    def __init__(self, spark: SparkSession, datasets: list[Dataset], cfg: ProfileConfig | None = None,
                 files_found: int | None = None):
        self.spark = spark
        self.cfg = cfg or ProfileConfig()
        self.datasets = datasets
        self.files_found = len({d.path for d in datasets}) if files_found is None else files_found
        self.notes: list[tuple[int, str]] = []  # (table number, what failed)
        self._rows: dict[int, ProfiledRows] = {}
        self._tables: dict[int, TableProfile] = {}

    def _profiled(self, i: int) -> ProfiledRows:
        if i not in self._rows:
            self._rows[i] = profile_rows(self.datasets[i].df, self.cfg)
        return self._rows[i]

    def _each(self, name: str, report: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
        """`report` of every table, with the table's number `ds`.

        One job per table, several at a time: tables are independent, and together they keep
        the cluster busy. A table whose job fails has no rows here and is noted; the index keeps it.
        """
        return self._gathered(name, lambda i: report(self._profiled(i).df), schema)

    def family(self, report: str) -> DataFrame:
        """(dataset_id, dataset_name, sheet_name, ...): a report of TableProfile for all tables of the catalog in one frame. Families
        share the scans of each table. Reports whose columns are the table's own have none."""
        def one(i: int) -> DataFrame:
            if i not in self._tables:
                self._tables[i] = TableProfile(self._profiled(i).df, self.cfg)
            return getattr(self._tables[i], report)

        found = self._gathered(report, one, "ds int")
        return self._named(found).drop("ds")

    def _gathered(self, name: str, make: Callable[[int], DataFrame], schema: str) -> DataFrame:
        def one(i: int) -> pa.Table | None:
            try:
                found = make(i).withColumn("ds", F.lit(i)).toArrow()
                return found.cast(pa.schema([f.with_nullable(True) for f in found.schema]))
            except Exception as e:
                self.notes.append((i, f"Report '{name}' failed: {e}"))
                return None

        with ThreadPoolExecutor(self.cfg.parallel_tables) as pool:
            parts = [t for t in pool.map(one, range(len(self.datasets))) if t is not None]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.createDataFrame(pa.concat_tables(parts))

    @cached_property
    def ids(self) -> DataFrame:
        """(ds, dataset_id, dataset_dir, source_path, dataset_name, sheet_name, rows_total, sampled)."""
        rows = []
        for i, d in enumerate(self.datasets):
            try:
                taken = self._profiled(i)
                rows.append((i, d.path, d.name, d.sheet, taken.rows_total, taken.sampled))
            except Exception as e:
                self.notes.append((i, f"Report 'sample' failed: {e}"))
                rows.append((i, d.path, d.name, d.sheet, None, False))
        named = self.spark.createDataFrame(
            rows, "ds int, source_path string, dataset_name string, sheet string, "
                  "rows_total bigint, sampled boolean")
        code = dataset_id(F.col("source_path"), F.col("sheet"))
        folder = F.concat_ws("__", code, slug(F.col("dataset_name")),
                             F.when(F.col("sheet").isNull(), "sheet-None").otherwise(slug(F.col("sheet"))))
        return local_frame(named.select("ds", code.alias("dataset_id"), folder.alias("dataset_dir"), "source_path",
                            "dataset_name", F.coalesce("sheet", F.lit("")).alias("sheet_name"),
                            "rows_total", "sampled"))

    def _named(self, frame: DataFrame) -> DataFrame:
        return frame.join(F.broadcast(self.ids.select("ds", *ID)), "ds")  # one row per table

    @cached_property
    def facts(self) -> DataFrame:
        return self._each(
            "facts", lambda df: column_facts(df, self.cfg, ["years", "bytes", "constant"]),
            "ds int, column string, position bigint, dtype string, type_class string, rows bigint, "
            "non_null bigint, min_year bigint, max_year bigint, year_hits bigint, bytes bigint, one_value boolean")

    @cached_property
    def _shapes(self) -> DataFrame:
        """rows, non_null and one_value of every column: of the facts, if they are there, else of a scan without years and bytes."""
        if "facts" in self.__dict__:
            return self.facts
        return self._each("facts", lambda df: column_facts(df, self.cfg, ["constant"]),
                          "ds int, column string, position bigint, dtype string, type_class string, rows bigint, "
                          "non_null bigint, one_value boolean")

    @cached_property
    def schema(self) -> DataFrame:
        """One row per column of the catalog."""
        unique = self._each("unique", lambda df: distinct_counts(df, self.cfg),
                            "ds int, column string, unique_non_null bigint")
        n = F.coalesce(F.col("unique_non_null"), F.lit(0))
        null = F.col("rows") - F.col("non_null")
        unique_all = n + (null > 0).cast("bigint")
        return local_frame(self._named(self.facts.join(F.broadcast(unique), ["ds", "column"], "left")).select(
            "ds", *ID, "position", "column", "dtype", "type_class", "non_null", null.alias("null"),
            percent(null, F.col("rows")).alias("null_pct"), unique_all.alias("unique"),
            F.try_divide(unique_all.cast("double"), F.col("non_null")).alias("unique_ratio")))

    @cached_property
    def _repeats(self) -> DataFrame:
        return self._each("duplicate_rows", lambda df: duplicate_rows(df, self.cfg), "ds int, rows bigint, duplicate_rows bigint, duplicate_row_pct double")

    @cached_property
    def datasets_index(self) -> DataFrame:
        """One row per table: size, missing cells, repeated rows."""
        return self._index(self.facts)

    def _index(self, facts: DataFrame) -> DataFrame:
        """datasets_index from facts; without their bytes the memory estimate is null."""
        repeats = self._repeats
        size = F.sum("bytes") if "bytes" in facts.columns else F.lit(None).cast("bigint")
        cells = facts.groupBy("ds").agg(
            F.count(F.lit(1)).alias("columns"),
            F.sum(F.col("rows") - F.col("non_null")).alias("missing_cells"),
            size.alias("memory_bytes_estimate"))
        # Every frame here has one row per table.
        empty = facts.select("ds").distinct().withColumn("has_facts", F.lit(True))
        joined = (self.ids.join(F.broadcast(repeats), "ds", "left").join(F.broadcast(cells), "ds", "left")
                  .join(F.broadcast(empty), "ds", "left").join(F.broadcast(self._failures), "ds", "left"))
        # A table without columns has no facts, and none have failed.
        none = F.col("has_facts").isNull() & F.col("failed").isNull()
        # Of a table that cannot be read in full, not even what a key column shows is reported.
        for c in ("rows", "duplicate_row_pct"):
            joined = joined.withColumn(c, F.when(F.col("has_facts").isNotNull() | none, F.col(c)))
        for c in ("columns", "missing_cells", "memory_bytes_estimate"):
            joined = joined.withColumn(c, F.when(none, F.lit(0)).otherwise(F.col(c)).cast("bigint"))
        return local_frame(joined.select(
            "ds", "dataset_id", "dataset_dir", "source_path", "dataset_name", "sheet_name",
            F.coalesce("rows_total", "rows").alias("rows"), F.col("rows").alias("rows_sample"),
            "sampled", "columns",
            percent(F.col("missing_cells"), F.col("rows") * F.col("columns")).alias("missing_cell_pct"),
            "duplicate_row_pct", "memory_bytes_estimate",
            F.coalesce(F.concat(F.lit("failed: "), F.col("failed")), F.lit("ok")).alias("status")))

    @property
    def _failures(self) -> DataFrame:
        """(ds, failed): the reports that failed so far, joined by commas; one row per table at most."""
        by: dict[int, set[str]] = {}
        for i, note in self.notes:
            by.setdefault(i, set()).add(note.split("'")[1] if "'" in note else note)
        return self.spark.createDataFrame([(i, ", ".join(sorted(x))) for i, x in by.items()], "ds int, failed string")

    @cached_property
    def totals(self) -> DataFrame:
        return self.datasets_index.agg(
            F.lit(self.files_found).cast("bigint").alias("files_found"),
            F.count_if(F.col("status") == "ok").alias("datasets_processed"),
            F.count_if(F.col("status") != "ok").alias("datasets_failed"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum("columns"), F.lit(0)).alias("total_columns"))

    @cached_property
    def dtype_composition(self) -> DataFrame:
        counts = self.facts.groupBy("dtype").agg(F.count(F.lit(1)).alias("count"))
        total = F.sum("count").over(Window.partitionBy())  # one row per type
        return counts.withColumn("pct", F.col("count") / total * 100.0).orderBy(F.desc("count"), "dtype")

    @cached_property
    def type_buckets(self) -> DataFrame:
        """Columns per type class of each table, by the type itself rather than its name."""
        kinds = ("numeric", "text", "bool", "other")
        counts = self.facts.groupBy("ds").agg(*[
            F.count_if(F.col("type_class") == k).alias(f"{k}_cols_est") for k in kinds])
        joined = self.datasets_index.select("ds", *ID, "status").join(F.broadcast(counts), "ds", "left")
        read = F.col("status") == "ok"
        return joined.select("ds", *ID, *[F.when(read, F.coalesce(f"{k}_cols_est", F.lit(0))).otherwise(F.col(f"{k}_cols_est")).alias(f"{k}_cols_est") for k in kinds])

    @cached_property
    def missingness(self) -> DataFrame:
        """One row per column; without the other facts, null counts alone are read."""
        missing = F.col("rows") - F.col("non_null")
        counts = self.__dict__.get("facts", self.__dict__.get("_shapes"))
        if counts is None:
            counts = self._each("missingness", lambda df: column_facts(df, self.cfg, ()),
                                "ds int, column string, rows bigint, non_null bigint")
        return local_frame(self._named(counts).select(
            "ds", *ID, "column", missing.alias("missing"),
            percent(missing, F.col("rows")).alias("missing_pct")))

    def _top(self, frame: DataFrame, limit: int | None, *order: Column) -> DataFrame:
        """The first `limit` rows of each table, or all; frames have one row per column."""
        if limit is None:
            return frame
        place = F.row_number().over(Window.partitionBy("ds").orderBy(*order))
        return frame.withColumn("place", place).where(F.col("place") <= limit)

    @cached_property
    def missing_hotspots(self) -> DataFrame:
        top = self._top(self.missingness, self.cfg.hotspot_limit, F.desc("missing_pct"), F.asc("column"))
        return (top.orderBy(F.desc("missing_pct"), "dataset_name", "sheet_name", "column")
                .transform(_first, self.cfg.hotspot_total_limit).select(*ID, "column", "missing_pct"))

    @cached_property
    def high_missing_columns(self) -> DataFrame:
        return (self.missingness.where(F.col("missing_pct") >= self.cfg.high_missing_pct)
                .orderBy(F.desc("missing_pct"), "dataset_name", "sheet_name", "column")
                .select(*ID, "column", "missing_pct"))

    @cached_property
    def _constant(self) -> DataFrame:
        """(ds, *ID, column): numeric columns with one value at most, null counted as one. The least and the largest value show
        it: nothing is shuffled and no distinct values are counted."""
        whole = (F.col("non_null") == F.col("rows")) & F.col("one_value")
        return local_frame(self._named(self._shapes).where((F.col("type_class") == "numeric") & ((F.col("non_null") == 0) | whole))
                           .select("ds", *ID, "column"))

    @cached_property
    def constant_columns(self) -> DataFrame:
        return (self._top(self._constant, self.cfg.constant_limit, F.asc("column"))
                .orderBy("dataset_name", "sheet_name", "column").select(*ID, "column"))

    @cached_property
    def high_cardinality(self) -> DataFrame:
        cfg = self.cfg
        rich = self.schema.where((F.col("type_class") == "text")
                                 & (F.col("non_null") >= cfg.cardinality_min_values)
                                 & (F.col("null_pct") <= cfg.cardinality_max_null_pct)
                                 & (F.col("unique_ratio") >= cfg.cardinality_min_ratio))
        return (self._top(rich, cfg.cardinality_limit, F.desc("unique_ratio"), F.asc("column"))
                .orderBy("dataset_name", "sheet_name", F.desc("unique_ratio"), "column")
                .select(*ID, "column", "dtype", "non_null", "unique", "unique_ratio", "null_pct"))

    @cached_property
    def high_uniqueness(self) -> DataFrame:
        """(ds, high_uniqueness_cols): the first key-like columns by name, joined by commas."""
        cfg = self.cfg
        likely = self.schema.where((F.col("non_null") >= cfg.key_min_values)
                                   & (F.col("null_pct") <= cfg.key_max_null_pct)
                                   & (F.col("unique_ratio") >= cfg.key_unique_ratio))
        top = self._top(likely, cfg.high_uniqueness_limit, F.asc("column"))
        return top.groupBy("ds").agg(
            F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("high_uniqueness_cols"))

    @cached_property
    def temporal_coverage(self) -> DataFrame:
        return self._temporal.where("datetime_cols_detected > 0").select(
            *ID, "datetime_cols_detected", "min_year", "max_year").orderBy("dataset_name", "sheet_name")

    @cached_property
    def _temporal(self) -> DataFrame:
        years = self.facts.groupBy("ds").agg(
            F.count_if(F.col("year_hits") > 0).alias("datetime_cols_detected"),
            F.min("min_year").alias("min_year"), F.max("max_year").alias("max_year"))
        return self._named(years)

    @cached_property
    def warnings(self) -> DataFrame:
        keys = ["ds", *ID]
        shape = self._constant.select(*keys, "column", F.lit(True).alias("is_constant"))
        index = self.__dict__["datasets_index"] if "datasets_index" in self.__dict__ else self._index(self._shapes)
        found = quality.quality_warnings(index, self.missingness, shape, self.cfg, keys)
        order = [F.asc(c) for c in ("rule", "column", "warning")]
        return (self._top(found, self.cfg.warning_limit, *order)
                .orderBy("dataset_name", "sheet_name", "rule", "column")
                .select(*ID, "rule", "column", "warning"))

    @cached_property
    def row_missingness(self) -> DataFrame:
        return self._each("row_missingness", lambda df: row_missing_quantiles(df, self.cfg),
                          "ds int, min_null_pct double, p50_null_pct double, p90_null_pct double, "
                          "p99_null_pct double, max_null_pct double, mean_null_pct double")

    @cached_property
    def sources_table(self) -> DataFrame:
        """One row per table with everything that describes the whole table, most rows first."""
        rows = self.row_missingness.select("ds", *[
            F.col(f"{q}_null_pct").alias(f"row_{q}_null_pct") for q in ("min", "p50", "p90", "p99", "max")])
        out = self.datasets_index.drop("dataset_dir")
        for part in (self.type_buckets.drop(*ID), self._temporal.drop(*ID), self.high_uniqueness, rows):
            out = out.join(F.broadcast(part), "ds", "left")  # one row per table
        return local_frame(
            out.withColumn("high_uniqueness_cols", F.coalesce("high_uniqueness_cols", F.lit("")))
            .withColumn("datetime_cols_detected", F.coalesce("datetime_cols_detected", F.lit(0)))
            .orderBy(F.desc("rows"), "dataset_name", "sheet_name").drop("ds"))

    @cached_property
    def missing_stats(self) -> DataFrame:
        """Average, median and p90 over tables of missing cells and repeated rows."""
        cols = ("missing_cell_pct", "duplicate_row_pct")
        long = self.datasets_index.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in cols])))
        counts = long.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n"))
        p90 = quantiles_of_counts(counts, "measure", "value", (0.90,))
        middle = long.groupBy("measure").agg(F.median("value").alias("p50"))
        both = p90.join(F.broadcast(middle), "measure")
        aggs = []
        for c in cols:
            at = lambda v, c=c: F.max(F.when(F.col("measure") == c, F.col(v)))
            aggs += [at("avg").alias(f"avg_{c}"), at("p50").alias(f"p50_{c}"), at("q0").alias(f"p90_{c}")]
        return both.agg(*aggs)

    @cached_property
    def top_datasets(self) -> DataFrame:
        keep = [*ID, "rows", "rows_sample", "sampled", "columns", "missing_cell_pct", "duplicate_row_pct",
                "numeric_cols_est", "text_cols_est", "datetime_cols_detected", "min_year", "max_year"]
        return (self.sources_table.orderBy(F.desc("rows"), "dataset_name", "sheet_name")
                .limit(self.cfg.top_datasets).select(*keep))

    def search(self, text: str = "", min_rows: int = 0, max_rows: int = 0,
               sort_by: str = "rows") -> DataFrame:
        """Tables whose name, path or sheet contains `text`, within the row bounds (0: none)."""
        df = self.datasets_index.drop("ds")
        if text.strip():
            needle = F.lit(text.strip().lower())
            df = df.where(F.contains(F.lower("dataset_name"), needle)
                          | F.contains(F.lower("source_path"), needle)
                          | F.contains(F.lower("sheet_name"), needle))
        df = df.where(F.col("rows") >= min_rows)
        if max_rows > 0:
            df = df.where(F.col("rows") <= max_rows)
        numeric = sort_by in ("rows", "columns", "missing_cell_pct", "duplicate_row_pct")
        return df.orderBy(F.desc(sort_by) if numeric else F.asc(sort_by), "dataset_name", "sheet_name")

    def missing_pct_buckets(self, buckets: int = 10) -> DataFrame:
        """(bucket, low, high, count): tables by share of missing cells; empty buckets stay."""
        width = 100.0 / buckets
        at = F.least(F.lit(buckets - 1).cast("bigint"), F.floor(F.col("missing_cell_pct") / F.lit(width)))
        counts = self.datasets_index.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
        grid = self.spark.range(buckets).select(
            F.col("id").alias("bucket"), (F.col("id") * F.lit(width)).alias("low"),
            ((F.col("id") + 1) * F.lit(width)).alias("high"))
        return (grid.join(F.broadcast(counts), "bucket", "left")
                .select("bucket", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))
                .orderBy("bucket"))

    def hotspot_cells(self) -> DataFrame:
        """(dataset_id, dataset_name, sheet_name, column, share): the cells of the matrix that are not 0, shares from 0 to 1. With
        limits, of the tables and columns with the highest shares. Tables of one name are rows of their own."""
        spots = self.missing_hotspots.where("missing_pct > 0")
        for name, limit in (("dataset_id", self.cfg.matrix_datasets), ("column", self.cfg.matrix_columns)):
            if limit is not None:
                first = spots.groupBy(name).agg(F.max("missing_pct").alias("most")).orderBy(F.desc("most"), name).limit(limit)
                spots = spots.join(F.broadcast(first.select(name)), name, "left_semi")
        return spots.select(*ID, "column", (F.col("missing_pct") / 100.0).alias("share"))

    def hotspot_matrix(self, columns: list[str] | None = None) -> DataFrame:
        """The cells as a grid: a row for each table with any, a value column for each of `columns` (all that have cells), 0 where a
        table has no such hotspot. For display: a large catalog is read from the cells."""
        cells = self.hotspot_cells()
        if columns is None:
            columns = [r["column"] for r in cells.select("column").distinct().orderBy("column").collect()]
        named = {c: f"share_{i}" for i, c in enumerate(columns)}
        grid = cells.groupBy(*ID).agg(*[F.max(F.when(F.col("column") == c, F.col("share"))).alias(n) for c, n in named.items()] or [F.count("*").alias("_")])
        return grid.select(*ID, *[F.coalesce(n, F.lit(0.0)).alias(c) for c, n in named.items()]).orderBy(*ID)

    @cached_property
    def master_summary(self) -> DataFrame:
        """One JSON document over the whole catalog, in the one column `document`.

        Every list has one entry per table, column or warning of the catalog at most.
        """
        cfg = self.cfg
        lists = {
            "datasets": self.sources_table,
            "global_dtype_counts": self.dtype_composition.drop("pct"),
            "global_dtype_counts_pct": self.dtype_composition,
            "top_missing_hotspots": _first(self.missing_hotspots, cfg.document_hotspots),
            "high_missing_columns": self.high_missing_columns,
            "high_cardinality_columns": _first(self.high_cardinality, cfg.document_cardinality),
            "constant_columns": self.constant_columns,
            "temporal_coverage": self.temporal_coverage,
            "quality_warnings": _first(self.warnings, cfg.document_warnings),
        }
        pieces = [("totals", self.totals, False), ("missingness_stats", self.missing_stats, False)]
        pieces += [(name, frame, True) for name, frame in lists.items()]
        rows = []
        for place, (name, frame, many) in enumerate(pieces):
            entry = F.struct(F.monotonically_increasing_id().alias("at"), F.struct(*frame.columns).alias("row"))
            held = (frame.select(entry.alias("entry"))
                    .agg(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["row"]).alias("rows")))
            body = F.col("rows") if many else F.get("rows", 0)
            text = F.concat(F.lit(f'"{name}":'), F.to_json(body, {"ignoreNullFields": "false"}))
            rows.append(held.select(F.struct(F.lit(place).alias("place"), text.alias("text")).alias("piece")))
        notes = self.spark.range(1).select(F.struct(
            F.lit(len(pieces)).alias("place"),
            F.concat(F.lit('"notes":'), F.to_json(F.array(*[F.lit(n) for n in NOTES]))).alias("text"))
            .alias("piece"))
        texts = F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"])
        return union_all([*rows, notes]).agg(
            F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}")).alias("document"))

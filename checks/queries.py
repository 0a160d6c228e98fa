"""The registered queries: each operator over whole tables.

Doubles are rounded for comparison, since sums add up in another order elsewhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.data import EXACT, TABLES, catalog, table
from plumbline import Catalog, Dataset, TableProfile
from plumbline.functions.columns import union_all
from plumbline.operators import (
    categorical, correlation, distinct, frequent, lists, numeric, overview, sampling, schema, temporal, text,
    uniqueness,
)
from plumbline.sinks import reports
from plumbline.sources import files, grids

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind != "double":
            return c
        r = F.round(c, digits)
        return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(name)
    return df.select(*[one(n, k) for n, k in df.dtypes])


def on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(table(spark, sf_dir, name)))


def of(name: str, report: str) -> Query:
    return lambda spark, sf_dir: rounded(getattr(TableProfile(table(spark, sf_dir, name), EXACT), report))


def over(report: Callable) -> Query:
    return lambda spark, sf_dir: rounded(report(catalog(spark, sf_dir)))


# --- sources ---------------------------------------------------------------------------

MESSY_HEADER = ("' okey '", "null", "'status'", "'status'", "' '", "'status__1'")


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw cells: one sheet per status, each with blank lines and a poor header on
    top; urgent orders have too few cells, low ones too many."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.selectExpr(
        "'orders.xlsx' as path", "o_orderstatus as sheet", "o_orderkey + 3 as row_no",
        """case when o_orderpriority = '1-URGENT' then array(cast(o_orderkey as string),
                cast(o_custkey as string), o_orderstatus)
           when o_orderpriority = '5-LOW' then array(cast(o_orderkey as string),
                cast(o_custkey as string), o_orderstatus, cast(o_totalprice as string),
                cast(o_orderdate as string), o_orderpriority, 'beyond', 'the header')
           else array(cast(o_orderkey as string), cast(o_custkey as string), o_orderstatus,
                cast(o_totalprice as string), cast(o_orderdate as string), o_orderpriority) end as cells""")
    top = (orders.select(F.lit("orders.xlsx").alias("path"), F.col("o_orderstatus").alias("sheet")).distinct()
           .selectExpr("path", "sheet", f"""inline(array(
                struct(0L as row_no, array(cast(null as string), '') as cells),
                struct(1L as row_no, array('  ') as cells),
                struct(2L as row_no, array({', '.join(MESSY_HEADER)}) as cells)))"""))
    return rows.unionByName(top)


def header_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.headers(order_grid(spark, sf_dir), ["path", "sheet"]).select(
        "path", "sheet", "header_row", F.posexplode("names").alias("pos", "name"))


def _sheet(spark: SparkSession, sf_dir: str, sheet: str) -> DataFrame:
    grid = order_grid(spark, sf_dir).where(F.col("sheet") == sheet)
    head = grids.headers(grid, ["path", "sheet"]).head()
    return grids.body(grid, head["header_row"], head["names"])


def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all([_sheet(spark, sf_dir, s) for s in ("F", "O", "P")])


def infer_column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.column_types(ragged_rows(spark, sf_dir))


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grids.typed(ragged_rows(spark, sf_dir)))


def sheet_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = files.grid_datasets(order_grid(spark, sf_dir))
    return union_all([d.df.agg(F.count(F.lit(1)).alias("rows"), F.count("status__1").alias("status__1"))
                      .select(F.lit(d.name).alias("name"), F.lit(d.sheet).alias("sheet"), "rows", "status__1",
                              F.lit(len(d.df.columns)).cast("bigint").alias("columns")) for d in found])


def container_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of all sheets, among them one with a header only and one without any text."""
    grid = order_grid(spark, sf_dir)
    bare = table(spark, sf_dir, "region").limit(1).selectExpr("'orders.xlsx' as path", """inline(array(
        struct('blank' as sheet, 0L as row_no, array('', cast(null as string)) as cells),
        struct('head' as sheet, 4L as row_no, array('only', 'a header') as cells)))""")
    return grids.container_columns(grid.unionByName(bare), ["path", "sheet"]).withColumn("pos", F.col("pos").cast("bigint"))


def container_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sheets, cut at a thousand rows."""
    grid = order_grid(spark, sf_dir)
    bare = table(spark, sf_dir, "region").limit(1).selectExpr("'orders.xlsx' as path", "'blank' as sheet", "0L as row_no", "array('  ') as cells")
    return grids.container_tables(grid.unionByName(bare), ["path", "sheet"], 1000)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or f'file://{tempfile.mkdtemp()}'}".rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def folder_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables written in parts, one of them partitioned, found again: files, rows and columns of each."""
    folder = scratch(spark, "tables")
    table(spark, sf_dir, "orders").repartition(4).write.partitionBy("o_orderstatus").parquet(f"{folder}/lake/orders")
    table(spark, sf_dir, "customer").repartition(3).write.option("header", True).csv(f"{folder}/lake/customer")
    table(spark, sf_dir, "part").repartition(2).write.json(f"{folder}/lake/deep/part")
    found = files.discover(spark, [folder])
    opened, notes = files.open_datasets(spark, found, EXACT)
    if notes:
        raise ValueError(notes)
    sizes = union_all([d.df.agg(F.count("*").alias("rows")).select(F.lit(d.name).alias("name"), "rows", F.lit(len(d.df.columns)).cast("bigint").alias("columns")) for d in opened])
    known = files.tables(found).select("name", "format", (F.col("files") > 1).alias("in_parts"), F.array_join("partition_columns", ",").alias("partitions"))
    return known.join(sizes, "name")


def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of orders written in each format, in the layout of a catalog, and read back."""
    folder = scratch(spark, "reports")
    catalog_ = Catalog(spark, [Dataset("orders", table(spark, sf_dir, "orders"), "lake/orders")], EXACT)
    parts = []
    for fmt in ("csv", "json", "parquet"):
        notes = reports.write_catalog(catalog_, f"{folder}/{fmt}", fmt, ("uniqueness",), ("totals",))
        if not notes.isEmpty():
            raise ValueError(notes.collect())
        schema_ = "column string, unique_non_null bigint, unique_including_null_as_value bigint"
        home = catalog_.ids.head()["dataset_dir"]
        found = spark.read.format(fmt).schema(schema_).option("header", True).load(f"{folder}/{fmt}/{home}/uniqueness")
        totals = spark.read.format(fmt).schema("files_found bigint, total_rows bigint").option("header", True).load(f"{folder}/{fmt}/_total/totals") if fmt != "csv" \
            else spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/csv/_total/totals").selectExpr("cast(files_found as bigint) as files_found", "cast(total_rows as bigint) as total_rows")
        parts.append(found.join(F.broadcast(totals)).select(F.lit(fmt).alias("format"), F.lit(home).alias("folder"), "*"))
    return union_all(parts)


def report_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The missingness of four tables written as one family and read back."""
    folder = scratch(spark, "families")
    names = ("dirty_orders", "judged_documents", "customer", "labels")
    lake = Catalog(spark, [Dataset(n, table(spark, sf_dir, n), f"lake/{n}") for n in names], EXACT)
    notes = reports.write_families(lake, folder, families=("missingness",))
    if notes:
        raise ValueError(notes)
    return rounded(spark.read.option("basePath", f"{folder}/missingness").schema(
        "dataset_name string, column string, missing bigint, missing_pct double, dataset_id string").parquet(f"{folder}/missingness"))


def header_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each benchmark text as a header: many repeats, some blanks."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ", -1))
                                                     .alias("pos", "cell"))
    return grids.repaired_names(words, ["item_id"])


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = union_all([files.file_inventory(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES])
    return out.select(F.element_at(F.split("file", "/"), -1).alias("file"),
                      (F.col("bytes") > 0).alias("has_bytes"), "rows", "columns")


def json_key_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (files.json_inventory(table(spark, sf_dir, "events"), "props").groupBy("event_type")
            .agg(F.count(F.lit(1)).alias("documents"), F.sum("json_keys").alias("json_keys"),
                 F.sum("json_items").alias("json_items")))


# --- projections, limits, samples ---------------------------------------------------------

def sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_rows(table(spark, sf_dir, "orders"), 1000, 42, ["o_orderkey"])


def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head_rows(table(spark, sf_dir, "lineitem"), 500,
                              ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TableProfile(table(spark, sf_dir, "dirty_orders"), EXACT, ["o_orderkey"]).preview


def sampled_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = replace(EXACT, sample_rows=2000, sample_strategy="random")
    return rounded(TableProfile(table(spark, sf_dir, "dirty_orders"), cfg, ["o_orderkey"]).overview)


def dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", sampling.dataset_id(F.col("url"), F.lit(None).cast("string")).alias("id"),
                        sampling.dataset_id(F.col("url"), F.lit("Sheet 1")).alias("sheet_id"),
                        sampling.slug(F.concat(F.lit("  "), F.col("url"), F.lit(" x "))).alias("slug"))


# --- distinct counts -------------------------------------------------------------------------

def unique_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketched counts beside the exact ones, with whether they are within 3 %."""
    df = table(spark, sf_dir, "lineitem")
    approx = distinct.approx_distinct(df, EXACT).withColumnRenamed("unique_non_null", "approx")
    return (distinct.exact_distinct(df).join(F.broadcast(approx), "column")
            .select("column", "unique_non_null",
                    (F.abs(F.col("approx") / F.col("unique_non_null") - 1) < 0.03).alias("within_3pct")))


def unique_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = replace(EXACT, sample_rows=3000, sample_strategy="random")
    rows = sampling.profile_rows(table(spark, sf_dir, "orders"), cfg, ["o_orderkey"])
    return schema.schema_profile(rows.df, cfg)


def max_unique_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniqueness.uniqueness(table(spark, sf_dir, "judged_documents"), replace(EXACT, max_unique_sample=150))


def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent texts of columns with few, many and nearly unique values, by summaries of 96 values."""
    cells = [{"field": c, "value": f"cast({c} as string)"} for c in ("sparse_status", "tags", "cust_id", "o_orderkey")]
    top = frequent.top_values(table(spark, sf_dir, "dirty_orders"), cells, 5, replace(EXACT, frequent_items=96))
    return top.select(F.col("field").alias("column"), "value", F.col("n").alias("count"), F.col("place").cast("bigint").alias("place"))


def many_top_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,000 most frequent values of a key that is unique and of one that is not."""
    return uniqueness.key_top_repeated(table(spark, sf_dir, "orders"), replace(EXACT, key_top_values=5000), ["o_orderkey", "o_custkey"])


def empty_table_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TableProfile(table(spark, sf_dir, "orders").where("o_orderkey < 0"), EXACT).quality_warnings


# --- catalog ---------------------------------------------------------------------------------

def quantiles_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 columns, each narrowed by sketches."""
    df = table(spark, sf_dir, "lineitem").selectExpr(*[f"l_extendedprice + l_partkey * {i} as c{i}" for i in range(64)])
    return rounded(numeric.column_quantiles(df, replace(EXACT, rank_group_rows=2000)))


def wide_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """72 numeric columns with nulls in different rows."""
    return table(spark, sf_dir, "orders").selectExpr(
        *[f"case when (o_orderkey + {i}) % {i + 2} <> 0 then o_totalprice + o_custkey * {i * i}D end as c{i}" for i in range(72)])


def correlations_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correlation.correlations(wide_orders(spark, sf_dir), EXACT))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as CSV to the shared folder, with their quotes and line breaks, and read back."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "csv")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_csv(spark, path, docs.schema, multiline=True)


def catalog_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a catalog in which one table cannot be read."""
    orders = table(spark, sf_dir, "orders")
    broken = orders.withColumn("bad", F.expr("raise_error('unreadable')").cast("bigint"))
    index = Catalog(spark, [Dataset("good", orders, "a"), Dataset("broken", broken, "b")], EXACT).datasets_index
    return index.select("dataset_name", "rows", "columns", (F.col("status") == "ok").alias("ok"))


def catalog_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the master document, with the number of entries of each."""
    doc = catalog(spark, sf_dir).master_summary
    names = ["datasets", "global_dtype_counts", "top_missing_hotspots", "high_missing_columns",
             "high_cardinality_columns", "constant_columns", "temporal_coverage", "quality_warnings"]
    pairs = [F.struct(F.lit(n).alias("part"), F.json_array_length(
        F.get_json_object("document", f"$.{n}")).cast("bigint").alias("entries")) for n in names]
    return doc.select(F.get_json_object("document", "$.totals.total_rows").cast("bigint").alias("total_rows"),
                      F.inline(F.array(*pairs)))


def run_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = replace(EXACT, sample_rows=100, sample_strategy="random")
    return union_all([TableProfile(table(spark, sf_dir, name), cfg).notes_frame().select(F.lit(name).alias("dataset"), "note")
                      for name in ("region", "orders", "pages", "benchmark")])


def key_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the key document, in their order."""
    text_ = uniqueness.key_summary(table(spark, sf_dir, "dirty_orders"), EXACT)
    entry = "struct<key_column: string, unique_keys: bigint, avg_rows_per_key: double, max_rows_per_key: bigint>"
    held = text_.select(F.from_json("document", f"candidates array<string>, by_key array<{entry}>").alias("d"))
    return rounded(held.select(F.posexplode("d.by_key").alias("place", "e"), "d.candidates").select(
        F.col("place").cast("bigint").alias("place"), F.get("candidates", F.col("place")).alias("candidate"), "e.*"))


def master_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that the master document lists."""
    shown = catalog(spark, sf_dir)
    kind = shown.sources_table.schema.simpleString()
    return rounded(shown.master_summary.select(F.explode(F.from_json("document", f"datasets array<{kind}>")["datasets"]).alias("d")).select("d.*"))


def queries() -> dict[str, Query]:
    cfg = EXACT
    q: dict[str, Query] = {
        # sources
        "header_promotion": header_promotion,
        "header_repair": header_repair,
        "ragged_rows": ragged_rows,
        "infer_column_types": infer_column_types,
        "typed_rows": typed_rows,
        "sheet_datasets": sheet_datasets,
        "container_columns": container_columns,
        "container_tables": container_tables,
        "folder_tables": folder_tables,
        "written_reports": written_reports,
        "report_families": report_families,
        "file_inventory": file_inventory,
        "json_key_inventory": json_key_inventory,
        # projections, limits, samples
        "sample_exact_n": sample_exact_n,
        "head_sample": head_sample,
        "preview": preview,
        "sampled_overview": sampled_overview,
        "dataset_names": dataset_names,
        # overview
        "overview": of("dirty_orders", "overview"),
        "overview_dup_customers": of("dup_customers", "overview"),
        "duplicate_rows": on("narrow_lineitem", lambda d: overview.duplicate_rows(d, cfg)),
        "duplicate_rows_wide": on("dup_customers", lambda d: overview.duplicate_rows(d, cfg)),
        "duplicate_rows_lineitem": on("lineitem", lambda d: overview.duplicate_rows(d, cfg)),
        "duplicate_rows_embeddings": on("embeddings", lambda d: overview.duplicate_rows(d, cfg)),
        # schema and missingness
        "schema_profile": on("dirty_orders", lambda d: schema.schema_profile(d, cfg)),
        "schema_profile_lineitem": on("lineitem", lambda d: schema.schema_profile(d, cfg)),
        "schema_profile_documents": on("documents", lambda d: schema.schema_profile(d, cfg)),
        "unique_exact": on("lineitem", distinct.exact_distinct),
        "unique_approx": unique_approx,
        "unique_sample": unique_sample,
        "max_unique_sample": max_unique_sample,
        "missingness": on("dirty_orders", lambda d: schema.missingness(d, cfg)),
        "missingness_judged_documents": on("judged_documents", lambda d: schema.missingness(d, cfg)),
        "row_missingness": on("dirty_orders", lambda d: schema.row_missingness(d, cfg)),
        "row_missingness_quantiles": on("judged_documents", lambda d: schema.row_missing_quantiles(d, cfg)),
        "row_null_counts": on("dirty_orders", lambda d: schema.row_nulls(d).select(
            "o_orderkey", F.col("null_count").cast("bigint").alias("null_count"), "null_pct")),
        "dtype_counts": of("lineitem", "dtype_counts"),
        # numeric
        "numeric_summary": on("dirty_orders", lambda d: numeric.numeric_summary(d, cfg)),
        "numeric_summary_lineitem": on("lineitem", lambda d: numeric.numeric_summary(d, cfg)),
        "numeric_quantiles": on("lineitem", lambda d: numeric.column_quantiles(d, cfg)),
        "numeric_quantiles_wide": quantiles_wide,
        "csv_round_trip": csv_round_trip,
        "catalog_with_failures": catalog_with_failures,
        "quality_warnings_sparse": of("sparse_orders", "quality_warnings"),
        "numeric_quantiles_narrowed": on("lineitem", lambda d: numeric.column_quantiles(
            d, replace(cfg, rank_group_rows=500))),
        "distribution_shape": on("dirty_orders", lambda d: numeric.distribution_shape(d, cfg)),
        "distribution_shape_lineitem": on("lineitem", lambda d: numeric.distribution_shape(d, cfg)),
        "numeric_histogram": on("lineitem", lambda d: numeric.numeric_histogram(d, cfg)),
        "numeric_histogram_dirty": on("dirty_orders", lambda d: numeric.numeric_histogram(d, cfg)),
        "correlations": on("dirty_orders", lambda d: correlation.correlations(d, cfg)),
        "correlations_lineitem": on("lineitem", lambda d: correlation.correlations(d, cfg)),
        "correlations_wide": correlations_wide,
        "correlation_matrix": of("judged_documents", "correlation_matrix"),
        # uniqueness and keys
        "uniqueness": on("dirty_orders", lambda d: uniqueness.uniqueness(d, cfg)),
        "uniqueness_orders": on("orders", lambda d: uniqueness.uniqueness(d, cfg)),
        "key_candidates": on("dirty_orders", lambda d: uniqueness.key_candidates(d, cfg)),
        "key_candidates_customer": on("customer", lambda d: uniqueness.key_candidates(d, cfg)),
        "key_duplicates": on("dirty_orders", lambda d: uniqueness.key_duplicates(d, cfg)),
        "key_duplicates_lineitem": on("lineitem", lambda d: uniqueness.key_duplicates(
            d, cfg, ["l_orderkey", "l_partkey", "l_suppkey"])),
        "key_top_repeated": on("dirty_orders", lambda d: uniqueness.key_top_repeated(d, cfg)),
        "key_summary": on("dirty_orders", lambda d: uniqueness.key_summary(d, cfg).select(
            F.get_json_object("document", "$.candidates").alias("candidates"),
            F.json_array_length(F.get_json_object("document", "$.by_key")).cast("bigint").alias("entries"),
            F.get_json_object("document", "$.by_key[1].max_rows_per_key").cast("bigint").alias("second_max"))),
        # categories, text, lists, years
        "categorical_columns": on("dirty_orders", lambda d: categorical.categorical_columns(d, cfg)),
        "categorical_columns_documents": on("documents", lambda d: categorical.categorical_columns(d, cfg)),
        "categorical_topk": on("dirty_orders", lambda d: categorical.categorical_topk(d, cfg)),
        "frequent_values": frequent_values,
        "key_top_repeated_many": many_top_keys,
        "quality_warnings_empty": empty_table_warnings,
        "categorical_topk_part": on("part", lambda d: categorical.categorical_topk(d, cfg)),
        "text_profile": on("dirty_orders", lambda d: text.text_profile(d, cfg)),
        "text_profile_documents": on("documents", lambda d: text.text_profile(d, cfg)),
        "text_profile_pages": on("pages", lambda d: text.text_profile(d, cfg)),
        "listlike_detect": on("dirty_orders", lambda d: lists.list_columns(d, cfg)),
        "listlike_detect_benchmark": on("benchmark", lambda d: lists.list_columns(d, cfg)),
        "listlike_items": on("dirty_orders", lambda d: lists.list_profile(d, cfg)),
        "listlike_tokens": on("dirty_orders", lambda d: lists.list_tokens(d, cfg)),
        "listlike_tokens_benchmark": on("benchmark", lambda d: lists.list_tokens(d, cfg)),
        "temporal_coverage": on("orders", lambda d: temporal.temporal_coverage(d, cfg)),
        "temporal_coverage_dirty": on("dirty_orders", lambda d: temporal.temporal_coverage(d, cfg)),
        "temporal_coverage_token": on("orders", lambda d: temporal.temporal_coverage(
            d.withColumnRenamed("o_orderdate", "order_date"), replace(cfg, temporal_mode="token"))),
        # warnings and cards
        "quality_warnings": of("dirty_orders", "quality_warnings"),
        "quality_warnings_dup_customers": of("dup_customers", "quality_warnings"),
        "column_profile": of("dirty_orders", "column_cards"),
        "column_profile_lineitem": of("lineitem", "column_cards"),
        # catalog
        "datasets_index": over(lambda c: c.datasets_index.drop("ds")),
        "catalog_totals": over(lambda c: c.totals),
        "dtype_composition": over(lambda c: c.dtype_composition),
        "type_buckets": over(lambda c: c.type_buckets.drop("ds")),
        "high_uniqueness": over(lambda c: c._named(c.high_uniqueness).drop("ds")),
        "high_cardinality": over(lambda c: c.high_cardinality),
        "missing_hotspots": over(lambda c: c.missing_hotspots),
        "high_missing_columns": over(lambda c: c.high_missing_columns),
        "constant_columns": over(lambda c: c.constant_columns),
        "catalog_temporal": over(lambda c: c.temporal_coverage),
        "catalog_warnings": over(lambda c: c.warnings),
        "sources_table": over(lambda c: c.sources_table),
        "top_datasets": over(lambda c: c.top_datasets),
        "catalog_missing_stats": over(lambda c: c.missing_stats),
        "catalog_search": over(lambda c: c.search("ORDERS", 100, 0, "missing_cell_pct")),
        "missing_pct_buckets": over(lambda c: c.missing_pct_buckets()),
        "hotspot_matrix": over(lambda c: c.hotspot_cells()),
        "master_summary": catalog_document,
        "master_document": master_datasets,
        "key_document": key_document,
        "run_notes": run_notes,
    }
    for name in ("lineitem", "documents", "embeddings", "events"):
        q[f"logical_size_bytes_{name}"] = on(name, lambda d: overview.logical_size(d, cfg))
    return q

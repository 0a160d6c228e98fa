"""Finding and opening data files."""

from __future__ import annotations

import logging
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import union_all
from plumbline.plans.catalog import Dataset
from plumbline.sources import grids

log = logging.getLogger(__name__)

EXTENSIONS = ("csv", "parquet", "orc", "json")
FILE_SCHEMA = "path string, length bigint, modificationTime timestamp"


def _any_case(*extensions: str) -> str:
    """A pattern of file names with one of the extensions, in any case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in extensions) + "}"


def discover(spark: SparkSession, paths: list[str], extensions=EXTENSIONS) -> DataFrame:
    """(path, length, modificationTime) of the data files under folders, files or globs.

    Extensions match in any case. Paths that do not exist are skipped with a warning.
    Contents are not read.
    """
    found = []
    for path in paths:
        try:
            found.append(spark.read.format("binaryFile").option("recursiveFileLookup", True)
                         .option("pathGlobFilter", _any_case(*extensions))
                         .load(path).select("path", "length", "modificationTime"))
        except AnalysisException as e:
            log.warning("Skipping input %s: %s", path, e.getCondition())
    if not found:
        return spark.createDataFrame([], FILE_SCHEMA)
    return union_all(found).dropDuplicates(["path"]).orderBy("path")


def tables(found: DataFrame) -> DataFrame:
    """(path, name, format, files, bytes, partition_columns): the tables that discovered files are parts of.

    The files of a writer (part-…), and files in folders key=value, are one table for their folder and format, below any such
    folders; every other file is a table by itself. One row per table reaches the driver, not one per file.
    """
    parts = found.select("path", "length", F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.regexp_replace("path", r"/[^/]*$", "").alias("folder"))
    keyed = parts.withColumn("keys", F.regexp_extract("folder", r"((?:/[^/=]+=[^/]*)+)$", 1))
    is_part = F.col("file").rlike(r"\Apart-\d+") | (F.col("keys") != "")
    root = F.when(is_part, F.expr("left(folder, length(folder) - length(keys))")).otherwise(F.col("path"))
    kind = F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))
    name = F.regexp_extract(F.col("root"), r"([^/]*?)(?:\.[^./]*)?$", 1)
    columns = F.transform(F.filter(F.split("keys", "/"), lambda k: k != ""), lambda k: F.substring_index(k, "=", 1))
    return (keyed.select(root.alias("root"), kind.alias("format"), "length", columns.alias("columns"))
            .groupBy("root", "format").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("columns").alias("partition_columns"))
            .select(F.col("root").alias("path"), name.alias("name"), "format", "files", "bytes", "partition_columns").orderBy("path", "format"))


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line has an odd number of quotes, so that a quoted value may go on in the next."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, schema=None, multiline: bool = False, checked: bool = False) -> DataFrame:
    """A CSV file with a header. Types are inferred from every row unless given.

    Quotes inside quoted values are doubled. Files with line breaks inside quoted values need
    `multiline`, which reads each file in one task; without it they are refused, not misread. `checked`: the lines are known
    to be whole.
    """
    if not multiline and not checked and has_broken_lines(spark, path):
        raise ValueError(f"{path} has quoted line breaks or unbalanced quotes: read it with multiline=True")
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def csv_grid(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """The raw lines of CSV files as a grid, for files with blank lines above the header or
    rows of uneven length. Quoted cells may hold the separator but no line breaks."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), "value")
    plain = "\\Q" + separator + "\\E"
    # In lines with quotes only a separator followed by an even number of quotes ends a cell.
    outside = plain + '(?=(?:[^"]*"[^"]*")*[^"]*$)'
    pieces = F.when(F.contains("value", F.lit('"')), F.split("value", outside, -1)).otherwise(
        F.split("value", plain, -1))
    cells = F.transform(pieces, lambda c: F.when(
        c != "", F.regexp_replace(F.regexp_replace(c, r'^\s*"([\s\S]*)"\s*$', "$1"), '""', '"')))
    # Lines of one file are ordered by the split they are in and their place in it.
    row_no = F.col("start") * F.lit(1 << 20) + F.col("id") % F.lit(1 << 33)
    return lines.select("path", F.lit(None).cast("string").alias("sheet"),
                        row_no.cast("bigint").alias("row_no"), cells.alias("cells"))


def grid_datasets(grid: DataFrame, max_rows: int | None = None) -> tuple[list[Dataset], list[str]]:
    """One dataset per (path, sheet) of a grid, and notes on sheets cut at `max_rows`. A cap
    needs consecutive row numbers, as workbooks have.

    Headers, types and sizes of all sheets are found together, and their rows are written once, parted by sheet, to the
    cluster's shared folder: the grid is scanned as often for a thousand sheets as for one, and each dataset reads its own rows
    only. The driver sees one row per sheet and one per column.
    """
    keys, spark = ["path", "sheet"], grid.sparkSession
    tables = grids.container_tables(grid, keys, max_rows).orderBy(*keys).collect()
    columns: dict[tuple, list] = {}
    for r in grids.container_columns(grid, keys, max_rows).orderBy(*keys, "pos").collect():
        columns.setdefault((r["path"], r["sheet"]), []).append((r["column"], r["type"]))
    number = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), k), F.lit("")) for k in keys])
    rows = grids.marked_body(grid, keys, max_rows).where("not over").select(*keys, number.alias("sheet_no"), "cells")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and columns:
        target = f"{folder.rstrip('/')}/sheets-{uuid.uuid4().hex}"
        rows.repartition("sheet_no", F.pmod(F.hash("cells"), F.lit(16))).write.partitionBy("sheet_no").parquet(target)
        rows = spark.read.parquet(target)
    codes = {(r["path"], r["sheet"]): r["n"] for r in spark.createDataFrame([(t["path"], t["sheet"]) for t in tables], "path string, sheet string").select(*keys, number.alias("n")).collect()}
    datasets, notes = [], []
    for t in tables:
        at = t["path"], t["sheet"]
        name = os.path.splitext(os.path.basename(t["path"]))[0]
        own = rows.where((F.col("sheet_no") == codes[at]) & F.col("path").eqNullSafe(t["path"]) & F.col("sheet").eqNullSafe(t["sheet"]))
        if t["truncated"]:
            notes.append(f"{name} (sheet {t['sheet']}) is cut at {max_rows} rows.")
        cells = [F.try_element_at("cells", F.lit(i)) for i in range(1, len(columns.get(at, [])) + 1)]
        frame = own.select(*[(c if kind == "string" else c.try_cast(kind)).alias(n) for c, (n, kind) in zip(cells, columns.get(at, []))])
        datasets.append(Dataset(name, frame if t["columns"] else own.select().limit(0), t["path"], t["sheet"]))
    return datasets, notes


def staged(df: DataFrame) -> DataFrame:
    """A table read from text, written once as Parquet to the cluster's shared folder, so that
    the passes of a profile read columns instead of parsing lines again.

    Without spark.checkpoint.dir the table is used as it is.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder or not df.columns:
        return df
    target = f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.parquet(target)


def open_datasets(spark: SparkSession, files: DataFrame,
                  cfg: ProfileConfig) -> tuple[list[Dataset], list[str]]:
    """Datasets for the tables that discovered files make. A table that cannot be opened becomes a note."""
    datasets, notes = [], []
    for r in tables(files).collect():  # one row per table of the catalog
        path, name, kind = r["path"], r["name"], r["format"]
        source = path if r["files"] == 1 and path.lower().endswith(f".{kind}") else f"{path}/"
        try:
            if kind == "csv":
                broken = has_broken_lines(spark, source)
                if broken:
                    notes.append(f"{path} has quoted line breaks and was read in one task.")
                frame = staged(read_csv(spark, source, multiline=broken, checked=True))
            else:
                frame = spark.read.format(kind).option("pathGlobFilter", _any_case(kind)).load(source)
            datasets.append(Dataset(name, frame, path))
        except Exception as e:  # one bad table must not stop the catalog
            notes.append(f"Cannot open {path}: {e}")
    return datasets, notes


def file_inventory(df: DataFrame) -> DataFrame:
    """(file, bytes, modified, rows, columns) of the files behind a table.

    On Parquet only the footers and file list are read: no column is selected.
    """
    meta = F.col("_metadata")
    return (df.select(meta["file_path"].alias("file"), meta["file_size"].alias("bytes"),
                      meta["file_modification_time"].alias("modified"))
            .groupBy("file", "bytes", "modified").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("columns", F.lit(len(df.columns)).cast("bigint")).orderBy("file"))


def json_inventory(df: DataFrame, column: str) -> DataFrame:
    """The table plus `json_keys`, the top-level keys of a JSON object, and `json_items`, the
    items in its top-level lists; both 0 for text that is no JSON object, items for a list."""
    c = F.col("`" + column.replace("`", "``") + "`")
    members = F.map_values(F.from_json(c, "map<string,string>"))
    lists = F.transform(members, lambda v: F.coalesce(F.json_array_length(v), F.lit(0)))
    items = F.aggregate(lists, F.lit(0), lambda a, b: a + b)
    return (df.withColumn("json_keys", F.coalesce(F.size(F.json_object_keys(c)), F.lit(0)).cast("bigint"))
            .withColumn("json_items", F.coalesce(F.json_array_length(c), items, F.lit(0)).cast("bigint")))

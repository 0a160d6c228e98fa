"""Writing reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import is_nested
from plumbline.plans.catalog import Catalog
from plumbline.plans.profile import REPORTS, profile

CATALOG_REPORTS = (
    "datasets_index", "totals", "sources_table", "dtype_composition", "missing_hotspots",
    "high_missing_columns", "constant_columns", "high_cardinality", "temporal_coverage",
    "warnings", "missing_stats", "top_datasets", "master_summary",
)


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """One report as one part file. Reports are small: rows per column, value or table.

    A report in the one column `document` is JSON text and written as it is.
    """
    if report.columns == ["document"]:
        report.coalesce(1).write.mode("overwrite").text(path)
        return
    if fmt == "csv":
        nested = {f.name for f in report.schema.fields if is_nested(f.dataType)}
        report = report.select(*[
            F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in report.columns])
        report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        report.coalesce(1).write.mode("overwrite").format(fmt).save(path)


def write_reports(reports: dict[str, DataFrame], folder: str, fmt: str = "csv") -> list[str]:
    """Write each report to folder/<name>. A report that fails becomes a note."""
    notes = []
    for name, report in reports.items():
        try:
            write_report(report, f"{folder}/{name}", fmt)
        except Exception as e:  # one failing report must not lose the others
            notes.append(f"Report '{name}' failed: {e}")
    return notes


#: Reports with the same columns for every table.
FAMILIES = tuple(r for r in REPORTS if r != "preview")


def write_families(catalog: Catalog, root: str, fmt: str = "parquet", families=FAMILIES) -> list[str]:
    """Each report on all tables as one table root/<report>, parted by dataset_id: one write for each report however many
    tables there are, and one to read by. A report that fails becomes a note."""
    notes = []
    for name in families:
        try:
            report = catalog.family(name)
            if fmt == "csv":
                nested = {f.name for f in report.schema.fields if is_nested(f.dataType)}
                report = report.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in report.columns])
            writer = report.repartition("dataset_id").write.mode("overwrite").partitionBy("dataset_id").format(fmt)
            (writer.option("header", True) if fmt == "csv" else writer).save(f"{root}/{name}")
        except Exception as e:  # one failing report must not lose the others
            notes.append(f"Report '{name}' failed: {e}")
    return notes


def write_catalog(catalog: Catalog, root: str, fmt: str = "csv", reports=REPORTS, rollups=CATALOG_REPORTS) -> DataFrame:
    """Every report on every table under root/<id>__<name>__<sheet>/ and the roll-ups under
    root/_total/. Returns (dataset_id, note), also written to root/_total/notes."""
    spark: SparkSession = catalog.spark
    cfg: ProfileConfig = catalog.cfg

    def one(r) -> list[tuple[str | None, str]]:
        made, said = profile(catalog.datasets[r["ds"]].df, cfg, reports)
        said += write_reports(made, f"{root}/{r['dataset_dir']}", fmt)
        return [(r["dataset_id"], n) for n in said]

    tables = catalog.ids.orderBy("ds").collect()  # one row per table
    with ThreadPoolExecutor(cfg.parallel_tables) as pool:
        notes = [note for said in pool.map(one, tables) for note in said]
    for name in rollups:
        try:
            write_report(getattr(catalog, name), f"{root}/_total/{name}", fmt)
        except Exception as e:
            notes.append((None, f"Report '{name}' failed: {e}"))
    number = {r["ds"]: r["dataset_id"] for r in tables}
    notes += [(number[i], note) for i, note in catalog.notes]
    out = spark.createDataFrame(notes, "dataset_id string, note string")
    write_report(out, f"{root}/_total/notes", fmt)
    return out

"""From files to written reports."""

from __future__ import annotations

from pyspark.sql import SparkSession

from plumbline.config import ProfileConfig
from plumbline.plans.catalog import Catalog
from plumbline.sinks.reports import write_catalog, write_report
from plumbline.sources.files import discover, open_datasets


def run(spark: SparkSession, inputs: list[str], output: str, cfg: ProfileConfig | None = None,
        fmt: str = "csv") -> dict[str, int]:
    """Profile every data file under `inputs` and write all reports under `output`.

    Returns files_found, datasets_processed, total_rows and total_columns.
    """
    cfg = cfg or ProfileConfig()
    files = discover(spark, inputs)
    datasets, notes = open_datasets(spark, files, cfg)
    catalog = Catalog(spark, datasets, cfg, files_found=files.count())
    write_catalog(catalog, output, fmt)
    if notes:
        write_report(spark.createDataFrame([(n,) for n in notes], "note string"),
                     f"{output}/_total/source_notes", fmt)
    return catalog.totals.head().asDict()

"""Every threshold and option of a profile, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass

# They decide which columns and rows a report mentions, so a report
# only equals another profiler's when these are the same.
TEMPORAL_NAME_PARTS = (
    "year", "date", "datum", "start", "end", "from", "to", "published", "created", "updated",
)
KEY_NAME_PARTS = (
    " id", "id ", "_id", "id_", "doi", "orcid", "uuid", "guid", "issn", "isbn",
)
LIST_SEPARATORS = (";", "|", ",")
YEAR_PATTERN = r"(19\d{2}|20\d{2})"
ROW_MISSING_THRESHOLDS = (0, 10, 25, 50, 75, 90, 100)
NULL_LABEL = "<NULL>"


@dataclass(frozen=True)
class ProfileConfig:
    # The thresholds and shares below decide what a report mentions, like the names above.
    # Row sampling. None profiles every row.
    sample_rows: int | None = None
    sample_strategy: str = "head"  # head | random
    sample_seed: int = 42
    max_unique_sample: int | None = None
    preview_rows: int = 20
    sheet_max_rows: int | None = None

    # Distinct counts in the schema profile: approx | exact | sample
    unique_mode: str = "approx"
    sketch_lg_k: int = 14

    # Categorical values
    top_k: int = 20
    # A column is prose if more than this share of its values is longer than that.
    long_text_length: int = 500
    long_text_share_pct: float = 10.0
    category_unique_ratio: float = 0.98
    category_min_values: int = 50
    category_max_null_pct: float = 50.0

    # Delimited lists
    list_min_share_pct: float = 20.0
    list_top_tokens: int = 30
    list_token_length: int | None = None  # shortens tokens for display, after they were counted

    # Keys
    key_unique_ratio: float = 0.98
    key_min_values: int = 50
    key_max_null_pct: float = 30.0
    key_limit: int | None = None
    key_min_rows: int = 10
    key_top_values: int = 10

    # Correlations
    max_corr_cols: int | None = None

    # Temporal columns are found by name: substring | token
    temporal_mode: str = "substring"

    # Warnings
    warn_missing_cell_pct: float = 50.0
    warn_duplicate_row_pct: float = 10.0
    warn_column_missing_pct: float = 80.0
    warn_column_limit: int | None = None

    # Catalog roll-up. None: no limit, which is the default of every limit here.
    high_uniqueness_limit: int | None = None
    cardinality_min_values: int = 200
    cardinality_max_null_pct: float = 50.0
    cardinality_min_ratio: float = 0.50
    cardinality_limit: int | None = None
    hotspot_limit: int | None = None
    hotspot_total_limit: int | None = None
    high_missing_pct: float = 80.0
    constant_limit: int | None = None
    warning_limit: int | None = None
    top_datasets: int = 20
    document_hotspots: int | None = None
    document_cardinality: int | None = None
    document_warnings: int | None = None
    matrix_datasets: int | None = None
    matrix_columns: int | None = None

    # Histograms
    histogram_bins: int = 12

    # Physical choices. Aggregates per scan keep one aggregate inside whole-stage
    # code generation; rank_group_rows bounds the largest group a window may sort.
    aggregates_per_scan: int = 40
    rank_group_rows: int = 200_000
    rank_sketch_k: int = 1024
    merge_slots: int = 64
    # Values of a summary of frequent values; three quarters of a power of two.
    frequent_items: int = 12_288
    parallel_tables: int = 8

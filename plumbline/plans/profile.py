"""All reports on one table, sharing the scans they have in common."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import local_frame
from plumbline.operators import (
    cards, categorical, correlation, distinct, facts, lists, numeric, overview, quality, sampling,
    schema, temporal, text, uniqueness,
)

log = logging.getLogger(__name__)


class TableProfile:
    """The reports on one table.

    Facts, distinct counts, quantiles and decisions have one row per column; they are
    computed once and kept, so a full profile scans the table a fixed number of times
    however many columns it has or reports are asked for.
    """

    def __init__(self, df: DataFrame, cfg: ProfileConfig | None = None, key: list[str] | None = None):
        self.cfg = cfg or ProfileConfig()
        self.source = df
        self.key = key

    def together(self, *names: str) -> None:
        """Evaluate reports that need only the facts at the same time, to keep the cluster busy.

        A failure shows when the report itself is asked for.
        """
        def one(name: str) -> None:
            try:
                getattr(self, name)
            except Exception as e:
                log.warning("Report '%s' failed: %s", name, e)

        one("facts")
        missing = [n for n in names if n not in self.__dict__]
        with ThreadPoolExecutor(max(len(missing), 1)) as pool:
            list(pool.map(one, missing))

    @cached_property
    def rows(self) -> sampling.ProfiledRows:
        return sampling.profile_rows(self.source, self.cfg, self.key)

    @property
    def df(self) -> DataFrame:
        return self.rows.df

    @cached_property
    def facts(self) -> DataFrame:
        return local_frame(facts.column_facts(self.df, self.cfg))

    @cached_property
    def unique(self) -> DataFrame:
        return local_frame(distinct.distinct_counts(self.df, self.cfg))

    @cached_property
    def quantiles(self) -> DataFrame:
        return local_frame(numeric.column_quantiles(self.df, self.cfg, self.facts))

    @cached_property
    def overview(self) -> DataFrame:
        return local_frame(overview.overview(
            self.df, self.cfg, self.facts, self.rows.sampled, self.rows.rows_total))

    @cached_property
    def schema(self) -> DataFrame:
        return local_frame(schema.schema_profile(self.df, self.cfg, self.facts, self.unique))

    @cached_property
    def missingness(self) -> DataFrame:
        return schema.missingness(self.df, self.cfg, self.facts)

    @cached_property
    def row_missingness(self) -> DataFrame:
        return schema.row_missingness(self.df, self.cfg)

    @cached_property
    def numeric_summary(self) -> DataFrame:
        return numeric.numeric_summary(self.df, self.cfg, self.facts, self.quantiles)

    @cached_property
    def distribution_shape(self) -> DataFrame:
        return numeric.distribution_shape(self.df, self.cfg, self.facts, self.quantiles, self.unique)

    @cached_property
    def numeric_histogram(self) -> DataFrame:
        return numeric.numeric_histogram(self.df, self.cfg, self.facts)

    @cached_property
    def correlations(self) -> DataFrame:
        return correlation.correlations(self.df, self.cfg, self.facts)

    @cached_property
    def correlation_matrix(self) -> DataFrame:
        return correlation.correlation_matrix(self.df, self.cfg, self.correlations)

    @cached_property
    def uniqueness(self) -> DataFrame:
        return local_frame(uniqueness.uniqueness(self.df, self.cfg, self.facts, self.unique))

    @cached_property
    def list_columns(self) -> DataFrame:
        return local_frame(lists.list_columns(self.df, self.cfg, self.facts))

    @cached_property
    def list_profile(self) -> DataFrame:
        return lists.list_profile(self.df, self.cfg, self.list_columns)

    @cached_property
    def list_tokens(self) -> DataFrame:
        return lists.list_tokens(self.df, self.cfg, self.list_columns)

    @cached_property
    def judged_columns(self) -> DataFrame:
        return local_frame(categorical.judged_columns(
            self.df, self.cfg, self.facts, self.schema, self.list_columns))

    @cached_property
    def categorical_columns(self) -> DataFrame:
        return self.judged_columns.drop("unique", "rows")

    @cached_property
    def categorical_summary(self) -> DataFrame:
        return local_frame(categorical.categorical_topk(self.df, self.cfg, self.judged_columns))

    @cached_property
    def text_profile(self) -> DataFrame:
        return local_frame(text.text_profile(self.df, self.cfg, self.facts))

    @cached_property
    def datetime_profile(self) -> DataFrame:
        return temporal.temporal_coverage(self.df, self.cfg, self.facts)

    @cached_property
    def key_columns(self) -> list[str]:
        return [r["column"] for r in self.key_candidates.collect()]

    @cached_property
    def key_candidates(self) -> DataFrame:
        return uniqueness.key_candidates(self.df, self.cfg, self.schema)

    @cached_property
    def key_duplicates(self) -> DataFrame:
        return uniqueness.key_duplicates(self.df, self.cfg, self.key_columns)

    @cached_property
    def key_top_repeated(self) -> DataFrame:
        return uniqueness.key_top_repeated(self.df, self.cfg, self.key_columns)

    @cached_property
    def key_summary(self) -> DataFrame:
        return uniqueness.key_summary(self.df, self.cfg, self.key_columns)

    @cached_property
    def quality_warnings(self) -> DataFrame:
        self.together("overview", "unique")
        return quality.quality_warnings(
            self.overview, self.missingness, numeric.constant_columns(self.facts, self.unique), self.cfg)

    @cached_property
    def column_cards(self) -> DataFrame:
        self.together("unique", "quantiles", "text_profile", "list_columns")
        return cards.column_cards(self.schema, self.numeric_summary, self.text_profile,
                                  self.uniqueness, self.categorical_summary)

    @cached_property
    def dtype_counts(self) -> DataFrame:
        return schema.dtype_counts(self.schema)

    @cached_property
    def preview(self) -> DataFrame:
        return sampling.head_rows(self.df, self.cfg.preview_rows, self.key)

    def notes_frame(self) -> DataFrame:
        """(note): the same notes as a frame, evaluated with the tables."""
        said = correlation.correlation_note(self.source, self.cfg)
        own = self.source.sparkSession.range(1 if said else 0).select(F.lit(said).cast("string").alias("note"))
        return sampling.sampling_notes(self.source, self.cfg).unionAll(own)

    def notes(self) -> list[str]:
        found = [sampling.sampling_note(self.rows, self.cfg),
                 correlation.correlation_note(self.df, self.cfg)]
        return [n for n in found if n]


# Report name -> attribute of TableProfile, in the order they are written.
REPORTS = (
    "overview", "schema", "missingness", "row_missingness", "numeric_summary",
    "distribution_shape", "numeric_histogram", "correlations", "uniqueness", "list_profile",
    "list_tokens", "categorical_columns", "categorical_summary", "text_profile",
    "datetime_profile", "key_candidates", "key_duplicates", "key_top_repeated", "key_summary",
    "quality_warnings", "column_cards", "dtype_counts", "preview",
)


def profile(df: DataFrame, cfg: ProfileConfig | None = None, reports=REPORTS,
            key: list[str] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """The asked reports by name, and notes. A report that fails becomes a note."""
    table = TableProfile(df, cfg, key)
    out, notes = {}, table.notes()
    if tuple(reports) == REPORTS:
        table.together("unique", "quantiles", "overview", "text_profile", "list_columns", "correlations")
    for name in reports:
        try:
            out[name] = getattr(table, name)
        except Exception as e:  # one failing report must not lose the others
            notes.append(f"Report '{name}' failed: {e}")
    return out, notes

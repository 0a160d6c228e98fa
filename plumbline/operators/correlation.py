"""Pearson correlations of all pairs of numeric columns, each over its complete rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.config import ProfileConfig
from plumbline.functions.columns import number, pick, union_all
from plumbline.operators.facts import numeric_fields

PAIR_SCHEMA = "column_a string, column_b string, corr double"
SUMS = ("n", "sa", "sb", "saa", "sbb", "sab", "infinite")
#: Columns of a block, blocks that a task holds sums for on either side, rows multiplied at once.
BLOCK = 64
HELD = 16
ROWS = 2048


def correlation_note(df: DataFrame, cfg: ProfileConfig) -> str | None:
    n = len(numeric_fields(df))
    if n < 2:
        return "Not enough numeric columns for correlation."
    if cfg.max_corr_cols is not None and n > cfg.max_corr_cols:
        return f"Skipped correlation: {n} numeric columns exceeds limit ({cfg.max_corr_cols})."
    return None


def correlations(df: DataFrame, cfg: ProfileConfig, facts: DataFrame | None = None) -> DataFrame:
    """(column_a, column_b, corr) for every ordered pair; null where a side is constant.

    Empty when `correlation_note` gives a reason to skip. Facts save the scan for the means.
    """
    if correlation_note(df, cfg):
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    fields = numeric_fields(df)
    means = _means(df, fields, facts)
    sums = _sums(df, fields, means)
    half = _pairs(sums, [f.name for f in fields])
    there, back = (F.struct(F.col(a).alias("column_a"), F.col(b).alias("column_b"), "corr")
                   for a, b in (("column_a", "column_b"), ("column_b", "column_a")))
    both = F.array_compact(F.array(there, F.when(F.col("column_a") != F.col("column_b"), back)))
    return half.select(F.inline(both)).orderBy("column_a", "column_b")


def correlation_matrix(df: DataFrame, cfg: ProfileConfig, pairs: DataFrame | None = None) -> DataFrame:
    """The same numbers with one row and one value column per numeric column."""
    names = [f.name for f in numeric_fields(df)]
    pairs = correlations(df, cfg) if pairs is None else pairs
    return (pairs.groupBy(F.col("column_a").alias("column"))
            .pivot("column_b", names).agg(F.first("corr")).orderBy("column"))


def _means(df: DataFrame, fields: list[T.StructField], facts: DataFrame | None) -> list[float]:
    if facts is None:
        found = df.selectExpr(*[f"avg({number(f)}) as m{i}" for i, f in enumerate(fields)]).head()
    else:
        known = {r["column"]: r["mean"] for r in facts.select("column", "mean").collect()}
        found = [known[f.name] for f in fields]
    return [v if v is not None and np.isfinite(v) else 0.0 for v in found]


def _pairs(sums: DataFrame, names: list[str]) -> DataFrame:
    """Correlations from (i, j, n, sa, sb, saa, sbb, sab), sums over the complete rows of a pair
    of values relative to the column means: raw squares would lose digits."""
    n, sa, sb, saa, sbb, sab, infinite = (F.col(s) for s in SUMS)
    va, vb = saa - F.try_divide(sa * sa, n), sbb - F.try_divide(sb * sb, n)
    # What is left of a constant column after rounding is no spread.
    spread = F.when((infinite == 0) & (va > saa * 1e-13) & (vb > sbb * 1e-13), F.sqrt(va) * F.sqrt(vb))
    return sums.select(F.expr(pick(names, "i")).alias("column_a"), F.expr(pick(names, "j")).alias("column_b"),
                       F.try_divide(sab - F.try_divide(sa * sb, n), spread).alias("corr"))


def _sums(df: DataFrame, fields: list[T.StructField], means: list[float]) -> DataFrame:
    """(i, j, sums) for each pair of columns, in one scan.

    Columns go in blocks of BLOCK. Each task turns its batches into sums for every pair of blocks by matrix products and
    hands on one row for each pair of blocks, which are added up by pair; what a task holds is bounded by
    HELD blocks on either side. A table of more columns is scanned once for each pair of such groups of blocks, in the same
    job, and only for their columns. `infinite` counts the complete rows of a pair of columns that hold an infinity; those leave no
    correlation, and touch no other pair.
    """
    n = len(fields)
    size = min(BLOCK, n)
    blocks = [range(a, min(a + size, n)) for a in range(0, n, size)]
    groups = [range(a, min(a + HELD, len(blocks))) for a in range(0, len(blocks), HELD)]
    if n > BLOCK:  # as many rows are handed on as there are tasks
        df = df.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    frames = []
    for g, left in enumerate(groups):
        for right in groups[g:]:
            pairs = [(i, j) for i in left for j in right if i <= j]
            used = sorted({c for b in {*left, *right} for c in blocks[b]})
            numbers = df.selectExpr(*[f"{number(fields[c])} as x{c}" for c in used])
            frames.append(numbers.mapInArrow(_task_sums(pairs, {b: [used.index(c) for c in blocks[b]] for b in {*left, *right}}, np.array([means[c] for c in used])),
                                             "bi int, bj int, sums binary"))
    pairs = len(blocks) * (len(blocks) + 1) // 2
    parts = union_all(frames)
    dealt = (parts.repartition(max(8, pairs // 16), "bi", "bj") if len(blocks) > 1 else parts.repartition(1)).sortWithinPartitions("bi", "bj")
    return dealt.mapInArrow(_added(blocks), "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))


def _task_sums(pairs: list[tuple[int, int]], places: dict[int, list[int]], center: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - center
                seen, endless = ~np.isnan(values), np.isinf(values)
                values[~seen | endless] = 0.0
                parts = {b: [np.ascontiguousarray(x[:, own]) for x in (seen.astype(float), values, values * values, endless.astype(float))] for b, own in places.items()}
                for i, j in pairs:
                    (m, v, q, e), (mj, vj, qj, ej) = parts[i], parts[j]
                    own = np.stack([m.T @ mj, v.T @ mj, m.T @ vj, q.T @ mj, m.T @ qj, v.T @ vj, e.T @ mj + m.T @ ej])
                    total[i, j] = total[i, j] + own if (i, j) in total else own
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in total], pa.int32()) for k in (0, 1)] + [pa.array([x.tobytes() for x in total.values()], pa.binary())],
                names=["bi", "bj", "sums"])
    return run


def _added(blocks: list[range]):
    """The sums of each pair of blocks over all tasks, a row for each pair of their columns. Rows come in order of the pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def rows() -> pa.RecordBatch:
            i, j = np.meshgrid(blocks[now[0]], blocks[now[1]], indexing="ij")
            upper = i <= j
            return pa.RecordBatch.from_arrays([pa.array(i[upper], pa.int32()), pa.array(j[upper], pa.int32()), *[pa.array(m[upper]) for m in total]], names=["i", "j", *SUMS])

        for batch in batches:
            for k in range(batch.num_rows):
                bi, bj = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                own = np.frombuffer(batch.column(2)[k].as_buffer(), dtype=float).reshape(len(SUMS), len(blocks[bi]), len(blocks[bj]))
                if now == (bi, bj):
                    total = total + own
                    continue
                if now is not None:
                    yield rows()
                now, total = (bi, bj), own
        if now is not None:
            yield rows()
    return run

"""Exact order statistics of many columns without sorting them.

Sketches give, for each wanted rank, an interval around the value at that rank. Counting
the rows below, at and between the ends of the intervals shows exactly where the rank
lies: at an end, or in an open interval. Intervals that still hold many rows are
narrowed again. The rows in the last, small intervals are grouped by value and summed up.

The sketches of whole columns and the counts at the ends are plain aggregates side by side: no value becomes a row for them.
In which open interval a value lies is found among the ends of its column by a search tree of comparisons, written out as
SQL and compiled with the scan: about log2(ends) comparisons a value, and no lambda or array. Columns go through in
blocks small enough for the compiler; each block reads its own columns, all in one job.

The driver sees only the ends, the counts and the values found: a few numbers per column and rank. The data
are scanned, filtered and pre-aggregated in place; only the last intervals are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.config import ProfileConfig
from plumbline.functions.columns import union_all

#: Comparisons that one compiled block holds, counting a column as COLUMN_WEIGHT of them.
BLOCK_WEIGHT = 120
COLUMN_WEIGHT = 6


@dataclass
class Span:
    """Wanted 0-based ranks, in ascending order, and the open interval (low, high) that holds them. The intervals of a column are apart."""
    column: int
    ranks: list[int]
    inside: int                 # rows in the open interval
    low: float | None = None    # None: no bound
    high: float | None = None
    below: int = 0              # rows at or below `low`
    spread: float = 1.0         # widens after a sketch missed a rank


def double(value: float) -> str:
    return f"cast('{value!r}' as double)"


def search(value: str, marks: list[float], leaf: Callable[[int], str]) -> str:
    """SQL for leaf(i), where i is the number of the ascending marks at or below the value."""
    def part(first: int, last: int) -> str:
        if first == last:
            return leaf(first)
        middle = (first + last + 1) // 2
        return f"if({value} >= {double(marks[middle - 1])}, {part(middle, last)}, {part(first, middle - 1)})"
    return part(0, len(marks))


def _marked(df: DataFrame, exprs: list[str], trees: dict[int, tuple[str, int]]) -> DataFrame:
    """(place, v): what the tree of each column (SQL over x, and its size) makes of its values, where not null."""
    blocks: list[list[int]] = []
    weight = BLOCK_WEIGHT + 1
    for c, (_, size) in trees.items():
        weight += size + COLUMN_WEIGHT
        if weight > BLOCK_WEIGHT:
            blocks.append([])
            weight = size + COLUMN_WEIGHT
        blocks[-1].append(c)
    frames = []
    for block in blocks:
        cells = [f"struct(case when x{c} is not null then {trees[c][0]} end as place, x{c} as v)" for c in block]
        frames.append(df.selectExpr(*[f"{exprs[c]} as x{c}" for c in block]).selectExpr(f"inline(array({', '.join(cells)}))"))
    return union_all(frames).where("place is not null")


def _members(df: DataFrame, exprs: list[str], spans: list[Span]) -> DataFrame:
    """(place, v): the values inside the open intervals, with the number of the span."""
    own: dict[int, list[int]] = {}
    for i, s in enumerate(spans):
        own.setdefault(s.column, []).append(i)
    trees = {}
    for c, held in own.items():
        held.sort(key=lambda i: (spans[i].low is not None, spans[i].low or 0.0))
        marks, inside = [], {}  # number of marks at or below -> span, and the mark that is not part of it
        for i in held:
            s = spans[i]
            if s.low is not None and (not marks or marks[-1] != s.low):
                marks.append(s.low)
            inside[len(marks)] = i, s.low
            if s.high is not None:
                marks.append(s.high)

        def leaf(k: int, c=c, inside=inside) -> str:
            if k not in inside:
                return "cast(null as int)"
            i, low = inside[k]
            return str(i) if low is None else f"if(x{c} > {double(low)}, {i}, cast(null as int))"

        trees[c] = search(f"x{c}", marks, leaf), 2 * len(marks) + 1
    return _marked(df, exprs, trees)


def _sketches(df: DataFrame, exprs: list[str], spans: list[Span], cfg: ProfileConfig) -> DataFrame:
    """(place, s): sketches of the values of each span, several for each. Those of whole columns are aggregates side by side."""
    k, slot = cfg.rank_sketch_k, f"spark_partition_id() % {cfg.merge_slots} as slot"
    whole = [i for i, s in enumerate(spans) if s.low is None and s.high is None]
    rest = [i for i, s in enumerate(spans) if s.low is not None or s.high is not None]
    frames = []
    for at in range(0, len(whole), cfg.aggregates_per_scan):
        block = whole[at : at + cfg.aggregates_per_scan]
        made = (df.selectExpr(slot, *[f"{exprs[spans[i].column]} as x{i}" for i in block])
                .groupBy("slot").agg(*[F.expr(f"kll_sketch_agg_double(x{i}, {k}) as s{i}") for i in block]))
        frames.append(made.selectExpr(f"inline(array({', '.join(f'struct({i} as place, s{i} as s)' for i in block)}))"))
    if rest:
        names = f"array({', '.join(map(str, rest))})"
        frames.append(_members(df, exprs, [spans[i] for i in rest]).selectExpr(f"element_at({names}, place + 1) as place", "v", slot)
                      .groupBy("place", "slot").agg(F.expr(f"kll_sketch_agg_double(v, {k}) as s")).select("place", "s"))
    return union_all(frames)


def _counts(df: DataFrame, exprs: list[str], marks: dict[int, list[float]], cfg: ProfileConfig) -> dict[tuple[int, float], tuple[int, int]]:
    """For each column and mark, the values below it, and those below or at it: two counts a mark, in blocks small enough for the compiler."""
    every = [(c, m) for c, own in marks.items() for m in own]
    size, frames = max(1, cfg.aggregates_per_scan // 2), []
    for at in range(0, len(every), size):
        block = list(enumerate(every[at : at + size], at))
        made = (df.selectExpr(*[f"{exprs[c]} as x{c}" for c in dict.fromkeys(c for _, (c, _) in block)])
                .agg(*[F.expr(f"count_if(x{c} {sign} {double(m)}) as {name}{i}") for i, (c, m) in block for name, sign in (("b", "<"), ("t", "<="))]))
        frames.append(made.selectExpr(f"inline(array({', '.join(f'struct({i} as place, b{i} as below, t{i} as upto)' for i, _ in block)}))"))
    return {every[r["place"]]: (r["below"], r["upto"]) for r in union_all(frames).collect()}  # one row per mark


def _sketch_ends(df, exprs, spans, cfg) -> list[list[tuple[list[int], float, float]]]:
    """For each span (ranks, low, high): intervals that very likely hold its ranks; one sketch per span, all in one job."""
    k = cfg.rank_sketch_k
    merged = _sketches(df, exprs, spans, cfg).groupBy("place").agg(F.expr(f"kll_merge_agg_double(s, {k}) as s"))
    groups, cases = [], []
    for i, s in enumerate(spans):
        own: list[list[int]] = []
        for rank in s.ranks:
            if own and rank - own[-1][-1] <= 1:
                own[-1].append(rank)
            else:
                own.append([rank])
        # A KLL sketch of size k errs by about 2.3 / k^0.9 of the rows.
        error = s.spread * 2 * 2.3 / k ** 0.9 + 1.0 / s.inside
        asked = []
        for ranks in own:
            low, high = ((r - s.below + 0.5) / s.inside for r in (ranks[0], ranks[-1]))
            asked += [double(max(0.0, low - error)), double(min(1.0, high + error))]
        groups.append(own)
        cases.append(f"when {i} then kll_sketch_get_quantile_double(s, array({', '.join(asked)}))")
    found = {r["place"]: r["ends"] for r in merged.selectExpr("place", f"case place {' '.join(cases)} end as ends").collect()}
    return [[(ranks, *found[i][2 * j : 2 * j + 2]) for j, ranks in enumerate(own)] for i, own in enumerate(groups)]


def _narrow(df, exprs, spans, ends, cfg) -> tuple[list[Span], dict[tuple[int, int], float]]:
    """Spans with tighter intervals, and the values of the ranks found to lie at an end. One job counts, for each column,
    the values below and at each of its ends."""
    marks: dict[int, list[float]] = {}
    for s, own in zip(spans, ends):
        marks.setdefault(s.column, []).extend(e for _, *pair in own for e in pair)
    marks = {c: sorted(set(m)) for c, m in marks.items()}
    n = _counts(df, exprs, marks, cfg)

    def upto(c: int, end: float, with_it: bool) -> int:
        return n[c, end][with_it]

    out, found = [], {}
    for s, own in zip(spans, ends):
        c, children, missed = s.column, [], []
        for ranks, low, high in own:
            for rank in ranks:
                if upto(c, low, False) <= rank < upto(c, low, True):
                    found[c, rank] = low
                elif upto(c, high, False) <= rank < upto(c, high, True):
                    found[c, rank] = high
                elif upto(c, low, True) <= rank < upto(c, high, False):
                    children.append(([rank], low, high))
                else:
                    missed.append(rank)
        if missed:  # the whole interval again, with more room
            ranks = sorted({*missed, *(r for x, _, _ in children for r in x)})
            out.append(Span(c, ranks, s.inside, s.low, s.high, s.below, s.spread * 4))
            continue
        joined: list[tuple[list[int], float, float]] = []
        for ranks, low, high in sorted(children, key=lambda x: x[1:]):
            if joined and low < joined[-1][2]:
                held, begin, end = joined.pop()
                ranks, low, high = held + ranks, begin, max(end, high)
            joined.append((ranks, low, high))
        for ranks, low, high in joined:
            below = upto(c, low, True)
            out.append(Span(c, sorted(set(ranks)), upto(c, high, False) - below, low, high, below))
    return out, found


def _last(df, exprs, spans) -> dict[tuple[int, int], float]:
    """The values of the ranks of small spans, from their values in order."""
    order = Window.partitionBy("place").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (_members(df, exprs, spans).groupBy("place", "v").agg(F.expr("count(1) as n"))
               .withColumn("upto", F.sum("n").over(order)))
    most = max(len(s.ranks) for s in spans)
    at = [", ".join(f"{s.ranks[j] - s.below}L" if j < len(s.ranks) else "cast(null as bigint)" for s in spans) for j in range(most)]
    picks = [F.expr(f"min(case when upto > element_at(array({x}), place + 1) then v end) as r{j}") for j, x in enumerate(at)]
    rows = running.groupBy("place").agg(*picks).collect()  # one per span
    return {(spans[r["place"]].column, rank): r[f"r{j}"] for r in rows for j, rank in enumerate(spans[r["place"]].ranks)}


def values_at_ranks(df: DataFrame, exprs: dict[str, str], wanted: dict[str, tuple[int, dict]],
                    cfg: ProfileConfig) -> DataFrame:
    """(column, label, value) for `wanted`: column -> (number of non-null values, label -> rank).

    `exprs` gives each column as SQL text, a double without NaN.
    """
    names = list(wanted)
    texts = [exprs[c] for c in names]
    small, found = [], {}
    wide = [Span(i, sorted(set(wanted[c][1].values())), wanted[c][0]) for i, c in enumerate(names) if wanted[c][1]]
    while wide:
        small += [s for s in wide if s.inside <= cfg.rank_group_rows]
        wide = [s for s in wide if s.inside > cfg.rank_group_rows]
        if wide:
            wide, settled = _narrow(df, texts, wide, _sketch_ends(df, texts, wide, cfg), cfg)
            found |= settled
    if small:
        found |= _last(df, texts, small)
    rows = [{"column": c, "label": label, "value": float(found[i, rank])}
            for i, c in enumerate(names) for label, rank in wanted[c][1].items()]
    return df.sparkSession.createDataFrame(pa.Table.from_pylist(
        rows, pa.schema([("column", pa.string()), ("label", pa.string()), ("value", pa.float64())])))

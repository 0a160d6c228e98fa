"""Approximate nearest neighbours with a permutation index.

A vector is represented by its NEAREST pivots in order of nearness (largest cosine). The pivots are
distinct vectors of a bounded sample, the one fit; every row is indexed. In each task the rows of a block
are posted in one inverted file per pivot, with the place that the pivot has in the row's order. A
query reads the files of its own nearest pivots: a posting with place j in the file of its i-th
pivot brings a row closer by 2 * (NEAREST - max(i, j)), which summed is the footrule distance
between both orders (a missing pivot stands at place NEAREST). The SHARE of a block's rows that are
closest by it are ranked anew by the exact cosine, and the best of all blocks are the answer.

Queries go round in blocks of QUERY_BLOCK, each broadcast against all rows, so neither side has to
fit anywhere. A row vector that is repeated any number of times is spread like any other rows.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; rows that share an id count as one candidate, at its best; ties go to the
smaller id; fewer candidates than k give fewer rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

PIVOTS = 256
NEAREST = 64
SHARE = 0.15
LEAST = 256
QUERY_BLOCK = 4096
SAMPLE = 8192
ROWS = 8192


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part, as arrays of double."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    inf = float("inf")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf))
    rows = rows.where(F.coalesce(good, F.lit(False)) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes.n if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, which changes no cosine, so that no square of a component overflows or vanishes."""
    if not x.size:
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _orders(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    return np.argsort(-(_unit(x) @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int16)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Unit vectors: of the sampled distinct vectors, those with the smallest hashes."""
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    part = F.shiftrightunsigned(F.xxhash64("v"), 11) < int(min(1.0, SAMPLE / n) * (1 << 53))
    sample = rows.where(part | F.lit(n <= SAMPLE)).select("v", F.xxhash64("v", F.lit(7)).alias("h")).distinct().orderBy("h").limit(pivots).collect()
    if not sample:  # all rows are copies of few vectors
        sample = rows.select("v", F.xxhash64("v", F.lit(7)).alias("h")).distinct().orderBy("h").limit(pivots).collect()
    return _unit(np.array([r.v for r in sample], dtype=np.float64))


def build(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The index: every row's id, vector and order of nearest pivots, as a table in the shared folder."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("v array<double>, nearest array<smallint>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = _orders(_matrix(batch.column(1)), shared.value, min(NEAREST, len(shared.value)))
                at = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                nearest = pa.ListArray.from_arrays(pa.array(at), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([batch.column(0), batch.column(1), nearest], arrow)], schema=arrow)

    return written(rows.mapInArrow(run, schema), "index")


class Files:
    """The inverted files of a block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, pivots: int):
        self.ids, self.vectors, self.n = ids, _scaled(vectors), len(ids)
        self.unit = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        places = orders.shape[1]
        self.weight = 2 * (places - np.maximum.outer(np.arange(places), np.arange(places)))
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        self.row, self.place = by_pivot // places, by_pivot % places
        self.start = np.searchsorted(orders.ravel()[by_pivot], np.arange(pivots + 1))

    def closest(self, order: np.ndarray, c: int) -> np.ndarray:
        """The c rows with the least footrule distance, by id among equals."""
        rows = np.concatenate([self.row[self.start[p] : self.start[p + 1]] for p in order])
        near = np.concatenate([self.weight[i][self.place[self.start[p] : self.start[p + 1]]] for i, p in enumerate(order)])
        total = np.bincount(rows, weights=near, minlength=self.n)
        if c >= self.n:
            return np.arange(self.n)
        least = np.partition(total, self.n - c)[self.n - c]
        above, level = np.flatnonzero(total > least), np.flatnonzero(total == least)
        return np.concatenate([above, level[np.argsort(self.ids[level], kind="stable")][: c - len(above)]])

    def best(self, own: int, query: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        c = max(LEAST, int(np.ceil(SHARE * self.n))) + 1
        at = self.closest(order, c)
        at = at[self.ids[at] != own]
        query = _scaled(query[None])[0]
        score = (self.vectors[at] * query).sum(axis=1) / (self.unit[at] * np.sqrt((query * query).sum()))
        return _top(self.ids[at], score, k)


def _top(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))
    ids, score = ids[order], score[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], score[first]


def search(index: DataFrame, pivots: np.ndarray, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows of the index but its own."""
    spark = index.sparkSession
    schema = T._parse_datatype_string("query_id long, vec_id long, score double")
    arrow = to_arrow_schema(schema)
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block)
        rows = part.select(F.col("id").cast("long").alias("id"), "v", "nearest").collect()
        shared = spark.sparkContext.broadcast((
            [r.id for r in rows], np.array([r.v for r in rows], dtype=np.float64), np.array([r.nearest for r in rows], dtype=np.int64)))
        answers = index.select(F.col("id").cast("long").alias("id"), "v", "nearest").mapInArrow(_task(shared, len(pivots), k, arrow), schema)
        answers = answers if blocks == 1 else written(answers, "answers")
        found = answers if found is None else found.unionAll(answers)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _task(shared, pivots: int, k: int, schema: pa.Schema):
    def run(batches):
        ids, vectors, orders = shared.value
        held = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(ids)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                files = Files(part.column(0).to_numpy(), _matrix(part.column(1)), _matrix(part.column(2)).astype(np.int64), pivots)
                for i, own in enumerate(ids):
                    near, score = files.best(own, vectors[i], orders[i], k)
                    held[i] = _top(np.concatenate([held[i][0], near]), np.concatenate([held[i][1], score]), k)
        sizes = [len(x[0]) for x in held]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(ids, dtype=np.int64), sizes)), pa.array(np.concatenate([x[0] for x in held])), pa.array(np.concatenate([x[1] for x in held]))], schema=schema)
    return run

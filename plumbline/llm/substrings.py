"""Substring dedup: passages that repeat across documents, by compact windows.

A document is its sequence of 5-word shingles. For each of HASHES hash functions a Cartesian tree over
the sequence (the smallest value at the root, the rest left and right of it) gives its compact windows:
all stretches of at least LENGTH shingles inside window (l, r) that contain its root share one min-hash.
A window is shared if the same min-hash is the root of a window of another document. Where shared
windows of at least NEEDED of the hash functions overlap for LENGTH shingles, there may be a repeated passage: two
stretches of similarity 0.75 share two of six min-hashes at least with probability 0.995.

To verify, the shingles of those stretches are counted over all documents' stretches: a shingle is
repeated if another document has it, and a passage is a longest stretch of at least LENGTH shingles that
starts and ends with repeated ones and of which 75 % are repeated, with at most GAP others in a row.

Groups are never gathered: of equal min-hashes only the smallest and largest document id are kept, in each
task before they are shuffled, and the join that marks a hot one's windows is split by adaptive execution.
The hash functions go through this in PARTS parts, and the shared min-hashes of each are written before its join, so that on disk there
are the windows, those found to be shared, and one shuffle of a part. Most windows of others are left out of the join by a bit table of fixed size.
Equal shingles of the few remaining stretches meet in a window, which streams them and spills; by their hashes, they too go in PARTS parts.
Texts are shuffled only for documents with shared windows, found by a bit table of fixed size.

Defined results: words as in the Jaccard join; null, empty and shorter texts have no passages; rows that
share an id are one document, so a passage is not repeated by them alone; each of their different texts is searched, and gives
rows of its own; rows without id take no part. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textscan as ts
from .common import dropped, members, written

WORDS = 5
#: Shingles of the shortest passage: 50 words.
LENGTH = 46
HASHES, NEEDED = 6, 2
#: The hash functions, and then the shingles, are worked through in so many parts, one after the other, whose shuffles do not lie on disk together.
PARTS = 3
#: Windows of longer texts are found one by one, without a table of the smallest values of blocks.
LONG = 1 << 16
#: What two changed words at most spoil.
GAP = 2 * WORDS

_U = np.uint64
_SEEDS = ts.seeds(HASHES, 91)


def compact_windows(values: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(l, root, r), both ends included, of all subtrees of at least `length` values; of equal values the first is the root."""
    out = []
    stack = [(0, len(values) - 1)]
    while stack:
        left, right = stack.pop()
        if right - left + 1 < length:
            continue
        root = left + int(np.argmin(values[left : right + 1]))
        out.append((left, root, right))
        stack.append((left, root - 1))
        stack.append((root + 1, right))
    return out


def _sequence(found: ts.Words, i: int) -> np.ndarray:
    return ts.sequence_hashes(found.hashes[found.first[i] : found.first[i + 1]], WORDS)


def _sequences(found: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of all texts, one after the other, and where each begins (and the last ends)."""
    every = ts.sequence_hashes(found.hashes, WORDS)
    last = np.repeat(found.first[1:], np.diff(found.first))[: len(every)]
    return every[np.arange(WORDS, len(every) + WORDS) <= last], np.cumsum([0, *np.maximum(np.diff(found.first) - WORDS + 1, 0)])


def all_windows(values: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots, left and right ends (included) of compact_windows() of each sequence values[first[i] : first[i + 1]], as places in values.

    A root is the smallest of some stretch of `length` values; its window grows by halving steps over the smallest values of blocks."""
    sizes = np.diff(first)
    n, longest = len(values), int(sizes.max(initial=0))
    if longest < length:
        return (np.zeros(0, dtype=np.int64),) * 3
    if longest > LONG:
        found = [(left + at, root + at, right + at) for at, to in zip(first[:-1].tolist(), first[1:].tolist()) for left, root, right in compact_windows(values[at:to], length)]
        lefts, roots, rights = np.array(found, dtype=np.int64).T
        return roots, lefts, rights
    least = [values]  # least[p][i] is the smallest of values[i : i + 2^p]
    while 2 << (p := len(least) - 1) <= longest:
        least.append(np.minimum(least[p][: -(1 << p)], least[p][1 << p :]))
    begin, end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
    p = length.bit_length() - 1
    stretch = np.minimum(least[p][: n - length + 1], least[p][length - (1 << p) :])
    stretch[np.arange(length, n + 1) > end[: n - length + 1]] = 0
    none = np.zeros(length - 1, dtype=values.dtype)
    most, size = np.concatenate([none, stretch, none]), 1
    while 2 * size <= length:
        most, size = np.maximum(most[:-size], most[size:]), 2 * size
    roots = np.flatnonzero(np.maximum(most[:n], most[length - size :]) == values)
    value, low, high = values[roots], begin[roots], end[roots]
    left, right = roots.copy(), roots + 1
    for p in reversed(range(len(least))):
        step = 1 << p
        ok = left - step >= low
        left -= step * (ok & (least[p][np.where(ok, left - step, 0)] > value))
        ok = right + step <= high
        right += step * (ok & (least[p][np.where(ok, right, 0)] >= value))
    keep = right - left >= length
    return roots[keep], left[keep], right[keep] - 1


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """key (hash function and min-hash), id, own (hash of the text), l, r, k of every compact window."""
    schema = T.StructType([T.StructField("key", T.LongType()), docs.schema["id"], *T._parse_datatype_string("own long, l int, r int, k int").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            for a, b in ts.slices(offsets):
                found = ts.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ts.NOT_SPACE)
                own, first = _sequences(found)
                for k in range(HASHES):
                    values = ts.mix(own ^ _SEEDS[k])
                    roots, left, right = all_windows(values, first, length)
                    if not len(roots):
                        break
                    text = np.searchsorted(first, roots, side="right") - 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array(values[roots].view(np.int64)), *[batch.column(1 + j).take(pa.array(a + text)).cast(arrow.field(1 + j).type) for j in (0, 1)],
                        *[pa.array((x - first[text]).astype(np.int32)) for x in (left, right)], pa.array(np.full(len(roots), k, dtype=np.int32))], schema=arrow)

    return docs.select("text", "id", "own").where("text is not null").mapInArrow(run, schema)


def shared_stretches(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches [l, r) where windows (l, r included, k) of at least NEEDED hash functions overlap for `length` shingles."""
    n = int(windows[:, 1].max()) + 2
    functions = np.zeros(n, dtype=np.int32)
    for k in range(HASHES):
        own = windows[windows[:, 2] == k]
        edge = np.zeros(n, dtype=np.int32)
        np.add.at(edge, own[:, 0], 1)
        np.add.at(edge, own[:, 1] + 1, -1)
        functions += np.cumsum(edge) > 0
    inside = np.diff(np.concatenate([[0], (functions >= NEEDED).astype(np.int8), [0]]))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)) if b - a >= length]


def passages(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Passages [first, last] among the ascending places of repeated shingles."""
    out = []
    if not len(places):
        return out
    for run in np.split(places, np.flatnonzero(np.diff(places) > GAP + 1) + 1):
        value = 4 * np.arange(len(run)) - 3 * (run - run[0])  # a rise of -1 or more: 75 % are repeated
        at = 0
        while at < len(run):
            good = np.flatnonzero(value[at:] - value[at] >= -1)
            last = at + int(good[-1]) if len(good) else at
            if run[last] - run[at] + 1 >= length:
                out.append((int(run[at]), int(run[last])))
                at = last + 1
            else:
                at += 1
    return out


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    if pa.types.is_nested(column.type):
        every = column.to_pylist()
        return np.array([x != y for x, y in zip(every, every[1:])], dtype=bool)
    return pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)


def _by_text(rows: DataFrame, columns: list[str], task, schema: T.StructType) -> DataFrame:
    """Runs task(id, own, columns as one array) for the rows of each text; it returns the rows it makes."""
    arrow = to_arrow_schema(schema)

    def batched(made):
        rows = []
        for some in made:
            rows += some
            if len(rows) >= 4096:
                yield from made_of(rows)
                rows = []
        yield from made_of(rows)

    def made_of(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def each(batches):
        name, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(2 + j).to_numpy() for j in range(len(columns))], axis=1)
            edges = [0, *(np.flatnonzero(_changes(batch.column(0)) | _changes(batch.column(1))) + 1).tolist(), batch.num_rows]
            for at, to in zip(edges, edges[1:]):
                this = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if held and this != name:
                    yield task(*name, np.concatenate(held))
                    held = []
                name = this
                held.append(values[at:to])
        if held:
            yield task(*name, np.concatenate(held))

    return rows.select("id", "own", *columns).repartition("id", "own").sortWithinPartitions("id", "own").mapInArrow(lambda batches: batched(each(batches)), schema)


def _others(rows: DataFrame, key: str) -> DataFrame:
    """The keys that rows of more than one id have, with the smallest id."""
    return rows.groupBy(key).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id").select(key, "first_id")


def _sharing(windows: DataFrame, keys: DataFrame) -> DataFrame:
    """The windows of these keys. Not a semi join: Spark would put that before the bit table, and shuffle all windows."""
    return members(windows, keys, column="key").join(keys, "key").drop("key")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per passage: the document's id, start_word and end_word ([start, end)), n_words, n_repeated (shingles
    that other documents have) and first_id (the smallest id among the holders of any of them)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own")).where("id is not null")
    windows = written(_windows(docs, length), "windows")
    parts = []
    for part in range(PARTS):
        own = windows.where(F.col("k") % PARTS == part)
        keys = written(_others(own, "key").select("key"), "keys")
        parts.append(written(_sharing(own, keys), "shared"))
        dropped(keys)
    dropped(windows)
    one = T.StructType([docs.schema["id"], *T._parse_datatype_string("own long, l int, r int").fields])

    def stretched(name, own, rows):
        return [(name, own, a, b) for a, b in shared_stretches(rows, length)]

    shared = reduce(DataFrame.unionAll, parts)
    stretches = written(_by_text(shared, ["l", "r", "k"], stretched, one).groupBy("id", "own").agg(F.collect_list(F.struct("l", "r")).alias("stretches")), "stretches")
    dropped(*parts)
    texts = members(docs, stretches).join(stretches, ["id", "own"]).groupBy("id", "own").agg(F.first("text").alias("text"), F.first("stretches").alias("stretches"))
    whole = written(texts.select("text", "id", "own", "stretches"), "texts")
    dropped(stretches)
    listed = T.StructType([docs.schema["id"], *T._parse_datatype_string("own long, shingle long, pos int").fields])
    arrow = to_arrow_schema(listed)

    def shingles(batches, part):
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            wanted = batch.column(3).to_pylist()
            for a, b in ts.slices(offsets):
                found = ts.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ts.NOT_SPACE)
                rows, own, places = [], [], []
                for i in range(b - a):
                    every = _sequence(found, i)
                    for s in wanted[a + i]:
                        pos = np.arange(s["l"], min(s["r"], len(every)), dtype=np.int32)
                        pos = pos[every[pos] % _U(PARTS) == part]
                        rows.append(np.full(len(pos), a + i))
                        own.append(every[pos].view(np.int64))
                        places.append(pos)
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([*[batch.column(1 + j).take(at).cast(arrow.field(j).type) for j in (0, 1)], pa.array(np.concatenate(own)), pa.array(np.concatenate(places))], schema=arrow)

    same = Window.partitionBy("shingle")
    parts = []
    for part in range(PARTS):
        counted = whole.mapInArrow(lambda batches, part=part: shingles(batches, part), listed)
        parts.append(written(counted.withColumn("first_id", F.min("id").over(same)).withColumn("last_id", F.max("id").over(same))
                             .where("first_id < last_id").select("id", "own", "pos", "first_id"), "repeated"))
    dropped(whole)
    repeated = reduce(DataFrame.unionAll, parts)
    found = T.StructType([docs.schema["id"], *T._parse_datatype_string("first int, last int, n_repeated long").fields, T.StructField("first_id", docs.schema["id"].dataType)])

    def joined(name, own, rows):
        places, at = np.unique(rows[:, 0].astype(np.int64), return_index=True)
        spans = passages(places, length)
        ends = [(int(np.searchsorted(places, a)), int(np.searchsorted(places, b, side="right"))) for a, b in spans]
        return [(name, a, b, j - i, min(rows[at[i:j], 1])) for (a, b), (i, j) in zip(spans, ends)]

    spans = _by_text(repeated, ["pos", "first_id"], joined, found)
    end = F.col("last") + WORDS
    result = written(spans.select(
        F.col("id").alias(id_col), F.col("first").cast("long").alias("start_word"), end.cast("long").alias("end_word"), (end - F.col("first")).cast("long").alias("n_words"), "n_repeated", "first_id"), "passages")
    dropped(*parts)
    return result

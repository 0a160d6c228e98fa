"""Benchmark decontamination: Wu-Manber search for every benchmark window in every document.

Texts are sequences of words (A-Z lower-cased). A window is `width` consecutive words of an item, or
the whole item if it has fewer. The searcher holds, for each window length, a table of shifts by
block (two words): how far a reader whose last block is that one may move on, since no window ends
sooner. Where the shift is zero, the block's bucket names the windows with that ending, and all words
are compared, by hash and then byte by byte. Tables live on the benchmark side only; documents are read once, in place.

Documents are cut into lanes that overlap by one window less a word, and all lanes of a batch move
together, so the skipping loop is a few array operations whatever the number of documents.

Defined results: null or wordless texts have no words, hits or items; items without words or item_id
have no windows; equal items are all reported; repeated documents are searched each by itself; an
empty benchmark leaves every document clean. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textscan as ts
from .common import carried

#: Benchmark text searched for in one pass over the documents; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20

LANE = 1024
_SLOTS = 1 << 18
_U = np.uint64


def _blocks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ts.mix(left * _U(3) + right * _U(0x9E3779B97F4A7C15))


class WuManber:
    """Windows of one length, as 64-bit word hashes and as words."""

    def __init__(self, windows: np.ndarray, owners: list[np.ndarray], spelled: list[tuple[bytes, ...]] | None = None):
        self.m = m = windows.shape[1]
        self.windows, self.owners, self.spelled = windows, owners, spelled
        self.block = min(2, m)
        self.default = m - self.block + 1
        self.shift = np.full(_SLOTS, self.default, dtype=np.int16)
        for j in range(self.block - 1, m):
            np.minimum.at(self.shift, self._slot(self._at(windows, j)), m - 1 - j)
        last = self._at(windows, m - 1)
        self.order = np.argsort(last, kind="stable")
        self.suffixes = last[self.order]

    def _at(self, rows: np.ndarray, j: int) -> np.ndarray:
        return rows[:, j] if self.block == 1 else _blocks(rows[:, j - 1], rows[:, j])

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> _U(46)).astype(np.int64)

    def search(self, words: np.ndarray, first: np.ndarray, word: Callable[[int], bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ends (index of the last word) and windows of all occurrences that lie within one text; word: the bytes of a word."""
        lane_at, lane_end = [], []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= self.m:
                begins = np.arange(a + self.m - 1, b, LANE)
                lane_at.append(begins)
                lane_end.append(np.minimum(begins + LANE, b))
        if not lane_at or not len(self.windows):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at, end = np.concatenate(lane_at), np.concatenate(lane_end)
        ends, found = [], []
        while len(at):
            block = words[at] if self.block == 1 else _blocks(words[at - 1], words[at])
            shift = self.shift[self._slot(block)]
            stop = np.flatnonzero(shift == 0)
            if len(stop):
                e, w = self._confirm(words, at[stop], block[stop], word)
                ends.append(e)
                found.append(w)
            at = at + np.maximum(shift, 1)
            live = at < end
            at, end = at[live], end[live]
        if not ends:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(ends), np.concatenate(found)

    def _confirm(self, words: np.ndarray, at: np.ndarray, block: np.ndarray, word=None) -> tuple[np.ndarray, np.ndarray]:
        low = np.searchsorted(self.suffixes, block, side="left")
        size = np.searchsorted(self.suffixes, block, side="right") - low
        pos = np.repeat(at, size)
        inside = np.arange(len(pos)) - np.repeat(np.cumsum(size) - size, size)
        window = self.order[np.repeat(low, size) + inside]
        same = np.ones(len(pos), dtype=bool)
        for j in range(self.m):
            same[same] = words[pos[same] - self.m + 1 + j] == self.windows[window[same], j]
        pos, window = pos[same], window[same]
        if word and self.spelled:
            equal = [all(word(p + k) == w for k, w in enumerate(self.spelled[i], 1 - self.m)) for p, i in zip(pos.tolist(), window.tolist())]
            pos, window = pos[equal], window[equal]
        return pos, window


def speller(data: np.ndarray, found: ts.Words) -> Callable[[int], bytes]:
    """The lower-cased bytes of a word by its number."""
    return lambda i: ts.LOWER[data[found.starts[i] : found.ends[i]]].tobytes()


def searchers(items: list[tuple[int, str | None]], width: int) -> list[WuManber]:
    """One searcher for each window length that the items need."""
    by_length: dict[int, dict[tuple[bytes, ...], tuple[np.ndarray, set[int]]]] = {}
    texts = pa.array([text for _, text in items], type=pa.large_string())
    offsets, data = ts.buffers(texts)
    found = ts.words(data, offsets, ts.ALNUM)
    word = speller(data, found)
    for i, (item, _) in enumerate(items):
        spelled = [word(k) for k in range(int(found.first[i]), int(found.first[i + 1]))]
        own = found.hashes[found.first[i] : found.first[i + 1]]
        m = min(width, len(own))
        for k in range(len(own) - m + 1 if m else 0):
            row = own[k : k + m]
            by_length.setdefault(m, {}).setdefault(tuple(spelled[k : k + m]), (row, set()))[1].add(item)
    return [
        WuManber(np.stack([row for row, _ in rows.values()]), [np.array(sorted(own), dtype=np.int64) for _, own in rows.values()], list(rows))
        for m, rows in sorted(by_length.items())
    ]


def _scan(data: np.ndarray, found: ts.Words, tables: list[WuManber]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with hits: starts and ends of its hit runs of words, and the items."""
    n, texts = len(found.hashes), len(found)
    depth = np.zeros(n + 1, dtype=np.int32)
    owners, where = [], []
    for t in tables:
        ends, window = t.search(found.hashes, found.first, speller(data, found))
        np.add.at(depth, ends - t.m + 1, 1)
        np.add.at(depth, ends + 1, -1)
        doc = np.searchsorted(found.first, ends, side="right") - 1
        pairs = np.unique(np.stack([doc, window]), axis=1)
        for d, w in pairs.T:
            owners.append(t.owners[w])
            where.append(d)
    out: list = [None] * texts
    if not where:
        return out
    hit = np.cumsum(depth[:-1]) > 0
    by_doc: dict[int, list[np.ndarray]] = {}
    for d, own in zip(where, owners):
        by_doc.setdefault(int(d), []).append(own)
    for d, own in by_doc.items():
        a, b = int(found.first[d]), int(found.first[d + 1])
        edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
        out[d] = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), np.unique(np.concatenate(own))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", also: list[str] | None = None, mark: str = "",
) -> DataFrame:
    """Per document its id, n_words, hit_spans (runs of hit words, [start, end)) and items (ids, ascending);
    `also`: further columns to hand on; `mark`: put before the new names, where they would clash with those."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    frame, names, places = carried(docs, id_col, text_col, also)
    found = T._parse_datatype_string(f"{mark}n_words long, {mark}hit_spans array<struct<start:long,end:long>>, {mark}items array<long>").fields
    given = len(frame.columns)
    for block in range(blocks):
        rows = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        tables = spark.sparkContext.broadcast(searchers([(r.item, r.text) for r in rows.collect()], width))
        last = block == blocks - 1
        schema = T.StructType([*[docs.schema[c] for c in (names if last else frame.columns[:given])], *found])
        frame = frame.mapInArrow(_pass(tables, to_arrow_schema(schema), places if last else list(range(given)), given), schema)
    return frame


def _pass(tables, schema: pa.Schema, places: list[int], given: int):
    """Reads the text and what is handed on, and behind those what an earlier pass has found."""

    def run(batches):
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            for a, b in ts.slices(offsets):
                words = ts.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ts.ALNUM)
                hits = _scan(data[offsets[a] : offsets[b]], words, tables.value)
                part = batch.slice(a, b - a)
                if batch.num_columns > given:
                    _add(hits, part.column(given + 1), part.column(given + 2))
                spans = [[] if h is None else [{"start": int(s), "end": int(e)} for s, e in zip(h[0], h[1])] for h in hits]
                items = [[] if h is None else h[2].tolist() for h in hits]
                made = [pa.array(np.diff(words.first), type=pa.int64()), pa.array(spans, type=schema.field(-2).type), pa.array(items, type=schema.field(-1).type)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*[part.column(i) for i in places], *made], schema)], schema=schema)
    return run


def _add(hits: list, spans: pa.Array, items: pa.Array) -> None:
    """Joins the hits of an earlier pass to those of this one."""
    for i, (old, own) in enumerate(zip(spans.to_pylist(), items.to_pylist())):
        if not own:
            continue
        new = [] if hits[i] is None else list(zip(hits[i][0].tolist(), hits[i][1].tolist()))
        runs: list[list[int]] = []
        for s, e in sorted([(x["start"], x["end"]) for x in old] + new):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        ids = own if hits[i] is None else np.union1d(hits[i][2], own)
        hits[i] = np.array([r[0] for r in runs]), np.array([r[1] for r in runs]), np.asarray(ids, dtype=np.int64)

"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes. The code length of a byte is found
in the longest context that the tree knows: log2 of (n + d) / c if the byte followed it c times (n:
visits, d: different bytes that followed), else the escape, log2 of (n + d) / d, and what the next
shorter context charges, down to 8 bits for a byte never seen (escape method C, no exclusions). The
counts are frozen after training, so a text's code length under a language is a plain sum, and the
text belongs to the language that codes it in the fewest bits. The score is that language's share
of 2^-bits among all languages.

With frozen counts the code lengths under all languages of every ORDER + 1 bytes seen in training
are a fixed table, which workers look bytes up in; other positions go to the shorter contexts.

Training text is a bounded sample: per language the documents with the smallest hashes, TRAIN_BYTES in
all, so the broadcast table has at most that many entries per language. Bytes are taken in lower
case (A-Z and Latin-1 letters), and a text starts after ORDER zero bytes.

Defined results: null texts and texts without letters are `und` with score 0; ties go to the language
that sorts first; without training texts all are `und`. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textscan as ts
from .common import buckets_within, carried

ORDER = 4
TRAIN_BYTES = 3 << 20
SMALL = 64

_U = np.uint64


def folded(data: np.ndarray) -> np.ndarray:
    low = ts.LOWER[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][upper] += 0x20
    return low


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the number made of it (lowest) and the ORDER bytes before it in its text."""
    low = folded(data).astype(_U)
    place = np.arange(len(low)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = low.copy()
    for k in range(1, ORDER + 1):
        shifted = np.zeros_like(low)
        shifted[k:] = low[:-k] if len(low) > k else low[:0]
        shifted[place < k] = 0
        key |= shifted << _U(8 * k)
    return key


class Lookup:
    """Positions of 64-bit keys: a hash table probed for a whole array at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.slots = np.full(size, -1, dtype=np.int32)
        self.keys = keys
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            slot = self.slots[at]
            same = (slot >= 0) & (self.keys[slot] == keys[todo])
            out[todo[same]] = slot[same]
            on = (slot >= 0) & ~same
            todo, at = todo[on], (at[on] + 1) & (len(self.slots) - 1)
        return out


@dataclass
class Model:
    """Languages; by order, from 0 up, keys and code lengths of grams, and keys and escapes of contexts."""

    languages: list[str]
    gram_keys: list[np.ndarray]
    bits: list[np.ndarray]
    context_keys: list[np.ndarray]
    escapes: list[np.ndarray]


def build(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: for each language the keys and counts of its grams of ORDER + 1 bytes."""
    model = Model(languages, [], [], [], [])
    shorter = None
    for order in range(ORDER + 1):
        mask = _U((1 << (8 * (order + 1))) - 1)
        own = []
        for keys, n in counts:
            short, back = np.unique(keys & mask, return_inverse=True)
            own.append((short, np.bincount(back, weights=n, minlength=len(short))))
        every = np.unique(np.concatenate([k for k, _ in own]))
        contexts = np.unique(every >> _U(8))
        escape = np.zeros((len(contexts), len(languages)))
        bits = np.zeros((len(every), len(languages)))
        for i, (keys, n) in enumerate(own):
            at = np.searchsorted(contexts, keys >> _U(8))
            visits = np.bincount(at, weights=n, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            known = kinds > 0
            escape[known, i] = np.log2((visits[known] + kinds[known]) / kinds[known])
            if shorter is None:
                below = np.full(len(every), 8.0)
            else:
                below = shorter[1][np.searchsorted(shorter[0], every & (mask >> _U(8))), i]
            bits[:, i] = escape[np.searchsorted(contexts, every >> _U(8)), i] + below
            bits[np.searchsorted(every, keys), i] = np.log2((visits[at] + kinds[at]) / n)
        shorter = every, bits
        model.gram_keys.append(every)
        model.bits.append(bits.astype(np.float32))
        model.context_keys.append(contexts)
        model.escapes.append(escape.astype(np.float32))
    return model


class Coder:
    """Code lengths of texts under all languages of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.grams = [Lookup(k) for k in model.gram_keys]
        self.contexts = [Lookup(k) for k in model.context_keys]

    def _bits(self, keys: np.ndarray, order: int) -> np.ndarray:
        keys = keys & _U((1 << (8 * (order + 1))) - 1)
        at = self.grams[order].find(keys)
        out = self.model.bits[order][at]  # rows of -1 are replaced
        rest = np.flatnonzero(at < 0)
        if len(rest):
            context = self.contexts[order].find(keys[rest] >> _U(8))
            escape = np.where((context >= 0)[:, None], self.model.escapes[order][context], np.float32(0))
            below = np.full((len(rest), out.shape[1]), 8, dtype=np.float32) if order == 0 else self._bits(keys[rest], order - 1)
            out[rest] = escape + below
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        total = np.zeros((len(offsets) - 1, len(self.model.languages)))
        for a, b in ts.slices(offsets, 1 << 18):
            cut = offsets[a : b + 1] - offsets[a]
            bits = self._bits(grams(data[offsets[a] : offsets[b]], cut), ORDER)
            full = np.flatnonzero(np.diff(cut))
            if len(full):
                total[a + full] = np.add.reduceat(bits, cut[full], axis=0, dtype=np.float64)
        return total


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", train_bytes: int = TRAIN_BYTES) -> Model:
    """The model learnt from all rows given that have a text and a language."""
    bucket = F.floor(-F.log2((F.shiftrightunsigned(F.xxhash64(id_col, text_col), 11) + 1) / F.lit(float(1 << 53))) * 16)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), bucket.alias("bucket")).where("lang is not null and octet_length(text) > 0")
    size = F.greatest(F.octet_length("text"), F.lit(SMALL)).cast("long")
    taken = buckets_within(((r.lang, r.bucket, r["size"]) for r in rows.groupBy("lang", "bucket").agg(F.sum(size).alias("size")).collect()), train_bytes)
    if not taken:
        return Model([], [], [], [], [])
    wanted = docs.sparkSession.createDataFrame([(lang, b) for lang, own in taken.items() for b in own], "lang string, bucket long")
    sample = rows.join(F.broadcast(wanted), ["lang", "bucket"]).select("lang", "text")
    without = [lang for lang, own in taken.items() if not own]
    if without:  # none of its buckets fits: the beginning of one text
        begin = F.substring("text", 1, max(1, train_bytes // 4))
        sample = sample.unionAll(rows.where(F.col("lang").isin(without)).groupBy("lang").agg(F.min_by(begin, F.xxhash64("text")).alias("text")))
    schema = T._parse_datatype_string("lang string, gram long, n long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            offsets, data = ts.buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in ts.slices(offsets):
                cut = offsets[a : b + 1] - offsets[a]
                keys = grams(data[offsets[a] : offsets[b]], cut)
                known = {x: i for i, x in enumerate(dict.fromkeys(names[a:b]))}
                of = np.repeat(np.array([known[x] for x in names[a:b]]), np.diff(cut))
                for name, i in known.items():
                    own, n = np.unique(keys[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), type=pa.string()), pa.array(own.view(np.int64)), pa.array(n)], schema=arrow)

    found = sample.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(taken)
    codes = found.column("lang").combine_chunks().dictionary_encode()
    place = {x: i for i, x in enumerate(codes.dictionary.to_pylist())}
    lang, gram, n = codes.indices.to_numpy(), found.column("gram").to_numpy().view(_U), found.column("n").to_numpy()
    return build(languages, [(gram[lang == place.get(x, -1)], n[lang == place.get(x, -1)]) for x in languages])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None, mark: str = "") -> DataFrame:
    """Per document its id, lang_pred, score and bits_per_byte (under that language); `also`: further columns
    to hand on; `mark`: put before the new names, where they would clash with those."""
    frame, names, places = carried(docs, id_col, text_col, also)
    new = T._parse_datatype_string(f"{mark}lang_pred string, {mark}score double, {mark}bits_per_byte double").fields
    schema = T.StructType([*[docs.schema[c] for c in names], *new])
    letters = frame.withColumn("__letters", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    arrow, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        coder = Coder(shared.value) if shared.value.languages else None
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            has = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            for a, b in ts.slices(offsets):
                known = has[a:b] if coder else np.zeros(b - a, dtype=bool)
                n = np.maximum(np.diff(offsets[a : b + 1]), 1)
                if coder:
                    bits = coder.lengths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(b - a), best]
                    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    pred = [coder.model.languages[i] if k else "und" for i, k in zip(best, known)]
                    columns = [pa.array(pred), pa.array(np.where(known, share, 0.0)), pa.array(least / n, mask=~known)]
                else:
                    columns = [pa.array(["und"] * (b - a)), pa.array(np.zeros(b - a)), pa.nulls(b - a, pa.float64())]
                given = [batch.column(i).slice(a, b - a) for i in places]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*given, *columns], arrow)], schema=arrow)

    return letters.mapInArrow(run, schema)

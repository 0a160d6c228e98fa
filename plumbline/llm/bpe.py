"""BPE encoding and decoding with content-defined chunk reuse.

Every whole text is cut into chunks where its own bytes say so: where a rolling hash of the last WINDOW bytes ends in
ZERO_BITS zero bits, whether inside a word or not. Equal passages are thus cut alike wherever they stand, and the ids of
each distinct chunk are made once and kept for all texts that a worker reads. A chunk is known by its bytes, not by a hash.

What is kept of a chunk are the ids between its first and its last white space. The pre-tokeniser drops white space and
never spans it, so these hold wherever the chunk stands. Around each join a window is encoded anew: it grows until it
starts a pre-token at the same place as the left side and as the right side, from where on all agree, or reaches white
space on that side. In most texts it takes in the one word that was cut. New chunks and windows are made of words, and a
worker keeps the ids of those too.

Both stores take a bounded part of memory (MAX_CHUNKS words of MAX_BYTES, chunks of CHUNK_BYTES): when they are full, what was
met only once goes. No chunk moves between workers: a worker encodes again what only others have met.
The tokenizer is read once by the driver and broadcast (one vocabulary file).

Defined results: null and empty texts have no tokens and decode to an empty text; repeated documents
are encoded each by itself; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textscan as ts
from .common import carried, held

#: Words that a worker keeps, their bytes and ids, and the bytes and ids of its chunks.
MAX_CHUNKS = 1 << 20
MAX_BYTES = 48 << 20
CHUNK_BYTES = 16 << 20
#: Bytes of the shortest chunk, and of those that the rolling hash takes in.
LEAST = 64
WINDOW = 8
#: A chunk holds about 2^ZERO_BITS bytes.
ZERO_BITS = 10
#: Positions hashed at once.
BLOCK = 1 << 16
#: Half of the first repair window, in characters.
REPAIR = 16
#: Words given to the tokenizer at once.
GROUP = 256

_U = np.uint64


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces values[start : start + size], one after the other."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return values[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


class Growing:
    """An array that is extended at its end."""

    def __init__(self, kind):
        self.data, self.size = np.empty(1 << 16, dtype=kind), 0

    def extend(self, more: np.ndarray) -> int:
        at, need = self.size, self.size + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data[:at], np.empty(max(need, 2 * at) - at, dtype=self.data.dtype)])
        self.data[at:need] = more
        self.size = need
        return at


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Content-defined cuts inside of texts, at character starts; each depends on the bytes of its own text alone."""
    good = []
    for first in range(WINDOW, len(data), BLOCK):
        at = np.arange(first, min(first + BLOCK, len(data)))
        rolling = ts.span_hashes(ts.running(data[first - WINDOW : at[-1]]), at - first, at - first + WINDOW)
        good.append(at[(rolling & _U((1 << ZERO_BITS) - 1) == 0) & (data[at] & 0xC0 != 0x80)])
    at = np.concatenate(good) if good else np.zeros(0, dtype=np.int64)
    text = np.searchsorted(offsets, at, side="right") - 1
    begins, ends = offsets[text], offsets[text + 1]
    found, last = [], 0
    for p, begin, end in zip(at.tolist(), begins.tolist(), ends.tolist()):
        if p - max(last, begin) >= LEAST and end - p >= LEAST:
            found.append(p)
            last = p
    return np.array(found, dtype=np.int64)


class Kept:
    """What was made of some bytes, in two generations of half the size: when the younger is full, the elder goes, but for what was met since."""

    def __init__(self, size: int):
        self.half, self.used, self.young, self.old = size // 2, 0, {}, {}

    def get(self, key: bytes):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, *found)
        return found

    def put(self, key: bytes, value, size: int) -> None:
        if self.used + size > self.half:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[key] = value, size
        self.used += size


class Encoder:
    """Encodes chunks and whole texts; keeps what it has encoded."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        one = self._batch(["a b\n c", "a", "b", "c"])
        if one[0] != one[1] + one[2] + one[3]:
            raise ValueError("chunk reuse needs a pre-tokeniser that drops white space")
        added = self.tok.get_added_tokens_decoder().values()
        if any(x.lstrip or x.rstrip or any(c.isspace() for c in x.content) for x in added):
            raise ValueError("chunk reuse needs added tokens that white space is no part of")
        #: A window must see the whole of an added token that a join cuts.
        self.half = max([REPAIR, *[len(x.content) + 1 for x in added]])
        self.joined = json.loads(tokenizer_json).get("decoder") is None
        special = [(i, x.content) for i, x in self.tok.get_added_tokens_decoder().items() if x.special]
        self.mark = special[0] if special else None
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.names = [(self.tok.id_to_token(i) or "").encode() for i in range(size)]
        self.chunks, self.parts = Kept(CHUNK_BYTES), Kept(CHUNK_BYTES)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=_U)
        self.rows = np.zeros(0, dtype=np.int32)
        self.at, self.n, self.uses, self.raw_at, self.raw_n = (Growing(np.int32) for _ in range(5))
        self.ids, self.raw = Growing(np.int32), Growing(np.uint8)

    def _make_room(self) -> None:
        """Keeps the words that were met again, or none if those alone fill the store."""
        used = self.uses.data[self.rows] > 1
        keys, rows = self.keys[used], self.rows[used]
        n, raw_n = self.n.data[rows], self.raw_n.data[rows]
        ids = gather(self.ids.data, self.at.data[rows], n)
        raw = gather(self.raw.data, self.raw_at.data[rows], raw_n)
        self.clear()
        if len(keys) > MAX_CHUNKS // 2 or len(ids) * 4 + len(raw) > MAX_BYTES // 2:
            return
        self.keys, self.rows = keys, np.arange(len(keys), dtype=np.int32)
        for grown, kept in ((self.ids, ids), (self.raw, raw), (self.raw_n, raw_n), (self.raw_at, np.cumsum(raw_n) - raw_n), (self.n, n), (self.at, np.cumsum(n) - n), (self.uses, np.ones(len(keys), dtype=np.int64))):
            grown.extend(kept)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each word. Many go to the tokenizer as one text, parted by a special token: it is
        cut out first, so what stands between two of them is encoded by itself."""
        if self.mark is None:
            return self._batch(chunks)
        mark_id, mark = self.mark
        odd = {mark[0], mark[-1]}
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if c and odd.isdisjoint(c)]
        for k in range(0, len(plain), GROUP):
            some = plain[k : k + GROUP]
            ids = self._batch([mark.join([chunks[i] for i in some])])[0]
            ids.append(mark_id)
            at = 0
            for i in some:
                to = ids.index(mark_id, at)
                out[i] = ids[at:to]
                at = to + 1
        rest = [i for i in range(len(chunks)) if out[i] is None]
        for i, own in zip(rest, self._batch([chunks[i] for i in rest])):
            out[i] = own
        return out

    def _encode(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids, and for each the character where its pre-token starts, or -1 inside one."""
        e = self.tok.encode(chunk, add_special_tokens=False)
        starts, last = [], object()
        for word, (a, _) in zip(e.word_ids, e.offsets):
            starts.append(-1 if word is not None and word == last else a)
            last = word if word is not None else object()
        return e.ids, starts

    def _part(self, raw: bytes) -> tuple[list[int], list[int]]:
        found = self.parts.get(raw)
        if found is None:
            found = self._encode(raw.decode()), 16 * len(raw) + 400
            self.parts.put(raw, *found)
        return found[0]

    def run_ids(self, parts: list[bytes]) -> list[int]:
        """Ids of a run without white space that cuts went through: those of its parts, repaired at their joins."""
        run = b"".join(parts).decode()
        ids, starts, p = [], [], 0
        for part in parts:
            own_ids, own_starts = self._part(part)
            end = p + len(part.decode())
            half = self.half
            keep = from_mid = to_mid = from_right = 0
            mid_ids, mid_starts, a = [], [], 0
            while p:
                a, b = max(0, p - half), min(end, p + half)
                mid_ids, mid_starts = self._encode(run[a:b])
                mid_at = {a + s: i for i, s in enumerate(mid_starts) if s >= 0}
                keep, from_mid, left = self._left(starts, mid_at, a, p)
                right_at = {p + s: i for i, s in enumerate(own_starts) if 0 < s < b - p and p + s in mid_at}
                if (left or a == 0) and (right_at or b == end):
                    right = min(right_at, default=None)
                    from_right, to_mid = (right_at[right], mid_at[right]) if right_at else (len(own_ids), len(mid_ids))
                    break
                half *= 2
            del ids[keep:], starts[keep:]
            ids += mid_ids[from_mid:to_mid] + own_ids[from_right:]
            starts += [s if s < 0 else s + a for s in mid_starts[from_mid:to_mid]] + [s if s < 0 else s + p for s in own_starts[from_right:]]
            p = end
        return ids

    @staticmethod
    def _left(starts: list[int], mid_at: dict[int, int], a: int, p: int) -> tuple[int, int, bool]:
        """How many ids of the left side stay, the window's first id after them, and whether both start a pre-token there."""
        for i in range(len(starts) - 1, -1, -1):
            s = starts[i]
            if 0 <= s < a:
                break
            if s < p and s in mid_at and (s > a or a == 0):
                return i, mid_at[s], True
        return 0, 0, False

    def lookup(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The store's row of each word; words not yet in it are encoded. A word is known if its bytes are those kept under its hash."""
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MAX_CHUNKS or self.ids.size * 4 + self.raw.size > MAX_BYTES:
            self._make_room()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        rows = np.empty(len(distinct), dtype=np.int32)
        rows[known] = self.rows[place[known]]
        self.uses.data[rows[known]] += 1
        new = np.flatnonzero(~known)
        if len(new):
            rows[new] = self._add(where[new], starts, ends, data)
            self.keys = np.insert(self.keys, place[new], distinct[new])
            self.rows = np.insert(self.rows, place[new], rows[new])
        out = rows[back]
        odd = np.flatnonzero(~self._same(out, starts, ends, data))
        if len(odd):  # other bytes of the same hash: encoded by themselves, and kept under no hash
            out[odd] = self._add(odd, starts, ends, data)
        return out

    def _same(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        n = ends - starts
        same = self.raw_n.data[rows] == n
        held = np.flatnonzero(same & (n > 0))
        if len(held):
            n = n[held]
            equal = gather(self.raw.data, self.raw_at.data[rows[held]], n) == gather(data, starts[held], n)
            same[held] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return same

    def _add(self, where: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        raw = [data[a:b].tobytes() for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        ids = self._apart([r.decode() for r in raw])
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(sizes.sum()))
        at = self.ids.extend(flat)
        first = self.at.extend(at + np.cumsum(sizes) - sizes)
        self.n.extend(sizes)
        raw_n = (ends - starts)[where]
        self.raw_n.extend(raw_n)
        self.raw_at.extend(self.raw.extend(np.frombuffer(b"".join(raw), dtype=np.uint8)) + np.cumsum(raw_n) - raw_n)
        self.uses.extend(np.ones(len(ids), dtype=np.int64))
        return first + np.arange(len(ids))

    def _of_words(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces that begin and end with white space, or have none around them in their texts."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        found = ts.words(data, np.cumsum([0, *map(len, pieces)]), ts.NOT_SPACE, low=data)
        rows = self.lookup(found.hashes, found.starts, found.ends, data)
        sizes = self.n.data[rows]
        ids = gather(self.ids.data, self.at.data[rows], sizes)
        return np.split(ids, np.concatenate([[0], np.cumsum(sizes)])[found.first[1:-1]])

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes | list[bytes]], list[int]]:
        """What the texts are made of, in order: the inside of a chunk, from its first to its last white space (bytes), and between
        two of them the parts of the run that the cuts went through (a list); and the number of pieces before each text."""
        text = data.tobytes()
        edges = np.unique(np.concatenate([offsets, cuts(data, offsets)]))
        begins, ends = edges[:-1], edges[1:]
        space = np.append(np.flatnonzero(~ts.NOT_SPACE[data]), len(data))
        first = space[np.searchsorted(space, begins)]
        last = space[np.searchsorted(space, ends) - 1] + 1
        pieces, before, k, n = [], [0], 0, len(begins)
        chunks = list(zip(begins.tolist(), first.tolist(), last.tolist(), ends.tolist()))
        for end in offsets[1:].tolist():
            run = []
            while k < n and chunks[k][0] < end:
                a, f, t, b = chunks[k]
                if f >= b:
                    run.append(text[a:b])
                else:
                    pieces += [[*run, text[a:f]], text[f:t]]
                    run = [text[t:b]]
                k += 1
            pieces.append(run)
            before.append(len(pieces))
        return pieces, before

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token offsets and ids, byte offsets and bytes of the decoded texts."""
        pieces, before = self._pieces(data, offsets)
        out: list = [None] * len(pieces)
        new: dict[bytes, list[int]] = {}
        for i, piece in enumerate(pieces):
            if isinstance(piece, bytes):
                kept = self.chunks.get(piece)
                if kept is not None:
                    out[i] = kept[0]
                    continue
                new.setdefault(piece, []).append(i)
                continue
            parts = [x for x in piece if x]
            if len(parts) > 1 and max(map(len, parts)) > self.half:
                out[i] = np.array(self.run_ids(parts), dtype=np.int32)
            else:  # the first window takes in the whole run, or no cut went through it
                new.setdefault(b"".join(parts), []).append(i)
        for (piece, places), ids in zip(new.items(), self._of_words(list(new)) if new else []):
            for i in places:
                out[i] = ids
            if isinstance(pieces[places[0]], bytes):
                self.chunks.put(piece, ids.copy(), len(piece) + ids.nbytes + 200)
        at = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])[before]
        ids = np.concatenate([np.zeros(0, dtype=np.int32), *out])
        every, ends = ids.tolist(), at.tolist()
        if self.joined:
            names = [self.names[i] for i in every]
            texts = [b" ".join(names[a:b]) for a, b in zip(ends, ends[1:])]
        else:
            texts = [self.tok.decode(every[a:b], skip_special_tokens=False).encode() for a, b in zip(ends, ends[1:])]
        return at, ids, np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), dtype=np.uint8)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None, mark: str = "") -> DataFrame:
    """Per document its id, ids (array of int) and decoded (the text those ids stand for); `also`: further
    columns to hand on; `mark`: put before the new names, where they would clash with those."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    frame, names, places = carried(docs, id_col, text_col, also)
    schema = T.StructType([*[docs.schema[c] for c in names], *T._parse_datatype_string(f"{mark}ids array<int>, {mark}decoded string").fields])
    return frame.mapInArrow(_task(source, to_arrow_schema(schema), places), schema)


def _task(source, schema: pa.Schema, places: list[int]):
    name = uuid.uuid4().hex

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        encoder = held(name, lambda: Encoder(source.value))
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            for a, b in ts.slices(offsets):
                at, ids, text_at, text = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                decoded = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(text_at.astype(np.int64)), pa.py_buffer(text))
                columns = [*[batch.column(i).slice(a, b - a) for i in places], lists, decoded]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
    return run

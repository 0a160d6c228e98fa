"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, over a whole corpus.

Texts are shuffled once, by full text, and counted on the way: each distinct text is encoded and
aligned once, however many documents hold it. Where neither tokenizer can have a token go from what is no
white space into the blank after it (see can_cut), texts are cut before such blanks into units: a text's
tokens and groups are those of its units, one after the other, and a worker encodes a unit that it has just
met only once. Other tokenizers get whole texts. Both encodings of a text are byte ranges; where a range
of A and one of B end at the same byte, the text is cut, and what lies between two cuts is a group. The
tokens that end there are linked, and the count of an id pair is the number of its links in all
documents: each distinct text gives its links once, times its number of documents.

Pair counts go back to the texts by a broadcast of the MAX_PAIRS most frequent pairs at most; rarer
pairs, if there are more, by a shuffle, in which no pair is frequent. The measures of a text go to its
documents by its SHA-256; those of texts that many documents share are dealt out (see dealt_join).

Defined results: a null or empty text, and one that either encoding does not give back byte by byte
(with a blank before it), has no tokens: all its figures are 0, its groups are empty. Repeated rows
count each. Strings of special tokens are ordinary text. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textscan as ts
from .common import dealt_join, dropped, written

#: Pairs in one broadcast: 24 bytes each.
MAX_PAIRS = 1 << 20
SIZES = "n_a", "n_b", "n_groups", "n_links"
#: A worker forgets the units it knows when they are more than these, or their characters.
MAX_UNITS, MAX_CHARS = 1 << 17, 1 << 22
#: Bytes of units encoded as one text.
RUN_BYTES = 1 << 14
#: The blank that a unit begins with, in a text without the blank before it.
CUT = re.compile(r"(?<=\S) ")


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Ragged:
    """Byte strings, one after the other."""

    def __init__(self, items: list[bytes]):
        self.sizes = np.array([len(x) for x in items], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(items), dtype=np.uint8)

    def joined(self, which: np.ndarray) -> np.ndarray:
        sizes = self.sizes[which]
        shift = self.starts[which] - (np.cumsum(sizes) - sizes)
        return self.data[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


def can_cut(a_json: str, b_model: bytes) -> bool:
    """Whether both tokenizers give a text the tokens of its units, one after the other. A: byte-level words by the usual expression, in
    which white space but begins a word, and nothing else that looks across. B: BPE of the text as it is, without a piece in which
    white space follows anything else, so that no merge reaches across."""
    from sentencepiece import sentencepiece_model_pb2

    a, b = json.loads(a_json), sentencepiece_model_pb2.ModelProto.FromString(b_model)
    words, model, norm = a.get("pre_tokenizer") or {}, a["model"], b.normalizer_spec
    return (
        words.get("type") == "ByteLevel" and words["use_regex"] and not words["add_prefix_space"] and not a.get("normalizer") and not a.get("post_processor")
        and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("fuse_unk")
        and all(x["special"] for x in a.get("added_tokens", ()))
        and b.trainer_spec.model_type == 2 and b.trainer_spec.byte_fallback and not b.trainer_spec.treat_whitespace_as_suffix
        and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        and not any(x.type == x.USER_DEFINED or "▁" in x.piece.lstrip("▁") for x in b.pieces)
    )


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=sum(map(len, ids)))


class Aligner:
    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        a_names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = Ragged([bytes(letters[c] for c in x) if letters.keys() >= set(x) else x.encode() for x in a_names])
        b_names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = Ragged([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(b_names)])
        self.size_a, self.size_b = len(a_names), len(b_names)
        self.blank = self.b.encode("a ")[len(self.b.encode("a")):]
        self.cuts = can_cut(a_json, b_model)
        self.forget()
        self.numbers = Ragged([b"%d," % i for i in range(max(len(a_names), len(b_names)))])

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # unit without its first blank -> its number
        self.chars = 0
        self.groups: list[bytes] = []
        self.sizes = np.empty((4, 0), dtype=np.int64)  # n_a, n_b, n_groups, and where its pairs begin
        self.pairs = np.empty(0, dtype=np.int64)

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        found = self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)
        return [x.ids for x in found], [x or self.blank for x in self.b.encode(texts, num_threads=1)]

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """For each text, none empty, the sizes, the groups as bytes, and its distinct links (pair, n): offsets and both columns."""
        if len(self.known) > MAX_UNITS or self.chars > MAX_CHARS:
            self.forget()
        parts = [CUT.split(x) for x in texts] if self.cuts else [[x] for x in texts]
        numbers = self._numbers(parts)
        starts = np.cumsum([0, *map(len, parts)])
        if len(bad := np.flatnonzero(np.add.reduceat(self.sizes[0][numbers] == 0, starts[:-1]))):
            for i in bad.tolist():  # a text is given back or not as a whole
                parts[i] = [texts[i]]
            numbers = self._numbers(parts)
            starts = np.cumsum([0, *map(len, parts)])
        n_a, n_b, n_groups = (np.add.reduceat(x[numbers], starts[:-1]) for x in self.sizes[:3])
        each, begin = self.sizes[2][numbers], self.sizes[3][numbers]
        shift = begin - (np.cumsum(each) - each)
        pairs = self.pairs[np.repeat(shift, each) + np.arange(int(each.sum()))]
        span = self.size_a * self.size_b
        linked = np.sort(np.repeat(np.arange(len(texts)), n_groups) * span + pairs)
        at = np.flatnonzero(np.diff(linked, prepend=-1))
        of, pair = np.divmod(linked[at], span)
        cuts, flat = starts.tolist(), [self.groups[i] for i in numbers.tolist()]
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_groups,
            "groups": [b";".join(flat[p:q]) for p, q in zip(cuts, cuts[1:])],
            "offsets": np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]),
            "pair": pair, "n": np.diff(at, append=len(linked)),
        }

    def _numbers(self, parts: list[list[str]]) -> np.ndarray:
        """The numbers of all units, one after the other; those not known yet are encoded."""
        fresh = set(chain.from_iterable(parts)).difference(self.known)
        if fresh:
            alone = [x for x in fresh if not self.cuts or not x or x[-1].isspace()]
            fresh = [*fresh.difference(alone), *alone]
            sizes, groups, pairs = self._units(fresh, len(fresh) - len(alone))
            sizes[3] = len(self.pairs) + np.cumsum(sizes[2]) - sizes[2]
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.chars += sum(map(len, fresh))
            self.groups += groups
            self.sizes, self.pairs = np.concatenate([self.sizes, sizes], axis=1), np.concatenate([self.pairs, pairs])
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=sum(map(len, parts)))

    def _tokens(self, units: list[str], runs: list[tuple[int, int]]) -> tuple[list[list[int]], list[list[int]], list[int]]:
        """The tokens of runs of units, each encoded as one text, and the units that are not given back: these have none."""
        rows = [" ".join(units[p:q]) for p, q in runs]
        a, b = self.encoded(rows)
        if all(self._given(table, ids, rows) for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            return a, b, []
        all_a, all_b, lost = [], [], []
        for (p, q), row, own_a, own_b in zip(runs, rows, a, b):
            own = [own_a], [own_b], []
            if not (self._given(self.a_bytes, [own_a], [row]) and self._given(self.b_bytes, [own_b], [row])):
                own = ([], [], [p]) if q == p + 1 else self._tokens(units, [(i, i + 1) for i in range(p, q)])
            for out, more in zip((all_a, all_b, lost), own):
                out += more
        return all_a, all_b, lost

    @staticmethod
    def _given(table: Ragged, ids: list[list[int]], rows: list[str]) -> bool:
        """Whether the tokens of each text are its bytes, with a blank before them."""
        raw, flat = [b" " + x.encode() for x in rows], _flat(ids)
        ends = np.concatenate([[0], np.cumsum(table.sizes[flat])])[np.cumsum([len(x) for x in ids])]
        return np.array_equal(ends, np.cumsum([len(x) for x in raw])) and np.array_equal(table.joined(flat), np.frombuffer(b"".join(raw), dtype=np.uint8))

    def _units(self, units: list[str], joined: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """The sizes of units, their groups as bytes, and their links as pairs. The first `joined`, which end in no white space, are
        encoded many at a time, as a text that is cut between them."""
        spans = np.fromiter((len(x.encode()) + 1 for x in units), dtype=np.int64, count=len(units))
        marks = np.flatnonzero(np.diff(np.cumsum(spans[:joined]) // RUN_BYTES, prepend=-1)).tolist()
        runs = [*zip(marks, [*marks[1:], joined]), *((i, i + 1) for i in range(joined, len(units)))]
        a, b, lost = self._tokens(units, runs)
        spans[lost] = 0
        all_a, all_b, ends = _flat(a), _flat(b), np.cumsum(spans)
        a_end, b_end = np.cumsum(self.a_bytes.sizes[all_a]), np.cumsum(self.b_bytes.sizes[all_b])
        a_cut, b_cut = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
        count = lambda at: np.diff(np.searchsorted(at, ends, side="right"), prepend=0)
        n_a, n_b, n_groups = count(a_end), count(b_end), count(a_end[a_cut])
        return np.stack([n_a, n_b, n_groups, n_groups]), self._groups(all_a, all_b, a_cut, b_cut, n_a, n_b), all_a[a_cut] * self.size_b + all_b[b_cut]

    def _groups(self, a, b, a_cut, b_cut, n_a, n_b) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` for each text: ids of A, then of B, by group."""
        of_a, of_b = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        a_through, b_before = np.flatnonzero(a_cut) + 1, np.concatenate([[0], np.flatnonzero(b_cut) + 1])
        place_a, place_b = np.arange(len(a)) + b_before[of_a], np.arange(len(b)) + a_through[of_b]
        ids, marks = np.empty(len(a) + len(b), dtype=np.int64), np.empty(len(a) + len(b), dtype=np.uint8)
        ids[place_a], ids[place_b] = a, b
        marks[place_a], marks[place_b] = np.where(a_cut, ord("|"), ord(",")), np.where(b_cut, ord(";"), ord(","))
        out = self.numbers.joined(ids)
        ends = np.cumsum(self.numbers.sizes[ids])
        out[ends - 1] = marks
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        data = out.tobytes()
        return [data[p : max(p, q - 1)] for p, q in zip(cuts, cuts[1:])]


_aligners: dict[str, Aligner] = {}


def _aligned(texts: DataFrame, a_path: str, b_path: str, digests: bool) -> tuple[DataFrame, int]:
    """key (SHA-256), copies, sizes, groups and links (pair, n) of each of the distinct texts (text, copies); and the factor in a pair's number."""
    context = texts.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    source, name = context.broadcast((a_json, b_model)), uuid.uuid4().hex
    schema = T._parse_datatype_string("key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair: long, n: int>>")
    arrow = to_arrow_schema(schema)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        aligner = _aligners.get(name)
        if aligner is None:
            _aligners.clear()
            aligner = _aligners[name] = Aligner(*source.value)
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            for a, b in ts.slices(offsets):
                cuts = (offsets[a : b + 1] - offsets[a]).tolist()
                piece = data[offsets[a] : offsets[b]].tobytes()
                raw = [piece[p:q] for p, q in zip(cuts, cuts[1:])]
                found = aligner.align([x.decode() for x in raw])
                groups = [hashlib.sha256(g).hexdigest() if digests and g else g.decode() for g in found["groups"]]
                links = pa.StructArray.from_arrays([pa.array(found["pair"], type=pa.int64()), pa.array(found["n"], type=pa.int32())], ["pair", "n"])
                lists = pa.ListArray.from_arrays(pa.array(found["offsets"], type=pa.int32()), links)
                columns = [pa.array([hashlib.sha256(x).digest() for x in raw]), batch.column(1).slice(a, b - a), *[pa.array(found[c]) for c in SIZES], pa.array(groups, type=pa.string()), lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return written(texts.select("text", "copies").mapInArrow(run, schema), "aligned"), Aligner(a_json, b_model).size_b


def _counted(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, count (links in all documents) and best (whether no pair of the same B id has a higher count)."""
    counts = aligned.select("copies", F.inline("links")).groupBy("pair").agg(F.sum(F.col("copies") * F.col("n")).alias("count"))
    counts = written(counts, "pair_counts")
    b_id = (F.col("pair") % size_b).alias("b_id")
    most = counts.groupBy(b_id).agg(F.max("count").alias("most"))
    made = written(counts.select("pair", "count", b_id).join(most, "b_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    dropped(counts)
    return made


def _frequent(pairs: DataFrame, limit: int) -> Column | None:
    """A condition that holds for the most frequent pairs, limit at most; None: all pairs are so few."""
    levels = pairs.groupBy(F.floor(F.log2("count") * 4).alias("level")).agg(F.count("*").alias("n"), F.min("count").alias("least")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        total += r.n
        if total > limit:
            return F.col("count") >= (1 << 62 if least is None else least)
        least = r.least
    return None


def _measures(aligned: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """key, n_best and count_sum of the texts that have links."""
    each = aligned.select("key", F.inline("links"))
    frequent = _frequent(pairs, limit)
    if frequent is None:
        found = each.join(F.broadcast(pairs), "pair")
    else:
        top = each.join(F.broadcast(pairs.where(frequent)), "pair", "left")
        rare = top.where("count is null").select("pair", "key", "n").join(pairs.where(~frequent).hint("merge"), "pair")
        found = top.where("count is not null").unionByName(rare)
    return found.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """a_id, b_id and count of the linked id pairs of a corpus, and whether the count is its B id's highest."""
    aligned, size_b = _aligned(_distinct(docs, text_col), a_path, b_path, True)
    return _counted(aligned, size_b).select(F.expr(f"pair div {size_b}").cast("int").alias("a_id"), (F.col("pair") % size_b).cast("int").alias("b_id"), "count", "best")


def _distinct(docs: DataFrame, text_col: str) -> DataFrame:
    texts = docs.select(F.col(text_col).alias("text")).where("text != ''")
    return texts.groupBy("text").agg(F.count("*").alias("copies"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Per document its id, n_a, n_b, n_groups, n_links, n_best (links whose pair has its B id's highest count),
    count_sum (of its links' pairs) and groups, as `a1,a2|b1;a3|b2,b3`; digests: as the SHA-256 of that."""
    aligned, size_b = _aligned(_distinct(docs, text_col), a_path, b_path, digests)
    pairs = _counted(aligned, size_b)
    texts = written(aligned.drop("links").join(_measures(aligned, pairs, max_pairs), "key", "left"), "measures")
    dropped(aligned, pairs)
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)).alias("key"))
    found = dealt_join(rows, texts, "key", "copies")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(F.col("id").alias(id_col), *[zero(c) for c in (*SIZES, "n_best", "count_sum")], F.coalesce("groups", F.lit("")).alias("groups"))

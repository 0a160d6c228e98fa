"""SimHash near-dedup by a hierarchical index in Gray order.

A document's fingerprint has a bit for each that is set in over half of the hashes of its word shingles,
repeats included. Documents of equal fingerprints are one code from here on. Codes that differ in DISTANCE bits
or fewer are linked.

How the work is dealt out: the bits are parted in DISTANCE + 1 blocks, and linked codes agree in one of
them at least, so each code goes to one group for each block. A group of more than LIMIT codes is parted
once more by the bits left, in DISTANCE + 1 blocks again; after DEPTH times few bits are left, and with them few codes.

In a group, codes are sorted by Gray rank, so that neighbours differ in few bits. Runs of FAN codes make
a node, runs of FAN nodes an upper one. A node keeps the bits in which all its codes agree, without those
that the nodes above it have already: the differences to a code sought are added up on the way down, and a
node is left, with all below it, when they pass DISTANCE. It is also left when all its codes are in the component
of the code sought. The first codes of a group go first, then twice as many and so on: a group of near copies is one
component after a few of them, so no group is paired with itself. A task hands on one link for each code that hangs
on another one. Components over all groups are found by star contraction.

Defined results: words are parted by white space, A-Z lower-cased; with fewer words than a shingle has, all of
them are one; null and wordless texts have fingerprint zero, which links like any other. Repeated rows get
equal results. A null id counts for no component_id but is given one through others. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textscan as ts
from .common import dealt_join, dropped, written
from .components import components

WORDS = 3
SEED = 42
DISTANCE = 3
BITS = 64
#: Shingles hashed at once.
BLOCK = 1 << 16
#: Codes of a group before it is parted once more, and how often that is done.
LIMIT = 1 << 16
DEPTH = 4
#: Codes that a task indexes at once, unless one group has more.
TASK_CODES = 1 << 17
FAN = 16
#: Nodes and codes visited at once.
FRONT = 1 << 21

_U = np.uint64


def shingle_bounds(sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of each shingle in the words written one blank apart, and by text the number of its first shingle."""
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    n = np.diff(first)
    width = np.minimum(n, WORDS)
    shingles = np.where(n > 0, n - width + 1, 0)
    before = np.concatenate([[0], np.cumsum(shingles)])
    word = np.repeat(first[:-1] - before[:-1], shingles) + np.arange(int(before[-1]))
    last = word + np.repeat(width, shingles) - 1
    return starts[word], starts[last] + sizes[last], before


def codes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text."""
    import xxhash

    starts, ends = ts.word_bounds(data, offsets, ts.NOT_SPACE)
    sizes = ends - starts
    plain = np.full(int(sizes.sum()) + len(sizes), 0x20, dtype=np.uint8)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    plain[np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes) + within] = ts.LOWER[data[np.repeat(starts, sizes) + within]]
    text = plain.tobytes()
    a, b, before = shingle_bounds(sizes, np.searchsorted(starts, offsets))
    n = np.diff(before)
    ones = np.zeros((len(n), BITS), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(a), BLOCK):
        to = min(k + BLOCK, len(a))
        hashes = np.array([digest(text[p:q], SEED) for p, q in zip(a[k:to].tolist(), b[k:to].tolist())], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS)
        own = np.searchsorted(before, np.arange(k, to), side="right") - 1
        new = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(_U)


def _coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    given = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    schema = T.StructType([given.schema["id"], T.StructField("code", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            for a, b in ts.slices(offsets):
                codes = codes_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a).cast(arrow.field(0).type), pa.array(codes.view(np.int64))], schema=arrow)

    return written(given.mapInArrow(run, schema), "coded")


def masks(depth: int) -> list[int]:
    """The bits that groups of each kind agree in, after so many partings; four kinds follow from each kind before."""
    kinds = [0]
    for _ in range(depth):
        more = []
        for kind in kinds:
            left = [1 << i for i in range(BITS) if not kind >> i & 1]
            cuts = [len(left) * i // (DISTANCE + 1) for i in range(DISTANCE + 2)]
            more += [kind | sum(left[a:b]) for a, b in zip(cuts, cuts[1:])]
        kinds = more
    return kinds


def _dealt(codes: DataFrame, limit: int) -> DataFrame:
    """(group, code): the groups in which each code is compared."""
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    now, done = codes.select("code", F.lit(0).alias("kind")), None
    for depth in range(1, DEPTH + 1):
        known = F.array(*[F.lit(signed(x)) for x in masks(depth)])
        each = now.select("code", F.explode(F.sequence(F.col("kind") * (DISTANCE + 1), F.col("kind") * (DISTANCE + 1) + DISTANCE)).alias("kind"))
        each = each.select("code", "kind", F.xxhash64(F.lit(depth), "kind", F.col("code").bitwiseAND(F.element_at(known, F.col("kind") + 1))).alias("group"))
        if depth == DEPTH:
            full = None
        else:
            full = each.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("group", F.lit(True).alias("full"))
            full = written(full, "full_groups")
        if full is None or full.isEmpty():
            small, now = each, None
        else:
            marked = each.join(full, "group", "left")
            small, now = marked.where("full is null"), marked.where("full").select("code", "kind")
        small = small.select("group", "code")
        done = small if done is None else done.unionAll(small)
        if now is None:
            break
    return done


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U(k)
    return rank


class GrayIndex:
    """Codes of several groups, each under a tree of its own; all trees are as high as the highest."""

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), groups))
        self.codes, groups = codes[order], groups[order]
        n = len(codes)
        self.labels = np.arange(n)
        heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        sizes = np.diff(heads, append=n)
        self.place = np.arange(n) - np.repeat(heads, sizes)  # of a code in its group
        self.root = np.repeat(np.arange(len(heads)), sizes)
        # from the codes up: first code and first child of each node
        firsts, children = [np.arange(n)], []
        counts = sizes
        while len(counts) and (counts.max() > 1 or not children):
            upper = -(-counts // FAN)
            begin = np.repeat(np.cumsum(counts) - counts, upper)
            within = np.arange(int(upper.sum())) - np.repeat(np.cumsum(upper) - upper, upper)
            child = begin + within * FAN
            children.append(np.append(child, int(counts.sum())))
            firsts.append(firsts[-1][child])
            counts = upper
        self.firsts, self.children = firsts, children
        self.agree, self.pattern = [np.full(n, ~_U(0))], [self.codes]
        for first in firsts[1:]:
            both, some = np.bitwise_and.reduceat(self.codes, first), np.bitwise_or.reduceat(self.codes, first)
            self.agree.append(~(both ^ some))
            self.pattern.append(both)
        # the bits that a node adds to those of the node above it
        self.own = []
        for level, child in enumerate(children):
            self.own.append(self.agree[level] & ~np.repeat(self.agree[level + 1], np.diff(child)))

    def _uniform(self) -> list[np.ndarray]:
        """For each node the label that all its codes have, or -1."""
        out = [self.labels]
        for first in self.firsts[1:]:
            least, most = np.minimum.reduceat(self.labels, first), np.maximum.reduceat(self.labels, first)
            out.append(np.where(least == most, least, -1))
        return out

    def _near(self, sought: np.ndarray, uniform: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs of codes (later than the one sought, of another component); None: too many at once."""
        top = len(self.children)
        node, query, differ = self.root[sought], sought, np.zeros(len(sought), dtype=np.int64)
        for level in range(top - 1, -1, -1):
            child = self.children[level]
            n = child[node + 1] - child[node]
            if n.sum() > FRONT and len(sought) > 1:
                return None
            shift = np.repeat(child[node] - (np.cumsum(n) - n), n)
            node, query, differ = shift + np.arange(int(n.sum())), np.repeat(query, n), np.repeat(differ, n)
            differ = differ + np.bitwise_count((self.codes[query] ^ self.pattern[level][node]) & self.own[level][node])
            ends = np.append(self.firsts[level][1:], len(self.codes))
            stays = (differ <= DISTANCE) & (ends[node] > query + 1) & (uniform[level][node] != self.labels[query])
            node, query, differ = node[stays], query[stays], differ[stays]
        return query, node

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            low, high = np.minimum(self.labels[a], self.labels[b]), np.maximum(self.labels[a], self.labels[b])
            if np.array_equal(low, high):
                return
            above = np.arange(len(self.labels))
            np.minimum.at(above, high, low)
            while not np.array_equal(above, above[above]):
                above = above[above]
            self.labels = above[self.labels]

    def link(self) -> None:
        """Gives linked codes of a group one label, the place of the first of them."""
        size, turn = int(self.place.max()) + 1, 0
        while (1 << turn) - 1 < size:
            at = np.flatnonzero((self.place >= (1 << turn) - 1) & (self.place < (2 << turn) - 1))
            parts = [at[k : k + BLOCK] for k in range(0, len(at), BLOCK)][::-1]
            uniform = self._uniform()
            while parts:
                part = parts.pop()
                found = self._near(part, uniform)
                if found is None:
                    parts += [part[len(part) // 2 :], part[: len(part) // 2]]
                elif len(found[0]):
                    self._merge(*found)
                    uniform = self._uniform()
            turn += 1


def _links(dealt: DataFrame) -> DataFrame:
    """Links (a, b) that connect the linked codes of each group, one for each code but the first."""
    schema = T._parse_datatype_string("a long, b long")
    arrow = to_arrow_schema(schema)

    def linked(groups, codes):
        index = GrayIndex(groups, codes.view(_U))
        index.link()
        more = np.flatnonzero(index.labels != np.arange(len(codes)))
        return pa.RecordBatch.from_arrays([pa.array(index.codes[x].view(np.int64)) for x in (index.labels[more], more)], schema=arrow)

    def run(batches):
        groups, codes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            groups, codes = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((groups, codes)))
            if len(codes) >= TASK_CODES:
                cut = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
                if cut:
                    yield linked(groups[:cut], codes[:cut])
                    groups, codes = groups[cut:], codes[cut:]
        if len(codes):
            yield linked(groups, codes)

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document its id, fingerprint (16 hexadecimal digits), and component_id, the smallest id that links lead to, its own included."""
    coded = _coded(docs, id_col, text_col)
    codes = written(coded.groupBy("code").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "codes")
    links = written(_links(_dealt(codes, limit)), "links")
    labels = components(links)
    linked = written(labels.join(codes.select(F.col("code").alias("node"), "id"), "node"), "linked")
    least = written(linked.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("members")), "least")
    near = dealt_join(linked.select("node", "component"), least, "component", "members").select(F.col("node").alias("code"), "least")
    facts = written(codes.join(near, "code", "left").select("code", "copies", F.coalesce("least", "id").alias("component_id")), "facts")
    dropped(codes, links, linked, least)
    found = dealt_join(coded, facts, "code", "copies")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")

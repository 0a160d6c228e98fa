"""N-gram Jaccard join: documents whose sets of word shingles overlap by 75 % or more, by prefix trees.

All sets are ordered alike: shingles seldom met first, those met often last, by count. Two sets that
overlap by enough share at least s of the first n - ceil(0.75 n) + s shingles of that order (their
prefixes; s is 1 + n / 16, more where both sizes are known), so documents meet under their prefix
shingles, and those that meet under too few are not tried. Equal sets are one node from the start.

Who meets whom becomes probes: of a small group every pair, of a large one each set against the
group's leader, the set with most shingles in large groups (a pair's meetings in large groups, which are
not counted, are taken to be as many as the set with fewer of them has; a set with fewer of them than any
link of its size takes has no need of large groups). For every probe set, the
ordered sets to be tried are stored in a trie whose paths share equal beginnings; it is walked from
the root, the overlap so far is carried down, and a branch is left when even all its remaining
shingles would be too few. Groups with one leader make a cluster. Sets of a cluster that are not yet in
its leader's component are then probes against the sets of the cluster of about their size, in blocks,
and report one link per component found: no link that matters to the components is missed, and no group
is paired with itself. Components are found by star contraction.

Only ids, sizes and hashes move, but for the texts of sets that are tried. What is broadcast is the
list of frequent shingles, MAX_FREQUENT at most; being an order only, it changes no result. A probe
with many sets is dealt out in blocks of BLOCK shingles. Groups are made in parts of the shingles, and
probes in rounds, so that what is on disk at a time stays a share of the corpus, however many probes there are.

Defined results: words are parted by white space, A-Z lower-cased; with fewer words than a shingle
has, the whole text is one; null and wordless texts have no shingles, link with nothing and are their
own component; repeated rows get equal results; a null id has a component_id only through others.
Sets and shingles are told apart by 64-bit hashes. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textscan as ts
from .common import dropped, members, written
from .components import components

WORDS = 5
#: Shingles counted together before the repeated ones are passed on.
CHUNK = 1_000_000
FREQUENT = 4
MAX_FREQUENT = 1 << 18
#: The largest group of which every pair is tried at once.
SMALL = 32
#: A prefix is longer than it must be by a shingle for each so many of its set.
SPARE = 16
BLOCK = 1 << 20
#: Sizes of linked sets differ by less than this factor, so they lie in the same band of sizes or in the next.
BAND = 1.34
#: Shingles of the corpus whose groups are made together; beyond MAX_PARTS times as many, parts grow.
PART = 1 << 25
MAX_PARTS = 8
#: Shingles that a round of probes moves: so many, or this share of all shingles of the corpus if that is more.
ROUND = 1 << 25
ROUND_SHARE = 0.4
#: What a set that is wanted costs, in times its shingles: its text, its shingles as they are written and joined.
WANTED = 2.5

_U = np.uint64


def prefix_size(n: int) -> int:
    """n - ceil(3 n / 4), and as many more as two prefixes of linked sets must share."""
    return n - (3 * n + 3) // 4 + 1 + n // SPARE


def linked(overlap: int, n: int, m: int) -> bool:
    """Whether 100 * overlap >= 75 * union."""
    return 7 * overlap >= 3 * (n + m)


def _frequent(docs: DataFrame, text_col: str) -> np.ndarray:
    """Shingles found again and again, least often first; at most MAX_FREQUENT."""
    schema = T._parse_datatype_string("shingle long, n long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, size = [], 0

        def counted():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            more = n > 1
            return pa.RecordBatch.from_arrays([pa.array(keys[more].view(np.int64)), pa.array(n[more])], schema=arrow)

        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            for a, b in ts.slices(offsets):
                found = ts.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ts.NOT_SPACE)
                for own in ts.shingle_sets(found, WORDS):
                    held.append(own)
                    size += len(own)
                    if size >= CHUNK:
                        yield counted()
                        held, size = [], 0
        if held:
            yield counted()

    found = written(docs.select(text_col).mapInArrow(run, schema).groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "frequent")
    least, total = FREQUENT, 0
    for r in found.groupBy(F.floor(F.log2("n") * 4).alias("level")).agg(F.count("*").alias("c"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        total += r.c
        if total > MAX_FREQUENT:
            break
        least = r.n
    else:
        least = FREQUENT
    if total > MAX_FREQUENT and least == FREQUENT:
        dropped(found)
        return np.zeros(0, dtype=_U)
    rows = found.where(F.col("n") >= least).toPandas()
    dropped(found)
    keys, n = rows.shingle.to_numpy(dtype=np.int64).view(_U), rows.n.to_numpy(dtype=np.int64)
    return keys[np.lexsort((keys, n))]


class Order:
    """The global order of shingles: those not listed by hash, then the listed ones."""

    def __init__(self, frequent: np.ndarray):
        by_hash = np.argsort(frequent)
        self.keys, self.rank = frequent[by_hash], by_hash

    def sort(self, own: np.ndarray) -> np.ndarray:
        """A set in ascending order of hashes, put in the global order."""
        if not len(self.keys) or not len(own):
            return own
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        listed = self.keys[at] == own
        if not listed.any():
            return own
        return np.concatenate([own[~listed], own[listed][np.argsort(self.rank[at[listed]])]])


def _digest(own: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(ts.mix(np.array([ts.mix(own ^ _U(0xA5A5)).sum(dtype=_U) + _U(len(own))]))[0].view(np.int64))


def _sets(docs: DataFrame, id_col: str, text_col: str, order, also: list[str]) -> DataFrame:
    """One row per document: id, `also`, key (hash of its set), n (size), prefix (its first shingles)."""
    given = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.struct(F.lit(0).alias("row"), *also).alias("also"))
    schema = T.StructType([given.schema["id"], given.schema["also"], *T._parse_datatype_string("key long, n long, prefix array<long>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            for a, b in ts.slices(offsets):
                found = ts.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ts.NOT_SPACE)
                keys, sizes, prefixes = [], [], []
                for own in ts.shingle_sets(found, WORDS):
                    keys.append(_digest(own) if len(own) else None)
                    sizes.append(len(own))
                    prefixes.append(order.value.sort(own)[: prefix_size(len(own))].view(np.int64) if len(own) else own.view(np.int64))
                at = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(prefixes)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(a, b - a).cast(arrow.field(0).type), batch.column(2).slice(a, b - a).cast(arrow.field(1).type),
                    pa.array(keys, type=pa.int64()), pa.array(sizes, type=pa.int64()), lists.cast(arrow.field(4).type)], schema=arrow)

    return written(given.mapInArrow(run, schema), "sets")


def _size_fits(n: str, m: str):
    """n <= m and not too small to be linked with it."""
    return (F.col(n) <= F.col(m)) & (4 * F.col(n) >= 3 * F.col(m))


def enough(n: int, m: int) -> int:
    """Prefix shingles that linked sets of these sizes share. Up to the end of the prefix that ends first in the
    order, what they share is in both prefixes; after it, at most the rest of that set."""
    return max(1, -(-3 * (n + m) // 7) - max(n - prefix_size(n), m - prefix_size(m)))


def _enough(n: str, m: str):
    """enough() of two columns."""
    rest = [F.floor((3 * F.col(x) + 3) / 4) - 1 - F.floor(F.col(x) / SPARE) for x in (n, m)]
    return F.greatest(F.lit(1), F.floor((3 * (F.col(n) + F.col(m)) + 6) / 7) - F.greatest(*rest))


def _least_enough(n: str):
    """No more than enough(n, m) for any m that fits."""
    return 1 + F.floor(F.floor((3 * F.col(n) + 3) / 4) / SPARE)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _groups(sets: DataFrame, part: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Meetings in small groups (a, an, b, bn, c: how many), and the large groups (shingle, key, n), of a part of the shingles.
    Equal sets count once."""
    posted = sets.where("n > 0").select(F.explode("prefix").alias("shingle"), "key", "n")
    if parts > 1:
        posted = posted.where(F.pmod("shingle", F.lit(parts)) == part)
    group = Window.partitionBy("shingle")
    shared = written(posted.repartition("shingle").distinct().withColumn("m", F.count("*").over(group)).where("m > 1"), "shared")
    large = written(shared.where(F.col("m") > SMALL).select("shingle", "key", "n"), "large")
    few = (shared.where(F.col("m") <= SMALL).groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("members"))
           .groupBy("members").agg(F.count("*").alias("c")))
    met = (few.select("members", "c", F.posexplode("members").alias("i", "x"))
           .select("c", "x", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("y"))
           .select(F.col("x.key").alias("a"), F.col("x.n").alias("an"), F.col("y.key").alias("b"), F.col("y.n").alias("bn"), "c").where(_size_fits("an", "bn")))
    met = written(met.groupBy("a", "an", "b", "bn").agg(F.sum("c").alias("c")), "met")
    dropped(shared)
    return met, large


def _meetings(sets: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, an, b, bn) to be tried, and the clusters (leader, key, n and more) of large groups. total: shingles of all sets."""
    parts = min(MAX_PARTS, 1 + total // PART)
    made = [_groups(sets, k, parts) for k in range(parts)]
    met = _all([x for x, _ in made]).groupBy("a", "an", "b", "bn").agg(F.sum("c").alias("c"))
    large = _all([x for _, x in made])
    uncounted = written(large.groupBy("key").agg(F.count("*").alias("u")), "uncounted")
    known = met
    for side in ("a", "b"):
        known = known.join(uncounted.select(F.col("key").alias(side), F.col("u").alias(f"{side}u")), side, "left")
    pairs = known.where(F.col("c") + F.least(F.coalesce("au", F.lit(0)), F.coalesce("bu", F.lit(0))) >= _enough("an", "bn")).select("a", "an", "b", "bn")
    ranked = large.join(uncounted, "key").where(F.col("u") >= _least_enough("n"))
    leaders = ranked.groupBy("shingle").agg(F.max(F.struct("u", "key", "n")).alias("leader")).select("shingle", "leader.key", "leader.n", "leader.u").toDF("shingle", "leader", "ln", "lu")
    clusters = written(ranked.join(leaders, "shingle").select("leader", "ln", "lu", "key", "n", "u").distinct(), "clusters")
    spokes = clusters.where("leader != key").select(
        F.least("u", "lu").alias("u"), *[F.when(F.col("n") < F.col("ln"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("key", "leader", "a"), ("n", "ln", "an"), ("leader", "key", "b"), ("ln", "n", "bn"))])
    pairs = pairs.unionAll(spokes.where(F.col("u") >= _enough("an", "bn")).select("a", "an", "b", "bn"))
    tried = written(pairs.where(_size_fits("an", "bn")).distinct(), "pairs")
    dropped(uncounted, *[x for both in made for x in both])
    return tried, clusters


class _Node:
    __slots__ = ("path", "branches", "ends", "least", "most")

    def __init__(self, path: np.ndarray, least: int, most: int):
        self.path, self.branches, self.ends, self.least, self.most = path, {}, [], least, most


class Trie:
    """Ordered sets by their equal beginnings; every node knows the smallest and largest set below it."""

    def __init__(self):
        self.root = _Node(np.zeros(0, dtype=np.int64), 1 << 62, 0)

    def add(self, name: int, own: np.ndarray) -> None:
        node, at, n = self.root, 0, len(own)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.ends.append(name)
                return
            child = node.branches.get(int(own[at]))
            if child is None:
                leaf = _Node(own[at:], n, n)
                leaf.ends.append(name)
                node.branches[int(own[at])] = leaf
                return
            k = min(len(child.path), n - at)
            differ = np.flatnonzero(child.path[:k] != own[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(child.path):  # part the path where the new set leaves it
                upper = _Node(child.path[:same], child.least, child.most)
                child.path = child.path[same:]
                upper.branches[int(child.path[0])] = child
                node.branches[int(own[at])] = upper
                child = upper
            node, at = child, at + same

    def probe(self, own: np.ndarray) -> list[int]:
        """Names of the sets linked with this one."""
        sought, n, found = np.sort(own), len(own), []
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if len(node.path):
                at = np.searchsorted(sought, node.path)
                at[at == n] = 0
                overlap += int((sought[at] == node.path).sum())
                depth += len(node.path)
            if node.ends and linked(overlap, n, depth):
                found.extend(node.ends)
            for child in node.branches.values():
                reach = overlap + min(n - overlap, child.most - depth)
                if linked(reach, n, child.least):
                    stack.append((child, depth, overlap))
        return found


def _ordered(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, wanted: DataFrame, order) -> DataFrame:
    """key and ordered shingles of each of the wanted sets, from the text of one document that has it."""
    schema = T._parse_datatype_string("key long, shingles array<long>")
    arrow = to_arrow_schema(schema)
    holders = sets.where("n > 0").groupBy("key").agg(F.min("id").alias("id")).join(wanted, "key")
    texts = members(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), holders).withColumnRenamed("id", "own_id").join(holders, F.col("own_id").eqNullSafe(F.col("id"))).select("key", "text")

    def run(batches):
        for batch in batches:
            offsets, data = ts.buffers(batch.column(1))
            expected = batch.column(0).to_numpy()
            for a, b in ts.slices(offsets):
                found = ts.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ts.NOT_SPACE)
                keys, lists = [], []
                for i, own in enumerate(ts.shingle_sets(found, WORDS)):
                    if len(own) and _digest(own) == expected[a + i]:  # another text may bear the same id
                        keys.append(expected[a + i])
                        lists.append(order.value.sort(own).view(np.int64))
                if keys:
                    at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys, type=pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists))).cast(arrow.field(1).type)], schema=arrow)

    return written(texts.mapInArrow(run, schema).dropDuplicates(["key"]), "ordered")


def _runs(batches, roles: int):
    """(name, sets of each role) for runs of rows (name columns..., role, key, component, shingles) of one name."""
    name, held = None, None
    for batch in batches:
        *names, role, key, component = (batch.column(i).to_pylist() for i in range(batch.num_columns - 1))
        lists = batch.column(batch.num_columns - 1)
        at, shingles = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, own in enumerate(zip(*names)):
            if own != name:
                if held:
                    yield name, held
                name, held = own, [[] for _ in range(roles)]
            held[role[i]].append((key[i], component[i], shingles[at[i] : at[i + 1]].copy()))
    if held:
        yield name, held


def _links(rows: DataFrame, ordered: DataFrame, names: list[str]) -> DataFrame:
    """Links (a, b) of probes (role 1) with the sets (role 0) of the same name, one for each component but their own."""
    schema = T._parse_datatype_string("a long, b long")
    arrow = to_arrow_schema(schema)
    full = rows.join(ordered, "key").select(*names, "role", "key", "component", "shingles")
    dealt = full.repartition(*names).sortWithinPartitions(*names)

    def run(batches):
        for _, (sets, probes) in _runs(batches, 2):
            trie, component = Trie(), {}
            for key, own, shingles in sets:
                trie.add(key, shingles)
                component[key] = own
            a, b = [], []
            for key, own, shingles in probes:
                near = {component[x]: x for x in trie.probe(shingles) if x != key}
                near.pop(own, None)
                a += [key] * len(near)
                b += near.values()
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], schema=arrow)

    return dealt.mapInArrow(run, schema)


def _tried(pairs: DataFrame) -> DataFrame:
    """Probes for the pairs (a, an, b, bn): each a is one for its partners, in blocks of BLOCK shingles."""
    blocks = pairs.groupBy("a", "an").agg(F.ceil(F.sum("bn") / BLOCK).cast("int").alias("blocks"))
    partners = pairs.join(blocks.drop("an"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), F.col("b").alias("key"), F.col("bn").alias("n"))
    probes = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), F.col("a").alias("key"), F.col("an").alias("n"))
    return partners.unionAll(probes).withColumn("component", F.col("key"))


def _rest(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """(leader, key, n, component, led) of the clusters that hold sets outside their leader's component (not led)."""
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    named = clusters.join(label("key"), "key", "left").join(label("leader"), "leader", "left")
    named = named.select("leader", "key", "n", F.coalesce("key_c", "key").alias("component"), (F.coalesce("key_c", "key") == F.coalesce("leader_c", "leader")).alias("led"))
    return named.join(named.where(~F.col("led")).select("leader").distinct(), "leader", "left_semi")


def _cluster_probes(rest: DataFrame) -> DataFrame:
    """Probes for the sets outside their leader's component, against the sets of the cluster in their band of sizes
    and the next ones: blocks of BLOCK shingles of either kind."""
    sets = rest.withColumn("band", F.floor(F.log("n") / np.log(BAND)).cast("int"))
    probes = sets.where(~F.col("led")).withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    named = ["leader", "band"]
    count = lambda rows, name: rows.groupBy(*named).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias(name))
    parts = count(sets, "blocks").join(count(probes, "turns"), named)
    own, upto = F.xxhash64("key"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sets = sets.join(parts, named).select(*named, F.pmod(own, F.col("blocks")).cast("int").alias("block"), upto("turns").alias("turn"), F.lit(0).alias("role"), "key", "n", "component")
    probes = probes.join(parts, named).select(*named, upto("blocks").alias("block"), F.pmod(own, F.col("turns")).cast("int").alias("turn"), F.lit(1).alias("role"), "key", "n", "component")
    return sets.unionAll(probes)


def _found(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, probes: DataFrame, names: list[str], order, total: int) -> list[DataFrame]:
    """Links (a, b) of the probes, as tables by round. Sets are made from their texts for all rounds at once if they are few, else anew for each."""
    rows = written(probes, "probes")
    limit = max(ROUND, int(ROUND_SHARE * total))
    wanted = WANTED * (rows.select("key", "n").distinct().agg(F.sum("n")).head()[0] or 0)
    rounds = -(-int(wanted + (rows.agg(F.sum("n")).head()[0] or 0)) // limit)
    ordered = lambda some: _ordered(docs, id_col, text_col, sets, some.select("key").distinct(), order)
    every = ordered(rows) if rounds and wanted <= limit / 2 else None
    links = []
    for k in range(rounds):
        now = rows.where(F.pmod(F.xxhash64(*names), F.lit(rounds)) == k)
        own = ordered(now) if every is None else every
        links.append(written(_links(now, own, names), "links"))
        if every is None:
            dropped(own)
    dropped(rows, *([] if every is None else [every]))
    return links


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None) -> DataFrame:
    """Per document its id, n_shingles, component_id (the smallest id that links lead to, its own included),
    component (a hash that names the component, null without shingles) and the columns `also`, in a struct of that name."""
    order = docs.sparkSession.sparkContext.broadcast(Order(_frequent(docs, text_col)))
    full = _sets(docs, id_col, text_col, order, also or [])
    sets = written(full.drop("prefix"), "slim")
    total = sets.agg(F.sum("n")).head()[0] or 0
    pairs, clusters = _meetings(full, total)
    dropped(full)
    links = _found(docs, id_col, text_col, sets, _tried(pairs), ["a", "block"], order, total)
    labels = components(_all([pairs.select("a", "b").limit(0), *links]))
    rest = written(_rest(clusters, labels), "rest")
    dropped(clusters, pairs, *links)
    if not rest.isEmpty():
        more = _found(docs, id_col, text_col, sets, _cluster_probes(rest), ["leader", "band", "block", "turn"], order, total)
        labels = components(_all([labels.select(F.col("component").alias("a"), F.col("node").alias("b")), *more]))
        dropped(*more)
    nodes = (sets.where("n > 0").groupBy("key").agg(F.min("id").alias("id")).join(labels.withColumnRenamed("node", "key"), "key", "left")
             .select("key", "id", F.coalesce("component", "key").alias("component")))
    least = nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    known = nodes.join(least, "component").select("key", "component", "component_id")
    found = sets.select("id", "key", "n", "also").join(known, "key", "left")
    result = written(found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "component",
        F.col("also").dropFields("row").alias("also") if also else F.lit(None).cast("string").alias("also")), "joined")
    dropped(sets, rest)
    return result

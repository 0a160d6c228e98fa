"""Toxicity: interpolated Kneser-Ney word models, one per class, over one shared base.

A word's probability after the word before it is, for class c,

    P(w | v) = kept(v, w) / N(v) + (1 - sum of kept(v, .) / N(v)) * P(w)
    P(w)     = kept(w) / N + (1 - sum of kept / N) * P(s) * Q(w | s)
    P(s)     = kept(s) / N + (1 - sum of kept / N) * Q(s)

with s the word's beginning (first STEM bytes). N(v) counts the class's texts with the pair, and the lower
orders count continuations: in how many pairs of the class a word, or the words of a beginning, come second.
Q, the base that both classes share, has the shares of tokens of all documents, labelled or not.

kept is a count less its discount: D where the classes differ in the expression, and the whole count where they do not,
as for all rare ones, so that it passes to the shared backoff. They differ where a likelihood ratio statistic of the
numbers of texts of each class reaches a threshold that rises with the number of expressions. (A fixed discount alone
leaves chance differences of very many rare words, which outweigh the few words that matter in a long text.)

A document's figure is the difference of both log-likelihoods, divided by its number of words. A
logistic curve, fitted on labelled documents that gave no counts, turns it into a score from 0 to 1.

Counts are numbers of distinct texts, so repeats within a text or copies of it weigh once. The classes are learnt
from a bounded sample: per class the documents with the smallest hashes, TRAIN_BYTES in all.
What both classes share cancels, so the broadcast model holds only expressions that tell the classes apart.

Defined results: null, empty and wordless texts have no words and the figure of a text of unknown words; a doc_id labelled
several times is toxic if any label says so; null labels and ids do not count; without training
texts of both classes all scores are 0. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textscan as ts
from .common import buckets_within, carried, crc_bucket, dropped, let_go, small_batches, written

#: Bytes of text per class from which the model learns; small documents count as SMALL bytes.
TRAIN_BYTES = 32 << 20
SMALL = 64

STEM = 5
D = 0.75
#: An expression tells the classes apart if its statistic reaches this much per unit of ln(expressions), by level. Pairs
#: need more: those of a sentence that near copies share come together.
EVIDENCE = 3.0, 3.0, 4.0
#: Width of the bins in which figures of the calibration documents are counted, and their number.
BIN, BINS = 0.001, 4000
#: The curve used when there is nothing to fit it on.
SLOPE, MIDDLE = 300.0, 0.015

_U = np.uint64
WORD, BEGINNING, PAIR = 0, 1, 2


@dataclass
class Model:
    """Log ratios (toxic against ordinary) of expressions by level, keys ascending: of words and pairs those of their
    probabilities, of beginnings likewise; of histories those of the share that backs off. The curve's slope and intercept."""

    keys: list[np.ndarray]
    ratios: list[np.ndarray]
    histories: np.ndarray
    backoff: np.ndarray
    #: Of words that are not among the keys, on top of their beginning's; of other beginnings.
    other_words: float = 0.0
    other_beginnings: float = 0.0
    slope: float = SLOPE
    intercept: float = -SLOPE * MIDDLE
    fitted: bool = True

    @property
    def unknown(self) -> float:
        """The figure of a text of unknown words."""
        return self.other_words + self.other_beginnings


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ts.mix(before * _U(3) + word * _U(0x9E3779B97F4A7C15))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[ts.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and for each word its beginning, the pair with the word before, and that word."""
    found = ts.words(data, offsets, ts.ALNUM)
    h = found.hashes
    ends = np.minimum(found.ends, found.starts + STEM)
    stems = np.empty_like(h)
    at = 0
    while at < len(h):
        to = max(int(np.searchsorted(found.starts, found.starts[at] + ts.SLICE_BYTES)), at + 1)
        origin = found.starts[at]
        total = ts.running(ts.LOWER[data[origin : ends[at:to].max()]])
        stems[at:to] = ts.span_hashes(total, found.starts[at:to] - origin, ends[at:to] - origin)
        at = to
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = found.first[:-1]
    before[first[first < len(h)]] = _U(0)
    return found, stems, _pair(before, h), before


def _count_task(schema: pa.Schema):
    """(text, toxic) to rows of level, expression (the word before and the word; the word and its beginning; the beginning), and the texts of each class that have it."""

    def run(batches):
        let_go()
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in ts.slices(offsets):
                found, stems, pairs, before = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                text = np.repeat(np.arange(b - a), np.diff(found.first))
                none = np.zeros(len(stems), dtype=_U)
                for level, x, parts in ((WORD, found.hashes, (found.hashes, stems)), (BEGINNING, stems, (stems, none)), (PAIR, pairs, (before, found.hashes))):
                    order = np.lexsort((x, text))
                    own, of = x[order], text[order]
                    new = np.ones(len(own), dtype=bool)
                    new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
                    keys, where, back = np.unique(own[new], return_index=True, return_inverse=True)
                    yes = np.bincount(back, weights=toxic[a + of[new]], minlength=len(keys)).astype(np.int64)
                    every = np.bincount(back, minlength=len(keys))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(keys), level, dtype=np.int32)), *[pa.array(y[order][new][where].view(np.int64)) for y in parts],
                        pa.array(yes), pa.array(every - yes)], schema=schema)
    return run


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Labels of the sample: per class the documents with the smallest hashes, as many as hold `limit` bytes, but one at least."""
    bucket = F.floor(-F.log2((F.shiftrightunsigned(F.xxhash64(id_col), 11) + 1) / F.lit(float(1 << 53))) * 16)
    labels = labels.withColumn("bucket", bucket)
    size = F.greatest(F.octet_length(text_col), F.lit(SMALL)).cast("long")
    known = docs.select(id_col, size.alias("size"), (F.octet_length(text_col) > 0).alias("full")).where("size is not null").join(labels, id_col)
    sizes = known.groupBy("toxic", "bucket").agg(F.sum("size").alias("size")).collect()
    taken = buckets_within(((r.toxic, r.bucket, r["size"]) for r in sizes), limit)
    wanted = docs.sparkSession.createDataFrame([(toxic, b) for toxic, own in taken.items() for b in own], "toxic int, bucket long")
    sample = labels.join(F.broadcast(wanted), ["toxic", "bucket"]).select(id_col, "toxic", "fold")
    without = [toxic for toxic, own in taken.items() if not own]
    if without:
        one = known.where(F.col("toxic").isin(without) & F.col("full")).groupBy("toxic").agg(F.min_by(F.struct(id_col, "fold"), F.xxhash64(id_col)).alias("one"))
        sample = sample.unionAll(one.select(f"one.{id_col}", "toxic", "one.fold"))
    return sample


def _bounded(text_col: str, limit: int):
    """The text, or the beginning of one that is longer than the whole sample may be."""
    return F.when(F.octet_length(text_col) > limit, F.substring(text_col, 1, max(1, limit // 4))).otherwise(F.col(text_col)).alias(text_col)


def _statistic(t, o, n_t, n_o):
    """Likelihood ratio statistic of t of n_t against o of n_o."""
    p = (t + o) / (n_t + n_o)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    return 2 * (part(t, n_t * p) + part(o, n_o * p) + part(n_t - t, n_t * (1 - p)) + part(n_o - o, n_o * (1 - p)))


def _base(every: DataFrame, words: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of these words, tokens of these beginnings, and all tokens, in all texts (the only column of every).

    Each task adds up its texts and hands on one row per key it met; the keys are those of the sample's telling expressions."""
    schema = "level int, at int, n long"
    shared = every.sparkSession.sparkContext.broadcast((words, stems))

    def run(batches):
        let_go()
        keys = shared.value
        totals, tokens = [np.zeros(len(k), dtype=np.int64) for k in keys], 0
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            for a, b in ts.slices(offsets):
                found, own, _, _ = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                tokens += len(own)
                for k, total, x in zip(keys, totals, (found.hashes, own)):
                    at = np.searchsorted(k, x)
                    at[at == len(k)] = 0
                    if len(k):
                        total += np.bincount(at[k[at] == x], minlength=len(k))
        for level, n in ((WORD, totals[0]), (BEGINNING, totals[1]), (PAIR, np.array([tokens]))):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["level", "at", "n"])

    sums = every.mapInArrow(run, schema).groupBy("level", "at").agg(F.sum("n").alias("n")).collect()
    out = [np.zeros(len(words)), np.zeros(len(stems)), np.zeros(1)]
    for r in sums:
        out[r.level][r["at"]] = r.n
    return out[0], out[1], int(out[2][0])


def learn(texts: DataFrame, every: DataFrame) -> Model:
    """The model of texts (text, toxic: 0 or 1), distinct ones, over the base of all texts `every`, before its curve is fitted."""
    small_batches(texts.sparkSession)
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_t, n_o = float(n.get(1, 0)), float(n.get(0, 0))
    none, zero = np.zeros(0, dtype=_U), np.zeros(0)
    if not n_t or not n_o:
        return Model([none] * 3, [zero] * 3, none, zero, fitted=False)
    schema = T._parse_datatype_string("level int, a long, b long, t long, o long")
    parts = texts.mapInArrow(_count_task(to_arrow_schema(schema)), schema)
    # Rows of a task, added up by slices, are nearly all distinct: they are dealt out before they are added up, so that no task holds its own twice
    counts = written(parts.repartition("level", "a", "b").groupBy("level", "a", "b").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "counts")
    of = {r.level: r for r in counts.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("t") + F.col("o")).alias("texts")).collect()}
    needed = [EVIDENCE[level] * math.log((of[level].n if level in of else 0) + 1) for level in (WORD, BEGINNING, PAIR)]
    pairs = counts.where(F.col("level") == PAIR).select(F.col("a").alias("history"), F.col("b").alias("word"), "t", "o")
    after = written(pairs.groupBy("word").agg(F.sum((F.col("t") > 0).cast("long")).alias("c_t"), F.sum((F.col("o") > 0).cast("long")).alias("c_o")), "after")
    stem_of = counts.where(F.col("level") == WORD).select(F.col("a").alias("word"), F.col("b").alias("stem"), "t", "o")
    apart = _statistic(F.col("t"), F.col("o"), F.lit(n_t), F.lit(n_o))
    total = after.agg(F.sum("c_t").alias("t"), F.sum("c_o").alias("o")).head()
    word = after.join(stem_of.where(apart >= needed[WORD]).select("word", "stem"), "word").toPandas()
    stems = counts.where((F.col("level") == BEGINNING) & (apart >= needed[BEGINNING])).select(F.col("a").alias("stem"))
    beginning = after.join(stem_of.join(stems, "stem").select("word", "stem"), "word").groupBy("stem").agg(F.sum("c_t").alias("c_t"), F.sum("c_o").alias("c_o")).toPandas()
    # k texts of a history's h give a statistic of 2 * k * (ln(h) + 1) at most, so pairs of fewer cannot tell the classes apart
    least = needed[PAIR] / (2 * (math.log(max(of[PAIR].texts if PAIR in of else 1, 1)) + 1))
    before = pairs.groupBy("history").agg(F.sum("t").alias("h_t"), F.sum("o").alias("h_o"))
    telling = pairs.where(F.col("t") + F.col("o") >= least).join(before, "history").where(_statistic(F.col("t"), F.col("o"), F.col("h_t"), F.col("h_o")) >= needed[PAIR])
    pair = telling.join(stem_of.select("word", "stem"), "word").toPandas()
    dropped(counts, after)
    return _model(word, beginning, pair, total.t or 0, total.o or 0, every)


def _model(word, beginning, pair, n_t: int, n_o: int, every: DataFrame) -> Model:
    """The model of the telling words and beginnings with their continuation counts, and pairs with their counts and those of their histories."""
    unsigned = lambda column: column.to_numpy(dtype=np.int64).view(_U)
    all_words, at = np.unique(np.concatenate([unsigned(word.word), unsigned(pair.word)]), return_index=True)
    stem_of = np.concatenate([unsigned(word.stem), unsigned(pair.stem)])[at]
    all_stems = np.unique(np.concatenate([unsigned(beginning.stem), stem_of]))
    of_words, of_stems, tokens = _base(every, all_words, all_stems)
    of_stems = np.maximum(of_stems, 1)
    share = np.maximum(of_words, 1) / of_stems[np.searchsorted(all_stems, stem_of)]
    stem_at, word_at = np.searchsorted(all_stems, unsigned(beginning.stem)), np.searchsorted(all_words, unsigned(word.word))
    pair_at, histories = np.searchsorted(all_words, unsigned(pair.word)), unsigned(pair.history)
    own_histories, back = np.unique(histories, return_inverse=True)
    logs = []
    for c, n in (("t", n_t), ("o", n_o)):
        stems, words = np.zeros(len(all_stems)), np.zeros(len(all_words))
        stems[stem_at] = np.maximum(beginning[f"c_{c}"].to_numpy(dtype=float) - D, 0) / n
        words[word_at] = np.maximum(word[f"c_{c}"].to_numpy(dtype=float) - D, 0) / n
        rest_s, rest_w = 1 - stems.sum(), 1 - words.sum()
        stems += rest_s * of_stems / max(tokens, 1)
        words += rest_w * stems[np.searchsorted(all_stems, stem_of)] * share
        pairs = np.maximum(pair[c].to_numpy(dtype=float) - D, 0) / np.maximum(pair[f"h_{c}"].to_numpy(dtype=float), 1)
        rest_p = 1 - np.bincount(back, weights=pairs, minlength=len(own_histories))
        pairs += rest_p[back] * words[pair_at]
        logs.append([np.log(x) for x in (words[word_at], stems[stem_at], pairs, rest_p, rest_w, rest_s)])
    words, stems, pairs, backoff, other_words, other_stems = (t - o for t, o in zip(*logs))
    keys = [unsigned(word.word), unsigned(beginning.stem), _pair(histories, unsigned(pair.word))]
    order = [np.argsort(k) for k in keys]
    return Model([k[i] for k, i in zip(keys, order)], [x[i] for x, i in zip((words, stems, pairs), order)], own_histories, backoff, float(other_words), float(other_stems))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_bytes: int = TRAIN_BYTES) -> Model:
    """The model learnt from labelled documents whose id's crc32 modulo 5 is not 0 (1: the curve; 2 to 4: counts)."""
    known = (labels.select(F.col(id_col), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(id_col).agg(F.max("toxic").alias("toxic")).withColumn("fold", crc_bucket(id_col, 5)))
    docs = docs.select(id_col, text_col)
    sample = _sampled(docs, known.where("fold in (2, 3, 4)"), id_col, text_col, train_bytes)
    texts = written(docs.join(F.broadcast(sample), id_col).where(F.octet_length(text_col) > 0).select(_bounded(text_col, train_bytes), "toxic").distinct(), "sample")
    model = learn(texts, docs.select(text_col))
    dropped(texts)
    if not model.fitted:
        return model
    judge = _sampled(docs, known.where("fold = 1"), id_col, text_col, train_bytes)
    figures = figure(docs.join(F.broadcast(judge), id_col).select(id_col, text_col, "toxic"), model, id_col, text_col, ["toxic"])
    at = F.least(F.greatest(F.round(F.col("figure") / BIN), F.lit(-BINS)), F.lit(BINS)).cast("int")
    found = figures.groupBy(at.alias("at"), "toxic").count().collect()
    model.slope, model.intercept = _curve([(r.at * BIN, r.toxic, r["count"]) for r in found], model.unknown)
    return model


def _curve(points: list[tuple[float, int, int]], unknown: float = 0.0) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over (figure, toxic, number of documents).

    Its middle is where the fewest documents fall on the wrong side, halfway across the widest such gap, and above the figure of unknown words;
    the slope is the likeliest one, with targets drawn in a little from 0 and 1.
    """
    x, y, w = (np.array([p[i] for p in points], dtype=float) for i in range(3))
    if not len(x) or not w[y == 1].sum() or not w[y == 0].sum():
        return SLOPE, -SLOPE * (unknown + MIDDLE)
    at, back = np.unique(x, return_inverse=True)
    ones, zeros = (np.bincount(back, weights=w * (y == k), minlength=len(at)) for k in (1, 0))
    wrong = np.cumsum(ones) + zeros.sum() - np.cumsum(zeros)  # with the middle after each figure
    gaps = np.append(np.diff(at), BIN)
    best = np.flatnonzero(wrong == wrong.min())
    k = best[np.argmax(gaps[best])]
    middle = max(at[k] + gaps[k] / 2, unknown + BIN / 2)
    target = np.where(y == 1, (ones.sum() + 1) / (ones.sum() + 2), 1 / (zeros.sum() + 2))
    slopes = np.exp(np.linspace(np.log(5), np.log(5000), 200))
    z = slopes[:, None] * (x - middle)
    loss = (w * (np.logaddexp(0, z) - target * z)).sum(axis=1)
    slope = float(slopes[np.argmin(loss)])
    return slope, -slope * float(middle)


def _ratio(keys: np.ndarray, ratios: np.ndarray, x: np.ndarray, other: np.ndarray | float) -> np.ndarray:
    """The ratio of each x that is among the keys, and `other` for the rest."""
    if not len(keys):
        return np.broadcast_to(other, len(x)).astype(float)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return np.where(keys[at] == x, ratios[at], other)


def _figures(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, stems, pairs, before = _grams(data, offsets)
    own = model.other_words + _ratio(model.keys[BEGINNING], model.ratios[BEGINNING], stems, model.other_beginnings)
    own = _ratio(model.keys[WORD], model.ratios[WORD], found.hashes, own)
    own = _ratio(model.keys[PAIR], model.ratios[PAIR], pairs, own + _ratio(model.histories, model.backoff, before, 0.0))
    n = np.diff(found.first)
    text = np.repeat(np.arange(len(n)), n)
    return np.where(n > 0, np.bincount(text, weights=own, minlength=len(n)) / np.maximum(n, 1), model.unknown), n


def figure(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None, mark: str = "") -> DataFrame:
    """Per document its id, n_words and figure (log-likelihood ratio per word); `also`: further columns to
    hand on; `mark`: put before the new names, where they would clash with those."""
    frame, names, places = carried(docs, id_col, text_col, also)
    schema = T.StructType([*[docs.schema[c] for c in names], *T._parse_datatype_string(f"{mark}n_words long, {mark}figure double").fields])
    arrow, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        let_go()
        for batch in batches:
            offsets, data = ts.buffers(batch.column(0))
            for a, b in ts.slices(offsets):
                value, n = _figures(shared.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [*[batch.column(i).slice(a, b - a) for i in places], pa.array(n), pa.array(value)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return frame.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None, mark: str = "") -> DataFrame:
    """figure() with score (0 to 1) and predicted (1 if the score is 0.5 or more)."""
    value = 1 / (1 + F.exp(-(F.col(f"{mark}figure") * model.slope + model.intercept))) if model.fitted else F.lit(0.0)
    found = figure(docs, model, id_col, text_col, also, mark).withColumn(f"{mark}score", value)
    return found.withColumn(f"{mark}predicted", (F.col(f"{mark}score") >= 0.5).cast("int"))

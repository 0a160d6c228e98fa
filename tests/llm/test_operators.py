"""Each operator against a plain version of it, and on odd rows."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plumbline.llm import (
    bpe, components, decontaminate, html_pages, html_text, jaccard, language, licenses, lines, neighbours, queries, substrings, textscan, toxicity,
)
from tests.llm.conftest import CLASH, LINE, SCHEMA, odd_texts, rows_of

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(AZ))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


# --- words ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind, pattern", [(textscan.NOT_SPACE, SPACED), (textscan.ALNUM, ALNUM)])
def test_words(kind, pattern, monkeypatch):
    monkeypatch.setattr(textscan, "SLICE_BYTES", 50)  # words cross the pieces
    texts = odd_texts()[:8] + odd_texts()[9:] + ["x" * 500, "a" * 60 + " " + "b" * 60]
    offsets, data = textscan.buffers(pa.array(texts))
    found = textscan.words(data, offsets, kind)
    hashes = {}
    for i, text in enumerate(texts):
        own = found.hashes[found.first[i] : found.first[i + 1]].tolist()
        expected = words(text, pattern)
        assert len(own) == len(expected)
        for h, w in zip(own, expected):
            assert hashes.setdefault(h, w) == w
    assert len(set(hashes.values())) == len(hashes)


# --- 1 language ----------------------------------------------------------------------------------------


def plain_bits(counts, text, order):
    """Code length of bytes under a tree of counts {context: Counter}."""
    data = bytes(order) + bytes(textscan.LOWER[np.frombuffer(text.encode(), np.uint8)])
    total = 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts.get(data[i - k : i])
            if seen is None:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                total += np.log2(whole / seen[data[i]])
                break
            total += np.log2(whole / len(seen))
        else:
            total += 8
    return total


def test_code_lengths():
    train = {"a": "the cat sat on the mat and the rat", "b": "le chat est sur la table et le rat"}
    counts, grams = {}, []
    for text in train.values():
        own = defaultdict(Counter)
        data = bytes(language.ORDER) + text.encode()
        for i in range(language.ORDER, len(data)):
            for k in range(language.ORDER + 1):
                own[data[i - k : i]][data[i]] += 1
        counts[text] = own
        offsets, raw = textscan.buffers(pa.array([text]))
        grams.append(np.unique(language.grams(raw, offsets), return_counts=True))
    coder = language.Coder(language.build(list(train), grams))
    texts = ["the rat", "la table", "xyz the zzz", "", "Q"]
    offsets, raw = textscan.buffers(pa.array(texts))
    got = coder.lengths(raw, offsets)
    for i, text in enumerate(texts):
        for j, own in enumerate(train.values()):
            assert got[i, j] == pytest.approx(plain_bits(counts[own], text, language.ORDER), abs=1e-3)


def test_languages_held_out(spark):
    got = queries.op1_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(got) == len(truth) and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_of_odd_rows(spark, docs, nothing):
    model = language.fit(docs)
    got = language.identify(docs, model, also=["score"], mark="own_").collect()
    assert len(got) == docs.count() and all(0 <= r.own_score <= 1 for r in got)
    by_text = dict(zip([(r.doc_id, r.text) for r in docs.collect()], [None] * 99))
    assert {r.own_lang_pred for r in got if r.doc_id in (0, 1, 2, 11)} == {"und"} and by_text
    assert {r.own_lang_pred for r in got if r.doc_id == 5} == {"en"}
    none = language.fit(nothing)
    assert language.identify(nothing, none).count() == 0
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_languages_of_long_texts_are_learnt(spark):
    """A language of one long text, one that is a row many times, and one that has a long text before its short ones."""
    said = {"aa": "baba dodo lulu ", "bb": "kirix xanat zerok ", "cc": "mno pqr stu "}
    rows = [(1, said["aa"] * 2000, "aa")] + [(2, said["bb"] * 5, "bb")] * 300 + [(k, said["cc"] * (2000 if k < 120 else 3), "cc") for k in range(100, 140)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_bytes=4000)
    asked = spark.createDataFrame([(i, said[x] * 2) for i, x in enumerate(said)], "doc_id long, text string")
    assert model.languages == list(said) and {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()} == dict(enumerate(said))


# --- 2 Jaccard join ---------------------------------------------------------------------------------------


def plain_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                group[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def family_texts(seed, families=6, size=40):
    """Groups of texts at varying distances from each other, all with a common passage."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(4000)]
    common = [r.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 6, 30, 90, 200]))] + common
        for _ in range(size):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            if r.random() < 0.2:
                own = own[: r.randint(3, len(own))]
            texts.append(" ".join(own))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [1, 4, 1000])
def test_jaccard_components(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 500)
    texts = dict(enumerate(family_texts(small)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df).collect()}
    assert got == plain_components(texts)


def probed(monkeypatch):
    """Gets the shingles that each call of jaccard._links moves."""
    moved, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda rows, *rest: moved.append(rows.groupBy().sum("n").head()[0] or 0) or links(rows, *rest))
    return moved


def test_jaccard_chance_meetings_are_not_tried(spark, monkeypatch):
    """A shingle that many texts share, in no order of frequency, makes no cluster of texts that share nothing else."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "MAX_FREQUENT", 0)
    moved = probed(monkeypatch)
    texts = {i: "all of them begin so " + " ".join(f"w{i}x{k}" for k in range(40)) for i in range(100)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: (41, i) for i in texts} and not moved


def test_jaccard_in_parts_and_rounds(spark, monkeypatch):
    """Parts of shingles and rounds of probes change no component, and a round moves a share of all."""
    for name, value in (("SMALL", 4), ("BLOCK", 500), ("PART", 1), ("MAX_PARTS", 3), ("ROUND", 1), ("ROUND_SHARE", 1), ("MAX_FREQUENT", 0)):
        monkeypatch.setattr(jaccard, name, value)
    moved = probed(monkeypatch)
    texts = dict(enumerate(family_texts(4)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df).collect()} == plain_components(texts)
    assert len(moved) > 2 and max(moved) < sum(moved) / 2


def test_jaccard_enough(spark):
    """Prefixes of linked sets share that many; equally in Python and as a column."""
    r = random.Random(3)
    for _ in range(3000):
        n = r.randrange(1, 120)
        a = r.sample(range(10**6), n)
        b = r.sample(a, r.randrange(3 * n // 4, n + 1)) + r.sample(range(10**6, 2 * 10**6), r.randrange(n // 3 + 1))
        order = {x: r.random() for x in {*a, *b}}
        (p, q) = ({*sorted(x, key=order.get)[: jaccard.prefix_size(len(x))]} for x in (a, b))
        if b and jaccard.linked(len({*a} & {*b}), len(a), len(b)):
            assert len(p & q) >= jaccard.enough(len(a), len(b))
    sizes = [(n, m) for n in (*range(1, 70), 793, 1048577) for m in range(n, min(4 * n // 3, n + 70) + 1)]
    for x in spark.createDataFrame(sizes, "n long, m long").select("n", "m", jaccard._enough("n", "m").alias("e"), jaccard._least_enough("n").alias("x"), jaccard._least_enough("m").alias("y")).collect():
        assert x.e == jaccard.enough(x.n, x.m) >= max(x.x, x.y)


def test_jaccard_odd_rows(spark, docs, nothing):
    got = jaccard.jaccard_join(docs, also=["key"]).collect()
    assert len(got) == docs.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[2] == {(0, 2)}
    assert by[3] == {(1, 3), (2, 3)} and by[4] == {(1, 3)}
    assert {c for i in (5, 6, 7, None) for _, c in by[i]} == {5}
    assert jaccard.jaccard_join(nothing).count() == 0


def test_components_of_paths(spark):
    r = random.Random(1)
    nodes = list(range(300))
    r.shuffle(nodes)
    edges = [(a, b) for k in range(0, 300, 60) for a, b in zip(nodes[k : k + 60], nodes[k + 1 : k + 60])]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(nodes[k : k + 60]) for k in range(0, 300, 60) for n in nodes[k : k + 60]}


# --- 3 line dedup -----------------------------------------------------------------------------------------


def test_templates_recur(spark):
    r = random.Random(3)
    other = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(6))
    texts = [f"{other()}\nRead article number {i} in our archive now\n{other()}\nShare this page with all your {other().split()[0]} friends\n{i} 2 3 total" for i in range(30)]
    texts += ["a copy of one text\nwith two lines"] * 20 + ["", None, "All alone\n\n"]
    got = {x.doc_id: x for x in lines.dedup_lines(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5), also=["gone"]).collect()}
    for i in range(30):
        kept = texts[i].split("\n")
        assert got[i].text == "\n".join([kept[0], kept[2], kept[4]]) and (got[i].n_lines, got[i].n_dropped) == (5, 2)
    for i in range(30, len(texts)):
        assert got[i].text == texts[i] and got[i].n_dropped == 0


def test_templates_recur_in_any_surroundings(spark):
    """Blocks of several lines, lines between blank lines, the same neighbours everywhere, and two templates in one leaf."""
    r = random.Random(33)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    other = lambda: " ".join(word() for _ in range(8))
    head, foot = ["Skip to the main content", "Sign in to read more"], ["About this fine site", "All rights are kept here", "Made by hand with care"]
    middle = "This part stands alone between blank lines"
    texts, kept = [], []
    for i in range(60):
        mine = [other() for _ in range(6)]
        kind = "Click here now to follow our {} page on the site" if i % 2 else "Click here now and get his {} book by air mail"
        texts.append("\n".join([*head, mine[0], "", middle, "", *mine[1:5], kind.format(word()), mine[5], *foot]))
        kept.append("\n".join([mine[0], "", "", *mine[1:]]))
    body = [other() for _ in range(9)]
    copies = ["\n".join([*body, f"{word()} {word()}"]) for _ in range(40)]
    got = {x.doc_id: x for x in lines.dedup_lines(spark.createDataFrame(rows_of(texts + copies), SCHEMA).repartition(5)).collect()}
    assert [got[i].text for i in range(60)] == kept and {got[i].n_dropped for i in range(60)} == {7}
    assert [got[i].text for i in range(60, 100)] == copies


def test_lines_of_odd_rows(docs, nothing):
    got = lines.dedup_lines(docs, also=["gone", "key"])
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    assert lines.dedup_lines(nothing).count() == 0


# --- 4 toxicity ---------------------------------------------------------------------------------------------


def test_toxic_words_are_learnt(spark, nothing):
    r = random.Random(4)
    plain = [f"p{i}" for i in range(300)]
    texts, toxic = [], []
    for i in range(900):
        own = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic.append(int(r.random() < 0.2))
        for _ in range(toxic[-1] * r.randint(1, 3)):
            own.insert(r.randrange(len(own)), r.choice(["vileword", "nastyone", "nastytwo"]))
        texts.append(" ".join(own))
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i % 3] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {x.doc_id: x for x in toxicity.score(df, model, also=["score"], mark="own_").collect()}
    assert all((got[i].own_predicted == t) and (got[i].own_score >= 0.5) == bool(t) for i, t in enumerate(toxic))
    flat = toxicity.fit(df, labels.where("toxic = 0"))
    assert {x.score for x in toxicity.score(df, flat).collect()} == {0.0}
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0


def plain_figures(labelled, every, texts):
    """Kneser-Ney models of both classes with dictionaries, straight from the formulas of the module."""
    low = lambda t: words(t, ALNUM)
    d = toxicity.D
    n, df, of_pair = Counter(), Counter(), Counter()
    for t, c in labelled:
        w = low(t)
        n[c] += 1
        df.update({("w", x, c) for x in w} | {("s", x[: toxicity.STEM], c) for x in w})
        of_pair.update({(v, x, c) for v, x in zip([None, *w], w)})
    seen = {(v, x) for v, x, _ in of_pair}
    vocabulary, stems = {x for _, x in seen}, {x[: toxicity.STEM] for _, x in seen}
    tokens = [x for t in every for x in low(t or "")]
    q_w, q_s = Counter(tokens), Counter(x[: toxicity.STEM] for x in tokens)

    def told(t, o, n_t, n_o, level, size):
        p = (t + o) / (n_t + n_o)
        part = lambda x, e: x * math.log(x / e) if x else 0.0
        s = 2 * (part(t, n_t * p) + part(o, n_o * p) + part(n_t - t, n_t * (1 - p)) + part(n_o - o, n_o * (1 - p)))
        return s >= toxicity.EVIDENCE[level] * math.log(size + 1)

    hist = Counter()
    for (v, _, c), k in of_pair.items():
        hist[v, c] += k
    t_w = {x for x in vocabulary if told(df["w", x, 1], df["w", x, 0], n[1], n[0], 0, len(vocabulary))}
    t_s = {x for x in stems if told(df["s", x, 1], df["s", x, 0], n[1], n[0], 1, len(stems))}
    t_p = {(v, x) for v, x in seen if told(of_pair[v, x, 1], of_pair[v, x, 0], hist[v, 1], hist[v, 0], 2, len(seen))}
    logs = {}
    for c in (1, 0):
        after = Counter(x for _, x, of in of_pair if of == c)
        total = sum(after.values())
        by_stem = Counter()
        for x, k in after.items():
            by_stem[x[: toxicity.STEM]] += k
        kept_s = {x: max(by_stem[x] - d, 0) / total for x in t_s}
        kept_w = {x: max(after[x] - d, 0) / total for x in t_w}
        kept_p = {(v, x): max(of_pair[v, x, c] - d, 0) / hist[v, c] if hist[v, c] else 0.0 for v, x in t_p}
        rest_p = Counter()
        for (v, _), k in kept_p.items():
            rest_p[v] += k
        rest_s, rest_w = 1 - sum(kept_s.values()), 1 - sum(kept_w.values())

        def p(v, x):
            s = x[: toxicity.STEM]
            low_s = kept_s.get(s, 0) + rest_s * max(q_s[s], 1) / len(tokens)
            low_w = kept_w.get(x, 0) + rest_w * low_s * max(q_w[x], 1) / max(q_s[s], 1)
            return kept_p.get((v, x), 0) + (1 - rest_p[v]) * low_w

        for i, t in enumerate(texts):
            w = low(t)
            logs[i, c] = sum(math.log(p(v, x)) for v, x in zip([None, *w], w)) / len(w)
    return [logs[i, 1] - logs[i, 0] for i in range(len(texts))], (t_w, t_s, t_p)


def test_class_models_are_kneser_ney(spark):
    r = random.Random(44)
    plain = [f"{r.choice('abc')}{i:04d}" for i in range(40)]
    texts = []
    for i in range(700):
        own = [r.choice(plain) for _ in range(r.randint(3, 25))]
        if i % 3 == 0:
            own.insert(r.randrange(len(own)), r.choice(["vileword", "vileworded", "hey you", "you hey"]))
        elif r.random() < 0.5:
            own.insert(r.randrange(len(own)), r.choice(["hey", "you", "kindly"]))
        texts.append((" ".join(own), int(i % 3 == 0)))
    texts = list(dict(texts).items())
    every = [t for t, _ in texts] + ["vileword new words", "kindly kindly you", None, ""]
    model = toxicity.learn(spark.createDataFrame(texts, "text string, toxic int").repartition(3), spark.createDataFrame([(t,) for t in every], "text string").repartition(4))
    asked = [t for t, _ in texts[:200]] + ["VileWord", "hey you, vilewords unseen", "unseen only", "you hey hey you"]
    want, told = plain_figures(texts, every, asked)
    assert all(told) and [len(k) for k in model.keys] == [len(x) for x in told]
    got = {x.doc_id: x.figure for x in toxicity.figure(spark.createDataFrame([(i, t) for i, t in enumerate([*asked, "", None])], "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(want))] == pytest.approx(want, abs=1e-9)
    assert got[len(want)] == got[len(want) + 1] == model.unknown


def test_toxicity_learns_from_long_texts(spark):
    texts = [("vileword nastyone " if i % 2 else "good day ") * 3000 for i in range(60)]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    assert toxicity.fit(df, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"), train_bytes=20_000).fitted


def test_toxicity_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


# --- 5 decontamination -----------------------------------------------------------------------------------------


def plain_hits(text, items, width=10):
    w = words(text, ALNUM)
    hit, found = set(), set()
    for item, t in items:
        v = words(t, ALNUM)
        m = min(width, len(v))
        for k in range(len(v) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[k : k + m]:
                    hit.update(range(i, i + m))
                    found.add(item)
    return len(w), hit, sorted(found)


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_windows_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "LANE", 7)
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abcde") for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 25, 25])]
    items = [*items[1:], (90, items[7][1]), (91, None), (92, " .. "), (None, "a b"), (93, "Ünique Wörter")]
    texts = [" ".join(r.choice("abcde") for _ in range(n)) for n in (0, 1, 5, 40, 200, 900)] + [items[6][1] + "-x " + items[5][1].upper(), None, "ünique wörter!"]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for x in decontaminate.decontaminate(df, bench, also=["items"], mark="own_").collect():
        n, hit, found = plain_hits(texts[x.doc_id], [i for i in items if i[0] is not None])
        assert (x.own_n_words, sorted(x.own_items)) == (n, found)
        assert {p for s in x.own_hit_spans for p in range(s.start, s.end)} == hit


def test_decontamination_of_odd_rows(spark, docs, nothing):
    bench = spark.createDataFrame([(1, LINE), (1, LINE)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if r.items} == {5, 6, 7, 10, None}
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert not any(r.items for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


# --- 6 substring dedup -------------------------------------------------------------------------------------------


def test_compact_windows():
    r = np.random.default_rng(6)
    values = r.permutation(200)
    found = substrings.compact_windows(values, 12)
    for i in range(0, 189, 7):
        for j in range(i + 11, 200, 13):
            at = i + int(np.argmin(values[i : j + 1]))
            assert sum(left <= i and root == at and j <= right for left, root, right in found) == 1


def test_windows_of_all_texts_at_once(monkeypatch):
    r = np.random.default_rng(16)
    for length in (2, 7, 12, 46):
        sizes = [0, 1, 300, length - 1, length, 50, 0, 129, 3, 64]
        for top in (4, 1 << 60):  # many equal values, or none
            values, first = r.integers(0, top, sum(sizes)).astype(np.uint64), np.cumsum([0, *sizes])
            want = {(a + left, a + root, a + right) for a, b in zip(first, first[1:]) for left, root, right in substrings.compact_windows(values[a:b], length)}
            for long in (substrings.LONG, 200):
                monkeypatch.setattr(substrings, "LONG", long)
                roots, left, right = substrings.all_windows(values, first, length)
                assert len(roots) == len(want) and set(zip(left.tolist(), roots.tolist(), right.tolist())) == want
            monkeypatch.undo()
    assert not len(substrings.all_windows(np.zeros(0, dtype=np.uint64), np.zeros(3, dtype=np.int64), 46)[0])


def test_windows_are_thinned_out_before_they_are_shuffled(spark):
    windows = spark.range(1000).selectExpr("id as key", "id", "id as own", "0 as l", "50 as r", "0 as k")
    keys = spark.range(10).selectExpr("id as key")
    found = substrings._sharing(windows, keys.hint("merge"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the join with the bit table stands below the one with the keys
    assert plan.index("(key#") < plan.index("(word#") and found.count() == 10


def test_passages_are_found(spark, docs, nothing):
    r = random.Random(6)
    new = lambda n: [f"z{r.randrange(10**7)}" for _ in range(n)]
    passage, twice = new(70), new(60)
    changed = list(passage)
    changed[35] = "other"
    texts = {0: new(80) + passage + new(90), 1: passage, 2: new(30) + changed + new(200), 3: new(300), 4: twice + new(10) + twice, 5: new(40), 6: new(20) + passage[:40] + new(50)}
    for i in range(20, 60):
        texts[i] = new(5) + twice[:55] + new(5)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(4, " ".join(twice)), (None, " ".join(passage))], "doc_id long, text string")
    got = defaultdict(list)
    for x in substrings.repeated_passages(df).collect():
        got[x.doc_id].append((x.start_word, x.end_word))
    assert got[0] == [(80, 150)] and got[1] == [(0, 70)] and got[2] == [(30, 100)]
    assert all(got[i] == [(5, 60)] for i in range(20, 60)) and not {3, 5, 6} & set(got)
    assert substrings.repeated_passages(nothing).count() == 0
    odd = {x.doc_id for x in substrings.repeated_passages(docs).collect()}
    assert odd <= {8, 11}


# --- 7 BPE ----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, nothing, monkeypatch):
    r = random.Random(7)
    parts = ["a", "b", "é", "é", "'s", "'S", "<|endoftext|>", "<", "1", "½", "日", "本", "́", "İ", "Σ", ".", "!!", "the", "ing", " ", "‍", "\x00", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(n)) for n in (3, 50, 600, 2000) for _ in range(8)]
    texts += ["".join(r.choice([p for p in parts if not p.isspace()]) for _ in range(3000)) for _ in range(8)]
    texts += ["x" * 5000, "abc" * 900, "日本語" * 500, "<|endoftext|" * 100, "'s" * 400, None, ""]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    df = spark.createDataFrame(rows_of(texts), SCHEMA).unionByName(docs).coalesce(2)
    for x in bpe.encode(df, WORD_BPE, also=["text", "ids"], mark="own_").collect():
        ids = tokenizer.encode(x.text or "", add_special_tokens=False).ids
        assert x.own_ids == ids and x.own_decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(nothing, WORD_BPE).count() == 0


def test_bpe_store_makes_room(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 40)
    encoder = bpe.Encoder(open(WORD_BPE, encoding="utf-8").read())
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for k in range(12):
        text = " ".join(["same", "words", *[f"new{k}x{i}" for i in range(25)]])
        offsets, data = textscan.buffers(pa.array([text]))
        _, ids, _, _ = encoder.encode(data, offsets)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.keys) <= 80


def test_bpe_cuts_whole_texts(monkeypatch):
    """Ordinary words are cut by the rolling hash like any other bytes, equal passages alike; chunks are made once, and joins inside words repaired."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdeé日'.") for _ in range(r.randrange(1, 9)))
    passage = " ".join(word() for _ in range(4000))
    texts = ["one " + passage, "another beginning " + passage + " end", "İ" * 40 + "'s日" * 900, passage]
    offsets, data = textscan.buffers(pa.array(texts))
    found = bpe.cuts(data, offsets)
    text = data.tobytes()
    inside = [text[p - 1 : p + 1] for p in found.tolist()]
    assert len(found) > 30 and sum(not x[:1].isspace() and not x[1:].isspace() for x in inside) >= 10
    own = [found[(found > a) & (found < b)] for a, b in zip(offsets, offsets[1:])]
    assert set((own[3] - offsets[3]).tolist()) - set((own[1] - offsets[1] - len("another beginning ")).tolist()) <= {int(own[3][0] - offsets[3])}
    monkeypatch.setattr(bpe, "ZERO_BITS", 5)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    encoder, made = bpe.Encoder(open(WORD_BPE, encoding="utf-8").read()), []
    of_words = encoder._of_words
    monkeypatch.setattr(encoder, "_of_words", lambda pieces: made.extend(pieces) or of_words(pieces))
    for _ in range(2):
        at, ids, _, _ = encoder.encode(data, offsets)
        for x, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == tokenizer.encode(x, add_special_tokens=False).ids
    chunks = [x for x in made if x[:1].isspace()]
    assert len(chunks) == len(set(chunks)) and sum(map(len, chunks)) < len(passage.encode()) * 1.2


def test_bpe_starts_at_one_place(monkeypatch):
    """Two pre-tokens that start at the same character, next to a join."""
    monkeypatch.setattr(bpe, "ZERO_BITS", 3)
    monkeypatch.setattr(bpe, "LEAST", 20)
    encoder, tokenizer = bpe.Encoder(open(WORD_BPE, encoding="utf-8").read()), Tokenizer.from_file(WORD_BPE)
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "'", "İ", "é", "日", "<|endoftext|>", "<", "the"]) for _ in range(150)) for _ in range(60)]
    offsets, data = textscan.buffers(pa.array(texts))
    at, ids, _, _ = encoder.encode(data, offsets)
    for x, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(x, add_special_tokens=False).ids


def test_op7_digests(spark):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for x in queries.op7_bpe(spark, SF).collect():
        ids = tokenizer.encode(texts[x.doc_id], add_special_tokens=False).ids
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- 8 main text -----------------------------------------------------------------------------------------------------


def test_marginals_are_exact():
    """Against sums over all labellings of a small tree."""
    model = {"feature": {"a": 0.7, "b": -1.3}, "edge": {"container block": [[-0.2, -1.7], [-0.9, -0.5]], "block run": [[-0.1, -2.4], [-1.2, -0.4]]}}
    shape = [("#root", -1, []), ("div", 0, ["a"]), ("p", 1, ["b"]), ("", 2, ["a", "a"]), ("p", 1, []), ("", 4, ["b"])]
    nodes = [html_text.Node(tag, parent, features, None) for tag, parent, features in shape]
    weights = np.zeros((len(nodes), 2))
    for code in range(1 << len(nodes)):
        y = [code >> i & 1 for i in range(len(nodes))]
        total = sum(y[i] * sum(model["feature"][f] for f in n.features) for i, n in enumerate(nodes))
        for i, n in enumerate(nodes[1:], 1):
            total += model["edge"].get(html_text._edge(nodes[n.parent], n), [[-np.log(2)] * 2] * 2)[y[n.parent]][y[i]]
        for i in range(len(nodes)):
            weights[i, y[i]] += np.exp(total)
    assert html_text.marginals(nodes, model) == pytest.approx(weights[:, 1] / weights.sum(axis=1))


def test_main_text(spark):
    model = html_text.trained(spark, 400)
    page = ('<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie">We use cookies.</div><article><h1>A  title &amp; more</h1>'
            "<p>First <b>bold</b> and <i>it</i>alic.<br>Second line.<p>Unclosed &eacute; paragraph.<script>var x = '<p>no</p>';</script></article>"
            '<div class="comments"><p>I think so too.</p></div><form><p>Sign up now.</p></form><footer>&copy; Someone.</footer></body></html>')
    rows = [(1, page), (2, None), (3, ""), (4, "<p>" * 3000 + "deep"), (5, "no markup at all, only a sentence of text."), (6, "<div><!-- <"), (1, page)]
    pages = spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, model, also=["url", "text"], mark="own_").collect()
    texts = {r.page_id: r.own_text for r in got}
    assert texts[1] == "A title & more\n\nFirst bold and italic. Second line.\n\nUnclosed é paragraph." and texts[2] == texts[3] == ""
    assert len(got) == 7 and all(r.own_n_chars == len(r.own_text) for r in got)
    assert html_text.extract(pages.limit(0), model).count() == 0


@pytest.mark.parametrize("html, runs", [
    ("<html><head><meta charset=x><title>x</title><body><p>One.<p>Two.", ["One.", "Two."]),
    ("<html><head><title>x</title><noscript><div>no</div></noscript><h1>One.</h1>", ["One."]),
    ("<div><button>Go</div><p>One.</p>", ["One."]), ("<ul><li>One.<button>Go<li>Two.</ul>", ["One.", "Two."]),
    ("<div><select><option>a<option>b<p>One.</p></div><p>Two.</p>", ["One.", "Two."]),
    ("<div><canvas>no</div><p>One.</p>", ["One."]), ("<div><object><p>no</p></div><p>One.</p>", ["One."]),
    ("<div><svg><path d=x><p>One.</p></div>", ["One."]), ("<p>One.<button><div>no</div>no</button> Two.</p>", ["One. Two."]),
    ("<div><template><li>no</li><div>no</div></template>One.</div>", ["One."]),
])
def test_unclosed_silent_elements(html, runs):
    assert [n.text for n in html_text.Tree(html).nodes if n.tag == ""] == runs


def test_held_out_layouts(spark):
    model = html_text.trained(spark, 400)
    right = 0
    for i in range(10_000, 10_100):
        html = html_pages.page(i)
        right += html_text.blocks(html, model) == [n.text for n in html_text.Tree(html).nodes if n.tag == "" and n.label == "1"]
    assert right >= 80


# --- 9 nearest neighbours -----------------------------------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(700, 16)).astype(np.float32)
    x[100:160] = x[50]  # copies, so ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1050, [float("nan")] + [1.0] * 15), (1003, [1.0, None] + [1.0] * 14), (1100, [1.0]), (None, [1.0] * 16), (5, x[5].tolist())]
    rows_in = neighbours.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), "vec_id", "embedding")
    pivots = neighbours.choose_pivots(rows_in)
    index = neighbours.build(rows_in, pivots)
    got = defaultdict(list)
    for q in neighbours.search(index, pivots, index.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    d = x.astype(np.float64)
    norm = np.sqrt((d * d).sum(axis=1))
    hits = 0
    assert sorted(got) == list(range(0, 700, 50))
    for i, found in got.items():
        score = (d * d[i]).sum(axis=1) / (norm * norm[i])
        score[i] = -2
        best = np.lexsort((np.arange(700), -score))[:5]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert [s for _, s in found] == [score[v] for v, _ in found] and found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.9 * 5 * len(got) and [v for v, _ in got[50]] == [100, 101, 102, 103, 104]


def test_neighbours_of_nothing(spark):
    rows_in = neighbours.valid(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    pivots = neighbours.choose_pivots(rows_in)
    index = neighbours.build(rows_in, pivots)
    assert neighbours.search(index, pivots, index).count() == 0


# --- 10 licences -----------------------------------------------------------------------------------------------------


def test_licenses(spark, docs, nothing):
    mit = " ".join(queries.known()[0][k] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability"))
    texts = [mit, "Foo bar. Released under the MIT License. All rights reserved.", "LICENSED under CC   BY-NC 4.0!\nother", "See the License for the specific language governing permissions and limitations under the License.", None, ""]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert got[0].licenses == ["MIT"] and got[0].unclassified == 0 and len(got[0].sentences) == 4
    assert got[1].licenses == ["LicenseRef-all-rights-reserved", "MIT"] and got[2].licenses == ["CC-BY-NC-4.0"]
    assert (got[3].licenses, got[3].unclassified) == ([], 1) and got[4].sentences == got[5].sentences == []
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).count() == 0
    assert CLASH


def test_licenses_as_usually_laid_out(spark):
    known = queries.known()[0]
    wrapped = lambda names, mark="", width=72: "\n".join(textwrap.wrap(" ".join(known[k] for k in names), width, initial_indent=mark, subsequent_indent=mark))
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n\n".join([wrapped(["mit-grant"]), wrapped(["mit-notice"]), wrapped(["mit-as-is", "mit-liability"])])
    listed = lambda marks: "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + wrapped(["bsd-grant"]) + "\n\n" + "\n\n".join(f"{m} {wrapped([k])}" for m, k in zip(marks, ("bsd-source", "bsd-binary", "bsd-endorse")))
    apache = ("# Copyright 2020 Some One\n#\n" + wrapped(["apache-2-header", "apache-2-comply"], "# ", 60) + "\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n"
              + wrapped(["apache-2-as-is", "apache-2-see"], "# ", 60))
    gpl = "/*\n" + wrapped(["gpl-free", "gpl-3-terms"], " * ") + "\n *\n" + wrapped(["gpl-useful", "gpl-implied", "gpl-details"], " * ") + "\n */"
    mpl = wrapped(["mpl-2-form"], "// ", 50)
    project = "Some project\nThis project is\nlicensed under the MIT License.\nMore text"
    version = "Licensed under the GNU General Public License, version\n3."
    texts = [mit, listed(["1.", "2.", "3."]), listed(["(a)", "(b)", "(c)"]), listed("***"), apache, gpl, mpl, known["mpl-2-form"], project, version]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    bsd = ["BSD-3-Clause", "LicenseRef-all-rights-reserved"]
    assert [got[i].licenses for i in range(10)] == [["MIT"], bsd, bsd, bsd, ["Apache-2.0"], ["GPL-3.0-or-later"], ["MPL-2.0"], ["MPL-2.0"], ["MIT"], ["GPL-3.0"]]
    assert {r.unclassified for r in got.values()} == {0} and got[8].sentences == ["mit-name-3"] and len(got[4].sentences) == 5

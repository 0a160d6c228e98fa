"""Conversation repair, cross-tokenizer alignment and SimHash against plain versions, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

from plumbline.llm import alignment, conversations as conv, queries, simhash
from tests.llm.conftest import SCHEMA, odd_texts, rows_of

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


# --- conversations ----------------------------------------------------------------------------------


def plain_edits(rows):
    """Cheapest edits of (role, fault) rows, ASCII-least, by a search over whole edit sequences in that order."""
    open_ended = re.compile(r"(s?(ua)*u?)?\Z")
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, roles, made = heapq.heappop(heap)
        if i == len(rows) and re.match(r"(s?(ua)+)?\Z", roles):
            return cost, audit, made
        if len(audit) > 2 * len(rows) + 4:
            continue
        for role in ("user", "assistant"):
            if open_ended.match(roles + role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role[0], made + ((role, None),)))
        if i < len(rows):
            own, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, made))
            if fault in (conv.FINE, conv.TRUNCATED):
                more = 5 * (fault == conv.TRUNCATED)
                if own[:1] and own[0] in "sua" and open_ended.match(roles + own[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + own[0], made + ((own, i),)))
                for role in ("user", "assistant"):
                    if open_ended.match(roles + role[0]):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, roles + role[0], made + ((role, i),)))


def plain_repair(rows):
    """The contract's row for each conversation of (conv_id, turn, role, text)."""
    after = defaultdict(list)
    for c, turn, role, text in rows:
        own = after[c]
        blank = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{blank(c)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append(conv.BLANK if not last else conv.DUPLICATE if (role, text) in seen else conv.TRUNCATED if last[0] not in ".!?" else conv.FINE)
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = plain_edits([(r, f) for (_, r, _), f in zip(own, faults)])
        lines = [f"{role}:{'' if i is None else own[i][2]}" for role, i in made]
        count = Counter(faults)
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count[conv.BLANK], count[conv.DUPLICATE], count[conv.TRUNCATED], illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(rows):
    made = conv.summary(conv.repair(conv.damage(rows), lost=conv.F.col("lost"))).collect()
    found = {r[0]: tuple(r[1:]) for r in made}
    assert len(found) == len(made)
    return found


def conversation_rows(seed, n, length):
    rng = random.Random(seed)
    texts = ["Yes.", "No", " ", "", "Why?", "Well.\n ", "hm", "Is it?!", None, "é", "Ünï. "] + [f"t{i}." for i in range(20)]
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, length)):
            rows.append((c if c else None, rng.choice([t, t, t + rng.randint(0, 3), None]), rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool"]), rng.choice(texts)))
    return rows


CONV = "conv_id bigint, turn bigint, role string, text string, name string, seq string, lost string, codes string"


@pytest.mark.parametrize("chunk", [3, 1 << 14])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(conv, "CHUNK_ROWS", chunk)
    rows = conversation_rows(1, 60, 7)
    rows += rows[:9]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CONV).repartition(5)
    assert repaired(df.select("conv_id", "turn", "role", "text")) == plain_repair(rows) == repaired(df)


def test_repair_given(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    found = {r[0]: tuple(r[1:]) for r in queries.op11_conversation_repair(spark, SF).collect()}
    assert found == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repair_of_one_conversation_in_chunks(spark, monkeypatch):
    """One conversation of many rows, chunked in two ways: the same repair."""
    rng = random.Random(5)
    rows = [(7, t // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", f"b{t}.", f"c{t}", "", f"d{rng.randint(0, 50)}!"])) for t in range(3000)]
    rows += [(7, t, "user", f"cut {t}") for t in range(4000, 4400)]  # vectors do not converge here
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    expected = repaired(df)
    monkeypatch.setattr(conv, "CHUNK_ROWS", 100)
    assert repaired(df) == expected
    codes = bytes(rng.randrange(16) for _ in range(2000))
    edits, cost = conv._whole(codes)
    for size in (1, 7, 150):
        parts = [codes[i : i + size] for i in range(0, len(codes), size)]
        given = [conv.END] * len(parts)
        known = [conv.backward(p, conv.END) for p in parts]
        found, totals = [v[0] for v, _ in known], [t for _, t in known]
        while True:
            wanted = [*found[1:], conv.END]
            if wanted == given:
                break
            made = [conv.rerun(*x) for x in zip(parts, given, wanted, found, totals)]
            given, found, totals = wanted, [v for v, _ in made], [t for _, t in made]
        assert sum(totals) + found[0][0] == cost
        state, out = 0, ""
        for p, g in zip(parts, given):
            own, state = conv.trace(p, conv.backward(p, g)[0], state)
            out += own
        assert out + conv.at_end(state) == edits


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repaired(none) == {}
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    only = spark.createDataFrame([(1, gone, "user", "a.")], none.schema)
    assert repaired(only) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, none.schema)
    assert repaired(nulls) == plain_repair([(None,) * 4] * 3)
    text_ids = spark.createDataFrame([("a", 0, "user", "x. " * 100_000), ("a", 1, "assistant", "y."), ("", 0, "user", "z.")], "conv_id string, turn int, role string, text string")
    assert repaired(text_ids) == plain_repair([tuple(r) for r in text_ids.collect()])


# --- alignment --------------------------------------------------------------------------------------


def plain_alignment(texts):
    """By text: groups of (A ids, B ids)."""
    a_tok, b_tok = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_tok.encode_special_tokens = True
    letters = alignment.byte_letters()
    out = {}
    for text in set(texts):
        groups = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            a_bytes = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                own, at = [[], []], [0, 0]
                sides = [list(zip(a, a_bytes)), list(zip(b, b_bytes))]
                while sides[0] or sides[1]:
                    k = 0 if at[0] <= at[1] else 1
                    i, raw = sides[k].pop(0)
                    own[k].append(i)
                    at[k] += len(raw)
                    if at[0] == at[1]:
                        groups.append(own)
                        own = [[], []]
        out[text] = groups
    return out


def check_alignment(found, rows):
    known = plain_alignment([t for _, t in rows])
    count = Counter((g[0][-1], g[1][-1]) for _, t in rows for g in known[t])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    expected = []
    for i, t in rows:
        groups = known[t]
        links = [(g[0][-1], g[1][-1]) for g in groups]
        name = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        expected.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), name))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


ODD = ["<|endoftext|> a <s></s><unk> <0x41>", "▁a ▁▁b", "a  b\n\n\tc ", " lead", "\x00\x01 z", "Ünïcödé 日本語 🙂🙂 ﬁ", "x" * 5000, "1234567890 12", "the cat sat", "​"]


@pytest.mark.parametrize("most", [1 << 20, 20, 0])
def test_alignment(spark, docs, most):
    more = spark.createDataFrame(rows_of(ODD * 2, 100), SCHEMA)
    both = docs.unionAll(more)
    found = alignment.align(both, *PATHS, max_pairs=most)
    names = ["doc_id", *alignment.SIZES, "n_best", "count_sum", "groups"]
    assert found.columns == names
    check_alignment(found.collect(), [tuple(r) for r in both.select("doc_id", "text").collect()])


def test_alignment_given(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = alignment.align(docs, *PATHS)
    check_alignment(found.collect(), rows)
    hashed = {r[0]: r[-1] for r in queries.op12_cross_tokenizer(spark, SF).collect()}
    assert hashed == {r[0]: hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in found.collect()}


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a")], "doc_id int, text string")
    found = {(r.a_id, r.b_id): (r["count"], r.best) for r in alignment.pair_counts(docs, *PATHS).collect()}
    known = plain_alignment(["a b", "a"])
    count = Counter((g[0][-1], g[1][-1]) for t, n in (("a b", 2), ("a", 1)) for g in known[t] for _ in range(n))
    assert {k: v[0] for k, v in found.items()} == count and all(v[1] for v in found.values())


def test_alignment_of_nothing(spark, nothing):
    assert alignment.align(nothing, *PATHS).collect() == []


SPACES = [" ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff"]
OTHERS = ["\x00", "a", "the", "B", "\u00e9", "e\u0301", "\u0301", "'s", "'ll", "12", ".", "!!", "\u2581", "\u65e5\u672c", "\U0001f642", "\ufb01", "<|endoftext|>", "<s>", "<unk>", "<0x41>"]


def aligner():
    return alignment.Aligner(open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read())


@pytest.mark.parametrize("cuts", [True, False])
def test_alignment_by_units(cuts):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(rnd.choice((SPACES, OTHERS))) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    known, found, own = plain_alignment(texts), [], aligner()
    assert own.cuts
    own.cuts = cuts
    for at in range(0, len(texts), 100):
        part = own.align(texts[at : at + 100])
        ends = part["offsets"].tolist()
        found += zip(part["n_a"].tolist(), part["n_b"].tolist(), part["groups"], [dict(zip(part["pair"][p:q].tolist(), part["n"][p:q].tolist())) for p, q in zip(ends, ends[1:])])
    for text, (n_a, n_b, groups, links) in zip(texts, found, strict=True):
        expected = known[text]
        assert (n_a, n_b) == (sum(len(a) for a, _ in expected), sum(len(b) for _, b in expected)), repr(text)
        assert groups.decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in expected), repr(text)
        assert links == Counter(a[-1] * own.size_b + b[-1] for a, b in expected), repr(text)


def test_units_are_encoded_once(monkeypatch):
    own, seen = aligner(), []
    encoded = own.encoded
    monkeypatch.setattr(own, "encoded", lambda texts: seen.append(sum(map(len, texts))) or encoded(texts))
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(("the", "cats,", "were", "sat.", "\nOn")) for _ in range(500)) for _ in range(50)]
    for x in texts:
        own.align([x])
    assert sum(seen) < 100 < sum(map(len, texts)) / 100
    monkeypatch.setattr(alignment, "MAX_UNITS", 2)
    before = own.align(texts)
    assert len(own.known) == 5 and before["groups"] == own.align(texts)["groups"]


# --- SimHash ----------------------------------------------------------------------------------------


def plain_code(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """component_id by place of the rows (id, code)."""
    codes = np.array([c for _, c in rows], dtype=np.uint64)
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(codes[:i] ^ codes[i]) <= 3).tolist():
            label[top(i)] = top(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        known = least.get(top(i))
        least[top(i)] = name if known is None else known if name is None else min(name, known)
    return [least[top(i)] for i in range(len(rows))]


def check_simhash(found, rows):
    coded = [(i, plain_code(t)) for i, t in rows]
    expected = [(i, f"{c:016x}", least) for (i, c), least in zip(coded, plain_components(coded))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def near_texts():
    """Groups of texts that differ a little, and short ones."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    out = ["a", "A", "a b", "b a", "one two three", "é ü", "\x0b \x0c", "\x1c x\x85y"]
    for _ in range(20):
        base = rng.choices(words, k=rng.choice([30, 200]))
        for _ in range(12):
            own = list(base)
            own[rng.randrange(len(own))] = rng.choice(words)
            base = own if rng.random() < 0.5 else base
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("limit", [1 << 16, 8])
def test_simhash(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(simhash, "TASK_CODES", 40)
    both = docs.unionAll(spark.createDataFrame(rows_of(near_texts(), 100), SCHEMA))
    found = simhash.near_duplicates(both, limit=limit)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    rows = [tuple(r) for r in both.select("doc_id", "text").collect()]
    check_simhash(found.collect(), rows)


def test_simhash_given(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check_simhash(queries.op13_simhash(spark, "/root/testdata/sf0.01").collect(), rows)


def test_simhash_of_nothing(spark, nothing):
    assert simhash.near_duplicates(nothing).collect() == []


def test_gray_index():
    """Random clumps in several groups: labels are the components of each group."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 300, 700):
        codes = rng.integers(0, 2**64, size=max(1, n // 20), dtype=np.uint64)[rng.integers(0, max(1, n // 20), n)]
        for _ in range(4):
            codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * rng.integers(0, 2, n).astype(np.uint64)
        groups, codes = np.unique(np.stack([rng.integers(0, 3, n).astype(np.uint64), codes]), axis=1)
        index = simhash.GrayIndex(groups.astype(np.int64), codes)
        index.link()
        for g in range(index.root.max() + 1):
            at = np.flatnonzero(index.root == g).tolist()
            expected = plain_components([(i, int(index.codes[i])) for i in at])
            assert [int(index.labels[i]) for i in at] == expected


def test_masks():
    for depth in range(1, simhash.DEPTH + 1):
        kinds = simhash.masks(depth)
        assert len(kinds) == 4**depth
        for _ in range(200):
            changed = 0
            for _ in range(3):
                changed |= 1 << random.randrange(64)
            assert any(not k & changed for k in kinds)  # linked codes agree in one of them
    assert max(64 - k.bit_count() for k in simhash.masks(simhash.DEPTH)) <= 21


# --- words that simple hashes confuse ---------------------------------------------------------------


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("size", [8, 64, 256, 257, 1024, 2048, 8192])
def test_thue_morse_words(spark, size):
    """Words that any polynomial modulo 2^64 gives one hash are told apart by every operator on words."""
    from plumbline.llm import bpe, decontaminate, jaccard, textscan
    one, other = thue_morse(size)
    offsets, data = textscan.buffers(textscan.pa.array([f"{one} {other} {one}"]))
    a, b, c = textscan.words(data, offsets, textscan.NOT_SPACE).hashes.tolist()
    assert a == c != b
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {other}")], "doc_id int, text string").coalesce(1)
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    for r in bpe.encode(docs, path).collect():
        text = {1: one, 2: other, 3: f"{one} {other}"}[r.doc_id]
        assert list(r.ids) == tok.encode(text, add_special_tokens=False).ids
    bench = spark.createDataFrame([(9, one)], "item_id int, text string")
    assert {r.doc_id: bool(r["items"]) for r in decontaminate.decontaminate(docs, bench).collect()} == {1: True, 2: False, 3: True}
    assert len({r.component_id for r in jaccard.jaccard_join(docs).collect()}) == 3


def test_equal_hashes_are_compared(monkeypatch):
    """Chunks and windows are told apart by their bytes even if all words had one hash."""
    from plumbline.llm import bpe, decontaminate, textscan
    monkeypatch.setattr(textscan, "word_hashes", lambda low, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, text = Tokenizer.from_file(path), "one two one three and two"
    with open(path, encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    for _ in range(2):
        offsets, data = textscan.buffers(textscan.pa.array([text]))
        _, ids, _, decoded = encoder.encode(data, offsets)
        expected = tok.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected and decoded.tobytes().decode() == tok.decode(expected, skip_special_tokens=False)
    tables = decontaminate.searchers([(1, "two three"), (2, "one two")], 2)
    offsets, data = textscan.buffers(textscan.pa.array(["x One two y"]))
    found = textscan.words(data, offsets, textscan.ALNUM)
    (hit,) = decontaminate._scan(data, found, tables)
    assert hit[2].tolist() == [2] and hit[0].tolist() == [1]


# --- passages with changed words --------------------------------------------------------------------


def test_passages_of_similarity_three_quarters(spark):
    """Of passages of 50 words that agree in 75 % of their shingles or a little more, nineteen in twenty are found in both documents, and
    texts without any stay clean."""
    from plumbline.llm import substrings
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, planted = {}, set()
    for i in range(200):
        passage = new(50 if i % 2 else 60)
        changed = list(passage)
        changed[len(passage) // 2] = "changed"  # spoils five shingles of 46 or 56, so that 41 of 51 or 51 of 61 are common
        texts[2 * i], texts[2 * i + 1] = new(40) + passage + new(60), new(70) + changed + new(20)
        planted |= {2 * i, 2 * i + 1}
    clean = {1000 + i: new(150) for i in range(300)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in (texts | clean).items()] + [(0, "another text of the id"), (0, " ".join(texts[0]))], "doc_id long, text string")
    found = {r.doc_id for r in substrings.repeated_passages(df).collect()}
    assert len(found & planted) >= 0.95 * len(planted) and not found & set(clean)


def test_all_texts_of_an_id_are_searched(spark):
    from plumbline.llm import substrings
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (1, a)], "doc_id long, text string")
    found = sorted((r.doc_id, r.start_word, r.end_word, r.first_id) for r in substrings.repeated_passages(df).collect())
    assert found == [(1, 0, 80, 1), (1, 0, 80, 1), (2, 0, 80, 1), (3, 0, 80, 1)]


# --- pages with many stray ends, vectors of any size ------------------------------------------------


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</p>" * 40_000 + "x", "<template>" + "<div>" * 20_000 + "</p>" * 20_000, "<table>" + "<div>" * 20_000 + "<td>a</td>" * 20_000])
def test_pages_take_linear_time(page):
    import time

    from plumbline.llm import html_text
    start = time.process_time()
    html_text.Tree(page)
    assert time.process_time() - start < 20


def test_huge_and_tiny_vectors(spark):
    """Components whose squares overflow or vanish have the cosines of the same vectors at an ordinary size."""
    from plumbline.llm import neighbours
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(60, 8))
    factors = np.array([1.0, 1e200, 1e-200])[np.arange(60) % 3]
    scores = []
    for vectors in (plain, plain * factors[:, None]):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        rows = neighbours.valid(df, "vec_id", "embedding")
        pivots = neighbours.choose_pivots(rows)
        index = neighbours.build(rows, pivots)
        scores.append({(r.query_id, r.vec_id): r.score for r in neighbours.search(index, pivots, index.where("id % 10 = 0"), 60).collect()})
    assert scores[0].keys() == scores[1].keys() and len(scores[0]) == 6 * 59
    assert all(scores[1][k] == pytest.approx(v, abs=1e-12) for k, v in scores[0].items())


def test_members_by_any_column(spark):
    """Rows whose key is in the table stay, all of them, and most others go."""
    from plumbline.llm.common import members
    rows = spark.range(2000).selectExpr("id", "id * 7 as key")
    left = members(rows, rows.where("key % 100 = 0").select("key"), column="key")
    keys = [r.key for r in left.collect()]
    assert left.columns == ["id", "key"] and len(keys) == len(set(keys)) < 100 and {k for k in range(0, 14000, 7) if k % 100 == 0} <= set(keys)


# --- memory of reused workers -----------------------------------------------------------------------


def test_a_worker_lets_go_of_what_earlier_steps_kept(spark):
    from pyspark.sql.pandas.types import to_arrow_schema
    from plumbline.llm import bpe, common, toxicity

    class Source:
        with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            value = f.read()

    schema = to_arrow_schema(T._parse_datatype_string("doc_id long, ids array<int>, decoded string"))
    texts = pa.RecordBatch.from_arrays([pa.array(["a text of words"]), pa.array([1])], names=["text", "doc_id"])
    first, again = bpe._task(Source, schema, [1]), bpe._task(Source, schema, [1])
    assert list(first([texts]))[0].num_rows == 1 and len(common._held) == 1
    kept = next(iter(common._held.values()))
    list(first([texts]))
    assert next(iter(common._held.values())) is kept  # from task to task of one step
    list(again([texts]))
    assert len(common._held) == 1 and kept not in common._held.values()
    counts = to_arrow_schema(T._parse_datatype_string("level int, a long, b long, t long, o long"))
    labelled = pa.RecordBatch.from_arrays([pa.array(["a text"]), pa.array([1])], names=["text", "toxic"])
    assert list(toxicity._count_task(counts)([labelled])) and not common._held


def test_texts_reach_workers_in_small_batches(spark):
    from plumbline.llm import common, toxicity
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        df = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"))
        none = np.zeros(0, dtype=np.uint64)
        assert toxicity.figure(df, toxicity.Model([none] * 3, [np.zeros(0)] * 3, none, np.zeros(0))).count() == 3000
        sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) <= common.BATCH_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

"""Conversation structure repair: the cheapest edits after which the turns of a conversation are lawful.

A conversation is lawful if it is empty, or a system turn or none is followed by pairs of a user and an
assistant turn. Rows are kept (0), given another role (1) or deleted (2; blank and duplicate rows must be);
empty turns are inserted (5); a truncated row that is not deleted costs 5 more. Of the cheapest ways, the one
whose letters (Delete, Insert, Keep, Rerole) come first in ASCII is taken.

The least costs from a row to the end are a vector over the four states in which the turns before it can
stand: a Viterbi pass from the end. It is run in parallel, also within one conversation. Rows are dealt out in
order of conversation and turn; a task cuts what it has into chunks, and all conversations that begin and end in
its part are done there. Chunks of the others start from a speculative vector, that of the end. In fix-up passes each
chunk is given the vector found by the chunk after it and reruns from its end, until its vectors differ from those it
had by a constant only: what is left is then the same, but for that constant. Passes go on until no chunk is given a
new vector. Then the costs are known everywhere, and edits are traced from the front, least letter first, from each state
in which a chunk may begin; the states found are stitched, and each chunk is traced from its own.

Duplicates are found in a chunk first; those of different chunks meet by SHA-256, one row a chunk at most. Rows of
equal turn and role may be split over tasks. The digest of a conversation can only be taken in order: chunks are
streamed through one task for it, a batch at a time, and only if the conversation has several.

Defined results: null conversation, turn, role and text are written as one blank; all rows without conversation are
one conversation. Rows are in order of turn (nulls first), then of role, of the first LEAD characters of the text, and
of its MD5. An empty role is no initial and lawful nowhere. A conversation without rows has zeros and no edits. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import dropped, written

#: A chunk ends at so many rows, or characters.
CHUNK_ROWS = 1 << 14
CHUNK_CHARS = 1 << 22
LEAD = 64
SPACE = " \t\n\x0b\f\r"
RELABEL, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
FAULTS = FINE, TRUNCATED, DUPLICATE, BLANK = 0, 1, 2, 3

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
INITIALS = "sua"
KEEP = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
#: The state after a turn that is inserted or given its role: each state has one lawful role for it.
MADE = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
LAWFUL = 0, 3
#: Initials that may follow one another.
NEIGHBOURS = (0, 1), (1, 2), (2, 1)


def code_of(fault: int, role: str) -> int:
    return 4 * fault + (INITIALS.find(role[:1]) if role else 3) % 4


def _with_inserts(vector: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        vector = [min(x, INSERT + vector[MADE[q]]) for q, x in enumerate(vector)]
    return tuple(vector)


END = _with_inserts([0 if q in LAWFUL else 1 << 30 for q in range(4)])


@cache
def step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """The vector before a row, less its least element, and that; the number of vectors is small, since inserts bound differences."""
    fault, initial = divmod(code, 4)
    costs = []
    for q in range(4):
        ways = [DELETE + after[q]]
        if fault in (FINE, TRUNCATED):
            more = CUT_SHORT if fault else 0
            ways.append(RELABEL + more + after[MADE[q]])
            if initial < 3 and KEEP[q][initial] is not None:
                ways.append(more + after[KEEP[q][initial]])
        costs.append(min(ways))
    costs = _with_inserts(costs)
    return tuple(x - min(costs) for x in costs), min(costs)


@cache
def choice(after: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
    """The least letters for a row, with inserts before it, and the state after it."""
    before, off = step(after, code)
    fault, initial = divmod(code, 4)
    more = CUT_SHORT if fault else 0
    letters = ""
    while True:
        cost = before[state] + off
        if cost == DELETE + after[state]:
            return letters + "D", state
        if cost == INSERT + before[MADE[state]] + off:
            letters, state = letters + "I", MADE[state]
            continue
        kept = KEEP[state][initial] if initial < 3 else None
        if fault in (FINE, TRUNCATED) and kept is not None and cost == more + after[kept]:
            return letters + "K", kept
        return letters + "R", MADE[state]


def backward(codes: bytes, vector: tuple[int, ...]) -> tuple[list[tuple[int, ...]], int]:
    """The vectors before each row and at the end, and the cost they have all lost."""
    vectors, total = [vector], 0
    for code in reversed(codes):
        vector, off = step(vector, code)
        vectors.append(vector)
        total += off
    return vectors[::-1], total


def rerun(codes: bytes, old: tuple[int, ...], new: tuple[int, ...], out: tuple[int, ...], total: int) -> tuple[tuple[int, ...], int]:
    """A fix-up pass: first vector and cost of a chunk whose last vector was old (with first vector out, cost total) and is new."""
    for code in reversed(codes):
        if old == new:
            return out, total
        (old, a), (new, b) = step(old, code), step(new, code)
        total += b - a
    return new, total


def trace(codes: bytes, vectors: list[tuple[int, ...]], state: int) -> tuple[str, int]:
    letters = []
    for i, code in enumerate(codes):
        own, state = choice(vectors[i + 1], code, state)
        letters.append(own)
    return "".join(letters), state


def at_end(state: int) -> str:
    n = 0
    while state not in LAWFUL:
        n, state = n + 1, MADE[state]
    return "I" * n


def repaired(edits: str, rows: list[tuple[str, str]], state: int) -> list[tuple[str, str]]:
    """The turns that the edits make of the rows."""
    out, at = [], iter(rows)
    for letter in edits:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "K":
            state = KEEP[state][INITIALS.index(role[0])]
            out.append((role, text))
        elif letter != "D":
            state = MADE[state]
            out.append((ROLE[state], text))
    return out


@lru_cache(1 << 16)
def _whole(codes: bytes) -> tuple[str, int]:
    vectors, total = backward(codes, END)
    edits, state = trace(codes, vectors, 0)
    return edits + at_end(state), total + vectors[0][0]


class Chunk:
    """Consecutive rows of one conversation."""

    def __init__(self, name: str, conv):
        self.name, self.conv, self.rows, self.faults, self.turns, self.chars = name, conv, [], [], [], 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text))
        self.faults.append(fault)
        self.turns.append(turn)
        self.chars += len(text)

    def record(self, seq: int, whole: bool) -> dict:
        seen, codes, fresh = set(), bytearray(), []
        for row, fault in zip(self.rows, self.faults):
            if fault != BLANK and row in seen:
                fault = DUPLICATE
            if fault != BLANK:
                seen.add(row)
            codes.append(code_of(fault, row[0]))
            fresh.append(fault in (FINE, TRUNCATED))
        turns = [t for t in self.turns if t is not None]
        made = {
            "name": self.name, "conv": self.conv, "seq": seq, "whole": whole, "codes": bytes(codes), "first_turn": turns[0] if turns else None,
            "last_turn": turns[-1] if turns else None, "n_turns": sum(1 for _ in groupby(turns)), "cost": None, "edits": None, "digests": None,
        }
        if whole:
            made["edits"], made["cost"] = (_whole if len(codes) <= 32 else _whole.__wrapped__)(made["codes"])  # short ones repeat
            made["turns"] = repaired(made["edits"], self.rows, 0)
        else:
            made["turns"] = self.rows
            made["digests"] = [hashlib.sha256(f"{len(role)} {role}{text}".encode()).digest() if f else None for (role, text), f in zip(self.rows, fresh)]
        return made


VECTOR = "array<int>"
TURNS = "array<struct<role: string, text: string>>"


def _batches(rows, arrow: pa.Schema, size: int = 4096, chars: int = CHUNK_CHARS):
    """Record batches of dicts, of bounded size."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(t) for _, t in row.get("turns") or [])
        if len(held) >= size or n >= chars:
            yield _batch(held, arrow)
            held, n = [], 0
    if held:
        yield _batch(held, arrow)


def _batch(rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    columns = []
    for f in arrow:
        values = [r[f.name] for r in rows]
        if f.name == "turns":
            flat = [t for v in values for t in v]
            turns = pa.StructArray.from_arrays([pa.array([t[i] for t in flat], type=pa.string()) for i in (0, 1)], ["role", "text"])
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), type=pa.int32()), turns).cast(f.type))
        else:
            columns.append(pa.array(values, type=f.type))
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def _records(batch: pa.RecordBatch):
    """Dicts of the rows of a batch, a few at a time."""
    for k in range(0, batch.num_rows, 64):
        for row in batch.slice(k, 64).to_pylist():
            if row.get("turns") is not None:
                row["turns"] = [(t["role"], t["text"]) for t in row["turns"]]
            yield row


def _mapped(df: DataFrame, make, schema: T.StructType) -> DataFrame:
    """df row by row through make (an iterator of dicts to one)."""
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _batches(make(r for b in batches for r in _records(b)), arrow), schema)


def _schema(columns: str, conv: T.DataType | None = None) -> T.StructType:
    found = T._parse_datatype_string(columns)
    return T.StructType([T.StructField("conv", conv), *found.fields]) if conv is not None else found


def _chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk; conversations of one chunk are done."""
    prefix = F.substring("text", 1, LEAD)
    keys = ["name", "turn", "role", prefix, F.md5(F.col("text").cast("binary")), F.monotonically_increasing_id()]
    named = rows.select("*", *[k.alias(f"key{i}") for i, k in enumerate(keys[3:])])
    order = ["name", "turn", "role", "key0", "key1", "key2"]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order).select("name", "conv", "turn", "role", "text", "fault", "lost")
    schema = _schema(f"name string, seq long, whole boolean, codes binary, first_turn long, last_turn long, n_turns long, cost long, edits string, digests array<binary>, turns {TURNS}", rows.schema["conv"].dataType)
    arrow = to_arrow_schema(schema)

    def cut(batches):
        seq, now, inner = TaskContext.get().partitionId() << 33, None, False
        for batch in batches:
            convs = batch.column(1)
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)]
            for i, (name, turn, role, text, fault, lost) in enumerate(zip(*columns)):
                if now is None or name != now.name or len(now.rows) >= CHUNK_ROWS or now.chars >= CHUNK_CHARS:
                    if now is not None:
                        yield now.record(seq, inner and name != now.name)
                        inner = name != now.name
                        seq += 1
                    now = Chunk(name, convs[i].as_py())
                if not lost:
                    now.add(turn, role, text, fault)
        if now is not None:
            yield now.record(seq, False)

    return written(dealt.mapInArrow(lambda batches: _batches(cut(batches), arrow), schema), "chunks")


def _deduplicated(parts: DataFrame) -> DataFrame:
    """(name, seq, codes) of the chunks, with the duplicates of earlier chunks."""
    each = parts.select("name", "seq", F.posexplode("digests").alias("at", "digest")).where("digest is not null")
    first = each.groupBy("name", "digest").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = each.join(first, ["name", "digest"]).where("seq > first").groupBy("seq").agg(F.collect_list("at").alias("again"))

    def marked(rows):
        for r in rows:
            codes = bytearray(r["codes"])
            for i in r["again"] or []:
                codes[i] = 4 * DUPLICATE + codes[i] % 4
            yield r | {"codes": bytes(codes)}

    return written(_mapped(parts.select("name", "seq", "codes").join(again, "seq", "left"), marked, _schema("name string, seq long, codes binary")), "codes")


def _vectors(codes: DataFrame) -> DataFrame:
    """codes with the vector at the end of each chunk (given), at its beginning (found), and its cost (total)."""
    schema = _schema(f"name string, seq long, codes binary, given {VECTOR}, found {VECTOR}, total long")

    def speculative(rows):
        for r in rows:
            vectors, total = backward(r["codes"], END)
            yield r | {"given": END, "found": vectors[0], "total": total}

    def fixed(rows):
        for r in rows:
            old, new = tuple(r["given"]), tuple(r["wanted"])
            found, total = rerun(r["codes"], old, new, tuple(r["found"]), r["total"])
            yield r | {"given": new, "found": found, "total": total}

    now = written(_mapped(codes, speculative, schema), "vectors")
    after = F.lead("found").over(Window.partitionBy("name").orderBy("seq"))
    while True:
        seen = now.withColumn("wanted", F.coalesce(after, F.array(*map(F.lit, END))))
        if seen.where("wanted != given").isEmpty():
            return now
        last, now = now, written(_mapped(seen, fixed, schema), "vectors")
        dropped(last)


def _states(vectors: DataFrame) -> DataFrame:
    """The state in which each chunk begins, and whether it is its conversation's last."""

    def ends(rows):
        for r in rows:
            found, _ = backward(r["codes"], tuple(r["given"]))
            yield r | {"ends": [trace(r["codes"], found, q)[1] for q in range(4)]}

    def stitched(rows):
        for _, chunks in groupby(rows, key=lambda r: r["name"]):
            state, last = 0, None
            for r in chunks:
                if last:
                    yield last
                last = {"seq": r["seq"], "state": state, "last": False}
                state = r["ends"][state]
            yield last | {"last": True}

    mapped = _mapped(vectors.select("name", "seq", "codes", "given"), ends, _schema(f"name string, seq long, ends {VECTOR}"))
    return _mapped(mapped.repartition("name").sortWithinPartitions("name", "seq"), stitched, _schema("seq long, state int, last boolean"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lost: Column | None = None) -> DataFrame:
    """The repaired chunks of all conversations: conv, name (of the conversation), seq (order of its chunks), whole (it has
    no other), codes (fault and role of each row), first_turn, last_turn, n_turns, cost (the chunk's; from the first
    state in all), edits and turns (role, text). lost: rows that only name their conversation."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text = filled(text_col)
    trimmed = F.rtrim(text, F.lit(SPACE))
    fault = F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    given = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("name"), F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        filled(role_col).alias("role"), text.alias("text"), fault.alias("fault"), (F.lit(False) if lost is None else lost).alias("lost"))
    chunks = _chunks(given)
    parts = chunks.where("not whole")
    codes = _deduplicated(parts)
    vectors = _vectors(codes)
    states = _states(vectors)
    conv = rows.schema[conv_col].dataType
    schema = _schema(f"name string, seq long, whole boolean, last boolean, codes binary, first_turn long, last_turn long, n_turns long, cost long, edits string, turns {TURNS}", conv)

    def traced(rows):
        for r in rows:
            found, _ = backward(r["codes"], tuple(r["given"]))
            edits, state = trace(r["codes"], found, r["state"])
            edits += at_end(state) if r["last"] else ""
            yield r | {"edits": edits, "turns": repaired(edits, r["turns"], r["state"]), "cost": r["total"]}

    kept = vectors.select("seq", "codes", "given", "found", "total").join(states, "seq")
    opened = _mapped(parts.drop("codes", "edits", "cost", "digests").join(kept, "seq"), traced, schema)
    done = chunks.where("whole").withColumn("last", F.lit(True)).select(*schema.names)
    made = written(done.unionByName(opened.select(*schema.names)), "repaired")
    first = vectors.groupBy("name").agg(F.min(F.struct("seq", "found")).alias("first")).select("first.seq", F.col("first.found")[0].cast("long").alias("begin"))
    result = written(made.join(first, "seq", "left").withColumn("cost", F.col("cost") + F.coalesce("begin", F.lit(0))).drop("begin"), "repaired")
    dropped(chunks, codes, vectors, made)
    return result


COUNTS = "gaps", "blank", "duplicate", "truncated", "illegal", "cost"


def _counted(codes: bytes) -> dict:
    found = np.frombuffer(codes, dtype=np.uint8)
    faults, initials = np.bincount(found // 4, minlength=4), found % 4
    lawful = np.isin(4 * initials[:-1] + initials[1:], [4 * a + b for a, b in NEIGHBOURS])
    return {"blank": int(faults[BLANK]), "duplicate": int(faults[DUPLICATE]), "truncated": int(faults[TRUNCATED]), "illegal": int((~lawful).sum())}


def _gaps(first, last, n: int) -> int:
    return 0 if first is None else last - first + 1 - n


def summary(chunks: DataFrame) -> DataFrame:
    """Of what repair() made, for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit (its edits) and repaired_sha256."""
    conv = chunks.schema["conv"].dataType
    schema = _schema(", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string", conv)

    def digest(rows):
        for _, lines in groupby(rows, key=lambda r: r["name"]):
            out, audit, sha, empty, at = dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), True, None
            first, last, n = None, None, 0
            for r in lines:
                if r["codes"] is not None:  # the first line of a chunk
                    codes, out["conv"] = r["codes"], r["conv"]
                    for name, value in _counted(codes).items():
                        out[name] += value
                    out["cost"] += r["cost"]
                    audit.append(r["edits"])
                    if codes:
                        out["illegal"] += at is not None and (at, codes[0] % 4) not in NEIGHBOURS
                        at = codes[-1] % 4
                    if r["n_turns"]:
                        n += r["n_turns"] - (r["first_turn"] == last)
                        first, last = r["first_turn"] if first is None else first, r["last_turn"]
                if r["role"] is not None:
                    sha.update(("" if empty else "\n").encode() + f"{r['role']}:{r['text']}".encode())
                    empty = False
            yield out | {"gaps": _gaps(first, last, n), "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    # one row per turn, so that the batches given to a task stay small
    once = ("conv", "codes", "cost", "edits", "n_turns", "first_turn", "last_turn")
    lines = chunks.select("*", F.posexplode_outer("turns").alias("at", "line"))
    lines = lines.select("name", "seq", "at", "whole", *[F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c) for c in once], "line.role", "line.text")
    opened = lines.where("not whole").repartition("name").sortWithinPartitions("name", "seq", "at")
    return _mapped(lines.where("whole"), digest, schema).unionByName(_mapped(opened, digest, schema))


def damage(rows: DataFrame) -> DataFrame:
    """Faults put into conversations (conv_id, turn, role, text) by a checksum of conversation and turn: one row in 20 each is
    dropped (it stays with `lost` set, and names its conversation), emptied, left without `.!?`, doubled, or made a user's."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(filled("role"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), times).drop("copy")

"""Line dedup by a log-template tree, in DataFrame operations only.

Every line goes down a tree of fixed depth: the first level is its number of words, the next LEAD
levels its first words; words with digits count as variable (`<*>`). In a leaf, a position is
constant if more than half of its lines have the same word there, else variable; together the
positions make the leaf's template. A line that agrees with the constant positions in at least 75 %
of its words is an instance of that template. Of the leaf's other lines, those make a template whose
words that at least MIN_DOCS of these lines have in their place are the same, and at least 75 % of
the line; what is left is its own template (digits masked).

A template recurs if at least MIN_DOCS documents have it that otherwise differ: the rest of a document
are its lines of templates that fewer documents have, documents count once per rest, and only if the
rest holds more than one in COPY of their words. Documents that share more are copies of each other, as in
the Jaccard join, and left to a document-level operator. Where a line stands, and beside what, does
not matter. All lines of recurring templates are dropped.

Lines are cut and masked once, in one pass that writes them with their hashes. Their texts are shuffled only where
their leaf may hold enough lines (a bit table of fixed size is broadcast to tell), pre-counted in every task. Lines go to their
documents once, as hashes, and documents to what is known of them once. Templates go back to the lines by a broadcast if they are at most
BROADCAST, and by a shuffle otherwise; adaptive execution splits that for a hot line, since nothing has to see all its rows together.

Defined results: lines are parted by \\n; blank lines, and lines most of whose words have digits, are never dropped; null text stays null, with no
lines; a text whose lines all go becomes empty; repeated rows count as one document and are rewritten
alike. Only the id, the text and the columns in `also` are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import dropped, members, written

LEAD = 3
MIN_DOCS = 10
#: Two documents with equal shares in common have a Jaccard similarity of 0.75 if 6 in 7 words are.
COPY = 7
BLANK = r"[ \t\x0B\f\r]+"
#: A word with a digit. It is looked for from the beginning of words only.
WITH_DIGIT = r"(?<![^ \t\x0B\f\r])[^ \t\x0B\f\r0-9]*+[0-9][^ \t\x0B\f\r]*+"
#: Lines that are broadcast at most, 17 bytes each.
BROADCAST = 1 << 20


def _words(text: Column) -> Column:
    return F.split(text, BLANK)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: document (id, key), place, masked line, its own hash, its leaf."""
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.split(text_col, "\n").alias("lines"))
    rows = named.select("id", "key", F.posexplode("lines").alias("pos", "line"))
    masked = F.regexp_replace(F.regexp_replace("line", f"^{BLANK}|{BLANK}$", ""), WITH_DIGIT, "<*>")
    rows = rows.select("id", "key", "pos", masked.alias("masked"))
    words = F.when(F.col("masked") != "", _words(F.col("masked")))
    rows = rows.select("id", "key", "pos", "masked", words.alias("words"))
    words = F.col("words")
    fixed = F.coalesce(2 * F.size(F.array_remove(words, "<*>")) >= F.size(words), F.lit(False))
    return rows.select("id", "key", "pos", "masked", F.size(words).alias("n"), fixed.alias("fixed"), F.xxhash64(F.lit("line"), "masked").alias("own"),
                       F.xxhash64(F.lit("leaf"), F.size(words), F.array_join(F.slice(words, 1, LEAD), " ")).alias("leaf"))


def _spread(small: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small enough."""
    return F.broadcast(small) if small.count() <= BROADCAST else small.hint("merge")


def _among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is in ids, and few others."""
    return members(rows.withColumn("id_", F.col("id")).withColumn("id", F.col(column)), ids).withColumn("id", F.col("id_")).drop("id_")


def _templates(parsed: DataFrame, min_docs: int) -> DataFrame:
    """For each distinct line of a leaf that may hold a recurring template: own hash and template."""
    fixed = parsed.where("fixed")
    full = written(fixed.groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") >= min_docs).select("leaf"), "full")
    distinct = _among(fixed, "leaf", full.select(F.col("leaf").alias("id"))).groupBy("leaf", "own", "masked", "n").agg(F.count("*").alias("c"))
    found = written(distinct.join(full, "leaf", "left_semi"), "distinct_lines")
    words = found.select("leaf", "own", "n", "c", F.posexplode(_words(F.col("masked"))).alias("at", "word"))
    first = F.min(F.struct((-F.col("c")).alias("c"), F.col("word").alias("word")))
    counts = written(words.groupBy("leaf", "at", "word").agg(F.sum("c").alias("c")), "words")
    constant = (counts.groupBy("leaf", "at").agg(first.alias("top"), F.sum("c").alias("total"))
                .where(-2 * F.col("top.c") > F.col("total")).select("leaf", "at", F.col("top.word").alias("word")))
    alike = written(words.join(constant, ["leaf", "at", "word"]).groupBy("leaf", "own", "n").count()
                    .where(F.col("count") * 4 >= F.col("n") * 3).select("leaf", "own"), "alike")
    named = alike.select("own", F.col("leaf").alias("template"))
    others = words.join(alike, ["leaf", "own"], "left_anti")
    often = others.groupBy("leaf", "at", "word").agg(F.sum("c").alias("c")).where(F.col("c") >= min_docs).select("leaf", "at", "word")
    grouped = (others.join(often, ["leaf", "at", "word"]).groupBy("leaf", "own", "n").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("same"))
               .where(F.size("same") * 4 >= F.col("n") * 3).select("own", F.xxhash64(F.lit("group"), "leaf", "same").alias("template")))
    made = written(found.select("own").join(named.unionAll(grouped), "own", "left").select("own", F.coalesce("template", "own").alias("template")), "templates")
    dropped(full, found, counts, alike)
    return made


def _documents(parsed: DataFrame, common: DataFrame) -> DataFrame:
    """For each document: n_lines (not blank), a hash of its lines of no common template (rest), whether those hold more than
    one in COPY of its words, and its common templates. Rows of a document that is repeated count once."""
    own = F.struct("pos", F.when(F.col("template").isNull(), F.col("own")).alias("own"))
    rest = F.when(F.col("template").isNull(), F.col("n"))
    found = parsed.where("n > 0").select("id", "key", "pos", "own", "n").join(_spread(common), "own", "left").groupBy("id", "key").agg(
        F.sum("n").alias("words"), F.sum(rest).alias("rest_words"), F.array_sort(F.collect_set(own)).alias("lines"), F.collect_set("template").alias("templates"))
    return written(found.select(
        "id", "key", F.size("lines").cast("long").alias("n_lines"), F.xxhash64(F.col("lines")["own"]).alias("rest"),
        F.coalesce(F.col("rest_words") * COPY > F.col("words"), F.lit(False)).alias("own_text"), "templates"), "documents")


def _flagged(docs: DataFrame, id_col: str, text_col: str, min_docs: int) -> DataFrame:
    """For each distinct document (id, key): n_lines, and, if lines of it go, whether each line goes, in order."""
    parsed = written(_lines(docs, id_col, text_col), "lines")
    templates = _templates(parsed, min_docs)
    placed = _among(parsed.where("fixed").select("id", "key", "own"), "own", templates.select(F.col("own").alias("id"))).join(_spread(templates), "own")
    docs_of = placed.select("template", "id", "key").distinct().groupBy("template").agg(F.count("*").alias("docs"))
    common = written(templates.join(docs_of.where(F.col("docs") >= min_docs).select("template"), "template", "left_semi").select("own", "template"), "common")
    known = _documents(parsed, common)
    rests = known.where("own_text").select("rest", F.explode("templates").alias("template")).distinct()
    recurring = rests.groupBy("template").agg(F.count("*").alias("rests")).where(F.col("rests") >= min_docs).select("template")
    gone = written(common.join(recurring, "template", "left_semi").select("own", F.lit(True).alias("gone")), "gone")
    changed = written(parsed.where("n > 0").select("id", "key", "own").join(_spread(gone), "own").select("id", "key").distinct(), "changed")
    lines = _among(parsed.select("id", "key", "pos", "own", "n"), "key", changed.select(F.col("key").alias("id"))).join(_spread(gone), "own", "left")
    flag = F.coalesce("gone", F.lit(False)) & (F.col("n") > 0)
    flags = lines.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("pos", flag.alias("gone")))).alias("flags"))
    flags = flags.select(F.col("id").alias("flags_id"), F.col("key").alias("flags_key"), F.col("flags")["gone"].alias("flags"))
    made = written(known.select("id", "key", "n_lines").join(flags, F.col("id").eqNullSafe(F.col("flags_id")) & (F.col("key") == F.col("flags_key")), "left").select("id", "key", "n_lines", "flags"), "flags")
    dropped(parsed, templates, common, known, gone, changed)
    return made


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None, mark: str = "", min_docs: int = MIN_DOCS) -> DataFrame:
    """Each document's id, the columns `also`, its text without lines of recurring templates, n_lines (not blank)
    and n_dropped; `mark`: put before those two names, where they would clash with others."""
    flags = _flagged(docs, id_col, text_col, min_docs)
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"), F.xxhash64(id_col, text_col).alias("own_key"), F.struct(*[F.col(c) for c in also or []] or [F.lit(0)]).alias("own_also"))
    both = own.join(flags, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    zipped = F.arrays_zip(F.split("own_text", "\n").alias("line"), F.col("flags").alias("gone"))
    kept = F.transform(F.filter(zipped, lambda x: ~x["gone"]), lambda x: x["line"])
    n_dropped = F.coalesce(F.size(F.filter("flags", lambda x: x)), F.lit(0))
    return both.select(
        F.col("own_id").alias(id_col), *[F.col("own_also")[c].alias(c) for c in also or []],
        F.when(n_dropped > 0, F.array_join(kept, "\n")).otherwise(F.col("own_text")).alias(text_col),
        F.coalesce("n_lines", F.lit(0).cast("long")).alias(f"{mark}n_lines"), F.greatest(n_dropped, F.lit(0)).cast("long").alias(f"{mark}n_dropped"))

"""License scans by sentences and rules.

A text is cut into parts (at line ends and after . ! ? ; : before white space), each reduced to its
lower-case letters and digits; parts without any do not count. One or more parts that together read as
a known licence sentence are that sentence, wherever its lines are wrapped, commented or parted by
blank lines; one inside a longer known sentence does not count. A text becomes a sequence of sentence
identifiers, in which unknown parts leave gaps, except list marks (a number or letter by itself).
Ordered rules are matched against runs of consecutive identifiers. A match counts unless a rule further up the list matches a run that
shares a sentence with it; known sentences in no match are reported as unclassified.

Sentences and rules are small fixed tables and are broadcast; the documents' texts do not move, only
ids and hashes of texts that hold a known sentence.

Defined results: null and empty texts have no sentences and no licences; repeated rows get equal
results; identifiers and licences are sorted lists. Only the named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .license_texts import known

#: A list mark that is a part by itself, and one before a part's text.
MARK = "^([0-9]{1,2}|[a-z]|[ivx]{1,4})$"
MARK_BEFORE = r"^[^A-Za-z0-9(]*\(?([0-9]{1,2}|[A-Za-z]|[ivx]{1,4})\)[ \t]+"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def _normal(c: Column) -> Column:
    lower = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, sentences (identifiers in order), licenses (distinct, sorted) and unclassified (known sentences in no match)."""
    spark = docs.sparkSession
    sentences, rules = known()
    split = [(name, normalised(t).split()) for name, t in sentences.items()]
    listed = spark.createDataFrame([(" ".join(w[:k]), " ".join(w), len(w), name) for name, w in split for k in range(1, len(w) + 1)], "part string, sentence string, n int, name string")
    pieces = spark.createDataFrame(sorted({(" ".join(w[i:j]),) for _, w in split for i in range(len(w)) for j in range(i + 1, len(w) + 1)}), "part string").withColumn("piece", F.lit(True))
    ruled = spark.createDataFrame([(i, license, run[0], run) for i, (license, run) in enumerate(rules)], "rule int, license string, name string, run array<string>")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    cut = F.split(F.regexp_replace("text", r"([.!?;:])[ \t\x0B\f\r]+", "$1\n"), "\n")
    parts = F.filter(F.transform(cut, lambda x: _normal(F.regexp_replace(x, MARK_BEFORE, ""))), lambda x: x != "")
    doc = Window.partitionBy("id", "key").orderBy("first")
    # of each text only parts that lie in a known sentence, or are list marks, go on; each sees as many further ones as a sentence has words
    some = (own.select("id", "key", F.posexplode(parts).alias("first", "part")).join(F.broadcast(pieces), "part", "left")
            .where(F.col("piece") | F.col("part").rlike(MARK)).select("id", "key", "first", "part").distinct())
    ahead = some.withColumn("ahead", F.array_sort(F.collect_list(F.struct("first", "part")).over(doc.rangeBetween(0, max(len(w) for _, w in split)))))
    there = lambda n: F.get(F.col("ahead")["first"], n) == F.col("first") + n
    reads = lambda n: there(n - 1) & (F.array_join(F.slice(F.col("ahead")["part"], 1, n), " ") == F.col("sentence"))
    size = F.get(F.filter(F.sequence(F.lit(1), F.col("n")), reads), F.lit(0))
    found = ahead.join(F.broadcast(listed), "part").withColumn("size", size).where("size is not null").withColumn("last", F.col("first") + F.col("size") - 1)
    mark = F.coalesce(there(F.col("size")) & F.get(F.col("ahead")["part"], F.col("size")).rlike(MARK), F.lit(False))
    found = found.select("id", "key", "first", "last", F.when(mark, F.col("last") + 2).otherwise(F.col("last") + 1).alias("next"), "name")
    outer = found.withColumn("before", F.max("last").over(doc.rangeBetween(Window.unboundedPreceding, -1))).withColumn("longest", F.max("last").over(Window.partitionBy("id", "key", "first")))
    whole = outer.where("coalesce(before < last, true) and longest = last")
    place = Window.partitionBy("id", "key").orderBy("first", "name")
    step = F.when(F.col("first") == F.lag("first").over(place), 0).when(F.col("first").isin(F.lag("last").over(place) + 1, F.lag("next").over(place)), 1).otherwise(2)
    # pos rises by one from a sentence to the next if nothing but list marks lies between, else by two
    placed = whole.withColumn("step", step).withColumn("pos", F.sum("step").over(place.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    per_doc = placed.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("all"))
    at = per_doc.select("id", "key", "all", F.posexplode("all").alias("i", "first"))
    run = F.slice("all", F.col("i") + 1, F.size("run"))
    matches = (at.join(F.broadcast(ruled), F.col("first.name") == F.col("name"))
               .where((F.transform(run, lambda x: x["name"]) == F.col("run")) & (F.element_at(run, -1)["pos"] == F.col("first.pos") + F.size("run") - 1))
               .select("id", "key", "rule", "license", "i", F.explode(F.sequence(F.col("first.pos"), F.col("first.pos") + F.size("run") - 1)).alias("pos")))
    place = Window.partitionBy("id", "key", "pos")
    counted = (matches.withColumn("upper", F.min("rule").over(place)).groupBy("id", "key", "rule", "license", "i")
               .agg(F.min("upper").alias("upper"), F.collect_list("pos").alias("places")).where("upper = rule"))
    by_doc = counted.groupBy(F.col("id").alias("m_id"), F.col("key").alias("m_key")).agg(
        F.array_sort(F.collect_set("license")).alias("licenses"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("placed"))
    result = per_doc.join(by_doc, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left").select(
        "id", "key", F.transform("all", lambda x: x["name"]).alias("sentences"), "licenses", F.size(F.filter("all", lambda x: ~F.array_contains(F.coalesce("placed", F.array().cast("array<int>")), x["pos"]))).alias("unclassified"))
    empty = F.array().cast("array<string>")
    rows = own.select(F.col("id").alias("own_id"), F.col("key").alias("own_key"))
    both = rows.join(result, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    return both.select(F.col("own_id").alias(id_col), F.coalesce("sentences", empty).alias("sentences"), F.coalesce("licenses", empty).alias("licenses"), F.coalesce("unclassified", F.lit(0)).cast("long").alias("unclassified"))

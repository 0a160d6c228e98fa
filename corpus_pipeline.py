"""Cleaning a corpus: stages over `documents`, each written as Parquet and read by the next.

toxicity: documents that the model predicts to be toxic go.
line_dedup: lines of recurring templates go; no document goes, n_chars follows the text.
near_duplicates: of each group of linked documents the one with the smallest id stays (of rows that
share id and group, one); documents without words stay.
decontamination: documents with a window of a benchmark item go.
bpe: token ids and the text they decode to are added.

All stages hand on every column of their input, extra ones too; new names of the last one that would
clash get a leading underscore. Null or empty texts pass through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import bpe, decontaminate, jaccard, lines, toxicity
from plumbline.llm.common import table, written

#: Put before the names of columns that a stage makes and drops again.
OWN = "__stage_"


def _others(docs: DataFrame, *without: str) -> list[str]:
    return [c for c in docs.columns if c not in without]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, also=_others(docs, "doc_id"), mark=OWN)
    return found.where(F.col(f"{OWN}predicted") == 0).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(docs, also=_others(docs, "doc_id", "text", "n_chars"), mark=OWN)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are named by their id and a hash of their text; of equal rows of a group the first met stays."""
    own = f"{OWN}text"
    named = docs.withColumn(own, F.xxhash64("text"))
    found = written(jaccard.jaccard_join(named, also=[own]).select("doc_id", F.col("also")[own].alias("text"), "component"), "groups")
    grouped = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text")).alias("row")).select("row.*", F.lit(True).alias("once"))
    single = found.where("component is null").select("doc_id", "text", F.lit(False).alias("once")).distinct()
    stays = grouped.unionAll(single).select(F.col("doc_id").alias(f"{OWN}id"), F.col("text").alias(f"{OWN}hash"), F.col("once").alias(f"{OWN}once"))
    kept = named.join(stays, F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")) & (F.col(own) == F.col(f"{OWN}hash")))
    row = F.when(F.col(f"{OWN}once"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return kept.withColumn(f"{OWN}row", row).dropDuplicates([f"{OWN}id", f"{OWN}hash", f"{OWN}row"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), also=_others(docs, "doc_id"), mark=OWN)
    return found.where(F.size(f"{OWN}items") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), also=_others(docs, "doc_id"), mark=OWN)
    new = {"n_tokens": F.size(f"{OWN}ids").cast("long"), "ids": F.col(f"{OWN}ids"), "decoded": F.col(f"{OWN}decoded")}
    return made.select(*docs.columns, *[v.alias(f"_{k}" if k in docs.columns else k) for k, v in new.items()])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokens),
]

#: The toxicity model cannot be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

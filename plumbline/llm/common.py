"""Helpers shared by the operators: input tables, tables in the shared folder, broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='llm-shared-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own for a session of one process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = _own_dir()
    return known.rstrip("/")


#: Texts that go to a Python worker at once. Spark's own 10,000 are kept twice, by the worker and, outside its heap, by the executor.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Sets the session's rows per Arrow batch to BATCH_ROWS, unless it is fewer already. Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What this Python worker keeps from task to task under that name. It keeps one thing at a time: Spark uses a worker again for
    later steps, which need the memory."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Frees what this Python worker keeps of earlier steps; for tasks that keep nothing themselves."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and any executor can read it.

    The shuffle files of the jobs that made it are let go at once: Spark deletes them when the driver has
    collected the plans that own them as garbage, which a driver with little to do may put off for long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return made


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing will read them again."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path.rpartition("/")[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def members(rows: DataFrame, ids: DataFrame, bits: int = 24, column: str = "id") -> DataFrame:
    """rows whose column occurs in the table ids, and few others: a table of 2^bits bits, a fixed size, is
    broadcast, so that most other rows need not move in the exact join that follows."""
    spot = F.expr(f"id_hash & {(1 << bits) - 1}L")
    hashed = ids.select(F.xxhash64(column).alias("id_hash"))
    table = (hashed.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id_hash & 63 as int))")).alias("bits")))
    named = rows.withColumn("id_hash", F.xxhash64(column)).withColumn("word", F.shiftright(spot, 6))
    hit = named.join(F.broadcast(table), "word").where("(shiftrightunsigned(bits, cast(id_hash & 63 as int)) & 1) = 1")
    return hit.select(*rows.columns)


def buckets_within(sizes, limit: int) -> dict[object, list[int]]:
    """Of (name, bucket, bytes): each name's buckets, from the highest on, that fit into limit together; a bucket that does not fit is passed over."""
    total: dict[object, int] = {}
    found: dict[object, list[int]] = {}
    for name, bucket, size in sorted(sizes, key=lambda x: -x[1]):
        found.setdefault(name, [])
        if total.get(name, 0) + size <= limit:
            total[name] = total.get(name, 0) + size
            found[name].append(bucket)
    return found


def crc_bucket(column: str, n: int):
    """crc32 of the value as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def carried(docs: DataFrame, id_col: str, text_col: str, also: list[str] | None) -> tuple[DataFrame, list[str], list[int]]:
    """Frame of text, id and `also` without repeats; names to hand on (id first), and their places in the frame."""
    small_batches(docs.sparkSession)
    names = [id_col, *[c for c in also or [] if c != id_col]]
    frame = [text_col, *[c for c in names if c != text_col]]
    return docs.select(*frame), names, [frame.index(c) for c in names]


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, copies: str, share: int = 1024, least: int = 10_000) -> DataFrame:
    """rows with the columns of facts, a written table of one row per key; copies: its column with the number of
    rows of that key. Keys that hold one in share of all rows (share keys at most, which are broadcast) are dealt
    out over parts of least rows or more, so that no task gets a hot key whole."""
    total = facts.agg(F.sum(copies).alias("n")).head().n or 0
    floor = max(least, total // share + 1)
    hot = facts.where(F.col(copies) >= floor).select(key, F.ceil(F.col(copies) / floor).cast("int").alias("_parts"))
    named = rows.join(F.broadcast(hot), key, "left")
    salted = named.withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    parts = F.when(F.col(copies) >= floor, F.ceil(F.col(copies) / floor).cast("int")).otherwise(1)
    spread = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(spread, [key, "_part"], "left").drop("_part")

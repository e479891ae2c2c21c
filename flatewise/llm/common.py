"""Helpers for the training-data operators: tables in the shared folder, size-checked broadcasts, expression binding."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times this many bytes each stay below BROADCAST_BYTES.
BROADCAST_BYTES = 32 << 20
#: Bytes of a broadcast row of a few longs: rows of key and value in pages, and a hash table that doubles (115 to 150 measured).
HASHED_ROW = 160

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a new one if driver and executors are
    one process, as in tests. On a cluster there is no folder to guess, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not one_process(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="flatewise-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flatewise/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(remove_stored)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, as in tests."""
    return bool(re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master))


def give_back(spark: SparkSession) -> None:
    """Let go of what earlier work has left, on the driver and on executors.

    Spark frees broadcasts and shuffle files on executors only once the driver's collector finds that nothing refers to
    them, which by itself may take half an hour; and an executor's heap, once grown, shrinks only after a whole collection,
    beside which Python workers and buffers need their share of its memory."""
    gc.collect()
    release_memory()
    spark._jvm.java.lang.System.gc()
    if not one_process(spark):
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


_worker: dict = {"owner": None, "forget": []}


def own_worker(name: str, forget: Callable[[], None] | None = None) -> None:
    """Called in a Python worker when an operator begins there: what another operator kept goes, and is given back.

    forget: lets go of what this operator is going to keep from task to task."""
    if _worker["owner"] != name:
        for f in _worker["forget"]:
            f()
        _worker.update(owner=name, forget=[forget] if forget else [])
        gc.collect()
        release_memory()


def release_memory() -> None:
    """Give freed memory back, since idle workers live on beside the next operator's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def remove_stored() -> None:
    """Delete the tables that stored() has written in this process; also runs when it ends."""
    while _made:
        path, spark = _made.popitem()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def small(size: int) -> bool:
    """Whether so many bytes may be broadcast."""
    return size <= BROADCAST_BYTES


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, joined by shuffle whatever size Spark takes it for.

    Spark may take a side for far smaller than it is, as after an explode or where Parquet packs well, and build its hash
    table on the driver."""
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted size is under BROADCAST_BYTES; otherwise df, joined by shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if small(rows * row_bytes) else by_shuffle(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """0, 1, ... n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


#: Upper and lower case letters; other letters keep their case under the contracts of this subpackage.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: What separates words of ASCII letters, digits and any non-ASCII characters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def document_key() -> list[Column]:
    """Identifies a document's row even where doc_id repeats or is null: equal keys mean equal id and text."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def positioned_words(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text_key, and the text's words: word i (from 0) of n_words is get(words, i + at).

    The array keeps the empty strings that split() leaves beside separators at the ends; ``at`` steps over the first."""
    words = F.split(F.coalesce(ascii_lower(F.col("text")), F.lit("")), NON_WORD, -1)
    rows = docs.select(*document_key(), words.alias("words"), *more)
    at = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)
    end = F.size("words") - F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    return rows.withColumn("at", at).withColumn("n_words", F.greatest(F.lit(0), end - F.col("at")))


#: Rows and bytes of an Arrow batch: documents differ in length by five orders of magnitude, so bytes are what counts.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to these (never raise them); called by operators that run Python.

    A batch is held several times over, in the JVM, in Arrow and in Python, by every worker at once."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def hash_sample(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """About ``limit`` of the rows (doc_id, group) of each group, or all of a smaller one, chosen by hash of doc_id alone.

    The share that stays follows from the group's counted size, so no group is ranked or gathered."""
    sizes = rows.groupBy(F.col(group).alias("group_")).agg(F.count("*").alias("size_"))
    kept = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * limit / F.col("size_")
    return rows.join(broadcast_if_small(sizes, 256), F.col(group) == F.col("group_")).where(kept).select("doc_id", group)


def sampled_texts(docs: DataFrame, chosen: DataFrame, group: str, most_bytes: int) -> list[Row]:
    """Rows (doc_id, group, text) of the chosen ones, sorted by group and hash of doc_id; one text per doc_id and group.

    The driver first gets the texts' lengths, and then only texts that come to at most ``most_bytes`` a group."""
    wanted = broadcast_if_small(stored(chosen.select(F.col("doc_id").alias("chosen_"), group)), 256)
    texts = docs.select("doc_id", "text").where("text is not null")
    found = stored(texts.join(wanted, F.col("doc_id") == F.col("chosen_")).groupBy("doc_id", group).agg(F.min("text").alias("text")))
    place = F.xxhash64("doc_id").alias("place")
    sizes = found.select("doc_id", group, place, F.octet_length("text").alias("size")).collect()
    held: dict = {}
    taken = []
    for r in sorted(sizes, key=lambda r: (r[group], r["place"], r["doc_id"])):
        if held.get(r[group], 0) + r["size"] <= most_bytes:
            held[r[group]] = held.get(r[group], 0) + r["size"]
            taken.append((r["doc_id"], r[group]))
    if len(taken) < len(sizes):
        keys = found.sparkSession.createDataFrame(taken, found.select("doc_id", group).schema)
        found = found.join(F.broadcast(keys), ["doc_id", group])  # as many rows as were collected above
    return sorted(found.select("doc_id", group, place, "text").collect(), key=lambda r: (r[group], r["place"], r["doc_id"]))

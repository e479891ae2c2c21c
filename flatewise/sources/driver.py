"""Runs over files as the command line has them: outputs named and written beside the inputs, errors as rows.

Parts of an output are written in order by the task that holds them, into a file of that attempt's own name that is then
renamed; a lost executor's task is repeated and leaves no half-written output. Files are opened through pyarrow's file
systems, so inputs and outputs may lie wherever executors can reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..operators import codec, index
from ..options import CodecOptions
from . import files

PLAN = "stream_id long, path string, output string, format string, error string"
WRITTEN = "output string, n_out long, error string"


def _at(uri: str):
    """The file system and path of a URI or of a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _normal(path: str) -> str:
    """file:/a as file:///a, which is what other readers expect."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _refused(force: bool, decompress: bool, suffix: str):
    """Marks inputs that must not be worked on, as the command line does."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        for batch in batches:
            errors = []
            for path, output in zip(batch["path"], batch["output"]):
                system, at = _at(_normal(output))
                packed = path.lower().endswith((".gz", ".zz", ".zip", suffix.lower()))
                if not decompress and packed and not force:
                    errors.append("has_suffix")
                elif path == output:
                    errors.append("same_name")
                elif system.get_file_info(at).type != FileType.NotFound and not force:
                    errors.append("exists")
                else:
                    errors.append(None)
            yield batch.assign(error=errors)

    return check


def planned(spark: SparkSession, options: CodecOptions, pattern: str | None = None) -> DataFrame:
    """stream_id, path, output, format, error of every input; error says why an input is left alone."""
    found = files.files(spark, list(options.files), options.recursive, pattern).select("stream_id", "path", "format")
    name = formats.decompressed_name(F.col("path"), F.lit(False)) if options.decompress else formats.compressed_name(F.col("path"), F.lit(options.force), F.lit(options.suffix))
    return found.withColumn("output", name).withColumn("error", F.lit(None).cast("string")).select("stream_id", "path", "output", "format", "error").mapInPandas(_refused(options.force, options.decompress, options.suffix), PLAN)


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come ordered by output and part; each output's parts follow each other."""
    now = out = system = at = None
    n, error, own = 0, None, f".part-{uuid.uuid4().hex}"

    def closed() -> pd.DataFrame:
        out.close()
        if error is None:
            system.move(at + own, at)
        else:
            system.delete_file(at + own)
        return pd.DataFrame([(now, n, error)], columns=["output", "n_out", "error"])

    for batch in batches:
        for output, payload, wrong in zip(batch["output"], batch["payload"], batch["error"]):
            if output != now:
                if now is not None:
                    yield closed()
                system, at = _at(_normal(output))
                now, n, error, out = output, 0, None, system.open_output_stream(at + own)
            error = error or wrong
            if payload is not None:
                out.write(bytes(payload))
                n += len(payload)
    if now is not None:
        yield closed()


def write_parts(parts: DataFrame) -> DataFrame:
    """Write (output, part, payload, error): a file per output, its parts in order; none where a part has an error.

    Gives output, n_out, error once per file, when it is acted upon."""
    dealt = parts.select("output", "part", "payload", "error").repartition("output").sortWithinPartitions("output", "part")
    return dealt.select("output", "payload", "error").mapInPandas(_write, WRITTEN)


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            system, at = _at(_normal(path))
            system.delete_file(at)
        yield batch


def run(spark: SparkSession, options: CodecOptions, log: str | None = None, pattern: str | None = None) -> DataFrame:
    """Compress or decompress options.files: path, output, n_in, n_out, error for every input.

    One input's failure does not stop the others. Inputs go once their output is whole, unless options.keep. The rows are
    kept as Parquet under log, or under the folder of spark.checkpoint.dir."""
    base = log or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("run() needs a log path or spark.checkpoint.dir")
    base = f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"
    planned(spark, options, pattern).write.parquet(f"{base}/plan")
    plan = spark.read.parquet(f"{base}/plan")
    todo = plan.where("error is null")
    content = files.files(spark, list(options.files), options.recursive, pattern).select("stream_id", "length", "content")
    streams = content.join(todo.select("stream_id", "output", "format"), "stream_id")
    if options.decompress:
        gzip, zlib_, zip_ = (streams.where(F.col("format") == f) for f in ("gzip", "zlib", "zip"))
        members = index.decoded_members(gzip.select("stream_id", "content"))
        parts = members.select("stream_id", F.col("member_idx").alias("part"), F.col("data").alias("payload"), F.when(F.col("error") != "empty", F.col("error")).alias("error"))
        whole = zlib_.select("stream_id", codec.decode_zlib("content").alias("d")).select("stream_id", F.lit(0).alias("part"), F.col("d.data").alias("payload"), "d.error")
        refused = zip_.select("stream_id", F.lit(0).alias("part"), F.lit(None).cast("binary").alias("payload"), F.lit("zip_not_supported").alias("error"))
        parts = parts.unionByName(whole).unionByName(refused)
    elif options.zlib:
        parts = streams.select("stream_id", F.lit(0).alias("part"), codec.encode_zlib("content", F.lit(options.effective_level)).alias("payload"), F.lit(None).cast("string").alias("error"))
    else:
        coded = codec.compressed_parts(streams, options.level, options.threads, options.threads, options.block_size)
        parts = coded.select("stream_id", "part", "payload", F.lit(None).cast("string").alias("error"))
    write_parts(parts.join(todo.select("stream_id", "output"), "stream_id")).write.parquet(f"{base}/written")
    written = spark.read.parquet(f"{base}/written").select("output", "n_out", F.col("error").alias("failed"))
    sizes = files.files(spark, list(options.files), options.recursive, pattern).select("stream_id", F.col("length").alias("n_in"))
    done = plan.join(sizes, "stream_id").join(written, "output", "left").select("path", "output", "n_in", F.when(F.col("failed").isNull(), F.col("n_out")).alias("n_out"), F.coalesce("error", "failed").alias("error"))
    done.write.parquet(f"{base}/done")
    done = spark.read.parquet(f"{base}/done")
    if not options.keep:
        done.where("error is null").select("path").mapInPandas(_remove, "path string").foreach(lambda _: None)
    return done


def exit_code(done: DataFrame) -> int:
    """0 if no input failed, else 1."""
    return int(done.where("error is not null").limit(1).count() > 0)

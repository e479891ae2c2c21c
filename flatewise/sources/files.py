"""Sources and sinks: files and documents as streams, result files, synthetic data, and output."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats

RESULT = "tool string, level int, threads int, source string, time double, size long, output_size long, speed double, speed_mbps double, trials int, cv double, status string, error string, data_type string, size_mb int"


def files(spark: SparkSession, paths: str | list[str], recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """stream_id, path, length, content, format. Columns not asked for are not read; filter on path or length first."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(paths)
    kind = F.coalesce(formats.format_of_bytes(F.col("content")), formats.format_of_path(F.col("path")))
    found = rows.select("path", "length", "content").unionByName(_empty_files(rows))
    return found.select(F.xxhash64("path").alias("stream_id"), "path", "length", "content", kind.alias("format"))


def _empty_files(rows: DataFrame) -> DataFrame:
    """path, length, content of the files that a scan leaves out because they have no bytes."""
    one_slash = lambda path: re.sub(r"^([A-Za-z][\w+.-]*):/+(?=/)", r"\1:", unquote(path)) if path.startswith("file:") else unquote(path)
    listed = rows.sparkSession.createDataFrame([(one_slash(p),) for p in rows.inputFiles()], "path string")
    return listed.join(rows.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def bytes_source(spark: SparkSession, data: bytes, stream_id: int = 0) -> DataFrame:
    """One stream from memory, as standard input is."""
    return spark.createDataFrame([(stream_id, bytearray(data))], "stream_id long, content binary")


def from_text(rows: DataFrame, stream_id: str, text: Column | str) -> DataFrame:
    """Rows' texts as UTF-8 streams."""
    return rows.select(F.col(stream_id).cast("long").alias("stream_id"), F.encode(text, "UTF-8").alias("content"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by key if they come in fewer partitions than the cluster has cores (as one small file does);
    unchanged, without a shuffle, otherwise."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """Results in all JSON files under path: a list, or an object with results, benchmarks, compression or decompression.

    arrival orders rows by file and place, since de-duplication depends on order; files that are no JSON give nothing."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    item = f"array<struct<{','.join(c.replace(' ', ':') for c in RESULT.split(', ')).replace(',', ',')}>>"
    of_object = F.from_json("value", f"struct<results:{item},benchmarks:{item},compression:{item},decompression:{item}>")
    none = F.array().cast(item)
    lists = F.concat(*[F.coalesce(of_object[k], none) for k in ("results", "benchmarks", "compression", "decompression")])
    found = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.coalesce(F.from_json("value", item), none)).otherwise(F.coalesce(lists, none))
    rows = raw.select("path", F.posexplode(found).alias("place", "r"))
    return rows.select("path", F.struct("path", "place").alias("arrival"), "r.*")


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_streams(payloads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Payloads as a Parquet table of (stream_id, payload); sources.driver writes them as files."""
    payloads.write.mode(mode).parquet(path)


def synthetic_logs(spark: SparkSession, n: int, patterns: list[str] | None = None) -> DataFrame:
    """stream_id, line: repetitive log lines, patterns taken in turn with a running number modulo 1000."""
    patterns = patterns or ["INFO request served in %d ms", "WARN cache miss for key %d", "DEBUG worker %d is idle", "ERROR retry %d of upload", "INFO user %d signed in"]
    text = F.lit("")
    for i, p in enumerate(patterns):
        text = F.when(F.col("id") % len(patterns) == i, F.format_string(p, F.col("id") % 1000)).otherwise(text)
    return spark.range(n).select(F.col("id").alias("stream_id"), text.alias("line"))


def sized_text(spark: SparkSession, sizes: list[int], phrase: str = "the quick brown fox jumps over the lazy dog. ") -> DataFrame:
    """Streams of given sizes: a phrase repeated and cut."""
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "stream_id long, n int")
    times = (F.floor(F.col("n") / len(phrase)) + 1).cast("int")
    return rows.select("stream_id", F.substr(F.encode(F.repeat(F.lit(phrase), times), "UTF-8"), F.lit(1), F.col("n")).alias("content"))


def random_bytes(spark: SparkSession, sizes: list[int], seed: int = 42) -> DataFrame:
    """Streams of given sizes that do not compress: hashes of the seed, the stream and a counter."""
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "stream_id long, n int")
    each = F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / 32).cast("int")), lambda i: F.unhex(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("stream_id").cast("string"), i.cast("string")), 256)))
    whole = F.aggregate(each, F.lit(b""), lambda a, b: F.concat(a, b))
    return rows.select("stream_id", F.substr(whole, F.lit(1), F.col("n")).alias("content"))


def binary_records(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """Streams of fixed-width records: a counter, its square and a flag, 4 bytes each, in big-endian order."""
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "stream_id long, n int")
    word = lambda v: F.unhex(F.lpad(F.hex(v), 8, "0"))
    ids = F.sequence(F.lit(0), F.floor(F.col("n") / 12).cast("int"))
    each = F.transform(ids, lambda i: F.concat(word(i), word((i.cast("long") * i) % (1 << 32)), word(i % 2)))
    return rows.select("stream_id", F.substr(F.aggregate(each, F.lit(b""), lambda a, b: F.concat(a, b)), F.lit(1), F.col("n")).alias("content"))


def tarball(streams: DataFrame, name: str, content: str, into: str) -> DataFrame:
    """stream_id, content: the rows of each ``into`` as one uncompressed POSIX archive, in order of name."""
    size = F.length(content)
    octal = lambda v, width: F.concat(F.lpad(F.conv(v.cast("string"), 10, 8), width - 1, "0"), F.lit("\0"))
    named = F.rpad(F.substring(F.col(name), 1, 100), 100, "\0")
    before = F.concat(named, F.lit("0000644\0" + "0000000\0" * 2), octal(size, 12), F.lit("0" * 11 + "\0"))
    after = F.rpad(F.concat(F.lit("0"), F.rpad(F.lit(""), 100, "\0"), F.lit("ustar\x0000")), 512 - 156, "\0")
    text = F.concat(before, F.rpad(F.lit(""), 8, " "), after)
    total = F.aggregate(F.transform(F.split(text, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, b: a + b)
    check = F.concat(F.lpad(F.conv(total.cast("string"), 10, 8), 6, "0"), F.lit("\0 "))
    head = F.encode(F.concat(before, check, after), "UTF-8")
    pad = F.encode(F.rpad(F.lit(""), ((512 - size % 512) % 512).cast("int"), "\0"), "UTF-8")
    rows = streams.select(F.col(into).cast("long").alias("stream_id"), F.col(name).alias("name_"), F.concat(head, F.col(content), pad).alias("part"))
    whole = rows.groupBy("stream_id").agg(F.expr("listagg(part) WITHIN GROUP (ORDER BY name_)").alias("content"))
    return whole.select("stream_id", F.concat("content", F.lit(bytes(1024))).alias("content"))


def guard_data(spark: SparkSession, lines: int = 200_000, width: int = 100, seed: int = 42) -> DataFrame:
    """line, text: lines of ``width`` letters from a to j, drawn by hashes of the seed and the place."""
    letter = lambda i: F.substr(F.lit("abcdefghij"), (F.pmod(F.xxhash64(F.lit(seed), F.col("line"), i), F.lit(10)) + 1).cast("int"), F.lit(1))
    rows = spark.range(lines).select(F.col("id").alias("line"))
    return rows.select("line", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(width)), letter), "").alias("text"))


def software_archive(spark: SparkSession, n: int) -> DataFrame:
    """path, content: n source-like files of repeated statements, names and indentation, as archives of software have."""
    i = F.col("id")
    body = F.repeat(F.format_string("    if value_%d > %d {\n        total = total + table[%d];\n    }\n", i % 50, i % 97, i % 16), (20 + i % 30).cast("int"))
    text = F.concat(F.format_string("// module %d\nfn compute_%d(table) {\n    total = 0;\n", i, i), body, F.lit("    return total;\n}\n"))
    return spark.range(n).select(F.format_string("src/module_%d/file_%d.src", (i % 20).cast("long"), i).alias("path"), F.encode(text, "UTF-8").alias("content"))


def datasets(spark: SparkSession, size: int = 1 << 16) -> DataFrame:
    """name, level, content of the built-in data sets."""
    one = lambda rows, name, level: rows.select(F.lit(name).alias("name"), F.lit(level).alias("level"), "content")
    archive = tarball(software_archive(spark, 40).withColumn("one", F.lit(0)), "path", "content", "one")
    logs = synthetic_logs(spark, 1000).groupBy().agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY stream_id)").alias("t")).select(F.encode("t", "UTF-8").alias("content"))
    sets = [one(sized_text(spark, [size]), "text", 6), one(random_bytes(spark, [size]), "random", 1), one(binary_records(spark, [size]), "binary", 6), one(archive, "software", 9), one(logs, "logs", 1)]
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out

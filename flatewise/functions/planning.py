"""Planning rules as column expressions: threads, buffers, backends, block sizes, levels, and the plan as a struct.

All take columns (or literals), so a plan is part of the query: Catalyst folds constants and prunes unused parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB = 1024, 1024 * 1024
SMALL_FILE = 100 * KIB
SINGLE_BELOW = 64 * KIB
MMAP_FROM = 128 * KIB


def thread_count(requested: Column, size: Column, level: Column, cores: int) -> Column:
    n = F.least(requested, F.lit(cores))
    return F.when(level.between(2, 5) & (size <= SMALL_FILE), F.greatest(F.lit(1), F.floor(n / 2).cast("int"))).otherwise(n)


def buffer_size(size: Column, content_type: Column) -> Column:
    base = F.when(size <= SMALL_FILE, 32 * KIB).when(size <= MIB, 64 * KIB).when(size <= 10 * MIB, 128 * KIB).otherwise(512 * KIB)
    return F.when(content_type == "Binary", base * 2).when(content_type == "Random", (base / 2).cast("int")).otherwise(base)


def backend(size: Column, threads: Column) -> Column:
    return F.when((size > SINGLE_BELOW) & (threads > 1), "Parallel").otherwise("SingleThreaded")


def numa_pinning(size: Column, threads: Column) -> Column:
    return (threads >= 4) & (size >= 10 * MIB)


def independent_block_size(level: Column, size: Column, threads: Column) -> Column:
    """Low levels take an eighth of a thread's share, from 64 to 256 KiB in steps of 64; others a size of their own."""
    share = F.least(F.lit(256 * KIB), F.greatest(F.lit(64 * KIB), F.floor(size / (8 * threads))))
    stepped = (F.ceil(share / (64 * KIB)) * 64 * KIB).cast("int")
    return F.when(level <= 2, stepped).when(level <= 6, 64 * KIB).when(level <= 9, 128 * KIB).otherwise(512 * KIB)


def chained_block_size(size: Column) -> Column:
    return F.when(size >= 50 * MIB, 192 * KIB).otherwise(128 * KIB)


def adjusted_level(level: Column) -> Column:
    """Level 1 runs as 2 in the stream encoder; zlib ends at 9."""
    return F.least(F.lit(9), F.when(level == 1, 2).otherwise(level))


def plan(requested: Column, size: Column, level: Column, content_type: Column, cores: int) -> Column:
    threads = thread_count(requested, size, level, cores)
    return F.struct(
        threads.alias("threads"), buffer_size(size, content_type).alias("buffer_size"), backend(size, threads).alias("backend"),
        content_type.alias("content_type"), numa_pinning(size, threads).alias("use_numa"), level.alias("level"),
    )


def size_pair(size: Column) -> Column:
    """(value, unit) up to GB."""
    out = F.struct(size.cast("double").alias("value"), F.lit("B").alias("unit"))
    for unit, scale in (("KB", KIB), ("MB", MIB), ("GB", 1024 * MIB)):
        out = F.when(size >= scale, F.struct((size / scale).alias("value"), F.lit(unit).alias("unit"))).otherwise(out)
    return out


def size_text(size: Column) -> Column:
    """'512 B', '1.5 KB', ... up to TB; a half is rounded to the even digit."""
    out = F.format_string("%d B", size.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scale = 1024**power
        out = F.when(size >= scale, F.format_string(f"%.1f {unit}", F.bround(size / scale, 1))).otherwise(out)
    return out


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "N/A").otherwise(F.format_string("%.1f%%", F.bround(part / whole * 100, 1)))


def compression_stats(n_in: Column, n_out: Column) -> Column:
    ratio = F.when(n_in == 0, 1.0).otherwise(n_out / n_in)
    return F.struct(ratio.alias("ratio"), ((1 - ratio) * 100).alias("saved_percent"))


def expansion(n_in: Column, n_out: Column) -> Column:
    return F.when((n_out == 0) | (n_in == 0), 1.0).otherwise(n_out / n_in)


def throughput(n_bytes: Column, seconds: Column, binary: bool = False) -> Column:
    """MB/s (1e6), or MiB/s."""
    return F.when(seconds > 0, n_bytes / seconds / (MIB if binary else 1e6))


def speedup(own: Column, other: Column) -> Column:
    return F.when(own > 0, other / own)


def difference_percent(own: Column, other: Column) -> Column:
    return F.when(other > 0, (own / other - 1) * 100)


def verdict(diff_percent: Column, strong: float = 10, weak: float = 0, bad: float = -5) -> Column:
    return F.when(diff_percent >= strong, "much_faster").when(diff_percent >= weak, "faster").when(diff_percent >= bad, "similar").otherwise("slower")


def data_type_of(path: Column) -> Column:
    """The first known data type named in a path."""
    out = F.lit("unknown")
    for name in ("tarball", "text", "logs", "software", "silesia"):
        out = F.when(F.contains(F.lower(path), F.lit(name)), name).otherwise(out)
    return out


def canonical_tool(tool: Column) -> Column:
    return F.when(tool == "unpigz", "pigz").otherwise(tool)


def time_allowance(level: Column, size_mb: Column) -> Column:
    return F.when(level >= 10, 500.0).when(size_mb <= 1, 15.0).when(size_mb <= 10, 8.0).otherwise(5.0)


def size_allowance(level: Column) -> Column:
    return F.when(level >= 10, -3.0).when(level >= 9, 0.5).when(level >= 6, 2.0).otherwise(8.0)


def distance_bucket(distance: Column) -> Column:
    return F.when(distance <= 1, "1").when(distance < 8, "2-7").when(distance < 40, "8-39").otherwise("40+")


def length_bucket(length: Column) -> Column:
    return F.when(length <= 8, "3-8").when(length <= 32, "9-32").otherwise("33+")

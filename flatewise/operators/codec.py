"""Block codec: split, independent and chained encoding, ordered merge, assembly, and decoding.

Streams are rows (stream_id, content). Splitting, dictionaries and merging are built-in expressions; only DEFLATE itself
runs in Arrow-batched UDFs. Spread over the cluster comes from rows being blocks, and order from the block's number.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import framing
from ..functions import planning as P
from ..options import DICTIONARY
from ..plans import routing

#: Types are objects, so that workers can import this module without a session.
DECODED = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])
EMPTY_MEMBER = framing.plain_member(b"", 9)


@F.pandas_udf(T.BinaryType())
def encode_indexed(data: pd.Series, level: pd.Series) -> pd.Series:
    """A self-indexing gzip member per block."""
    return pd.Series([None if d is None else framing.indexed_member(d, n) for d, n in zip(data, level)], dtype=object)


@F.pandas_udf(T.BinaryType())
def encode_chained(data: pd.Series, dictionary: pd.Series, level: pd.Series, last: pd.Series) -> pd.Series:
    """Raw DEFLATE of a block that may refer to its dictionary; byte-aligned, and final for the last."""
    return pd.Series([framing.deflate(d, n, z or b"", bool(e)) for d, z, n, e in zip(data, dictionary, level, last)], dtype=object)


@F.pandas_udf(T.BinaryType())
def encode_single(data: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else framing.plain_member(d, n) for d, n in zip(data, level)], dtype=object)


@F.pandas_udf(T.BinaryType())
def encode_zlib(data: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else zlib.compress(d, n) for d, n in zip(data, level)], dtype=object)


#: zlib's strategies by name; ``stored`` takes the level for the size of its blocks instead.
STRATEGIES = {"default": zlib.Z_DEFAULT_STRATEGY, "filtered": zlib.Z_FILTERED, "huffman": zlib.Z_HUFFMAN_ONLY, "runs": zlib.Z_RLE, "fixed": zlib.Z_FIXED}


@F.pandas_udf(T.BinaryType())
def encode_by_strategy(data: pd.Series, level: pd.Series, strategy: pd.Series) -> pd.Series:
    """A plain member whose blocks are made by the named strategy."""
    out = []
    for d, n, s in zip(data, level, strategy):
        out.append(None if d is None else framing.member(d, framing.stored_deflate(d, int(n)) if s == "stored" else framing.strategy_deflate(d, int(n), STRATEGIES[s])))
    return pd.Series(out, dtype=object)


@F.pandas_udf(DECODED)
def decode_zlib(data: pd.Series) -> pd.DataFrame:
    out = []
    for d in data:
        try:
            out.append((None, None) if d is None else (zlib.decompress(d), None))
        except zlib.error as e:
            out.append((None, f"bad_data: {e}"))
    return pd.DataFrame(out, columns=["data", "error"])


@F.pandas_udf(DECODED)
def inflate_member(member: pd.Series, deflate_offset: pd.Series) -> pd.DataFrame:
    """One member's data, checked against its trailer."""
    out = []
    for m, at in zip(member, deflate_offset):
        if m is None:
            out.append((None, None))
            continue
        try:
            d = zlib.decompressobj(-15)
            data = d.decompress(m[int(at) :]) + d.flush()
            end = d.unused_data
            if not d.eof or len(end) < 8:
                out.append((data, "truncated"))
            else:
                crc, n = struct.unpack("<II", end[:8])
                wrong = "crc_mismatch" if crc != zlib.crc32(data) else "size_mismatch" if n != len(data) & 0xFFFFFFFF else None
                out.append((data, wrong))
        except zlib.error as e:
            out.append((None, f"bad_data: {e}"))
    return pd.DataFrame(out, columns=["data", "error"])


@F.pandas_udf(T.BinaryType())
def inflate_with_dictionary(data: pd.Series, dictionary: pd.Series) -> pd.Series:
    """Raw DEFLATE data after a window."""
    out = []
    for d, z in zip(data, dictionary):
        o = zlib.decompressobj(-15, **({"zdict": z} if z else {}))
        out.append(o.decompress(d))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.LongType())
def combined_crc32(part: pd.Series, crc: pd.Series, length: pd.Series) -> int:
    """CRC-32 of parts laid end to end in the order of ``part``; an aggregate whose input order does not matter."""
    total = 0
    for _, c, n in sorted(zip(part, crc, length)):
        total = framing.crc32_combine(total, int(c), int(n))
    return total


@F.pandas_udf(T.LongType())
def advanced_crc32(crc: pd.Series, n: pd.Series) -> pd.Series:
    """What a part's CRC-32 adds to that of the whole if n bytes follow the part."""
    return pd.Series([framing.crc32_combine(int(c), 0, int(k)) for c, k in zip(crc, n)], dtype="int64")


def whole_crc32(parts: DataFrame, keys: list[str], start: str, length: str, crc: str) -> DataFrame:
    """keys, crc, n: CRC-32 and size of each whole from its parts' places, sizes and checksums.

    A checksum is the exclusive or of its parts' advanced ones, so parts are combined within tasks first and a stream of
    any number of parts is never gathered."""
    sizes = parts.groupBy(*keys).agg(F.sum(length).alias("n"))
    follow = F.col("n") - F.col(start) - F.col(length)
    rows = parts.join(sizes, keys).select(*keys, "n", advanced_crc32(F.col(crc), follow).alias("a"))
    return rows.groupBy(*keys).agg(F.bit_xor("a").alias("crc"), F.first("n").alias("n"))


def merged(payload: str, order: str) -> Column:
    """Binary pieces of a group, concatenated in order."""
    return F.expr(f"listagg({payload}) WITHIN GROUP (ORDER BY {order})")


def split(streams: DataFrame, size: Column) -> DataFrame:
    """Blocks: the streams' columns without content, and block_idx, start, data, is_last. An empty stream has one block."""
    rest = [c for c in streams.columns if c != "content"]
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / F.col("block_size_"))).cast("int")
    rows = streams.withColumn("block_size_", size).withColumn("n_blocks_", n)
    rows = rows.select(*rest, "content", "block_size_", "n_blocks_", F.explode(F.sequence(F.lit(0), F.col("n_blocks_") - 1)).alias("block_idx"))
    start = F.col("block_idx") * F.col("block_size_")
    return rows.select(
        *rest, "block_idx", start.cast("long").alias("start"), F.substr("content", (start + 1).cast("int"), F.col("block_size_").cast("int")).alias("data"),
        (F.col("block_idx") == F.col("n_blocks_") - 1).alias("is_last"), F.substr("content", F.greatest(F.lit(1), start + 1 - DICTIONARY).cast("int"), F.least(start, F.lit(DICTIONARY)).cast("int")).alias("dictionary"),
    )


def independent_parts(streams: DataFrame, level: Column, size: Column) -> DataFrame:
    """stream_id, part, payload: self-indexing members. level and size may use the streams' columns."""
    return split(streams, size).select("stream_id", F.col("block_idx").alias("part"), encode_indexed("data", level).alias("payload"))


def compress_independent(streams: DataFrame, level: Column, size: Column) -> DataFrame:
    """stream_id, payload: self-indexing members in order, decodable in parallel."""
    return independent_parts(streams, level, size).groupBy("stream_id").agg(merged("payload", "part").alias("payload"))


def chained_parts(streams: DataFrame, level: Column, size: Column) -> DataFrame:
    """stream_id, part, payload: one member in parts, whose blocks refer to the 32 KiB before them; the header stands in
    the first part and the trailer in the last."""
    # the whole's checksum and size ride along with its blocks; combined_crc32 is for streams that lie in several rows
    whole = streams.withColumns({"crc_": F.crc32("content"), "n_": F.length("content").cast("long")})
    le = lambda v: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(4)])
    body = encode_chained("data", "dictionary", level, "is_last").alias("body")
    coded = split(whole, size).select("stream_id", F.col("block_idx").alias("part"), "is_last", "crc_", "n_", body)
    head = F.when(F.col("part") == 0, F.lit(framing.PLAIN_HEADER)).otherwise(F.lit(b""))
    tail = F.when(F.col("is_last"), F.concat(le(F.col("crc_")), le(F.col("n_")))).otherwise(F.lit(b""))
    return coded.select("stream_id", "part", F.concat(head, "body", tail).alias("payload"))


def compress_chained(streams: DataFrame, level: Column, size: Column) -> DataFrame:
    """stream_id, payload: the parts of one member laid end to end."""
    return chained_parts(streams, level, size).groupBy("stream_id").agg(merged("payload", "part").alias("payload"))


def compressed_parts(streams: DataFrame, level: int = 6, threads: int = 4, cores: int = 8, block_size: int | None = None) -> DataFrame:
    """stream_id, strategy, part, payload: every stream by the strategy the plan gives it, in parts to be laid end to end.

    Parts are never brought into one row, so a stream's size is bounded by its input row alone. block_size replaces the
    planned one."""
    n = F.length("content").cast("long")
    t = P.thread_count(F.lit(threads), n, F.lit(level), cores)
    planned = streams.select("stream_id", "content").withColumn("strategy", routing.compress_strategy(n, F.lit(level), t))
    used = F.lit(min(level, 9))
    of = lambda s: planned.where(F.col("strategy") == s).select("stream_id", "content")
    size = lambda planned_size: F.lit(block_size) if block_size else planned_size
    whole = lambda s, payload: of(s).select("stream_id", F.lit(0).alias("part"), payload.alias("payload"))
    done = [
        ("EMPTY", whole("EMPTY", F.lit(EMPTY_MEMBER))),
        ("SINGLE", whole("SINGLE", encode_single("content", P.adjusted_level(F.lit(level))))),
        ("INDEPENDENT", independent_parts(of("INDEPENDENT"), used, size(P.independent_block_size(F.lit(level), F.length("content"), F.lit(max(1, min(threads, cores))))))),
        ("CHAINED", chained_parts(of("CHAINED"), used, size(P.chained_block_size(F.length("content"))))),
    ]
    out = None
    for name, parts in done:
        rows = parts.select("stream_id", F.lit(name).alias("strategy"), "part", "payload")
        out = rows if out is None else out.unionByName(rows)
    return out


def compress(streams: DataFrame, level: int = 6, threads: int = 4, cores: int = 8) -> DataFrame:
    """stream_id, strategy, effective_level, payload: every stream by the strategy the plan gives it."""
    parts = compressed_parts(streams, level, threads, cores)
    done = parts.groupBy("stream_id", "strategy").agg(merged("payload", "part").alias("payload"))
    return done.select("stream_id", "strategy", F.lit(min(level, 9)).alias("effective_level"), "payload")

"""Member index of gzip streams: exact walk, offsets, listing, testing, candidates, and parallel decoding from the index."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import framing, resume
from ..plans import routing
from . import codec

MEMBERS = "stream_id long, member_idx int, start long, length long, deflate_offset int, isize long, n_out long, crc_ok boolean, indexed boolean, error string"


def walk(data: bytes, keep: bool = False, stepping: bool = True) -> Iterator[tuple]:
    """(start, length, deflate offset, isize, bytes out, crc ok, indexed, error, data) of each member.

    A member whose header tells its size is stepped over without decoding (bytes out and crc are then null); for others
    the decoder says where it ends, and their data are given if keep is set. What follows the last member gives one row
    with an error. stepping: believe headers that tell a size; otherwise all members are decoded."""
    at = 0
    if not data:
        yield 0, 0, 0, 0, 0, None, False, "empty", b""
    while at < len(data):
        head = framing.parse_header(data, at)
        if head is None:
            yield at, len(data) - at, 0, 0, 0, None, False, "trailing_bytes" if at else "not_gzip", b""
            return
        size = head.member_size if stepping else None
        if size and head.size + 8 <= size <= len(data) - at:
            yield at, size, head.size, struct.unpack_from("<I", data, at + size - 4)[0], None, None, True, None, None
            at += size
            continue
        d, n, crc, feed, parts = zlib.decompressobj(-15), 0, 0, data[at + head.size :], []
        error = None
        try:
            while feed and not d.eof:
                out = d.decompress(feed, 1 << 20)
                n, crc, feed = n + len(out), zlib.crc32(out, crc), d.unconsumed_tail
                if keep:
                    parts.append(out)
        except zlib.error as e:
            error = f"bad_data: {e}"
        got = b"".join(parts)
        if error or not d.eof or len(d.unused_data) < 8:
            yield at, len(data) - at, head.size, 0, n, False, False, error or "truncated", got
            return
        want_crc, isize = struct.unpack("<II", d.unused_data[:8])
        length = len(data) - len(d.unused_data) + 8 - at
        wrong = "crc_mismatch" if want_crc != crc else "size_mismatch" if isize != n & 0xFFFFFFFF else None
        yield at, length, head.size, isize, n, wrong is None, False, wrong, got
        at += length


def members(streams: DataFrame) -> DataFrame:
    """One row per member of each stream (stream_id, content), see walk()."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        for batch in batches:
            rows = [(s, i, *m[:8]) for s, data in zip(batch["stream_id"], batch["content"]) for i, m in enumerate(walk(data or b""))]
            frame = pd.DataFrame(rows, columns=names)
            frame["n_out"] = frame["n_out"].astype("Int64")
            frame["crc_ok"] = frame["crc_ok"].astype("boolean")
            yield frame

    return streams.select("stream_id", "content").mapInPandas(scan, MEMBERS)


def with_offsets(index: DataFrame) -> DataFrame:
    """The index with output_offset: bytes that earlier members of the stream give."""
    earlier = Window.partitionBy("stream_id").orderBy("member_idx").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("output_offset", F.coalesce(F.sum(F.coalesce("n_out", "isize")).over(earlier), F.lit(0)))


def listing(streams: DataFrame) -> DataFrame:
    """stream_id, n_members, compressed, uncompressed, ratio: what --list tells."""
    rows = members(streams).where("error is null or error like '%_mismatch'")
    got = rows.groupBy("stream_id").agg(F.count("*").alias("n_members"), F.sum("length").alias("compressed"), F.sum(F.coalesce("n_out", "isize")).alias("uncompressed"))
    return got.withColumn("ratio", F.when(F.col("uncompressed") > 0, 1 - F.col("compressed") / F.col("uncompressed")).otherwise(0.0))


_CUT = "stream_id long, member_idx int, deflate_offset int, member binary, data binary, error string"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _CUT.split(", ")]
    for batch in batches:
        rows = []
        for s, data in zip(batch["stream_id"], batch["content"]):
            for i, (start, length, head, _, _, _, indexed, error, out) in enumerate(walk(data or b"", keep=True)):
                rows.append((s, i, head, data[start : start + length] if indexed else None, out, error))
        yield pd.DataFrame(rows, columns=names)


def decoded_members(streams: DataFrame, spread: bool = False) -> DataFrame:
    """stream_id, member_idx, data, error: members that tell their size are decoded apart from each other.

    spread: deal them out over the cluster first, for streams so large that their own rows don't fill it."""
    cut = streams.select("stream_id", "content").mapInPandas(_cut, _CUT)
    if spread:
        cut = cut.repartition("stream_id", "member_idx")
    found = codec.inflate_member("member", "deflate_offset")
    one = cut.select("stream_id", "member_idx", "member", "data", "error", found.alias("d"))
    held = F.col("member").isNotNull()
    return one.select("stream_id", "member_idx", F.when(held, F.col("d.data")).otherwise(F.col("data")).alias("data"), F.when(held, F.col("d.error")).otherwise(F.col("error")).alias("error"))


def decompress(streams: DataFrame, mode: str = "PERMISSIVE", spread: bool = False) -> DataFrame:
    """stream_id, data, error: the members' data in order; error is the first member's that has one.

    PERMISSIVE keeps what could be decoded; FAILFAST raises for the first error."""
    parts = decoded_members(streams, spread)
    if mode == "FAILFAST":
        parts = parts.withColumn("error", F.when(F.col("error").isNotNull() & (F.col("error") != "empty"), F.raise_error(F.concat(F.lit("stream "), F.col("stream_id").cast("string"), F.lit(": "), F.col("error")))))
    some = parts.withColumn("data", F.coalesce("data", F.lit(b"")))
    return some.groupBy("stream_id").agg(codec.merged("data", "member_idx").alias("data"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("member_idx"))).alias("error"))


@F.pandas_udf(T.StructType([T.StructField("gzip", T.BooleanType()), T.StructField("indexed", T.BooleanType()), T.StructField("candidates", T.IntegerType())]))
def _seen(content: pd.Series) -> pd.DataFrame:
    heads = [framing.parse_header(data or b"") for data in content]
    counts = [len(candidate_starts(data or b"", "member")) if h else 0 for h, data in zip(heads, content)]
    return pd.DataFrame({"gzip": [h is not None for h in heads], "indexed": [bool(h and h.member_size) for h in heads], "candidates": pd.Series(counts, dtype="int32")})


def routed(streams: DataFrame) -> DataFrame:
    """stream_id, strategy: how each stream is best decoded, from its first header and the members behind further ones."""
    seen = streams.select("stream_id", _seen("content").alias("s"))
    return seen.select("stream_id", routing.decompress_strategy(F.col("s.gzip"), F.col("s.indexed"), F.col("s.candidates")).alias("strategy"))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _at_candidates(content: pd.Series) -> pd.Series:
    """Streams cut where a whole header stands."""
    out = []
    for data in content:
        data = data or b""
        starts = [0, *(m.start() for m in re.finditer(b"\x1f\x8b\x08", data) if m.start() and framing.parse_header(data, m.start()))]
        out.append([data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])])
    return pd.Series(out, dtype=object)


@F.pandas_udf(codec.DECODED)
def _whole_member(piece: pd.Series) -> pd.DataFrame:
    """A piece's data if it is one sound member and nothing else."""
    out = []
    for data in piece:
        found = list(walk(bytes(data), keep=True, stepping=False))
        one = len(found) == 1 and found[0][7] is None
        out.append((found[0][8], None) if one else (None, "not_one_member"))
    return pd.DataFrame(out, columns=["data", "error"])


def decompress_candidates(streams: DataFrame) -> DataFrame:
    """stream_id, data, error like decompress(), for streams of many members that do not tell their size.

    Each stream is cut where headers seem to stand and its pieces are decoded apart from each other, dealt out over the
    cluster. Where a piece is not exactly one sound member, a candidate was false or the stream is damaged, and that
    stream is walked from its beginning instead; the outcome never depends on the candidates."""
    pieces = streams.select("stream_id", F.posexplode(_at_candidates("content")).alias("piece", "content")).repartition("stream_id", "piece")
    parts = pieces.select("stream_id", "piece", _whole_member("content").alias("d")).select("stream_id", "piece", "d.*")
    whole = parts.groupBy("stream_id").agg(codec.merged("data", "piece").alias("data"), F.max("error").alias("error"))
    sound = whole.where("error is null")
    rest = streams.join(whole.where("error is not null").select("stream_id"), "stream_id", "left_semi")
    return sound.unionByName(decompress(rest))


@F.pandas_udf(codec.DECODED)
def decode_whole(content: pd.Series) -> pd.DataFrame:
    """A stream's data by one pass over it, member sizes in headers being ignored; and the first error."""
    out = []
    for data in content:
        found = list(walk(bytes(data or b""), keep=True, stepping=False))
        out.append((b"".join(m[8] for m in found), next((m[7] for m in found if m[7]), None)))
    return pd.DataFrame(out, columns=["data", "error"])


@F.pandas_udf(codec.DECODED)
def decode_resumed(content: pd.Series, piece: pd.Series) -> pd.DataFrame:
    """A stream's data by a decoder that is put away and taken up again after every ``piece`` bytes."""
    out = []
    for data, n in zip(content, piece):
        decoder, got = resume.Resumable(), []
        for at in range(0, len(data or b""), int(n)):
            got.append(decoder.feed(bytes(data[at : at + int(n)])))
            decoder = resume.Resumable(*decoder.state())
        out.append((b"".join(got), decoder.error or (None if decoder.at_end else "truncated")))
    return pd.DataFrame(out, columns=["data", "error"])


def tested(streams: DataFrame) -> DataFrame:
    """stream_id, n_members, ok, error: what --test tells; every checksum is computed."""
    parts = decoded_members(streams)
    return parts.groupBy("stream_id").agg(F.count("*").alias("n_members"), F.bool_and(F.col("error").isNull()).alias("ok"), F.min("error").alias("error"))


#: How much of a header a candidate must have right, from the flags alone to all of it; a member must also begin there.
STRICTNESS = ("flags", "system", "time", "header", "member")


def _candidate(data: bytes, at: int, strictness: str) -> bool:
    if at + 10 > len(data) or data[at + 3] & framing.RESERVED:
        return False
    if strictness in ("system", "time") and not (data[at + 8] in (0, 2, 4) and (data[at + 9] <= 13 or data[at + 9] == 255)):
        return False
    if strictness == "time" and struct.unpack_from("<I", data, at + 4)[0] > 4102444800:
        return False
    return strictness not in ("header", "member") or framing.parse_header(data, at) is not None


def candidate_starts(data: bytes, strictness: str = "time") -> list[int]:
    """Places that look like member headers. Coded data hold whole headers by chance, so under "member" a stream that
    has more than its first is walked, and only places where the walk comes upon a member count."""
    if strictness not in STRICTNESS:
        raise ValueError(strictness)
    found = [m.start() for m in re.finditer(b"\x1f\x8b\x08", data) if _candidate(data, m.start(), strictness)]
    if strictness != "member" or found in ([], [0]):
        return found
    begun = {m[0] for m in walk(data) if m[7] not in ("not_gzip", "trailing_bytes")}
    return [at for at in found if at in begun]


def candidates(streams: DataFrame, strictness: str = "time") -> DataFrame:
    """stream_id, start: places that look like member headers. Data may hold false ones unless strictness is "member"."""
    if strictness not in STRICTNESS:
        raise ValueError(strictness)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, start) for s, d in zip(batch["stream_id"], batch["content"]) for start in candidate_starts(d or b"", strictness)]
            yield pd.DataFrame(rows, columns=["stream_id", "start"]).astype("int64")

    return streams.select("stream_id", "content").mapInPandas(scan, "stream_id long, start long")


def likely_multi_member(streams: DataFrame) -> DataFrame:
    """stream_id, multi: a further candidate header after the first, in a stream of at least 36 bytes."""
    later = candidates(streams).where("start > 0").select("stream_id").distinct().withColumn("more", F.lit(True))
    n = F.length("content")
    return streams.select("stream_id", n.alias("n")).join(later, "stream_id", "left").select("stream_id", ((F.col("n") >= 36) & F.coalesce("more", F.lit(False))).alias("multi"))

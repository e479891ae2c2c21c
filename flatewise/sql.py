"""Functions and table functions for SQL: register(spark) makes the codec and the stream walks callable by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import codec, index, inflate_stats


class MemberIndex:
    """One row per member of a gzip stream."""

    def eval(self, content: bytes):
        for i, (start, length, head, isize, n_out, ok, indexed, error, _) in enumerate(index.walk(bytes(content or b""))):
            yield i, start, length, head, isize, n_out, ok, indexed, error


class DeflateBlocks:
    """One row per DEFLATE block of a gzip stream's members."""

    def eval(self, content: bytes):
        for member, i, bit, kind, final, n_out, _, literals, matches, match_bytes, *_rest in inflate_stats.member_blocks(bytes(content or b"")):
            yield member, i, bit, kind, final, n_out, literals, matches, match_bytes


class HeaderCandidates:
    """Places in a stream where a member's header seems to stand."""

    def eval(self, content: bytes, strictness: str):
        for start in index.candidate_starts(bytes(content or b""), strictness):
            yield (start,)


def register(spark: SparkSession) -> list[str]:
    """Register all names for the session's SQL, and give them."""
    functions = {"gzip_encode": codec.encode_single, "gzip_encode_indexed": codec.encode_indexed, "gzip_decode": index.decode_whole, "zlib_encode": codec.encode_zlib, "zlib_decode": codec.decode_zlib, "crc32_concat": codec.combined_crc32}
    tables = {
        "gzip_members": (MemberIndex, "member_idx int, start long, length long, deflate_offset int, isize long, n_out long, crc_ok boolean, indexed boolean, error string"),
        "deflate_blocks": (DeflateBlocks, "member_idx int, block_idx int, bit_offset long, btype string, final boolean, n_out long, literals long, matches long, match_bytes long"),
        "gzip_candidates": (HeaderCandidates, "start long"),
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    for name, (made, columns) in tables.items():
        spark.udtf.register(name, F.udtf(made, returnType=columns))
    return [*functions, *tables]

"""Codec and index on hand-made streams: golden patterns, sizes around block borders, damage, framing."""

import gzip
import os
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flatewise import queries
from flatewise.functions import framing
from flatewise.operators import codec, index

GOLDEN = {
    "empty": b"",
    "literals": b"a short sentence, nothing more",
    "ramp": bytes(i % 256 for i in range(10_000)),
    "short_distance": b"abc" * 8000,
    "long_distance": b"a phrase to find again " + bytes(range(1, 251)) * 200 + b"a phrase to find again ",
    "multi_block": b"twenty-two characters. " * 50_000,
    "all_bytes": bytes(range(256)) * 100,
    "max_match": b"x" * 10_000,
    "random": os.urandom(70_000),
    **{f"border_{d:+d}": b"0123456789abcdef" * 4096 + b"z" * (1 + d) if d >= 0 else (b"0123456789abcdef" * 4096)[:d] for d in (-1, 0, 1)},
    "two_blocks": b"q" * 131072,
}


@pytest.fixture(scope="module")
def streams(spark):
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(GOLDEN.values())], "stream_id long, content binary").cache()


def payloads(df):
    return {r["stream_id"]: bytes(r["payload"]) for r in df.select("stream_id", "payload").collect()}


@pytest.mark.parametrize("level", [0, 1, 6, 9, 12])
def test_every_plan_round_trips(spark, streams, level):
    packed = codec.compress(streams, level=level, threads=4).cache()
    got = payloads(packed)
    assert len(got) == len(GOLDEN)
    for i, data in enumerate(GOLDEN.values()):
        assert gzip.decompress(got[i]) == data
    back = {r["stream_id"]: r for r in index.decompress(packed.select("stream_id", F.col("payload").alias("content"))).collect()}
    assert all(bytes(back[i]["data"]) == d and back[i]["error"] is None for i, d in enumerate(GOLDEN.values()))
    assert {r["strategy"] for r in packed.collect()} >= {"INDEPENDENT" if level < 6 or level > 9 else "CHAINED"}


def test_chained_is_not_larger(spark, streams):
    size = lambda df: sum(map(len, payloads(df).values()))
    assert size(codec.compress_chained(streams, F.lit(6), F.lit(65536))) <= size(codec.compress_independent(streams, F.lit(6), F.lit(65536)))


def test_blocks_in_order(spark):
    one = spark.createDataFrame([(1, bytearray(range(100)))], "stream_id long, content binary")
    blocks = codec.split(one, F.lit(10)).orderBy("block_idx").collect()
    assert [bytes(b["data"]) for b in blocks] == [bytes(range(i, i + 10)) for i in range(0, 100, 10)]
    assert [b["is_last"] for b in blocks] == [False] * 9 + [True]


def header(flags, extra=b"", name=b"", comment=b"", crc=b""):
    return b"\x1f\x8b\x08" + bytes([flags]) + b"\0" * 6 + extra + name + comment + crc


def test_headers():
    tail = framing.plain_member(b"hello", 6)[10:]
    full = header(0x1E, struct.pack("<H", 4) + b"xy\0\0", b"name\0", b"why\0", b"\1\2") + tail
    head = framing.parse_header(full)
    assert (head.name, head.comment, head.subfields) == (b"name", b"why", ((b"xy", b""),))
    assert [m[5] for m in index.walk(full)] == [True]
    assert framing.parse_header(header(0x20)) is None and framing.parse_header(header(8, name=b"no end")) is None
    legacy = header(4, struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, 10 + 8 + len(tail) - 1)) + tail
    assert framing.parse_header(legacy).member_size == len(legacy)
    assert [m[6] for m in index.walk(legacy + legacy)] == [True, True]


def test_tiny_members_and_false_magic():
    inner = framing.plain_member(b"looks like a member", 6)
    stored = framing.PLAIN_HEADER + framing.deflate(inner, 0) + framing.trailer(zlib.crc32(inner), len(inner))
    data = codec.EMPTY_MEMBER + stored + codec.EMPTY_MEMBER
    got = list(index.walk(data))
    assert [m[4] for m in got] == [0, len(inner), 0] and all(m[5] for m in got)


@pytest.mark.parametrize(
    ("damage", "error"),
    [(lambda d: d[:-8] + bytes([d[-8] ^ 1]) + d[-7:], "crc_mismatch"), (lambda d: d[:-3], "truncated"), (lambda d: d + b"junk", "trailing_bytes"), (lambda d: b"PK\3\4" + d, "not_gzip"), (lambda d: b"", "empty"), (lambda d: d[:10] + b"\x07" + d[11:], "bad_data")],
)
def test_damage(spark, damage, error):
    bad = damage(framing.plain_member(b"some text to damage " * 50, 6))
    df = spark.createDataFrame([(7, bytearray(bad))], "stream_id long, content binary")
    got = index.tested(df).first()
    assert not got["ok"] and got["error"].startswith(error)
    if error not in ("empty",):
        with pytest.raises(Exception, match=error):
            index.decompress(df, mode="FAILFAST").collect()


def test_offsets_and_listing(spark):
    parts = [b"first" * 100, b"", b"third" * 7]
    data = b"".join(framing.indexed_member(p, 6) for p in parts)
    df = spark.createDataFrame([(1, bytearray(data))], "stream_id long, content binary")
    rows = index.with_offsets(index.members(df)).orderBy("member_idx").collect()
    assert [r["output_offset"] for r in rows] == [0, 500, 500] and [r["indexed"] for r in rows] == [True] * 3
    assert index.listing(df).first()["uncompressed"] == 535
    assert index.likely_multi_member(df).first()["multi"]
    assert index.candidates(df, "flags").count() >= index.candidates(df, "header").count() >= 3


def false_header():
    """A plain and a self-indexing member of stored data in which a whole member stands."""
    inner = framing.plain_member(b"looks like a member", 6)
    return framing.member(inner, framing.deflate(inner, 0)), framing.indexed_member(inner, 0)


def test_a_false_header_makes_no_second_member(spark):
    plain, _ = false_header()
    rows = [(1, plain), (2, plain + plain), (3, plain[:-4]), (4, b"PK" + plain), (5, b""), (6, framing.plain_member(b"x" * 99, 1))]
    got = index.routed(spark.createDataFrame([(i, bytearray(d)) for i, d in rows], "stream_id long, content binary"))
    assert {r["stream_id"]: r["strategy"] for r in got.collect()} == {1: "single", 2: "parallel_members", 3: "single", 4: "not_gzip", 5: "not_gzip", 6: "single"}


def test_false_headers_are_no_candidates_where_members_must_begin(spark, monkeypatch):
    plain, indexed = false_header()
    df = spark.createDataFrame([(1, bytearray(indexed * 3)), (2, bytearray(plain + indexed)), (3, bytearray(b"PK" + plain))], "stream_id long, content binary")
    count = lambda rows: {r["stream_id"]: r["count"] for r in rows.groupBy("stream_id").count().collect()}
    assert count(index.candidates(df, "header")) == {1: 6, 2: 4, 3: 2} and count(index.candidates(df, "member")) == {1: 3, 2: 2}
    monkeypatch.setattr(queries, "_archive", lambda *_: df)
    assert {r["stream_id"]: r["n_candidates"] for r in queries.header_candidates(spark, "").collect()} == {1: 3, 2: 2}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_crc_combine(a, b):
    assert framing.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=400), min_size=1, max_size=5), st.integers(0, 9))
def test_walk_finds_each_member(parts, level):
    data = b"".join(framing.indexed_member(p, level) if i % 2 else framing.plain_member(p, level) for i, p in enumerate(parts))
    got = list(index.walk(data))
    assert [m[3] for m in got] == [len(p) for p in parts] and sum(m[1] for m in got) == len(data)

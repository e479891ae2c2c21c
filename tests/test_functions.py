"""Planning, formats, bits, content classes and options at their borders."""

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from flatewise import queries
from flatewise.functions import bits, deflate, formats, framing, planning
from flatewise.operators import content, inflate_stats
from flatewise.operators.codec import encode_single
from flatewise.options import CodecOptions, parse_level, parse_size
from flatewise.plans import routing
from flatewise.sources import files

from .conftest import rows_of


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_routes(spark):
    cases = [((0, 6, 4), "SINGLE"), ((0, 10, 4), "EMPTY"), ((65536, 6, 4), "SINGLE"), ((65537, 6, 4), "CHAINED"), ((65537, 5, 4), "INDEPENDENT"), ((131073, 9, 2), "CHAINED"), ((131073, 1, 2), "INDEPENDENT"), ((10**6, 6, 1), "SINGLE"), ((10, 12, 1), "INDEPENDENT"), ((131073, 10, 2), "INDEPENDENT")]
    got = values(spark, routing.compress_strategy(F.col("n"), F.col("l"), F.col("t")), [c for c, _ in cases], "n long, l int, t int")
    assert got == [want for _, want in cases]


def test_block_sizes(spark):
    cases = [((1, 1, 4), 65536), ((1, 4 << 20, 4), 131072), ((2, 1 << 30, 4), 262144), ((6, 10, 1), 65536), ((9, 10, 1), 131072), ((12, 10, 1), 524288), ((0, 65537 * 32, 4), 131072)]
    assert values(spark, planning.independent_block_size(F.col("l"), F.col("n"), F.col("t")), [c for c, _ in cases], "l int, n long, t int") == [w for _, w in cases]


def test_sizes_and_shares(spark):
    assert values(spark, planning.size_text(F.col("n")), [(0,), (1023,), (1024,), (1536,), (5 << 20,), (3 << 40,)], "n long") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 TB"]
    assert values(spark, planning.percentage(F.col("a"), F.col("b")), [(1, 4), (1, 0)], "a int, b int") == ["25.0%", "N/A"]


def test_names(spark):
    rows = [("a.txt", False), ("a", False), ("a.txt", True), ("x.tar.xz", True), ("d.e/plain", True)]
    assert values(spark, formats.compressed_name(F.col("p"), F.col("f"), F.lit(".gz")), rows, "p string, f boolean") == ["a.txt.gz", "a.gz", "a.gz", "x.gz", "d.e/plain.gz"]
    assert values(spark, formats.decompressed_name(F.col("p"), F.lit(False)), [("a.gz",), ("a.bin",), ("A.GZ",)], "p string") == ["a", "a.bin.out", "A"]


def test_bits(spark):
    rows = [(0b0000000000100,), (0b0000000000101,), (0b1111000000100,), (0b0000011110100,), (0b1110111101100,)]
    assert values(spark, bits.is_deflate_candidate(F.col("b")), rows, "b int") == [True, False, False, False, True]
    assert values(spark, bits.reverse_bits(F.col("b"), 5), [(1,), (0b10110,)], "b int") == [16, 0b01101]
    assert values(spark, bits.valid_precode(F.col("n"), strict=True), [([1, 1],), ([1],), ([2, 2],), ([7],), ([1, 1, 1],)], "n array<int>") == [True, True, True, False, False]


@pytest.mark.parametrize(("data", "kind", "random"), [(b"", "Binary", False), (b"\0" * 100, "Binary", False), (b"plain text\n" * 9, "Text", False), (bytes(range(256)) * 32, "Binary", True)])
def test_content(data, kind, random):
    got = content.sample_stats(data)
    assert (got[4], got[3]) == (kind, random)


def test_random_bytes_spread():
    assert content.sample_stats(os.urandom(8192))[3]


def test_block_walk_matches_zlib(spark):
    texts = [b"", b"a" * 5000, os.urandom(3000), b"the cat sat on the mat. " * 400]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "stream_id long, content binary")
    for level in (0, 6):
        found = inflate_stats.blocks(df.select("stream_id", encode_single("content", F.lit(level)).alias("content")))
        assert {r["stream_id"]: r["n"] for r in found.groupBy("stream_id").agg(F.sum("n_out").alias("n")).collect()} == {i: len(t) for i, t in enumerate(texts)}


def test_candidates_hold_true_blocks(spark):
    text = " ".join(f"word{i % 97}x{i * 31 % 1009}" for i in range(40_000)).encode()
    df = spark.createDataFrame([(1, bytearray(text))], "stream_id long, content binary").select("stream_id", encode_single("content", F.lit(6)).alias("content"))
    true = {r["bit_offset"] + 80 for r in inflate_stats.blocks(df).where("btype = 'dynamic' and not final").collect()}
    got = {r["bit_offset"] for r in inflate_stats.block_candidates(df).collect()}
    assert true and true <= got
    assert inflate_stats.block_candidates(df, limit=3).count() == 3


def test_options():
    got = CodecOptions.from_args(["-kp4", "-9", "--suffix=.z", "--", "-f"], {"GZIP": "-c 'a b'", "PIGZ": "-q"})
    assert (got.keep, got.threads, got.level, got.suffix, got.stdout, got.quiet, got.files) == (True, 4, 9, ".z", True, True, ("a b", "-f"))
    assert CodecOptions.from_args(["-11"], {}).effective_level == 9 and CodecOptions.from_args(["--blocksize", "128k"], {}).block_size == 131072
    for bad in ("13", "x", ""):
        with pytest.raises(ValueError):
            parse_level(bad)
    for bad in ("", "1", "k", "1023"):
        with pytest.raises(ValueError):
            parse_size(bad)
    with pytest.raises(ValueError):
        CodecOptions.from_args(["-y"], {})


def test_synthetic_sources(spark):
    sizes = [0, 1, 44, 1000]
    assert [len(r["content"]) for r in files.sized_text(spark, sizes).orderBy("stream_id").collect()] == sizes
    assert files.synthetic_logs(spark, 10).count() == 10


def test_blocks_of_all_members_and_before_damage(spark):
    import zlib

    def body(n):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        return b"".join(c.compress(bytes([i]) * 40) + c.flush(zlib.Z_SYNC_FLUSH) for i in range(n)) + c.flush()

    member = lambda n: framing.PLAIN_HEADER + body(n) + b"12345678"
    rows = [(1, member(3) + member(2)), (2, member(4)[:-20]), (3, b""), (4, None), (5, member(1) + b"rest"), (6, framing.PLAIN_HEADER + b"\x00\x05\x00\xfa\xffabcde\x00\x05\x00\xfa\xfeabcde")]
    found = inflate_stats.blocks(spark.createDataFrame(rows, "stream_id long, content binary"))
    got = {(r["stream_id"], r["member_idx"]): (r["n"], r["out"]) for r in found.groupBy("stream_id", "member_idx").agg(F.sum("n_out").alias("out"), F.count_if(F.col("n_out") > 0).alias("n")).collect()}
    assert {k: v for k, v in got.items() if k[0] != 2} == {(1, 0): (3, 120), (1, 1): (2, 80), (5, 0): (1, 40), (6, 0): (1, 5)}
    assert 1 <= got[2, 0][0] <= 4
    assert inflate_stats.blocks(spark.createDataFrame(rows, "stream_id long, content binary"), first_only=True).groupBy("stream_id").count().where("stream_id = 1").first()["count"] == 1


def test_literals_are_read_several_at_once(monkeypatch):
    """A walk over blocks looks up few single symbols where literals follow each other, and builds a code once."""
    single, built = deflate.Code.next, deflate.Code.__init__
    calls = {"next": 0, "built": 0}

    def counted(name, f):
        def run(*args):
            calls[name] += 1
            return f(*args)

        return run

    monkeypatch.setattr(deflate.Code, "next", counted("next", single))
    monkeypatch.setattr(deflate.Code, "__init__", counted("built", built))
    deflate._code.cache_clear()
    data = (b"abcdef" * 700)[:4096]
    body = framing.strategy_deflate(data, 1, zlib.Z_HUFFMAN_ONLY)
    for _ in range(5):
        (block,) = deflate.blocks(body)
        assert (block.literals, block.matches, block.n_out) == (4096, 0, 4096)
    assert calls["next"] < 5 * 4096 / 5 and calls["built"] <= 2 + 5  # a precode each time
    with pytest.raises(EOFError):
        list(deflate.blocks(body[:-3]))


@pytest.mark.parametrize("strategy", [zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED, zlib.Z_RLE])
def test_strategies_that_code_store_no_block(strategy):
    """Bytes that coding doesn't shrink, alone and between blocks that it does; zlib alone would store them."""
    r = random.Random(4)
    hard, easy = r.randbytes(40_000), b"the cat sat on the mat. " * 2000
    for data in (b"", b"a", hard[:30], hard, easy, easy + hard + easy, hard + easy, "ÿþýüûúùøö".encode() * 6):
        body = framing.strategy_deflate(data, 1, strategy)
        found = list(deflate.blocks(body))
        assert zlib.decompress(body, -15) == data and [b.final for b in found] == [False] * (len(found) - 1) + [True]
        assert {b.kind for b in found} <= {"fixed", "dynamic"} and (found[-1].end + 7) // 8 == len(body)
        assert strategy != zlib.Z_HUFFMAN_ONLY or sum(b.literals for b in found) == len(data)
    assert {b.kind for b in deflate.blocks(framing.strategy_deflate(hard, 0, strategy))} == {"stored"}


def unfriendly(spark, folder):
    """documents whose texts zlib would rather store: letters that are no ASCII, without an order."""
    r = random.Random(8)
    texts = ["", None, "plain words " * 40, *["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(n)) for n in (20, 200, 20_000)], "word " * 9000 + "".join(chr(r.randrange(0x80, 0x7FF)) for _ in range(30_000))]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["decode_trace", "first_coded_blocks"])
def test_texts_that_coding_does_not_shrink_agree_with_sql(spark, tmp_path, name):
    import duckdb

    folder = unfriendly(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    got, want = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLE_SQL[name])
    assert rows_of(got.columns, [tuple(x) for x in got.collect()]) == rows_of(want.columns, want.fetchall())

"""Files as they arrive, and chunks decoded with state."""

import gzip
import os

from flatewise.functions import framing
from flatewise.operators import codec  # noqa: F401 - the encoder used below lives there
from flatewise.sources import files
from flatewise.streaming import pipe


def chained(blocks):
    body, before, whole = b"", b"", b"".join(blocks)
    for i, b in enumerate(blocks):
        body += framing.deflate(b, 6, before[-32768:], i == len(blocks) - 1)
        before += b
    import zlib

    return framing.PLAIN_HEADER + body + framing.trailer(zlib.crc32(whole), len(whole))


def test_arriving_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_bytes(os.urandom(100 + i))
    out = tmp_path / "out"
    q = pipe.compressed(pipe.arriving_files(spark, str(tmp_path / "*.txt"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out))
    q.awaitTermination()
    got = {r["path"].rsplit("/", 1)[-1]: gzip.decompress(bytes(r["payload"])) for r in spark.read.parquet(str(out)).collect()}
    assert got == {f"{i}.txt": (tmp_path / f"{i}.txt").read_bytes() for i in range(3)}


def streamed(spark, tmp_path, name, batches):
    """Rows of decoded() where each batch of (stream_id, chunk, content) arrives by itself."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(s, c, bytearray(b)) for s, c, b in rows], "stream_id long, chunk long, content binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    source = spark.readStream.schema("stream_id long, chunk long, content binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = pipe.decoded(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    return sorted(spark.sql(f"select * from {name}").collect(), key=lambda r: (r["stream_id"], r["chunk"]))


def test_resumed_decoding(spark, tmp_path):
    """Members with and without flush points, chunks that split trailers, and chunks that arrive out of order."""
    blocks = [os.urandom(3000), b"text and text again " * 400, bytes(5000), b"end"]
    data = chained(blocks) + gzip.compress(b"second " * 999)
    whole = b"".join(blocks) + b"second " * 999
    size = len(data) // 7 - 3
    chunks = [(1, i, data[a : a + size]) for i, a in enumerate(range(0, len(data), size))]
    small = [(2, i, gzip.compress(b"xy")[i : i + 1]) for i in range(len(gzip.compress(b"xy")))]
    assert len(chunks) >= 7
    got = streamed(spark, tmp_path, "decoded", [[chunks[2], *small[5:]], [chunks[0]], [chunks[1], chunks[4], *small[:5]], chunks[3:4] + chunks[5:]])
    ones, twos = ([r for r in got if r["stream_id"] == s] for s in (1, 2))
    assert [r["chunk"] for r in ones] == list(range(len(chunks))) and b"".join(bytes(r["data"]) for r in ones) == whole
    assert ones[-1]["finished"] and ones[-1]["members"] == 2 and not any(r["error"] or r["finished"] for r in ones[:-1])
    assert b"".join(bytes(r["data"]) for r in twos) == b"xy" and twos[-1]["finished"]


def test_damage_in_a_stream(spark, tmp_path):
    data = bytearray(gzip.compress(b"some text " * 50))
    data[-8] ^= 1
    rows = streamed(spark, tmp_path, "damaged", [[(1, 0, data[:20])], [(1, 0, data[:20]), (1, 1, data[20:])], [(1, 2, b"more")]])
    assert [(r["chunk"], r["error"]) for r in rows if r["error"] != "repeated_chunk"] == [(0, None), (1, "crc_mismatch"), (2, "crc_mismatch")]
    assert sum(r["error"] == "repeated_chunk" for r in rows) == 1 and not any(r["finished"] for r in rows)


def test_files_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.gz").write_bytes(gzip.compress(b"x"))
    (tmp_path / "b.zz").write_bytes(b"\x78\x9cnot really")
    got = {r["path"].rsplit("/", 1)[-1]: r["format"] for r in files.files(spark, str(tmp_path), recursive=True).collect()}
    assert got == {"a.gz": "gzip", "b.zz": "zlib"}
    assert files.files(spark, str(tmp_path), recursive=True, pattern="*.gz").count() == 1
    assert bytes(files.bytes_source(spark, b"abc").first()["content"]) == b"abc"

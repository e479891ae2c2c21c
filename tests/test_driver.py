"""Files worked on as the command line does, table functions in SQL, data generators, and streams cut at candidates."""

import gzip
import io
import os
import random
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from flatewise import sql
from flatewise.operators import codec, index
from flatewise.options import CodecOptions
from flatewise.sources import driver, files


def by_name(done, root):
    return {r["path"].split(f"{root.name}/", 1)[1]: r for r in done.collect()}


@pytest.mark.parametrize("args", [["-6", "-p4"], ["-1", "-p4"], ["-9", "-p1"], ["-3", "-p4", "-b", "70k"]])
def test_there_and_back(spark, tmp_path, args):
    r = random.Random(1)
    made = {"a.txt": b"some text " * 40_000, "d/b": r.randbytes(300_000), "d/e/empty": b"", "d/c.tar": b"x"}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    done = driver.run(spark, CodecOptions.from_args([*args, "-r", str(tmp_path)], {}))
    got = by_name(done, tmp_path)
    assert driver.exit_code(done) == 0 and set(got) == set(made) and all(r["n_in"] == len(made[k]) for k, r in got.items())
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == sorted(f"{k}.gz" for k in made)
    assert all(gzip.decompress((tmp_path / f"{k}.gz").read_bytes()) == v for k, v in made.items())
    back = driver.run(spark, CodecOptions.from_args(["-d", "-k", "-r", str(tmp_path)], {}))
    assert driver.exit_code(back) == 0 and all((tmp_path / k).read_bytes() == v and (tmp_path / f"{k}.gz").exists() for k, v in made.items())


def test_refusals_and_failures(spark, tmp_path):
    good = gzip.compress(b"good" * 100)
    for name, data in {"a.gz": good, "b.gz": good[:-6], "c.gz": b"none", "e.gz": good + gzip.compress(b"more"), "e": b"old", "f.zz": zlib.compress(b"z" * 99), "g.zip": b"PK\x03\x04"}.items():
        (tmp_path / name).write_bytes(data)
    done = driver.run(spark, CodecOptions.from_args(["-d", str(tmp_path / "*.*")], {}))
    errors = {k: r["error"] for k, r in by_name(done, tmp_path).items()}
    assert errors == {"a.gz": None, "b.gz": "truncated", "c.gz": "not_gzip", "e.gz": "exists", "f.zz": None, "g.zip": "zip_not_supported"}
    assert driver.exit_code(done) == 1 and (tmp_path / "a").read_bytes() == b"good" * 100 and (tmp_path / "f").read_bytes() == b"z" * 99 and (tmp_path / "e").read_bytes() == b"old"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b.gz", "c.gz", "e", "e.gz", "f", "g.zip"]
    forced = driver.run(spark, CodecOptions.from_args(["-d", "-f", "-k", str(tmp_path / "e.gz")], {}))
    assert driver.exit_code(forced) == 0 and (tmp_path / "e").read_bytes() == b"good" * 100 + b"more"
    again = driver.run(spark, CodecOptions.from_args(["-k", str(tmp_path / "e.gz")], {}))
    assert again.first()["error"] == "has_suffix"
    zz = driver.run(spark, CodecOptions.from_args(["-z", "-k", "-S", ".zz", str(tmp_path / "e")], {}))
    assert zlib.decompress((tmp_path / "e.zz").read_bytes()) == (tmp_path / "e").read_bytes() and driver.exit_code(zz) == 0


def test_table_functions(spark):
    names = sql.register(spark)
    assert "gzip_members" in names
    spark.createDataFrame([(1, bytearray(gzip.compress(b"a" * 9) + gzip.compress(b"bc"))), (2, bytearray(b"no"))], "id long, content binary").createOrReplaceTempView("streams")
    rows = spark.sql("select id, m.member_idx, m.n_out, m.error from streams, lateral gzip_members(content) m order by 1, 2").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 9, None), (1, 1, 2, None), (2, 0, 0, "not_gzip")]
    rows = spark.sql("select id, count(*) n, sum(b.n_out) bytes from streams, lateral deflate_blocks(content) b group by id").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 11)]
    assert spark.sql("select c.start from streams, lateral gzip_candidates(content, 'header') c order by 1").first()["start"] == 0
    row = spark.sql("select gzip_decode(gzip_encode(cast('text' as binary), 6)).data d, zlib_decode(zlib_encode(cast('x' as binary), 1)).data z").first()
    assert bytes(row["d"]) == b"text" and bytes(row["z"]) == b"x"
    assert spark.sql("select crc32_concat(p, crc32(v), length(v)) = crc32('abcd') same from values (1, 'cd'), (0, 'ab') t(p, v)").first()["same"]


def test_streams_cut_at_candidates(spark):
    r = random.Random(2)
    plain = lambda d: gzip.compress(d)
    inner = gzip.compress(b"hidden", 0)
    stored = gzip.compress(inner * 3, 0)  # false candidates inside stored data
    rows = [(1, b"".join(plain(r.randbytes(500)) for _ in range(9))), (2, stored + plain(b"x")), (3, plain(b"a") + plain(b"b")[:-3]), (4, b""), (5, b"zz"), (6, plain(b"one")), (7, plain(b"a") + b"rest")]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in rows], "stream_id long, content binary")
    got = {x["stream_id"]: (bytes(x["data"]), x["error"]) for x in index.decompress_candidates(df).collect()}
    want = {x["stream_id"]: (bytes(x["data"]), x["error"]) for x in index.decompress(df).collect()}
    assert got == want and got[2][0] == inner * 3 + b"x"


def test_archives_are_archives(spark):
    rows = files.software_archive(spark, 7).withColumn("one", F.lit(1))
    data = bytes(files.tarball(rows, "path", "content", "one").first()["content"])
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        got = {m.name: t.extractfile(m).read() for m in t.getmembers()}
    assert got == {r["path"]: bytes(r["content"]) for r in rows.collect()} and len(got) == 7


def test_generators(spark):
    sizes = [0, 1, 31, 32, 33, 5000]
    for made in (files.random_bytes, files.binary_records, files.sized_text):
        assert [len(r["content"]) for r in made(spark, sizes).orderBy("stream_id").collect()] == sizes
    noise = bytes(files.random_bytes(spark, [50_000]).first()["content"])
    assert len(zlib.compress(noise)) > 49_000
    lines = [r["text"] for r in files.guard_data(spark, 50).collect()]
    assert len(set(lines)) == 50 and all(len(x) == 100 and set(x) <= set("abcdefghij") for x in lines)
    assert {r["name"] for r in files.datasets(spark).collect()} == {"text", "random", "binary", "software", "logs"}


def test_parts_are_never_one_row(spark):
    df = spark.createDataFrame([(1, bytearray(os.urandom(2_000_000)))], "stream_id long, content binary")
    parts = codec.compressed_parts(df, level=6, threads=4)
    assert parts.count() > 10 and parts.agg(F.max(F.length("payload"))).first()[0] < 300_000

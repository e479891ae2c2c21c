"""Each stage on what its predecessor kept, held against the operators' brute-force versions."""

import re

import corpus_pipeline as C
from . import brute
from ..conftest import SF
from .test_models import verify


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    from tokenizers import Tokenizer

    from flatewise.llm import packing
    from flatewise.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(C.STAGES)
    assert list(stages) == ["language", "near_dup", "decontaminate", "pii", "pack"]
    before = rows(docs)
    spoken = stored(stages["language"](spark, docs, SF))
    assert spoken.columns == docs.columns and len(rows(spoken)) >= 0.99 * len(before)

    before = rows(spoken)
    unique = stored(stages["near_dup"](spark, spoken, SF))
    want = {c for _, c in brute.components([(d, r["text"]) for d, r in before.items()]).values()}
    assert set(rows(unique)) == want and unique.columns == docs.columns

    before = rows(unique)
    clean = stored(stages["decontaminate"](spark, unique, SF))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, _, n, *_ in brute.contamination([(d, r["text"]) for d, r in before.items()], items) if n}
    assert dirty and set(rows(clean)) == set(before) - dirty

    before = rows(clean)
    safe = stored(stages["pii"](spark, clean, SF))
    after = rows(safe)
    assert set(after) == set(before) and safe.columns == docs.columns
    for d, r in after.items():
        found = brute.pii(before[d]["text"])
        assert (r["text"] == before[d]["text"]) or any(found.values()) or re.search("<(iban|ssn)>", r["text"])
        assert len(r["text"]) == r["n_chars"] and not any(brute.pii(r["text"]).values())

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    verify(tokenizer, [(d, r["text"]) for d, r in after.items()], stages["pack"](spark, safe, SF).collect())


def words(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def keys(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_rows_without_id_and_with_repeated_ids(spark, tmp_path):
    near = words("a", 59) + " z"
    rows = [(1, words("a")), (None, words("a")), (None, near), (2, words("b")), (2, words("b")), (3, words("c")), (3, near), (None, words("d")), (None, words("d")), (None, words("e")), (4, words("f")), (4, words("f").upper())]
    got = keys(C.drop_near_duplicates(spark, frame(spark, rows), SF))
    f = [x for x in got if x[0] == 4]
    assert len(f) == 1 and f[0] in rows
    assert sorted(set(got) - set(f), key=str) == sorted([(1, words("a")), (2, words("b")), (3, words("c")), (None, words("d")), (None, words("e"))], key=str) and len(got) == 6

    spark.createDataFrame([(1, words("q", 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(8, "x " + words("q", 12)), (8, words("c")), (None, words("q", 12)), (None, words("d")), (9, words("e"))]
    assert keys(C.drop_contaminated(spark, frame(spark, rows), str(tmp_path))) == sorted([(8, words("c")), (None, words("d")), (9, words("e"))], key=str)


def test_sets_of_one_id_are_told_apart(spark):
    from flatewise.llm import near_dup

    got = near_dup.digest(frame(spark, [(5, words("g")), (5, words("h", 50)), (4, words("g", 59) + " z"), (6, words("h", 49) + " z")])).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(5, 59, 4, False), (5, 49, 5, True), (4, 59, 4, True), (6, 49, 5, False)}


def test_run(spark):
    assert C.run(spark, SF).count() > 100


def test_keys_are_broadcast_by_what_their_hash_table_takes(spark, no_broadcasts, monkeypatch):
    """A broadcast row of two longs takes over 100 bytes of the driver, not 24."""
    docs = frame(spark, [(i, f"text {i}") for i in range(400)])
    gone = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "xxhash64(text) AS text_key")
    for limit, hinted in ((100, False), (200, True)):
        monkeypatch.setattr("flatewise.llm.common.BROADCAST_BYTES", 200 * limit)
        left = C.without(docs, gone)
        assert ("Broadcast" in left._jdf.queryExecution().executedPlan().toString()) == hinted
        assert keys(left) == sorted([(i, f"text {i}") for i in range(1, 400, 2)], key=str)


def test_stages_broadcast_nothing_by_sparks_own_estimate(spark, monkeypatch):
    """Whatever Spark takes a side for, as after an explode: what was not counted is joined by shuffle."""
    from flatewise.llm import decontaminate

    stored, plans = decontaminate.stored, []

    def seen(df):
        plans.append(df)
        return stored(df)

    monkeypatch.setattr("flatewise.llm.common.BROADCAST_BYTES", -1)
    for module in ("flatewise.llm.near_dup", "flatewise.llm.components", "flatewise.llm.decontaminate", "corpus_pipeline"):
        monkeypatch.setattr(f"{module}.stored", seen)
    docs = frame(spark, [(i, f"text {i // 2} " + "a b c d e f g h i j k l " * (1 + i % 3)) for i in range(60)])
    for stage in (C.drop_near_duplicates, C.drop_contaminated):
        left = stage(spark, docs, SF)
        assert 0 < left.count() <= 60
        plans.append(left)
    assert not any("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in plans)

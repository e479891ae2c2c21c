"""Near duplicates, contamination and top-k against brute force."""

import random
import time

import numpy as np
import pytest

from flatewise.llm import decontaminate, near_dup, topk
from flatewise.llm.components import components

from . import brute
from ..conftest import SF


def check_classes(spark, rows):
    got = near_dup.digest(spark.createDataFrame(rows, "doc_id long, text string, n long" if len(rows[0]) > 2 else "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components([r[:2] for r in rows])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def near_copies(n, seed=1):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(r.randrange(12)):
            copy[r.randrange(len(copy))] = f"m{r.randrange(10**6)}"
        out.append((i * 3, " ".join(copy)))
    return out


def test_classes_of_the_table(spark):
    check_classes(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_one_large_group(spark, monkeypatch):
    """A group of near copies of which some are linked with few others; blocks far smaller than the group."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    check_classes(spark, near_copies(150) + [(10_000 + i, f"alone {i} and so on {i * 7} {i * 13}") for i in range(20)])


@pytest.mark.parametrize("block", [8, 512])
def test_groups_across_bands_of_size(spark, monkeypatch, block):
    """Chains of ever shorter copies, all by blocks: links lie within bands of size and between neighbouring ones."""
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    r = random.Random(6)
    rows, at = [], 0
    for chain in range(3):
        base = [f"c{chain}w{i}" for i in range(150)]
        for n in sorted(r.sample(range(8, 150), 40)):
            rows.append((at, " ".join(base[:n] + [f"x{at}"] * r.randrange(2))))
            at += 1
    r.shuffle(rows)
    check_classes(spark, rows)


def test_class_edges(spark):
    rows = [(1, "a b c d"), (2, "A B  C\td"), (3, None), (4, ""), (5, "one"), (6, "one "), (None, "a b c d"), (7, "é é"), (7, "é é"), (0, "zz"), (8, "x y")]
    got = {(r["doc_id"], r["component_id"], r["n_shingles"], r["kept"]) for r in near_dup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 3, True), (2, 1, 3, False), (3, 3, 0, True), (4, 4, 0, True), (5, 5, 1, True), (6, 5, 1, False), (None, None, 3, True), (7, 7, 1, True), (0, 0, 1, True), (8, 8, 1, True)}
    assert near_dup.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_classes_are_broadcast_by_what_their_hash_table_takes(spark, no_broadcasts, monkeypatch):
    """Sets that are read again, and first documents of classes: over 100 bytes of the driver a row, not 32 or 48."""
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30 + i % 2))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = docs.selectExpr("doc_id AS node", "struct(false AS unnamed, doc_id, xxhash64(text) AS text_key) AS first")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for limit, hinted in ((100, False), (200, True)):
        monkeypatch.setattr("flatewise.llm.common.BROADCAST_BYTES", 400 * limit)
        sets = near_dup.sets_of(docs, nodes)
        assert ("Broadcast" in plan(sets)) == hinted
        assert {r["node"]: len(r["shingles"]) for r in sets.collect()} == {i: 29 + i % 2 for i in range(400)}
        monkeypatch.setattr("flatewise.llm.common.BROADCAST_BYTES", 200 * limit)
        got = near_dup.digest(docs)
        assert ("Broadcast" in plan(got)) == hinted
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i - i % 2 for i in range(400)}


def test_nothing_is_broadcast_by_sparks_own_estimate(spark, monkeypatch):
    """Table keys are 55 rows a set, which Spark takes for one; every join is by shuffle unless its side was counted."""
    stored, plans = near_dup.stored, []

    def seen(df):
        plans.append(df)
        return stored(df)

    monkeypatch.setattr("flatewise.llm.common.BROADCAST_BYTES", -1)
    monkeypatch.setattr(near_dup, "stored", seen)
    monkeypatch.setattr("flatewise.llm.components.stored", seen)
    rows = near_copies(60)
    got = near_dup.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute.components(rows)
    joins = [df._jdf.queryExecution().executedPlan().toString() for df in [*plans, got]]
    assert sum("SortMergeJoin" in p for p in joins) > 5 and not any("Broadcast" in p for p in joins)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(30)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in root.items() if any(n in e and e[0] != e[1] for e in edges)}


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "the the"), (3, ""), (None, "x y z"), (4, None), (5, "one"), (6, "a a a a a a a a a a a a"), (6, "Q r")]
DOCS = [(1, "...A b c d e f g h i j, k m one. "), (2, None), (3, "x the THE the q r"), (None, "one"), (None, "one"), (4, "a " * 30), (5, "b c d e f g h i j k l"), (5, "nothing"), (7, "é one"), (8, "---")]


def contaminated(spark, docs, items):
    key = lambda r: str(r)
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(*tables).collect()
    have = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=key)
    assert have == sorted(brute.contamination(docs, items), key=key)


def near_counts(spark, docs, items):
    contaminated(spark, docs, items)
    rows = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return [(r["doc_id"], r["n_near"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_contamination(spark):
    contaminated(spark, DOCS, ITEMS)
    contaminated(spark, DOCS, [])
    contaminated(spark, [], ITEMS)
    table = lambda t, i: [(r[i], r["text"]) for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()]
    contaminated(spark, table("documents", "doc_id"), table("benchmark", "item_id"))


def test_contamination_without_broadcasts(spark, no_broadcasts):
    contaminated(spark, DOCS, ITEMS)
    df = decontaminate.digest(spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_proximity(spark):
    item = [(1, "aa bb cc dd ee ff gg hh ii jj kk"), (2, "x y z")]
    docs = [(1, "aa bb cc XX ee ff gg hh ii jj"), (2, "aa bb XX YY ZZ ff gg hh ii jj"), (3, "aa XX cc dd ee ff gg hh YY jj kk"), (4, "bb cc dd ee ff gg hh ii jj kk"), (5, None), (6, "cc dd ee ff gg hh ii jj kk " * 3)]
    got = near_counts(spark, docs, item)
    assert got == brute.near_windows(docs, item) and any(n for _, n in got)


def test_proximity_at_random(spark):
    r = random.Random(8)
    text = lambda n, of="abcdefgh": " ".join(r.choice(of) for _ in range(n))
    items = [(i, text(r.randrange(8, 30))) for i in range(6)]
    changed = lambda t: " ".join(r.choice("abcdefgh") if r.random() < 0.12 else w for w in t.split())
    docs = [(i, f"{text(r.randrange(0, 20))} {changed(items[i % 6][1])} {text(5)}") for i in range(24)]
    assert near_counts(spark, docs, items) == brute.near_windows(docs, items)


def test_contamination_of_long_texts(spark):
    """One text of one word, and an item that is as long as its document: time grows with their length, not its square."""
    took = []
    for n in (30_000, 60_000):
        docs = [(1, "the " * n), (2, " ".join(f"w{i}" for i in range(n))), (3, "a w7 w8 the")]
        began = time.monotonic()
        rows = decontaminate.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "the"), (2, docs[1][1])], "item_id long, text string")).collect()
        took.append(time.monotonic() - began)
        assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in rows} == {1: (n, 1), 2: (n, 1), 3: (1, 1)}
    assert took[1] < 2.6 * took[0] + 4


def test_contamination_of_other_columns(spark):
    docs = spark.createDataFrame([(1, "one", "x", 2, 3), (1, "one", "y", 2, 3)], "doc_id long, text string, item string, term int, position int")
    items = spark.createDataFrame([("5", "one", 1, "z")], "item_id string, text string, doc_id int, word string")
    assert [(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.digest(docs, items).collect()] == [(1, 1, 1)] * 2


@pytest.mark.parametrize(("block", "queries"), [(7, 2), (8192, 1024)])
def test_top_k_in_a_grid(spark, monkeypatch, no_broadcasts, block, queries):
    monkeypatch.setattr(topk, "QUERY_BLOCK", queries)
    test_top_k(spark, monkeypatch, block)


def test_top_k_of_other_columns_and_ties(spark):
    rows = [(i, [1.0, 0.0], 5, 6) for i in range(0, 40)] + [(200, [1.0, 0.0], 5, 6)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int, dim int")).collect()
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == {(0, i): i for i in range(1, 11)} | {(200, i): i - 1 for i in range(1, 11)}
    wide = topk.top_k(spark.createDataFrame([(0, [0.5] * 20_000), (1, [0.25] * 20_000)], "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["score"]) for r in wide] == [(1, 512 * 256 * 20_000)]


@pytest.mark.parametrize("block", [7, 8192])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    r = np.random.default_rng(0)
    vectors = r.normal(size=(300, 8)).astype("float32").tolist()
    vectors[100] = vectors[200] = [0.0] * 8
    rows = [(i, v) for i, v in enumerate(vectors)] + [(301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (400, [5.0] * 3), (5, vectors[5]), (600, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    x = np.floor(1024 * np.array(vectors + [vectors[5]], dtype="float32").astype("float64")).astype("int64")
    ids = np.array([*range(300), 5])
    have = {(g["query_id"], g["rank"]): (g["vec_id"], g["score"]) for g in got}
    for q in (0, 100, 200):
        score = x @ x[q]
        best = [j for j in np.lexsort((ids, -score)) if j != q][:10]
        assert [have[q, k + 1] for k in range(10)] == [(ids[j], score[j]) for j in best]
    assert {g["query_id"] for g in got} == {0, 100, 200}
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []

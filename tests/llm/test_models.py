"""Packing, language and toxicity: exact round trips, held-out accuracy, and defined results at the edges."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flatewise.llm import common, langid, packing, toxicity
from ..conftest import SF


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def verify(tokenizer, docs, rows):
    """Each id of each document lies in one piece, sequences are gapless and not too long; returns the padding's share."""
    want, have, places = Counter(), Counter(), defaultdict(list)
    for d, t in docs:
        ids = ids_of(tokenizer, t)
        want[d] += len(ids)
    texts = defaultdict(list)
    for d, t in docs:
        texts[d].append(ids_of(tokenizer, t))
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in texts[r["doc_id"]])
        have[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for d, x in texts.items():
        if len(x) == 1:
            at = 0
            for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    padding = 0
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding / max(1, sum(want.values()))


PACKED = [(1, "a b c"), (1, "d e " * 900), (2, None), (3, ""), (None, "x " * 1500), (None, "x " * 1500), (4, "hello " * 1500), (4, "hello " * 1500), (5, "it's 100 " * 700), (6, "é" * 4000), (7, "<|endoftext|> \x85 é")]


def test_packing_edges(spark, tokenizer):
    rows = packing.pack(spark.createDataFrame(PACKED, "doc_id long, text string")).collect()
    verify(tokenizer, PACKED, rows)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing_of_one_length(spark, tokenizer):
    """No multiset of the one length fills a window: the tail is cut instead."""
    docs = [(i, "hello " * 1500) for i in range(300)]
    assert verify(tokenizer, docs, packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()) < 0.01


def test_packing_of_the_table(spark, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert verify(tokenizer, docs, rows) < 0.02


def test_chunk_tokenizer(tokenizer):
    odd = ["a b c", "it's don't I'LL\tX", "<|endoftext|> x", "é a ́b", "\x1ca\x85b", "ﬁ İstanbul ẞ 日本 語 ٣", "", "œuvre ŉ ſ", "a​b", "x\x0by"]
    got = packing.document_ids(packing.default_vocabulary(), odd)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(tokenizer, t).tolist() for t in odd]


def test_least_slack_is_least():
    r = random.Random(2)
    for _ in range(200):
        counts = Counter(r.randrange(3, 40) for _ in range(r.randrange(1, 9)))
        room = r.randrange(1, 90)
        sums = {0}
        for x, n in counts.items():
            for _ in range(n):
                sums |= {s + x for s in sums}
        taken = packing.least_slack(dict(counts), room)
        assert all(counts[x] >= n for x, n in taken.items()) and sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= room)


def test_plan_places_all():
    counts = {7: 100, 30: 11, 63: 40, 64: 3, 50: 1}
    uses, tails, first = packing.plan(counts, 64, 2)
    taken = Counter()
    for u in uses:
        taken[u.length] += u.rank_to - u.rank_from
        assert (u.rank_to - u.rank_from) % u.each == 0
    for t in tails:
        taken[t.length] += t.rank_to - t.rank_from
    assert taken == counts and first == len({u.first + i for u in uses for i in range((u.rank_to - u.rank_from) // u.each)})


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.digest(docs).collect()}
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] == (r in held) for r in rows)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in got.values()) <= 0.005 * len(got) and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(spark):
    texts = ["the cat and the dog", "le chat et le chien", "the house and the tree", "la maison et le arbre"] * 5
    rows = [(i, t, "en" if "the" in t else "fr") for i, t in enumerate(texts)] + [(100, None, "en"), (101, "123 !!", "fr"), (102, "", None), (None, "the end", "fr"), (103, "et le chat", None)]
    got = [tuple(r)[:4:2] for r in langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    assert dict(got)[100] == dict(got)[101] == dict(got)[102] == "und" and dict(got)[103] == "fr" and dict(got)[None] == "en"
    nothing = langid.digest(spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")).first()
    assert (nothing["lang_pred"], nothing["score"]) == ("und", 0.0)
    assert langid.digest(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def toxic_rows(n=900):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "er", "th", "in", "on", "re", "ou", "sh"]) for _ in range(r.randrange(1, 5)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(20, 120))]
        if i % 4 == 0:
            for _ in range(max(1, len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(["wretch", "villain", "grotesque"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return rows


def test_toxicity_of_planted_words(spark):
    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.digest(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["predicted"] for i, y in held if y]) >= 0.9 and np.mean([got[i]["predicted"] for i, y in held if not y]) <= 0.03
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_held_out(spark):
    """Held-out documents of sf0.1, by language: none of the four is left out."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = {r["doc_id"]: r for r in toxicity.digest(some, labels).collect()}
    seen = defaultdict(lambda: [0, 0, 0, 0])
    for r in docs.join(labels, "doc_id").select("doc_id", "lang", "toxic").collect():
        if got[r["doc_id"]]["held_out"]:
            for of in (seen[r["lang"]], seen["all"]):
                of[2 * r["toxic"]] += 1
                of[2 * r["toxic"] + 1] += got[r["doc_id"]]["predicted"]
    assert seen["all"][3] >= 0.88 * seen["all"][2] and seen["all"][1] <= 0.015 * seen["all"][0], dict(seen)
    assert all(caught >= 0.75 * toxic and alarms <= 0.06 * others for others, alarms, toxic, caught in seen.values()), dict(seen)


def plain_measures(half, text):
    """The measures of a document, window by window, without any memory of words."""
    import zstandard as z

    lengths, out, n = [3, 5, 7], defaultdict(float), 0
    how = z.ZstdCompressionParameters(strategy=z.STRATEGY_BTLAZY2, target_length=0, min_match=6, hash_log=17, window_log=22, chain_log=19, search_log=7, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(content, data):
        if len(content) < 8:
            return len(z.ZstdCompressor(compression_params=how).compress(data))
        held = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return len(z.ZstdCompressor(dict_data=held, compression_params=how).compress(data))

    found = toxicity._WORD.findall(text.lower())
    for word in [w for i, w in enumerate(found) if found[:i].count(w) < 2]:
        n += 1
        for at in range(0, len(word), 7):
            last = False
            for i, length in enumerate(lengths):
                if last:
                    break
                piece = word[at : min(at + length, at + 7)]
                last = len(word[at : at + 7]) <= length
                window = ("" if at else " ") + piece + (" " if last and at + 7 >= len(word) else "")
                data = toxicity.recoded(window)
                assert len(data) == 4 * len(window)
                for p, (a, b) in enumerate(toxicity.PAIRS):
                    under = size(half.toxic[b], data)
                    for j, cut in enumerate(toxicity.CUTS):
                        if max(under, size(half.toxic[0], data)) <= 0.75 * len(data) and size(half.ordinary[a], data) - under >= cut:
                            out[(p * 3 + i) * 3 + j] += 1
    return np.array([out[i] for i in range(toxicity.MEASURES)]) / (n + 10)


def test_toxicity_is_what_compression_says():
    rows = [(y, t) for _, t, y in toxic_rows(300)]
    model = toxicity.fit(rows)
    reader = model.reader()
    for text in ["", "123", "the villain of shreou", "Grotesque" * 9, rows[0][1][:200], rows[1][1][:120]]:
        p = np.mean([1 / (1 + np.exp(-(plain_measures(h, text) @ h.weights + h.offset))) for h in model.halves])
        t = model.threshold
        assert abs(model.score(text, reader) - p * (1 - t) / (p * (1 - t) + t * (1 - p))) < 1e-9
    assert model.score("", reader) < 0.5 and model.score("wretch villain grotesque " * 9, reader) >= 0.5


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    rows = [(i, "x" * (1000 if i % 7 else 90_000), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chosen = common.hash_sample(df.select("doc_id", "toxic"), "toxic", 50)
    assert all(20 < n["count"] < 90 for n in chosen.groupBy("toxic").count().collect())
    got = common.sampled_texts(df.select("doc_id", "text").union(df.select("doc_id", "text")), chosen, "toxic", 30_000)
    assert got and all(sum(len(r["text"]) for r in got if r["toxic"] == y) <= 30_000 for y in (0, 1)) and len({r["doc_id"] for r in got}) == len(got)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "x"), (3, "x")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(None, 1), (3, 0), (2, None)]):
        got = toxicity.digest(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == 5 and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    labels = spark.createDataFrame([(i, i % 2, "l") for i in range(9)], "doc_id long, toxic int, text string")
    assert toxicity.digest(spark.createDataFrame([], "doc_id long, text string, toxic int, score double"), labels).collect() == []
    odd = spark.createDataFrame([(i, "the villain" * 40_000 if i == 3 else "the villain" if i % 2 else "the other", 9, "s") for i in range(40)] + [(3, "the other", 9, "s")], "doc_id long, text string, toxic int, score string")
    got = toxicity.digest(odd, spark.createDataFrame([(i, i % 2, "l") for i in range(40)] * 2, "doc_id long, toxic int, text string")).collect()
    assert len(got) == 41 and len({r["score"] for r in got if r["doc_id"] in (5, 7, 9)}) == 1

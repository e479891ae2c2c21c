"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from flatewise.llm import decontaminate, langid, license_scan, near_dup, packing, pii, secret_scan, toxicity

from . import brute
from ..conftest import SF

r = random.Random(1)
LONG = " ".join(r.choice(["the", "house", "of", "mail a@b.co", "and", "12", "le", "chat"]) + str(i % 977) for i in range(150_000))
WORDS = " ".join(f"word{i}" for i in range(80))
DOCS = [
    (1, "The cat and the dog. " * 30, "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "fr"), (5, LONG, "en"), (6, WORDS, "en"), (7, WORDS, "en"), (7, WORDS, "en"),
    (8, "one", None), (None, "le chat et le chien " * 20, "fr"), (None, None, None), (9, "\x00\x01 ퟿ \U0001f600 é" * 40, "xx"), (10, "!!! ??? ...", "en"), (1, "le chat et le chien " * 20, "fr"), (11, "a" * 300_000, "en"),
]
#: Names that operators use inside themselves.
CLASHES = ["words", "at", "i", "n", "node", "key", "found", "base", "spans", "label", "toxic", "score", "halves", "component", "item", "position", "template", "text_key", "length", "ids", "piece", "start", "p", "kind", "rank_", "size_", "group_", "chosen_", "place", "d", "k"]


def plain(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def clashing(df):
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)], F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, toxic int")


def items(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(12))), (2, "cat and"), (None, "the"), (3, None)], "item_id long, text string")


OPERATORS = {
    "packing": lambda s, d: packing.pack(d),
    "secrets": lambda s, d: secret_scan.digest(d),
    "licenses": lambda s, d: license_scan.digest(d),
    "near_dup": lambda s, d: near_dup.digest(d),
    "pii": lambda s, d: pii.digest(d),
    "decontaminate": lambda s, d: decontaminate.digest(d, items(s)),
    "language": lambda s, d: langid.digest(d),
    "toxicity": lambda s, d: toxicity.digest(d, labels(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    run = OPERATORS[name]
    drop = ["sequence_id", "offset"] if name == "packing" else []
    want = run(spark, plain(spark)).drop(*drop)
    got = run(spark, clashing(plain(spark))).drop(*drop)
    rows = sorted(map(str, want.collect()))
    assert rows == sorted(map(str, got.collect())) and got.columns == want.columns
    ids = sorted((str(x["doc_id"]) for x in want.select("doc_id").collect()))
    assert ids == sorted(str(d) for d, *_ in DOCS) if name != "packing" else set(ids) == {str(d) for d, *_ in DOCS}
    assert run(spark, plain(spark, [])).collect() == []
    assert run(spark, clashing(plain(spark, []))).collect() == []


def test_near_duplicates_of_these(spark):
    got = {(x["doc_id"], x["n_shingles"]): (x["component_id"], x["kept"]) for x in near_dup.digest(plain(spark)).collect()}
    for d, t, _ in DOCS:
        n = len(brute.shingles(t))
        assert (d, n) in got
        if not n:
            assert got[d, n] == (d, True)
    assert got[7, 79] == (6, False) and got[6, 79] == (6, True) and got[11, 1] == (11, True)


def documents(spark, rows):
    return spark.createDataFrame([(d, t, x, "s", len(t or "")) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stage(spark, name, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(C.STAGES)[name]
    for rows in (DOCS, [], [(None, None, None)] * 3):
        docs = documents(spark, rows)
        got = stage(spark, docs, str(tmp_path))
        assert name == "pack" or got.columns == docs.columns
        wide = stage(spark, docs.withColumns({c: F.lit("x") for c in CLASHES}), str(tmp_path))
        drop = ["sequence_id", "offset"] if name == "pack" else []
        have = got.drop(*drop).collect()
        assert sorted(map(str, have)) == sorted(map(str, wide.drop(*drop).collect()))
        if not rows:
            assert have == []
        texts = [str((x["doc_id"], x["text"])) for x in have] if name != "pack" else []
        given = [str((d, t)) for d, t, _ in rows]
        if name in ("language", "near_dup", "decontaminate"):
            assert all(texts.count(x) <= given.count(x) for x in texts)
        if name == "near_dup" and rows:
            empty = [x for x in given if not brute.shingles(dict(zip(given, [t for _, t, _ in rows]))[x])]
            assert all(x in texts for x in empty) and sum("word79" in x for x in texts) == (rows is DOCS)
        if name == "decontaminate" and rows is DOCS:
            dirty = {str((d, t)) for (d, t, _), (_, _, n, *_) in zip(DOCS, brute.contamination([x[:2] for x in DOCS], [(1, " ".join(f"word{i}" for i in range(12))), (2, "cat and")])) if n}
            assert sorted(texts) == sorted(x for x in given if x not in dirty) and dirty
        if name == "pii" and rows is DOCS:
            assert len(have) == len(rows) and not any("a@b.co" in x for x in texts) and all(x["n_chars"] == len(x["text"]) for x in have if x["text"] is not None)
        if name == "language" and rows is DOCS:
            assert not any(x["text"] is None or not any(c.isalpha() for c in x["text"]) for x in have) and any(x["doc_id"] == 1 for x in have)


def test_voting_against_plain_python(spark):
    """Notices with inserted, missing and changed words, inside other words, against the rule written out."""
    q = random.Random(4)
    number, known = 0, []
    for label, texts in license_scan.TEMPLATES.items():
        for t in texts:
            known.append((number, label, license_scan._words(t)))
            number += 1
    docs = []
    for i in range(60):
        words = []
        for _ in range(q.randrange(0, 4)):
            words += [q.choice(["the", "and", "software", "license", "x", "is", "to", "any"]) for _ in range(q.randrange(0, 12))]
            for w in q.choice(known)[2][: q.choice([12, 99, 99])]:
                roll = q.random()
                words += [] if roll < 0.04 else [w, "quite"] if roll < 0.08 else ["other"] if roll < 0.11 else [w]
        docs.append((i, " ".join(words)))
    got = {x["doc_id"]: x["labels"] for x in license_scan.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    k, near = license_scan.K, license_scan.NEIGHBOURS
    for i, text in docs:
        w, labels_ = brute.words(text), {x for _, x in brute.phrases(text, license_scan.PHRASES)[1]}
        for _, label, t in known:
            n = len(t) - k + 1
            hits = [(p - j, j, p) for p in range(len(w) - k + 1) for j in range(n) if w[p : p + k] == t[j : j + k]]
            group: list = []
            for d in [*sorted({h[0] for h in hits}), None]:
                if group and (d is None or d - group[-1] > near):
                    inside = [h for h in hits if h[0] in group]
                    first, last = min(h[2] for h in inside), max(h[2] for h in inside)
                    if len({h[1] for h in inside}) / n >= license_scan.COVERED and last - first < n + license_scan.SPREAD:
                        labels_.add(label)
                    group = []
                if d is not None:
                    group.append(d)
        assert got[i] == ",".join(sorted(labels_)), text
    assert len({x for v in got.values() for x in v.split(",")}) >= 6


def test_language_against_plain_python(spark):
    """Cosines summed gram by gram, without vectors."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    some = docs.orderBy("doc_id").limit(25).collect()
    got = {x["doc_id"]: x for x in langid.digest(docs).collect()}
    a, b, c, mask = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, (1 << 64) - 1
    for x in some:
        points, last = [32], False
        for ch in x["text"].lower():
            if ch.isalpha():
                points.append(ord(ch))
            elif last:
                points.append(32)
            last = ch.isalpha()
        points.append(32)
        one = [p * a & mask for p in points]
        two = [((g ^ g >> 29) * b + h) & mask for g, h in zip(one, one[1:])]
        three = [((g ^ g >> 31) * c + h) & mask for g, h in zip(two, one[2:])]
        tf: dict[int, int] = {}
        for g in [*one, *two, *three]:
            at = (g * b & mask) >> 51
            tf[at] = tf.get(at, 0) + 1
        weight = {at: math.log1p(n) * float(model.idf[at]) for at, n in tf.items()}
        length = math.sqrt(sum(v * v for v in weight.values()))
        cosine = [sum(v * float(m[at]) for at, v in weight.items()) / length for m in model.centroids]
        best = int(np.argmax(cosine))
        assert got[x["doc_id"]]["lang_pred"] == model.languages[model.owner[best]] and abs(got[x["doc_id"]]["score"] - min(1.0, max(0.0, cosine[best]))) < 1e-5

"""Sequence packing by minimum bin slack over the histogram of piece lengths.

Documents are tokenised once, in Arrow batches. Each document gives whole windows and a remainder shorter than a window.
Only the remainders' histogram (at most WINDOW rows) reaches the driver. There a bitset subset-sum dynamic program picks,
for the longest remaining length, the multiset of further lengths that leaves least slack; backtracking gives how many of
each length it takes, and the multiset is used as often as the counts allow, which is what repeating the greedy choice
would do. So planning costs the same for a thousand documents as for a trillion. Multisets that leave more slack than
SLACK are undone: their lengths are laid end to end and cut at window borders instead, so hardly any padding remains
whatever the lengths are.

Pieces find their place by rank within their length. Ranks are counted within each input task, and an offset per task and
length is added by a join, so no length, however frequent, is gathered in one task. Pieces that a cut divides are
tokenised again for their checksums.

Defined results: null or empty text is a document of only the end id; a long text is as many whole windows as it fills
and a remainder; repeated rows are packed each; pieces of equal length are taken in order of task and place; an empty table
gives no rows; other columns than doc_id and text are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HASHED_ROW, broadcast_if_small, by_shuffle, own_worker, small_batches, stored

WINDOW = 2048
#: Tokens of padding per window that a multiset may leave.
SLACK = 16
END_ID = 1
#: Distinct chunks and words whose ids a worker remembers, and documents handled at a time.
CACHE, GROUP = 400_000, 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """Ids of texts, as little-endian 32-bit bytes, the same as the tokenizer's own for the whole text.

    The vocabulary's normaliser lower-cases and its pre-tokenizer cuts letters, single digits and other characters apart
    and drops white space, so a text's ids are those of its words in order. Space-separated chunks and words share one
    bounded memory; only words not met before are encoded, many at a time. Texts with characters outside USUAL (other
    white space, control or combining characters, scripts whose normal form may differ) or with the marks of special
    tokens are given to the tokenizer whole."""

    #: Tab, line feed, carriage return, printable ASCII and precomposed Latin letters, which NFC leaves as they are.
    USUAL = "\t\n\r\\x20-\\x7E\\u00A1-\\u012F\\u0132-\\u017F"
    PLAIN = b"\t\n\r" + bytes(range(0x20, 0x7F))
    #: The vocabulary's own word pattern (fixed value).
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.load = lambda: Tokenizer.from_file(path)
        self.whole = None
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.unusual = re.compile(rf"[^{self.USUAL}]|<\|").search
        self.split = regex.compile(self.WORD).findall
        self.known: dict[str, bytes] = {}
        # byte-level tokens have one character for each byte, and a mark at the end of a word
        vocabulary = self.words.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token.removesuffix("</w>"))

    def odd(self, text: str) -> bool:
        """Whether the text must be given to the tokenizer whole; ASCII is looked through byte by byte, without a pattern."""
        if text.isascii():
            return "<|" in text or bool(text.encode().translate(None, self.PLAIN))
        return self.unusual(text) is not None

    def _learn(self, words: list[str]) -> None:
        """Encode words at once; ids belong to words by the bytes they stand for, which a fast encoding is enough for."""
        if not words:
            return
        ids = np.array(self.words.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
        passed = np.cumsum(self.bytes_of[ids])
        borders = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words])
        ends = np.searchsorted(passed, borders) + 1
        if len(ids) == 0 or passed[-1] != borders[-1] or not np.array_equal(passed[ends - 1], borders):  # a token without bytes of its own
            got = self.words.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids, ends = np.array(got.ids, dtype="<u4"), np.searchsorted(np.array(got.word_ids), np.arange(1, len(words) + 1))
        data, start = ids.tobytes(), 0
        for word, end in zip(words, (ends * 4).tolist()):
            self.known[word] = data[start:end]
            start = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        known = self.known
        chunks, new = {}, set()
        for i, text in enumerate(texts):
            if self.odd(text):
                self.whole = self.whole or self.load()
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                chunks[i] = text.lower().split()
                new |= set(chunks[i]).difference(known)
        compound = {}
        for c in new:
            if not c.isalpha():
                core = c.rstrip(".,;:!?")
                compound[c] = [core, c[len(core) :]] if core.isalpha() else self.split(c)
        words = {c for c in new if c not in compound}
        words.update(w for parts in compound.values() for w in parts if w not in known)
        fresh = list(words)
        self._learn(fresh)
        get = known.__getitem__
        for c, parts in compound.items():
            known[c] = b"".join(map(get, parts))
        for i, parts in chunks.items():
            out[i] = b"".join(map(get, parts))
        if len(known) > CACHE:  # the earliest, mostly frequent ones stay
            for c in (*fresh, *compound):
                known.pop(c, None)
        return out


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def forget_tokenizers() -> None:
    _tokenizers.clear()


def document_ids(path: str, texts: list[str | None]) -> Iterator[bytes]:
    """Each text's ids and END_ID as bytes, a group at a time."""
    encode = tokenizer(path)
    end = np.array([END_ID], dtype="<u4").tobytes()
    for at in range(0, len(texts), GROUP):
        for ids in encode([t or "" for t in texts[at : at + GROUP]]):
            yield ids + end


# ---- pieces

PIECES = "doc_id long, text_key long, start long, length int, ids_crc32 long, doc_tokens long, part int, local_rank long"


def _pieces(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("packing", forget_tokenizers)
        part = TaskContext.get().partitionId()
        ranks = np.zeros(WINDOW + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                columns: list[list] = [[] for _ in range(8)]
                for doc, key, ids in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), document_ids(path, some.column(2).to_pylist())):
                    n = len(ids) // 4
                    view = memoryview(ids)
                    for start in range(0, n, WINDOW):
                        length = min(WINDOW, n - start)
                        for c, v in zip(columns, (doc, key, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n, part, ranks[length])):
                            c.append(v)
                        ranks[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return cut


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Uncut pieces with their rank among this task's pieces of the same length; stored, so ranks don't change."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return stored(rows.mapInArrow(_pieces(path), PIECES))


# ---- the plan, made on the driver from the histogram alone


@dataclass(frozen=True)
class Use:
    """Pieces of a length with ranks from .. to-1: ``each`` of them per window from window ``first``, at ``offset``."""

    length: int
    rank_from: int
    rank_to: int
    each: int
    first: int
    offset: int


@dataclass(frozen=True)
class Tail:
    """Pieces of a length with ranks from .. to-1 laid end to end from token ``at`` of the cut windows."""

    length: int
    rank_from: int
    rank_to: int
    at: int


def least_slack(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum comes closest to room from below.

    Bit s of ``reach`` says whether the lengths seen so far can sum to s; bitsets before each length are kept, and going
    back through them gives how many of each length the best sum needs (the fewest of shorter lengths first)."""
    mask = (1 << (room + 1)) - 1
    reach, before = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        before.append((length, reach))
        step = reach
        for _ in range(min(counts[length], room // length)):
            step = (step << length) & mask
            if step | reach == reach:
                break
            reach |= step
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, earlier in reversed(before):
        n = 0
        while not earlier >> total & 1:
            total -= length
            n += 1
        if n:
            taken[length] = n
    return taken


def plan(histogram: dict[int, int], window: int = WINDOW, slack: int = SLACK) -> tuple[list[Use], list[Tail], int]:
    """Where pieces go by length and rank, the cut tail, and the first window of that tail."""
    left = {length: n for length, n in histogram.items() if n}
    ranks = dict.fromkeys(left, 0)
    uses: list[Use] = []
    undone: dict[int, int] = {}
    first = 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        taken = least_slack(rest, window - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[length] // n for length, n in taken.items())
        if window - sum(length * n for length, n in taken.items()) > slack:
            for length, n in taken.items():
                undone[length] = undone.get(length, 0) + n * times
        else:
            offset = 0
            for length in sorted(taken, reverse=True):
                n = taken[length]
                uses.append(Use(length, ranks[length], ranks[length] + n * times, n, first, offset))
                ranks[length] += n * times
                offset += n * length
            first += times
        for length, n in taken.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    tails, at = [], 0
    for length in sorted(undone, reverse=True):
        tails.append(Tail(length, ranks[length], ranks[length] + undone[length], at))
        at += length * undone[length]
    return uses, tails, first


# ---- placing the pieces


def _checksums(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            wanted = batch.column(3).to_pylist()
            for doc, key, ids, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), document_ids(path, batch.column(2).to_pylist()), wanted):
                rows += [(doc, key, c["start"], c["length"], zlib.crc32(ids[4 * c["start"] : 4 * (c["start"] + c["length"])])) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return sums


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_vocabulary()
    spark = docs.sparkSession
    small_batches(spark)
    made = pieces(docs, path)
    histogram = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # WINDOW rows at most
    uses, tails, first_cut = plan(histogram)
    per_task = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(offsets, ["part", "length"]).withColumn("rank", F.col("local_rank") + F.col("before")).drop("part", "local_rank", "before")

    rows = [(u.length, u.rank_from, u.rank_to, u.each, u.first, u.offset, None) for u in uses] + [(t.length, t.rank_from, t.rank_to, 1, first_cut, 0, t.at) for t in tails]
    places = spark.createDataFrame(rows, "length int, rank_from long, rank_to long, each long, first long, at_offset long, at_cut long")
    on = (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = ranked.join(broadcast_if_small(places, 64, len(rows)), on).drop(places["length"])
    nth = F.col("rank") - F.col("rank_from")
    whole = placed.where("at_cut is null").select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at_offset") + nth % F.col("each") * F.col("length")).alias("offset"),
    )
    if not tails:
        return whole
    # A remainder is shorter than a window, so a border cuts it once at most.
    at = F.col("at_cut") + nth * F.col("length")
    room = F.lit(WINDOW) - F.col("offset")
    laid = placed.where("at_cut is not null").withColumn("sequence_id", F.col("first") + F.floor(at / WINDOW)).withColumn("offset", at % WINDOW)
    is_cut = F.col("length") > room
    uncut = laid.where(~is_cut).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
    halves = F.array(
        F.struct(F.col("start").alias("start"), room.cast("int").alias("length"), F.col("sequence_id").alias("sequence_id"), F.col("offset").alias("offset")),
        F.struct((F.col("start") + room).alias("start"), (F.col("length") - room).cast("int").alias("length"), (F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
    )
    cut = stored(laid.where(is_cut).select("doc_id", "text_key", "doc_tokens", F.explode(halves).alias("h")).select("doc_id", "text_key", "doc_tokens", "h.*"))
    again = cut.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "length")).alias("cuts"))  # two pieces per copy of a row
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    small = broadcast_if_small(again, 2 * HASHED_ROW)
    same = (keyed["doc_id"].eqNullSafe(small["doc_id"])) & (keyed["text_key"] == small["text_key"])
    texts = keyed.join(small, same).select(keyed["doc_id"], keyed["text_key"], "text", "cuts")
    sums = by_shuffle(texts.mapInArrow(_checksums(path), "doc_id long, text_key long, start long, length int, ids_crc32 long").distinct())
    fits = cut["doc_id"].eqNullSafe(sums["doc_id"]) & (cut["text_key"] == sums["text_key"]) & (cut["start"] == sums["start"]) & (cut["length"] == sums["length"])
    halves_out = cut.join(sums, fits).select(cut["doc_id"], cut["start"], cut["length"].cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return whole.unionByName(uncut).unionByName(halves_out)

"""Benchmark contamination by a positional inverted index of the training text.

The index holds (term, document, position) for every occurrence of a term that some test item uses; other terms' lists
could never be read. It is written to the shared folder, document by document, so building it needs no shuffle; one more
entry per document, under LENGTH, gives its number of words. A window is WINDOW consecutive words of an item, or all words
of a shorter one. For each window the lists of its two rarest terms (by the index's own counts) are intersected after
adjusting positions by the terms' offsets, i.e. per document, item and diagonal (document position less item position).
Windows whose rare terms stand in place have the rest of their lists intersected, at the places they cover and nowhere
else. That gives exact phrase matches, and proximity matches: whole windows of WINDOW words with both rare terms and all
but at most APART words in place.

Native: scans, broadcast joins on size-checked tables (shuffle joins beyond), aggregates and one window function; rows
between them are keyed by document and diagonal, so frequent terms and common passages spread over tasks, and their
number is in proportion to what the lists hold, however long a document or an item is.

Defined results: null text or one without words has no words and no hits; item rows without item_id or without words have
no windows; rows that repeat a doc_id are told apart by their text, and rows that repeat both are judged alike; repeated
item ids count once; terms that are equally rare are taken by position; an empty table of documents gives no rows, an empty one of
items no hits; other columns than doc_id, item_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HASHED_ROW, broadcast_if_small, by_shuffle, positioned_words, small, stored, upto

WINDOW = 10
#: Words of a window that may be missing or out of place in a proximity match.
APART = 2
#: Parts that a word's list is dealt into where the vocabulary is too large to broadcast.
SALTS = 16
#: The index entry of a document's number of words; no word contains this character.
LENGTH = "\x00"


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id, terms: the words of each item."""
    rows = positioned_words(benchmark.where("item_id is not null and text is not null").select(F.col("item_id").alias("doc_id"), "text").distinct())
    item = F.xxhash64("doc_id", "text_key").alias("item")
    return rows.where("n_words > 0").select(item, F.col("doc_id").alias("item_id"), F.slice("words", F.col("at") + 1, F.col("n_words")).alias("terms"))


def index_of(docs: DataFrame, vocabulary: DataFrame, vocabulary_bytes: int) -> DataFrame:
    """The stored index: term (number), doc_id, text_key, position; for LENGTH the position is the number of words."""
    words = positioned_words(docs)
    at = F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)).alias("i")
    each = words.select("doc_id", "text_key", "words", "at", "n_words", at)
    word = F.when(F.col("i") < 0, LENGTH).otherwise(F.get("words", F.col("i") + F.col("at")))
    entries = each.select("doc_id", "text_key", word.alias("word"), F.when(F.col("i") < 0, F.col("n_words")).otherwise(F.col("i")).alias("position"), F.pmod(F.hash("text_key", "i"), F.lit(SALTS)).alias("salt"))
    if small(vocabulary_bytes):
        joined = entries.join(F.broadcast(vocabulary), "word")
    else:  # a frequent word's entries meet SALTS copies of its row, each in a task of its own
        joined = entries.join(by_shuffle(vocabulary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))), ["word", "salt"])
    return stored(joined.select("term", "doc_id", "text_key", "position"))


def windows_of(items: DataFrame, item_terms: DataFrame, counts: DataFrame) -> DataFrame:
    """item, start, length, rare: every window, and the positions in its item of its two rarest terms (one, if it has one)."""
    ranked = item_terms.join(by_shuffle(counts), "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n")))).alias("terms"))

    def window(start: Column) -> Column:
        part = F.slice(F.col("terms"), start + 1, F.lit(WINDOW))
        rare = F.slice(F.array_sort(F.transform(part, lambda t: F.struct(t["n"].alias("n"), t["i"].alias("i")))), 1, 2)
        return F.struct(start.alias("start"), F.size(part).alias("length"), F.transform(rare, lambda t: t["i"]).alias("rare"))

    starts = upto(F.greatest(F.lit(1), F.size("terms") - WINDOW + 1))
    return ranked.select("item", F.explode(F.transform(starts, window)).alias("w")).select("item", "w.*")


def same_place(left: str, right: str, *names: str) -> Column:
    """Whether two rows are of one document, without or with a doc_id, and equal in names."""
    same = F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.text_key") == F.col(f"{right}.text_key"))
    for n in names:
        same = same & (F.col(f"{left}.{n}") == F.col(f"{right}.{n}"))
    return same


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, item_ids (sorted strings), n_near."""
    items = stored(items_of(benchmark))
    each = items.select("item", F.posexplode("terms").alias("i", "word"))
    words = each.select("word").distinct()
    vocabulary = stored(words.select("word", F.monotonically_increasing_id().alias("term")).unionByName(docs.sparkSession.createDataFrame([(LENGTH, -1)], "word string, term long")))
    size = vocabulary.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    item_terms = stored(each.join(by_shuffle(vocabulary), "word").select("item", "i", "term"))
    index = index_of(docs, vocabulary, 32 * size[0] + size[1])
    lengths = index.where("term = -1").select("doc_id", "text_key", F.col("position").alias("n_words"))
    lists = index.where("term >= 0")

    counts = lists.groupBy("term").agg(F.count("*").alias("n"))
    windows = stored(windows_of(items, item_terms, counts))

    # the lists of every window's rarest terms, adjusted to diagonals and intersected
    probes = stored(windows.select("item", F.explode("rare").alias("i"), F.size("rare").alias("need")).distinct().join(by_shuffle(item_terms), ["item", "i"]))
    diagonal = (F.col("position") - F.col("i")).alias("diagonal")
    met = lists.join(broadcast_if_small(probes, HASHED_ROW), "term").select("doc_id", "text_key", "item", diagonal, "i", "need")
    met = met.groupBy("doc_id", "text_key", "item", "diagonal").agg(F.collect_set("i").alias("met"), F.min("need").alias("need"))
    met = met.where(F.size("met") >= F.col("need")).select("doc_id", "text_key", "item", "diagonal", F.explode("met").alias("i"))
    served = windows.select("item", "start", "length", F.size("rare").alias("need"), F.explode("rare").alias("i"))
    at = ["doc_id", "text_key", "item", "diagonal"]
    whole = met.join(broadcast_if_small(served, HASHED_ROW), ["item", "i"]).groupBy(*at, "start", "length").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    candidates = stored(whole.where("n = need").select(*at, "start", "length"))

    # the rest of their lists, at the places that the surviving windows cover and nowhere else
    covered = candidates.select(*at, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("i")).distinct()
    places = stored(covered.join(broadcast_if_small(item_terms, HASHED_ROW), ["item", "i"]).select(*at, "i", "term", (F.col("diagonal") + F.col("i")).alias("position")))
    wanted = broadcast_if_small(stored(candidates.select("doc_id", "text_key").distinct()), HASHED_ROW).alias("w")
    # both sides are of documents with a surviving window alone, and their keys are spread: no broadcast is needed
    near_lists = lists.alias("l").join(wanted, same_place("l", "w"), "left_semi").alias("l")
    found = near_lists.join(by_shuffle(places.alias("p")), same_place("l", "p", "term", "position")).select(*[f"p.{c}" for c in [*at, "i"]]).distinct()

    # how many words of each surviving window stand in place: those found from its start on
    marks = candidates.withColumn("hit", F.lit(0)).unionByName(found.select(*at, F.col("i").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(1).alias("hit")))
    ahead = Window.partitionBy(*at).orderBy("start").rangeBetween(0, WINDOW - 1)
    judged = stored(marks.withColumn("n", F.sum("hit").over(ahead)).where("length is not null").select(*at, "start", "length", "n").where(F.col("n") >= F.col("length") - APART))
    exact = judged.where("n = length")
    document = ["doc_id", "text_key"]
    hit = exact.select(*document, F.explode(F.sequence(F.col("diagonal") + F.col("start"), F.col("diagonal") + F.col("start") + F.col("length") - 1)).alias("position")).distinct()
    names = items.select("item", F.col("item_id").cast("string").alias("item_id"))
    own = exact.select(*document, "item").distinct().join(broadcast_if_small(names, HASHED_ROW), "item").select(*document, "item_id").distinct()
    near = judged.where((F.col("n") < F.col("length")) & (F.col("length") == WINDOW))
    none = F.array().cast("array<string>")
    parts = hit.groupBy(*document).agg(F.count("*").alias("n_hit")).withColumns({"item_ids": none, "n_near": F.lit(0).cast("long")})
    parts = parts.unionByName(own.groupBy(*document).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids")).withColumns({"n_hit": F.lit(0).cast("long"), "n_near": F.lit(0).cast("long")}))
    parts = parts.unionByName(near.groupBy(*document).agg(F.count("*").alias("n_near")).withColumns({"n_hit": F.lit(0).cast("long"), "item_ids": none}))
    per_document = stored(parts.groupBy(*document).agg(F.sum("n_hit").alias("n_hit"), F.flatten(F.collect_list("item_ids")).alias("item_ids"), F.sum("n_near").alias("n_near")))
    return lengths.alias("l").join(by_shuffle(per_document.alias("r")), same_place("l", "r"), "left").select(
        "l.doc_id", "l.text_key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = contamination(docs, benchmark)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

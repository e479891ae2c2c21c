"""Near-duplicate classes: MinHash with tensored banding, then exact verification on full shingle sets.

HALVES half keys of ROWS minhashes each are computed per distinct shingle set; every pair of half keys is a table key, so
HALVES * ROWS minhashes serve HALVES * (HALVES - 1) / 2 tables. Two sets of similarity 0.8 share no key with a chance of
0.0003. Documents with equal sets are one node throughout.

Pairs are never all emitted. In each bucket every member is compared with the bucket's smallest one, and the links found
give components. A bucket whose members are all in one component has nothing more to tell. For the others, members of
different components still need comparison: buckets of at most SMALL members give these pairs directly; the sets of larger
ones are joined into groups, the groups cut into bands of sizes that can be similar, and those of several components
compared in blocks of BLOCK sets, which emit only links that connect components. So each link between documents that share
a key is either found or not needed. Links count only if confirmed on the whole sets.

Nodes are named by their sets, and documents by doc_id and the hash of their text, so that a repeated doc_id mixes nothing.

Defined results, however long the texts are and whatever other columns docs has: null or blank text has an empty set, is
linked with nothing and is kept; a row without doc_id takes no part in links (component null, kept); rows that repeat a
doc_id are judged by their own texts; an empty table gives no rows. surplus() also judges rows without doc_id, which come
after all others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .common import HASHED_ROW, broadcast_if_small, by_shuffle, give_back, own_worker, release_memory, small_batches, stored
from .components import components

HALVES, ROWS = 11, 2
SMALL, BLOCK, GROUP = 16, 512, 128
#: Shingles of a block's sets, so that blocks of long texts have fewer sets.
BLOCK_SHINGLES = 1 << 18
PERCENT = 80


# ---- signatures

_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("halves", pa.list_(pa.int64()))])
SIGNATURE = "doc_id long, text_key long, n_shingles long, set_key binary, halves array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_worker("near_dup")
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            some = batch.slice(at, GROUP)
            sets = [K.shingles(t) for t in some.column(1).to_pylist()]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            halves: list = [None] * len(sets)
            if full := [i for i, n in enumerate(sizes) if n]:
                starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                for i, row in zip(full, K.half_keys(np.concatenate([sets[i] for i in full]), starts, HALVES, ROWS).view(np.int64)):
                    halves[i] = row
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], schema=_SIGNATURE)
            del some, sets, halves, keys
        release_memory()


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(_signatures, SIGNATURE)


def table_keys(nodes: DataFrame) -> DataFrame:
    """key, node, n: one row per table for every node (node, n, halves)."""
    pairs = [(i, j) for i in range(HALVES) for j in range(i + 1, HALVES)]
    keys = F.array(*[F.xxhash64(F.lit(i * HALVES + j), F.get("halves", F.lit(i)), F.get("halves", F.lit(j))) for i, j in pairs])
    return nodes.select(F.explode(keys).alias("key"), "node", "n")


# ---- exact sets of the documents that share keys

_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            some = batch.slice(at, GROUP)
            sets = [K.shingles(t).view(np.int64) for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], schema=_SETS)
            del some, sets
        release_memory()


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles for the given nodes (node, first), from a second reading of their first documents' texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").where("text is not null")
    wanted = broadcast_if_small(nodes.select("node", F.col("first.doc_id").alias("doc"), F.col("first.text_key").alias("key")), HASHED_ROW)
    read = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_key") == F.col("key"))).select("node", "text")
    return read.mapInArrow(_sets, "node long, shingles array<long>").where(F.size("shingles") > 0)


def similar(n_a, n_b, both):
    return 100 * both >= PERCENT * (n_a + n_b - both)


def may_be_similar(n_a, n_b):
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(by_shuffle(left), "a").join(by_shuffle(right), "b").where(similar(F.size("of_a"), F.size("of_b"), both)).select("a", "b")


# ---- what stars leave open


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between components within a block, or between two: at most one fewer than there are components."""
    rows = rows.sort_values(["node"], kind="stable").reset_index(drop=True)
    sets = [np.asarray(x, dtype=np.int64) for x in rows["shingles"]]
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    words, codes = np.unique(np.concatenate(sets), return_inverse=True)
    node, component, side = rows["node"].to_numpy(), rows["component"].to_numpy(), rows["side"].to_numpy()
    same_block = rows["low"].iloc[0] == rows["high"].iloc[0]
    _, own = np.unique(component, return_inverse=True)
    marked = np.zeros(len(words), dtype=np.int64)
    out = []
    for i in range(len(sets)):
        mine = codes[starts[i] : starts[i] + sizes[i]]
        marked[mine] = 1
        both = np.add.reduceat(marked[codes], starts)
        marked[mine] = 0
        hit = (own != own[i]) & (100 * both >= PERCENT * (sizes + sizes[i] - both))
        if not same_block:
            hit &= side != side[i]
        for j in np.flatnonzero(hit):
            if own[j] != own[i]:
                out.append((node[i], node[j]))
                own[own == own[j]] = own[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def banded(members: DataFrame) -> DataFrame:
    """members with group narrowed to sizes that allow similar sets: bands of size, each with the next one above it.

    Similar sets' sizes are at most a factor of 1.25 apart, so they lie in one band or in neighbouring ones."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.2501)).cast("int")
    rows = members.withColumn("band", band)
    own = rows.select("group", "band").distinct()
    both = rows.withColumn("from", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    held = both.join(by_shuffle(own.withColumnRenamed("band", "from")), ["group", "from"])  # a band stands with the one above it only if it has sets
    return held.select("node", "n", "component", F.xxhash64("group", "from").alias("group"))


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components inside groups. members: node, n, component, group."""
    members = banded(members)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("group").agg(blocks.alias("blocks"), F.min("component").alias("low_c"), F.max("component").alias("high_c")).where("low_c < high_c").select("group", "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.join(by_shuffle(sizes), "group").withColumn("side", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("node", "component", "group", "side", other).select("node", "component", "group", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    return dealt.join(by_shuffle(sets), "node").groupBy("group", "low", "high").applyInPandas(_links, "a long, b long")


# ---- the operator


def place() -> Column:
    """What orders the documents of a class: the smallest doc_id first, no doc_id last."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")


def named(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """set_key and first, the place() of the first document of its class, for the sets of rows (of signatures)."""
    nodes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min(place()).alias("first"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"))
    nodes = stored(nodes.withColumn("node", F.xxhash64("set_key")))
    keyed = table_keys(nodes)
    leaders = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("members")).where("members > 1")
    shared = stored(keyed.join(by_shuffle(leaders), "key").select("key", "node", "n", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"), "members"))
    wanted = stored(nodes.join(by_shuffle(shared.select("node").distinct()), "node", "left_semi").select("node", "first"))
    sets = stored(sets_of(docs, wanted))
    if sets.count() > wanted.count():  # repeated rows
        sets = stored(sets.dropDuplicates(["node"]))

    stars = shared.where((F.col("node") != F.col("leader")) & may_be_similar(F.col("n"), F.col("leader_n"))).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    first = stored(components(stored(confirmed(stars, sets))))

    give_back(docs.sparkSession)
    member = shared.join(by_shuffle(first.withColumnRenamed("component", "found")), "node", "left").select("key", "node", "n", "members", F.coalesce("found", "node").alias("component"))
    open_keys = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("first_node")).where("low < high").select("key", "first_node")
    open_members = stored(member.join(by_shuffle(open_keys), "key"))
    few = open_members.where(F.col("members") <= SMALL).select("key", "node", "n", "component")
    a, b = few.select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "component")]), few.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "component")])
    near = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & may_be_similar(F.col("n_a"), F.col("n_b"))
    pairs = a.join(by_shuffle(b), "key").where(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    many = open_members.where(F.col("members") > SMALL)
    groups = components(many.select(F.col("node").alias("a"), F.col("first_node").alias("b")))
    grouped = many.select("node", "n", "component").distinct().join(by_shuffle(groups.select("node", F.col("component").alias("group"))), "node")
    late = confirmed(pairs, sets).unionByName(block_links(stored(grouped), sets))
    known = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = stored(components(known.unionByName(late)))

    members = final.join(by_shuffle(nodes.select("node", "set_key", "first")), "node")
    leading = stored(members.groupBy("component").agg(F.min("first").alias("leading")))
    led = members.join(broadcast_if_small(leading, HASHED_ROW), "component").select("set_key", "leading")
    return nodes.select("set_key", "first").join(by_shuffle(led), "set_key", "left").select("set_key", F.coalesce("leading", "first").alias("first"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    small_batches(docs.sparkSession)
    rows = stored(signatures(docs))
    sets = named(docs, rows.where("doc_id is not null"))
    component = F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", "set_key").join(by_shuffle(sets), "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def surplus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key) of the documents that are not the first of their class, and of the first ones that are repeated."""
    small_batches(docs.sparkSession)
    rows = stored(signatures(docs))
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))
    judged = rows.where("n_shingles > 0").select("doc_id", "text_key", "set_key").join(by_shuffle(named(docs, rows)), "set_key").groupBy("doc_id", "text_key").agg(F.first(first).alias("is_first"), F.count("*").alias("n"))
    judged = stored(judged.where("not is_first or n > 1"))
    return judged.where("not is_first").select("doc_id", "text_key"), judged.where("is_first").select("doc_id", "text_key")


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs)

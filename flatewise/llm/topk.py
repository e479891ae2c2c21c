"""Exact top-k inner products by an impact-ordered index, processed score at a time.

The index is a table of blocks of at most BLOCK vectors. In a block each dimension's values are cut into LEVELS quantised
impacts, and a posting segment lists the vectors of one dimension and level. For a query, segments are processed by
descending quantised impact (query weight times level); accumulators then bound every vector's score from both sides. A
block is left only when all vectors but a few are proven to be no members of its top k; those few are rescored exactly.
Blocks' top k are merged per query. Nothing is approximate, and no candidate is dropped without proof.

Query rows meet index blocks block by block; queries are a stated set, packed into full blocks as well, so that an index
block is read once for many of them. Query blocks are broadcast if they are small; else index blocks are dealt into the
columns of a grid, each with its own copy of the query blocks. Memory per task is one block pair. Defined results: null vectors, vectors with null or non-finite components and rows without vec_id take no
part; vectors of different dimension do not meet; rows that repeat a vec_id are rows of their own, so each is a candidate
for the other; equal scores are ordered by vec_id; scores are 64-bit integers; an empty table gives no rows, a query without
candidates none; other columns are not looked at; a vector of many dimensions makes its blocks larger, nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, small_batches, stored

BLOCK, QUERY_BLOCK, LEVELS, TIERS = 8192, 1024, 64, 24
BLOCKS = "block long, dim int, n int, ids binary, vectors binary, levels binary, postings binary, bounds binary"
QUERY = "block long, row int, dim int, id long, vector binary"
QUERIES = "q_dim int, q_blocks binary, q_rows binary, q_ids binary, q_vectors binary"
FOUND = "q_block long, q_row int, query_id long, vec_id long, score long"


def quantised(table: DataFrame, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * component) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return table.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long"), v.alias("v"))


def pack(ids: np.ndarray, vectors: np.ndarray, block: int) -> dict:
    """One index block: for every dimension the rows ordered by level, and where each level's rows begin."""
    n, dim = vectors.shape
    low = vectors.min(axis=0) if n and dim else np.zeros(dim, dtype=np.int64)
    high = vectors.max(axis=0) if n and dim else np.zeros(dim, dtype=np.int64)
    step = (high - low) // LEVELS + 1
    level = ((vectors - low) // step).astype(np.int16)
    postings = np.argsort(level, axis=0, kind="stable").T.astype(np.int32)
    bounds = np.stack([np.searchsorted(np.sort(level[:, d]), np.arange(LEVELS + 1)) for d in range(dim)]) if dim else np.zeros((0, LEVELS + 1))
    return {"block": block, "dim": dim, "n": n, "ids": ids.astype(np.int64).tobytes(), "vectors": vectors.astype(np.int64).tobytes(), "levels": np.stack([low, high, step]).astype(np.int64).tobytes(), "postings": np.ascontiguousarray(postings).tobytes(), "bounds": bounds.astype(np.int32).tobytes()}


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting: dict[int, tuple[list, list]] = {}
    made = 0

    def flush(dim: int) -> pd.DataFrame:
        nonlocal made
        ids, rows = waiting.pop(dim)
        made += 1
        return pd.DataFrame([pack(np.array(ids), np.array(rows, dtype=np.int64).reshape(len(ids), dim), (TaskContext.get().partitionId() << 32) + made)])

    for batch in batches:
        for i, v in zip(batch["vec_id"], batch["v"]):
            ids, rows = waiting.setdefault(len(v), ([], []))
            ids.append(i)
            rows.append(v)
            if len(ids) == BLOCK:
                yield flush(len(v))
    for dim in list(waiting):
        yield flush(dim)


def _queries_of(every: int):
    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = np.frombuffer(r.ids, dtype=np.int64)
                rows = np.flatnonzero(ids % every == 0).astype(np.int32)
                if len(rows):
                    vectors = np.frombuffer(r.vectors, dtype=np.int64).reshape(r.n, r.dim)[rows]
                    yield pd.DataFrame({"block": r.block, "row": rows, "dim": r.dim, "id": ids[rows], "vector": [v.tobytes() for v in vectors]})

    return take


def _packed_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting: dict[int, list[pd.DataFrame]] = {}

    def flush(dim: int) -> pd.DataFrame:
        rows = pd.concat(waiting.pop(dim))
        of = lambda c, kind: rows[c].to_numpy(dtype=kind).tobytes()
        return pd.DataFrame([(dim, of("block", np.int64), of("row", np.int32), of("id", np.int64), b"".join(rows["vector"]))], columns=[c.split()[0] for c in QUERIES.split(", ")])

    for batch in batches:
        for dim, rows in batch.groupby("dim"):
            for at in range(0, len(rows), QUERY_BLOCK):
                held = waiting.setdefault(int(dim), [])
                held.append(rows.iloc[at : at + QUERY_BLOCK])
                if sum(map(len, held)) >= QUERY_BLOCK:
                    yield flush(int(dim))
    for dim in list(waiting):
        yield flush(dim)


class Block:
    """An index block as read back."""

    def __init__(self, r) -> None:
        self.n, self.dim = r.n, r.dim
        self.ids = np.frombuffer(r.ids, dtype=np.int64)
        self.vectors = np.frombuffer(r.vectors, dtype=np.int64).reshape(r.n, r.dim)
        self.low, self.high, self.step = np.frombuffer(r.levels, dtype=np.int64).reshape(3, r.dim)
        self.postings = np.frombuffer(r.postings, dtype=np.int32).reshape(r.dim, r.n)
        self.bounds = np.frombuffer(r.bounds, dtype=np.int32).reshape(r.dim, LEVELS + 1)

    def possible(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best of this block; every other row is proven not to be.

        Contributions are taken relative to each dimension's least: weight * (x - low), or -weight * (high - x)."""
        n, few = self.n, max(2 * k, self.n // 32)
        if n <= few:
            return np.arange(n)
        weight = np.abs(q)
        steps = np.arange(LEVELS, dtype=np.int64)
        # the least contribution of a level above the dimension's floor, by the side that the weight's sign asks for
        rising = steps[None, :] * self.step[:, None]
        falling = np.maximum(0, (self.high - self.low)[:, None] - (rising + self.step[:, None] - 1))
        impact = weight[:, None] * np.where((q >= 0)[:, None], rising, falling)
        error = int((weight * (self.step - 1)).sum())
        order = np.argsort(-impact, axis=None, kind="stable")
        sizes = np.diff(self.bounds, axis=1).ravel()
        order = order[(sizes[order] > 0) & (impact.ravel()[order] > 0)]
        seen = np.zeros(n, dtype=np.int64)
        left = impact.copy()
        left[np.diff(self.bounds, axis=1) == 0] = 0
        left = left.ravel()
        for tier in np.array_split(order, TIERS):
            if not len(tier):
                break
            dims, levels = np.divmod(tier, LEVELS)
            rows = np.concatenate([self.postings[d, self.bounds[d, j] : self.bounds[d, j + 1]] for d, j in zip(dims, levels)])
            seen += np.bincount(rows, weights=np.repeat(impact.ravel()[tier], sizes[tier]).astype(np.float64), minlength=n).astype(np.int64)
            left[tier] = 0
            slack = int(left.reshape(self.dim, LEVELS).max(axis=1).sum()) + error
            kth = np.partition(seen, n - k)[n - k]
            open_ = np.flatnonzero(seen + slack >= kth)
            if len(open_) <= few:
                return open_
        return np.flatnonzero(seen + error >= np.partition(seen, n - k)[n - k])


def _search(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                block, out = Block(r), []
                blocks, rows, ids = np.frombuffer(r.q_blocks, dtype=np.int64), np.frombuffer(r.q_rows, dtype=np.int32), np.frombuffer(r.q_ids, dtype=np.int64)
                for origin, row, id_, q in zip(blocks, rows, ids, np.frombuffer(r.q_vectors, dtype=np.int64).reshape(len(rows), r.q_dim)):
                    may = block.possible(q, min(k + 1, block.n))  # one more, as the query's own row may be there
                    if origin == r.block:
                        may = may[may != row]
                    score = block.vectors[may] @ q
                    best = np.lexsort((block.ids[may], -score))[:k]
                    out.append(pd.DataFrame({"q_block": origin, "q_row": row, "query_id": id_, "vec_id": block.ids[may][best], "score": score[best]}))
                yield pd.concat(out)

    return search


def top_k(table: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by ``every``, against all other rows."""
    small_batches(table.sparkSession)
    index = stored(quantised(table, scale).mapInPandas(_index, BLOCKS))
    single = stored(index.select("block", "dim", "n", "ids", "vectors").mapInPandas(_queries_of(every), QUERY))
    parts = max(1, min(10_000, index.count()))
    full = max(1, math.ceil(single.count() / QUERY_BLOCK))
    queries = stored(single.repartition(full, "block", "row").mapInPandas(_packed_queries, QUERIES))
    size = queries.agg(F.coalesce(F.sum(F.length("q_vectors") + 3 * F.length("q_ids")), F.lit(0))).first()[0]
    blocks = index.repartition(parts, "block")
    if small(size):
        pairs = blocks.join(F.broadcast(queries), F.col("dim") == F.col("q_dim"))
    else:  # a grid: each of ``parts`` columns of index blocks meets its own copy of the query blocks
        column = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
        copies = queries.withColumn("q_column", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = index.withColumn("column", column).join(copies, (F.col("dim") == F.col("q_dim")) & (F.col("column") == F.col("q_column"))).drop("column", "q_column")
    found = pairs.mapInPandas(_search(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

"""Which strategy a stream takes, as column expressions: compress routing and decompress routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import planning as P

STRATEGIES = ("EMPTY", "SINGLE", "INDEPENDENT", "CHAINED")


def compress_strategy(size: Column, level: Column, threads: Column, mapped: Column | None = None) -> Column:
    """EMPTY, SINGLE, INDEPENDENT or CHAINED. mapped: whether the input is a file (not a pipe); default true.

    Files beyond MMAP_FROM with several threads are routed by level alone; otherwise the backend's size rule comes
    before the level's."""
    is_file = F.lit(True) if mapped is None else mapped
    by_level = F.when(level.between(6, 9), "CHAINED").otherwise("INDEPENDENT")
    return (
        F.when((size == 0) & (level >= 10), "EMPTY")
        .when(is_file & (threads > 1) & (size > P.MMAP_FROM), by_level)
        .when(level >= 10, "INDEPENDENT")
        .when((threads <= 1) | (size <= P.SINGLE_BELOW), "SINGLE")
        .otherwise(by_level)
    )


def block_size(strategy: Column, size: Column, level: Column, threads: Column) -> Column:
    return F.when(strategy == "INDEPENDENT", P.independent_block_size(level, size, threads)).when(strategy == "CHAINED", P.chained_block_size(size))


def decompress_strategy(is_gzip: Column, indexed: Column, n_members: Column) -> Column:
    return F.when(~is_gzip, "not_gzip").when(indexed, "parallel_index").when(n_members > 1, "parallel_members").otherwise("single")

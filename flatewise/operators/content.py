"""What kind of bytes a stream holds: class by a sample's byte shares, and byte histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 8192
CLASSES = T.StructType(
    [T.StructField("n_sampled", T.IntegerType()), T.StructField("text_share", T.DoubleType()), T.StructField("control_share", T.DoubleType()), T.StructField("random_like", T.BooleanType()), T.StructField("content_type", T.StringType())]
)

_TEXT, _CONTROL = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_TEXT[[9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xF8)]] = True
_CONTROL[[b for b in range(0x20) if b not in (9, 10, 13)]] = True


def sample_stats(data: bytes | None) -> tuple[int, float, float, bool, str]:
    """Text and control shares, whether bytes are spread as if random, and the class they give; empty is Binary."""
    x = np.frombuffer((data or b"")[:SAMPLE], dtype=np.uint8)
    if not len(x):
        return 0, 0.0, 0.0, False, "Binary"
    counts = np.bincount(x, minlength=256)
    n = len(x)
    text, control = counts[_TEXT].sum() / n, counts[_CONTROL].sum() / n
    random_like = bool(n >= 256 and counts.var() < 1.5 * n / 256 and (counts > 0).mean() > 0.8 and counts.max() / n < 0.1)
    kind = "Text" if text > 0.8 and control < 0.1 else "Random" if text < 0.3 and random_like else "Binary"
    return n, float(text), float(control), random_like, kind


@F.pandas_udf(CLASSES)
def _stats(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sample_stats(d) for d in data], columns=CLASSES.names)


def classified(streams: DataFrame) -> DataFrame:
    """stream_id and the sample's statistics. Only the sample crosses to Python."""
    return streams.select("stream_id", _stats(F.substring("content", 1, SAMPLE)).alias("s")).select("stream_id", "s.*")


_COUNTS = pa.schema([("key", pa.string()), ("value", pa.int32()), ("n", pa.int64())])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """256 counts per key and batch; a batch's rows of one key are counted in one go."""
    values = np.arange(256, dtype=np.int32)
    for batch in batches:
        by_key: dict[str | None, np.ndarray] = {}
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if data.is_valid and (buffer := data.as_buffer()) is not None and buffer.size:
                by_key[key] = by_key.get(key, 0) + np.bincount(np.frombuffer(buffer, dtype=np.uint8), minlength=256)
        for key, counts in by_key.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * 256, pa.string()), pa.array(values), pa.array(counts)], schema=_COUNTS)


def byte_histogram(streams: DataFrame, key: str | None = None) -> DataFrame:
    """value (0 to 255), n over all bytes, by a string column if given. Counts, not bytes, are shuffled."""
    rows = streams.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), "content")
    counts = rows.mapInArrow(_partial_counts, "key string, value int, n long").where("n > 0")
    got = counts.groupBy("key", "value").agg(F.sum("n").alias("n"))
    return got.withColumnRenamed("key", key) if key else got.drop("key")

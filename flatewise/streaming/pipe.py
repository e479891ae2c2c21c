"""Streaming forms: compressing files as they arrive, and a decoder whose state outlives its chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import resume
from ..operators import codec

FILES = "path string, modificationTime timestamp, length long, content binary"
DECODED = "stream_id long, chunk long, data binary, members int, finished boolean, error string"
STATE = "next long, held array<struct<chunk: long, content: binary>>, phase string, pending binary, bit int, window binary, given long, tried long, crc long, n_out long, members int, error string"
#: Bytes of chunks that wait for an earlier one before the stream is given up.
MOST_HELD = 64 << 20


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, path, content of each file once it has arrived; stateless, so no watermark is needed."""
    rows = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.xxhash64("path").alias("stream_id"), "path", "content")


def compressed(streams: DataFrame, level: int = 6) -> DataFrame:
    """stream_id, path, payload: a self-indexing member each."""
    return streams.select("stream_id", "path", codec.encode_indexed("content", F.lit(min(level, 9))).alias("payload"))


def decode_chunks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One stream's chunks, numbered from 0, in that order: a row for each as soon as all before it have arrived.

    data is what the chunk makes known. members counts the members that have ended well so far, checksums included;
    finished says that the stream may end with this chunk. error is set from the first damage on, after which a stream has
    no more data; a chunk that comes again gives a row without data and the error repeated_chunk, and leaves the stream
    as it was. The state is bounded by the window, a block and the chunks that wait."""
    follows, held, decoder = 0, {}, resume.Resumable()
    if state.exists:
        follows, waiting, *fields = state.get
        held = {int(c): bytes(b) for c, b in waiting}
        decoder = resume.Resumable(*[bytes(f) if isinstance(f, (bytes, bytearray)) else f for f in fields])
    out = []
    for batch in batches:
        for number, content in zip(batch["chunk"], batch["content"]):
            if number < follows or number in held:
                out.append((key[0], int(number), b"", decoder.members, False, "repeated_chunk"))
            else:
                held[int(number)] = bytes(content or b"")
    while follows in held:
        data = decoder.feed(held.pop(follows))
        out.append((key[0], follows, data, decoder.members, decoder.at_end, decoder.error))
        follows += 1
    if decoder.error or sum(map(len, held.values())) > MOST_HELD:
        if not decoder.error:
            decoder.fail("missing_chunk")
        out += [(key[0], number, b"", decoder.members, False, decoder.error) for number in sorted(held)]
        follows, held = max([follows, *(n + 1 for n in held)]), {}
    state.update((follows, sorted(held.items()), *decoder.state()))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in DECODED.split(", ")])


def decoded(chunks: DataFrame) -> DataFrame:
    """A streaming (stream_id, chunk, content) decoded piece by piece, state kept per stream."""
    return chunks.groupBy("stream_id").applyInPandasWithState(decode_chunks, DECODED, STATE, "append", GroupStateTimeout.NoTimeout)

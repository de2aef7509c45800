"""Contents that arrive in segments, and chunks that are new."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from corestrata.functions.cutting import Cutter
from corestrata.functions.profiles import Profile

_STATE = "next long, off long, gear_high long, gear_low long, open binary, waiting_at array<long>, waiting array<binary>, end_at long"


def cut_segments(segments: DataFrame, profile: Profile) -> DataFrame:
    """segments: a stream of (content_id long, seq long, bytes binary, last boolean), in any order. Emits (content_id, off, len, id) as soon as a chunk is sure.

    The state of a content is its open chunk (its bytes for the digest, the cutter's length and hash) and segments
    that came too early; it is dropped after the last segment.
    """

    def step(key, frames: Iterator[pd.DataFrame], state):
        following, off, high, low, open_, at, early, end = state.get if state.exists else (0, 0, 0, 0, b"", [], [], -1)
        waiting = dict(zip(at, map(bytes, early), strict=True))
        for pdf in frames:
            for seq, raw, is_last in zip(pdf["seq"], pdf["bytes"], pdf["last"], strict=True):
                if seq >= following:
                    waiting[int(seq)] = bytes(raw or b"")
                if is_last:
                    end = int(seq)
        open_ = bytes(open_)
        cutter = Cutter(profile, len(open_), (int(high) & 0xFFFFFFFF) << 32 | int(low) & 0xFFFFFFFF)
        rows = []

        def emit(lengths):
            nonlocal off, open_
            for n in lengths:
                rows.append((key[0], off, n, hashlib.sha256(open_[:n]).hexdigest()))
                off, open_ = off + n, open_[n:]

        while following in waiting:
            raw = waiting.pop(following)
            open_ += raw
            emit(cutter.feed(raw))
            following += 1
        if end >= 0 and following > end:
            emit(cutter.finish())
            state.remove()
        else:
            state.update((following, off, cutter.gear >> 32, cutter.gear & 0xFFFFFFFF, open_, list(waiting), list(waiting.values()), end))
        yield pd.DataFrame(rows, columns=["content_id", "off", "len", "id"])

    return segments.groupBy("content_id").applyInPandasWithState(step, "content_id long, off long, len long, id string", _STATE, "append", "NoTimeout")


def first_seen(chunks: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Chunks whose id the stream has not had before; with a time column only as far back as the watermark reaches, which bounds the state."""
    if time is None:
        return chunks.dropDuplicates(["id"])
    return chunks.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


def file_stream(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """New files of a folder as (path, bytes)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path).selectExpr("path", "content AS bytes")

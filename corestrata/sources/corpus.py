"""Synthetic contents by seed, for measuring: each kind is a recipe of a few lines over bytes drawn at once."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corestrata.functions.hashing import SplitMix


def _random(size: int, r: SplitMix, symbols: int = 256) -> np.ndarray:
    raw = np.frombuffer(r.fill(size), np.uint8)
    return raw if symbols == 256 else raw % np.uint8(symbols)


def _tiled(size: int, r: SplitMix, period: int) -> np.ndarray:
    return np.resize(_random(min(period, size), r), size)


def _where(size: int, *widths: int) -> np.ndarray:
    """At each byte, which of the stretches of these widths it lies in, over and over."""
    return np.resize(np.repeat(np.arange(len(widths), dtype=np.uint8), widths), size)


def _archive(size: int, r: SplitMix) -> np.ndarray:
    """Assets of 16 to 112 KiB, every fourth of which comes again from those before; each begins with its number."""
    out, at, kept = np.empty(size, np.uint8), 0, []
    while at < size:
        part = kept[r.below(len(kept))] if len(kept) % 4 == 3 else _random((16 << 10) + r.below(96 << 10), r)
        kept.append(part)
        name = np.frombuffer(f"ASSET{len(kept):011d}".encode(), np.uint8)
        for x in (name, part):
            n = min(len(x), size - at)
            out[at : at + n] = x[:n]
            at += n
    return out


def _program(size: int, r: SplitMix) -> np.ndarray:
    """A third code of few symbols, padding between, and data: by 12 KiB of code, 4 of zeros and 8 of random bytes."""
    where = _where(size, 12 << 10, 4 << 10, 8 << 10)
    return np.choose(where, [_random(size, r, 48), np.zeros(size, np.uint8), _random(size, r)])


def _pages(size: int, r: SplitMix) -> np.ndarray:
    """Pages of 8 KiB: 32 bytes of header, a kilobyte of records of which half recur on every page, free space."""
    where = _where(size, 32, 512, 512, (8 << 10) - 1056)
    return np.choose(where, [np.full(size, 0xDB, np.uint8), _tiled(size, r, 8 << 10), _random(size, r), np.zeros(size, np.uint8)])


def _compressed(size: int, r: SplitMix) -> np.ndarray:
    out = b""
    while len(out) < size:
        out += zlib.compress(_random(512 << 10, r, 24).tobytes(), 1)
    return np.frombuffer(out[:size], np.uint8)


def _runs(size: int, r: SplitMix) -> np.ndarray:
    """Random bytes in which, about every mebibyte, a run of one byte of up to 512 KiB lies."""
    out = _random(size, r).copy()
    for at in range(0, size, 1 << 20):
        begin = at + r.below(512 << 10)
        out[begin : begin + r.below(512 << 10)] = r.below(256)
    return out


_RECIPES: dict[str, Callable[[int, SplitMix], np.ndarray]] = {
    "zero": lambda n, r: np.zeros(n, np.uint8),
    "random": _random,
    "random-like": lambda n, r: _random(n, r) ^ np.uint8(r.below(256)),
    "repeated": lambda n, r: _tiled(n, r, 4096),
    "low-entropy": lambda n, r: _random(n, r, 16),
    "game-pak-like": _archive,
    "executable-app-like": _program,
    "db-vm-data-like": _pages,
    "compressed-like": _compressed,
    "single-byte": lambda n, r: np.full(n, 1 + r.below(255), np.uint8),
    "short-pattern": lambda n, r: _tiled(n, r, 7),
    "alternating-entropy": lambda n, r: _random(n, r) & np.where(_where(n, 128 << 10, 128 << 10) == 0, np.uint8(255), np.uint8(3)),
    "low-entropy-runs": _runs,
}
KINDS = tuple(_RECIPES)


def generate(kind: str, size: int, seed: int) -> bytes:
    """size bytes of a kind; the compressed kind depends on the zlib at hand."""
    if size <= 0:
        raise ValueError("the size must be positive")
    if kind not in _RECIPES:
        raise ValueError(f"unknown kind {kind}")
    return _RECIPES[kind](size, SplitMix(seed)).tobytes()


def synthetic(spark: SparkSession, entries: list[tuple[str, str, int, int]]) -> DataFrame:
    """entries (id, kind, size, seed) -> (content_id, kind, bytes), made on the executors, one task an entry at most."""
    schema = pa.schema([("content_id", pa.string()), ("kind", pa.string()), ("bytes", pa.binary())])

    def run(source):
        for batch in source:
            for i, kind, size, seed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([kind]), pa.array([generate(kind, size, seed)], pa.binary())], schema=schema)

    rows = spark.createDataFrame(entries, "content_id string, kind string, size long, seed long").repartition(max(1, len(entries)))
    return rows.mapInArrow(run, "content_id string, kind string, bytes binary")

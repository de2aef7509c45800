"""Edits of contents, by seed: what changed, where, and on what basis it is counted."""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corestrata.functions.cutting import cut
from corestrata.functions.profiles import Profile

KINDS = ("insert", "prepend", "append", "delete", "overwrite", "localized-rewrite", "random-rewrite", "move", "reorder", "identity")


@dataclass(frozen=True)
class Edit:
    """A target; the stretch of it outside of which it is the source; and so many changed bytes, counted on a basis."""

    target: bytes
    start: int
    end: int
    changed: int
    basis: str


def draw(seed: int, what: str, limit: int) -> int:
    """A number below limit that depends on the seed and on what it is for, so that no draw shifts another."""
    return _drawn(seed, what) % max(1, limit)


@functools.lru_cache(1 << 10)
def _drawn(seed: int, what: str) -> int:
    return int(hashlib.md5(f"{what}/{seed}".encode(), usedforsecurity=False).hexdigest()[:15], 16)


def filler(seed: int, what: str, size: int) -> bytes:
    return b"".join(hashlib.sha256(f"{what}/{seed}/{k}".encode()).digest() for k in range(-(-size // 32)))[:size]


@functools.lru_cache(1 << 14)
def _new_byte(seed: int, place: int) -> bytes:
    return filler(seed, f"new/{place}", 1)


def pieces(kind: str, n: int, size: int, seed: int) -> tuple[list[tuple[int, int] | bytes], str]:
    """The target of an edit of n bytes as stretches of the source and new bytes, in order, and the basis of counting. An edit that has no room gives the whole source."""
    whole: list[tuple[int, int] | bytes] = [(0, n)]
    if kind == "identity":
        return whole, "none"
    if size <= 0:
        raise ValueError("the size must be positive")
    if kind in ("insert", "prepend", "append"):
        at = {"prepend": 0, "append": n}.get(kind, draw(seed, "place", n + 1))
        return [(0, at), filler(seed, "fill", size), (at, n)], "inserted"
    if kind in ("delete", "overwrite"):
        size = min(size, n)
        at = draw(seed, "place", n - size + 1)
        return [(0, at), filler(seed, "fill", size) if kind == "overwrite" else b"", (at + size, n)], "deleted" if kind == "delete" else "differing"
    if kind in ("localized-rewrite", "random-rewrite"):  # single bytes: within a stretch of twice the size, or anywhere
        reach = min(n, 2 * size) if kind[0] == "l" else n
        low = draw(seed, "place", n - reach + 1)
        places = {low + draw(seed, f"byte/{k}", reach) for k in range(min(size, reach))}
        out, at = [], 0
        for p in sorted(places):
            out += [(at, p), _new_byte(seed, p)]
            at = p + 1
        return [*out, (at, n)], "differing"
    size = min(size, n // 2)
    if kind not in ("move", "reorder"):
        raise ValueError(f"unknown kind of edit {kind}")
    if not size:
        return whole, "none"
    if kind == "move":  # a block changes places with the stretch between it and where it goes
        a = draw(seed, "block", n - size + 1)
        to = draw(seed, "gap", n - size)
        low, mid, high = (to, a, a + size) if to < a else (a, a + size, to + 1 + size)
        return [(0, low), (mid, high), (low, mid), (high, n)], "moved"
    first = draw(seed, "first", n // size)
    second = (first + 1 + draw(seed, "second", n // size - 1)) % (n // size)
    a, b = sorted((first * size, second * size))
    return [(0, a), (b, b + size), (a + size, b), (a, a + size), (b + size, n)], "swapped"


def mutate(source: bytes, kind: str, size: int, seed: int) -> Edit:
    parts, basis = pieces(kind, len(source), size, seed)
    target = b"".join(p if isinstance(p, bytes) else source[p[0] : p[1]] for p in parts)
    if basis == "none":
        return Edit(target, 0, 0, 0, basis)
    if basis == "differing":  # new bytes may equal the old ones
        where = np.flatnonzero(np.frombuffer(source, np.uint8) != np.frombuffer(target, np.uint8))
        return Edit(target, int(where[0]), int(where[-1]) + 1, len(where), basis) if len(where) else Edit(target, 0, 0, 0, basis)
    start = parts[0][1]
    end = len(target) - (parts[-1][1] - parts[-1][0])
    changed = {"inserted": end - start, "deleted": len(source) - len(target), "moved": min(size, len(source) // 2), "swapped": 2 * min(size, len(source) // 2)}[basis]
    return Edit(target, start, end, changed, basis)


def boundary_edit(source: bytes, profile: Profile, anchor: str = "boundary", relative: int = 0) -> Edit | None:
    """One byte, XOR 0x5A, at the boundary (or minimum) of the middle content-defined chunk; None where there is none."""
    lengths = cut(source, profile)
    ends = np.cumsum([0, *lengths]).tolist()
    inner = [i for i, n in enumerate(lengths[:-1]) if profile.minimum < n < profile.maximum]
    if not inner:
        return None
    i = inner[len(inner) // 2]
    at = (ends[i + 1] if anchor == "boundary" else ends[i] + profile.minimum) + relative
    if not 0 <= at < len(source):
        return None
    target = bytearray(source)
    target[at] ^= 0x5A
    return Edit(bytes(target), at, at + 1, 1, "differing")


def edited(source: bytes, job: tuple[str, str, int, int], profile: Profile | None) -> Edit | None:
    """A job (name, kind, size, seed) done; a boundary edit's size is its relative place."""
    _, kind, size, seed = job
    return boundary_edit(source, profile, relative=size) if kind == "boundary-edit" else mutate(source, kind, size, seed)


def _edits(place: int, names: list[str], jobs: list[tuple[str, str, int, int]], profile: Profile | None):
    def run(source):
        for batch in source:
            rows, out = [], []
            for r, raw in enumerate(batch.column(place).to_pylist()):
                for job in jobs:
                    e = edited(raw or b"", job, profile)
                    rows.append(r)
                    out.append((job[0], None, None, None, None, None) if e is None else (job[0], e.target, e.start, e.end, e.changed, e.basis))
            take = pa.array(rows, pa.int64())
            kept = [c.take(take) for j, c in enumerate(batch.columns) if j != place]
            types = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(kept + cols, names=names)

    return run


def mutated(content: DataFrame, jobs: list[tuple[str, str, int, int]], profile: Profile | None = None) -> DataFrame:
    """Each content under each job (name, kind, size, seed): (keys..., mutation, bytes, affected_start, affected_end, changed_bytes, basis). bytes is null where a boundary edit has no anchor."""
    keys = [c for c in content.columns if c != "bytes"]
    types = dict(content.dtypes)
    names = [*keys, "mutation", "bytes", "affected_start", "affected_end", "changed_bytes", "basis"]
    return content.mapInArrow(_edits(content.columns.index("bytes"), names, jobs, profile), ", ".join([*(f"`{k}` {types[k]}" for k in keys), "mutation string, bytes binary, affected_start long, affected_end long, changed_bytes long, basis string"]))


# The same edits with given places and fills, as expressions.


def inserted(at, fill: bytes):
    return F.concat(F.substring("bytes", F.lit(1), at.cast("int")), F.lit(fill), F.substring("bytes", (at + 1).cast("int"), F.octet_length("bytes")))


def deleted(at, size):
    return F.concat(F.substring("bytes", F.lit(1), at.cast("int")), F.substring("bytes", (at + size + 1).cast("int"), F.octet_length("bytes")))


def overwritten(at, fill: bytes):
    n = F.octet_length("bytes")
    return F.concat(F.substring("bytes", F.lit(1), at.cast("int")), F.substring(F.lit(fill), F.lit(1), (n - at).cast("int")), F.substring("bytes", (at + len(fill) + 1).cast("int"), n))


def moved(origin, to, size):
    """to is a place in what is left without the block."""
    rest = deleted(origin, size)
    block = F.substring("bytes", (origin + 1).cast("int"), F.least(size, F.octet_length("bytes")).cast("int"))
    return F.concat(F.substring(rest, F.lit(1), to.cast("int")), block, F.substring(rest, (to + 1).cast("int"), F.octet_length("bytes")))

"""A full run: every lane over every content and edit, measured alike, as one table."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corestrata.functions.cutting import cut_all
from corestrata.functions.profiles import Profile
from corestrata.operators import chunking, metrics, mutations, reuse

#: Measures of a row, in the order of its columns.
MEASURES = ("source_chunks", "target_chunks", "reused_bytes", "missing_bytes", "survival", "resync_distance", "resync_status")


#: Bytes of contents and their edits that are cut together.
TOGETHER = 1 << 20
_MEASURED = pa.schema([("mutation", pa.string()), ("lane", pa.string()), ("changed_bytes", pa.int64()), ("source_chunks", pa.int64()), ("target_chunks", pa.int64()), ("reused_bytes", pa.int64()), ("missing_bytes", pa.int64()), ("survival", pa.float64()), ("resync_distance", pa.int64()), ("resync_status", pa.string())])


def _named(data: bytes, lengths: list[int], names: dict[bytes, int]) -> list[int]:
    """Chunks as numbers, the same for the same bytes."""
    out, at = [], 0
    for n in lengths:
        out.append(names.setdefault(data[at : at + n], len(names)))
        at += n
    return out


def _compared(a: list[int], b: list[int], sizes: list[int], e: mutations.Edit) -> tuple:
    """The measures of chunks b (of these sizes), given the chunks a of the source."""
    known = set(a)
    reused = sum(n for x, n in zip(b, sizes, strict=True) if x in known)
    survival = 1.0
    if len(a) > 1:
        pairs, others = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
        survival = sum(min(n, others[x]) for x, n in pairs.items()) / (len(a) - 1)
    distance, status = None, "not-applicable"
    if e.changed and e.end < len(e.target):
        tail = 0
        while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        at = len(e.target)
        status = "not-resynchronized"
        for i in range(len(b) - 1, max(1, len(b) - tail) - 1, -1):
            at -= sizes[i]
            if at < e.end:
                break
            distance, status = at - e.end, "resynchronized"
    return len(a), len(b), reused, len(e.target) - reused, survival, distance, status


def _measured(content: DataFrame, lanes: dict[str, Profile], jobs: list[tuple[str, str, int, int]], profile: Profile | None) -> DataFrame:
    """run() by content-defined lanes: a content is edited, cut and compared where it lies, and only measures come back. Rows are contents of their own, whatever their keys."""
    keys = [c for c in content.columns if c != "bytes"]
    types = dict(content.dtypes)
    place = content.columns.index("bytes")
    profiles = list(lanes.values())

    def compare(group: list[tuple[int, bytes, list]]) -> list[tuple]:
        cuts = cut_all([c for _, raw, edits in group for c in (raw, *(e.target for _, e in edits))], profiles)
        out, k = [], 0
        for r, raw, edits in group:
            names: dict[bytes, int] = {}
            for lane, lengths in zip(lanes, cuts, strict=True):
                a = _named(raw, lengths[k], names)
                for j, (name, e) in enumerate(edits, k + 1):
                    out.append((r, name, lane, e.changed, *_compared(a, _named(e.target, lengths[j], names), lengths[j], e)))
            k += 1 + len(edits)
        return out

    def run(source):
        for batch in source:
            rows, group, held = [], [], 0
            for r, value in enumerate(batch.column(place)):
                raw = value.as_py() or b""
                edits = [(job[0], e) for job in jobs if (e := mutations.edited(raw, job, profile)) is not None]
                group.append((r, raw, edits))
                held += len(raw) + sum(len(e.target) for _, e in edits)
                if held >= TOGETHER:
                    rows += compare(group)
                    group, held = [], 0
            rows += compare(group)
            which, *cols = zip(*rows, strict=True) if rows else [()] * (1 + len(_MEASURED))
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for j, c in enumerate(batch.columns) if j != place), *(pa.array(c, f.type) for c, f in zip(cols, _MEASURED, strict=True))], names=[*keys, *_MEASURED.names])

    told = {"string": "string", "int64": "long", "double": "double"}
    return content.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"{f.name} {told[str(f.type)]}" for f in _MEASURED)]))


def run(content: DataFrame, lanes: dict[str, Profile | int], jobs: list[tuple[str, str, int, int]], profile: Profile | None = None) -> DataFrame:
    """(keys..., mutation, lane, changed_bytes, MEASURES...): each content under each job (as mutations.mutated() has them), cut by each lane before and after.

    Lanes and jobs are few and told by the caller; contents are a table of any size, edited once for all fixed lanes, whose chunks are compared by joins, and once for all content-defined ones, which go through Python anyway and are compared there, without a shuffle.
    """
    fixed = {k: v for k, v in lanes.items() if isinstance(v, int)}
    defined = {k: v for k, v in lanes.items() if k not in fixed}
    parts = [_joined(content, fixed, jobs, profile)] if fixed else []
    parts += [_measured(content, defined, jobs, profile)] if defined else []
    keys = [c for c in content.columns if c != "bytes"]
    return reduce(DataFrame.unionByName, parts).select(*keys, "mutation", "lane", "changed_bytes", *MEASURES)


def _joined(content: DataFrame, lanes: dict[str, int], jobs: list[tuple[str, str, int, int]], profile: Profile | None) -> DataFrame:
    """run() by fixed lanes."""
    keys = [c for c in content.columns if c != "bytes"]
    pair = [*keys, "mutation"]
    edited = mutations.mutated(content, jobs, profile).where("bytes is not null")
    before = edited.select(*pair).join(content, keys)
    parts = []
    for name, lane in lanes.items():
        a, b = chunking.fixed_chunks(before.select(*pair, "bytes"), lane), chunking.fixed_chunks(edited.select(*pair, "bytes"), lane)
        count = lambda c, n: c.groupBy(*pair).agg(F.count(F.lit(1)).alias(n))
        known = a.groupBy(*pair, "id").agg(F.lit(True).alias("known"))
        held = b.groupBy(*pair, "id").agg(F.sum("len").alias("bytes")).join(known, [*pair, "id"], "left").groupBy(*pair).agg(F.sum(F.when(F.col("known"), F.col("bytes")).otherwise(0)).alias("reused_bytes"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("bytes"))).alias("missing_bytes"))
        edits = edited.select(*pair, "affected_end", "changed_bytes")
        sync = metrics.resynchronization(a, b, edits, pair).select(*pair, F.col("distance").alias("resync_distance"), F.col("status").alias("resync_status"))
        row = edits.select(*pair, "changed_bytes")
        for part in (count(a, "source_chunks"), count(b, "target_chunks"), held, metrics.boundary_survival(a, b, pair).select(*pair, "survival"), sync):
            row = row.join(part, pair, "left")
        zero = {c: 0 for c in ("source_chunks", "target_chunks", "reused_bytes", "missing_bytes")} | {"survival": 1.0}
        parts.append(row.na.fill(zero).withColumn("lane", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def report(rows: DataFrame) -> DataFrame:
    """A row for each lane and mutation, in the order lane, mutation kind, contents (byte by byte): position, means and the share of contents that meet again."""
    done = rows.groupBy("lane", "mutation").agg(F.count(F.lit(1)).alias("contents"), F.avg("survival").alias("survival"), F.sum("reused_bytes").alias("reused_bytes"), F.sum("missing_bytes").alias("missing_bytes"), F.avg((F.col("resync_status") == "resynchronized").cast("double")).alias("resynchronized"))
    # A row for each lane and mutation: as few as the caller named.
    return done.withColumn("position", F.row_number().over(Window.orderBy(F.encode("lane", "UTF-8"), F.encode("mutation", "UTF-8"), "contents")))

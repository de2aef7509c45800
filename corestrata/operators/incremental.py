"""New chunk tables from old ones and edits, cutting only what the edits can reach."""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corestrata.functions.cutting import recut_apart
from corestrata.functions.profiles import Profile


def rechunk(chunks: DataFrame, edited: DataFrame, keys: list[str], profile: Profile) -> DataFrame:
    """chunks: old ones (keys..., idx, len, id); edited: (keys..., bytes, splices), splices an array of (start, old_end, new_end) in order, each in the coordinates that the ones before have left.

    Returns the new chunks (keys..., idx, off, len, id, reused, scanned): equal to cutting anew. Only what the
    edits reach is cut and hashed; between edits that lie apart old chunks stay, with their ids (reused).
    """
    old = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "len", "id"))).alias("old"))
    joined = edited.join(old, keys, "left").select(*keys, "bytes", "splices", "old.len", "old.id")
    types = dict(joined.dtypes)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())

    def run(source):
        for batch in source:
            rows, cols = [], []
            for r, (splices, lengths, ids) in enumerate(zip(*(batch.column(len(keys) + i).to_pylist() for i in (1, 2, 3)), strict=True)):
                raw = memoryview(batch.column(len(keys))[r].as_buffer() or b"")
                edits = [(s["start"], s["old_end"], s["new_end"]) for s in splices or []]
                new, kept, scanned = recut_apart(raw, lengths or [], edits, profile)
                known = {i + k: ids[j + k] for i, j, n in kept for k in range(n)}
                for i, (off, n) in enumerate(zip(itertools.accumulate([0, *new[:-1]]), new, strict=True)):
                    rows.append(r)
                    cols.append((i, off, n, known.get(i) or hashlib.sha256(raw[off : off + n]).hexdigest(), i in known, scanned))
            take = pa.array(rows, pa.int64())
            out = [pa.array(c, t) for c, t in zip(zip(*cols, strict=True), kinds, strict=True)] if cols else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(len(keys))] + out, names=[*keys, "idx", "off", "len", "id", "reused", "scanned"])

    return joined.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "idx long, off long, len long, id string, reused boolean, scanned long"]))

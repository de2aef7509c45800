"""Contents to ordered chunk rows: (keys..., idx, off, len, id)."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corestrata.functions import fixed
from corestrata.functions.cutting import cut
from corestrata.functions.hashing import Digests
from corestrata.functions.profiles import Profile

def contents(table: DataFrame, keys: dict[str, Column | str], value: Column) -> DataFrame:
    """(keys..., bytes) from a table's text or binary column; null counts as empty."""
    named = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in keys.items()]
    return table.select(*named, F.coalesce(F.encode(value, "UTF-8") if not dict(table.select(value.alias("v")).dtypes)["v"] == "binary" else value, F.lit(b"")).alias("bytes"))


def fixed_chunks(content: DataFrame, size: int, payload: bool = False) -> DataFrame:
    """A chunk every size bytes, the remainder last; an empty content has none. Native: no Python, no shuffle."""
    keys = [c for c in content.columns if c != "bytes"]
    n = F.octet_length("bytes")
    step = (F.lit(size) * F.greatest(F.lit(1), F.ceil(F.sqrt(n / size)))).cast("long")
    part = content.where(n > 0).select(*keys, "bytes", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / step).cast("long"))).alias("p"))
    base = F.col("p") * F.col("step")
    # First into as many stretches as each has chunks: substring copies the whole of its input every time.
    stretch = part.select(*keys, base.alias("base"), F.substring("bytes", (base + 1).cast("int"), F.col("step").cast("int")).alias("bytes"))
    m = F.octet_length("bytes")
    cut_at = stretch.select(*keys, "base", "bytes", F.explode(F.sequence(F.lit(0), F.floor((m - 1) / size).cast("int"))).alias("i"))
    piece = F.substring(F.col("bytes"), F.col("i") * size + 1, F.lit(size))
    out = cut_at.select(*keys, (F.floor(F.col("base") / size) + F.col("i")).cast("long").alias("idx"), (F.col("base") + F.col("i") * F.lit(size).cast("long")).alias("off"), F.octet_length(piece).cast("long").alias("len"), F.sha2(piece, 256).alias("id"), *([piece.alias("payload")] if payload else []))
    return out


def cdc_chunks(content: DataFrame, profile: Profile, suite: str = fixed.SHA256_SUITE, payload: bool = False, on_chunk: Callable | None = None) -> DataFrame:
    """Content-defined chunks with ids of the suite.

    One pass over Arrow batches (which Spark bounds by spark.sql.execution.arrow.maxBytesPerBatch), without a shuffle; contents are cut and hashed where they lie in the batch, and bytes return to Spark only where payload asks for them. on_chunk(index, offset,
    bytes) -> value, if given, adds a binary column value for each chunk, in order.
    """
    keys = [c for c in content.columns if c != "bytes"]
    types = dict(content.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "idx long, off long, len long", *(["payload binary"] if payload else []), "id string", *(["value binary"] if on_chunk else [])])
    place = content.columns.index("bytes")

    def run(source):
        for batch in source:
            rows, idx, off, size, data, ids, values = [], [], [], [], [], [], []
            hashed = Digests(suite)
            for r, value in enumerate(batch.column(place)):
                raw = memoryview(value.as_buffer() or b"")  # of the batch itself: nothing is copied
                lengths = cut(raw, profile)
                starts = list(itertools.accumulate(lengths, initial=0))[:-1]
                rows += [r] * len(lengths)
                idx += range(len(lengths))
                off += starts
                size += lengths
                parts = [raw[at : at + n] for at, n in zip(starts, lengths, strict=True)]
                ids += hashed.add(parts)
                if payload:
                    data += parts
                if on_chunk:
                    values += [on_chunk(i, at, bytes(part)) for i, (at, part) in enumerate(zip(starts, parts, strict=True))]
            ids += hashed.rest()
            take = pa.array(rows, pa.int64())
            out = [c.take(take) for j, c in enumerate(batch.columns) if j != place] + [pa.array(x, pa.int64()) for x in (idx, off, size)]
            names = [*keys, "idx", "off", "len"]
            for name, made, kind, use in (("payload", data, pa.binary(), payload), ("id", ids, pa.string(), True), ("value", values, pa.binary(), bool(on_chunk))):
                if use:
                    out.append(pa.array(made, kind))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(out, names=names)

    return content.mapInArrow(run, schema)


def with_index(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """idx from the order of offsets."""
    return chunks.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("off")) - 1).cast("long"))


def with_offsets(records: DataFrame, keys: list[str]) -> DataFrame:
    """off from idx and the lengths before."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("off", F.sum("len").over(w) - F.col("len"))


def records(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """What a manifest keeps: order, id and length."""
    return chunks.select(*keys, "idx", "id", "len")


def broken(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of no length or whose offset isn't the sum of the lengths before; a sound table has none."""
    return with_offsets(chunks.withColumnRenamed("off", "said"), keys).where("len <= 0 or said <> off").select(*keys, "idx", "said", "off", "len")


def interior(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """All chunks but each content's last, whose end is a boundary."""
    w = Window.partitionBy(*keys).orderBy("idx")
    return chunks.withColumn("next", F.lead("idx").over(w)).where("next is not null").drop("next")

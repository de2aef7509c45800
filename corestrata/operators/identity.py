"""Ordered folds: identities of manifests, sequences and trees, in Spark's own functions; and verification against contents."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corestrata.functions import fixed

BLOCK = 4096


def _le(value: Column, size: int) -> Column:
    """A number's little-endian bytes as upper-case hexadecimal digits."""
    big = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*(F.substring(big, 2 * i + 1, 2) for i in reversed(range(size))))


def _hex(raw: bytes) -> Column:
    return F.lit(raw.hex().upper())


def _entries() -> Column:
    """Ids and lengths of a group, in order; chunks of one group are one content's, so the list is as long as its manifest."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "id", "len")))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.upper(r["id"]), _le(r["len"], 4))), "")


def manifest_ids(records: DataFrame, keys: list[str], suite: str, profile_id: str, fingerprint: str, everyone: DataFrame | None = None) -> DataFrame:
    """(keys..., manifest_id, chunks, bytes) of SHA-256 manifests; with everyone, contents without chunks are there too."""
    if suite != fixed.SHA256_SUITE:
        raise ValueError("Spark folds SHA-256 alone; other suites go through the manifest writer")
    s, p = suite.encode(), profile_id.encode()
    head = fixed.MANIFEST_DOMAIN + len(s).to_bytes(2, "little") + s + len(p).to_bytes(2, "little") + p + bytes.fromhex(fingerprint)
    folded = records.groupBy(*keys).agg(_entries().alias("entries"), F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes"))
    if everyone is not None:
        folded = everyone.select(*keys).distinct().join(folded, keys, "left").select(*keys, F.coalesce("entries", F.lit("")).alias("entries"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    whole = F.unhex(F.concat(_hex(head), F.col("entries"), _le(F.col("chunks"), 8), _le(F.col("bytes"), 8)))
    return folded.select(*keys, F.sha2(whole, 256).alias("manifest_id"), "chunks", "bytes")


def sequence_digests(records: DataFrame, keys: list[str]) -> DataFrame:
    folded = records.groupBy(*keys).agg(_entries().alias("entries"), F.count(F.lit(1)).alias("chunks"))
    return folded.select(*keys, F.sha2(F.unhex(F.concat(_hex(fixed.SEQUENCE_DOMAIN), _le(F.col("chunks"), 8), F.col("entries"))), 256).alias("sequence_digest"))


def layout_digests(files: DataFrame, keys: list[str]) -> DataFrame:
    """files: (keys..., path, length, sha256). The digest of a tree's files in the order of their paths."""
    rows = F.sort_array(F.collect_list(F.struct(F.encode("path", "UTF-8").alias("p"), "length", "sha256")))
    line = lambda r: F.concat(_le(F.octet_length(r["p"]), 4), F.hex(r["p"]), _le(r["length"], 8), F.upper(r["sha256"]))
    return files.groupBy(*keys).agg(F.sha2(F.unhex(F.array_join(F.transform(rows, line), "")), 256).alias("layout_sha256"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def tree_identities(entries: DataFrame, keys: list[str]) -> DataFrame:
    """entries: (keys..., path, kind, length, sha256, exec, link), kind one of directory, file, symlink."""
    rows = F.sort_array(F.collect_list(F.struct(F.encode("path", "UTF-8").alias("p"), "kind", "length", "sha256", "exec", F.encode("link", "UTF-8").alias("l"))))
    text = lambda b: F.concat(_le(F.octet_length(b), 4), F.hex(b))
    line = lambda r: F.concat(F.when(r["kind"] == "directory", "01").when(r["kind"] == "file", "02").otherwise("03"), text(r["p"]), F.when(r["kind"] == "file", F.concat(_le(r["length"], 8), F.upper(r["sha256"]), F.when(r["exec"], "01").otherwise("00"))).when(r["kind"] == "symlink", text(r["l"])).otherwise(""))
    return entries.groupBy(*keys).agg(F.sha2(F.unhex(F.concat(_hex(fixed.TREE_DOMAIN), _le(F.count(F.lit(1)), 4), F.array_join(F.transform(rows, line), ""))), 256).alias("tree_id"))


def block_index(chunks: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """The first chunk and content offset of each block."""
    return chunks.withColumn("block", F.floor(F.col("idx") / block)).groupBy(*keys, "block").agg(F.min("idx").alias("first_idx"), F.min("off").alias("first_off"), F.count(F.lit(1)).alias("chunks"))


def verify_records(manifest: DataFrame, content: DataFrame, keys: list[str]) -> DataFrame:
    """Per content whether each record's bytes have its id, the lowest index that differs, and whether the lengths add up. No re-chunking; records gather by content first, so that each content is read once, and ranges are hashed where they lie in the Arrow batch (Spark's substring would copy the content for every record)."""
    told = manifest.groupBy(*keys).agg(F.collect_list(F.struct("idx", "off", "len", "id")).alias("records"))
    joined = content.join(told, keys).select(*keys, "bytes", "records")
    types = dict(joined.dtypes)

    def run(source):
        for batch in source:
            lists = batch.column(len(keys) + 1)
            ends, flat = lists.offsets.to_pylist(), lists.values
            idx, off, size = (flat.field(c).to_pylist() for c in ("idx", "off", "len"))
            ids = flat.field("id").to_pylist()
            out = []
            for value, a, b in zip(batch.column(len(keys)), ends[:-1], ends[1:], strict=True):
                view = memoryview(value.as_buffer() or b"")
                bad = [idx[k] for k in range(a, b) if hashlib.sha256(view[off[k] : off[k] + size[k]]).hexdigest() != ids[k]]
                out.append((min(bad, default=None), len(bad), sum(size[a:b]) == len(view)))
            first, n, whole = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(whole, pa.bool_())], names=[*keys, "first_bad", "bad", "whole"])

    return joined.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "first_bad long, bad long, whole boolean"]))


def range_groups(chunks: DataFrame, keys: list[str], most: int = 4 << 20) -> DataFrame:
    """Ranges of consecutive records of most bytes at most, a longer record alone: (keys..., range, off, len, records)."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "off", "len")))
    step = lambda acc, r: F.struct((F.when((acc["size"] + r["len"] > most) & (acc["size"] > 0), acc["range"] + 1).otherwise(acc["range"])).alias("range"), (F.when((acc["size"] + r["len"] > most) & (acc["size"] > 0), r["len"]).otherwise(acc["size"] + r["len"])).alias("size"), F.concat(acc["out"], F.array(F.struct(F.when((acc["size"] + r["len"] > most) & (acc["size"] > 0), acc["range"] + 1).otherwise(acc["range"]).alias("range"), r["off"].alias("off"), r["len"].alias("len")))).alias("out"))
    zero = F.struct(F.lit(0).cast("int").alias("range"), F.lit(0).cast("long").alias("size"), F.expr("cast(array() as array<struct<range:int,off:bigint,len:bigint>>)").alias("out"))
    placed = chunks.groupBy(*keys).agg(F.aggregate(rows, zero, step)["out"].alias("out"))
    flat = placed.select(*keys, F.explode("out").alias("r"))
    return flat.groupBy(*keys, F.col("r.range").alias("range")).agg(F.min("r.off").alias("off"), F.sum("r.len").alias("len"), F.count(F.lit(1)).alias("records"))

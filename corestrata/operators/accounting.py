"""What a tree's update weighs, file by file: each against its own path, on its own, or against the whole old tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corestrata.operators import trees
from corestrata.operators.patches import framing_size, manifest_size

#: Bytes of a file in a tree's map besides its path, and of the map besides its files.
MAP_ENTRY, MAP_HEADER = 46, 4


def file_costs(old: DataFrame, new: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each changed or added file: path, status, length, same_path, own, whole_tree, the bytes of its update in three lanes, with entries stored raw.

    same_path: a patch against the old file of that path; an added file travels as it is. own: the same, but an
    added file as a patch without a base. whole_tree: a patch against the chunks of all old files. Ids are reduced
    to one row a file before the joins, which go by id, so that a chunk that every file has is no hot key.
    """
    touched = trees.diff(old, new, keys).where("status in ('added', 'changed')").select(*keys, "path", "status", F.col("new_length").alias("length"))
    same = old_chunks.select(*keys, "path", "id").distinct().withColumn("same", F.lit(True))
    whole = old_chunks.select(*keys, "id").distinct().withColumn("whole", F.lit(True))
    ids = new_chunks.groupBy(*keys, "path", "id").agg(F.count(F.lit(1)).alias("n"), F.min("len").alias("len")).join(touched.select(*keys, "path"), [*keys, "path"], "left_semi")
    seen = ids.join(same, [*keys, "path", "id"], "left").join(whole, [*keys, "id"], "left")
    lack = lambda name, cond: (F.count_if(cond).alias(f"n_{name}"), F.sum(F.when(cond, F.col("len"))).alias(f"b_{name}"))
    per = seen.groupBy(*keys, "path").agg(F.sum("n").alias("chunks"), *lack("same", F.col("same").isNull()), *lack("own", F.lit(True)), *lack("whole", F.col("whole").isNull()))
    v = lambda name: F.coalesce(F.col(name), F.lit(0))
    patch = lambda name, base: framing_size(v("chunks"), v(f"n_{name}"), F.lit(0), base) + v(f"b_{name}")
    changed = F.col("status") == "changed"
    return touched.join(per, [*keys, "path"], "left").select(
        *keys, "path", "status", "length", F.when(changed, patch("same", True)).otherwise(F.col("length")).alias("same_path"), F.when(changed, patch("same", True)).otherwise(patch("own", False)).alias("own"), patch("whole", True).alias("whole_tree")
    )


def update_costs(old: DataFrame, new: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Per tree: changed, added and removed files, and each lane's bytes with the new tree's map; whole_tree_cold also carries the manifest of the old tree, for a receiver that lacks it."""
    files = file_costs(old, new, old_chunks, new_chunks, keys).groupBy(*keys).agg(F.count_if(F.col("status") == "changed").alias("changed"), F.count_if(F.col("status") == "added").alias("added"), *(F.sum(c).alias(c) for c in ("same_path", "own", "whole_tree")))
    gone = trees.diff(old, new, keys).where("status = 'removed'").groupBy(*keys).agg(F.count(F.lit(1)).alias("removed"))
    mapped = new.groupBy(*keys).agg((F.sum(F.octet_length(F.encode("path", "UTF-8")) + MAP_ENTRY) + MAP_HEADER).cast("long").alias("map_bytes"))
    known = old_chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("old_chunks"))
    v = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    joined = mapped.join(files, keys, "left").join(gone, keys, "left").join(known, keys, "left")
    return joined.select(*keys, *(v(c).alias(c) for c in ("changed", "added", "removed", "map_bytes")), *((v(c) + F.col("map_bytes")).alias(c) for c in ("same_path", "own", "whole_tree")), (v("whole_tree") + F.col("map_bytes") + manifest_size(v("old_chunks"))).alias("whole_tree_cold"))

"""Base chunks that could serve as dictionaries for missing target chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RADIUS, MOST, RUN, DICTIONARY_BYTES, HOT_KEY = 256 << 10, 8, 4, 1 << 20, 256


def nearest_starts(base: DataFrame, wanted: DataFrame, keys: list[str], radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(keys..., idx, start, rank): base chunks whose offsets lie within radius of the target chunk's, nearest first, the lower index on ties.

    An equi-join on offset buckets of the radius' width, each target chunk looking into its own and both neighbours.
    """
    b = base.select(*keys, F.col("idx").alias("start"), F.col("off").alias("base_off"), F.floor(F.col("off") / radius).alias("bucket"))
    home = F.floor(F.col("off") / radius)
    t = wanted.select(*keys, "idx", "off", F.explode(F.array(home - 1, home, home + 1)).alias("bucket"))
    near = t.join(b, [*keys, "bucket"]).withColumn("distance", F.abs(F.col("base_off") - F.col("off"))).where(F.col("distance") <= radius)
    w = Window.partitionBy(*keys, "idx").orderBy("distance", "start")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*keys, "idx", "start", "distance", "rank")


def runs(base: DataFrame, keys: list[str], length: int = RUN, most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(keys..., start, count, bytes): for each base chunk the run of up to length chunks from it on, unless they exceed most_bytes."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(0, length - 1)
    out = base.select(*keys, F.col("idx").alias("start"), F.count(F.lit(1)).over(w).alias("count"), F.sum("len").over(w).alias("bytes"))
    return out.where(F.col("bytes") <= most_bytes)


def similar_starts(base_keys: DataFrame, wanted_keys: DataFrame, keys: list[str], most: int = MOST, hot: int = HOT_KEY) -> DataFrame:
    """Base chunks that share super-features (column key): most shared first, then nearest, then lowest index.

    A key that more than hot base chunks have says nothing and is left out, as the definition has it.
    """
    count = base_keys.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= hot).select(*keys, "key")
    b = base_keys.join(count, [*keys, "key"], "left_semi").select(*keys, "key", F.col("idx").alias("start"), F.col("off").alias("base_off"))
    shared = wanted_keys.join(b, [*keys, "key"]).groupBy(*keys, "idx", "start").agg(F.count(F.lit(1)).alias("shared"), F.first(F.abs(F.col("off") - F.col("base_off"))).alias("distance"))
    w = Window.partitionBy(*keys, "idx").orderBy(F.desc("shared"), "distance", "start")
    return shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def labelled_union(by_offset: DataFrame, by_sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Each candidate start once, with the way it was found: offset, sketch or both."""
    on = [*keys, "idx", "start"]
    a, b = by_offset.select(*on).distinct().withColumn("a", F.lit(1)), by_sketch.select(*on).distinct().withColumn("b", F.lit(1))
    return a.join(b, on, "full").select(*on, F.when(F.col("a").isNull(), "sketch").when(F.col("b").isNull(), "offset").otherwise("both").alias("found_by"))


def cheapest(costs: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """The k candidates of least cost, the lower ordinal on ties."""
    w = Window.partitionBy(*keys).orderBy("cost", "ordinal")
    return costs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stride_sample(records: DataFrame, domain: str, stride: int) -> DataFrame:
    """Records whose keyed digest is a multiple of stride (a power of two): the same ones wherever they are stored."""
    if stride & (stride - 1) or not 0 < stride <= 1 << 32:
        raise ValueError("the stride must be a power of two")
    raw = F.sha2(F.unhex(F.concat(F.lit(domain.encode("ascii").hex() + "00"), F.col("id"))), 256)
    low = F.conv(F.concat(*(F.substring(raw, 2 * i + 1, 2) for i in reversed(range(4)))), 16, 10).cast("long")
    return records.where(low.bitwiseAND(stride - 1) == 0)

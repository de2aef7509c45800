"""Measures over chunk tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GIB = float(1 << 30)


def size_stats(chunks: DataFrame, keys: list[str], target: int) -> DataFrame:
    """Mean, its ratio to the target size, population and sample deviations, coefficient of variation, least and greatest."""
    n, mean = F.count(F.lit(1)), F.avg("len")
    sample = F.when(n < 2, 0.0).otherwise(F.stddev_samp("len"))
    return chunks.groupBy(*keys).agg(n.alias("chunks"), mean.alias("mean_bytes"), (mean / target).alias("mean_to_target"), F.stddev_pop("len").alias("deviation"), sample.alias("sample_deviation"), F.when(mean == 0, 0.0).otherwise(sample / mean).alias("variation"), F.min("len").alias("least"), F.max("len").alias("greatest"))


def percentiles(chunks: DataFrame, keys: list[str], value: str = "len") -> DataFrame:
    """Nearest-rank p50, p95, p99 and max, the median, and p95 by linear interpolation."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("long")
    return chunks.groupBy(*keys).agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max(value).alias("max"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95_linear"))


def cut_rates(chunks: DataFrame, keys: list[str], maximum: int) -> DataFrame:
    """Shares of chunks of the maximum length, and of nine tenths of it or more but less."""
    near = (F.col("len") >= 0.9 * maximum) & (F.col("len") < maximum)
    return chunks.groupBy(*keys).agg(F.avg((F.col("len") == maximum).cast("int")).alias("max_cut_rate"), F.avg(near.cast("int")).alias("near_max_rate"))


def transient_cuts(chunks: DataFrame, keys: list[str], minimum: int, window: int = 64) -> DataFrame:
    """Chunks cut while the hash knew fewer bytes than its window."""
    return chunks.groupBy(*keys).agg(F.count_if((F.col("len") >= minimum) & (F.col("len") < minimum + window - 1)).alias("transient_cuts"), F.count(F.lit(1)).alias("chunks"))


def dedup_summary(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks and bytes, and how many of them are distinct."""
    per_id = chunks.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n"), F.first("len").alias("len"))
    return per_id.groupBy(*keys).agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum(F.col("n") * F.col("len")).alias("bytes"), F.sum("len").alias("distinct_bytes"))


def most_repeated(chunks: DataFrame, k: int) -> DataFrame:
    """The k ids that save most bytes if kept once."""
    per_id = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.first("len").alias("len"))
    return per_id.select("id", "times", "len", ((F.col("times") - 1) * F.col("len")).alias("saved_bytes")).orderBy(F.desc("saved_bytes"), "id").limit(k)


def manifest_density(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks and manifest bytes (36 a chunk) for a GiB of source; 0 for none."""
    n, b = F.count(F.lit(1)), F.sum("len")
    return chunks.groupBy(*keys).agg((n / (b / GIB)).alias("chunks_per_gib"), (36 * n / (b / GIB)).alias("manifest_per_gib"))


def pack_projection(chunks: DataFrame, keys: list[str], packs_mib: tuple[int, ...] = (16, 32, 64, 128)) -> DataFrame:
    """Chunks of mean size that a pack would hold."""
    mean = chunks.groupBy(*keys).agg(F.avg("len").alias("mean"))
    return mean.select(*keys, F.explode(F.array(*map(F.lit, packs_mib))).alias("pack_mib"), "mean").select(*keys, "pack_mib", (F.col("pack_mib") * float(1 << 20) / F.col("mean")).alias("chunks_per_pack"))


def boundary_pairs(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Each inner boundary by the ids and lengths on both sides."""
    w = Window.partitionBy(*keys).orderBy("idx")
    return chunks.select(*keys, "idx", F.lag("id").over(w).alias("left_id"), F.lag("len").over(w).alias("left_len"), F.col("id").alias("right_id"), F.col("len").alias("right_len")).where("left_id is not null")


def boundary_survival(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the source's boundaries that the target has, counted with repetition; 1 for a source of one chunk or none."""
    sign = [*keys, "left_id", "left_len", "right_id", "right_len"]
    a = boundary_pairs(source, keys).groupBy(*sign).agg(F.count(F.lit(1)).alias("a"))
    b = boundary_pairs(target, keys).groupBy(*sign).agg(F.count(F.lit(1)).alias("b"))
    kept = a.join(b, sign, "left").groupBy(*keys).agg(F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("survived"), F.sum("a").alias("boundaries"))
    pairs = source.select(*keys).distinct().unionByName(target.select(*keys).distinct()).distinct()
    return pairs.join(kept, keys, "left").select(*keys, F.coalesce("boundaries", F.lit(0)).alias("boundaries"), F.coalesce("survived", F.lit(0)).alias("survived"), F.coalesce(F.col("survived") / F.col("boundaries"), F.lit(1.0)).alias("survival"))


def resynchronization(source: DataFrame, target: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """edits: (keys..., affected_end, changed_bytes). Distance from the edit's end to the first target chunk (not the first of all) from which on all chunks equal the source's last ones; status tells apart what is not applicable and what never meets.

    Both sides are numbered from their ends, so a running conjunction replaces the comparison of every pair of suffixes.
    """
    back = Window.partitionBy(*keys).orderBy(F.desc("idx"))
    a = source.select(*keys, F.row_number().over(back).alias("r"), F.col("id").alias("sid"), F.col("len").alias("slen"))
    b = target.select(*keys, "idx", "off", F.row_number().over(back).alias("r"), "id", "len")
    same = b.join(a, [*keys, "r"], "left").withColumn("eq", F.coalesce((F.col("id") == F.col("sid")) & (F.col("len") == F.col("slen")), F.lit(False)))
    run = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    tail = same.withColumn("all_eq", F.min("eq").over(run)).join(edits, keys)
    found = tail.where("all_eq and idx >= 1 and off >= affected_end").groupBy(*keys).agg(F.min("off").alias("at"))
    size = target.groupBy(*keys).agg(F.sum("len").alias("target_bytes"))
    out = edits.join(size, keys, "left").join(found, keys, "left")
    fits = (F.col("changed_bytes") != 0) & (F.col("affected_end") < F.coalesce("target_bytes", F.lit(0)))
    return out.select(*keys, F.when(fits, F.col("at") - F.col("affected_end")).alias("distance"), F.when(~fits, "not-applicable").when(F.col("at").isNull(), "not-resynchronized").otherwise("resynchronized").alias("status"))


def coalesced(ranges: DataFrame, keys: list[str], gaps: tuple[int, ...] = (0, 64 << 10, 1 << 20)) -> DataFrame:
    """Requests and bytes when needed ranges (off, len) no further apart than a gap are fetched together, the gaps' bytes included."""
    w = Window.partitionBy(*keys, "gap").orderBy("off")
    spread = ranges.select(*keys, "off", (F.col("off") + F.col("len")).alias("end"), F.explode(F.array(*map(F.lit, gaps))).alias("gap"))
    before = F.lag("end").over(w)
    marked = spread.withColumn("new", (before.isNull() | (F.col("off") - before > F.col("gap"))).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(w)).groupBy(*keys, "gap", "island").agg((F.max("end") - F.min("off")).alias("bytes"))
    return islands.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))


def splitters(df: DataFrame, order: Column, most: int = 63, sample: int = 4096) -> list:
    """At most so many values of an order, evenly spread over a sample that a hash picks: a few rows come to the driver, however many there are."""
    n = df.count()
    some = df.select(order.alias("_o")).where(F.pmod(F.xxhash64("_o"), F.lit(max(1, n // sample))) == 0).distinct().orderBy("_o").limit(4 * sample)
    values = [r[0] for r in some.collect()]
    return [values[i * len(values) // (most + 1)] for i in range(1, most + 1)] if len(values) > most else values[1:]


def running_total(df: DataFrame, keys: list[str], order: Column, value: str, name: str) -> DataFrame:
    """df plus name: the sum of value over the rows of a group that come before in an order without ties. A group is cut into ranges of the order, so that none, however large, is sorted by one task: windows run within ranges, and over the ranges' sums."""
    bounds = splitters(df, order)
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_o"))) if bounds else F.lit(0)
    placed = df.withColumn("_o", order).withColumn("_b", bucket)
    before = lambda w: F.coalesce(F.sum(value if w else "_s").over(Window.partitionBy(*keys, *(["_b"] if w else [])).orderBy("_o" if w else "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy(*keys, "_b").agg(F.sum(value).alias("_s")).withColumn("_t", before(False)).drop("_s")
    return placed.withColumn("_w", before(True)).join(ranges, [*keys, "_b"]).withColumn(name, (F.col("_t") + F.col("_w")).cast("long")).drop("_o", "_b", "_t", "_w")


def coverage(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes that intervals [start, stop) cover, each once; touching and nested ones merge."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.where("stop > start").withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "island").agg((F.max("stop") - F.min("start")).alias("bytes"))
    return islands.groupBy(*keys).agg(F.count(F.lit(1)).alias("islands"), F.sum("bytes").alias("covered"))


def clipped(intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    return intervals.withColumn("start", F.greatest("start", low)).withColumn("stop", F.least("stop", high)).where("stop > start")


def boundary_agreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct inner boundaries of two chunkings, shared ones, and shared over the larger count; 1 where neither has any."""
    from corestrata.operators.chunking import interior

    ends = lambda c: interior(c, keys).select(*keys, (F.col("off") + F.col("len")).alias("end")).distinct()
    a, b = ends(left).withColumn("a", F.lit(1)), ends(right).withColumn("b", F.lit(1))
    counted = a.join(b, [*keys, "end"], "full").groupBy(*keys).agg(F.count("a").alias("left_boundaries"), F.count("b").alias("right_boundaries"), F.count(F.col("a") + F.col("b")).alias("shared"))
    all_keys = left.select(*keys).distinct().unionByName(right.select(*keys).distinct()).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = all_keys.join(counted, keys, "left").select(*keys, zero("left_boundaries"), zero("right_boundaries"), zero("shared"))
    most = F.greatest("left_boundaries", "right_boundaries")
    return out.withColumn("agreement", F.when(most == 0, 1.0).otherwise(F.col("shared") / most))


def _weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    """Median of values (ascending) that occur so many times."""
    ends, n = np.cumsum(counts), int(counts.sum())
    low, high = np.searchsorted(ends, [(n - 1) // 2, n // 2], "right")
    return float((values[low] + values[high]) / 2)


def _interval(draws: list[float]) -> tuple[float, float]:
    return float(np.quantile(draws, 0.025)), float(np.quantile(draws, 0.975))


def bootstrap_medians(samples: DataFrame, keys: list[str], value: str, seed: int = 1, rounds: int = 1000) -> DataFrame:
    """Median of a group's values and the 2.5th and 97.5th percentile of medians of resamples; the same for any partitioning.

    A resample with replacement is a draw of how often each distinct value occurs, so values are counted first, and a
    task holds a group's distinct values alone.
    """
    types = dict(samples.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_v")
        v, c = pdf["_v"].to_numpy(float), pdf["_n"].to_numpy(np.int64)
        rng = np.random.default_rng(seed)
        low, high = _interval([_weighted_median(v, rng.multinomial(c.sum(), c / c.sum())) for _ in range(rounds)])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "median": [_weighted_median(v, c)], "low": [low], "high": [high]})

    counted = samples.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).applyInPandas(one, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "median double, low double, high double"]))


def bootstrap_ratios(samples: DataFrame, keys: list[str], lane: str, off: str, seed: int = 1, rounds: int = 1000) -> DataFrame:
    """Overhead sum(lane) / sum(off) - 1 of a group's pairs, with the interval of resampled pairs; groups whose off doesn't sum to more than 0 give none. Pairs are counted first, as in bootstrap_medians()."""
    types = dict(samples.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_a", "_b"])
        a, b, c = (pdf[x].to_numpy(float) for x in ("_a", "_b", "_n"))
        ratio = lambda n: float(n @ a / (n @ b) - 1) if n @ b > 0 else 0.0
        rng = np.random.default_rng(seed)
        low, high = _interval([ratio(rng.multinomial(int(c.sum()), c / c.sum())) for _ in range(rounds)])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "overhead": [ratio(c)], "low": [low], "high": [high]})

    counted = samples.where(F.col(lane).isNotNull() & F.col(off).isNotNull()).groupBy(*keys, F.col(lane).cast("double").alias("_a"), F.col(off).cast("double").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    some = counted.join(counted.groupBy(*keys).agg(F.sum(F.col("_b") * F.col("_n")).alias("_s")).where("_s > 0").select(*keys), keys, "left_semi")
    return some.groupBy(*keys).applyInPandas(one, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "overhead double, low double, high double"]))


def bootstrap_blocks(samples: DataFrame, keys: list[str], block: str, left: str, right: str, seed: int = 1, rounds: int = 1000) -> DataFrame:
    """Ratio of medians of two paired measures, with the interval of resampled whole blocks."""
    types = dict(samples.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([block, left, right])
        parts = [g[[left, right]].to_numpy(float) for _, g in pdf.groupby(block, sort=True)]
        ratio = lambda x: float(np.median(x[:, 0]) / np.median(x[:, 1]))
        rng = np.random.default_rng(seed)
        got = [ratio(np.concatenate([parts[i] for i in rng.integers(0, len(parts), len(parts))])) for _ in range(rounds)]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ratio": [ratio(np.concatenate(parts))], "low": [float(np.quantile(got, 0.025))], "high": [float(np.quantile(got, 0.975))]})

    return samples.groupBy(*keys).applyInPandas(one, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "ratio double, low double, high double"]))

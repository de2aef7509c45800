"""Which chunks of a target a base holds. Both sides carry the same key columns, which name the pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reused(base: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Target chunks, every occurrence, whose id is in the base."""
    return target.join(base.select(*keys, "id").distinct(), [*keys, "id"], "left_semi")


def missing(base: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Target chunks, every occurrence, whose id is not in the base."""
    return target.join(base.select(*keys, "id").distinct(), [*keys, "id"], "left_anti")


def first_occurrences(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Of each id its first row, by a pre-aggregated minimum rather than a window."""
    rest = [c for c in chunks.columns if c not in (*keys, "id", "idx")]
    got = chunks.groupBy(*keys, "id").agg(F.min(F.struct("idx", *rest)).alias("r"))
    return got.select(*keys, "id", "r.*")


def plan(base: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair: chunks and bytes in all, reused and missing (each occurrence), and missing once each."""
    known = base.select(*keys, "id").distinct().withColumn("known", F.lit(True))
    per_id = target.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("b"), F.min_by("len", "idx").alias("one"))
    joined = per_id.join(known, [*keys, "id"], "left").withColumn("known", F.col("known").isNotNull())
    pick = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    k, m = F.col("known"), ~F.col("known")
    return joined.groupBy(*keys).agg(
        F.sum("n").alias("target_chunks"), F.sum("b").alias("target_bytes"), pick(k, "n").alias("reused_chunks"), pick(k, "b").alias("reused_bytes"),
        pick(m, "n").alias("missing_chunks"), pick(m, "b").alias("missing_bytes"), F.count_if(m).alias("unique_missing_chunks"), pick(m, "one").alias("unique_missing_bytes"),
    )


def ratios(planned: DataFrame, changed: str | None = None) -> DataFrame:
    """Adds reuse_ratio (1 for an empty target), missing_ratio and, given a column of changed bytes, amplification (0 where none changed)."""
    out = planned.withColumn("reuse_ratio", F.when(F.col("target_bytes") == 0, 1.0).otherwise(F.col("reused_bytes") / F.col("target_bytes")))
    out = out.withColumn("missing_ratio", F.when(F.col("target_bytes") == 0, 0.0).otherwise(F.col("unique_missing_bytes") / F.col("target_bytes")))
    return out if changed is None else out.withColumn("amplification", F.when(F.col(changed) == 0, 0.0).otherwise(F.col("unique_missing_bytes") / F.col(changed)))


def locate(base: DataFrame, target: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """For each target chunk where its bytes come from: the payload before the base, the first base chunk of that id and length before later ones."""
    first = first_occurrences(base.select(*keys, "id", "idx", "off", "len"), keys).select(*keys, "id", F.col("off").alias("base_off"), F.col("len").alias("base_len"))
    held = payload.select(*keys, "id").distinct().withColumn("held", F.lit(True))
    out = target.join(held, [*keys, "id"], "left").join(first, [*keys, "id"], "left")
    source = F.when(F.col("held"), "payload").when(F.col("base_off").isNull(), "missing").when(F.col("base_len") == F.col("len"), "base").otherwise("wrong_length")
    return out.withColumn("source", source).drop("held", "base_len")


def depends_on_base(target: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair whether any target id is outside the payload or any entry names dictionary chunks."""
    ids = payload.select(*keys, "id").distinct()
    lack = target.join(ids, [*keys, "id"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("outside"))
    named = payload.groupBy(*keys).agg(F.max(F.col("dict_count") > 0).alias("named"))
    return target.select(*keys).distinct().join(lack, keys, "left").join(named, keys, "left").select(*keys, (F.coalesce("outside", F.lit(0)) > 0).alias("outside"), F.coalesce("named", F.lit(False)).alias("named")).withColumn("depends", F.col("outside") | F.col("named"))


def payload_flags(target: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair the OR of 8 (an id twice), 16 (an id outside the target) and 32 (a stored length that is too long, or raw and different)."""
    known = first_occurrences(target.select(*keys, "id", "idx", "len"), keys).select(*keys, "id", F.col("len").alias("full"))
    w = Window.partitionBy(*keys, "id")
    seen = payload.withColumn("times", F.count(F.lit(1)).over(w)).join(known, [*keys, "id"], "left")
    flag = F.when(F.col("times") > 1, 8).otherwise(0).bitwiseOR(F.when(F.col("full").isNull(), 16).otherwise(0)).bitwiseOR(F.when((F.col("stored_len") > F.col("full")) | ((F.col("encoding") == 0) & (F.col("stored_len") != F.col("full"))), 32).otherwise(0))
    return seen.groupBy(*keys).agg(F.bit_or(flag).cast("long").alias("flags"))


def id_sets(base: DataFrame, target: DataFrame, lane: list[str]) -> DataFrame:
    """Per lane (a chunking profile, say) distinct ids of both sides, shared ones, and target bytes reused."""
    b, t = base.select(*lane, "id").distinct(), target.groupBy(*lane, "id").agg(F.sum("len").alias("bytes"))
    both = t.join(b.withColumn("in_base", F.lit(True)), [*lane, "id"], "full")
    return both.groupBy(*lane).agg(F.count_if(F.col("in_base").isNotNull()).alias("base_ids"), F.count_if(F.col("bytes").isNotNull()).alias("target_ids"), F.count_if(F.col("in_base").isNotNull() & F.col("bytes").isNotNull()).alias("shared_ids"), F.coalesce(F.sum(F.when(F.col("in_base").isNotNull(), F.col("bytes"))), F.lit(0)).cast("long").alias("reused_bytes"))

"""Versions, transitions, and comparisons in which every family weighs the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(versions: DataFrame, most: int = 3) -> DataFrame:
    """(family, version) -> (family, from_version, to_version, stride, kind) for strides 1 to most in the order of versions. One window, no self-join."""
    w = Window.partitionBy("family").orderBy("version")
    steps = versions.select("family", "version").distinct().select("family", F.col("version").alias("from_version"), *(F.lead("version", k).over(w).alias(f"s{k}") for k in range(1, most + 1)))
    pairs = F.array(*(F.struct(F.col(f"s{k}").alias("to_version"), F.lit(k).alias("stride")) for k in range(1, most + 1)))
    flat = steps.select("family", "from_version", F.explode(pairs).alias("p")).where("p.to_version is not null")
    return flat.select("family", "from_version", "p.to_version", F.col("p.stride").alias("stride"), F.when(F.col("p.stride") == 1, "version-adjacent").otherwise(F.concat(F.lit("version-skip-"), F.col("p.stride") - 1)).alias("kind"))


def scope(kind: Column) -> Column:
    return F.when(kind == "version-adjacent", "adjacent").when(kind.startswith("version-skip-"), "skipped").otherwise("synthetic")


def history(versions: Column) -> Column:
    return F.when(versions <= 2, "pair-only").when(versions <= 4, "short-history").otherwise("full-history")


def by_family(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: (keys..., kind, target_bytes, target_chunks, reused_bytes, unique_missing_bytes, survival, max_cut_rate, status, distance). Ratios weigh bytes; rates weigh transitions alike; identity rows don't count."""
    b = F.sum("target_bytes")
    zero = lambda c: F.when(b == 0, 0.0).otherwise(c)
    fits = F.col("status") != "not-applicable"
    return rows.where("kind <> 'identity'").groupBy(*keys, scope(F.col("kind")).alias("scope")).agg(
        F.count(F.lit(1)).alias("transitions"), b.alias("target_bytes"), F.coalesce(b / F.nullif(F.sum("target_chunks"), F.lit(0)), F.lit(0.0)).alias("mean_bytes"), zero(F.sum("reused_bytes") / b).alias("reuse_ratio"),
        F.sum("unique_missing_bytes").alias("unique_missing_bytes"), zero(F.sum("unique_missing_bytes") / b).alias("missing_ratio"), F.avg("survival").alias("survival"), F.avg("max_cut_rate").alias("max_cut_rate"), F.count_if(fits).alias("applicable"), F.count("distance").alias("resynchronized"),
    )


def across_families(families: DataFrame, keys: list[str]) -> DataFrame:
    """families: by_family rows with history. Means and worst values over families; only those with more than two versions count, except for synthetic scopes; null without any."""
    use = (F.col("scope") == "synthetic") | (F.col("history") != "pair-only")
    only = lambda c: F.when(use, F.col(c))
    return families.groupBy(*keys, "scope").agg(
        F.count(F.lit(1)).alias("families"), F.count_if(F.col("history") != "pair-only").alias("eligible"), F.count_if(use).alias("compared"), F.avg(only("mean_bytes")).alias("mean_bytes"), F.avg(only("reuse_ratio")).alias("mean_reuse"), F.min(only("reuse_ratio")).alias("worst_reuse"),
        F.avg(only("missing_ratio")).alias("mean_missing"), F.max(only("missing_ratio")).alias("worst_missing"), F.avg(only("survival")).alias("mean_survival"), F.max(only("max_cut_rate")).alias("worst_max_cut_rate"),
    )


def resync_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: results for which resynchronisation applies, those that did, coverage, and the distances' nearest-rank percentiles."""
    fits, done = F.col("status") != "not-applicable", F.col("status") == "resynchronized"
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY distance)").cast("long")
    return results.groupBy(*keys).agg(F.count_if(fits).alias("applicable"), F.count_if(done).alias("resynchronized"), F.when(F.count_if(fits) == 0, F.lit(None)).otherwise(F.count_if(done) / F.count_if(fits)).alias("coverage"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max("distance").alias("max"))


def corpus_summary(versions: DataFrame) -> DataFrame:
    """versions: (family, split, version). Families by split and history."""
    per = versions.groupBy("family", "split").agg(F.count(F.lit(1)).alias("n"))
    h = history(F.col("n"))
    return per.groupBy("split").agg(F.count(F.lit(1)).alias("families"), F.sum("n").alias("versions"), F.count_if(h != "pair-only").alias("eligible"), F.count_if(h == "pair-only").alias("pair_only"), F.count_if(h == "short-history").alias("short_history"))


def corpus_faults(versions: DataFrame, contents: DataFrame) -> DataFrame:
    """versions: (family, split, version, size, sha256); contents: (family, version, bytes). Rows that break a rule, with the rule."""
    w = Window.partitionBy("family", "version")
    splits = Window.partitionBy("family")
    seen = versions.withColumn("twins", F.count(F.lit(1)).over(w)).withColumn("splits", F.size(F.collect_set("split").over(splits))).join(contents, ["family", "version"], "left")
    rule = (
        F.when(F.col("twins") > 1, "version_twice")
        .when(F.col("splits") > 1, "two_splits")
        .when(F.col("bytes").isNull(), "content_missing")
        .when(F.octet_length("bytes") != F.col("size"), "size")
        .when(F.sha2("bytes", 256) != F.col("sha256"), "digest")
    )
    return seen.withColumn("rule", rule).where("rule is not null").select("family", "version", "rule")


def compare_runs(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each id of either run as equal, different (with the fields that differ), only_left or only_right."""
    a = left.select(key, F.struct(*fields).alias("a"))
    b = right.select(key, F.struct(*fields).alias("b"))
    apart = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields))), ",")
    verdict = F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").when(apart == "", "equal").otherwise("different")
    return a.join(b, key, "full").select(key, verdict.alias("verdict"), F.when(verdict == "different", apart).otherwise("").alias("fields"))


def mean_match(plan: DataFrame, results: DataFrame, tolerance: float) -> DataFrame:
    """plan: (group, candidate), results: (candidate, mean_bytes). Per group the greatest relative distance from the group's least mean, and whether it is within tolerance."""
    joined = plan.join(results, "candidate", "left")
    delta = F.max("mean_bytes") / F.min("mean_bytes") - 1
    return joined.groupBy("group").agg(F.count("mean_bytes").alias("found"), F.count_if(F.col("mean_bytes").isNull()).alias("absent"), delta.alias("delta"), F.coalesce((delta <= tolerance) & (F.count_if(F.col("mean_bytes").isNull()) == 0), F.lit(False)).alias("matched"))


def lane_totals(rows: DataFrame, lane: str, value: str, reference: str) -> DataFrame:
    """Sums by lane and each one's share of the reference lane's."""
    per = rows.groupBy(lane).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"))
    whole = rows.where(F.col(lane) == reference).agg(F.sum(value).alias("whole")).first()[0]  # one number, known before the plan
    return per.select(lane, "total", "rows", (F.col("total") / F.lit(whole)).alias("share"))


def throughput(samples: DataFrame, keys: list[str]) -> DataFrame:
    """samples: (keys..., bytes, wall_s, cpu_s). Nearest-rank medians and 95th percentiles of GiB a second and a CPU second."""
    gib = F.col("bytes") / float(1 << 30)
    rows = samples.select(*keys, (gib / F.col("wall_s")).alias("rate"), (gib / F.col("cpu_s")).alias("cpu_rate"))
    rank = lambda c, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), rank("rate", 0.5).alias("p50"), rank("rate", 0.95).alias("p95"), F.min("rate").alias("least"), F.max("rate").alias("most"), rank("cpu_rate", 0.5).alias("cpu_p50"))


def verdicts(measured: DataFrame, keys: list[str], lane: str, base_lane: str, value: str, least: float) -> DataFrame:
    """Each lane's median over the base lane's, and PASS where it is least or more."""
    base = measured.where(F.col(lane) == base_lane).select(*keys, F.col(value).alias("base"))
    out = measured.where(F.col(lane) != base_lane).join(base, keys)
    return out.select(*keys, lane, (F.col(value) / F.col("base")).alias("ratio"), F.when(F.col(value) / F.col("base") >= least, "PASS").otherwise("FAIL").alias("verdict"))


def registry_faults(registry: DataFrame, index: DataFrame, statuses: list[str]) -> DataFrame:
    """registry and index: (id, status). Whatever keeps the two from being one list of unique ids with legal statuses: (id, fault, registered, indexed); a sound pair gives none."""
    ids = {}
    for name, table in (("registered", registry), ("indexed", index)):
        ids[name] = table.groupBy("id").agg(F.min("status").alias(name), F.count(F.lit(1)).alias(f"n_{name}"), F.count_if(~F.coalesce(F.col("status").isin(statuses), F.lit(False))).alias(f"bad_{name}"))
    both = ids["registered"].join(ids["indexed"], ids["registered"]["id"].eqNullSafe(ids["indexed"]["id"]), "full").select(F.coalesce(ids["registered"]["id"], ids["indexed"]["id"]).alias("id"), *(F.col(f"{p}{n}") for n in ("registered", "indexed") for p in ("", "n_", "bad_")))
    tests = (("no_id", F.coalesce("id", F.lit("")) == ""), ("repeated", (F.col("n_registered") > 1) | (F.col("n_indexed") > 1)), ("status", (F.col("bad_registered") > 0) | (F.col("bad_indexed") > 0)), ("unregistered", F.col("n_registered").isNull()), ("unindexed", F.col("n_indexed").isNull()), ("disagree", F.col("registered") != F.col("indexed")))
    return both.select("id", "registered", "indexed", F.explode(F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests)), lambda x: x.isNotNull())).alias("fault")).select("id", "fault", "registered", "indexed")

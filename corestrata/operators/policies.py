"""Encoding policies by name, and the lanes of a sweep over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corestrata.functions.profiles import Profile
from corestrata.operators import patches

#: Names of policies: level of zstd (0: raw), chunks of a dictionary (0: none), candidates and the radius within which they begin, ranked.
NAMED = {"standard": (19, 4, 8, 256 << 10, False), "ranked": (19, 4, 8, 256 << 10, True), "wide": (9, 4, 16, 1 << 20, False), "plain": (19, 0, 0, 0, False), "raw": (0, 0, 0, 0, False)}
#: Radius by the number of candidates that a lane's name gives.
RADIUS = {8: 256 << 10, 16: 1 << 20}
#: sweep-L19-K4-C8 and enc-L9-K2-C16-copy-H17C18: level, chunks, candidates; how the dictionary is loaded; logarithms of two tables.
LANE = r"^(?:sweep-L([0-9]+)-K([0-9]+)-C([0-9]+)|enc-L([0-9]+)-K([0-9]+)-C([0-9]+)-(copy|attach|prefix)(?:-H([0-9]+)C([0-9]+))?)$"
MOST_LEVEL, MOST_CHUNKS, LOGS = 22, 4, (6, 27)


def parsed(names: DataFrame, column: str = "name") -> DataFrame:
    """names plus level, chunks, candidates, radius, ranked, load, hash_log, chain_log, known; nothing but known = false for a name that is no policy. In Spark's own functions."""
    own = lambda i: F.regexp_extract(column, LANE, i)
    number = lambda *at: F.coalesce(*(F.when(own(i) != "", F.expr(f"try_cast(regexp_extract(`{column}`, '{LANE}', {i}) as int)")) for i in at))
    named = lambda k: reduce(lambda a, x: a.when(F.col(column) == x, F.lit(NAMED[x][k])), NAMED, F.when(F.lit(False), F.lit(NAMED["raw"][k])))
    level, chunks, count = (F.coalesce(named(k), number(k + 1, k + 4)) for k in range(3))
    radius = F.coalesce(named(3), reduce(lambda a, n: a.when(count == n, RADIUS[n]), RADIUS, F.when(F.lit(False), 0)))
    logs = [number(8), number(9)]
    sound = F.coalesce(named(0).isNotNull() | (level.between(1, MOST_LEVEL) & chunks.between(1, MOST_CHUNKS) & radius.isNotNull() & reduce(lambda a, b: a & b, (F.coalesce(x.between(*LOGS), own(8) == "") for x in logs))), F.lit(False))
    out = {"level": level, "chunks": chunks, "candidates": count, "radius": radius, "ranked": F.coalesce(named(4), F.lit(False)), "load": F.when(own(7) != "", own(7)), "hash_log": logs[0], "chain_log": logs[1]}
    return names.select("*", sound.alias("known"), *(F.when(sound, c).alias(n) for n, c in out.items()))


def sweep(base: DataFrame, target: DataFrame, keys: list[str], profile: Profile, lanes: list[str]) -> DataFrame:
    """(keys..., lane, entries, dictionary_entries, references, stored_bytes) of each lane; an unknown name is refused before anything runs."""
    spark = base.sparkSession
    rows = {r.name: r for r in parsed(spark.createDataFrame([(x,) for x in lanes], "name string")).collect()}
    if unknown := [x for x in lanes if not rows[x].known]:
        raise ValueError(f"no policies: {', '.join(unknown)}")
    parts = []
    for x in lanes:
        p = rows[x]
        made = patches.entries(base, target, keys, profile, p.level, p.ranked, p.chunks, p.radius, p.candidates)
        parts.append(made.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("dict_count") > 0).alias("dictionary_entries"), F.sum("dict_count").alias("references"), F.sum("stored_len").alias("stored_bytes")).withColumn("lane", F.lit(x)))
    return reduce(DataFrame.unionByName, parts).select(*keys, "lane", "entries", "dictionary_entries", "references", "stored_bytes")

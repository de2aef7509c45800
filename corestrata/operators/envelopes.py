"""Dictionaries of ever larger envelopes: how far each may reach, what each would store, and what a lane of nested ones comes to."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corestrata.functions import codecs, fixed
from corestrata.operators.arrow import each_row
from corestrata.operators.candidates import MOST, RADIUS
from corestrata.operators.patches import _both, _wanted
from corestrata.sources import patches as binary

_TRIAL = pa.schema([("idx", pa.int64()), ("envelope", pa.int32()), ("ordinal", pa.int32()), ("start", pa.int64()), ("records", pa.int64()), ("dictionary_bytes", pa.int64()), ("cost", pa.int64()), ("repeated", pa.bool_()), ("selected", pa.bool_())])


def prefixes(base: DataFrame, starts: DataFrame, keys: list[str], envelopes=fixed.ENVELOPES) -> DataFrame:
    """(keys..., idx, rank, start, envelope, records, bytes): for each start and envelope the run of base chunks from start on that the envelope holds.

    A run ends before the record that would exceed the envelope's bytes, and at its number of references; none is
    skipped. Ends of records and ends of budgets are merged in one ordered pass, so no record is paired with the
    runs that hold it; starts whose first record is too large give no row.
    """
    ends = base.select(*keys, "idx", "off", (F.col("off") + F.col("len")).alias("end"))
    held = F.array(*(F.struct(F.lit(name).alias("envelope"), F.lit(refs).alias("refs"), F.lit(size).cast("long").alias("budget")) for name, refs, size, _ in envelopes))
    probes = starts.select(*keys, "idx", "rank", "start").join(ends.select(*keys, F.col("idx").alias("start"), F.col("off").alias("from")), [*keys, "start"])
    probes = probes.select("*", F.explode(held).alias("e")).select(*keys, "idx", "rank", "start", "from", "e.envelope", "e.refs", (F.col("from") + F.col("e.budget")).alias("limit"))
    marks = ends.select(*keys, F.col("end").alias("limit"), F.lit(0).alias("kind"), F.col("idx").alias("record")).unionByName(probes.select(*keys, "limit").distinct().select(*keys, "limit", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("record")))
    w = Window.partitionBy(*keys).orderBy("limit", "kind").rowsBetween(Window.unboundedPreceding, 0)
    fits = marks.withColumn("fit", F.max("record").over(w)).where("kind = 1").select(*keys, "limit", "fit")
    reach = probes.join(fits, [*keys, "limit"]).withColumn("last", F.least(F.col("start") + F.col("refs") - 1, "fit")).where(F.col("last") >= F.col("start"))
    found = reach.join(ends.select(*keys, F.col("idx").alias("last"), "end"), [*keys, "last"])
    return found.select(*keys, "idx", "rank", "start", "envelope", (F.col("last") - F.col("start") + 1).alias("records"), (F.col("end") - F.col("from")).alias("bytes"))


def _nearest(offsets: list[int], at: int, radius: int, most: int) -> list[int]:
    near = range(bisect.bisect_left(offsets, at - radius), bisect.bisect_right(offsets, at + radius))
    return sorted(near, key=lambda i: (abs(offsets[i] - at), i))[:most]


def _run(records: list[tuple[bytes, int]], start: int, most: int, budget: int) -> int:
    """Records from start on that fit."""
    n = size = 0
    while n < most and start + n < len(records) and size + records[start + n][1] <= budget:
        size += records[start + n][1]
        n += 1
    return n


def trials(base: DataFrame, target: DataFrame, keys: list[str], profile, envelopes=fixed.ENVELOPES, level: int = 19) -> DataFrame:
    """Every trial of every wanted chunk: idx, envelope (its number; 0 is what the first envelope's own choice costs), ordinal and start of the candidate, records, dictionary_bytes, cost, repeated, selected.

    Trials go by envelope, then by candidate. One with the records and window of an earlier trial is repeated and
    stores nothing anew (its cost is null). Selected is the one that costs strictly less than all before it.
    """

    def make(t, b):
        t, b = t or b"", b or b""
        m, wanted = _wanted(b, t, profile)
        offsets = [0]
        for _, n in m.records:
            offsets.append(offsets[-1] + n)
        for i, chunk, at, n in wanted:
            raw = t[at : at + n]
            first, which = binary.choose(chunk, raw, binary.dictionaries(m, b, at), level)
            rows = [(0, which, -1, len(first.dictionary), 0, codecs.cost(len(first.stored), len(first.dictionary)), False)]
            starts, seen = _nearest(offsets[:-1], at, RADIUS, MOST), set()
            for number, (_, most, budget, window) in enumerate(envelopes[1:], 1):
                for ordinal, start in enumerate(starts):
                    count = _run(m.records, start, most, budget)
                    held = b[offsets[start] : offsets[start + count]]
                    if not count or held.startswith(fixed.ZSTD_DICTIONARY_MAGIC):
                        continue
                    what = (window, *(c for c, _ in m.records[start : start + count]))
                    again = what in seen
                    seen.add(what)
                    rows.append((number, ordinal, start, count, len(held), None if again else codecs.cost(len(codecs.compress(raw, held, level, window)), count), again))
            best = min(range(len(rows)), key=lambda k: (rows[k][5] is None, rows[k][5], k))
            yield from ((i, *row, k == best) for k, row in enumerate(rows))

    return each_row(_both(base, target, keys), keys, ["target_bytes", "base_bytes"], "idx long, envelope int, ordinal int, start long, records long, dictionary_bytes long, cost long, repeated boolean, selected boolean", _TRIAL, make)


def lanes(tried: DataFrame, keys: list[str], envelopes=fixed.ENVELOPES) -> DataFrame:
    """(keys..., lane, entries, cost, saved, beaten): a lane has its envelope and all smaller ones, so that none costs more than the lane before; saved is against the first, beaten counts the entries that it improves."""
    least = tried.where("cost is not null").select(*keys, "idx", "cost", F.explode(F.sequence("envelope", F.lit(len(envelopes) - 1))).alias("lane"), F.when(F.col("envelope") == 0, F.col("cost")).alias("plain"))
    entry = least.groupBy(*keys, "idx", "lane").agg(F.min("cost").alias("cost"), F.max("plain").alias("plain"))
    return entry.groupBy(*keys, "lane").agg(F.count(F.lit(1)).alias("entries"), F.sum("cost").alias("cost"), F.sum(F.col("plain") - F.col("cost")).alias("saved"), F.count_if(F.col("cost") < F.col("plain")).alias("beaten"))

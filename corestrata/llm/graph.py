"""Connected components of an edge table: in one task, or by rounds in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corestrata.llm.common import spool, unspool

#: Links that one task unites, in about 200 MB; more take rounds, each of which is a table of its own in many files.
ONE_TASK = 1 << 20
_ROOTED = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != (deeper := new[new])).any():
            new = deeper
        if (new == root).all():
            return root
        root = new


def _unite(source):
    held = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in source if batch.num_rows]
    if held:
        links = np.concatenate(held, axis=1)
        nodes, place = np.unique(links, return_inverse=True)
        x, y = place.reshape(links.shape)
        root = roots(len(nodes), x, y)
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        for k in range(0, len(linked), 1 << 16):
            some = linked[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], schema=_ROOTED)


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(low)
    return low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges (a long, b long; read twice) -> (node, root): root is the smallest node that links reach; nodes without links, and roots, are absent.

    Up to one_task links are united in one task. More take alternating large-star and small-star steps (Kiveris et
    al., 2014), each round written to the shared folder. A star's centre may have any number of links: minima are
    pre-aggregated, and the joins are plain shuffled joins, which adaptive execution splits. Loops (a = b) and nulls are ignored; an empty table gives none.
    """
    edges = edges.where("a <> b")
    if edges.count() <= one_task:
        return spool(edges.select("a", "b").repartition(1).mapInArrow(_unite, "node long, root long"), "components")
    now = spool(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        new = (now.count(), now.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
        if new == mark or not new[0]:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.spooled_at = now.spooled_at  # for unspool()
            return out
        mark = new
        star = spool(_small_star(_large_star(now).distinct()).where("a <> b").distinct(), "edges")
        unspool(now)
        now = star

"""Near-duplicate vectors: a navigable small-world graph per shard, beams widened until audits pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corestrata.llm.common import bounded_batches, spool, unspool
from corestrata.llm.graph import components

THRESHOLD = 0.93
#: Distinct vectors of a shard, about; and shards of a block. A task compares one block with itself or another.
SHARD, SHARDS = 2048, 4
#: Numbers that a block holds at most, about: longer vectors make smaller shards.
VALUES = 1 << 21
DEGREE, BEAM = 12, 16
#: Beams are widened up to this; a shard whose audits still fail is answered by dense products.
WIDEST = 128
#: Members that a shard's audit asks for, links that they must have together (else more are asked), vectors of another block that are audited in each batch, and the share of links that must be found.
AUDITED, LINKS, PASSING, RECALL = 128, 64, 16, 0.99
#: Rows of a dense product at a time.
ROWS = 512
_SLACK = 1e-4  # single precision finds, double decides
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _spread(near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) those that lie nearer to the row than to any chosen before them; the nearest others fill up."""
    n, c = near.shape
    own = np.take_along_axis(sims, np.maximum(near, 0), axis=1)
    own[near < 0] = -np.inf
    closest, chosen = np.full((n, c), -np.inf, np.float32), np.zeros((n, c), bool)
    for k in range(c):
        take = (near[:, k] >= 0) & (closest[:, k] < own[:, k]) & (chosen.sum(axis=1) < most)
        chosen[:, k] = take
        rows = np.flatnonzero(take)
        closest[rows] = np.maximum(closest[rows], sims[near[rows, k][:, None], np.maximum(near[rows], 0)])
    first = np.argsort(np.where(near < 0, 2 * c, np.arange(c) + c * ~chosen), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, first, axis=1)


class SmallWorld:
    """Hierarchical navigable small world (Malkov and Yashunin, 2016) over a bounded number of unit vectors, by inner product.

    Vectors enter in random order and link to earlier ones, as there; but candidates come from the shard's own
    product matrix, so all vectors of a level are linked at once. Searches move the beams of many queries together.
    """

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, seed: int = 7):
        self.v = vectors
        n = len(vectors)
        rnd = np.random.default_rng(seed)
        level = np.minimum((-np.log(np.maximum(rnd.random(n), 1e-12)) / np.log(degree)).astype(int), 8)
        order = rnd.permutation(n)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the lowest: members, and links by vector
        for at in range(int(level.max()) + 1):
            members = order[level[order] >= at]
            links = np.full((n, 2 * degree), -1, np.int32)
            near = self._links(vectors[members], degree)
            links[members] = np.where(near >= 0, members[near], -1)
            self.levels.append((members, links))
        self.entry = int(self.levels[-1][0][0])

    @staticmethod
    def _links(v: np.ndarray, degree: int) -> np.ndarray:
        n, c = len(v), 3 * degree
        sims = v @ v.T
        earlier = np.where(np.tri(n, k=-1, dtype=bool), sims, -np.inf)
        c = min(c, n)
        near = np.argpartition(-earlier, c - 1, axis=1)[:, :c] if c < n else np.tile(np.arange(n), (n, 1))
        found = np.take_along_axis(earlier, near, axis=1)
        rank = np.argsort(-found, axis=1, kind="stable")
        near = np.where(np.take_along_axis(found, rank, axis=1) == -np.inf, -1, np.take_along_axis(near, rank, axis=1))
        ahead = _spread(near, sims, degree)
        later, to = np.nonzero(ahead >= 0)
        to = ahead[later, to]
        rank = np.lexsort((-sims[later, to], to))
        later, to = later[rank], to[rank]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        back = np.full((n, c), -1)
        some = place < c
        back[to[some], place[some]] = later[some]
        both = np.full((n, 2 * degree), -1)
        both[:, : ahead.shape[1]] = ahead
        back = _spread(back, sims, degree)
        both[:, degree : degree + back.shape[1]] = back
        return both

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, similarities) of each query's beam, -1 where it has fewer."""
        m, v = len(q), self.v
        at = np.full(m, self.entry)
        sim = q @ v[self.entry]
        for _, links in self.levels[:0:-1]:
            moving = np.arange(m)
            while len(moving):
                near = links[at[moving]]
                sims = np.where(near >= 0, np.matmul(v[near], q[moving][:, :, None])[:, :, 0], -np.inf)
                best = sims.argmax(axis=1)
                best_sim = sims[np.arange(len(moving)), best]
                better = best_sim > sim[moving]
                moving, near, best, best_sim = moving[better], near[better], best[better], best_sim[better]
                at[moving], sim[moving] = near[np.arange(len(moving)), best], best_sim
        links = self.levels[0][1]
        ids, sims, done = np.full((m, beam), -1), np.full((m, beam), -np.inf, np.float32), np.zeros((m, beam), bool)
        ids[:, 0], sims[:, 0] = at, sim
        seen = np.zeros((m, len(v)), bool)
        seen[np.arange(m), at] = True
        live = np.arange(m)
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            pick = open_.argmax(axis=1)
            more = open_[np.arange(len(live)), pick] > -np.inf
            live, pick = live[more], pick[more]
            if not len(live):
                break
            done[live, pick] = True
            near = links[ids[live, pick]]
            new = (near >= 0) & ~seen[live[:, None], near]
            row, col = np.nonzero(new)
            seen[live[row], near[row, col]] = True
            got = np.full(near.shape, -np.inf, np.float32)
            got[row, col] = np.einsum("ij,ij->i", v[near[row, col]], q[live[row]])
            all_sims, all_ids = np.concatenate([sims[live], got], axis=1), np.concatenate([ids[live], np.where(new, near, -1)], axis=1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[live], ids[live], done[live] = (np.take_along_axis(x, best, axis=1) for x in (all_sims, all_ids, all_done))
        return ids, sims


class Shard:
    """Members; answers queries with verified links, and audits its answers."""

    def __init__(self, vectors: np.ndarray, threshold: float):
        self.exact, self.threshold = vectors, threshold
        self.graph = SmallWorld(vectors.astype(np.float32))
        self.beam, self.dense = min(BEAM, len(vectors)), False
        self.hits = self.truth = 0
        self._audit_members()

    def _product(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.nonzero(q[k : k + ROWS] @ self.exact.T >= self.threshold) for k in range(0, len(q), ROWS)]
        return np.concatenate([x + k * ROWS for k, (x, _) in enumerate(parts)] or [_NONE]), np.concatenate([y for _, y in parts] or [_NONE])

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all links found. Queries whose whole beam links are answered by a product: there may be any number more."""
        if self.dense or not len(q):
            return self._product(q)
        ids, sims = self.graph.search(q.astype(np.float32), self.beam)
        near = sims >= self.threshold - _SLACK
        crowded = near.all(axis=1) if self.beam < len(self.exact) else np.zeros(len(q), bool)
        x, y = np.nonzero(near & ~crowded[:, None])
        y = ids[x, y]
        keep = np.concatenate([np.einsum("ij,ij->i", q[x[k : k + 65536]], self.exact[y[k : k + 65536]]) >= self.threshold for k in range(0, len(x), 65536)] or [np.empty(0, bool)])
        x, y = x[keep], y[keep]
        if crowded.any():
            a, b = self._product(q[crowded])
            x, y = np.concatenate([x, np.flatnonzero(crowded)[a]]), np.concatenate([y, b])
        return x, y

    def _recall(self, q: np.ndarray, own: np.ndarray | None) -> tuple[int, int]:
        """Links found and links there are, a member's link to itself aside."""
        out = []
        for x, y in (self.find(q), self._product(q)):
            out.append(len(x) if own is None else int((own[x] != y).sum()))
        return out[0], out[1]

    def _audit_members(self) -> None:
        """Asks members, spread evenly, until they have LINKS links; widens the beam until RECALL of these are found."""
        n, asked = len(self.exact), AUDITED
        while True:
            own = np.unique(np.linspace(0, n - 1, min(n, asked)).astype(int))
            hits, truth = self._recall(self.exact[own], own)
            if truth < LINKS and asked < n:
                asked *= 2
                continue
            if hits >= RECALL * truth:
                break
            if self.beam >= min(WIDEST, n):
                self.dense, hits = True, truth
                break
            self.beam = min(2 * self.beam, n)
        self.hits, self.truth = hits, truth

    def ask(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """find() for vectors of other shards, some of which are audited: where too few of their links are found, all are answered again, by products from then on."""
        x, y = self.find(q)
        if not self.dense:
            some = np.unique(np.linspace(0, len(q) - 1, min(len(q), PASSING)).astype(int))
            truth, hits = len(self._product(q[some])[0]), int(np.isin(x, some).sum())
            if hits < RECALL * truth:
                self.dense = True
                x, y = self._product(q)
                hits = truth
            self.hits, self.truth = self.hits + hits, self.truth + truth
        return x, y


_NONE = np.empty(0, np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Tile:
    """A block's shards, and the vectors that ask them: counts and united links of both."""

    def __init__(self, parts: list[tuple], alone: bool, threshold: float):
        ids, weights, shard, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(shard, kind="stable")
        self.ids, self.weights, v = ids[order], weights[order], _unit(v[order])
        self.counts, self.root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        starts = np.r_[np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0]), len(ids)].tolist()
        self.shards = [(a, Shard(v[a:b], threshold)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        if alone:
            for a, s in self.shards:
                self._add(a, *s.find(s.exact), own=True)
                for b, t in self.shards:
                    if b > a:
                        self._add(a, *s.ask(t.exact), offset=b)

    def _add(self, a: int, x: np.ndarray, y: np.ndarray, own: bool = False, offset: int | None = None) -> None:
        """Links (x, y) of members from offset on to members from a on."""
        x, y = x + (a if offset is None else offset), y + a
        if own:  # a link that one end finds counts for both, once
            x, y = x[x != y], y[x != y]
            low, high = np.minimum(x, y), np.maximum(x, y)
            code = np.unique(low * len(self.ids) + high)
            x, y = code // len(self.ids), code % len(self.ids)
        self.counts += np.bincount(x, self.weights[y], len(self.ids)).astype(np.int64) + np.bincount(y, self.weights[x], len(self.ids)).astype(np.int64)
        self._unite(x, y)

    def _unite(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.root[x], self.root[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            if not len(x):
                break
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up

    def ask(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> None:
        """Vectors of another block."""
        n = len(self.ids)
        self.ids, self.weights = np.concatenate([self.ids, ids]), np.concatenate([self.weights, weights])
        self.counts, self.root = np.concatenate([self.counts, np.zeros(len(ids), np.int64)]), np.concatenate([self.root, np.arange(n, n + len(ids))])
        q = _unit(vectors)
        for a, s in self.shards:
            self._add(a, *s.ask(q), offset=n)

    def close(self):
        """(kind, a, b): kind 0 adds b links to a, 1 links a and b, 2 is an audit's links found and links there are."""
        met, linked = np.flatnonzero(self.counts), np.flatnonzero(self.root != np.arange(len(self.ids)))
        parts = [(0, self.ids[met], self.counts[met]), (1, self.ids[linked], self.ids[self.root[linked]]), (2, np.array([sum(s.hits for _, s in self.shards)]), np.array([sum(s.truth for _, s in self.shards)]))]
        for kind, a, b in parts:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], schema=_FOUND)


def _search(threshold: float):
    def run(source):
        """Rows sorted by (label, dim, i, j, other): a block's members come first and make its graphs, then another block's vectors pass by."""
        key, members, tile = None, [], None

        def close():
            if members or tile is not None:
                yield from (tile or Tile(members, key[2] == key[3], threshold)).close()

        for batch in source:
            label, dim, i, j, other, shard, ids, weights = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:8])
            flat, offsets = batch.column(8).flatten().to_numpy(zero_copy_only=False), batch.column(8).offsets.to_numpy()
            offsets = offsets - offsets[0]
            edges = np.flatnonzero((np.diff(label) != 0) | (np.diff(dim) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(other.astype(int)) != 0)) + 1
            for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, batch.num_rows].tolist(), strict=True):
                now = (label[a], dim[a], i[a], j[a])
                if now != key:
                    yield from close()
                    key, members, tile = now, [], None
                x = flat[offsets[a] : offsets[b]].reshape(b - a, int(dim[a])).astype(np.float64)
                if not other[a]:
                    members.append((ids[a:b], weights[a:b], shard[a:b], x))
                    continue
                if tile is None:
                    if not members:
                        continue
                    tile = Tile(members, False, threshold)
                tile.ask(ids[a:b], weights[a:b], x)
        yield from close()

    return run


def _classes(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, label, ok, dim, k1, k2, v) and written classes of identical vectors (c, label, dim, k1, k2, rep, n, v); k1 and k2 are a digest of 128 bits."""
    kind = dict(table.dtypes)[vector_col]
    v = F.col(f"`{vector_col}`").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v")).withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    rows = rows.select("id", "label", "ok", F.size("v").alias("dim"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("again"), "v").alias("k2"), "v")
    found = rows.where("ok").groupBy("label", "dim", "k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    return rows, spool(found.withColumn("c", F.monotonically_increasing_id()), "classes")


def search(classes: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """(kind, a, b) as Tile.close() has them, for classes (c, label, dim, k1, n, v); written.

    Each label's classes are dealt to shards of about shard members, and these to blocks. A task holds one block
    and lets one other block, or its own members, ask all its shards; a vector is sent once for each block.
    """
    size = F.greatest(F.lit(1), F.least(F.lit(shard), F.floor(F.lit(VALUES // SHARDS) / F.col("dim"))))
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("shards")).withColumn("blocks", F.ceil(F.col("shards") / SHARDS).cast("long"))
    own = F.pmod(F.xxhash64("k1", F.lit("shard")), F.col("shards"))
    dealt = classes.join(counts, ["label", "dim"]).withColumn("shard", own).withColumn("block", F.floor(F.col("shard") / SHARDS)).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    i, j = F.least("block", "met"), F.greatest("block", "met")
    ready = dealt.select("label", "dim", i.alias("i"), j.alias("j"), (F.col("block") != i).alias("other"), "shard", F.col("c"), "n", "v")
    k = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spool(ready.repartition(k, "label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j", "other", "c").mapInArrow(_search(threshold), "kind int, a long, b long"), "found")


def audited_recall(found: DataFrame) -> DataFrame:
    """One row: links that the audits of search() found, links there were, and their share (null where there were none)."""
    return found.where("kind = 2").agg(F.sum("a").alias("hits"), F.sum("b").alias("links")).withColumn("recall", F.try_divide("hits", "links"))


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of table.

    Vectors of equal labels and lengths link at a cosine of threshold or more, in double precision; none found is
    below it, and ties with it link. Identical vectors are one class, which is searched once and counts with its
    size. Every shard of a label is asked by every vector of that label, by itself or, for pairs of shards, from
    one side; a link counts for both ends. Links are those that the beams find: at least RECALL of them in each
    audit, of a shard's own members (all of them, where links are rare) and of vectors that ask it. A shard that
    fails at the widest beam, and a vector whose whole beam links, are answered by dense products of bounded size.

    A row with a null vec_id, label or vector, or a vector that is empty, zero or holds null or non-finite
    components, links with nothing and is its own component. Long vectors make smaller shards. Repeated rows count
    as vectors of their own. An empty table gives none. Further columns are not read, whatever they are called.
    """
    bounded_batches(table.sparkSession)
    rows, classes = _classes(table, id_col, vector_col, label_col)
    found = search(classes, threshold, shard)
    more = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("found")).withColumnRenamed("a", "c")
    rooted = components(found.where("kind = 1").select("a", "b"))
    placed = classes.select("c", "label", "dim", "k1", "k2", "rep", "n").join(more, "c", "left").join(rooted.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = placed.join(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("label", "dim", "k1", "k2", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), "component_id")
    # Written first, so that adaptive execution may split the join at a vector that many rows have.
    known = spool(named, "named")
    for df in (classes, found, rooted):
        unspool(df)
    good = rows.where("ok").select("id", "label", "dim", "k1", "k2").join(known, ["label", "dim", "k1", "k2"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    lone = rows.where("not ok").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

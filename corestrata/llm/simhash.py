"""SimHash fingerprints and bit-sliced search for those within a Hamming radius."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corestrata.llm.common import batches, bounded_batches, few_files, pair, spool, texts, unspool
from corestrata.llm.exact import BROADCAST_BYTES, one_of_gone, only, row_key, text_digest
from corestrata.llm.graph import components, roots

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints that one bucket compares at once; larger buckets are divided by further bits.
BUCKET = 4096
#: Near copies by similarity: words of a shingle, the similarity as a fraction, and a radius that next to no pair of that similarity exceeds.
SIMILAR_WORDS, SIMILAR, SIMILAR_RADIUS = 5, (4, 5), 22
#: Bands of least hashes, of which sets of similarity 0.8 share one but for 1 in 40,000: 1 - 0.8 ** 4, to the power of 20.
BANDS, ROWS_A_BAND = 20, 4
#: Bytes of a row of a few numbers in a broadcast table, as measured.
ROW_BYTES = 80
#: Members of a part of a tile, and hashes of their sets, at most about; a tile compares two parts.
TILE, TILE_HASHES = 1024, 1 << 18
#: Pairs of a query and a word of 64 lanes that are under way at a time.
UNDER_WAY = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_SIGNED = pa.schema([("id", pa.int64()), ("row", pa.binary()), ("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
_TURN, _MULTIPLY = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS_A_BAND), np.uint64)
_MULTIPLY |= np.uint64(1)
_LINKS = pa.schema([("node", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def shingles(text: str, size: int = SHINGLE) -> list[bytes]:
    """Of the words of a whole text with A-Z lowered; words lie between blanks and \\x09-\\x0D. Fewer words than size: the whole sequence."""
    words = text.encode().translate(_LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    return [line[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64 bits, each 1 where over half of the shingles' XXH64 have it; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    parts = shingles(text, size)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(parts), 65536):
        hashes = np.array([xxh64_intdigest(x, SEED) for x in parts[i : i + 65536]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view("<u8")[0])


def _fingerprint_batches(source):
    yield from batches(source, lambda b: [b.column(0), np.array([fingerprint(t) for t in texts(b.column(1))], np.uint64).view(np.int64)], _FINGERPRINTS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; null texts count as empty."""
    return pair(docs, id_col, text_col).select(F.col("_id").cast("long"), "_value").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """Vertical form: row b holds bit b of all lanes, 64 lanes to a word."""
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, valid: np.ndarray, queries: np.ndarray, words: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(which, lanes): for those pairs of a query and a word with lanes within radius, the pair's position and a mask of the lanes.

    Carry-save counters in bit-sliced form: counter k holds bit k of 64 distances; the last one stays set once
    reached. Every eight planes the pairs whose lanes all exceed the radius are abandoned.
    """
    which = np.arange(len(queries))
    n = radius.bit_length() + 1
    counters = [np.zeros(len(queries), np.uint64) for _ in range(n)]
    for b in range(64):
        carry = planes[b][words] ^ ((queries >> np.uint64(b)) & np.uint64(1)) * _ALL
        for k in range(n - 1):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        counters[n - 1] |= carry
        if b % 8 == 7:
            far = counters[n - 1].copy()
            for count in range(radius + 1, 1 << (n - 1)):  # counts that the lower counters can show beyond the radius
                same = np.full(len(words), _ALL)
                for k in range(n - 1):
                    same &= counters[k] if count >> k & 1 else ~counters[k]
                far |= same
            near = ~far & valid[words]
            keep = near != 0
            if not keep.all():
                which, queries, words, near = which[keep], queries[keep], words[keep], near[keep]
                counters = [c[keep] for c in counters]
    return which, near


def bucket_hits(values: np.ndarray, buckets: np.ndarray, radius: int = RADIUS):
    """(x, y) positions, x < y, of all pairs within radius that share a bucket (equal buckets adjoin), in bounded parts.

    Each bucket begins in a word of its own, or shares one with other small buckets; every fingerprint is held
    against the words of its own bucket.
    """
    n = len(values)
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[starts, n])
    at, place = 0, np.empty(len(starts), np.int64)
    for i, size in enumerate(sizes.tolist()):
        if at % 64 + size > 64:
            at += -at % 64
        place[i] = at
        at += size
    lane = np.arange(n) + np.repeat(place - starts, sizes)
    total = at + -at % 64
    lanes, valid, owner = np.zeros(total, np.uint64), np.zeros(total, bool), np.full(total, -1)
    lanes[lane], valid[lane], owner[lane] = values, True, np.arange(n)
    planes, mask = planes_of(lanes), np.packbits(valid, bitorder="little").view("<u8")
    first, last = place // 64, (place + sizes - 1) // 64
    spread = np.repeat(last - first + 1, sizes)  # words that each fingerprint meets
    group = np.repeat(np.arange(len(starts)), sizes)
    at = 0
    reach = np.cumsum(spread)
    while at < n:
        end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + UNDER_WAY, "right")))
        some = np.repeat(np.arange(at, end), spread[at:end])
        words = first[group[some]] + np.arange(len(some)) - np.repeat(np.cumsum(spread[at:end]) - spread[at:end], spread[at:end])
        which, near = within(planes, mask, values[some], words, radius)
        for k in range(0, len(which), UNDER_WAY // 8):
            hit = np.unpackbits(near[k : k + UNDER_WAY // 8].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            row, bit = np.nonzero(hit)
            x, y = some[which[row + k]], owner[words[which[row + k]] * 64 + bit]
            ok = (x < y) & (group[x] == group[y])
            yield x[ok], y[ok]
        at = end


def bucket_links(values: np.ndarray, buckets: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of distinct fingerprints that share a bucket: enough of them to join all that are within radius, at most one a fingerprint."""
    found = list(bucket_hits(values, buckets, radius))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    root = roots(len(values), np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def _masks(radius: int) -> list[list[int]]:
    """By level, masks of bits that a bucket's members share. A node's free bits are cut into radius + 1 parts, of which one at least is equal in a pair within radius; each part makes a child."""
    levels: list[list[int]] = []
    nodes = [0]
    while True:
        free = [[b for b in range(64) if not m >> b & 1] for m in nodes]
        if levels and (1 << max(map(len, free))) <= BUCKET:
            return levels
        nodes = [m | sum(1 << b for b in bits[i * len(bits) // (radius + 1) : (i + 1) * len(bits) // (radius + 1)]) for m, bits in zip(nodes, free, strict=True) for i in range(radius + 1)]
        levels.append(nodes)


def _compare(radius: int):
    def run(source):
        """Rows sorted by (node, key): links of buckets, as node -1; members of buckets beyond BUCKET return with their node, as a = b."""
        held: list[np.ndarray] = [np.empty((0, 3), np.int64)]
        count, large = 0, None  # the bucket that is being passed on

        def out(node, a, b):
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)

        def flush(rows, last):
            nonlocal large
            new = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[new, len(rows)])
            bucket = np.repeat(np.arange(len(new)), sizes)
            big = sizes > BUCKET
            if large is not None and len(rows):
                big[0] |= tuple(rows[0, :2]) == large
            keep_from = len(rows)
            if not last and len(new):
                if big[-1]:
                    large = tuple(rows[-1, :2].tolist())
                else:
                    large, keep_from = None, int(new[-1])
            done = rows[:keep_from]
            bucket = bucket[:keep_from]
            over = big[bucket]
            if over.any():
                yield out(done[over, 0], done[over, 2], done[over, 2])
            some = ~over & (sizes[bucket] > 1)
            if some.any():
                a, b = bucket_links(done[some, 2].view(np.uint64), bucket[some], radius)
                if len(a):
                    yield out(np.full(len(a), -1), a.view(np.int64), b.view(np.int64))
            return rows[keep_from:]

        for batch in source:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
                count += batch.num_rows
                if count >= 4 * BUCKET:
                    rest = yield from flush(np.concatenate(held), False)
                    held, count = [rest], len(rest)
        yield from flush(np.concatenate(held), True)

    return run


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps (fp long, distinct) -> links (a, b) that join all fingerprints within radius of each other, and none further apart.

    Buckets share a third of the bits (radius 2), and a pair within radius meets in one at least. A bucket with
    more than BUCKET members is divided anew by a third of its free bits, until these leave no room for more
    members; so no bucket, however common its bits, is compared in one piece or cut short.
    """
    parts: list[DataFrame] = []
    rows = fps.select(F.lit(0).alias("node"), F.col("fp"))
    for nodes in _masks(radius):
        if len(nodes) == radius + 1:
            keyed = F.array(*(F.struct(F.lit(i).alias("node"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for i, m in enumerate(nodes)))
        else:
            masks = F.array(*(F.lit(_signed(m)) for m in nodes))
            child = [F.col("node") * (radius + 1) + i for i in range(radius + 1)]
            keyed = F.array(*(F.struct(c.cast("int").alias("node"), F.col("fp").bitwiseAND(F.element_at(masks, (c + 1).cast("int"))).alias("key")) for c in child))
        dealt = rows.select("fp", F.explode(keyed).alias("k")).select(F.col("k.node").cast("int").alias("node"), F.col("k.key").alias("key"), "fp")
        n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = spool(dealt.repartition(n, "node", "key").sortWithinPartitions("node", "key").mapInArrow(_compare(radius), "node int, a long, b long"), "links")
        parts.append(found.where("node = -1").select("a", "b"))
        rows = found.where("node >= 0").select("node", F.col("a").alias("fp"))
        if rows.isEmpty():
            break
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    return links


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def near_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id, group_size for each row of docs.

    Texts with equal fingerprints are one class; classes within radius link, at radius itself too; component_id is
    the smallest doc_id that links reach. Whole texts of any length count, repeats of shingles included; texts
    without words have fingerprint 0 and link like others. Null texts count as empty; null doc_ids get a row but
    never name a component, unless it has no other (then null). Repeated rows each give a row. An empty table gives
    none. group_size counts the rows of the component. Further columns are not read, whatever they are called.
    """
    own = spool(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    joined = components(near_links(classes.select("fp"), radius))
    rooted = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    of = rooted.select("fp", "root").join(named, "root").drop("root")
    return own.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_size")


# Near copies by the similarity of whole texts: the same fingerprints, over longer shingles and with a wide radius, whose pairs are then checked exactly.


def shingle_set(text: str, size: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct shingles' XXH64, ascending as signed numbers."""
    from xxhash import xxh64_intdigest

    return np.unique(np.array([xxh64_intdigest(x, SEED) for x in shingles(text, size)], np.uint64).view(np.int64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 where over half of the hashes have it, as a signed number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS numbers, each of ROWS_A_BAND least hashes under mixing functions of their own; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(_MULTIPLY), _ALL)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].view(np.uint64)
        np.minimum(least, ((part[:, None] ^ _TURN) * _MULTIPLY).min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS_A_BAND).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _signatures(size: int):
    def run(source):
        from xxhash import xxh64_intdigest

        def make(batch):
            own = [shingle_set(t, size) for t in texts(batch.column(2))]
            keys = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in own], np.uint64).view(np.int64)
            return [batch.column(0), batch.column(1), keys, [set_fingerprint(s) for s in own], [len(s) for s in own], _lists([bands(s) for s in own])]

        for batch in source:
            for k in range(0, batch.num_rows, 250):
                yield from batches([batch.slice(k, 250)], make, _SIGNED)

    return run


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_WORDS) -> DataFrame:
    """(id, row, key, fp, n, bands) for each row, written: row is its row_key(), key stands for the set of its n shingles, fp is the set's fingerprint."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(F.col(f"`{id_col}`"), text_digest(text_col)).alias("row"), F.col(f"`{text_col}`").alias("value"))
    return spool(rows.mapInArrow(_signatures(size), "id long, row binary, key long, fp long, n long, bands array<long>"), "signatures")


def _sets(size: int):
    schema = pa.schema([("key", pa.int64()), ("h", pa.list_(pa.int64()))])

    def run(source):
        from xxhash import xxh64_intdigest

        def make(batch):
            own = [shingle_set(t, size) for t in texts(batch.column(0))]
            return [np.array([xxh64_intdigest(s.tobytes(), SEED) for s in own], np.uint64).view(np.int64), _lists(own)]

        yield from batches(source, make, schema)

    return run


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """Sets as rows of bits, 64 to a word: a bit for each hash that two sets or more hold."""
    flat = np.concatenate(sets)
    known, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[column >= 0]
    column = column[column >= 0]
    out = np.zeros((len(sets), -(-int((count > 1).sum()) // 64) or 1), np.uint64)
    np.bitwise_or.at(out, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return out


def tile_links(members: np.ndarray, sets: list[np.ndarray], buckets: np.ndarray, radius: int, least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links of tiles (equal buckets adjoin): of pairs within radius whose components differ, as many that are similar as unite those that are. members: i, j, part, root, key, fp, n by row."""
    i, j, part, root, key, fp, n = members.T
    own = {int(r): int(r) for r in root}

    def top(r):
        while own[r] != r:
            own[r] = r = own[own[r]]
        return r

    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    ends = np.r_[starts[1:], len(buckets)]
    out, bits, at = [], None, -1
    for x, y in bucket_hits(fp.view(np.uint64).copy(), buckets, radius):
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        ok = (root[x] != root[y]) & (least[1] * small >= least[0] * large) & ((i[x] == j[x]) | (part[x] != part[y]))
        x, y = x[ok], y[ok]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        edges = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else x
        for a, b in zip(edges.tolist(), np.r_[edges[1:], len(x)].tolist(), strict=True):
            q, others = int(x[a]), y[a:b]
            if b - a > 8:
                home = int(np.searchsorted(starts, q, "right")) - 1
                if home != at:
                    bits, at = _bits(sets[starts[home] : ends[home]]), home
                common = np.bitwise_count(bits[others - starts[home]] & bits[q - starts[home]]).sum(axis=1, dtype=np.int64)
            else:
                common = np.array([len(np.intersect1d(sets[q], sets[o], assume_unique=True)) for o in others.tolist()], np.int64)
            for o in others[sum(least) * common >= least[0] * (n[q] + n[others])].tolist():
                r, t = top(int(root[q])), top(int(root[o]))
                if r != t:
                    own[max(r, t)] = min(r, t)
                    out.append((int(key[q]), int(key[o])))
    return out


def _across(radius: int, least: tuple[int, int]):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source):
        """Rows sorted by (h, i, j): a tile's members, of part i and of part j; where i < j, only pairs of one of each are looked at."""
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        size = 0

        def flush(last):
            rows, sets = np.concatenate([x for x, _ in held]), [s for _, some in held for s in some]
            new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
            stop = len(rows) if last else int(np.flatnonzero(new)[-1])
            found = tile_links(rows[:stop, 1:], sets[:stop], np.cumsum(new)[:stop], radius, least) if stop else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=schema)
            return rows[stop:], sets[stop:]

        for batch in source:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                ends, flat = some.column(8).offsets.to_numpy(), some.column(8).values.to_numpy(zero_copy_only=False)
                sets = [flat[a:b].copy() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                held.append((np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in some.columns[:8]], axis=1), sets))
                size += int(ends[-1] - ends[0]) + some.num_rows
                if size >= 4 * TILE_HASHES:
                    rest = yield from flush(False)
                    held, size = [rest], sum(map(len, rest[1])) + len(rest[1])
        if held:
            yield from flush(True)

    return run


def similar_links(docs: DataFrame, signed: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_WORDS, radius: int = SIMILAR_RADIUS, least: tuple[int, int] = SIMILAR, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """signatures() of docs -> links (a, b) of keys that join all sets of similarity least or more, as far as bands and radius reach, and none below.

    Sets that share a band meet in its bucket. First each is held against one of its bucket; what the pairs found
    unite is one component, however many copies it has. Then buckets in which components meet are compared
    bit-sliced, in tiles of bounded size, and pairs within radius are decided there by the whole sets, so that no
    more links leave a tile than unite its members. Sets are made anew, from the texts of documents that share a band.
    """
    some = signed.where("n > 0")
    if some.agg(F.count(F.lit(1)) > F.count_distinct("key")).first()[0]:  # of equal sets one serves
        some = spool(some.groupBy("key").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "distinct")
    posts = some.select(F.explode("bands").alias("h"), "key")
    met = spool(few_files(posts.groupBy("h").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1"), BANDS * some.count()), "buckets")
    shared = spool(posts.join(F.broadcast(met) if met.count() * ROW_BYTES <= broadcast_bytes else met, "h").select("h", "key", "lead"), "shared")
    most = shared.count()
    named = spool(few_files(shared.select("key").distinct(), most), "named")
    slim = spool(some.select("key", "row", "fp", "n").join(F.broadcast(named) if named.count() * ROW_BYTES <= broadcast_bytes else named, "key", "left_semi"), "slim")
    texts_ = only(docs, slim.select(F.col("row").alias("_gone")), row_key(F.col(f"`{id_col}`"), text_digest(text_col)), broadcast_bytes).groupBy("_key").agg(F.first(F.col("_own")[text_col]).alias("value"))
    sets = spool(texts_.select("value").mapInArrow(_sets(size), "key long, s array<long>"), "sets")

    stars = shared.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
    a, b = (slim.select(F.col("key").alias(x), F.col("fp").alias(f"f{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    near = (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius) & (least[1] * F.least("na", "nb") >= least[0] * F.greatest("na", "nb"))
    pairs = spool(few_files(stars.join(a, "a").join(b, "b").where(near).select("a", "b"), most), "pairs")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    found = spool(both.where(sum(least) * common >= least[0] * (F.size("sa") + F.size("sb"))).select("a", "b"), "links")

    of = components(found).withColumnRenamed("node", "key")
    placed = spool(few_files(shared.select("h", "key").join(slim.join(of, "key", "left").select("key", "fp", "n", F.coalesce("root", "key").alias("root")), "key"), most), "placed")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_HASHES)).cast("long")
    mixed = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), parts.alias("parts")).where("low < high").select("h", "parts")
    tiled = placed.join(mixed, "h").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = tiled.join(sets, "key").select("h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "root", "key", "fp", "n", "s")
    k = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = spool(rows.repartition(k, "h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_across(radius, least), "a long, b long"), "more")
    for df in (met, shared, named, slim, sets, pairs, placed):
        unspool(df)
    return found.unionByName(more)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_WORDS, radius: int = SIMILAR_RADIUS, least: tuple[int, int] = SIMILAR, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, less near copies: of each component the row of the least doc_id stays, of such rows any one.

    Texts link where the sets of their shingles (size words, with A-Z lowered; shorter texts are one shingle) have
    a Jaccard similarity of least or more, their SimHash fingerprints are within radius, and they share a band of
    least hashes. At a similarity of 0.8 fingerprints differ in 10 bits of 64 on average, with a deviation of 3,
    so that about one pair in 70,000 lies beyond 22; and one in 40,000 shares none of 20 bands of 4. Every pair
    that meets is then decided by the whole sets. Hashes of 64 bits stand for shingles. Null texts count as empty, and texts without
    words are alike; long texts are taken whole. A null doc_id comes after all others. Of rows that repeat doc_id
    and text one stays. Ties are settled by a digest. An empty table gives none; columns may have any names.
    """
    written = signatures(docs, id_col, text_col, size)
    rooted = components(similar_links(docs, written, id_col, text_col, size, radius, least, broadcast_bytes))
    rows = spool(written.select("id", "row", "key").join(rooted.withColumnRenamed("node", "key"), "key", "left").select("id", "row", F.coalesce("root", "key").alias("root")), "rows")
    unspool(written)
    unspool(rooted)
    # The name of each component with more than one row
    named = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.col("name.row").alias("name"))
    most = rows.count()
    named = spool(few_files(named, most), "named")
    members = rows.join(named, "root").groupBy("row").agg(F.max(F.col("row") == F.col("name")).alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = spool(few_files(members.where("not stays or n > 1").select(F.col("row").alias("_gone"), "stays"), most), "gone")
    unspool(named)
    unspool(rows)
    return one_of_gone(docs, gone, id_col, text_col, broadcast_bytes)

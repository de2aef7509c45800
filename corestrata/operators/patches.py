"""Patches as relations: entries chosen in Arrow batches, everything else joins and aggregates."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corestrata.functions import classify, codecs, delta, fixed
from corestrata.functions.cutting import cut
from corestrata.functions.hashing import Windows, super_features
from corestrata.functions.profiles import Malformed, Profile
from corestrata.operators import candidates, chunking, reuse
from corestrata.operators.arrow import each_row
from corestrata.sources import manifests
from corestrata.sources import patches as binary


def _both(base: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return target.select(*keys, F.col("bytes").alias("target_bytes")).join(base.select(*keys, F.col("bytes").alias("base_bytes")), keys, "left")


def _parts(data: bytes, profile: Profile) -> list[tuple[bytes, int, int]]:
    import hashlib

    out, at = [], 0
    for n in cut(data, profile):
        out.append((hashlib.sha256(data[at : at + n]).digest(), at, n))
        at += n
    return out


def _wanted(base: bytes, target: bytes, profile: Profile):
    """The base as a manifest, and the first occurrences that it lacks."""
    b = _parts(base, profile)
    known, seen, out = {c for c, _, _ in b}, set(), []
    for i, (chunk, at, n) in enumerate(_parts(target, profile)):
        if chunk not in known and chunk not in seen:
            seen.add(chunk)
            out.append((i, chunk, at, n))
    return manifests.Manifest(fixed.SHA256_SUITE, profile.profile_id, bytes(32), [(c, n) for c, _, n in b]), out


_ENTRY = pa.schema([("idx", pa.int64()), ("id", pa.string()), ("len", pa.int64()), ("encoding", pa.int32()), ("dict", pa.list_(pa.string())), ("stored", pa.binary()), ("choice", pa.int32())])


def entries(base: DataFrame, target: DataFrame, keys: list[str], profile: Profile, level: int = 19, ranked: bool = False, run: int = 4, radius: int = candidates.RADIUS, most: int = candidates.MOST) -> DataFrame:
    """run, radius and most say how long, how near and how many the dictionaries are. One row for each distinct chunk that the base lacks: idx, id, len, encoding, dict (ids), stored, stored_len, dict_count, choice (the dictionary's number, -1 for none, -2 for raw)."""
    pick = binary.choose_ranked if ranked else binary.choose

    def make(t, b):
        t, b = t or b"", b or b""
        m, wanted = _wanted(b, t, profile)
        for i, chunk, at, n in wanted:
            e, which = pick(chunk, t[at : at + n], binary.dictionaries(m, b, at, run, radius, most) if run and most else [], level=level)
            yield i, chunk.hex(), n, e.encoding, [c.hex() for c in e.dictionary], e.stored, which

    out = each_row(_both(base, target, keys), keys, ["target_bytes", "base_bytes"], "idx long, id string, len long, encoding int, dict array<string>, stored binary, choice int", _ENTRY, make)
    return out.withColumn("stored_len", F.octet_length("stored").cast("long")).withColumn("dict_count", F.size("dict"))


def trace(base: DataFrame, target: DataFrame, keys: list[str], profile: Profile, level: int = 19) -> DataFrame:
    """Every candidate of every wanted chunk: its ordinal and cost, and whether it would be chosen; -2 is raw, -1 plain zstd."""
    schema = pa.schema([("idx", pa.int64()), ("ordinal", pa.int32()), ("cost", pa.int64()), ("selected", pa.bool_())])

    def make(t, b):
        t, b = t or b"", b or b""
        m, wanted = _wanted(b, t, profile)
        for i, _, at, n in wanted:
            raw = t[at : at + n]
            costs = [(-2, n), (-1, len(codecs.compress(raw, level=level)))]
            costs += [(k, codecs.cost(len(codecs.compress(raw, d, level)), len(r))) for k, (r, d) in enumerate(binary.dictionaries(m, b, at)) if d and codecs.usable_dictionary(d)]
            best = min(costs, key=lambda x: (x[1], x[0]))[0]
            yield from ((i, k, c, k == best) for k, c in costs)

    return each_row(_both(base, target, keys), keys, ["target_bytes", "base_bytes"], "idx long, ordinal int, cost long, selected boolean", schema, make)


def statistics(made: DataFrame, keys: list[str]) -> DataFrame:
    """Entries by encoding, references, stored bytes, and blocks: the order of entries decides these, so the greedy fold runs over one patch's list."""
    sizes = F.transform(F.sort_array(F.collect_list(F.struct("idx", (40 + 32 * F.col("dict_count") + F.col("stored_len")).alias("size")))), lambda r: r["size"])
    step = lambda a, s: F.when((a["n"] > 0) & ((a["n"] == binary.ENTRIES) | (a["size"] + s > binary.BLOCK_BYTES)), F.struct((a["blocks"] + 1).alias("blocks"), F.lit(1).cast("long").alias("n"), s.cast("long").alias("size"))).otherwise(F.struct(a["blocks"].alias("blocks"), (a["n"] + 1).alias("n"), (a["size"] + s).cast("long").alias("size")))
    zero = F.struct(F.lit(1).cast("long").alias("blocks"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("size"))
    z = F.col("encoding") == codecs.ZSTD
    return made.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.count_if(~z).alias("raw_entries"), F.count_if(z & (F.col("dict_count") == 0)).alias("zstd_entries"), F.count_if(F.col("dict_count") > 0).alias("dictionary_entries"), F.sum("dict_count").alias("references"), F.sum("stored_len").alias("stored_bytes"), F.aggregate(sizes, zero, step)["blocks"].alias("blocks"))


def study(base: DataFrame, target: DataFrame, keys: list[str], profile: Profile, level: int = 19) -> DataFrame:
    """Stored bytes of a pair by the way they would be encoded: all of the target in one frame, missing chunks raw, in frames, against runs of 1, 2 or 4 base chunks, the whole target against the whole base, and a delta by suffix sorting."""
    lanes = ("full_zstd", "raw", "zstd", "dict_k1", "dict_k2", "dict_k4", "patch_from", "delta")
    schema = pa.schema([(x, pa.int64()) for x in lanes])

    def make(t, b):
        t, b = t or b"", b or b""
        m, wanted = _wanted(b, t, profile)
        out = dict.fromkeys(lanes, 0)
        out["full_zstd"] = len(codecs.compress(t, level=level))
        out["patch_from"] = len(codecs.patch_from(t, b, level))
        out["delta"] = len(delta.make(b, t))
        for _, chunk, at, n in wanted:
            raw = t[at : at + n]
            out["raw"] += n
            out["zstd"] += min(n, len(codecs.compress(raw, level=level)))
            for k in (1, 2, 4):
                e, _ = binary.choose(chunk, raw, binary.dictionaries(m, b, at, k), level)
                out[f"dict_k{k}"] += codecs.cost(len(e.stored), len(e.dictionary))
        yield tuple(out.values())

    return each_row(_both(base, target, keys), keys, ["target_bytes", "base_bytes"], ", ".join(f"{x} long" for x in lanes), schema, make)


def _decoded(encoding: int, stored: bytes, length: int, dictionary: bytes | None):
    try:
        yield (codecs.decode(encoding, stored, length, dictionary or b""),)
    except Malformed:
        yield (None,)


def apply_entries(target: DataFrame, base: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """target: records (keys..., idx, id, len); base: chunks with payload; made: entries(). (keys..., bytes, bad): the target's bytes and how many records could not be resolved and verified.

    Dictionaries are put together by a join on the ids that entries name; each distinct entry is decoded once.
    """
    have = base.groupBy(*keys, "id").agg(F.min_by("payload", "idx").alias("base_payload"))
    named = made.select(*keys, "id", F.posexplode("dict").alias("pos", "ref"))
    found = named.join(have.withColumnRenamed("id", "ref"), [*keys, "ref"], "left")
    parts = found.groupBy(*keys, "id").agg(F.sort_array(F.collect_list(F.struct("pos", "base_payload"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["base_payload"]))
    with_dict = made.join(parts.select(*keys, "id", joined.alias("dictionary")), [*keys, "id"], "left")
    decoded = each_row(with_dict, [*keys, "id"], ["encoding", "stored", "len", "dictionary"], "entry_payload binary", pa.schema([("entry_payload", pa.binary())]), _decoded)
    resolved = target.join(decoded, [*keys, "id"], "left").join(have, [*keys, "id"], "left").withColumn("payload", F.coalesce("entry_payload", "base_payload"))
    good = (F.sha2("payload", 256) == F.col("id")) & (F.octet_length("payload") == F.col("len"))
    parts = resolved.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "payload"))).alias("parts"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"))
    # Joined outside Spark, whose concat would copy what there is for every record.
    return each_row(parts, [*keys, "bad"], ["parts"], "bytes binary", pa.schema([("bytes", pa.binary())]), lambda p: [(b"".join(x["payload"] or b"" for x in p),)])


def roundtrip(base: DataFrame, target: DataFrame, keys: list[str], profile: Profile, level: int = 19) -> DataFrame:
    """Create and apply. Empty targets have no records and come back empty."""
    records = chunking.cdc_chunks(target, profile).select(*keys, "idx", "id", "len")
    made = entries(base, target, keys, profile, level)
    done = apply_entries(records, chunking.cdc_chunks(base, profile, payload=True), made, keys).where("bad = 0")
    return target.select(*keys).join(done, keys, "left").select(*keys, F.coalesce("bytes", F.lit(b"")).alias("bytes"))


def patch_files(base: DataFrame, target: DataFrame, keys: list[str], profile: Profile, profile_id: str = fixed.STABLE_PROFILE, suite: str = fixed.SHA256_SUITE, level: int = 19) -> DataFrame:
    """(keys..., base_manifest, base_bytes, patch): binary patches, each with its base."""
    schema = pa.schema([("base_manifest", pa.binary()), ("base_bytes", pa.binary()), ("patch", pa.binary())])

    def make(t, b):
        t, b = t or b"", b or b""
        bm = manifests.write(manifests.create(b, profile, profile_id, suite))
        tm = manifests.write(manifests.create(t, profile, profile_id, suite), index=True)
        yield bm, b, binary.create(tm, t, bm, b, level)

    return each_row(_both(base, target, keys), keys, ["target_bytes", "base_bytes"], "base_manifest binary, base_bytes binary, patch binary", schema, make)


def apply_files(made: DataFrame, keys: list[str], recheck: str = "boundary") -> DataFrame:
    """(keys..., bytes, flags, error): one bad patch gives a row that says so, not a failed job."""
    schema = pa.schema([("bytes", pa.binary()), ("flags", pa.int64()), ("error", pa.string())])

    def make(bm, b, p):
        try:
            yield binary.apply(p, bm, b, recheck), 0, None
        except binary.Rejected as e:
            yield None, e.flags, "verification"
        except Malformed as e:
            yield None, 0, f"malformed: {e}"
        except ValueError as e:
            yield None, 0, f"unsupported: {e}"

    return each_row(made, keys, ["base_manifest", "base_bytes", "patch"], "bytes binary, flags long, error string", schema, make)


def ledgers(made: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes of each patch by what they hold."""
    names = ("fixed", "headers", "manifest", "base", "entry_headers", "references", "stored", "index", "checksums")
    return each_row(made, keys, ["patch"], ", ".join(f"`{n}` long" for n in names), pa.schema([(n, pa.int64()) for n in names]), lambda p: [tuple(binary.ledger(p)[n] for n in names)])


def binding(given: DataFrame) -> DataFrame:
    """given: depends, base_suite (null: no base), suite, base_flags, expected, base_id. The first failure in the order: no base, another suite, a base manifest in doubt (its profile's meaning aside), another base."""
    wrong = F.when(~F.col("depends"), 0).when(F.col("base_suite").isNull(), binary.BASE_MISMATCH).when(F.col("base_suite") != F.col("suite"), binary.BASE_MISMATCH).when(F.col("base_flags").bitwiseAND(~manifests.PROFILE_SEMANTICS) != 0, binary.BASE_MANIFEST).when(F.col("base_id") != F.col("expected"), binary.BASE_MISMATCH).otherwise(0)
    return given.withColumn("flags", wrong)


def manifest_size(chunks: Column) -> Column:
    """Bytes of a manifest of so many chunks, with its block index; identifiers as in a manifest of the stable profile.

    A file's length is linear in its chunks and blocks, so it follows from the lengths of three written files.
    """
    from functools import reduce

    def written(n: int) -> int:
        m = manifests.Manifest(fixed.SHA256_SUITE, fixed.STABLE_PROFILE, bytes(32), [(bytes(32), 1)] * n)
        return len(manifests.write(m, index=True))

    one, two = written(1), written(2)
    chunk = two - one
    block = written(manifests.BLOCK + 1) - one - manifests.BLOCK * chunk
    blocks = F.ceil(chunks / manifests.BLOCK)
    return reduce(Column.__add__, (F.lit(one - chunk - block), chunk * chunks, block * blocks)).cast("long")


def framing_size(chunks: Column, made: Column, references: Column, with_base: bool = True) -> Column:
    """Bytes of a patch besides its stored bytes, with a manifest of so many chunks: found from written patches as in manifest_size()."""
    records = [(i.to_bytes(32, "big"), 1) for i in range(binary.ENTRIES + 1)]
    target = manifests.write(manifests.Manifest(fixed.SHA256_SUITE, fixed.STABLE_PROFILE, bytes(32), records), index=True)

    def written(n: int, refs: int = 0) -> int:
        new = [binary.Entry(c, codecs.ZSTD if refs else codecs.RAW, (bytes(32),) * refs, b"x") for c, _ in records[:n]]
        return len(binary.write(target, bytes(32) if with_base else None, new)) - n - len(target)

    none, one = written(0), written(1)
    entry = written(2) - one
    reference, block = written(1, 1) - one, one - none - entry
    return (manifest_size(chunks) + none + entry * made + reference * references + block * F.ceil(made / binary.ENTRIES)).cast("long")


def framing(df: DataFrame, chunks: Column, made: Column, references: Column) -> DataFrame:
    """Bytes of a manifest and of a patch besides its stored bytes."""
    return df.withColumn("manifest_bytes", manifest_size(chunks)).withColumn("framing_bytes", framing_size(chunks, made, references))


def usable(dictionary: Column, most: int = codecs.DICTIONARY_BYTES, magic: bytes = fixed.ZSTD_DICTIONARY_MAGIC) -> Column:
    return (F.octet_length(dictionary) <= most) & ~F.startswith(dictionary, F.lit(magic))


def dictionary_cost(stored: Column, references: Column) -> Column:
    return stored + 32 * references


def super_feature_keys(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., idx, off, key): three rows for each chunk (with payload); key as 16 hexadecimal digits."""
    schema = pa.schema([("key", pa.string())])
    return each_row(chunks, [*keys, "idx", "off"], ["payload"], "key string", schema, lambda p: [(f"{k:016x}",) for k in super_features(p)])


def exact_windows(base: DataFrame, target: DataFrame, keys: list[str], size: int, grid: int) -> DataFrame:
    """Windows of size bytes of the base, on a grid, that occur anywhere in the target: (keys..., base_at, target_at), the first occurrence of each. A pair's contents meet in one row, where hashes propose and bytes decide; of rows that repeat their keys the least place counts."""
    if size < 1 or grid < 1:
        raise ValueError("windows and grids have one byte at least")
    found = pa.schema([("base_at", pa.int64()), ("target_at", pa.int64())])
    pairs = each_row(_both(base, target, keys), keys, ["base_bytes", "target_bytes"], "base_at long, target_at long", found, lambda b, t: Windows(b or b"", size, grid).first(t or b""))
    return pairs.groupBy(*keys, "base_at").agg(F.min("target_at").alias("target_at"))


def residuals(base: DataFrame, target: DataFrame, keys: list[str], level: int = 3) -> DataFrame:
    """(keys..., bytes, xor_bytes, sparse_bytes, runs, restored): what a target weighs as the compressed XOR with its base and as the runs in which it differs, and whether both give it back."""
    schema = pa.schema([("bytes", pa.int64()), ("xor_bytes", pa.int64()), ("sparse_bytes", pa.int64()), ("runs", pa.int64()), ("restored", pa.bool_())])

    def make(t, b):
        t, b = t or b"", b or b""
        stored, runs = codecs.xor_residual(b, t, level), codecs.sparse_runs(b, t)
        again = bytearray(b[: len(t)].ljust(len(t), b"\0"))
        for at, new in runs:
            again[at : at + len(new)] = new
        yield len(t), len(stored), codecs.sparse_size(runs), len(runs), codecs.xor_restore(b, stored, len(t)) == t == bytes(again)

    return each_row(_both(base, target, keys), keys, ["target_bytes", "base_bytes"], "bytes long, xor_bytes long, sparse_bytes long, runs long, restored boolean", schema, make)


def boundaries_hold(content: DataFrame, chunks: DataFrame, keys: list[str], profile: Profile) -> DataFrame:
    """Per content whether its recorded chunk lengths are those that its bytes give; nothing is hashed."""
    told = chunks.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "len"))), lambda r: r["len"]).alias("lengths"))
    return each_row(content.join(told, keys), keys, ["bytes", "lengths"], "holds boolean", pa.schema([("holds", pa.bool_())]), lambda raw, lengths: [(cut(raw or b"", profile) == lengths,)])


def classified(content: DataFrame) -> DataFrame:
    """What each content is by its structure."""
    keys = [c for c in content.columns if c != "bytes"]
    names = ("executable", "architecture", "container")
    return each_row(content, keys, ["bytes"], ", ".join(f"{n} string" for n in names), pa.schema([(n, pa.string()) for n in names]), lambda raw: [(*classify.executable(raw or b"")[:2], classify.container(raw or b"")[0])])


def wanted_starts(base: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate dictionaries of all missing chunks, relationally: nearest starts and their runs."""
    need = reuse.first_occurrences(reuse.missing(base, target, keys), keys)
    return candidates.nearest_starts(base, need, keys).join(candidates.runs(base, keys), [*keys, "start"])

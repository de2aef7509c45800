"""Cutters, hashes, profiles, codecs and binary formats against golden values, plain definitions and corruption."""

import hashlib
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corestrata.functions import classify, codecs, delta, fixed, hashing
from corestrata.functions.cutting import Cutter, cut, cut_all, cut_fixed, cut_plainly, recut_apart, spans
from corestrata.functions.profiles import SMALL, STABLE, Malformed, Profile, Unsupported, canonical_integer, gear_table, lab_profile, mask, resolve, semantics_fingerprint
from corestrata.operators import mutations
from corestrata.sources import corpus, manifests, patches

WARM = Profile(64, 256, 1024, True)
#: Golden values of this engine's own recipes.
GOLDEN_CORPUS = ["886715e4", "3ec3ac38", "962046be", "2e2df307", "c86ec37f", "60443909", "f4b268b4", "c40a18b7", "d8412e34", "2874f9de", "184c57d4", "3ec3ac38"]
GOLDEN_EDITS = {"insert": "81eaeda4", "prepend": "e8f6c578", "append": "79e97d45", "delete": "cf9ee7c7", "overwrite": "8825060f", "localized-rewrite": "7922253a", "random-rewrite": "2f3f0920", "move": "3137a8ff", "reorder": "413960b3", "identity": "db3ce07e"}


def xorshift(n, seed):
    out, x = bytearray(), seed
    for _ in range(n):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        out.append(x & 255)
    return bytes(out)


def test_golden_cuts():
    assert cut(xorshift(1 << 20, 0x12345678), STABLE) == [100081, 33106, 69903, 49442, 103705, 144977, 214287, 145480, 50981, 37677, 79457, 19480]
    for pattern in (b"\0", bytes(range(1, 9))):
        assert cut((pattern * (1 << 20))[: 1 << 20], STABLE) == [262144] * 4
    for n in (16383, 16384, 16385, 65535, 65536, 65537, 262143, 262144, 262145):
        assert cut(bytes(n), STABLE) == [m for m in (min(n, 262144), n - min(n, 262144)) if m]


def test_profiles():
    assert hashing.gear_digest() == fixed.GEAR_SHA256
    assert [lab_profile(t << 10).fingerprint()[:16] for t in (64, 128, 256)] == ["f630746118136be0", "b81ec23522de7da7", "832c9e337d5d42bb"]
    assert (STABLE.strict, STABLE.relaxed) == (0x0000D90703537000, 0x0000D90F03530000)
    for sizes in ((62, 256, 1024), (64, 128, 1024), (64, 256, 512), (64, 300, 1024), (65, 256, 1024), (256, 256, 1024), (64, 256, 32 << 20)):
        with pytest.raises(ValueError):
            Profile(*sizes)
    with pytest.raises(ValueError):
        mask(4)
    assert resolve()[2] == fixed.BLAKE3_SUITE
    with pytest.raises(Unsupported):
        resolve("other.profile")
    with pytest.raises(Malformed):
        resolve("Not an id")


def test_canonical_numbers():
    for token, want in (("1", "1"), ("-0", "0"), ("1.0", "1"), ("12e2", "1200"), ("1200e-2", "12"), ("0.0e5", "0"), ("-1.50e1", "-15"), ("007", "7")):
        assert canonical_integer(token) == want
    for token in ("1.5", "1e-1", "", "1e2000", "9" * 200, "+1", "0x1"):
        with pytest.raises(Malformed):
            canonical_integer(token)
    a = semantics_fingerprint('{"semantics": {"b": [1.0, true, null], "a": "x"}, "more": 1}')
    assert a == semantics_fingerprint('{"semantics": {"a": "x", "b": [10e-1, true, null]}}')
    for bad in ('{"semantics": 1}', '{"semantics": {"a": 1, "a": 2}}', '{"semantics": {"a": 1.5}}'):
        with pytest.raises(Malformed):
            semantics_fingerprint(bad)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0, 1, 63, 64, 65, 255, 257, 1023, 1025, 3000]), st.sampled_from([SMALL, WARM]), st.sampled_from([2, 4, 256]))
def test_cutter_is_its_definition(seed, n, profile, symbols):
    rnd = random.Random(seed)
    data = bytes(rnd.randrange(symbols) for _ in range(n))
    want = cut_plainly(data, profile)
    assert cut(data, profile) == want and sum(want) == n
    cutter, got, at = Cutter(profile), [], 0
    while at < n:
        step = rnd.choice([1, 3, 64, 500])
        got += cutter.feed(data[at : at + step])
        cutter = Cutter(profile, cutter.length, cutter.gear)  # nothing else is carried
        at += step
    assert got + cutter.finish() == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32))
def test_recut_is_cutting_anew(seed):
    """Several edits, near and far, nested and touching; between those that lie apart old chunks stay."""
    rnd = random.Random(seed)
    data = new = rnd.randbytes(rnd.randrange(30_000))
    splices = []
    for _ in range(rnd.randrange(5)):
        a = rnd.randrange(len(new) + 1)
        b = min(len(new), a + rnd.choice([0, 1, rnd.randrange(300)]))
        fresh = rnd.randbytes(rnd.choice([0, 1, rnd.randrange(300)]))
        new = new[:a] + fresh + new[b:]
        splices.append((a, b, a + len(fresh)))
    edits, size = spans(len(data), splices)
    assert size == len(new) and all(x[1] <= y[0] and x[3] <= y[2] for x, y in zip(edits, edits[1:], strict=False))
    old_at = new_at = 0
    for a, b, c, d in [*edits, (len(data), len(data), size, size)]:
        assert data[old_at:a] == new[new_at:c]
        old_at, new_at = b, d
    old = cut(data, SMALL)
    lengths, kept, scanned = recut_apart(new, old, splices, SMALL)
    assert lengths == cut(new, SMALL) and scanned <= len(new)
    for i, j, n in kept:
        assert lengths[i : i + n] == old[j : j + n]
    if not splices:
        assert scanned == 0 and (kept == [(0, 0, len(old))] or not old)


def test_far_edits_leave_what_lies_between():
    data = random.Random(3).randbytes(400_000)
    new = data[:1000] + b"x" + data[1000:399_000] + b"y" + data[399_000:]
    lengths, kept, scanned = recut_apart(new, cut(data, SMALL), [(1000, 1000, 1001), (399_001, 399_001, 399_002)], SMALL)
    assert lengths == cut(new, SMALL) and scanned < 20_000 and sum(n for _, _, n in kept) > 0.9 * len(lengths)


def test_patch_from_reaches_the_whole_base():
    rnd = random.Random(5)
    base = rnd.randbytes(6 << 20)
    target = base[:3000] + b"new" + base[100_000 : 100_000 + (1 << 20)]
    stored = codecs.patch_from(target, base, 3)
    assert codecs.patch_restore(stored, base, len(target), 3) == target and len(stored) < 5000  # the match lies far from the base's end
    assert codecs.patch_restore(codecs.patch_from(b"abc" * 100, b""), b"", 300) == b"abc" * 100


def test_deltas():
    rnd = random.Random(1)
    for data in (b"", b"a", b"banana", b"abab" * 5, rnd.randbytes(300)):
        assert delta.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])  # noqa: B023
    some = lambda: bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(60)))
    for _ in range(300):
        b, t = some(), some()
        for x in (t, b[: rnd.randrange(60)] + t + b[rnd.randrange(60) :]):
            assert delta.restore(b, delta.make(b, x)) == x
    b = rnd.randbytes(20_000)
    t = bytearray(b[:5000] + b"new text" + b[5000:9000] + b[12000:] + b[9000:12000])
    t[::97] = bytes(x ^ 1 for x in t[::97])
    made = delta.make(b, bytes(t))
    assert delta.restore(b, made) == t and len(made) < 1000  # moved stretches, each with bytes changed
    with pytest.raises(ValueError):
        delta.restore(b, b"something else")


def test_window_hashes_are_those_of_the_windows_alone():
    data = random.Random(6).randbytes(3000)
    data += data[:1500]
    for size in (1, 7, 64, 1000):
        h = hashing.window_hashes(data, size)
        assert len(h) == len(data) - size + 1
        assert all(h[i] == hashing.window_hashes(data[i : i + size], size)[0] for i in range(0, len(h), 97))
        if size >= 7:
            assert len(np.unique(h)) == len({data[i : i + size] for i in range(len(h))})
    assert len(hashing.window_hashes(b"ab", 3)) == 0


def test_fixed_cutter():
    assert cut_fixed(0, 4) == [] and cut_fixed(8, 4) == [4, 4] and cut_fixed(9, 4) == [4, 4, 1]


@pytest.mark.parametrize(
    ("n", "want"),
    [(0, "af1349b9f5f9a1a6"), (1, "2d3adedff11b61f1"), (1023, "10108970eeda3eb9"), (1024, "42214739f095a406"), (1025, "d00278ae47eb27b3"), (2048, "e776b6028c7cd22a"), (102400, "bc3e3d41a1146b06")],
)
def test_blake3(n, want):
    assert hashing.blake3(bytes(i % 251 for i in range(n))).hex()[:16] == want


def test_checksum_and_numbers():
    assert hashing.crc32c(b"123456789") == 0xE3069283 and hashing.crc32c(b"") == 0
    one = hashing.SplitMix(42)
    many = hashing.SplitMix(42).numbers(5).tolist()
    assert [int(one.numbers(1)[0]) for _ in range(5)] == many
    assert hashing.SplitMix(0).numbers(1)[0] == 0xE220A8397B1DCDAF
    with pytest.raises(ValueError):
        one.below(0)


def test_features():
    data = random.Random(1).randbytes(500)
    slow = []
    for i in range(len(data) - 47):
        r = 0
        for byte in data[i : i + 48]:
            for bit in range(7, -1, -1):
                carry, r = r >> 63, (r << 1 | byte >> bit & 1) & (1 << 64) - 1
                r ^= fixed.RABIN_POLYNOMIAL if carry else 0
        slow.append(r)
    assert hashing.rabin48(data).tolist() == slow
    gear, h, a, b = gear_table().tolist(), 0, *hashing.affine_maps()
    least = [0xFFFFFFFF] * 12
    for byte in data:
        h = (h << 1) + gear[byte] & (1 << 64) - 1
        if h & 0x7F == 0:
            least = [min(x, (int(m) * (h & 0xFFFFFFFF) + int(c)) & 0xFFFFFFFF) for x, m, c in zip(least, a, b, strict=True)]
    assert hashing.similarity_features(data).tolist() == least
    assert len(set(hashing.super_features(data))) == 3 and hashing.similarity_features(b"").shape == (12,)
    near = hashing.super_features(data[:250] + b"!" + data[251:])
    assert isinstance(near[0], int)


def test_frames():
    rnd = random.Random(2)
    base = rnd.randbytes(20_000)
    for data in (b"a", b"abc" * 1000, base[:5000] + b"new" + base[5000:9000], rnd.randbytes(3000)):
        for d in (b"", base):
            stored = codecs.compress(data, d, 19)
            assert codecs.decompress(stored, len(data), d) == data
            f = codecs.frame(stored)
            assert (f.content, f.dictionary_id, f.size, f.checksum) == (len(data), 0, len(stored), False) and f.window <= 1 << 20
            for bad in (stored + b"x", stored[:-1], stored + stored, b"\0" + stored[1:]):
                with pytest.raises(Malformed):
                    codecs.decompress(bad, len(data), d)
            with pytest.raises(Malformed):
                codecs.decompress(stored, len(data) + 1, d)
    with pytest.raises(Malformed):
        codecs.decode(codecs.RAW, b"abc", 4)
    assert not codecs.usable_dictionary(fixed.ZSTD_DICTIONARY_MAGIC + b"x") and not codecs.usable_dictionary(bytes((1 << 20) + 1))
    t = base[:100] + b"zz" + base[102:]
    assert codecs.xor_restore(base, codecs.xor_residual(base, t), len(t)) == t
    restored = bytearray(base)
    for at, new in codecs.sparse_runs(base, t):
        restored[at : at + len(new)] = new
    assert bytes(restored) == t


def test_classifiers(tmp_path):
    import gzip
    import io
    import zipfile
    import zlib

    with open("/bin/sh", "rb") as f:
        assert classify.executable(f.read())[0] == "elf"
    assert classify.executable(b"MZ")[0] == "malformed" and classify.executable(b"text")[0] == "not-executable"
    pe = bytearray(1024)
    pe[:2], pe[0x3C:0x40] = b"MZ", struct.pack("<I", 64)
    pe[64:68] = b"PE\0\0"
    struct.pack_into("<HHIIIHH", pe, 68, 0x8664, 1, 0, 0, 0, 240, 0)
    struct.pack_into("<H", pe, 88, 0x20B)
    struct.pack_into("<I", pe, 88 + 108, 16)
    assert classify.executable(bytes(pe)) == ("pe-native", "x64", "NO_CLR_HEADER")
    struct.pack_into("<II", pe, 88 + 112 + 14 * 8, 4096, 72)
    assert classify.executable(bytes(pe))[0] == "pe-managed"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    assert classify.container(buffer.getvalue()) == ("zip", "DEFLATE")
    assert classify.container(gzip.compress(b"x"))[0] == "gzip" and classify.container(zlib.compress(b"x"))[0] == "zlib"
    assert classify.container(codecs.compress(b"x"))[0] == "compressed-other" and classify.container(b"hello")[0] == "none"


def test_corpus():
    for kind in corpus.KINDS:
        data = corpus.generate(kind, 300_001, 9)
        assert len(data) == 300_001 and data == corpus.generate(kind, 300_001, 9)
    assert set(corpus.generate("zero", 10, 1)) == {0} and len(set(corpus.generate("single-byte", 10, 1))) == 1
    pak = corpus.generate("game-pak-like", 2_000_000, 3)
    starts = [i for i in range(len(pak)) if pak.startswith(b"ASSET0", i)]
    assets = [pak[a + 16 : b] for a, b in zip(starts, starts[1:], strict=False)]
    assert starts[0] == 0 and len(set(assets)) < len(assets) and min(map(len, assets)) >= 16 << 10
    assert [hashlib.sha256(corpus.generate(k, 300_000, 1)).hexdigest()[:8] for k in corpus.KINDS if k != "compressed-like"] == GOLDEN_CORPUS
    entropy = lambda x: len(set(x))
    mixed = corpus.generate("alternating-entropy", 1 << 18, 2)
    assert entropy(mixed[: 1 << 17]) == 256 and entropy(mixed[1 << 17 :]) == 4
    with pytest.raises(ValueError):
        corpus.generate("other", 1, 1)


@pytest.mark.parametrize("kind", mutations.KINDS)
def test_mutations(kind):
    rnd = random.Random(4)
    for n in (0, 1, 2, 10, 1000):
        source = rnd.randbytes(n)
        e = mutations.mutate(source, kind, 16, 5)
        grown = len(e.target) - n
        assert grown == {"insert": 16, "prepend": 16, "append": 16, "delete": -min(16, n)}.get(kind, 0)
        assert 0 <= e.start <= e.end <= max(len(e.target), e.end)
        assert e.target[: e.start] == source[: e.start]
        assert e.target[e.end :] == source[e.end - grown :]
        if e.basis == "differing":
            assert e.changed == sum(a != b for a, b in zip(source, e.target, strict=True))
        if kind in ("move", "reorder"):
            assert sorted(e.target) == sorted(source)
        if kind in ("move", "reorder") and n >= 10:
            assert e.target != source and e.changed == (1 + (kind == "reorder")) * min(16, n // 2)
    assert hashlib.sha256(repr([mutations.mutate(bytes(range(200)), kind, 16, s) for s in range(20)]).encode()).hexdigest()[:8] == GOLDEN_EDITS[kind]


def test_sizes_are_those_of_written_files(spark):
    """Lengths by formula against files that are written, around the bounds of blocks."""
    from pyspark.sql import functions as F

    from corestrata.operators.patches import framing_size, manifest_size

    cases = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (5, 3, 4), (4096, 10, 9), (4097, 4096, 0), (8200, 4097, 8)]
    got = spark.createDataFrame(cases, "c long, e long, r long").select(manifest_size(F.col("c")), framing_size(F.col("c"), F.col("e"), F.col("r")), framing_size(F.col("c"), F.col("e"), F.col("r"), False)).collect()
    for (c, e, r), sizes in zip(cases, got, strict=True):
        records = [(i.to_bytes(32, "big"), 1) for i in range(c)]
        m = manifests.write(manifests.Manifest(fixed.SHA256_SUITE, fixed.STABLE_PROFILE, bytes(32), records), index=True)
        new = [patches.Entry(x, codecs.ZSTD if i * 4 < r else codecs.RAW, (bytes(32),) * min(4, max(0, r - 4 * i)), b"xy") for i, (x, _) in enumerate(records[:e])]
        assert tuple(sizes) == (len(m), *(len(patches.write(m, base, new)) - 2 * e for base in (bytes(32), None)))


def test_boundary_edit():
    data = random.Random(6).randbytes(5000)
    e = mutations.boundary_edit(data, SMALL)
    assert e.changed == 1 and e.start in np.cumsum(cut(data, SMALL)) and e.target[e.start] == data[e.start] ^ 0x5A
    assert mutations.boundary_edit(b"", SMALL) is None and mutations.boundary_edit(bytes(50), SMALL) is None


# Binary manifests

FIXTURE = hashlib.sha256(b"an example").digest()


def small_manifest(records):
    return manifests.Manifest(fixed.SHA256_SUITE, "example.small.v1", FIXTURE, records)


def test_manifest_golden():
    data = manifests.write(small_manifest([]))
    m = manifests.read(data)
    assert len(data) == 332 and m.manifest_id.hex() == "3fda0d71a9521abe4b14471c63a3bd2d15cd0689a2227eaa075de99b1b418abd" and m.file_digest.hex() == "0d1c85a3ed5d385054746a885dd63aaacfb7bf5b70538e1e186c43a7f5c77aaf"
    many = [(bytes([i & 255]) * 32, 2048) for i in range(4097)]
    plain, indexed = manifests.write(small_manifest(many)), manifests.write(small_manifest(many), index=True)
    assert (len(plain), len(indexed)) == (147912, 147968)
    assert manifests.read(plain).manifest_id == manifests.read(indexed).manifest_id and manifests.read(indexed).records == many


def _redigested(data):
    body = data[:-64]
    return body + data[-64:-40] + hashing.digest(fixed.SHA256_SUITE, body) + data[-8:]


def test_manifest_failures():
    m = small_manifest([(bytes([i]) * 32, i + 1) for i in range(3)])
    good = manifests.write(m, index=True)
    assert manifests.verify(good) == ("valid", 0)
    at = good.index(b"CBLK")
    bad = good[: at + 50] + bytes([good[at + 50] ^ 1]) + good[at + 51 :]
    assert manifests.verify(_redigested(bad)) == ("integrity", manifests.BLOCK_CRC)
    assert manifests.verify(good[:-20] + b"\1" + good[-19:])[1] & manifests.FILE_DIGEST
    cend = good.index(b"CEND")
    wrong = good[: cend + 16] + struct.pack("<Q", 4) + good[cend + 24 :]
    assert manifests.verify(_redigested(wrong)) == ("integrity", manifests.LOGICAL_TOTALS)
    other = good[: cend + 40] + b"\1" + good[cend + 41 :]
    assert manifests.verify(_redigested(other)) == ("integrity", manifests.MANIFEST_ID)
    for broken in (b"", good[:31], b"X" + good[1:], good + b"\0", good[:-1], good[:cend] + b"XEND" + good[cend + 4 :]):
        assert manifests.verify(broken)[0] == "malformed"
    assert manifests.verify(good[:8] + b"\1" + good[9:])[0] == "unsupported"
    extra = manifests.section(b"AUX0", b"hello", False)
    bidx = good.index(b"BIDX")
    foot = good.index(b"FOOT")
    shifted = good[:bidx] + extra + good[bidx:]
    body = bytearray(shifted)
    struct.pack_into("<Q", body, foot + len(extra) + 16 + 16, bidx + len(extra))
    struct.pack_into("<QQ", body, len(body) - 56, foot + len(extra), len(body))
    assert manifests.verify(_redigested(bytes(body))) == ("valid", 0)
    core = good.index(b"CORE")
    suite = good.replace(fixed.SHA256_SUITE.encode(), fixed.SHA256_SUITE.replace("256", "999").encode())
    assert manifests.verify(suite)[0] == "unsupported" and core == 32


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 255))
def test_manifest_fuzz(at, flip):
    data = bytearray(manifests.write(small_manifest([(bytes([i]) * 32, i + 1) for i in range(5)]), index=True))
    data[at % len(data)] ^= flip
    outcome, flags = manifests.verify(bytes(data))
    assert outcome != "valid" or 16 <= at % len(data) < 24  # optional feature bits alone mean nothing


def test_manifest_contents():
    content = random.Random(7).randbytes(400_000)
    for suite in (fixed.SHA256_SUITE, fixed.BLAKE3_SUITE):
        data = manifests.write(manifests.create(content, suite=suite))
        assert manifests.verify(data, content) == ("valid", 0)
        assert manifests.verify(data, content[:-1]) == ("integrity", manifests.CONTENT)
        m = manifests.read(data)
        assert manifests.first_difference(m, content) is None and manifests.first_difference(m, bytes(400_000)) == 0
    assert manifests.verify(manifests.write(small_manifest([])), b"")[0] == "unsupported"
    wrong = manifests.Manifest(fixed.SHA256_SUITE, fixed.STABLE_PROFILE, bytes(32), [])
    assert manifests.verify(manifests.write(wrong), b"abc") == ("integrity", manifests.PROFILE_SEMANTICS)


# Binary patches


@pytest.fixture(scope="module")
def pair():
    rnd = random.Random(8)
    base = rnd.randbytes(500_000)
    target = base[:150_000] + b"hello" * 40 + base[150_000:400_000] + rnd.randbytes(2000)
    make = lambda c: manifests.write(manifests.create(c, suite=fixed.SHA256_SUITE))
    return base, target, make(base), make(target)


@pytest.mark.parametrize("recheck", patches.RECHECKS)
def test_patch_round_trip(pair, recheck):
    base, target, bm, tm = pair
    p = patches.create(tm, target, bm, base, level=1)
    assert patches.apply(p, bm, base, recheck) == target
    alone = patches.create(tm, target, level=1)
    assert patches.apply(alone, recheck=recheck) == target
    assert len(p) < len(alone) and sum(patches.ledger(p).values()) == len(p)
    assert patches.apply(patches.create(tm, target, bm, base, level=1, ranked=True), bm, base) == target


def test_entries_are_fetched_alone(pair):
    base, target, bm, tm = pair
    p = patches.create(tm, target, bm, base, level=1)
    whole, read = patches.read(p), []

    def read_range(at, n):
        read.append(n)
        return p[at : at + n]

    for k, (entry, first) in enumerate(zip(whole.entries, whole.first, strict=True)):
        read.clear()
        assert patches.fetch(read_range, len(p), k) == (entry, first)
        assert sum(read) < 200 + 40 + 32 * len(entry.dictionary) + len(entry.stored)
    with pytest.raises(IndexError):
        patches.fetch(read_range, len(p), len(whole.entries))


def test_patch_failures(pair):
    base, target, bm, tm = pair
    p = patches.create(tm, target, bm, base, level=1)
    with pytest.raises(patches.Rejected) as e:
        patches.apply(p)
    assert e.value.flags == patches.BASE_MISMATCH
    with pytest.raises(patches.Rejected) as e:
        patches.apply(p, tm, target)
    assert e.value.flags == patches.BASE_MISMATCH
    with pytest.raises(patches.Rejected) as e:
        patches.apply(p, bm, bytes(len(base)))
    assert e.value.flags in (patches.BASE_CHUNK, patches.DICTIONARY_CHUNK)
    got = patches.read(p)
    with pytest.raises(patches.Rejected) as e:
        patches.read(patches.write(tm, got.base_id, [*got.entries, got.entries[-1]]))
    assert e.value.flags == patches.DUPLICATE
    with pytest.raises(patches.Rejected) as e:
        patches.apply(patches.write(tm, got.base_id, got.entries[:-1]), bm, base)
    assert e.value.flags == patches.MISSING
    with pytest.raises(Malformed):
        patches.read(patches.write(tm, None, got.entries))
    for cut_at in (10, 95, len(p) - 1):
        with pytest.raises(Malformed):
            patches.read(p[:cut_at])


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 255))
def test_patch_fuzz(at, flip):
    content = b"some content that is short"
    tm = manifests.write(manifests.create(content, suite=fixed.SHA256_SUITE))
    data = bytearray(patches.create(tm, content, level=1))
    data[at % len(data)] ^= flip
    try:
        assert patches.apply(bytes(data)) == content
    except (Malformed, Unsupported, patches.Rejected):
        pass


def test_blocks():
    assert patches.blocks([1, 1, 1], 2, 100) == [0, 0, 1]
    assert patches.blocks([60, 60, 200, 10], 9, 100) == [0, 1, 2, 3]
    assert patches.blocks([], 2, 100) == []


def test_blake3_of_many_contents_together(monkeypatch):
    """Contents of all sizes are hashed in common steps, in groups of bounded size, and none differs from its digest alone."""
    rnd = random.Random(8)
    some = [rnd.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 31744, 40000)] + [rnd.randbytes(rnd.randrange(6000)) for _ in range(300)]
    alone = [hashing.blake3(x) for x in some]
    assert alone[0].hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"  # published, of nothing
    calls, compress = [], hashing._compress
    monkeypatch.setattr(hashing, "_compress", lambda *a: calls.append(1) or compress(*a))
    held = hashing.Digests(fixed.BLAKE3_SUITE)
    got = [x for k in range(0, len(some), 7) for x in held.add(list(map(memoryview, some[k : k + 7])))] + held.rest()
    assert got == [x.hex() for x in alone] and len(calls) < 40
    monkeypatch.setattr(hashing, "BLAKE_GROUP", 4096)
    assert hashing.blake3_all(some) == alone
    assert hashing.Digests(fixed.SHA256_SUITE).add([b"ab"]) == [hashlib.sha256(b"ab").hexdigest()]


def test_contents_cut_together_are_cut_as_alone(monkeypatch):
    rnd = random.Random(9)
    some = [rnd.randbytes(rnd.randrange(4000)) for _ in range(40)] + [b"", bytes(3000), b"ab" * 900, *(b"x" * n for n in (1, 63, 64, 65, 1023, 1024, 1025))]
    rnd.shuffle(some)
    profiles = [SMALL, Profile(64, 256, 1024, True), Profile(240, 256, 1024), Profile(500, 512, 1100)]
    want = [[cut_plainly(c, p) for c in some] for p in profiles]
    assert cut_all(some, profiles) == want and cut_all([], profiles) == [[]] * 4 and cut_all([b""], profiles) == [[[]]] * 4
    monkeypatch.setattr("corestrata.functions.cutting.SEGMENT", 1500)
    assert cut_all(some, profiles) == want


def test_longest_stretches_are_those_of_halving(monkeypatch):
    """Length and place as halving the ordered suffixes, byte by byte, finds them; and far fewer comparisons than that takes."""
    rnd = random.Random(10)

    def halved(base, target, at):
        order = sorted(range(len(base)), key=lambda i: base[i:])
        low, high, best = 0, len(order), (0, 0)
        while low < high:
            mid = (low + high) // 2
            place = order[mid]
            n = 0
            while n < min(len(base) - place, len(target) - at) and base[place + n] == target[at + n]:
                n += 1
            best = max(best, (n, -place))
            if at + n == len(target) or (place + n < len(base) and base[place + n] > target[at + n]):
                high = mid
            else:
                low = mid + 1
        return best[0], -best[1]

    for letters in (b"ab", b"\0\xff", bytes(range(256)), b"abcdefgh "):
        for _ in range(6):
            base = bytes(rnd.choices(letters, k=rnd.randrange(90)))
            target = base[20:60] + bytes(rnd.choices(letters, k=rnd.randrange(60))) + base[-9:]
            find = delta._Longest(base, target)
            assert [find(at) for at in range(len(target))] == [halved(base, target, at) for at in range(len(target))]
            assert delta.suffix_array(base).tolist() == sorted(range(len(base)), key=lambda i: base[i:])  # noqa: B023
    words = [bytes(rnd.choices(b"abcdefghijklmnop", k=rnd.randrange(2, 12))) for _ in range(400)]
    base, more = (b" ".join(rnd.choice(words) for _ in range(n)) for n in (800, 150))
    calls, common = [], delta._common
    monkeypatch.setattr(delta, "_common", lambda *a: calls.append(1) or common(*a))
    made = delta.make(base, base + more)
    assert delta.restore(base, made) == base + more and len(calls) < len(more)

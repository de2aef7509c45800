"""The binary patch: a target manifest, the identity of its base, and entries for chunks that the base lacks."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

from corestrata.functions import codecs
from corestrata.functions.cutting import cut
from corestrata.functions.hashing import crc32c, digest
from corestrata.functions.profiles import Malformed, Profile, Unsupported
from corestrata.sources import manifests
from corestrata.sources.manifests import Manifest, checked, section

ENTRIES, BLOCK_BYTES, MOST_ENTRIES = 4096, 4 << 20, 1 << 20
(PATCH_DIGEST, EMBEDDED, SEMANTICS, DUPLICATE, NOT_IN_TARGET, LENGTH, BASE_MISMATCH, BASE_MANIFEST, BASE_CHUNK, DICTIONARY_CHUNK, PAYLOAD_CHUNK, MISSING, CONTENT_LENGTH, PROFILE_CONTENT, LIMIT) = (1 << i for i in range(15))
RECHECKS = ("off", "sequential", "overlapped", "boundary")


class Rejected(ValueError):
    """Integrity failures, as flags: nothing may be published."""

    def __init__(self, flags: int):
        super().__init__(f"flags {flags}")
        self.flags = flags


@dataclass
class Entry:
    chunk: bytes
    encoding: int
    dictionary: tuple[bytes, ...]
    stored: bytes


@dataclass
class Patch:
    target: Manifest
    target_bytes: bytes
    base_id: bytes | None
    entries: list[Entry]
    first: list[int]
    flags: int = 0


def blocks(sizes: list[int], most_entries: int = ENTRIES, most_bytes: int = BLOCK_BYTES) -> list[int]:
    """The block of each entry: a block is closed before an entry that would exceed either bound; a larger entry stands alone."""
    out, block, n, size = [], 0, 0, 0
    for s in sizes:
        if n and (n == most_entries or size + s > most_bytes):
            block, n, size = block + 1, 0, 0
        out.append(block)
        n, size = n + 1, size + s
    return out


def write(target_manifest: bytes, base_id: bytes | None, entries: list[Entry]) -> bytes:
    target = manifests.read(target_manifest)
    where: dict[bytes, int] = {}
    for i, (chunk, _) in enumerate(target.records):
        where.setdefault(chunk, i)
    out = bytearray(b"CSP1" + struct.pack("<HHQQQ", 1, 32, 0, 0, 0))
    tcsm = len(out)
    out += section(b"TCSM", target_manifest, True)
    base = len(out) if base_id is not None else 0
    if base_id is not None:
        out += section(b"BASE", base_id, False)
    raw = [e.chunk + struct.pack("<IBBH", len(e.stored), e.encoding, len(e.dictionary), 0) + b"".join(e.dictionary) + e.stored for e in entries]
    grouped = blocks([len(r) for r in raw])
    first_payl, places, at = 0, [], 0
    while at < len(raw):
        end = at
        while end < len(raw) and grouped[end] == grouped[at]:
            end += 1
        first_payl = first_payl or len(out)
        place = len(out) + 32
        for r in raw[at:end]:
            places.append(place)
            place += len(r)
        out += checked(b"PAYL", struct.pack("<IIQ", end - at, 0, at) + b"".join(raw[at:end]))
        at = end
    pidx = len(out)
    out += checked(b"PIDX", struct.pack("<II", 1, len(entries)) + b"".join(struct.pack("<QQIBBH", where[e.chunk], p, len(e.stored), e.encoding, len(e.dictionary), 0) for e, p in zip(entries, places, strict=True)))
    foot = len(out)
    out += section(b"FOOT", struct.pack("<QQQQQQQ", tcsm, base, pidx, first_payl, grouped[-1] + 1 if grouped else 0, len(entries), 0), True)
    return bytes(out) + b"CSPT" + struct.pack("<HHQQ", 1, 64, foot, len(out) + 64) + digest(target.suite, bytes(out)) + bytes(8)


def _require(ok: bool, why: str) -> None:
    if not ok:
        raise Malformed(why)


def _payl(head: bytes, payload: bytes, ordinal: int, place: int) -> list[tuple[Entry, int]]:
    _require(len(payload) >= 20, "PAYL length")
    _require(struct.unpack("<I", payload[-4:])[0] == crc32c(head + payload[:-4]), "PAYL checksum")
    count, zero, first = struct.unpack_from("<IIQ", payload)
    _require(0 < count <= ENTRIES and not zero and first == ordinal, "PAYL fields")
    out, at, end = [], 16, len(payload) - 4
    for _ in range(count):
        _require(at + 40 <= end, "an entry overruns")
        chunk, size, encoding, refs, zero = struct.unpack_from("<32sIBBH", payload, at)
        _require(size > 0 and not zero, "entry fields")
        if encoding > codecs.ZSTD:
            raise Unsupported("encoding")
        _require(refs <= (codecs.MOST_REFERENCES if encoding else 0), "dictionary count")
        stored = at + 40 + 32 * refs
        _require(stored + size <= end, "an entry overruns")
        out.append((Entry(chunk, encoding, tuple(payload[at + 40 + 32 * i : at + 72 + 32 * i] for i in range(refs)), payload[stored : stored + size]), place + at))
        at = stored + size
    _require(at == end, "PAYL length")
    return out


def read(data: bytes, most_entries: int = MOST_ENTRIES) -> Patch:
    """All of a patch but its base: structure, then the embedded manifest, then entries against the target."""
    _require(len(data) >= 96, "too short")
    magic, major, size, foot_at, physical, file_digest, zero = struct.unpack("<4sHHQQ32sQ", data[-64:])
    _require(magic == b"CSPT" and major == 1 and size == 64 and physical == len(data) and zero == 0, "trailer")
    magic, major, size, required, _, zero = struct.unpack("<4sHHQQQ", data[:32])
    _require(magic == b"CSP1" and major == 1 and size == 32 and zero == 0, "preamble")
    if required:
        raise Unsupported("required physical features")
    at, end, order = 32, len(data) - 64, []
    target_bytes, base_id, held, index = b"", None, [], None
    starts: dict[bytes, int] = {}
    payls, foot = 0, None
    while at < end:
        _require(at + 16 <= end and foot is None, "sections")
        kind, flags, n = struct.unpack_from("<4sIQ", data, at)
        _require(flags in (0, 1) and n <= end - at - 16, "section header")
        head, payload, place = data[at : at + 16], data[at + 16 : at + 16 + n], at + 16
        known = {b"TCSM": 1, b"BASE": 0, b"PAYL": 1, b"PIDX": 1, b"FOOT": 1}
        if kind in known:
            _require(flags == known[kind], "REQUIRED flag")
            _require(kind == b"PAYL" or kind not in starts, "a section twice")
            starts.setdefault(kind, at)
        else:
            _require(flags == 0 and b"TCSM" in starts and index is None, "unknown section")
            order.append("aux")
            at += 16 + n
            continue
        if kind == b"TCSM":
            _require(not order, "TCSM out of place")
            target_bytes = payload
        elif kind == b"BASE":
            _require(order == ["TCSM"] and n == 32, "BASE")
            base_id = payload
        elif kind == b"PAYL":
            _require("TCSM" in order and "aux" not in order and "PIDX" not in order, "PAYL out of place")
            held += _payl(head, payload, len(held), place)
            payls += 1
            if len(held) > most_entries:
                raise Rejected(LIMIT)
        elif kind == b"PIDX":
            _require("TCSM" in order and n >= 12 and (n - 12) % 24 == 0, "PIDX length")
            _require(struct.unpack("<I", payload[-4:])[0] == crc32c(head + payload[:-4]), "PIDX checksum")
            version, count = struct.unpack_from("<II", payload)
            _require(version == 1 and n == 12 + 24 * count, "PIDX length")
            index = [struct.unpack_from("<QQIBBH", payload, 8 + 24 * i) for i in range(count)]
            _require(not any(e[5] for e in index), "PIDX reserved")
        else:
            _require(index is not None and n == 56 and at == foot_at, "FOOT")
            foot = struct.unpack("<QQQQQQQ", payload)
        order.append(kind.decode())
        at += 16 + n
    _require(foot is not None and b"TCSM" in starts, "missing sections")
    _require(foot == (starts[b"TCSM"], starts.get(b"BASE", 0), starts[b"PIDX"], starts.get(b"PAYL", 0), payls, len(held), 0), "FOOT fields")
    _require(len(index) == len(held) and all((i[1], i[2], i[3], i[4]) == (p, len(e.stored), e.encoding, len(e.dictionary)) for i, (e, p) in zip(index, held, strict=True)), "PIDX and PAYL")
    target = manifests.read(target_bytes)
    flags = 0
    if target.flags & ~manifests.PROFILE_SEMANTICS:
        flags |= EMBEDDED
    if target.flags & manifests.PROFILE_SEMANTICS:
        flags |= SEMANTICS
    if digest(target.suite, data[:-64]) != file_digest:
        flags |= PATCH_DIGEST
    if flags:
        raise Rejected(flags)
    where: dict[bytes, int] = {}
    for i, (chunk, _) in enumerate(target.records):
        where.setdefault(chunk, i)
    seen: set[bytes] = set()
    first, last = [], -1
    for i, (e, _) in zip(index, held, strict=True):
        first.append(i[0])
        if e.chunk in seen or e.chunk not in where:
            flags |= DUPLICATE if e.chunk in seen else NOT_IN_TARGET
            continue
        seen.add(e.chunk)
        _require(i[0] == where[e.chunk] and i[0] > last, "first occurrence")
        last = i[0]
        full = target.records[i[0]][1]
        if len(e.stored) > full or (e.encoding == codecs.RAW and len(e.stored) != full):
            flags |= LENGTH
    if flags:
        raise Rejected(flags)
    held_ids = {e.chunk for e, _ in held}
    if base_id is None and (any(c not in held_ids for c, _ in target.records) or any(e.dictionary for e, _ in held)):
        raise Malformed("a base is needed, but none is named")
    return Patch(target, target_bytes, base_id, [e for e, _ in held], first)


def choose(chunk: bytes, raw: bytes, options: list[tuple[tuple[bytes, ...], bytes]], level: int = 19) -> tuple[Entry, int]:
    """The cheapest of raw, zstd (unless level is 0), and zstd with each of the dictionaries (references, bytes); the earlier on ties. With the option's number, -2 raw, -1 plain."""
    best, which = Entry(chunk, codecs.RAW, (), raw), -2
    least = len(raw)
    if not level:
        return best, which
    plain = codecs.compress(raw, level=level)
    if len(plain) < least:
        best, which, least = Entry(chunk, codecs.ZSTD, (), plain), -1, len(plain)
    for i, (references, data) in enumerate(options):
        if not codecs.usable_dictionary(data) or not data:
            continue
        stored = codecs.compress(raw, data, level)
        if len(stored) <= len(raw) and codecs.cost(len(stored), len(references)) < least:
            best, which, least = Entry(chunk, codecs.ZSTD, references, stored), i, codecs.cost(len(stored), len(references))
    return best, which


def choose_ranked(chunk: bytes, raw: bytes, options: list[tuple[tuple[bytes, ...], bytes]], cheap: int = 1, level: int = 19, keep: int = 2) -> tuple[Entry, int]:
    """All options at a cheap level; the keep best of them at the full one, unless one already costs three quarters of raw and plain zstd or less."""
    usable = [(codecs.cost(len(codecs.compress(raw, d, cheap)), len(r)), i) for i, (r, d) in enumerate(options) if d and codecs.usable_dictionary(d)]
    best, which = choose(chunk, raw, [], level)
    bound = len(best.stored)
    least = bound
    for _, i in sorted(usable)[:keep]:
        references, data = options[i]
        stored = codecs.compress(raw, data, level)
        price = codecs.cost(len(stored), len(references))
        if len(stored) <= len(raw) and price < least:
            best, which, least = Entry(chunk, codecs.ZSTD, references, stored), i, price
        if 4 * price <= 3 * bound:
            break
    return best, which


def dictionaries(base: Manifest, base_content: bytes, at: int, run: int = 4, radius: int = 256 << 10, most: int = 8) -> list[tuple[tuple[bytes, ...], bytes]]:
    """Runs of base chunks that begin nearest to a target offset."""
    offsets = base.offsets
    near = sorted((abs(o - at), i) for i, o in enumerate(offsets) if abs(o - at) <= radius)[:most]
    out = []
    for _, i in near:
        part = base.records[i : i + run]
        size = sum(n for _, n in part)
        if size <= codecs.DICTIONARY_BYTES:
            out.append((tuple(c for c, _ in part), base_content[offsets[i] : offsets[i] + size]))
    return out


def create(target_manifest: bytes, target: bytes, base_manifest: bytes | None = None, base: bytes = b"", level: int = 19, ranked: bool = False) -> bytes:
    """A patch with one entry for each distinct chunk that the base lacks, in the order of first occurrence."""
    t = manifests.read(target_manifest)
    b = manifests.read(base_manifest) if base_manifest is not None else None
    if t.flags or (b and b.flags):
        raise Rejected(EMBEDDED if t.flags else BASE_MANIFEST)
    if b and b.suite != t.suite:
        raise Rejected(BASE_MISMATCH)
    if manifests.first_difference(t, target) is not None:
        raise Rejected(CONTENT_LENGTH)
    known = {c for c, _ in b.records} if b else set()
    entries, seen = [], set()
    for (chunk, n), at in zip(t.records, t.offsets, strict=True):
        if chunk in known or chunk in seen:
            continue
        seen.add(chunk)
        pick = choose_ranked if ranked else choose
        entries.append(pick(chunk, target[at : at + n], dictionaries(b, base, at) if b else [], level=level)[0])
    return write(target_manifest, b.manifest_id if b else None, entries)


def boundaries_hold(lengths: list[int], content: bytes, profile: Profile) -> bool:
    """Whether cutting anew would give these chunks."""
    return cut(content, profile) == lengths


def apply(data: bytes, base_manifest: bytes | None = None, base: bytes = b"", recheck: str = "off") -> bytes:
    """The target's bytes, or an exception: every record is resolved and verified before anything is returned."""
    if recheck not in RECHECKS:
        raise ValueError("unknown recheck")
    p = read(data)
    chunks: dict[bytes, tuple[int, int]] = {}
    if p.base_id is not None:
        if base_manifest is None:
            raise Rejected(BASE_MISMATCH)
        b = manifests.read(base_manifest)
        if b.suite != p.target.suite:
            raise Rejected(BASE_MISMATCH)
        if b.flags & ~manifests.PROFILE_SEMANTICS:
            raise Rejected(BASE_MANIFEST)
        if b.manifest_id != p.base_id:
            raise Rejected(BASE_MISMATCH)
        for (chunk, n), at in zip(b.records, b.offsets, strict=True):
            chunks.setdefault(chunk, (at, n))
    suite = p.target.suite

    def from_base(chunk: bytes, failure: int) -> bytes:
        at, n = chunks[chunk]
        raw = base[at : at + n]
        if len(raw) != n or digest(suite, raw) != chunk:
            raise Rejected(failure)
        return raw

    payload = {e.chunk: e for e in p.entries}
    out, done = [], {}
    for chunk, n in p.target.records:
        if chunk in done:
            out.append(done[chunk])
            continue
        e = payload.get(chunk)
        if e is not None:
            if any(c not in chunks for c in e.dictionary):
                raise Rejected(DICTIONARY_CHUNK)
            d = b"".join(from_base(c, DICTIONARY_CHUNK) for c in e.dictionary)
            if not codecs.usable_dictionary(d):
                raise Rejected(DICTIONARY_CHUNK)
            raw = codecs.decode(e.encoding, e.stored, n, d)
            if digest(suite, raw) != chunk:
                raise Rejected(PAYLOAD_CHUNK)
        elif chunk in chunks:
            raw = from_base(chunk, BASE_CHUNK)
            if len(raw) != n:
                raise Rejected(BASE_CHUNK)
        else:
            raise Rejected(MISSING)
        done[chunk] = raw
        out.append(raw)
    content = b"".join(out)
    if len(content) != p.target.content_length:
        raise Rejected(CONTENT_LENGTH)
    known = manifests.REGISTERED.get(p.target.profile_id)
    if recheck != "off" and known and not boundaries_hold([n for _, n in p.target.records], content, known):
        raise Rejected(PROFILE_CONTENT)
    return content


def fetch(read_range: Callable[[int, int], bytes], size: int, ordinal: int) -> tuple[Entry, int]:
    """An entry and the index of its chunk in the target, by reading the ends of a patch, its entry in the index and the entry itself. read_range(offset, n) gives n bytes; checksums, which cover blocks, aren't looked at."""
    magic, major, _, foot_at, physical = struct.unpack("<4sHHQQ", read_range(size - 64, 24))
    _require(magic == b"CSPT" and major == 1 and physical == size and foot_at < size - 64, "trailer")
    _, _, pidx, _, _, count, _ = struct.unpack("<QQQQQQQ", read_range(foot_at + 16, 56))
    if not 0 <= ordinal < count:
        raise IndexError(ordinal)
    first, place, stored, encoding, refs, _ = struct.unpack("<QQIBBH", read_range(pidx + 24 + 24 * ordinal, 24))
    raw = read_range(place, 40 + 32 * refs + stored)
    _require(struct.unpack_from("<IBB", raw, 32) == (stored, encoding, refs), "entry fields")
    return Entry(raw[:32], encoding, tuple(raw[40 + 32 * i : 72 + 32 * i] for i in range(refs)), raw[40 + 32 * refs :]), first


def ledger(data: bytes) -> dict[str, int]:
    """Bytes of a patch by the class of what they hold; they add up to its size."""
    out = dict.fromkeys(("fixed", "headers", "manifest", "base", "entry_headers", "references", "stored", "index", "checksums"), 0)
    out["fixed"] = 96
    at = 32
    while at < len(data) - 64:
        kind, _, n = struct.unpack_from("<4sIQ", data, at)
        out["headers"] += 16
        if kind == b"TCSM":
            out["manifest"] += n
        elif kind == b"BASE":
            out["base"] += n
        elif kind == b"PAYL":
            got = _payl(data[at : at + 16], data[at + 16 : at + 16 + n], struct.unpack_from("<Q", data, at + 24)[0], at + 16)
            out["headers"] += 16
            out["checksums"] += 4
            for e, _ in got:
                out["entry_headers"] += 40
                out["references"] += 32 * len(e.dictionary)
                out["stored"] += len(e.stored)
        elif kind == b"PIDX":
            out["index"] += n - 4
            out["checksums"] += 4
        else:
            out["headers"] += n
        at += 16 + n
    return out

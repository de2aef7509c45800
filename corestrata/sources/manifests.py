"""The binary manifest: written, read with checks in their order, and verified against contents."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from corestrata.functions import fixed
from corestrata.functions.cutting import cut
from corestrata.functions.hashing import crc32c, digest
from corestrata.functions.profiles import ID_PATTERN, STABLE, SUITES, Malformed, Profile, Unsupported

BLOCK, INDEX_CAP, MOST_INT, MOST_LONG = 4096, 262_144, (1 << 31) - 1, (1 << 63) - 1
#: Failures that leave a manifest readable, as bits.
BLOCK_CRC, LOGICAL_TOTALS, MANIFEST_ID, FILE_DIGEST, PROFILE_SEMANTICS, CONTENT = (1 << i for i in range(6))
NAMES = ("BlockCrc", "LogicalTotals", "ManifestId", "FileDigest", "ProfileSemantics", "Content")
REGISTERED: dict[str, Profile] = {fixed.STABLE_PROFILE: STABLE}


def names(flags: int) -> list[str]:
    return [n for i, n in enumerate(NAMES) if flags >> i & 1]


def manifest_id(suite: str, profile_id: str, fingerprint: bytes, records: list[tuple[bytes, int]]) -> bytes:
    s, p = suite.encode(), profile_id.encode()
    head = fixed.MANIFEST_DOMAIN + struct.pack("<H", len(s)) + s + struct.pack("<H", len(p)) + p + fingerprint
    return digest(suite, head + b"".join(i + struct.pack("<I", n) for i, n in records) + struct.pack("<QQ", len(records), sum(n for _, n in records)))


@dataclass
class Manifest:
    suite: str
    profile_id: str
    fingerprint: bytes
    records: list[tuple[bytes, int]]
    manifest_id: bytes = b""
    file_digest: bytes = b""
    physical: int = 0
    indexed: bool = False
    blocks: list[tuple[int, int]] = field(default_factory=list)
    flags: int = 0

    @property
    def content_length(self) -> int:
        return sum(n for _, n in self.records)

    @property
    def offsets(self) -> list[int]:
        out, at = [], 0
        for _, n in self.records:
            out.append(at)
            at += n
        return out


def section(kind: bytes, payload: bytes, required: bool) -> bytes:
    return kind + struct.pack("<IQ", int(required), len(payload)) + payload


def checked(kind: bytes, payload: bytes) -> bytes:
    """A required section whose payload ends with the CRC of its header and all before."""
    head = kind + struct.pack("<IQ", 1, len(payload) + 4)
    return head + payload + struct.pack("<I", crc32c(head + payload))


def write(m: Manifest, index: bool = False) -> bytes:
    suite, profile = m.suite.encode(), m.profile_id.encode()
    out = bytearray(b"CSM1" + struct.pack("<HHQQQ", 1, 32, 0, 0, 0))
    core = len(out)
    out += section(b"CORE", struct.pack("<QQ", 0, 0) + m.fingerprint + struct.pack("<HHI", len(suite), len(profile), 0) + suite + profile, True)
    blocks, offset = [], 0
    for at in range(0, len(m.records), BLOCK):
        part = m.records[at : at + BLOCK]
        blocks.append((offset, len(out)))
        out += checked(b"CBLK", struct.pack("<IIQQ", len(part), 0, at, offset) + b"".join(i for i, _ in part) + b"".join(struct.pack("<I", n) for _, n in part))
        offset += sum(n for _, n in part)
    cend = len(out)
    out += section(b"CEND", struct.pack("<QQ", len(m.records), offset) + manifest_id(m.suite, m.profile_id, m.fingerprint, m.records), True)
    bidx = 0
    if index:
        if len(blocks) > INDEX_CAP:
            raise Unsupported("too many blocks for an index")
        bidx = len(out)
        out += section(b"BIDX", struct.pack("<II", 1, len(blocks)) + b"".join(struct.pack("<QQ", *b) for b in blocks), False)
    foot = len(out)
    out += section(b"FOOT", struct.pack("<QQQQQQ", core, cend, bidx, blocks[0][1] if blocks else 0, len(blocks), 0), True)
    return bytes(out) + b"CSMT" + struct.pack("<HHQQ", 1, 64, foot, len(out) + 64) + digest(m.suite, bytes(out)) + bytes(8)


class _Input:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Malformed("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))


def _require(ok: bool, why: str) -> None:
    if not ok:
        raise Malformed(why)


def read(data: bytes) -> Manifest:
    """Structure first; block checksums, totals and digests are failures that are told together, in flags. After a bad checksum nothing of the blocks is believed."""
    src = _Input(data)
    magic, major, size, required, _, reserved = src.unpack("4sHHQQQ")
    _require(magic == b"CSM1" and major == 1 and size == 32 and reserved == 0, "preamble")
    if required:
        raise Unsupported("required physical features")
    m = Manifest("", "", b"", [])
    starts: dict[bytes, int] = {}
    phase, sound, offset, index, told = "core", True, 0, None, None
    while phase != "trailer":
        begin = src.at
        kind, flags, n = src.unpack("4sIQ")
        _require(flags in (0, 1), "section flags")
        _require(n <= len(data) - src.at, "section length")
        if kind == b"CORE":
            _require(phase == "core" and flags == 1, "CORE out of place")
            need, optional, fingerprint, a, b, extra = src.unpack("QQ32sHHI")
            _require(not need and not optional and not extra, "semantic features")
            _require(0 < a <= 128 and 0 < b <= 128 and n == 56 + a + b, "CORE length")
            try:
                m.suite, m.profile_id = src.take(a).decode(), src.take(b).decode()
            except UnicodeDecodeError:
                raise Malformed("identifier bytes") from None
            _require(bool(re.match(ID_PATTERN, m.suite) and re.match(ID_PATTERN, m.profile_id)), "identifiers")
            if m.suite not in SUITES:
                raise Unsupported("hash suite")
            m.fingerprint, phase = fingerprint, "blocks"
        elif kind == b"CBLK":
            _require(phase == "blocks" and flags == 1, "CBLK out of place")
            head, payload = data[begin : begin + 16], src.take(n)
            _require(n >= 28 + 36 and (n - 28) % 36 == 0 and (n - 28) // 36 <= BLOCK, "CBLK length")
            if struct.unpack("<I", payload[-4:])[0] != crc32c(head + payload[:-4]):
                m.flags |= BLOCK_CRC
                sound = False
                m.blocks.append((-1, begin))
                continue
            count, zero, first, start = struct.unpack_from("<IIQQ", payload)
            _require(count * 36 + 28 == n and not zero, "CBLK fields")
            if sound:
                _require(first == len(m.records) and start == offset, "CBLK position")
            lengths = struct.unpack_from(f"<{count}I", payload, 24 + 32 * count)
            _require(all(lengths), "a chunk of no length")
            if max(lengths) > MOST_INT:
                raise Unsupported("a chunk is too long")
            m.blocks.append((start, begin))
            m.records += [(payload[24 + 32 * i : 56 + 32 * i], x) for i, x in enumerate(lengths)]
            offset += sum(lengths)
            if offset > MOST_LONG:
                raise Unsupported("the content is too long")
        elif kind == b"CEND":
            _require(phase == "blocks" and flags == 1 and n == 48, "CEND")
            told, phase = src.unpack("QQ32s"), "aux"
        elif kind == b"BIDX":
            _require(phase == "aux" and flags == 0 and n >= 8, "BIDX")
            version, count = src.unpack("II")
            _require(version == 1 and n == 8 + 16 * count, "BIDX length")
            if count > INDEX_CAP:
                raise Unsupported("the index is too long")
            index, phase = [src.unpack("QQ") for _ in range(count)], "foot"
        elif kind == b"FOOT":
            _require(phase in ("aux", "foot") and flags == 1 and n == 48, "FOOT")
            foot, phase = src.unpack("QQQQQQ"), "trailer"
        else:
            _require(phase == "aux" and flags == 0, "unknown section")
            src.take(n)
            continue
        starts[kind] = starts.get(kind, begin)
    end = src.at
    magic, major, size, foot_at, physical, file_digest, zero = src.unpack("4sHHQQ32sQ")
    _require(magic == b"CSMT" and major == 1 and size == 64 and zero == 0, "trailer")
    _require(src.at == len(data) == physical and foot_at == starts[b"FOOT"], "trailer positions")
    _require(foot == (starts[b"CORE"], starts[b"CEND"], starts.get(b"BIDX", 0), starts.get(b"CBLK", m.blocks[0][1] if m.blocks else 0), len(m.blocks), 0), "FOOT fields")
    if index is not None:
        _require(len(index) == len(m.blocks) and all(i[1] == b[1] and b[0] in (-1, i[0]) for i, b in zip(index, m.blocks, strict=True)) and all(a[0] < b[0] for a, b in zip(index, index[1:], strict=False)), "BIDX entries")
    m.indexed, m.physical, m.file_digest, m.manifest_id = index is not None, physical, file_digest, told[2]
    if sound:
        if told[:2] != (len(m.records), offset):
            m.flags |= LOGICAL_TOTALS
        if manifest_id(m.suite, m.profile_id, m.fingerprint, m.records) != told[2]:
            m.flags |= MANIFEST_ID
    if digest(m.suite, data[:end]) != file_digest:
        m.flags |= FILE_DIGEST
    known = REGISTERED.get(m.profile_id)
    if known and bytes.fromhex(known.fingerprint()) != m.fingerprint:
        m.flags |= PROFILE_SEMANTICS
    return m


def create(content: bytes, profile: Profile = STABLE, profile_id: str = fixed.STABLE_PROFILE, suite: str = fixed.BLAKE3_SUITE) -> Manifest:
    records, at = [], 0
    for n in cut(content, profile):
        records.append((digest(suite, content[at : at + n]), n))
        at += n
    fingerprint = bytes.fromhex(profile.fingerprint())
    return Manifest(suite, profile_id, fingerprint, records, manifest_id(suite, profile_id, fingerprint, records))


def verify(data: bytes, content: bytes | None = None, profiles: dict[str, Profile] = REGISTERED) -> tuple[str, int]:
    """(outcome, flags): valid, integrity, unsupported or malformed. With content it is cut anew, unless the profile's meaning is in doubt."""
    try:
        m = read(data)
        if content is not None and not m.flags & PROFILE_SEMANTICS:
            if m.profile_id not in profiles:
                raise Unsupported("profile")
            p = profiles[m.profile_id]
            if bytes.fromhex(p.fingerprint()) != m.fingerprint:
                m.flags |= PROFILE_SEMANTICS
            else:
                now = create(content, p, m.profile_id, m.suite).manifest_id
                if now not in (m.manifest_id, manifest_id(m.suite, m.profile_id, m.fingerprint, m.records)):
                    m.flags |= CONTENT
    except Malformed:
        return "malformed", 0
    except Unsupported:
        return "unsupported", 0
    return ("integrity" if m.flags else "valid"), m.flags


def first_difference(m: Manifest, content: bytes) -> int | None:
    """The lowest record whose bytes differ, by its place alone."""
    for i, ((chunk, n), at) in enumerate(zip(m.records, m.offsets, strict=True)):
        if digest(m.suite, content[at : at + n]) != chunk or at + n > len(content):
            return i
    return None if m.content_length == len(content) else len(m.records)

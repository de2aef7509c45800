"""Chunking profiles, hash suites and the digests that name them."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from dataclasses import dataclass
from decimal import Decimal

import numpy as np

from corestrata.functions import fixed

ID_PATTERN = r"^[a-z0-9][a-z0-9._-]{0,127}$"
SUITES = (fixed.SHA256_SUITE, fixed.BLAKE3_SUITE)
MAX_NUMBER_CHARS, MAX_DIGITS, MAX_EXPONENT = 1024, 128, 1024


class Malformed(ValueError):
    """The input breaks its format."""


class Unsupported(ValueError):
    """The input is well formed, but names or sizes are not ours to handle."""


@functools.cache
def gear_table() -> np.ndarray:
    """256 unsigned 64-bit numbers: the first eight bytes, big-endian, of the MD5 of 64 repetitions of each byte."""
    table = np.array([int.from_bytes(hashlib.md5(bytes([i]) * 64, usedforsecurity=False).digest()[:8], "big") for i in range(256)], np.uint64)
    if hashlib.sha256(table.astype("<u8").tobytes()).hexdigest() != fixed.GEAR_SHA256:
        raise AssertionError("the gear table's digest is wrong")
    return table


def mask(bits: int) -> int:
    if not 5 <= bits < 5 + len(fixed.MASKS):
        raise ValueError("no mask has so many bits")
    return fixed.MASKS[bits - 5]


@dataclass(frozen=True)
class Profile:
    """Sizes of content-defined chunks; warm: the hash takes in the bytes before the minimum as well."""

    minimum: int
    target: int
    maximum: int
    warm: bool = False

    def __post_init__(self):
        low, mid, high = self.minimum, self.target, self.maximum
        if low < 64 or mid < 256 or not 1024 <= high <= 16 << 20:
            raise ValueError("a size is out of bounds")
        if not low < mid < high or (low | mid | high) & 1 or mid & (mid - 1):
            raise ValueError("sizes must be even and rise, the target a power of two")
        mask(self.bits + 1), mask(self.bits - 1)

    @property
    def bits(self) -> int:
        return self.target.bit_length() - 1

    @property
    def strict(self) -> int:
        return mask(self.bits + 1)

    @property
    def relaxed(self) -> int:
        return mask(self.bits - 1)

    @property
    def profile_id(self) -> str:
        return f"corestrata.gear.v1.{self.minimum}-{self.target}-{self.maximum}"

    def fingerprint(self) -> str:
        semantics = {
            "algorithm": fixed.ALGORITHM, "sizes": [self.minimum, self.target, self.maximum], "warm": self.warm, "table": [fixed.GEAR_TABLE, fixed.GEAR_SHA256],
            "masks": [f"{self.strict:016x}", f"{self.relaxed:016x}"], "cut": "before the byte whose masked hash is zero, else at the maximum or the end",
        }
        return semantics_fingerprint(json.dumps({"semantics": semantics}))


STABLE = Profile(16 << 10, 64 << 10, 256 << 10)
#: A profile for texts of a few kilobytes.
SMALL = Profile(64, 256, 1024)


def lab_profile(target: int, warm: bool = False) -> Profile:
    return Profile(target // 4, target, target * 4, warm)


def resolve(profile_id: str | None = None, suite: str | None = None) -> tuple[Profile, str, str]:
    """(profile, its id, suite): the defaults for None; only the registered profile and suites are known."""
    profile_id, suite = profile_id or fixed.STABLE_PROFILE, suite or fixed.BLAKE3_SUITE
    for name in (profile_id, suite):
        if not re.match(ID_PATTERN, name):
            raise Malformed(f"{name!r} is no identifier")
    if profile_id != fixed.STABLE_PROFILE or suite not in SUITES:
        raise Unsupported("unknown profile or suite")
    return STABLE, profile_id, suite


def canonical_integer(token: str) -> str:
    """The integer that a JSON number denotes, in plain decimal; fractions and oversized numbers are refused."""
    if not 0 < len(token) <= MAX_NUMBER_CHARS:
        raise Malformed("the number is too long")
    m = re.fullmatch(r"(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?", token)
    if not m or len(m[2]) + len(m[3] or "") > 256 or abs(int(m[4] or 0)) > MAX_EXPONENT:
        raise Malformed("the number's syntax or size is not allowed")
    if not (m[2] + (m[3] or "")).strip("0"):
        return "0"
    sign, digits, exponent = Decimal(token).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    if exponent < 0:
        text, rest = text[:exponent], text[exponent:]
        if rest.strip("0") or not text:
            raise Malformed("the number is fractional")
    else:
        text += "0" * exponent
    if len(text) > MAX_DIGITS:
        raise Malformed("the integer has too many digits")
    return f"-{text}" if sign else text


class _Number(str):
    """A number's text as it stood in the JSON."""


def _object(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise Malformed("a property occurs twice")
    return dict(pairs)


def _encode(value) -> bytes:
    text = lambda s: struct.pack("<I", len(b := s.encode())) + b
    if value is None:
        return b"\0"
    if isinstance(value, bool):
        return b"\2" if value else b"\1"
    if isinstance(value, _Number):
        return b"\3" + text(canonical_integer(value))
    if isinstance(value, str):
        return b"\4" + text(value)
    if isinstance(value, list):
        return b"\5" + struct.pack("<I", len(value)) + b"".join(map(_encode, value))
    keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
    return b"\6" + struct.pack("<I", len(keys)) + b"".join(text(k) + _encode(value[k]) for k in keys)


def semantics_fingerprint(artifact: str) -> str:
    """SHA-256 of the typed canonical encoding of the object "semantics" in a JSON artifact."""
    parsed = json.loads(artifact, parse_int=_Number, parse_float=_Number, object_pairs_hook=_object)
    if not isinstance(parsed, dict) or not isinstance(parsed.get("semantics"), dict):
        raise Malformed("there is no object named semantics")
    return hashlib.sha256(fixed.PROFILE_DOMAIN + _encode(parsed["semantics"])).hexdigest()

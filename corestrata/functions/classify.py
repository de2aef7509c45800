"""What a content is, by its structure: executables and compressed containers."""

from __future__ import annotations

import struct
import zlib

_MACHINES = {0x8664: "x64", 0xAA64: "arm64", 0x14C: "x86"}
_ELF_MACHINES = {62: "x64", 183: "arm64", 3: "x86"}
_OTHER = (b"\x28\xb5\x2f\xfd", b"\xfd7zXZ\0", b"BZh", b"7z\xbc\xaf\x27\x1c", b"\x04\x22\x4d\x18", b"Rar!\x1a\x07", b"\x89PNG\r\n\x1a\n")


def executable(data: bytes) -> tuple[str, str, str]:
    """(kind, architecture, reason): PE images, managed or native, ELF files, malformed ones of either, or no executable."""
    if data[:2] == b"MZ":
        try:
            at = struct.unpack_from("<I", data, 0x3C)[0]
            if data[at : at + 4] != b"PE\0\0":
                return "malformed", "unknown", "NO_PE_SIGNATURE"
            machine, sections, _, _, _, optional = struct.unpack_from("<HHIIIH", data, at + 4)
            magic = struct.unpack_from("<H", data, at + 24)[0]
            if magic not in (0x10B, 0x20B):
                return "malformed", "unknown", "OPTIONAL_HEADER"
            directories = at + 24 + (96 if magic == 0x10B else 112)
            count = struct.unpack_from("<I", data, directories - 4)[0]
            clr = struct.unpack_from("<II", data, directories + 14 * 8) if count > 14 and optional >= directories - at - 24 + 15 * 8 else (0, 0)
            if at + 24 + optional + 40 * sections > len(data):
                return "malformed", "unknown", "SECTION_TABLE"
        except struct.error:
            return "malformed", "unknown", "TRUNCATED_PE"
        return ("pe-managed" if clr[0] else "pe-native"), _MACHINES.get(machine, "other"), "CLR_HEADER" if clr[0] else "NO_CLR_HEADER"
    if data[:4] == b"\x7fELF":
        if len(data) < 20 or data[4] not in (1, 2) or data[5] not in (1, 2):
            return "malformed", "unknown", "ELF_IDENT"
        machine = struct.unpack_from("<H" if data[5] == 1 else ">H", data, 18)[0]
        return "elf", _ELF_MACHINES.get(machine, "other"), "ELF_HEADER"
    return "not-executable", "unknown", "NO_PE_OR_ELF_MAGIC"


def container(data: bytes) -> tuple[str, str]:
    """(kind, reason): zip by its end record, gzip, zlib, other compressed formats by magic, or none. Raw deflate is never guessed."""
    end = data.rfind(b"PK\5\6", max(0, len(data) - 65557))
    if end >= 0 and len(data) >= end + 22:
        count, size, offset, comment = struct.unpack_from("<HIIH", data, end + 10)
        if end + 22 + comment != len(data) or offset + size > end:
            return "malformed-zip", "END_RECORD"
        at, methods = offset, set()
        for _ in range(count):
            if data[at : at + 4] != b"PK\1\2" or at + 46 > end:
                return "malformed-zip", "CENTRAL_DIRECTORY"
            flags, method = struct.unpack_from("<HH", data, at + 8)
            if flags & 1:
                return "encrypted-zip", "ENCRYPTED_ENTRY"
            methods.add(method)
            at += 46 + sum(struct.unpack_from("<HHH", data, at + 28))
        return "zip", "DEFLATE" if 8 in methods else "STORED" if methods <= {0} else "OTHER_METHOD"
    if data[:2] == b"\x1f\x8b":
        if len(data) < 18 or data[2] != 8 or data[3] & 0xE0:
            return "malformed-gzip", "HEADER"
        try:
            d = zlib.decompressobj(31)
            d.decompress(data, 1 << 16)
        except zlib.error:
            return "malformed-gzip", "STREAM"
        return "gzip", "DEFLATE"
    if len(data) >= 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        if data[1] & 32:
            return "zlib-preset-dictionary", "ZLIB_PRESET_DICTIONARY"
        try:
            zlib.decompressobj().decompress(data, 1 << 16)
        except zlib.error:
            return "none", "NO_SUPPORTED_COMPRESSED_STRUCTURE"
        return "zlib", "DEFLATE"
    if data.startswith(_OTHER):
        return "compressed-other", "KNOWN_COMPRESSED_MAGIC"
    return "none", "NO_SUPPORTED_COMPRESSED_STRUCTURE"

"""Stored forms of chunks: raw, and Zstandard frames with or without raw dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

import zstandard

from corestrata.functions.fixed import ZSTD_DICTIONARY_MAGIC
from corestrata.functions.profiles import Malformed

RAW, ZSTD = 0, 1
WINDOW_LOG, DICTIONARY_BYTES, MOST_REFERENCES, REFERENCE_BYTES = 20, 1 << 20, 4, 32
_FRAME_MAGIC = bytes.fromhex("28b52ffd")


def usable_dictionary(data: bytes) -> bool:
    return len(data) <= DICTIONARY_BYTES and not data.startswith(ZSTD_DICTIONARY_MAGIC)


def compress(data: bytes, dictionary: bytes = b"", level: int = 19, window_log: int = WINDOW_LOG) -> bytes:
    """One frame that tells its content's size, no dictionary id and no checksum, with a window of 1 << window_log bytes at most."""
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    p = zstandard.ZstdCompressionParameters.from_level(level, source_size=len(data), dict_size=len(dictionary))
    if p.window_log > window_log or p.hash_log > 20 or p.chain_log > 20:
        p = zstandard.ZstdCompressionParameters.from_level(level, source_size=len(data), dict_size=len(dictionary), window_log=min(window_log, p.window_log), hash_log=min(20, p.hash_log), chain_log=min(20, p.chain_log), write_content_size=1, write_checksum=0, write_dict_id=0)
        return zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(data)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=False, write_dict_id=False).compress(data)


def _against(base: bytes, total: int, level: int):
    """A compressor that has gone through base, with a window and long matches that reach all of it, and the head it gave."""
    p = zstandard.ZstdCompressionParameters.from_level(level, window_log=min(31, max(10, total.bit_length())), enable_ldm=True, write_content_size=0, write_checksum=0, write_dict_id=0)
    c = zstandard.ZstdCompressor(compression_params=p).compressobj()
    return c, c.compress(base) + c.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)


def patch_from(data: bytes, base: bytes, level: int = 19) -> bytes:
    """What a frame of base and data has beyond base: a receiver makes the head anew from its base."""
    c, _ = _against(base, len(base) + len(data), level)
    return c.compress(data) + c.flush()


def patch_restore(stored: bytes, base: bytes, length: int, level: int = 19) -> bytes:
    _, head = _against(base, len(base) + length, level)
    return zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj().decompress(head + stored)[len(base) :]


@dataclass(frozen=True)
class Frame:
    content: int
    window: int
    dictionary_id: int
    checksum: bool
    size: int


def frame(data: bytes) -> Frame:
    """Header of the frame that data begins with, and the frame's size by walking its blocks."""
    if data[:4] != _FRAME_MAGIC or len(data) < 6:
        raise Malformed("no zstd frame")
    told = data[4]
    single, at = told >> 5 & 1, 5
    if told & 8:
        raise Malformed("a reserved bit is set")
    window = 0
    if not single:
        e, m = data[at] >> 3, data[at] & 7
        window, at = (1 << 10 + e) + m * (1 << 10 + e) // 8, at + 1
    size_of_id = (0, 1, 2, 4)[told & 3]
    dictionary_id, at = int.from_bytes(data[at : at + size_of_id], "little"), at + size_of_id
    size_of_content = (1 if single else 0, 2, 4, 8)[told >> 6]
    if not size_of_content:
        raise Malformed("the frame does not tell its content's size")
    content = int.from_bytes(data[at : at + size_of_content], "little") + (256 if size_of_content == 2 else 0)
    at += size_of_content
    last = False
    while not last:
        if at + 3 > len(data):
            raise Malformed("the frame is truncated")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        if kind == 3:
            raise Malformed("a reserved block")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (told >> 2 & 1)
    if at > len(data):
        raise Malformed("the frame is truncated")
    return Frame(content, content if single else window, dictionary_id, bool(told & 4), at)


def decompress(stored: bytes, length: int, dictionary: bytes = b"") -> bytes:
    """The content of exactly one frame that obeys the bounds above."""
    f = frame(stored)
    if f.size != len(stored):
        raise Malformed("more than one frame")
    if f.content != length or f.dictionary_id or f.window > 1 << WINDOW_LOG:
        raise Malformed("the frame's header is not allowed")
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    try:
        out = zstandard.ZstdDecompressor(dict_data=d, max_window_size=1 << WINDOW_LOG).decompress(stored, max_output_size=length)
    except zstandard.ZstdError as e:
        raise Malformed(str(e)) from e
    if len(out) != length:
        raise Malformed("the frame's content has another size")
    return out


def decode(encoding: int, stored: bytes, length: int, dictionary: bytes = b"") -> bytes:
    if encoding == RAW:
        if len(stored) != length:
            raise Malformed("raw bytes of another length")
        return stored
    return decompress(stored, length, dictionary)


def cost(stored: int, references: int) -> int:
    return stored + REFERENCE_BYTES * references


def xor_residual(base: bytes, target: bytes, level: int = 19) -> bytes:
    """The XOR of target and base (zero beyond its end), compressed."""
    n = len(target)
    b = int.from_bytes(base[:n].ljust(n, b"\0"), "little")
    return compress((int.from_bytes(target, "little") ^ b).to_bytes(n, "little"), level=level)


def xor_restore(base: bytes, stored: bytes, length: int) -> bytes:
    b = int.from_bytes(base[:length].ljust(length, b"\0"), "little")
    return (int.from_bytes(decompress(stored, length), "little") ^ b).to_bytes(length, "little")


def sparse_size(runs: list[tuple[int, bytes]]) -> int:
    """Bytes of runs as an offset and a length of eight bytes together, and the new bytes."""
    return sum(8 + len(new) for _, new in runs)


def sparse_runs(base: bytes, target: bytes) -> list[tuple[int, bytes]]:
    """Places and new bytes where target differs from base."""
    import numpy as np

    n = len(target)
    a = np.frombuffer(base[:n].ljust(n, b"\0"), np.uint8)
    t = np.frombuffer(target, np.uint8)
    where = np.flatnonzero(a != t)
    groups = np.split(where, np.flatnonzero(np.diff(where) > 1) + 1) if len(where) else []
    return [(int(g[0]), target[g[0] : g[-1] + 1]) for g in groups]

"""Byte-level BPE in numpy: padded matrices by length, one merge of each row a round."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corestrata.llm.common import batches, pair, texts

#: Longer pieces are merged one by one with a heap: a matrix would take the square of their length.
MATRIX = 256
#: Cells of one matrix.
CELLS = 1 << 20
REMEMBERED = 500_000
LONGEST = 64
_NONE = np.int32(0x7FFFFFFF)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class PairTable:
    """Open addressing from a pair of ids to the id of the two joined; a lower id merges first."""

    def __init__(self, known: dict[tuple[int, int], int]):
        keys = np.array([a << 32 | b for a, b in known], np.uint64)
        values = np.array(list(known.values()), np.int32)
        self.bits = max(12, (8 * max(1, len(keys))).bit_length())
        self.keys = np.full((1 << self.bits) + 64, _EMPTY)
        self.values = np.full(len(self.keys), _NONE)
        left, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            free = self.keys[slot] == _EMPTY
            _, one = np.unique(slot[free], return_index=True)  # one newcomer a slot
            take = np.flatnonzero(free)[one]
            self.keys[slot[take]], self.values[slot[take]] = keys[left[take]], values[left[take]]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, slot = left[rest], slot[rest] + 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joined ids, _NONE where there is none or an id is negative."""
        shape = a.shape
        keys = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64) & np.uint64(0xFFFFFFFF)).ravel()
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        left = np.flatnonzero((found != keys) & (found != _EMPTY))
        for step in range(1, self.probes):
            if not len(left):
                break
            at = slot[left] + step
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (found != _EMPTY)]
        return np.where((a < 0) | (b < 0), _NONE, out.reshape(shape))


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def merge_rows(ids: np.ndarray, length: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Each round every row merges its leftmost pair of least rank; rows without one leave. ids: int32, padded with -1. Returns each row's ids as little-endian unsigned 32-bit numbers."""
    rank = pairs.look_up(ids[:, :-1], ids[:, 1:])
    row = np.arange(len(ids))
    out: list = [b""] * len(ids)
    while len(row):
        line = np.arange(len(row))
        at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
        best = rank[line, at] if rank.shape[1] else np.full(len(row), _NONE)
        over = best == _NONE
        if over.any():
            raw, step = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, (i, n) in enumerate(zip(row[over].tolist(), (4 * length[over]).tolist(), strict=True)):
                out[i] = raw[k * step : k * step + n]
            stay = ~over
            row, ids, rank, length, at, best = row[stay], ids[stay], rank[stay], length[stay], at[stay], best[stay]
            if not len(row):
                break
            most = int(length.max())
            if most < ids.shape[1]:  # columns that no row needs any more
                ids, rank = ids[:, :most].copy(), rank[:, : most - 1].copy()
            line = np.arange(len(row))
        last = ids.shape[1] - 1
        move = np.arange(last) > at[:, None]
        ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])  # compaction: what follows the pair moves up
        ids[:, -1] = -1
        ids[line, at] = best
        length = length - 1
        if last > 1:
            later = np.arange(last - 1) > at[:, None]
            rank[:, :-1] = np.where(later, rank[:, 1:], rank[:, :-1])
        rank[:, -1] = _NONE
        for shift in (-1, 0):  # only the merged id's own pairs are new
            left = at + shift
            ok = np.flatnonzero((left >= 0) & (left < last))
            rank[ok, left[ok]] = pairs.look_up(ids[ok, left[ok]], ids[ok, left[ok] + 1])
    return out


def merge_words(words: list[bytes], first: np.ndarray, pairs: PairTable, final: np.ndarray | None = None) -> list[bytes]:
    """Ids of words of at most MATRIX bytes, bucketed by length and padded. first: the id of each byte; final: of a word's last byte, if that differs."""
    out: list = [b""] * len(words)
    buckets: dict[int, list[int]] = {}
    for i, n in enumerate(map(len, words)):
        if n:
            buckets.setdefault(n if n <= 16 else -(-n // 8) * 8 if n <= 64 else -(-n // 64) * 64, []).append(i)
    for width, rows in buckets.items():
        step = max(1, CELLS // width)
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            some = [words[j] for j in part]
            length = np.fromiter(map(len, some), np.int64, len(some))
            raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in some), np.uint8).reshape(-1, width)
            ids = np.where(np.arange(width) < length[:, None], first[raw], np.int32(-1))
            if final is not None:
                ids[np.arange(len(some)), length - 1] = final[raw[np.arange(len(some)), length - 1]]
            for i, x in zip(part, merge_rows(ids, length, pairs), strict=True):
                out[i] = x
    return out


_CLASS = re.compile(r"\\[pP]\{\^?\w+\}|\\[sSdDwW]")


@functools.cache
def _members(name: str) -> tuple[np.ndarray, np.ndarray]:
    """By code point, whether a class such as \\p{L} holds it, for the tiktoken library and for regex: their tables are of different versions of Unicode."""
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    out = np.zeros((2, 0x110000), bool)
    for row, found in zip(out, (bytes(library.encode_ordinary(every)).decode(), "".join(regex.findall(name, every))), strict=True):
        row[np.frombuffer(found.encode("utf-32-le"), "<u4")] = True
    return out[0], out[1]


def _ranges(members: np.ndarray) -> str:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], members, [False]))))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


def plain_classes(pattern: str) -> tuple[str, str]:
    """The pattern with the library's members of each class written out, and a pattern of the code points on which regex has others ("" for none)."""
    out, at, odd = [], 0, np.zeros(0x110000, bool)
    for m in _CLASS.finditer(pattern):
        between = pattern[at : m.start()]
        if (len(between) - len(between.rstrip("\\"))) % 2:  # an escaped backslash, and no class
            continue
        ours, theirs = _members(m[0])
        odd |= ours != theirs
        before = re.sub(r"\\.", "", pattern[: m.start()])
        inside = before.rfind("[") > before.rfind("]")
        out += [between, _ranges(ours) if inside else f"[{_ranges(ours)}]"]
        at = m.end()
    return "".join([*out, pattern[at:]]), f"[{_ranges(odd)}]" if odd.any() else ""


class BytePairs:
    """Encodes and decodes as the tiktoken library does with these ranks and this pattern, without special tokens.

    classes: what plain_classes(pattern) gives, if that is at hand. Texts with a code point on which the two
    libraries' classes differ are split by the pattern that has the members written out.
    """

    def __init__(self, path: str, pattern: str, classes: tuple[str, str] | None = None):
        import regex

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.written, odd = classes or plain_classes(pattern)
        self.odd = re.compile(odd).search if odd else None
        ranks = self.ranks
        self.pairs = PairTable({(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks})
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    def pieces(self, words: list[bytes]) -> list[bytes]:
        """Ids of each piece, alone. A piece that is a token as a whole is that token."""
        whole = list(map(self.ranks.get, words))
        rest = [i for i, r in enumerate(whole) if r is None and len(words[i]) <= MATRIX]
        out = [b"" if r is None else r.to_bytes(4, "little") for r in whole]
        for i, x in zip(rest, merge_words([words[i] for i in rest], self.first, self.pairs), strict=True):
            out[i] = x
        for i, r in enumerate(whole):
            if r is None and len(words[i]) > MATRIX:
                out[i] = self._long(words[i]).astype("<u4").tobytes()
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """The same merges by a heap of (rank, position), for pieces of any length."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks
        text = [self.bytes_of[i] for i in ids]
        heap = [(r, i, 0, 0) for i in range(n - 1) if (r := ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        age = [0] * n  # of what stands at a position; a heap entry holds both ages
        while heap:
            r, i, x, y = heapq.heappop(heap)
            if age[i] != x or ids[i] < 0 or (j := after[i]) >= n or age[j] != y:
                continue
            ids[i], text[i], age[i] = r, text[i] + text[j], age[i] + 1
            ids[j], age[j] = -1, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := ranks.get(text[i] + text[after[i]])) is not None:
                    heapq.heappush(heap, (s, i, age[i], age[after[i]]))
            if (p := before[i]) >= 0 and (s := ranks.get(text[p] + text[i])) is not None:
                heapq.heappush(heap, (s, p, age[p], age[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def split(self, text: str) -> list[str]:
        if self.odd is None or text.isascii() or not self.odd(text):
            return self.pattern.findall(text)
        import regex

        return regex.findall(self.written, text)  # which keeps compiled patterns

    def encode(self, some: list[str]) -> list[np.ndarray]:
        """Ids of whole texts as unsigned 32-bit numbers; distinct pieces of all texts are merged together, once."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [self.split(t) for t in some]
        missing = list(set().union(*split).difference(self.known)) if split else []
        once: dict[str, bytes] = {}
        for w, ids in zip(missing, self.pieces([w.encode() for w in missing]), strict=True):
            (self.known if len(w) <= LONGEST else once)[w] = ids
        get = self.known.__getitem__ if not once else lambda w: self.known[w] if w in self.known else once[w]
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(2)
def _coder(path: str, pattern: str, classes: tuple[str, str]) -> BytePairs:
    """One for all tasks of a Python worker."""
    return BytePairs(path, pattern, classes)


def _digests(path: str, pattern: str):
    classes = plain_classes(pattern)

    def run(source):
        coder = _coder(path, pattern, classes)
        name = list(map(str, range(max(coder.bytes_of) + 1)))

        def make(batch):
            n, of_ids, of_bytes = [], [], []
            for ids in coder.encode(texts(batch.column(1))):
                ids = ids.tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            return [batch.column(0), n, of_ids, of_bytes]

        yield from batches(source, make, _OUT)

    return run


def _encoded(path: str, pattern: str):
    schema, classes = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), plain_classes(pattern)

    def run(source):
        coder = _coder(path, pattern, classes)
        yield from batches(source, lambda b: [b.column(0), pa.array([x.astype(np.int32) for x in coder.encode(texts(b.column(1)))], pa.list_(pa.int32()))], schema)

    return run


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of whole texts of any length; null counts as empty, of no ids; repeated rows each give a row; null doc_ids stay null; an empty table gives no rows. Pairs of equal rank merge leftmost first. Further columns are not read, whatever they are called."""
    return pair(docs, id_col, text_col).selectExpr("cast(_id as long)", "_value").mapInArrow(_encoded(ranks_path, pattern), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes); null ids count as none. Bytes need not be UTF-8 where ids were cut."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(source):
        names = {r: t for t, r in read_ranks(ranks_path).items()}
        yield from batches(source, lambda b: [b.column(0), [b"".join(map(names.__getitem__, x or ())) for x in b.column(1).to_pylist()]], schema)

    return encoded.selectExpr("cast(doc_id as long)", "ids").mapInArrow(run, "doc_id long, bytes binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids; nulls, empty and long texts, ties, repeated rows and further columns as in encode_texts(). No shuffle."""
    return pair(docs, id_col, text_col).selectExpr("cast(_id as long)", "_value").mapInArrow(_digests(ranks_path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

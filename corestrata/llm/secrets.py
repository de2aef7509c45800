"""Secret scans: keywords by Aho-Corasick, expressions anchored at their hits, then checksums inside the tokens."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corestrata.llm.common import batches, bounded_batches, pair, texts

#: Kinds in the order of spans that begin together. The first three are the base kinds; the others carry a checksum.
KINDS = ("assign", "access", "hex", "github", "npm")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
#: Tokens of 30 base-62 characters and 6 more that hold their CRC-32 (public formats of two hosting services).
_CHECKED = {"github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_SHORTEST_HEX = 24
_STEP = _SHORTEST_HEX // 4
_OUT = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("redacted", pa.string())])


def base62_crc(body: bytes) -> bytes:
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = _DIGITS[k] + out
    return out.encode()


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in _WORDS:
        found.add_word(w, ("assign", len(w)))
    for w, kind in (("akia", "access"), ("ghp_", "github"), ("gho_", "github"), ("ghu_", "github"), ("ghs_", "github"), ("ghr_", "github"), ("npm_", "npm")):
        found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def _hex_anchors(raw: bytes) -> np.ndarray:
    """Places that every run of 24 hexadecimal digits or more holds, and little else: four digits in a row of every sixth byte."""
    at = _IS_HEX[np.frombuffer(raw, np.uint8)[::_STEP]]
    return np.flatnonzero(at[:-3] & at[1:-2] & at[2:-1] & at[3:]) * _STEP if len(at) > 3 else np.empty(0, np.int64)


class Scanner:
    def __init__(self):
        self.words = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, end exclusive, by start and then kind. Leftmost and without overlap in each kind."""
        raw = text.encode()
        found: list[tuple[int, int, int]] = []
        reached = dict.fromkeys(KINDS, 0)
        hits = sorted((end + 1 - n, kind) for end, (kind, n) in self.words.iter(raw.translate(_LOWER).decode("latin-1")))
        for start, kind in hits:
            if start < reached[kind]:
                continue
            if kind == "assign":
                if m := _ASSIGN.match(raw, start):
                    reached[kind] = m.end()
                    if m.end(2) - m.start(2) >= 6:
                        found.append((start, 0, m.end()))
            elif kind == "access":
                if m := _ACCESS.match(raw, start):
                    reached[kind] = m.end()
                    if m.end() - start >= 20:
                        found.append((start, 1, m.end()))
            elif (m := _CHECKED[kind].match(raw, start)) and base62_crc(m[1]) == m[2]:
                reached[kind] = m.end()
                found.append((start, KINDS.index(kind), m.end()))
        end = 0
        for at in _hex_anchors(raw).tolist():
            if at < end:
                continue
            start = at
            while start > end and _IS_HEX[raw[start - 1]]:
                start -= 1
            end = _HEX.match(raw, at).end()
            if end - start >= _SHORTEST_HEX:
                found.append((start, 2, end))
        found.sort()
        if len(raw) == len(text):
            return [(KINDS[k], a, b) for a, k, b in found]
        places = sorted({x for a, _, b in found for x in (a, b)})
        points, at, n = {}, 0, 0
        for p in places:  # bytes to code points, each stretch once
            n += len(raw[at:p].decode())
            points[p], at = n, p
        return [(KINDS[k], points[a], points[b]) for a, k, b in found]


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """text with each stretch that spans cover replaced by one mark."""
    parts, at = [], 0
    stretches: list[list[int]] = []
    for _, a, b in spans:
        if stretches and a < stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    for a, b in stretches:
        parts += [text[at:a], mark]
        at = b
    return "".join([*parts, text[at:]])


def _scan(source):
    scanner = Scanner()

    def make(batch):
        some = texts(batch.column(1))
        spans = [scanner.spans(t) for t in some]
        return [batch.column(0), [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], [redact(t, s) if s else None for t, s in zip(some, spans, strict=True)]]

    yield from batches(source, make, _OUT)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end), redacted (the text with marks; null where nothing was found).

    Whole texts of any length; null counts as empty and has no spans; repeated rows each give a row; an empty table
    gives none; null doc_ids stay null. Spans of one kind don't overlap, the leftmost goes first; those of different
    kinds may, and where they begin together they stand in the order of KINDS. Further columns are not read,
    whatever they are called. No shuffle.
    """
    return pair(docs, id_col, text_col).selectExpr("cast(_id as long)", "_value").mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>, redacted string")


def _redacted(columns: list[str], at: int, schema):
    def run(source):
        scanner = Scanner()
        for batch in source:
            out = [t if t is None or not (s := scanner.spans(t)) else redact(t, s) for t in batch.column(at).to_pylist()]
            arrays = [pa.array(out, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return run


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all its columns and rows; found secrets in text_col are replaced by marks, one for spans that overlap.

    Null and empty texts stay, and so do null doc_ids and repeated rows; long texts are scanned whole; an empty
    table gives no rows; columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_redacted(docs.columns, docs.columns.index(text_col), None), docs.schema)


def digests(scanned: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.encode(F.array_join(F.transform(base, line), ","), "UTF-8"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in KINDS[:3]).encode()).hexdigest()

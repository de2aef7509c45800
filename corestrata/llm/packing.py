"""Packing of token streams into sequences, in order, by dynamic programming over document and sentence ends."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corestrata.llm.common import pair
from corestrata.llm.tokens import word_cache

LENGTH = 4096
END_ID = 2
#: Costs, in tokens of padding, of a cut inside a document: after a sentence, and elsewhere.
SENTENCE_COST, HARD_COST = 8, 64
#: Cost of a sequence besides, so that short sequences that need no padding are made where they save some, not everywhere.
SEQUENCE_COST = 128
#: Places for cuts elsewhere, where no sentence ends within so many tokens.
HARD_STEP = 512
#: Tokens that a task holds before it decides; the last, unfinished sequence is carried on.
HELD = 1 << 19
#: Texts whose new words are encoded at a time.
TOGETHER = 1000
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def padding(length: int, full: int = LENGTH) -> int:
    """What a sequence is padded by: to the full length, except at a power of two."""
    return 0 if length & (length - 1) == 0 else full - length


def best_cuts(places: np.ndarray, costs: np.ndarray, last: bool, length: int = LENGTH) -> list[int]:
    """Indices of places to cut at (the first and the last included) so that windows hold at most length tokens and padding, costs and SEQUENCE_COST for each window are least.

    f(j) = SEQUENCE_COST + cost[j] + the least of length - c[j] + f(i) + c[i] over i with c[j] - c[i] <= length, whose
    minimum moves with a monotone queue, and of f(i) over the few i with c[j] - c[i] a power of two, which needs no
    padding; so all is linear in the places. Neighbouring places must lie within length. Unless last, the final
    window isn't charged: it will be carried on.
    """
    c, p = places.tolist(), (costs + SEQUENCE_COST).tolist()
    sizes = [1 << k for k in range(length.bit_length())]
    earlier = [np.searchsorted(places, places - n) for n in sizes]  # where a place a power of two before would stand
    met = [np.flatnonzero(places[x] == places - n) for n, x in zip(sizes, earlier, strict=True)]
    later, back = np.concatenate(met), np.concatenate([x[m] for x, m in zip(earlier, met, strict=True)])
    even = back[np.argsort(later, kind="stable")].tolist()
    first = np.searchsorted(np.sort(later), np.arange(len(c) + 1)).tolist()
    total, came = [0] * len(c), [0] * len(c)
    values, indices, head = [c[0]], [0], 0  # the monotone queue, from head on
    for j in range(1, len(c)):
        at = c[j]
        while at - c[indices[head]] > length:
            head += 1
        f, i = values[head] + length - at, indices[head]
        for k in even[first[j] : first[j + 1]]:
            if total[k] < f:
                f, i = total[k], k
        f += p[j]
        total[j], came[j] = f, i
        value = f + at
        while len(values) > head and values[-1] >= value:
            values.pop(), indices.pop()
        values.append(value), indices.append(j)
    j = len(c) - 1
    if not last and j:
        came[j] = min(range(int(np.searchsorted(places, c[j] - length)), j), key=total.__getitem__)
    cuts = [j]
    while j:
        j = came[j]
        cuts.append(j)
    return cuts[::-1]


class _Packer:
    def __init__(self, first_id: int, length: int):
        self.docs: list[tuple[int | None, int, int, np.ndarray, np.ndarray]] = []  # doc_id, all its tokens, those before, ids, sentence ends
        self.tokens, self.next, self.length = 0, first_id, length

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), 0, ids, ends))
        self.tokens += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of all finished sequences."""
        if not self.docs:
            return []
        sizes = np.array([len(d[3]) for d in self.docs])
        begins = np.concatenate(([0], np.cumsum(sizes)))
        cost: dict[int, int] = {}
        soft = np.concatenate([b + d[4] for b, d in zip(begins[:-1].tolist(), self.docs, strict=True)] or [[]]).astype(np.int64)
        places = np.union1d(soft, begins)
        gaps = np.flatnonzero(np.diff(places) > HARD_STEP)
        hard = np.concatenate([np.arange(places[g] + HARD_STEP, places[g + 1], HARD_STEP) for g in gaps]) if len(gaps) else np.empty(0, np.int64)
        places = np.union1d(places, hard)
        costs = np.full(len(places), SENTENCE_COST)
        costs[np.searchsorted(places, hard)] = HARD_COST
        costs[np.searchsorted(places, begins)] = 0
        cuts = places[best_cuts(places, costs, last, self.length)]
        whole = cuts if last else cuts[:-1]
        end = int(whole[-1])
        edges = np.union1d(whole, begins[begins <= end])
        pieces = []
        of_doc = np.searchsorted(begins, edges[:-1], "right") - 1
        of_seq = np.searchsorted(whole, edges[:-1], "right") - 1
        for a, b, d, s in zip(edges[:-1].tolist(), edges[1:].tolist(), of_doc.tolist(), of_seq.tolist(), strict=True):
            doc_id, n, before, ids, _ = self.docs[d]
            at = a - int(begins[d])
            pieces.append((doc_id, before + at, b - a, zlib.crc32(ids[at : at + b - a].tobytes()), n, self.next + s, a - int(whole[s])))
        self.next += len(whole) - 1
        rest = []
        for (doc_id, n, before, ids, ends), b in zip(self.docs, begins[:-1].tolist(), strict=True):
            if b + len(ids) > end:
                cut = max(0, end - b)
                rest.append((doc_id, n, before + cut, ids[cut:].copy(), ends[ends > cut] - cut))
        self.docs, self.tokens = rest, sum(len(d[3]) for d in rest)
        return pieces


def _pack(path: str, length: int):
    def run(source):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        context = TaskContext.get()
        cache, packer = word_cache(path), _Packer((context.partitionId() if context else 0) << 36, length)
        tail, stop = np.array([END_ID], "<u4"), cache.sentence_ends()

        def out(pieces):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces, strict=True), _PIECES, strict=True)], schema=_PIECES)

        for batch in source:
            for k in range(0, batch.num_rows, TOGETHER):
                for doc_id, ids in zip(batch.column(0)[k : k + TOGETHER].to_pylist(), cache.ids(batch.column(1)[k : k + TOGETHER]), strict=True):
                    ids = np.concatenate((ids, tail))
                    packer.add(doc_id, ids, np.flatnonzero(stop[ids[:-1]]) + 1)
                if packer.tokens >= HELD and (pieces := packer.flush(False)):
                    yield out(pieces)
        if pieces := packer.flush(True):
            yield out(pieces)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences of at most length tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then END_ID; documents follow each other as the scan gives them, and no row is
    shuffled: each task packs what it reads and pads one unfinished sequence at most. Each id is in exactly one
    piece. sequence_id holds the task's number in its upper bits. Null texts count as empty (END_ID alone);
    null doc_ids stay null; repeated rows are packed each; an empty table gives no pieces. Texts of any length are cut
    where it costs least; of cuts that tie the later queue entry loses. Further columns are not read, whatever they
    are called. length must be at least HARD_STEP.
    """
    if length < HARD_STEP:
        raise ValueError(f"length is below {HARD_STEP}")
    return pair(docs, id_col, text_col).selectExpr("cast(_id as long)", "_value").mapInArrow(
        _pack(tokenizer_path, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )

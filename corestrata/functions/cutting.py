"""Cut positions of content-defined and fixed chunks, in numpy."""

from __future__ import annotations

import bisect
import itertools

import numpy as np

from corestrata.functions.profiles import Profile, gear_table

#: A byte leaves the 64-bit hash after so many more.
WINDOW = 64
#: Bytes that are hashed at a time.
BLOCK = 1 << 15
#: Bytes of a content that are fed at a time: hashes take eight times as much.
SEGMENT = 1 << 20
_SHIFTS = np.arange(1, WINDOW, dtype=np.uint64)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of it and all before it: sums of windows of 1, 2, 4 ... 64 bytes, each from two of half the size. Block by block, so that a block stays in the cache."""
    gear, n = gear_table(), len(data)
    out = np.empty(n, np.uint64)
    room, spare = np.empty((2, min(n, BLOCK) + WINDOW), np.uint64)
    for start in range(0, n, BLOCK):
        low, end = max(0, start - WINDOW + 1), min(n, start + BLOCK)
        m = end - low
        h = room[:m]
        np.take(gear, data[low:end], out=h, mode="clip")
        size = 1
        while size < min(WINDOW, m):
            shifted = spare[: m - size]
            np.left_shift(h[:-size], np.uint64(size), out=shifted)
            h[size:] += shifted
            size *= 2
        out[start:end] = h[start - low :]
    return out


def _zeros(h: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Where the masked hash is zero."""
    found = [np.flatnonzero((h[k : k + BLOCK] & mask) == 0) + k for k in range(0, len(h), BLOCK)]
    return found[0] if len(found) == 1 else np.concatenate(found)


class Cutter:
    """Cuts a stream that arrives in any segments; between segments only the open chunk's length and hash remain.

    A cut falls before the byte at which the masked hash is zero. The hash begins at the minimum (warm: at the
    chunk's start); as the window's sums are linear, what came before is subtracted for the 63 positions that it
    reaches.
    """

    def __init__(self, profile: Profile, length: int = 0, gear: int = 0):
        self.profile, self.length, self.gear = profile, length, gear

    def feed(self, segment: bytes) -> list[int]:
        """Lengths of the chunks that end within the segment or before."""
        with np.errstate(over="ignore"):  # hashes wrap
            return self._feed(segment)

    def _feed(self, segment: bytes) -> list[int]:
        p = self.profile
        data = np.frombuffer(segment, np.uint8)
        n = len(data)
        if not n:
            return []
        h = rolling(data)
        strict, relaxed = np.uint64(p.strict), np.uint64(p.relaxed)
        strict_at, relaxed_at = _zeros(h, strict), _zeros(h, relaxed)
        begin = 0 if p.warm else p.minimum
        out, start = [], -self.length  # of the open chunk, in the segment
        gear = np.uint64(self.gear)
        while True:
            hashed = max(start + begin, 0)  # from here on the hash goes on, from what it was
            tested = max(start + p.minimum, 0)
            if hashed > 0 or start >= 0:
                gear = np.uint64(0)
            end = min(start + p.maximum, n)
            cut = -1
            if tested < n:
                cut = self._first(h, hashed, tested, min(start + p.target, end), end, gear, strict, relaxed, strict_at, relaxed_at)
            if cut < 0 and start + p.maximum <= n:
                cut = start + p.maximum
            if cut < 0 or (cut == n and cut < start + p.maximum):
                self.length = n - start
                self.gear = int(self._at(h, n - 1, hashed, gear)) if n > hashed else int(gear)
                return out
            out.append(cut - start)
            start, gear = cut, np.uint64(0)
            if start == n:
                self.length = self.gear = 0
                return out

    @staticmethod
    def _at(h: np.ndarray, i: int, hashed: int, gear: np.uint64) -> np.uint64:
        k = i - hashed + 1
        if k >= WINDOW:
            return h[i]
        before = h[hashed - 1] if hashed else np.uint64(0)
        return h[i] + ((gear - before) << np.uint64(k))

    @staticmethod
    def _first(h, hashed, tested, middle, end, gear, strict, relaxed, strict_at, relaxed_at) -> int:
        """The first position from tested on at which the chunk is cut, strictly before middle and loosely from there; or -1."""
        settled = hashed + WINDOW - 1
        before = h[hashed - 1] if hashed else np.uint64(0)
        if tested < settled:
            stop = min(settled, end)
            values = h[tested:stop] + ((gear - before) << _SHIFTS[tested - hashed : stop - hashed])
            k = max(0, min(middle, stop) - tested)
            masked = values & relaxed
            masked[:k] = values[:k] & strict
            hit = np.flatnonzero(masked == 0)
            if len(hit):
                return tested + int(hit[0])
        at = max(tested, settled)
        for places, low, high in ((strict_at, at, middle), (relaxed_at, max(at, middle), end)):
            if low < high:
                k = int(np.searchsorted(places, low))
                if k < len(places) and places[k] < high:
                    return int(places[k])
        return -1

    def finish(self) -> list[int]:
        """The remainder."""
        rest, self.length, self.gear = self.length, 0, 0
        return [rest] if rest else []


def cut(data: bytes, profile: Profile) -> list[int]:
    """Lengths of the chunks of a whole content; none for an empty one."""
    cutter = Cutter(profile)
    if len(data) <= SEGMENT:
        return cutter.feed(data) + cutter.finish()
    view, out = memoryview(data), []
    for k in range(0, len(data), SEGMENT):
        out += cutter.feed(view[k : k + SEGMENT])
    return out + cutter.finish()


def cut_all(contents: list[bytes], profiles: list[Profile]) -> list[list[list[int]]]:
    """For each profile what cut() gives for each content. The hashes of all contents are made once, and each step cuts the next chunk of every content that goes on; a content above SEGMENT is cut by itself."""
    long = [len(c) > SEGMENT for c in contents]
    together = [c for c, alone in zip(contents, long, strict=True) if not alone]
    data = np.frombuffer(b"".join(together), np.uint8)
    ends = np.cumsum([len(c) for c in together], dtype=np.int64)
    out = []
    with np.errstate(over="ignore"):  # hashes wrap
        h = rolling(data)
        found: dict[int, np.ndarray] = {}  # by a mask: where the masked hash is zero, and a place beyond all
        for p in profiles:
            for mask in (p.strict, p.relaxed):
                if mask not in found:
                    found[mask] = np.append(_zeros(h, np.uint64(mask)) if len(h) else np.empty(0, np.int64), np.int64(1) << 62)
            lengths = iter(_cut_together(h, ends, p, found))
            out.append([cut(c, p) if alone else next(lengths) for c, alone in zip(contents, long, strict=True)])
    return out


def _cut_together(h: np.ndarray, ends: np.ndarray, p: Profile, found: dict[int, np.ndarray]) -> list[list[int]]:
    begin = 0 if p.warm else p.minimum
    # As in Cutter: up to WINDOW - 1 places after the minimum the hash knows fewer bytes than the window.
    zone = np.arange(max(0, begin + WINDOW - 1 - p.minimum))
    shifts = (p.minimum - begin + 1 + zone).astype(np.uint64)
    masks = np.where(p.minimum + zone < p.target, np.uint64(p.strict), np.uint64(p.relaxed))
    strict_at, relaxed_at = found[p.strict], found[p.relaxed]
    which = np.flatnonzero(np.diff(ends, prepend=0))
    start, stop = np.concatenate((np.zeros(1, np.int64), ends))[which], ends[which]
    steps = []
    while len(which):
        end = np.minimum(start + p.maximum, stop)
        middle, at = np.minimum(start + p.target, end), start + p.minimum + len(zone)
        strict = strict_at[np.searchsorted(strict_at, at)]
        low = np.maximum(at, middle)
        relaxed = relaxed_at[np.searchsorted(relaxed_at, low)]
        to = np.where(strict < middle, strict, np.minimum(relaxed, end))
        if len(zone):
            hashed = start + begin
            before = np.where(hashed > 0, h[np.clip(hashed - 1, 0, len(h) - 1)], np.uint64(0))
            places = (start + p.minimum)[:, None] + zone
            values = h[np.minimum(places, len(h) - 1)] - (before[:, None] << shifts)
            hit = ((values & masks) == 0) & (places < end[:, None])
            first = hit.argmax(axis=1)
            row = np.arange(len(which))
            to = np.where(hit[row, first], places[row, first], to)
        steps.append((which, to - start))
        on = to < stop
        which, start, stop = which[on], to[on], stop[on]
    owner, size = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.empty(0, np.int64), np.empty(0, np.int64))
    order = np.argsort(owner, kind="stable")
    size, after = size[order].tolist(), np.cumsum(np.bincount(owner, minlength=len(ends))).tolist()
    return [size[a:b] for a, b in itertools.pairwise([0, *after])] if len(ends) else []


def cut_fixed(n: int, size: int) -> list[int]:
    return [min(size, n - i) for i in range(0, n, size)]


def cut_plainly(data: bytes, profile: Profile) -> list[int]:
    """The definition, byte by byte; for tests."""
    gear, out, start = gear_table().tolist(), [], 0
    while start < len(data):
        rest = len(data) - start
        length, h = min(rest, profile.maximum), 0
        for i in range(0 if profile.warm else profile.minimum, min(rest, profile.maximum)):
            h = ((h << 1) + gear[data[start + i]]) & (1 << 64) - 1
            if i >= profile.minimum and h & (profile.strict if i < profile.target else profile.relaxed) == 0:
                length = i
                break
        out.append(length)
        start += length
    return out


def spans(n: int, splices: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int]], int]:
    """Splices (start, old_end, new_end), each in the coordinates that the ones before have left, as edits (old_start, old_end, new_start, new_end) of the first and the last coordinates, in order and apart from each other; and the last length.

    What is left of the old content, stretch by stretch, is tracked through all splices; edits are what lies between.
    """
    kept: list[tuple[int | None, int]] = [(0, n)]  # (place in the old content, or None for new bytes; length)
    for start, old_end, new_end in splices:
        out, at = [], 0
        for place, size in kept:
            for low, high in ((at, min(at + size, start)), (max(at, old_end), at + size)):
                if low < high:
                    out.append((low if high <= start else low - old_end + new_end, None if place is None else place + low - at, high - low))
            at += size
        out.append((start, None, new_end - start))
        kept = [(place, size) for _, place, size in sorted(out, key=lambda x: (x[0], x[2]))]
    edits: list[tuple[int, int, int, int]] = []
    old = new = gap = 0  # ends of the last old stretch, and where the edit under way began
    for place, size in [*kept, (n, 0)]:
        if place is None:
            new += size
            continue
        if place > old or new > gap:
            edits.append((old, place, gap, new))
        old, new = place + size, new + size
        gap = new
    return edits, new


def recut_apart(data: bytes, old: list[int], splices: list[tuple[int, int, int]], profile: Profile) -> tuple[list[int], list[tuple[int, int, int]], int]:
    """(lengths, kept, bytes scanned) after splices: as cutting anew, but between edits the old chunks stay from where a cut meets an old one up to the next edit. kept: runs (first new chunk, first old chunk, chunks)."""
    ends = np.cumsum(np.array(old, np.int64)).tolist()
    edits, size = spans(ends[-1] if ends else 0, splices)
    if size != len(data):
        raise ValueError("the splices don't lead to a content of this length")
    place = {e: i for i, e in enumerate(ends)}
    out: list[int] = []
    kept: list[tuple[int, int, int]] = []
    at, chunk, scanned, k = 0, 0, 0, 0  # new position, next old chunk, bytes cut, next edit
    while True:
        # Old chunks stay that end before the next edit begins: a cut depends on the byte after it too.
        stop = bisect.bisect_left(ends, edits[k][0], chunk) if k < len(edits) else len(ends)
        if stop > chunk:
            kept.append((len(out), chunk, stop - chunk))
            out += old[chunk:stop]
            at += ends[stop - 1] - (ends[chunk - 1] if chunk else 0)
            chunk = stop
        if k == len(edits):
            return out, kept, scanned
        cutter, pos, met, base = Cutter(profile), at, False, at
        while pos < len(data) and not met:
            piece = data[pos : pos + max(4 * profile.maximum, 1 << 14)]
            for n in cutter.feed(piece):
                at += n
                out.append(n)
                while k < len(edits) and edits[k][3] <= at:
                    k += 1  # passed
                before = k - 1
                if before >= 0 and edits[before][3] <= at and (k == len(edits) or at < edits[k][2]):
                    was = at - edits[before][3] + edits[before][1]
                    if was in place and place[was] < len(ends) - 1:
                        chunk, met = place[was] + 1, True
                        break
            pos += len(piece)
        scanned += min(pos, len(data)) - base if not met else at - base
        if not met:
            return out + cutter.finish(), kept, scanned

"""Deltas of one byte string against another by suffix sorting (Percival, 2003): what nearly matches is stored as differences, the rest as it is."""

from __future__ import annotations

import bz2
import struct

import numpy as np

_MAGIC = b"delta-v1"


#: Bytes of a prefix that a key holds, nine bits a byte, so that what lies beyond the end comes before any byte.
_KEY = 7


def _keys(data: bytes) -> np.ndarray:
    """At each place the next _KEY bytes as a number that orders as they do."""
    n = len(data)
    wide = np.zeros(n + _KEY - 1, np.int64)
    wide[:n] = np.frombuffer(data, np.uint8)
    wide[:n] += 1
    out = wide[:n].copy()
    for k in range(1, _KEY):
        out <<= 9
        out |= wide[k : k + n]
    return out


def suffix_array(data: bytes, keys: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes in their order, by doubling: ranks of prefixes of _KEY, 2 * _KEY ... bytes. Only groups of equal prefixes are ordered further."""
    n = len(data)
    keys = _keys(data) if keys is None else keys
    order = np.argsort(keys)
    sorted_ = keys[order]
    #: The number of a group's first place in the order; a group of one is done.
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    first = np.flatnonzero(new)
    size = np.diff(first, append=n)
    head = np.repeat(first, size)
    rank = np.empty(n, np.int64)
    rank[order] = head
    at = np.flatnonzero(np.repeat(size, size) > 1)  # in the order, what is not done
    width = _KEY
    while len(at):
        which, group = order[at], head[at]
        after = which + width
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(group * (n + 1) + follow)
        which, follow = which[by], follow[by]  # groups stay where they are
        order[at] = which
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(begin, append=len(at))
        # A new group begins where its first member stands in the order.
        group = np.repeat(at[begin], size)
        head[at] = group
        rank[which] = group
        at = at[np.repeat(size, size) > 1]
        width *= 2
    return order


def _common(a: bytes, i: int, b: bytes, j: int, at: int = 0) -> int:
    """How many bytes from a place on agree, given that so many do."""
    most = min(len(a) - i, len(b) - j)
    step = 16
    while at < most:
        size = min(step, most - at)
        if a[i + at : i + at + size] == b[j + at : j + at + size]:
            at, step = at + size, step * 2
        elif size == 1:
            break
        else:
            step = max(1, size // 2)
    return at


class _Longest:
    """(length, place) of the longest stretch of base that target continues with from a place on: the best that halving the ordered suffixes comes by, the first in base of several.

    Which suffixes halving comes by depends on where it ends alone. Keys tell where, for many places at once, unless a suffix shares a whole key; the rest is halved in between.
    """

    def __init__(self, base: bytes, target: bytes):
        keys = _keys(base)
        self.base, self.target, self.order = base, target, suffix_array(base, keys)
        self.sorted, self.asked = keys[self.order], _keys(target)
        self.low = self.high = 0  # of the target, what is answered
        self.block = 16

    def __call__(self, at: int) -> tuple[int, int]:
        if not self.low <= at < self.high:
            self.block = min(4 * self.block, 1 << 12) if at == self.high else 64
            self.low, self.high = at, min(len(self.target), at + self.block)
            self._answer()
        k = at - self.low
        if self.begin[k] < self.end[k] and at + _KEY <= len(self.target):
            return self._halved(at, self.begin[k], self.end[k])
        return self.lengths[k], self.places[k]

    def _answer(self) -> None:
        asked, n = self.asked[self.low : self.high], len(self.order)
        begin = np.searchsorted(self.sorted, asked, "left")
        # For places whose key no suffix has, or at the target's end: the suffixes that halving comes by, step by step.
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), n)
        length, place = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        left = len(self.target) - np.arange(self.low, self.high)
        while (on := low < high).any():
            mid = np.minimum((low + high) // 2, n - 1)
            where = self.order[mid]
            differ = self.sorted[mid] ^ asked
            common = np.zeros(len(asked), np.int64)
            for k in range(_KEY):
                common += differ >> 9 * k == 0
            common = np.minimum(np.minimum(common, left), len(self.base) - where)
            better = on & ((common > length) | ((common == length) & (where < place)))
            length, place = np.where(better, common, length), np.where(better, where, place)
            up = mid < begin
            low, high = np.where(on & up, mid + 1, low), np.where(on & ~up, mid, high)
        self.lengths, self.places = length.tolist(), place.tolist()
        self.begin, self.end = begin.tolist(), np.searchsorted(self.sorted, asked, "right").tolist()

    def _halved(self, at: int, begin: int, end: int) -> tuple[int, int]:
        """The same where suffixes from begin to end share a key: any other agrees less than they do."""
        base, target, order = self.base, self.target, self.order
        low, high, best = 0, len(order), (0, 0)
        while low < high:
            mid = (low + high) // 2
            if mid < begin:
                low = mid + 1
            elif mid >= end:
                high = mid
            else:
                place = int(order[mid])
                n = _common(base, place, target, at, _KEY)
                best = max(best, (n, -place))
                if at + n == len(target) or (place + n < len(base) and base[place + n] > target[at + n]):
                    high = mid
                else:
                    low = mid + 1
        return best[0], -best[1]


def _reach(same: np.ndarray) -> int:
    """Bytes of a stretch worth taking as differences: where agreements lead disagreements by most, the shortest such."""
    if not len(same):
        return 0
    lead = np.cumsum(2 * same.astype(np.int64) - 1)
    k = int(lead.argmax())
    return k + 1 if lead[k] > 0 else 0


def make(base: bytes, target: bytes) -> bytes:
    """The delta: triples (bytes to add to base's, bytes as they are, steps in base) and both kinds of bytes, each compressed."""
    longest = _Longest(base, target)
    wide, new = np.frombuffer(base, np.uint8), np.frombuffer(target, np.uint8)
    steps, added, plain = [], [], []
    done = from_base = 0  # of the target what is covered, and where the base goes on
    at = 0
    while done < len(target):
        # The next stretch that matches clearly better than going on as before would.
        found = (len(target), 0)
        while at < len(target):
            n, place = longest(at)
            as_before = from_base + at - done
            if n and as_before >= 0 and base[as_before : as_before + n] == target[at : at + n]:
                at += n
                continue
            if n > 8:
                agree = int((wide[as_before : as_before + n] == new[at : at + n][: max(0, len(base) - as_before)]).sum()) if 0 <= as_before < len(base) else 0
                if n > agree + 8:
                    found = (at, place)
                    break
            at += 1
        begin, place = found if at < len(target) else (len(target), from_base)
        ahead = min(begin - done, len(base) - from_base)
        forward = _reach(wide[from_base : from_base + ahead] == new[done : done + ahead])
        backward = 0
        if begin < len(target):
            room = min(begin - done - forward, place)
            backward = _reach((wide[place - room : place] == new[begin - room : begin])[::-1]) if room > 0 else 0
        added.append((new[done : done + forward] - wide[from_base : from_base + forward]).tobytes())
        plain.append(target[done + forward : begin - backward])
        steps.append((forward, begin - backward - done - forward, place - backward - from_base - forward))
        done, from_base = begin - backward, place - backward
        at = max(at, done + 1)
        if begin == len(target):
            break
    parts = [bz2.compress(x) for x in (b"".join(struct.pack("<qqq", *s) for s in steps), b"".join(added), b"".join(plain))]
    return _MAGIC + struct.pack("<QQQ", len(parts[0]), len(parts[1]), len(target)) + b"".join(parts)


def restore(base: bytes, delta: bytes) -> bytes:
    if delta[:8] != _MAGIC:
        raise ValueError("no delta")
    a, b, size = struct.unpack_from("<QQQ", delta, 8)
    steps, added, plain = (bz2.decompress(x) for x in (delta[32 : 32 + a], delta[32 + a : 32 + a + b], delta[32 + a + b :]))
    wide, out, place, i, j = np.frombuffer(base, np.uint8), [], 0, 0, 0
    for forward, as_it_is, jump in struct.iter_unpack("<qqq", steps):
        out.append((np.frombuffer(added, np.uint8)[i : i + forward] + wide[place : place + forward]).tobytes())
        out.append(plain[j : j + as_it_is])
        place, i, j = place + forward + jump, i + forward, j + as_it_is
    whole = b"".join(out)
    if len(whole) != size:
        raise ValueError("the delta gives another length")
    return whole

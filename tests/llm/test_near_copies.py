"""Near copies by shingles, against brute force."""

import random

import numpy as np
import pytest
from test_llm_operators import edge_docs, least_roots

from corestrata.llm import simhash


def slow_pairs(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    by = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    out = []
    for at, a in enumerate(by):
        for b in by[at + 1 :]:
            if 4 * len(sets[b]) > 5 * len(sets[a]):
                break
            both = len(sets[a] & sets[b])
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                out.append((a, b))
    return out


def slow_kept(rows):
    roots = least_roots(len(rows), slow_pairs([t for _, t in rows]))
    best = {}
    for (i, _), r in zip(rows, roots, strict=True):
        best[r] = min(best.get(r, i), i)
    return sorted(best.values())


def test_edited_copies(spark, monkeypatch):
    """A large group of copies with edits on both sides of the bound, common passages, and texts of few words."""
    rnd = random.Random(4)
    base, shared, rows = [f"w{i}" for i in range(120)], [f"c{i}" for i in range(30)], []
    for i in range(150):
        w = list(base)
        for at in rnd.sample(range(120), rnd.randrange(6)):
            w[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(shared + [f"y{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 40))])) for i in range(60)]
    rows += [(300, "A b c"), (301, "a  B c"), (302, "a b"), (303, ""), (304, " \n"), (305, "a b c d e f"), (306, "a b c d e g")]
    rnd.shuffle(rows)
    for tile in (1024, 16):  # in one piece, and in several
        monkeypatch.setattr(simhash, "TILE", tile)
        assert sorted(r.doc_id for r in simhash.drop_near_copies(edge_docs(spark, rows)).collect()) == slow_kept(rows)
    kept = simhash.drop_near_copies(edge_docs(spark, rows))
    assert kept.columns == edge_docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == slow_kept(rows)


def test_rows_without_an_id(spark):
    rows = [(None, "one two three four five"), (None, "ONE two three four five"), (7, "six"), (None, "six"), (None, None)]
    kept = [(r.doc_id, (r.text or "").lower()) for r in simhash.drop_near_copies(edge_docs(spark, rows), broadcast_bytes=0).collect()]
    assert sorted(kept, key=str) == sorted([(None, "one two three four five"), (7, "six"), (None, "")], key=str)
    assert simhash.drop_near_copies(edge_docs(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_one_row_of_repeated_rows_stays(spark, broadcast):
    rows = [(1, "one two three four five six")] * 3 + [(2, "ONE two three four five six")] * 2 + [(3, "alone")] * 2 + [(None, "no name at all")] * 2 + [(4, "apart")]
    kept = simhash.drop_near_copies(edge_docs(spark, rows), broadcast_bytes=broadcast)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted({rows[0], (3, "alone"), (None, "no name at all"), (4, "apart")}, key=str)


def test_similar_texts_lie_within_the_radius():
    """Fingerprints of sets at the least similarity: none of 4,000 pairs lies beyond."""
    rnd = np.random.default_rng(3)
    for n in (9, 10, 45, 90, 300):
        for _ in range(800):
            a = rnd.integers(-(1 << 63), 1 << 63, n + n // 9, dtype=np.int64)
            x, y = simhash.set_fingerprint(a[:n]), simhash.set_fingerprint(a[n // 9 :])  # n - n // 9 in common
            assert bin((x ^ y) & (1 << 64) - 1).count("1") <= simhash.SIMILAR_RADIUS

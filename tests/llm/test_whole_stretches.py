import random

import numpy as np
import pyarrow as pa

from trustweave.llm import suffix_dedup


def laid_out(rows):
    """Rows of (anchor, doc, bytes) as arrays: bytes, begin, count, doc and anchor."""
    size = np.array([len(r[2]) for r in rows])
    raw = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    return raw, np.cumsum(size) - size, size - 49, np.array([r[1] for r in rows]), np.array([r[0] for r in rows], np.uint64)


def some_rows(rng, n):
    """Stretches of few kinds per anchor, of which many are equal, some in part, some in one document only."""
    made = []
    for anchor in range(n):
        core = bytes(rng.choice(b"abcd") for _ in range(50))
        kinds = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(15))) + core + bytes(rng.choice(b"ab") for _ in range(rng.choice((0, 9, 300)))) for _ in range(3)]
        made += [(anchor, rng.randrange(8), rng.choice(kinds)) for _ in range(rng.randrange(1, 9))]
    rng.shuffle(made)
    return made


def test_runs_that_go_against_brute_force(monkeypatch):
    rng = random.Random(5)
    rows = some_rows(rng, 120)
    least = {}
    for anchor, doc, b in rows:
        for k in range(len(b) - 49):
            least[anchor, b[k : k + 50]] = min(doc, least.get((anchor, b[k : k + 50]), doc))
    want = {(i, k) for i, (anchor, doc, b) in enumerate(rows) for k in range(len(b) - 49) if least[anchor, b[k : k + 50]] < doc}
    for looked, at_once in ((128, 1 << 19), (8, 1 << 19), (128, 2000)):  # with few bytes looked at, more is compared or left to be sorted
        monkeypatch.setattr(suffix_dedup, "LOOKED", looked)
        monkeypatch.setattr(suffix_dedup, "SORTED", at_once)
        of, at, many = suffix_dedup.gone_windows(*laid_out(rows))
        got = [(i, k + x) for i, k, m in zip(of.tolist(), at.tolist(), many.tolist(), strict=True) for x in range(m)]
        assert len(got) == len(set(got)) and set(got) == want
    assert all(len(x) == 0 for x in suffix_dedup.gone_windows(*(np.zeros(0, k) for k in (np.uint8, np.int64, np.int64, np.int64, np.uint64))))


def test_equal_stretches_are_not_sorted(monkeypatch):
    rng = random.Random(7)
    one, two = (bytes(rng.choice(b"abcdefgh") for _ in range(70)) for _ in range(2))
    rows = [(3, doc, one) for doc in range(400)] + [(4, doc, two) for doc in (7, 900)] + [(5, 1, one[:60]), (5, 2, one[1:61])]
    raw, _, count, doc, anchor = laid_out(rows)
    packed = suffix_dedup.pack(anchor, doc.astype(np.uint64), np.zeros(len(rows), np.uint64), count.astype(np.uint64))
    batch = suffix_dedup.rows(suffix_dedup.SENT, [0], [False], [packed], [pa.compress(raw.tobytes(), "zstd", asbytes=True)])
    sizes, pointers = [], suffix_dedup.pointers
    monkeypatch.setattr(suffix_dedup, "pointers", lambda raw, span=50: (sizes.append(len(raw)), pointers(raw, span))[1])
    found = [suffix_dedup.unpack(p) for b in suffix_dedup.sort_anchors(1)(iter([batch])) for p in b.column(1).to_pylist()]
    gone = {int(d): int(m) for f in found for d, _, m in zip(*f, strict=True)}
    assert {d: m for d, m in gone.items() if d > 2} == {**{d: 21 for d in range(3, 400)}, 900: 21}
    assert sum(sizes) <= 120  # before, all 28,260 bytes

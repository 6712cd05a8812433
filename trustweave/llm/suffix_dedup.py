"""Exact removal of long repeated byte strings, by bucket-pointer refinement spread over the cluster.

Which ``span``-byte strings (windows) of a document also begin in a document with a smaller id is settled as in a suffix
array built by bucket-pointer refinement (Schürmann and Stoye, 2007), cut off at depth ``span``: suffixes are sorted into
buckets by their first q bytes and get a pointer, the number of their bucket's last place in the array; a bucket of
several is refined by sorting on the pointers at a later offset, which are those that the last step has refined, until
the depth is reached (:func:`pointers`). Pointers are places, not hashes, so equal ones mean equal bytes.

Sorting all suffixes of a corpus together would move each byte many times, so buckets that can't hold a repeat are left
out first, and the others are sorted apart:

1. Of the q-grams in a window, the one with the least hash is the window's anchor; equal windows have equal anchors, and
   successive windows with one form a stretch of some 18 windows (of all of them, where a text repeats a short phrase).
   Anchors that only one document has are settled.
2. The bytes of the other stretches are settled in each batch by itself, so that a frequent stretch is sent once per
   batch. What is left goes to the task of its anchor. Both times, stretches that equal one of a smaller document byte by
   byte go first; the rest is sorted with all others of its anchor, and windows with one pointer go but for those of the
   least document.

What travels is packed columns. Documents are read again, shuffled once, to send stretches and to cut the bytes out. A
task sorts some anchors' stretches at a time; those of one anchor stay together, so an anchor with many different
surroundings costs its task some 200 bytes for each batch that holds it.

Edge cases: null texts count as empty; texts shorter than ``span`` bytes keep everything; a window repeated within its
own document only stays; rows that repeat a document id count as one document for comparison and are returned each; null
ids are returned unchanged; an empty table gives an empty result; ids are cast to long; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.llm.common import partitions, slices, stored, total_bytes
from trustweave.llm.winnowing import gram_hashes, mix

SPAN, Q = 50, 16
#: Bytes of text in a batch, which must be fewer than MOST, and of one part of a longer text.
BATCH, PART = (2 << 20) - 1024, 1 << 20
#: Anchors of all batches so far that a task sends at once, bytes of stretches that it sorts at once, the most that it can sort
#: fast, and the most bytes of one anchor that it sorts together.
FLUSH, SORTED, MOST, ONE = 400_000, 1 << 19, (2 << 20) - 512, 6 << 20
#: Bytes of a stretch whose hash tells which others it is compared with.
LOOKED = 128


def first_words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts like them; bytes beyond the end count as 0."""
    w = np.zeros(len(raw) + 8, np.uint64)
    w[: len(raw)] = raw
    for size in (1, 2, 4):
        w[:-size] = (w[:-size] << np.uint64(8 * size)) | w[size:]
        w[-size:] <<= np.uint64(8 * size)
    return w[: len(raw)]


def pointers(raw: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Bucket pointers of all suffixes at depth ``span``: two are equal just if the ``span`` bytes are (zeros follow the end).

    Up to ``MOST`` bytes, a sort key and its place share 64 bits, as sorting numbers is much faster than sorting places.
    """
    n = len(raw)
    bits = (n + span).bit_length()
    packed = bits <= 21
    low, shift, depth = np.uint64((1 << bits) - 1), np.uint64(bits if packed else 32), 5 if packed else 8

    def in_order(key: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if packed:
            key = (key << shift) | places.astype(np.uint64)
            key.sort()
            return key >> shift, (key & low).astype(np.int64)
        order = np.argsort(key)
        return key[order], places[order]

    key, order = in_order(first_words(raw) >> np.uint64(64 - 8 * depth), np.arange(n))
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if n else np.zeros(0, np.int64)
    size = np.diff(last, prepend=-1)
    pointer = np.zeros(n + span, np.uint64)  # of last places plus one; 0 beyond the end
    pointer[order] = np.repeat(last + 1, size).astype(np.uint64)
    held = order[np.repeat(size > 1, size)]  # suffixes in buckets of several, in the order of the array
    while depth < span and len(held):
        step = min(depth, span - depth)
        # By bucket, then by the pointer at the later offset: each bucket keeps its own places.
        key, held = in_order((pointer[held] << shift) | pointer[held + step], held)
        bucket = (key >> shift).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        many = np.diff(np.append(first, len(held)))
        # The i-th suffix of a bucket of n whose pointer is p stands at place p - n + i.
        end = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        size = np.diff(end, prepend=-1)
        at = np.searchsorted(first, end, side="right") - 1
        pointer[held] = np.repeat((bucket[end] - many[at] + end - first[at] + 1).astype(np.uint64), size)
        held = held[np.repeat(size > 1, size)]
        depth += step
    return pointer[:n].astype(np.int64) - 1


def repeats(pointer: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of these windows, by their pointers, also begin in a smaller document."""
    least = np.full(int(pointer.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, pointer, doc)
    return doc > least[pointer]


@dataclass
class Stretches:
    """Windows with one anchor, in page order: text, its number there, first and last window (in that text), and anchor."""

    of: np.ndarray
    ordinal: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    raw: np.ndarray
    #: Start of each text in the batch.
    starts: np.ndarray


def stretches(texts: list[bytes]) -> Stretches:
    gap = bytes(SPAN)
    raw = np.frombuffer(gap.join(texts) + gap, np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(n + SPAN)[:-1]])
    grams = gram_hashes(raw, Q)
    low, size, width = grams, 1, SPAN - Q + 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    count = np.maximum(0, n - SPAN + 1)
    total = int(count.sum())
    at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(total)
    of = np.repeat(np.arange(len(texts)), count)
    chosen = low[at]
    new = np.ones(total, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], total) - 1 if total else begin
    of, first, last = of[begin], at[begin], at[end]
    per_text = np.bincount(of, minlength=len(texts))
    ordinal = np.arange(len(of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return Stretches(of, ordinal, first - starts[of], last - starts[of], mix(chosen[begin]), raw, starts)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, ``count`` numbers for each."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def numbered(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Equal numbers for the windows at these places just if their bytes are equal."""
    if len(raw) <= ONE:
        return pointers(raw)[at]
    # One anchor with more surroundings than can be sorted at once: windows go by their first bytes, in parts that are
    # sorted by themselves, each with its own numbers; equal windows are in one part.
    words = first_words(raw)[at]
    parts = mix(words) % np.uint64(len(at) * SPAN // MOST + 1)
    made = np.zeros(len(at), np.int64)
    done = 0
    for k in np.unique(parts).tolist():
        which = np.flatnonzero(parts == k)
        if len(which) * SPAN <= MOST:
            made[which] = done + pointers(raw[(at[which, None] + np.arange(SPAN)).ravel()])[np.arange(len(which)) * SPAN]
        else:  # many equal beginnings
            made[which] = done + np.unique(raw[at[which, None] + np.arange(SPAN)], axis=0, return_inverse=True)[1].ravel()
        done += len(which) * SPAN
    return made


def whole_repeats(raw: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Stretches that equal, byte by byte, one of a smaller document among those that are not returned.

    Hashes only say which to compare; what they miss is left to be sorted.
    """
    size = count + SPAN - 1
    words = np.ndarray(max(0, len(raw) - 7), np.uint64, np.ascontiguousarray(raw), strides=(1,))
    steps = range(0, min(int(size.max(initial=0)), LOOKED), 8)
    key = mix(anchor ^ mix(count.astype(np.uint64)))
    for at in steps:
        key = mix(key ^ words[begin + np.minimum(at, size - 8)])
    order = np.lexsort((doc, key))
    new = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    maybe = (doc[order] > doc[lead]) & (count[order] == count[lead])
    found, lead = order[maybe], lead[maybe]
    for at in steps:
        further = np.minimum(at, size[found] - 8)
        same = words[begin[found] + further] == words[begin[lead] + further]
        found, lead = found[same], lead[same]
    same = np.ones(len(found), bool)
    for k in np.flatnonzero(size[found] > LOOKED).tolist():
        a, b, n = begin[found[k]], begin[lead[k]], size[found[k]]
        same[k] = raw[a : a + n].tobytes() == raw[b : b + n].tobytes()
    return found[same]


def gone_windows(raw: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches of ``count`` windows from ``begin`` on, the runs that repeat a smaller document: stretch, first window (in it) and how many.

    Stretches that as a whole equal one of a smaller document go without being sorted, and so stay those whose anchor no
    other document has among the rest. All stretches of one anchor are sorted together.
    """
    whole = whole_repeats(raw, begin, count, doc, anchor)
    rest = np.delete(np.arange(len(begin)), whole)
    rest = rest[np.argsort(anchor[rest], kind="stable")]
    first = np.flatnonzero(np.append(True, anchor[rest][1:] != anchor[rest][:-1])[: len(rest)])
    many = np.diff(np.append(first, len(rest)))
    if len(rest):
        rest = rest[np.repeat(np.minimum.reduceat(doc[rest], first) < np.maximum.reduceat(doc[rest], first), many)]
    made = [(whole, np.zeros(len(whole), np.int64), count[whole])]
    if len(rest):
        size = count + SPAN - 1
        new = np.append(True, anchor[rest][1:] != anchor[rest][:-1])
        # Anchors are taken together until they have enough bytes.
        part = np.cumsum(size[rest]) // SORTED
        part = part[np.flatnonzero(new)][np.cumsum(new) - 1]
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(rest)).tolist()
        for which in (rest[a:b] for a, b in zip(edges, edges[1:], strict=False)):
            start = np.cumsum(size[which]) - size[which]
            at, of = spread(start, count[which]), np.repeat(np.arange(len(which)), count[which])
            gone = np.flatnonzero(repeats(numbered(raw[spread(begin[which], size[which])], at), doc[which][of]))
            if len(gone):
                of, at = of[gone], (at - start[of])[gone]
                run = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)))
                made.append((which[of[run]], at[run], np.diff(np.append(run, len(of)))))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


#: Packed columns on the way to an anchor's task (with the bytes of stretches, or none), or, if known, home.
SENT = "target int, known boolean, packed binary, bytes binary"
#: Numbers on the way to their documents' task, and one row for each document.
FOUND = "home int, packed binary"
GATHERED = "doc long, a array<long>, b array<long>"


def pack(*columns: np.ndarray) -> bytes:
    """Numbers of 64 bits each, in as few bytes as the largest needs above the least."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        base = int(c.min())
        c = (c.astype(np.uint64) - np.uint64(base & (2**64 - 1))) if len(c) else c
        width = max(1, (int(c.max()).bit_length() + 7) // 8)
        parts += [(base & (2**64 - 1)).to_bytes(8, "little"), bytes([width]), np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return b"".join(parts)


def unpack(packed: bytes) -> list[np.ndarray]:
    n, at, made = int.from_bytes(packed[:8], "little"), 8, []
    while at < len(packed):
        base, width = int.from_bytes(packed[at : at + 8], "little"), packed[at + 8]
        at += 9
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(packed, np.uint8, n * width, at).reshape(width, n).T
        made.append(wide.view(np.uint64).reshape(n) + np.uint64(base))
        at += n * width
    return made


def dealt(target: np.ndarray, n: int, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Targets in use, and the columns packed for each."""
    order = np.argsort(target, kind="stable")
    edges = np.searchsorted(target[order], np.arange(n + 1)).tolist()
    columns = tuple(c[order].view(np.uint64) for c in columns)
    used = [t for t in range(n) if edges[t] < edges[t + 1]]
    return used, [pack(*(c[edges[t] : edges[t + 1]] for c in columns)) for t in used]


def home_of(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def rows(schema: str, *columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def find_shared(n: int):
    """The task of some targets: numbers of the stretches whose anchor stands in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            target, known, packed, _ = (c.to_pylist() for c in batch.columns)
            yield rows(FOUND, [t for t, k in zip(target, known, strict=True) if k], [p for p, k in zip(packed, known, strict=True) if k])
            for t, k, p in zip(target, known, packed, strict=True):
                if not k:
                    parts.setdefault(t, []).append(p)
        for some in parts.values():
            columns = [unpack(p) for p in some]
            anchor, doc, number = (np.concatenate([c[k] for c in columns]) for k in range(3))
            order = np.argsort(anchor)
            anchor, doc, number = anchor[order], doc[order].view(np.int64), number[order].view(np.int64)
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            many = np.diff(np.append(first, len(anchor)))
            several = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), many)
            if several.any():
                yield rows(FOUND, *dealt(home_of(doc[several], n), n, doc[several], number[several]))

    return run


def sort_anchors(n: int):
    """The task of some targets: sorts the stretches of some anchors at a time, and returns the runs that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            target, known, packed, held = (c.to_pylist() for c in batch.columns)
            yield rows(FOUND, [t for t, k in zip(target, known, strict=True) if k], [p for p, k in zip(packed, known, strict=True) if k])
            for t, k, p, b in zip(target, known, packed, held, strict=True):
                if not k:
                    parts.setdefault(t, []).append((p, b))
        for some in parts.values():
            columns = [unpack(p) for p, _ in some]
            anchor, doc, start, count = (np.concatenate([c[k] for c in columns]) for k in range(4))
            doc, start, count = doc.view(np.int64), start.view(np.int64), count.astype(np.int64)
            raw = np.frombuffer(b"".join(pa.decompress(b, int(c[3].sum()) + len(c[3]) * (SPAN - 1), "zstd", asbytes=True) for (_, b), c in zip(some, columns, strict=True)), np.uint8)
            size = count + SPAN - 1
            begin = np.cumsum(size) - size
            of, at, many = gone_windows(raw, begin, count, doc, anchor)
            if len(of):
                yield rows(FOUND, *dealt(home_of(doc[of], n), n, doc[of], start[of] + at, many))

    return run


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers that have come home: one row for each document."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held += [unpack(p) for p in batch.column(1).to_pylist()]
    if held:
        doc, a = (np.concatenate([h[k] for h in held]).view(np.int64) for k in (0, 1))
        b = np.concatenate([h[2] if len(h) > 2 else np.zeros(len(h[0]), np.uint64) for h in held]).view(np.int64)
        order = np.lexsort((a, doc))
        doc, a, b = doc[order], a[order], b[order]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        edges = pa.array(np.append(first, len(doc)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.ListArray.from_arrays(edges, pa.array(a)), pa.ListArray.from_arrays(edges, pa.array(b))], names=["doc", "a", "b"])


def repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """``df``'s id (as doc) and text with the runs of windows that go: where each begins (a), and how many follow one another (b).

    Anchors go by the last ``bits`` of their hash; fewer of them change the work, not the result.
    """
    mask = np.uint64((1 << bits) - 1)
    docs = df.select(df[id_col].cast("long").alias("doc"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    n = max(partitions(df.sparkSession), total_bytes(docs, "text") // (8 << 20) + 1)

    def texts_of(batch: pa.RecordBatch) -> list[bytes]:
        return [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            anchor, doc, number = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            used, packed = dealt((anchor % np.uint64(n)).astype(np.int32), n, anchor >> np.uint64(32), doc, number)
            return rows(SENT, used, [False] * len(used), packed, [None] * len(used))

        for batch in slices(batches, "text", BATCH):
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for g in groups(texts_of(batch)):
                s = g.found
                held.append([s.anchor & mask, ids[g.owner[s.of]], g.before[s.of] + s.ordinal])
            if sum(len(h[0]) for h in held) > FLUSH:
                yield flush()
        if sum(len(h[0]) for h in held):
            yield flush()

    def send_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            """Sort what is held; send home what goes by that, and the stretches with anything left to their anchors."""
            if not held:
                return
            size = np.fromiter((len(h[4]) for h in held), np.int64, len(held))
            shift = np.repeat(np.cumsum(size) - size, [len(h[0]) for h in held])
            anchor, doc, start, count, begin = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2, 3, 5))
            raw, begin = np.concatenate([h[4] for h in held]), begin + shift
            held.clear()
            of, at, many = gone_windows(raw, begin, count, doc, anchor)
            if len(of):
                used, packed = dealt(home_of(doc[of], n), n, doc[of], start[of] + at, many)
                yield rows(SENT, used, [True] * len(used), packed, [None] * len(used))
            left = np.flatnonzero(np.bincount(of, many, minlength=len(doc)) < count)
            target = (anchor[left] % np.uint64(n)).astype(np.int32)
            order = np.argsort(target, kind="stable")
            left, target = left[order], target[order]
            used, packed = dealt(target, n, anchor[left] >> np.uint64(24), doc[left], start[left], count[left])
            edges = np.searchsorted(target, [*used, n]).tolist()
            some = [raw[spread(begin[x], count[x] + SPAN - 1)].tobytes() for x in (left[a:b] for a, b in zip(edges, edges[1:], strict=False))]
            yield rows(SENT, used, [False] * len(used), packed, [pa.compress(b, "zstd", asbytes=True) for b in some])

        for batch in slices(batches, "text", BATCH):
            batch = batch.filter(batch.column(2).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = [np.unique(np.array(x, np.int64)) for x in batch.column(2).to_pylist()]
            for g in groups(texts_of(batch)):
                s = g.found
                edges = np.searchsorted(s.of, np.arange(len(g.owner) + 1)).tolist()
                k = [np.zeros(0, np.int64)]
                for i, a, b, before in zip(g.owner.tolist(), edges, edges[1:], g.before.tolist(), strict=False):
                    low, high = np.searchsorted(wanted[i], (before, before + b - a))
                    k.append(a + wanted[i][low:high] - before)
                k = np.concatenate(k)
                if not len(k):
                    continue
                begin, count = s.starts[s.of[k]] + s.first[k], s.last[k] - s.first[k] + 1
                # Neighbouring stretches overlap; their bytes are held once.
                end = begin + count + SPAN - 1
                new = np.append(True, begin[1:] > end[:-1])
                first = np.flatnonzero(new)
                low, high = begin[first], end[np.append(first[1:], len(k)) - 1]
                size = high - low
                raw = s.raw[spread(low, size)]
                moved = begin - np.repeat(low - (np.cumsum(size) - size), np.diff(np.append(first, len(k))))
                if sum(len(h[4]) for h in held) + len(raw) > MOST:
                    yield from flush()
                held.append((s.anchor[k] & mask, ids[g.owner[s.of[k]]], g.base[s.of[k]] + s.first[k], count, raw, moved))
            if sum(len(h[4]) for h in held) > SORTED:
                yield from flush()
        if held:
            yield from flush()

    def home(sent: DataFrame, task) -> DataFrame:
        return sent.repartition(n, "target").mapInArrow(task, FOUND).repartition(n, "home").mapInArrow(gather, GATHERED)

    shared = stored(home(docs.mapInArrow(send_anchors, SENT), find_shared(n)))
    again = docs.join(shared.select("doc", F.col("a").alias("numbers")), "doc", "left").select("doc", "text", "numbers")
    found = home(again.mapInArrow(send_bytes, SENT), sort_anchors(n))
    return docs.join(found, "doc", "left")


@dataclass
class Group:
    """Stretches of some parts of texts: each part's text, where it begins there and how many stretches lie before."""

    found: Stretches
    owner: np.ndarray
    base: np.ndarray
    before: np.ndarray


def groups(texts: list[bytes]) -> Iterator[Group]:
    """All stretches of the texts, in groups of bounded size.

    Longer texts are taken in parts that overlap by ``span`` - 1 bytes. Anchors depend on a window's bytes alone, so a stretch that a
    part's end divides is two with one anchor.
    """
    some: list[bytes] = []
    owner: list[int] = []
    base: list[int] = []
    held, seen = 0, np.zeros(len(texts), np.int64)

    def group() -> Group:
        s, o = stretches(some), np.array(owner)
        count = np.bincount(s.of, minlength=len(some))
        before = np.zeros(len(some), np.int64)
        for k, i in enumerate(owner):
            before[k] = seen[i]
            seen[i] += count[k]
        return Group(s, o, np.array(base), before)

    for i, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - SPAN + 1), PART):
            part = text[begin : begin + PART + SPAN - 1]
            if some and held + len(part) + SPAN > BATCH:
                yield group()
                some, owner, base, held = [], [], [], 0
            some.append(part)
            owner.append(i)
            base.append(begin)
            held += len(part) + SPAN
    if some:
        yield group()


def gone_ranges(begin: list[int] | None, count: list[int] | None) -> np.ndarray:
    """Maximal runs of bytes that go, as rows (start, end)."""
    if not begin:
        return np.zeros((0, 2), np.int64)
    begin = np.array(begin, np.int64)
    end = begin + np.array(count, np.int64) + SPAN - 1
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    return np.stack([begin[first], end[np.append(first[1:], len(begin)) - 1]], axis=1)


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Per row: ``id_col``, n_bytes, spans (maximal removed runs of bytes: start, length) and kept, the bytes left."""
    marked = repeated_bytes(df, id_col, text_col, bits).select("doc", "text", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_bytes, spans, kept = [], [], []
            for text, begin, count in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                ranges = gone_ranges(begin, count).tolist()
                n_bytes.append(len(raw))
                spans.append([{"start": a, "length": b - a} for a, b in ranges])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in ranges]], [*[b for b, _ in ranges], len(raw)], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "spans", "kept"])

    return marked.mapInArrow(run, "doc long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary").withColumnRenamed("doc", id_col)


def summary(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of :func:`cut_repeats`: ``id_col``, n_bytes, n_removed, n_spans and kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return cut.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

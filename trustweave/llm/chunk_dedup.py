"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut after each byte where the gear hash of the last 8 bytes is small, so that an insertion
moves the cuts around it only. Of cuts closer than ``min_chunk`` to the one before, only the first counts, which again
depends on nearby bytes alone. Each chunk is taken with the two after it, some 30 bytes, and such a block is a repeat if
one of equal digest begins earlier in the corpus (by document id, then position): chunks this small resist shifts and
find short repeats, blocks keep single words from being matches. Repeats of one document that advance together with one
keeper, overlapping, make a run. Runs are held against the keeper's bytes: the run itself by its SHA-256, then up to
``reach`` bytes on either side, as far as they agree. Spans of at least ``min_span`` bytes are reported, and whole
texts of fewer bytes that equal a whole earlier text; each stands as a whole in its keeper. Spans of one
keeper that overlap there too are one, and a span inside another one is left out.

Each task settles repeats among its own texts first and sends on only the first of each digest, so a frequent block
arrives at its partition once per task's batch, whatever the number of documents that hold it. What travels is packed
numbers; texts are shuffled once, to answer what bytes stand around a run. A document that many others repeat answers in
several tasks.

Edge cases: null and empty texts have no chunks, and rows with a null id are not read; a run without cuts is cut every
``max_chunk`` bytes; rows that repeat a document id count as that document (of different texts, spans are those of the
least); a document may repeat itself; spans never split a character; an empty table gives an empty result; ids are cast
to long; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.llm.common import dropped, join_hot, partitions, slices, small, stored, total_bytes
from trustweave.llm.suffix_dedup import dealt, home_of, unpack
from trustweave.llm.winnowing import mix

WINDOW = 8
#: A number for each byte, from a fixed rule: of 32 bits for cuts, of 64 bits for digests.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint32)
WIDE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint64)
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
#: Chunks in a block, bytes of text in a batch, rows that a task settles at once, and requests that a document answers in one task.
BLOCK, BATCH, FLUSH, ASKED = 3, 2 << 20, 400_000, 5000


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """Gear hash, modulo 2^32, at every byte: bytes before the last 8 have been shifted out."""
    h, size = GEAR[raw], 1
    while size < WINDOW:
        moved = np.zeros_like(h)
        moved[size:] = h[:-size] << np.uint32(4 * size)
        h = h + moved
        size *= 2
    return h


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, where each begins there, and their lengths."""
    pad = bytes(WINDOW)
    raw = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return raw, WINDOW + np.concatenate([[0], np.cumsum(n + WINDOW)[:-1]]), n


def chunk_ends(texts: list[bytes], average: int, min_chunk: int, max_chunk: int) -> list[np.ndarray]:
    """Where the chunks of each text end."""
    if not texts:
        return []
    raw, start, n = laid_out(texts)
    low = gear_hashes(raw)[:-1] < np.uint32(2**32 // average)
    cuts = np.flatnonzero(low & ((raw[1:] & 0xC0) != 0x80)) + 1
    of = np.searchsorted(start, cuts, side="right") - 1
    inside = (of >= 0) & (cuts <= (start + n)[of])
    cuts, of = cuts[inside], of[inside]
    near = np.zeros(len(cuts), bool)
    near[1:] = (cuts[1:] - cuts[:-1] < min_chunk) & (of[1:] == of[:-1])
    cuts, of = cuts[~near], of[~near]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).tolist()
    made = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        ends = cuts[a:b] - start[i]
        if n[i] and (not len(ends) or ends[-1] != n[i]):
            ends = np.append(ends, n[i])
        if len(ends) and np.diff(ends, prepend=0).max() > max_chunk:
            ends = _with_forced(texts[i], ends.tolist(), max_chunk)
        made.append(ends)
    return made


def _with_forced(text: bytes, ends: list[int], max_chunk: int) -> np.ndarray:
    out, at = [], 0
    for end in ends:
        while end - at > max_chunk:
            at += max_chunk
            while at < end and text[at] & 0xC0 == 0x80:
                at += 1
            out.append(at)
        if end > at:
            out.append(end)
        at = end
    return np.array(out, np.int64)


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    ones = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
    return ones(BASE), ones(INVERSE)


def blocks(texts: list[bytes], average: int, min_chunk: int, max_chunk: int, min_span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and digest of every block; a text of fewer chunks, or of fewer bytes than ``min_span``, is one."""
    raw, begin, n = laid_out(texts)
    ends = chunk_ends(texts, average, min_chunk, max_chunk)
    count = np.fromiter(map(len, ends), np.int64, len(ends))
    end = np.concatenate(ends) if count.sum() else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = np.concatenate([[0], end[:-1]]) * (at > 0) if len(end) else end
    short = (n < min_span) | (count < BLOCK)
    first = np.flatnonzero(~short[of] & (at + BLOCK <= count[of]))
    whole = np.flatnonzero(short & (n > 0))
    of = np.concatenate([of[first], whole])
    start, end = np.concatenate([start[first], np.zeros(len(whole), np.int64)]), np.concatenate([end[first + BLOCK - 1], n[whole]])
    up, down = _powers(1 << (len(raw) - 1).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(WIDE[raw] * down[: len(raw)])])
    a, b = begin[of] + start, begin[of] + end
    shape = (end - start).astype(np.uint64) + (n[of] < min_span).astype(np.uint64) * np.uint64(1 << 40)
    return of, start, end, mix(mix((sums[b] - sums[a]) * up[a]) + shape * np.uint64(BASE))


def _first_of(digest: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by digest, document and position, and for each place in it where its digest's first row is."""
    order = np.lexsort((start, doc, digest))
    d = digest[order]
    new = np.ones(len(d), bool)
    new[1:] = d[1:] != d[:-1]
    return order, np.flatnonzero(new)[np.cumsum(new) - 1] if len(d) else np.zeros(0, np.int64)


#: Packed columns on their way to a digest's task or, where the keeper is known, home to their document's.
SENT = "target int, known boolean, packed binary"
HOME = "home int, packed binary"
RUN = "doc long, start long, length long, keep_doc long, keep_start long, blocks int"


def _settled(digest: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, n: int) -> tuple[tuple, tuple[list[int], list[bytes]]]:
    """The first row of each digest, and the other rows with their keepers, packed by home."""
    order, first = _first_of(digest, doc, start)
    digest, doc, start, length = (x[order] for x in (digest, doc, start, length))
    again = (doc != doc[first]) | (start != start[first])
    lead = first == np.arange(len(first))
    home = dealt(home_of(doc[again], n), n, doc[again], start[again], length[again], doc[first][again], start[first][again])
    return tuple(x[lead] for x in (digest, doc, start, length)), home


def _packed(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _runs(doc: np.ndarray, start: np.ndarray, length: np.ndarray, keep_doc: np.ndarray, keep_start: np.ndarray) -> pa.RecordBatch:
    """Blocks that overlap and advance together with one keeper, as one row each."""
    shift = start - keep_start
    order = np.lexsort((start, shift, keep_doc, doc))
    doc, start, length, keep_doc, keep_start, shift = (x[order] for x in (doc, start, length, keep_doc, keep_start, shift))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keep_doc[1:] != keep_doc[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > (start + length)[:-1])
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(start + length, first)
    columns = (doc[first], start[first], end - start[first], keep_doc[first], keep_start[first], np.diff(np.append(first, len(doc))).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in RUN.split(", ")])


def runs(docs: DataFrame, n: int, average: int, min_chunk: int, max_chunk: int, min_span: int, bits: int) -> DataFrame:
    """Runs of blocks whose digests stand earlier, by (doc, text)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            (digest, *rest), (home, packed) = _settled(*(np.concatenate([h[k] for h in held]) for k in range(4)), n)
            held.clear()
            yield _packed(SENT, home, [True] * len(home), packed)
            target = (digest % np.uint64(n)).astype(np.int32)
            used, packed = dealt(target, n, digest >> np.uint64(24), *rest)
            yield _packed(SENT, used, [False] * len(used), packed)

        for batch in slices(batches, "text", BATCH):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            of, start, end, digest = blocks(texts, average, min_chunk, max_chunk, min_span)
            held.append((digest >> np.uint64(64 - bits) if bits < 64 else digest, batch.column(0).to_numpy(zero_copy_only=False)[of], start, end - start))
            if sum(len(h[0]) for h in held) > FLUSH:
                yield from flush()
        if sum(len(h[0]) for h in held):
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            target, known, packed = (c.to_pylist() for c in batch.columns)
            yield _packed(HOME, *zip(*[(t, p) for t, k, p in zip(target, known, packed, strict=True) if k], strict=True)) if any(known) else _packed(HOME, [], [])
            for t, k, p in zip(target, known, packed, strict=True):
                if not k:
                    parts.setdefault(t, []).append(p)
        for some in parts.values():
            columns = [unpack(p) for p in some]
            digest, doc, start, length = (np.concatenate([c[k] for c in columns]) for k in range(4))
            _, (home, packed) = _settled(digest, doc.view(np.int64), start.view(np.int64), length.view(np.int64), n)
            yield _packed(HOME, home, packed)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for home, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(home, []).append(packed)
        for some in parts.values():
            columns = [unpack(p) for p in some]
            yield _runs(*(np.concatenate([c[k] for c in columns]).view(np.int64) for k in range(5)))

    sent = docs.mapInArrow(send, SENT).repartition(n, "target").mapInArrow(settle, HOME)
    return sent.repartition(n, "home").mapInArrow(gather, RUN)


SPANS = "doc long, start long, length long, blocks int, keep_doc long, keep_start long"
AROUND = "doc long, start long, length long, blocks int, keep_doc long, keep_start long, n long, size long, digest binary, before binary, after binary"


def surroundings(docs: DataFrame, places: DataFrame, n: int, reach: int) -> DataFrame:
    """The places (all columns of AROUND up to n) with the text's size, the digest of their bytes, and those on either side."""
    busy = small(stored(places.groupBy("doc").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("tasks")).where("tasks > 1")))
    tasks = F.coalesce("tasks", F.lit(1))
    names = places.columns
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in places.dtypes[3:]]
    texts = docs.join(busy, "doc", "left").select(
        "doc", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), *nothing, "text"
    )
    asked = places.join(busy, "doc", "left").select("doc", F.pmod(F.xxhash64("start", "length"), tasks).cast("int").alias("task"), *names[1:], F.lit(None).cast("string").alias("text"))
    both = texts.union(asked).repartition(n, "doc", "task").sortWithinPartitions("doc", "task", "start", "text")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw = None, b""
        for batch in slices(batches, "text"):
            at: list[int] = []
            made: list[tuple] = []
            for row, (doc, task, start, length, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "task", "start", "length", "text")), strict=True)):
                if start < 0:
                    if now != (doc, task):
                        now, raw = (doc, task), text.encode("utf-8", "surrogatepass")
                else:
                    end = start + length
                    at.append(row)
                    made.append((len(raw), hashlib.sha256(raw[start:end]).digest(), raw[max(0, start - reach) : start], raw[end : end + reach]))
            columns = list(zip(*made, strict=True)) or [()] * 4
            kinds = [pa.int64(), *[pa.binary()] * 3]
            same = batch.select(names).take(pa.array(at, pa.int64())).columns
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[f.split()[0] for f in AROUND.split(", ")])

    return both.mapInArrow(answer, AROUND)


def _agree(a: bytes, b: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def grown(own: tuple[bytes, bytes], keep: tuple[bytes, bytes]) -> tuple[int, int]:
    """How many bytes a run grows to the left and right, in whole characters."""
    left, right = _agree(own[0][::-1], keep[0][::-1]), _agree(own[1], keep[1])
    while left and own[0][-left] & 0xC0 == 0x80:
        left -= 1
    while right and right < len(own[1]) and own[1][right] & 0xC0 == 0x80:
        right -= 1
    while right == len(own[1]) and right and own[1][-1] & 0x80:  # the reach may end within a character
        right -= 1
    return left, right


def repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = 4, min_chunk: int = 4, max_chunk: int = 1024, min_span: int = 64, reach: int = 64, bits: int = 64
) -> DataFrame:
    """Spans of bytes that stand earlier as a whole: ``id_col``, start, length, blocks, keep_doc_id and keep_start.

    Digests have ``bits`` bits; what collides is told apart by its bytes, but of blocks that do, only the first is a keeper.
    """
    docs = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(df[id_col].cast("long").alias("doc"), df[text_col].cast("string").alias("text"))
    n = max(partitions(df.sparkSession), total_bytes(docs, "text") // (8 << 20) + 1)
    found = stored(runs(docs, n, average, min_chunk, max_chunk, min_span, bits))
    keepers = stored(found.groupBy(F.col("keep_doc").alias("doc"), F.col("keep_start").alias("start"), "length").agg(F.count("*").alias("n")))
    # What a run needs to know of its own document and of its keeper's is asked in one pass; a run's place has a keeper.
    none = [F.lit(None).cast(kind) for kind in ("int", "long", "long")]
    asked = found.select("doc", "start", "length", "blocks", "keep_doc", "keep_start", F.lit(None).cast("long").alias("n"))
    places = asked.union(keepers.select("doc", "start", "length", *none, "n"))
    around = stored(surroundings(docs, places, n, reach))
    dropped(found, keepers)
    own = around.where("n is null").drop("n")
    keep = around.where("n is not null").select(
        F.col("doc").alias("keep_doc"), F.col("start").alias("keep_start"), "length", "n", *[F.col(c).alias(f"keep_{c}") for c in ("size", "digest", "before", "after")]
    )
    both = join_hot(own, keep, ["keep_doc", "keep_start", "length"], "n")
    columns = ("doc", "start", "length", "blocks", "keep_doc", "keep_start", "size", "before", "after", "keep_size", "keep_before", "keep_after")

    def rows(made: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in SPANS.split(", ")])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for doc, start, length, times, keep_doc, keep_start, size, before, after, keep_size, keep_before, keep_after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right = grown((before, after), (keep_before, keep_after))
                if left + length + right >= min_span or left + length + right == size == keep_size:
                    made.append((doc, start - left, left + length + right, times, keep_doc, keep_start - left))
            yield rows(made)

    same = both.where("digest = keep_digest").select(*columns).mapInArrow(grow, SPANS).repartition(n, "doc").sortWithinPartitions("doc")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> list[tuple]:
            one: list[list] = []  # what overlaps in the document and in its keeper alike stands there as a whole too
            for row in sorted(held, key=lambda r: (r[4], r[1] - r[5], r[1])):
                last = one[-1] if one else None
                if last and last[4] == row[4] and last[1] - last[5] == row[1] - row[5] and row[1] <= last[1] + last[2]:
                    last[2] = max(last[2], row[1] + row[2] - last[1])
                    last[3] += row[3]
                else:
                    one.append(list(row))
            kept, end = [], -1
            for row in sorted(one, key=lambda r: (r[1], -r[2], r[4], r[5])):
                if row[1] + row[2] > end:
                    end = row[1] + row[2]
                    kept.append(tuple(row))
            held.clear()
            return kept

        for batch in batches:
            made: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    made += close()
                held.append(row)
            yield rows(made)
        if held:
            yield rows(close())

    made = same.mapInArrow(spans, SPANS)
    return made.select(F.col("doc").alias(id_col), "start", "length", "blocks", F.col("keep_doc").alias("keep_doc_id"), "keep_start")


def remove_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the spans of :func:`repeated_spans`, which may overlap, cut out of its texts."""
    per_doc = spans.groupBy(F.col(id_col).alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_spans"))
    names = df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = []
            for text, lost in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if lost and text is not None:
                    raw, parts, done = text.encode("utf-8", "surrogatepass"), [], 0
                    for s in lost:
                        parts.append(raw[done : s["start"]])
                        done = max(done, s["start"] + s["length"])
                    text = b"".join([*parts, raw[done:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.join(per_doc, df[id_col] == F.col("_doc"), "left").drop("_doc").mapInArrow(run, df.schema)

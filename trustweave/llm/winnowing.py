"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Every run of ``k`` code points is hashed; of each ``window`` successive hashes the smallest is chosen, the rightmost
among equals, and kept with its position. Two texts that share any run of ``window + k - 1`` code points share a
fingerprint hash for it, at the places where it stands. With the defaults that holds from 50 code points on.

Texts are hashed as whole batches of code points: a polynomial of each k-gram, from which the order is made by mixing.

Edge cases: a null text counts as empty and has no hashes; a text shorter than ``k`` has one hash, of all of it, and one
with fewer than ``window`` k-grams has their minimum; two texts without hashes are alike (1), one is unlike any other
(0); equal texts have equal fingerprints; repeated rows count each; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trustweave.llm.common import partitions, slices

K, WINDOW = 19, 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BIG = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.uint64(0xFFFFFFFF)

Prints = list[tuple[np.ndarray, np.ndarray]]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes, by doubling: runs of 2^j are joined from two halves."""
    h = codes.astype(np.uint64) + np.uint64(1)
    out, at, size, power = None, 0, 1, BASE
    rest = k
    while True:
        if rest & 1:
            part = h[at : len(codes) - k + 1 + at]
            out = part.copy() if out is None else out * power + part
            at += size
        rest >>= 1
        if not rest:
            return mix(out)
        h = h[: len(h) - size] * power + h[size:]
        size, power = 2 * size, np.uint64(int(power) ** 2 & (2**64 - 1))


def fingerprints(texts: list[str], k: int = K, window: int = WINDOW, block: int = 1 << 21) -> Prints:
    """32-bit hashes and positions, in order of position, of each text."""
    made: Prints = []
    some: list[str] = []
    held = 0
    for text in texts:
        if len(text) > block:
            made += _batch(some, k, window)
            some, held = [], 0
            made.append(_long(text, k, window, block))
            continue
        some.append(text)
        held += len(text) + k + window
        if held > block:
            made += _batch(some, k, window)
            some, held = [], 0
    return made + _batch(some, k, window)


def _batch(texts: list[str], k: int, window: int) -> Prints:
    if not texts:
        return []
    gap = "\0" * (window + k)
    codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(n + window + k)[:-1]])
    grams = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    hashes = gram_hashes(codes, k) >> np.uint64(32)
    # Only k-grams inside a text count; those of shorter texts are the text and some padding.
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + grams, len(hashes)), -1)
    inside = np.cumsum(edge[:-1]) > 0
    at = np.arange(len(hashes), dtype=np.uint64)
    key = np.where(inside, hashes << np.uint64(32) | (LOW - at), BIG)
    low, size = key, 1
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
    windows = np.where(grams > 0, np.maximum(1, grams - window + 1), 0)
    total = int(windows.sum())
    first = np.cumsum(windows) - windows
    chosen = low[np.repeat(start - first, windows) + np.arange(total)]
    new = np.ones(total, bool)
    new[1:] = chosen[1:] != chosen[:-1]
    chosen = chosen[new]
    place = (LOW - (chosen & LOW)).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), windows)[new]
    ends = np.cumsum(np.bincount(of, minlength=len(texts)))
    values = (chosen >> np.uint64(32)).astype(np.uint32)
    return [(values[a:b], place[a:b] - s) for a, b, s in zip([0, *ends[:-1].tolist()], ends.tolist(), start.tolist(), strict=True)]


def _long(text: str, k: int, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """One long text in overlapping blocks: each holds all windows that begin in it."""
    parts = []
    for begin in range(0, len(text) - k - window + 2, block):
        h, p = _batch([text[begin : begin + block + k + window - 2]], k, window)[0]
        p = p + begin
        if parts and len(p) and p[0] == parts[-1][1][-1]:
            h, p = h[1:], p[1:]
        parts.append((h, p))
    return np.concatenate([h for h, _ in parts]), np.concatenate([p for _, p in parts])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def winnow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``id_col``, hashes and positions of every row: the fingerprints themselves."""
    kept = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = fingerprints([t or "" for t in batch.column(1).to_pylist()], k, window)
            columns = [pa.array([x[i].tolist() for x in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "hashes", "positions"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, hashes array<long>, positions array<long>").withColumnRenamed("id", id_col)


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into ranges of ids, as (bucket, ahead, id, text), each range followed by the first row of the next.

    The ranges come from approximate quantiles of the ids, so there are as many as shuffle partitions; only their bounds
    and the first id of each go to the driver. Sorting a range by (ahead, id, text) puts each row before its next one.
    """
    spark = df.sparkSession
    kept = df.select(F.coalesce(df[id_col].cast("long"), F.lit(-(2**63))).alias("key"), df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    n = partitions(spark)
    cuts = kept.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0]
    bounds = F.lit(sorted(set(cuts or [])))
    bucketed = kept.withColumn("bucket", F.size(F.filter(bounds, lambda c: c <= F.col("key")))) if cuts else kept.withColumn("bucket", F.lit(0))
    firsts = sorted((r["bucket"], r["key"]) for r in bucketed.groupBy("bucket").agg(F.min("key").alias("key")).collect())
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    if not before:
        return bucketed.select("bucket", F.lit(False).alias("ahead"), "id", "text")
    ahead = spark.createDataFrame(list(before.items()), "key long, before int")
    # Of rows that repeat a first id, only the least text goes ahead; such ids are few: one for each range.
    known = bucketed.join(F.broadcast(ahead), "key", "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ahead"))
    also = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ahead"))
    return known.select(F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("x"), "id", "text").select("x.*", "id", "text")


def compare_with_edit_and_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likeness to each other and to the next document.

    The edited text has the last quarter replaced by as many code points from the start of the next document, by
    ascending id; the first follows the last. Texts are shuffled once. Rows with equal ids follow each other by text.
    """
    spark = df.sparkSession
    dealt = with_next(df, id_col, text_col).repartitionByRange(partitions(spark), "bucket").sortWithinPartitions("bucket", "ahead", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        held = None  # the row before: bucket, ahead, id, text, hashes

        def pairs() -> Iterator[tuple]:
            nonlocal held
            for batch in slices(batches, "text"):
                rows = [(b, a, i, t or "") for b, a, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                prints = [h for h, _ in fingerprints([r[3] for r in rows], k, window)]
                ready = []
                for row, hashes in zip(rows, prints, strict=True):
                    if held is not None and not held[1] and held[0] == row[0]:
                        ready.append((*held, row[3], hashes))
                    held = (*row, hashes)
                edited = [t[: len(t) - len(t) // 4] + nxt[: len(t) // 4] for _, _, _, t, _, nxt, _ in ready]
                yield ready, edited, [h for h, _ in fingerprints(edited, k, window)]

        for ready, edited, prints in pairs():
            for (_, _, i, text, own, _, following), changed, other in zip(ready, edited, prints, strict=True):
                ids.append(i)
                sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                for column, value in zip(columns, (len(text), sha, own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, following)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, columns, kinds)], names=["id", *names])
            ids.clear()
            for column in columns:
                column.clear()

    names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    id_type = to_arrow_type(dealt.schema["id"].dataType)
    schema = f"id {dealt.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)

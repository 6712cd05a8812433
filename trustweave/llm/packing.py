"""Packing of token sequences into as few full sequences as possible, by exact complements.

Documents become pieces of at most ``capacity`` tokens; only longer ones are cut, and the shorter piece comes first. How
many pieces there are of each length (at most ``capacity`` numbers, whatever the corpus) goes to the driver, which plans
in whole groups of equal lengths: for each length it looks up one, two or three lengths that exactly fill the gap, as
often as pieces are there, and places the rest best-fit. Each piece then finds its sequence by its rank among the
pieces of its length; the plan that is broadcast grows with the number of lengths only.

Edge cases: a null or empty text is a document of the end token alone; repeated rows are packed each; an empty table
gives no pieces; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustweave.llm.common import slices, stored
from trustweave.llm.tokens import encoder

Pattern = tuple[int, ...]


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32 (and with ``keep_ids`` the ids) of every piece of every document."""
    kept = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).batch
        for batch in slices(batches, "text", 12 << 20):
            rows: list[int] = []
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, ids in enumerate(encode(batch.column(1))):
                ids = np.concatenate([ids, end])
                n, at, k = len(ids), 0, 0
                raw = ids.astype("<u4").tobytes()
                step = (n - 1) % capacity + 1
                while at < n:
                    rows.append(i)
                    for column, value in zip(out, (k, at, step, zlib.crc32(raw[4 * at : 4 * (at + step)]), ids[at : at + step] if keep_ids else None), strict=True):
                        column.append(value)
                    at, k, step = at + step, k + 1, capacity
            made = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, t) for c, t in zip(out, (pa.int32(), *[pa.int64()] * 3), strict=False)]
            if keep_ids:
                made.append(pa.array([x.tolist() for x in out[4]], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(made, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(made)])

    kind = kept.schema["id"].dataType.simpleString()
    made = kept.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids)
    return made.withColumnRenamed("id", id_col)


class Lengths:
    """How many pieces of each length are left, with look-ups of one, two or three of them by their sum."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype(np.int64)

    def times(self, pattern: Pattern) -> int:
        """How often the whole pattern can still be taken."""
        return min(int(self.left[x]) // pattern.count(x) for x in set(pattern))

    def take(self, pattern: Pattern, times: int) -> None:
        for x in pattern:
            self.left[x] -= times

    def pair(self, gap: int, given: Pattern) -> Pattern | None:
        """The pair that adds up to ``gap`` and is there most often, next to what is ``given``."""
        if gap < 2:
            return None
        free = self.left.copy()
        for x in given:
            free[x] -= 1
        a = np.arange(1, gap // 2 + 1)
        often = np.minimum(free[a], free[gap - a])
        if gap % 2 == 0:
            often[-1] = free[gap // 2] // 2
        k = int(often.argmax())
        return (gap - k - 1, k + 1) if often[k] > 0 else None

    def complement(self, length: int) -> Pattern | None:
        """One, two or three lengths that fill the gap beside ``length`` exactly."""
        gap = len(self.left) - 1 - length
        if gap and self.times((length, gap)):
            return (gap,)
        if (two := self.pair(gap, (length,))) is not None:
            return two
        for a in (np.flatnonzero(self.left[: max(1, gap - 1)])[::-1]).tolist():
            if 3 * a < gap:
                break
            if self.times((length, a)) and (two := self.pair(gap - a, (length, a))) is not None:
                return (a, *two)
        return None


def plan(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Patterns of lengths that share a sequence, with how often each is used; counts[n] pieces have length n."""
    lengths, capacity, made = Lengths(counts), len(counts) - 1, []
    for length in range(capacity, 0, -1):
        while lengths.left[length] and (rest := (() if length == capacity else lengths.complement(length))) is not None:
            pattern = (length, *rest)
            lengths.take(pattern, times := lengths.times(pattern))
            made.append((pattern, times))
    open_by_gap: dict[int, list[tuple[Pattern, int]]] = {}
    for length in range(capacity - 1, 0, -1):
        n = int(lengths.left[length])
        while n and (gap := min((g for g, group in open_by_gap.items() if group and g >= length), default=0)):
            pattern, times = open_by_gap[gap].pop()
            used = min(n, times)
            if times > used:
                open_by_gap[gap].append((pattern, times - used))
            fits = min(gap // length, n // used)
            open_by_gap.setdefault(gap - fits * length, []).append((pattern + (length,) * fits, used))
            n -= used * fits
        each = capacity // length
        for size, times in ((each, n // each), (n % each, 1)):
            if size and times:
                open_by_gap.setdefault(capacity - size * length, []).append(((length,) * size, times))
    return made + [x for group in open_by_gap.values() for x in group]


def slots(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each place in a pattern: the length, the first rank that goes there, the first sequence and the offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, offset))
            taken[length] = rank + times
            offset += length
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns, strict=True))


def pack(pieces: DataFrame, capacity: int = 1024, id_col: str = "doc_id", rows_per_group: int = 4096) -> DataFrame:
    """Add sequence_id and offset to the rows of :func:`token_pieces`, which should come from a stored table.

    Ranks among equal lengths are counted in groups of a hash of the row, so that no frequent length meets in one task.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted:
        counts[r["length"]] = r["count"]
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    counts[capacity] = 0
    places = slots(plan(counts))
    groups = int(min(4096, max(1, counts.sum() // rows_per_group)))
    table = spark.sparkContext.broadcast((places["length"] << 40 | places["rank"], places["rank"], places["sequence"], places["offset"]))
    rest = pieces.where(F.col("length") < capacity).withColumn("_group", F.pmod(F.xxhash64(id_col, "piece"), F.lit(groups)).cast("int"))
    ahead = (
        rest.groupBy("length", "_group")
        .count()
        .withColumn("_ahead", F.sum("count").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_group", F.coalesce("_ahead", F.lit(0)).alias("_ahead"))
    )
    order = Window.partitionBy("length", "_group").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = rest.withColumn("_rank", F.row_number().over(order) - 1).join(ahead, ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_ahead"))
    names = pieces.columns
    ranked = ranked.select(*names, "_rank")


    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, sequences, offsets = table.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            columns = [batch.column(c) for c in names] + [pa.array(sequences[at] + rank - ranks[at], pa.int64()), pa.array(offsets[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return full.unionByName(ranked.mapInArrow(place, schema))


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where every piece of every document goes: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(token_pieces(df, tokenizer, capacity, end_id, id_col, text_col)), capacity, id_col)


def sequences(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, of at most ``capacity`` tokens each."""
    placed = pack(stored(token_pieces(df, tokenizer, capacity, end_id, id_col, text_col, keep_ids=True)), capacity, id_col)
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))

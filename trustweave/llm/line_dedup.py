"""Deduplication of lines within an edit bound, in words, by a deletion-neighbourhood join.

A line is its words: runs of characters without white space. It goes if an earlier line of the corpus (by document id,
then line number, whether that one stays or not) equals it, or, from ``near_words`` words on, differs by at most
``bound`` words inserted, deleted or replaced. Every line of a word or more takes part; a line of no more words than the
bound is near any other so short, so equality alone settles it.

Equal lines are settled by their 128-bit digest. A line's variants are what is left when up to ``bound`` of its words are
taken away, each either with a hole in its place or without; they are hashed. Two lines within the bound have a variant in
common with as many holes as words are replaced. In a group with one variant, of h holes, a line that lost x words
otherwise is within the bound of all those that lost up to bound - h - x, so each is joined to the earliest of these
alone, whatever the group's size. Texts are then compared word by word.

With a bound of 1, a line within one edit of another shares one of two halves with it; only lines that share a half emit
variants (an exact filter). With a larger bound all distinct lines do, some (2 n) ** bound / bound! for n words each.
A frequent equal line is settled by a broadcast (:func:`join_hot`); a variant that many lines share is one key of a
sort-merge join, which adaptive execution splits.

Edge cases: null and empty texts have no lines; rows that repeat a document id count as that document, and their lines
as the same lines (of different texts, the least line at a place counts); a null id sorts first; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.llm.common import join_hot, slices, small, stored

BASE = 0x9E3779B97F4A7C15
MASK = 2**64 - 1


def signed(values: list[int] | np.ndarray) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def half_keys(words: list[str]) -> list[int]:
    """Hashes of the halves under the line's own length, and under the length of a line with one word less."""
    n, keys = len(words), []
    for m in (n, n - 1):
        if m < 2:  # single words have no neighbours
            continue
        c = m // 2
        keys.append(xxhash.xxh3_64_intdigest(" ".join(words[:c]), seed=2 * m))
        keys.append(xxhash.xxh3_64_intdigest(" ".join(words[n - (m - c) :]), seed=2 * m + 1))
    return keys


def lines(df: DataFrame, id_col: str, text_col: str, near_words: int, bound: int) -> DataFrame:
    """doc, line, digest (h1, h2), whether it may have near lines, and for a bound of 1 the hashed halves of every line."""
    kept = df.select(df[id_col].alias("doc"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, numbers, digests, near, keys = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, line in enumerate((text or "").split("\n")):
                    words = line.split()
                    if words:
                        rows.append(i)
                        numbers.append(k)
                        digests.append(xxhash.xxh3_128_intdigest(" ".join(words)))
                        near.append(len(words) >= near_words)
                        keys.append(half_keys(words) if near[-1] and bound == 1 else [])
            counts = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(signed([d >> 64 for d in digests])),
                    pa.array(signed([d & MASK for d in digests])),
                    pa.array(near, pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(signed([k for x in keys for k in x]), pa.int64())),
                ],
                names=["doc", "line", "h1", "h2", "near", "halves"],
            )

    return kept.mapInArrow(run, f"doc {kept.schema['doc'].dataType.simpleString()}, line int, h1 long, h2 long, near boolean, halves array<long>")


def variants(words: list[str]) -> tuple[int, np.ndarray]:
    """Hash of the whole line, and of the line without its i-th word for each i; polynomials of the words' hashes."""
    x = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = len(x)
    ahead, behind, power = [0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
    for i, v in enumerate(x.tolist()):
        ahead[i + 1] = (ahead[i] * BASE + v) & MASK
        power[i + 1] = power[i] * BASE & MASK
    for i in range(n - 1, -1, -1):
        behind[i] = (int(x[i]) * power[n - 1 - i] + behind[i + 1]) & MASK
    a, b, p = (np.array(v, np.uint64) for v in (ahead, behind, power))
    return ahead[n] ^ n, (a[:n] * p[n - 1 :: -1] + b[1:]) ^ np.uint64(n - 1)


def many_variants(words: list[str], bound: int) -> set[tuple[int, int, int]]:
    """(hash, words lost without a hole, holes) of all variants with up to ``bound`` words taken away."""
    made = set()
    for m in range(min(bound, len(words)) + 1):
        for gone in combinations(range(len(words)), m):
            for h in range(m + 1):
                for holes in combinations(gone, h):
                    left = " ".join("\0" if i in holes else w for i, w in enumerate(words) if i in holes or i not in gone)
                    made.add((xxhash.xxh3_64_intdigest(left), m - h, h))
    return made


def emit(suspects: DataFrame, bound: int) -> DataFrame:
    """(key, lost, holes, doc, line) for each variant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", 1 << 18 if bound == 1 else 1 << 14):
            rows, keys, lost, holes = [], [], [], []
            for i, line in enumerate(batch.column(2).to_pylist()):
                if bound == 1:
                    whole, less = variants(line.split(" "))
                    at = (less + np.uint64(1)) * np.uint64(BASE) ^ np.arange(1, len(less) + 1, dtype=np.uint64)
                    less = np.unique(less)
                    keys += [np.array([whole], np.uint64), less, at]
                    lost += [np.zeros(1, np.int8), np.ones(len(less), np.int8), np.zeros(len(at), np.int8)]
                    holes += [np.zeros(1 + len(less), np.int8), np.ones(len(at), np.int8)]
                    rows.append(np.full(1 + len(less) + len(at), i))
                else:
                    made = list(zip(*many_variants(line.split(" "), bound), strict=True))
                    keys.append(np.array(made[0], np.uint64))
                    lost.append(np.array(made[1], np.int8))
                    holes.append(np.array(made[2], np.int8))
                    rows.append(np.full(len(made[0]), i))
            of = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(lost)), pa.array(np.concatenate(holes)), batch.column(0).take(of), batch.column(1).take(of)],
                names=["key", "lost", "holes", "doc", "line"],
            )

    kind = suspects.schema["doc"].dataType.simpleString()
    return suspects.mapInArrow(run, f"key long, lost byte, holes byte, doc {kind}, line int")


def edits(a: list[str], b: list[str], most: int) -> int:
    """The least number of words inserted, deleted or replaced that makes one of the other, or any number above ``most``."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b or most == 0:
        return len(a) + len(b)
    if abs(len(a) - len(b)) > most:
        return most + 1
    return 1 + min(edits(a[1:], b[1:], most - 1), edits(a[1:], b, most - 1), edits(a, b[1:], most - 1))


def suspect_lines(df: DataFrame, distinct: DataFrame, id_col: str, text_col: str, bound: int) -> DataFrame:
    """doc, line and words of those distinct lines that may have near ones: with a bound of 1, that share a half with another."""
    near = distinct.where("near")
    if bound == 1:
        halves = near.select(F.explode(F.array_distinct("halves")).alias("half"), "first")
        shared = halves.groupBy("half").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a != b").select("half")
        near = halves.join(shared, "half", "left_semi").select("first").distinct()
    found = stored(near.groupBy(F.col("first.doc").alias("_doc")).agg(F.collect_list("first.line").alias("lines")))
    texts = df.select(df[id_col].alias("doc"), df[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    texts = texts.join(small(found, 500_000), F.col("doc").eqNullSafe(F.col("_doc"))).select("doc", "text", "lines")
    kind = texts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, numbers, words = [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                split = text.split("\n")
                for k in wanted:
                    if k < len(split) and split[k].split():
                        rows.append(i)
                        numbers.append(k)
                        words.append(" ".join(split[k].split()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(words, pa.string())], names=["doc", "line", "words"])

    return texts.mapInArrow(run, f"doc {kind}, line int, words string").groupBy("doc", "line").agg(F.min("words").alias("words"))


def near_lines(suspects: DataFrame, bound: int) -> DataFrame:
    """first (doc, line) with its earliest neighbour ``keep``, and their distance, for suspects with an earlier line within the bound."""
    at = F.struct("doc", "line")
    sent = emit(suspects, bound).select("key", "lost", "holes", at.alias("at"))
    # The earliest line of a group among those that lost up to c words.
    groups = sent.groupBy("key").agg(F.min("at").alias("low"), F.max("at").alias("high"), *[F.min(F.when(F.col("lost") <= c, F.col("at"))).alias(f"low{c}") for c in range(bound + 1)]).where("low != high")
    keeper = F.col("low0")
    for c in range(1, bound + 1):
        keeper = F.when(bound - F.col("holes") - F.col("lost") == c, F.col(f"low{c}")).otherwise(keeper)
    pairs = sent.join(groups, "key").select(F.col("at").alias("first"), keeper.alias("keep")).where("keep < first").distinct()
    own, other = (suspects.select(F.struct("doc", "line").alias(name), F.col("words").alias(f"{name}_words")) for name in ("first", "keep"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [edits(a.split(" "), b.split(" "), bound) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.int32())], names=["first", "keep", "distance"])
            yield made.filter(pa.array([n <= bound for n in far], pa.bool_()))

    joined = pairs.join(own, "first").join(other, "keep").select("first", "keep", "first_words", "keep_words")
    kind = suspects.schema["doc"].dataType.simpleString()
    place = f"struct<doc:{kind},line:int>"
    good = joined.mapInArrow(verify, f"first {place}, keep {place}, distance int")
    return good.groupBy("first").agg(F.min(F.struct("keep", "distance")).alias("best")).select("first", "best.keep", "best.distance")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = 1, near_words: int | None = None) -> DataFrame:
    """Every line that goes: ``id_col``, line (from 0), the earlier line it repeats (keep_doc, keep_line) and distance.

    ``near_words`` is one more than the bound, if not given; a bound of 0 settles equal lines only.
    """
    near_words = bound + 1 if near_words is None else near_words
    if bound < 0 or near_words <= bound:
        raise ValueError("the bound is 0 or more, and near_words above it")
    found = stored(lines(df, id_col, text_col, near_words, bound))
    at = F.struct("doc", "line")
    distinct = stored(found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.first("halves").alias("halves"), F.first("near").alias("near"), F.count("*").alias("n")))
    again = distinct.where("n > 1").select("h1", "h2", "first", "n")
    equal = join_hot(found.select("h1", "h2", "doc", "line"), again, ["h1", "h2"], "n").where(at > F.col("first"))
    columns = lambda at, keep, far: [F.col(f"{at}doc").alias(id_col), F.col(f"{at}line").alias("line"), F.col(f"{keep}.doc").alias("keep_doc"), F.col(f"{keep}.line").alias("keep_line"), far.alias("distance")]
    made = equal.select(*columns("", "first", F.lit(0)))
    if bound == 0:
        return made
    near = near_lines(stored(suspect_lines(df, distinct, id_col, text_col, bound)), bound)
    return made.unionAll(near.select(*columns("first.", "keep", F.col("distance"))))


def remove_lines(df: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the lines named in ``gone``; documents of which nothing but white space would be left go too."""
    per_doc = gone.groupBy(F.col(id_col).alias("_doc")).agg(F.collect_set("line").alias("_lines"))
    joined = df.join(per_doc, df[id_col].eqNullSafe(F.col("_doc")), "left").drop("_doc")
    names = df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts, stays = [], []
            for text, lost in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if lost and text is not None:
                    drop = set(lost)
                    text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop)
                    stays.append(bool(text.strip()))
                else:
                    stays.append(True)
                texts.append(text)
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays, pa.bool_()))

    return joined.mapInArrow(run, df.schema)

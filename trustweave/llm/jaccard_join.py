"""Similarity join on word shingles by parity sketches; what links is exact, and components come from all links.

A document's set are its distinct shingles. For a Jaccard threshold of t percent, linked sets differ in at most
d = min(|A|, |B|) (100 - t) / t shingles. A sketch has m > d parts; each shingle flips, by its hash, one bit of one part,
a part being 2^64 bits wide and held as the XOR of its odd bits' numbers. Parts in which two sketches differ number at
most the size of the symmetric difference, so of any d + 1 parts of a document one at least is equal in the other. Each
document sends d + 1 of its parts: those with most shingles, in an order that depends on a part's content alone, so
that a pair's equal part is sent by both. m follows from the size band of a document (sizes within a factor of 1.5), and
a document whose partners may lie in the next band sends parts for that one as well.

Equal parts meet; sizes are compared; then parity sketches with parts of one bit, which rule out most pairs that don't
link and none that do; then the sets themselves. Small groups (up to ``group_limit`` documents with one part) give pairs
at once. In larger ones each member is held against the first; those that link with it are connected, and only the others
still have to meet all members, in pairs of blocks, each a task of bounded size, that pass over pairs which are connected
already and return links of a spanning forest only. Documents with equal sets count once in all this, and keys that many
rows share are broadcast (:func:`join_hot`). No link between different sets is lost.

Words are runs of characters other than ASCII white space, after lower-casing A-Z. Shingles and sets are compared by
64-bit hashes, classes of equal sets by 128 bits.

Edge cases: null and empty texts, and those without words, have an empty set and link with nothing; a text with fewer
words than a shingle has one shingle, of all its words; rows that repeat an id are returned each, and where their texts
differ the set of the least bytes links for all; a null id has a null component; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.llm.common import join_hot, partitions, slices, small, stored, total_bytes, without
from trustweave.llm.suffix_dedup import pack, unpack
from trustweave.llm.winnowing import mix
from trustweave.operators.components import components

RATIO = 1.5
C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, one after another, and how many words each text has."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # Arrow's case functions misread the offsets of some slices
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)], np.uint64)
    code = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text still has one part, which is no word
        code = np.delete(code, (np.cumsum(counts) - counts)[empty])
        counts[empty] = 0
    return hashes[code] if len(code) else np.zeros(0, np.uint64), counts


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    grams = np.zeros(0, np.uint64)
    if len(words) >= size:
        n = len(words) - size + 1
        grams = np.zeros(n, np.uint64)
        for k in range(size):
            grams = grams * C[0] + words[k : k + n]
        grams = mix(grams)
    made = []
    for begin, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if end - begin >= size:
            some = np.sort(grams[begin : end - size + 1])
            new = np.ones(len(some), bool)
            new[1:] = some[1:] != some[:-1]
            made.append(some[new])
        elif end > begin:
            whole = np.array([end - begin], np.uint64)
            for w in words[begin:end]:
                whole = whole * C[1] + w
            made.append(mix(whole))
        else:
            made.append(np.zeros(0, np.uint64))
    return made


class Bands:
    """Size bands for a threshold of ``percent``, and the number of sketch parts in each."""

    def __init__(self, percent: int) -> None:
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50 and at most 100")
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
        #: Band k holds the sizes from edges[k] to edges[k + 1] - 1.
        self.edges = np.array(edges, np.int64)
        most = self.differ(self.edges[1:] - 1)
        spread = 1.2 if percent >= 87 else 1.3
        self.parts = np.ceil(spread * (most + 1)).astype(np.int64) + 1

    def differ(self, size: np.ndarray | int) -> np.ndarray | int:
        """The most shingles in which a set of this size can differ from one that links with it and is no smaller."""
        return size * (100 - self.percent) // self.percent

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, size, side="right") - 1


def sketch(tokens: np.ndarray, owner: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XOR and number of shingles of every part; document i has parts[i] of them, from first[i] on."""
    first = np.cumsum(parts) - parts
    at = first[owner] + ((tokens >> np.uint64(32)) * parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    total = int(parts.sum())
    odd = np.zeros(total, np.uint64)
    np.bitwise_xor.at(odd, at, mix(tokens * C[2]))
    return odd, np.bincount(at, minlength=total), first


def part_keys(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) of all parts that are sent."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    home, reach = bands.of(sizes), bands.of(sizes * 100 // bands.percent)
    keys, owners = [], []
    for step in range(int((reach - home).max(initial=-1)) + 1):
        some = np.flatnonzero((home + step <= reach) & (bands.differ(sizes) > 0))
        if not len(some):
            continue
        band = home[some] + step
        parts = bands.parts[band]
        tokens = np.concatenate([sets[i] for i in some.tolist()])
        odd, count, first = sketch(tokens, np.repeat(np.arange(len(some)), sizes[some]), parts)
        of = np.repeat(np.arange(len(some)), parts)
        order = np.lexsort((odd, -np.minimum(count, 255), of))
        sent = order[np.arange(len(order)) - first[of] <= bands.differ(sizes[some])[of]]
        label = band[of[sent]].astype(np.uint64) * C[0] + (sent - first[of[sent]]).astype(np.uint64) * C[1]
        keys.append(mix(odd[sent] + mix(label)))
        owners.append(some[of[sent]])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold: 100 |A & B| >= percent |A | B|."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def set_rows(df: DataFrame, size: int, make, schema: str) -> DataFrame:
    """Rows that ``make`` builds from the ids and the shingle sets of a batch of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield make(batch.column(0), shingle_sets(batch.column(1), size))

    return df.mapInArrow(run, schema)


def classes(docs: DataFrame, size: int) -> DataFrame:
    """doc, n and a 128-bit digest (d1, d2) of its set, for every row."""

    def make(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        halves = [np.array([d >> k & (2**64 - 1) for d in digest], np.uint64).view(np.int64) for k in (64, 0)]
        return pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, sets)), pa.int64()), *map(pa.array, halves)], names=["doc", "n", "d1", "d2"])

    return set_rows(docs, size, make, "doc long, n long, d1 long, d2 long")


SENT = "target int, packed binary"
FOUND = "large boolean, a long, b long"


def candidates(docs: DataFrame, size: int, bands: Bands, targets: int, group_limit: int) -> DataFrame:
    """Pairs (a, b) of documents that share a part, and for larger groups (large) the rows (key, document)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, doc, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            target = (key % np.uint64(targets)).astype(np.int32)
            order = np.lexsort((doc, target))
            target, key, doc, n = (x[order] for x in (target, key >> np.uint64(32), doc.view(np.uint64), n.astype(np.uint64)))
            edges = np.searchsorted(target, np.arange(targets + 1)).tolist()
            used = [t for t in range(targets) if edges[t] < edges[t + 1]]
            packed = [pack(*(c[edges[t] : edges[t + 1]] for c in (key, doc, n))) for t in used]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["target", "packed"])

        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1), size)
            key, owner = part_keys(sets, bands)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            held.append([key, batch.column(0).to_numpy(zero_copy_only=False)[owner], sizes[owner]])
            if sum(len(h[0]) for h in held) > 600_000:
                yield flush()
                held = []
        if sum(len(h[0]) for h in held):
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for target, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(target, []).append(unpack(packed))
        for target, some in parts.items():
            key, doc, n = (np.concatenate([p[k] for p in some]) for k in range(3))
            doc, n = doc.view(np.int64), n.astype(np.int64)
            order = np.lexsort((doc, key))
            key, doc, n = key[order], doc[order], n[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            count = np.diff(np.append(np.flatnonzero(new), len(key)))
            count = np.repeat(count, count)
            large = count > group_limit
            several = (count > 1) & ~large
            k, d, s = key[several], doc[several], n[several]
            pairs = []
            for step in range(1, group_limit):
                if len(k) <= step:
                    break
                same = (k[step:] == k[:-step]) & (d[step:] != d[:-step])
                a, b, x, y = d[:-step][same], d[step:][same], s[:-step][same], s[step:][same]
                fits = 100 * np.minimum(x, y) >= bands.percent * np.maximum(x, y)
                pairs.append(np.stack([a[fits], b[fits]]))
            if pairs:
                both = np.concatenate(pairs, axis=1)
                both = both[:, np.lexsort(both)]
                fresh = np.ones(both.shape[1], bool)
                fresh[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
                yield rows(False, *both[:, fresh])
            if large.any():
                yield rows(True, (key[large] | np.uint64(target) << np.uint64(32)).view(np.int64), doc[large])

    def rows(large: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), large)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["large", "a", "b"])

    return docs.mapInArrow(send, SENT).repartition(targets, "target").mapInArrow(meet, FOUND)


def bit_sketches(sets: list[np.ndarray]) -> list[bytes]:
    """For each set its size and, of at least twice as many bits as that, those that its shingles flip an odd number of times."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    width = np.array([1 << max(6, (2 * n - 1).bit_length()) for n in sizes.tolist()], np.int64)
    first = np.cumsum(width) - width
    odd = np.zeros(int(width.sum()), np.uint8)
    if len(odd):
        tokens = np.concatenate(sets)
        np.bitwise_xor.at(odd, np.repeat(first, sizes) + (tokens & np.repeat(width - 1, sizes).astype(np.uint64)).astype(np.int64), np.uint8(1))
    packed = np.packbits(odd)
    return [n.to_bytes(8, "little") + packed[a : a + w].tobytes() for n, a, w in zip(sizes.tolist(), (first // 8).tolist(), (width // 8).tolist(), strict=True)]


def may_link(a: bytes, b: bytes, percent: int) -> bool:
    """False only for sets that don't link: they differ in at least as many shingles as their bit sketches in bits."""
    a, b = sorted((np.frombuffer(x, np.uint64) for x in (a, b)), key=len)
    n, a, b = int(a[0]) + int(b[0]), a[1:], b[1:]
    while len(b) > len(a):  # half as many bits: those of places that now coincide, added
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (100 + percent) <= (100 - percent) * n


def only(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The sets of these documents (one column), so that others are not shuffled."""
    return sets.join(small(docs.select(F.col(docs.columns[0]).alias("doc")).distinct()), "doc", "left_semi")


def compared(pairs: DataFrame, sets: DataFrame, column: str, keeps) -> DataFrame:
    """Those stored pairs (a, b) for which ``keeps`` holds, given this column's bytes of both."""
    often = pairs.groupBy("a").agg(F.count("*").alias("_n"))
    own = stored(sets.join(often, sets["doc"] == often["a"]).select("a", F.col(column).alias("a_held"), "_n"))
    other = only(sets, pairs.select("b")).select(F.col("doc").alias("b"), F.col(column).alias("b_held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            yield batch.filter(pa.array([keeps(x, y) for x, y in both], pa.bool_())).select(["a", "b"])

    return join_hot(pairs, own, ["a"], "_n", share=100).join(other, "b").select("a", "b", "a_held", "b_held").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those stored pairs (a, b) whose sets link: first by bit sketches, some twentieth of a set's bytes, which pass all that do."""
    near = stored(compared(pairs, sets, "bits", lambda x, y: may_link(x, y, percent)))
    return compared(near, sets, "tokens", lambda x, y: linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))


def forest(docs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among some documents; with two sides, those between the sides only."""
    bands = Bands(percent)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    m = int(bands.parts[bands.of(sizes.max(keepdims=True))[0]])
    odd, _, _ = sketch(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), np.full(len(sets), m))
    odd = odd.reshape(len(sets), m)
    root, links = np.arange(len(sets)), []
    two = bool(side.any() and not side.all())
    for i in range(len(sets)):
        low, high = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        maybe = (root != root[i]) & (100 * low >= percent * high) & (np.arange(len(sets)) > i)
        if two:
            maybe &= side != side[i]
        at = np.flatnonzero(maybe)
        if not len(at):
            continue
        apart = (odd[at] != odd[i]).sum(axis=1)
        for j in at[apart <= bands.differ(low[at])].tolist():
            if root[j] != root[i] and linked(sets[i], sets[j], percent):
                links.append((int(docs[i]), int(docs[j])))
                root[root == root[j]] = root[i]
    return links


def large_group_links(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links within groups (key, doc) of any size: of each member with the first, and of those without such a link with all.

    The latter meet in pairs of blocks of about ``block`` documents, each by a task of its own.
    """
    members = stored(members)
    groups = stored(members.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("first")))
    sized = stored(join_hot(members, groups, ["key"], "n"))
    near = stored(verified(stored(sized.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()), sets, percent))
    others = stored(sized.where("doc <> first").join(near.select(F.col("a").alias("first"), F.col("b").alias("doc")), ["first", "doc"], "left_anti").select("key", "doc"))
    if others.limit(1).count() == 0:
        return near
    dealt = groups.join(others.groupBy("key").agg(F.count("*").alias("r")), "key")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int").alias(f"{c}_blocks")
    dealt = stored(dealt.select("key", "n", "r", blocks("n"), blocks("r")))
    of = lambda c: F.pmod(F.xxhash64("doc"), F.col(f"{c}_blocks")).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_blocks") - 1))
    left = join_hot(others, dealt, ["key"], "r").select("key", of("r").alias("i"), all_of("n").alias("j"), F.lit(0).alias("own"), "doc")
    right = join_hot(members, dealt, ["key"], "n").select("key", all_of("r").alias("i"), of("n").alias("j"), F.lit(1).alias("own"), "doc")
    keyed = left.union(right).join(only(sets, members.select("doc")), "doc")
    ordered = keyed.select("key", "i", "j", "own", "doc", "tokens").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            side = np.array([x[3] == 1 for x in held])
            links = forest(np.array([x[4] for x in held]), [np.frombuffer(x[5], np.uint64) for x in held], side, percent)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield close()
                held.append(row)
        if held:
            yield close()

    return near.union(ordered.mapInArrow(run, "a long, b long"))


def similar_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, group_limit: int = 32, block: int = 1024
) -> DataFrame:
    """``id_col``, n_shingles and component_id for every row; links from ``percent`` of Jaccard similarity on."""
    docs = df.select(df[id_col].cast("long").alias("doc"), df[text_col].cast("string").alias("text"))
    bands = Bands(percent)
    known = stored(classes(docs, shingle))
    there = known.where("n > 0 and doc is not null")
    same = stored(there.groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.count("*").alias("rows")).where("rows > 1"))
    others = known.where("n = 0 or doc is null").select("doc", "n", F.lit(None).cast("long").alias("rep"))
    rep = stored(join_hot(there, same, ["d1", "d2"], "rows", "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep")).union(others))
    # Equal sets count once, and sets so small that only equal ones can link not at all.
    passed = (F.col("rep").isNull() | (F.col("doc") != F.col("rep")) | (F.col("n") * (100 - percent) < percent)) & F.col("doc").isNotNull()
    left = without(docs.where("doc is not null"), rep.where(passed).select("doc"), "doc")
    targets = max(partitions(df.sparkSession), total_bytes(docs, "text") // (16 << 20) + 1)
    found = stored(candidates(left, shingle, bands, targets, group_limit))
    pairs = stored(found.where("not large").select("a", "b").distinct())
    members = found.where("large").select(F.col("a").alias("key"), F.col("b").alias("doc")).distinct()
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc")).union(members.select("doc")).distinct())
    sets = set_rows(left.join(small(wanted), "doc", "left_semi"), shingle, _tokens, "doc long, tokens binary, bits binary")
    sets = stored(sets.groupBy("doc").agg(F.min(F.struct("tokens", "bits")).alias("least")).select("doc", "least.*"))
    links = verified(pairs, sets, percent)
    if found.where("large").limit(1).count():
        links = links.union(large_group_links(members, sets, percent, block))
    label = components(links)
    return rep.join(label, rep["rep"] == label["node"], "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "doc").alias("component_id")
    )


def _tokens(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(bit_sketches(sets), pa.binary())], names=["doc", "tokens", "bits"])

"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

Words are runs of letters and digits, lower-cased. A mask is laid at every word position; it hashes the words at its
ones and ignores those at its zeros, so that a substituted word under a zero doesn't hide a match. Hashes of documents
meet those of benchmark items, and around each hit the two texts are aligned word by word: a document is contaminated
by an item if some window of ``window`` aligned words (the whole item, if it is shorter) agrees in at least
``similarity`` of its places.

:func:`masks_for` gives the masks of an item by its number of words. Those of five words, 111011 and 1101101, and for
items of 10 to 12 words 11000111 too, find every passage in which up to each fifth word is substituted; shorter items
have masks for each word that may differ, and items of up to four words must stand verbatim. Documents are read with
the masks that some item needs. Hashes of the benchmark are broadcast while there are at most ``max_broadcast`` of them;
beyond that the join is a shuffled one, in which each hash is dealt over ``salt`` tasks.

Edge cases: null texts count as empty, and empty items are in no document; repeated documents and items give a row for
each pair of ids; empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ("111011", "1101101")
#: The item lengths at which MASKS miss some ways to substitute each fifth word, and the mask that finds those.
MORE = (range(10, 13), "11000111")


def masks_for(words: int) -> tuple[str, ...]:
    """Masks that together find an item of so many words wherever up to each fifth of them is substituted."""
    if words < 5:
        return ("1" * words,) if words else ()
    if words < 8:
        return tuple(sorted({("1" * k + "0" + "1" * (words - 1 - k)).strip("0") for k in range(words)}))
    return (*MASKS, MORE[1]) if words in MORE[0] else MASKS


def lengths_of(masks: tuple[str, ...]) -> list[tuple[str, list[int]]]:
    """For each mask, the item lengths up to 12 words that need it; 13 stands for all longer ones."""
    return [(m, [n for n in range(1, 14) if m in masks_for(n)]) for m in masks]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masked(words: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, at + k) for k, bit in enumerate(mask) if bit == "1"])


def seeds(words: Column, masks: tuple[str, ...]) -> Column:
    """Numbers of seeds: seed s lies at word s div |masks|, under mask s mod |masks|."""
    return F.when(F.size(words) >= min(map(len, masks)), F.sequence(F.lit(0), (F.size(words) - min(map(len, masks)) + 1) * len(masks) - 1)).otherwise(F.array().cast("array<int>"))


def seed_hash(words: Column, seed: str, masks: tuple[str, ...]) -> Column:
    at, which = F.expr(f"cast({seed} div {len(masks)} as int)"), F.col(seed) % len(masks)
    hashed = masked(words, at, masks[-1])
    for k in range(len(masks) - 2, -1, -1):
        hashed = F.when(which == k, masked(words, at, masks[k])).otherwise(hashed)
    return hashed


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 20,
    similarity: float = 0.8,
    max_broadcast: int = 1_000_000,
    salt: int = 16,
) -> DataFrame:
    """A row for each document and item found in it: ``id_col``, ``item_col``, matched_words, window_words.

    matched_words is the number of equal words in the best window of window_words aligned words. A ``similarity`` under
    0.8 is taken, but the masks find all passages from 0.8 on only.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), words_of(F.col(item_text_col)).alias("_iw")).where(F.size("_iw") > 0)
    length = F.least(F.size("_iw"), F.lit(13))
    there = sorted(r[0] for r in items.select(length).distinct().collect())  # 13 rows at most
    masks = tuple(sorted({m for n in there for m in masks_for(n)}, key=lambda m: (len(m), m))) or MASKS
    n = len(masks)
    which, needed = F.col("_s") % n, F.lit(False)
    for k, (_, lengths) in enumerate(lengths_of(masks)):
        needed |= (which == k) & length.isin(lengths)
    item_seeds = items.withColumn("_s", F.explode(seeds(F.col("_iw"), masks))).where(needed).select(
        "_item", "_iw", F.expr(f"cast(_s div {n} as int)").alias("_j"), seed_hash(F.col("_iw"), "_s", masks).alias("_h")
    )
    doc_words = docs.select(F.col(id_col).alias("_doc"), words_of(F.col(text_col)).alias("_w")).where(F.size("_w") >= min(map(len, masks)))
    at = F.expr(f"cast(_s div {n} as int)").alias("_i")
    doc_seeds = doc_words.withColumn("_s", F.explode(seeds(F.col("_w"), masks)))
    # Where the item would begin in the document, and the words of the document beside those of the item.
    begin = F.col("_i") - F.col("_j")
    if item_seeds.limit(max_broadcast + 1).count() <= max_broadcast:
        hits = doc_seeds.select("_doc", "_w", at, seed_hash(F.col("_w"), "_s", masks).alias("_h")).join(F.broadcast(item_seeds), "_h")
        hits = hits.select("_doc", "_item", "_iw", "_w", begin.alias("_at"))
    else:  # only the seeds themselves are shuffled; words join the places that they point to
        bare = doc_seeds.select("_doc", at, seed_hash(F.col("_w"), "_s", masks).alias("_h"), F.pmod(F.xxhash64("_doc", "_s"), F.lit(salt)).alias("_z"))
        spread = item_seeds.select("_item", "_j", "_h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))).alias("_z"))
        places = bare.join(spread, ["_h", "_z"]).select("_doc", "_item", begin.alias("_at")).distinct()
        whole = doc_words.select(F.col("_doc").alias("_same_doc"), "_w")
        hits = places.join(whole, F.col("_doc").eqNullSafe(F.col("_same_doc"))).join(items, "_item").select("_doc", "_item", "_iw", "_w", "_at")
    beside = F.slice("_w", F.greatest("_at", F.lit(0)) + 1, F.size("_iw") + F.least("_at", F.lit(0)))
    aligned = hits.select("_doc", "_item", "_iw", "_at", beside.alias("_dw")).dropDuplicates(["_doc", "_item", "_at"])
    shift = F.greatest(-F.col("_at"), F.lit(0))
    same = F.transform("_iw", lambda w, j: F.when(w == F.get(F.col("_dw"), j - shift), 1).otherwise(0))
    width = F.least(F.size("_iw"), F.lit(window))
    sums = F.transform(
        F.sequence(F.lit(1), F.size("_iw") - width + 1), lambda k: F.aggregate(F.slice("_same", k, width), F.lit(0), lambda a, b: a + b)
    )
    best = aligned.withColumn("_same", same).select("_doc", "_item", width.alias("window_words"), F.array_max(sums).alias("_m"))
    return (
        best.groupBy(F.col("_doc").alias(id_col), F.col("_item").alias(item_col))
        .agg(F.max("_m").alias("matched_words"), F.max("window_words").alias("window_words"))
        .where(F.col("matched_words") >= F.ceil(F.lit(similarity) * F.col("window_words")))
    )

"""Entity resolution: scored pairs within blocks, manual decisions, components, canonical ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustweave.functions import text
from trustweave.model import ModelError, Spec
from trustweave.operators.components import components

#: Names of the columns of scored pairs.
PAIR = ("a", "b", "score")


@dataclass(frozen=True)
class Scored:
    """Pairs of row ids with a score, under the column names that the scorer gave them."""

    pairs: DataFrame
    a: str = "a"
    b: str = "b"
    score: str = "score"

    def frame(self) -> DataFrame:
        return self.pairs.select(F.col(self.a).alias("a"), F.col(self.b).alias("b"), F.col(self.score).alias("score"))


def default_row_id(df: DataFrame) -> Column:
    """Canonical id where there is one, else source and first column."""
    first = next(c for c in df.columns if c not in ("source", "canonical_id"))
    named = F.concat_ws(":", "source", F.col(first).cast("string"))
    return F.coalesce(F.col("canonical_id"), named) if "canonical_id" in df.columns else named


def block_pairs(rows: DataFrame, block: Column, score: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], cross_source: bool = True, near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None, part_rows: int = 500) -> DataFrame:
    """Pairs (a, b, score), a < b, of rows with equal non-null block keys; a null score is no pair.

    ``near`` is a cheap condition that pairs must meet before they are scored.

    An equi-join on the block. The rows of a block of over ``part_rows`` are dealt over several parts, and each part
    meets the whole block, so that a key that all rows share is no single task; no pair is lost. Pairs exist only where
    a score does, so the result is as large as the matches.
    """
    keyed = rows.withColumn("_block", block).where(F.col("_block").isNotNull())
    large = keyed.groupBy("_block").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    sized = keyed.join(F.broadcast(large), "_block", "left")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda part: sized.withColumn("_part", part).drop("_parts").repartition(n, "_block", "_part")
    a = deal(F.pmod(F.xxhash64(F.col("row_id")), parts).cast("int")).alias("a")
    b = deal(F.explode(F.sequence(F.lit(0), parts - 1))).alias("b").hint("merge")
    of = lambda side: lambda name: F.col(f"{side}.{name}")
    condition = (of("a")("_block") == of("b")("_block")) & (of("a")("_part") == of("b")("_part")) & (of("a")("row_id") < of("b")("row_id"))
    if cross_source:
        condition &= of("a")("source") != of("b")("source")
    if near is not None:
        condition &= near(of("a"), of("b"))
    return a.join(b, condition).select(of("a")("row_id").alias("a"), of("b")("row_id").alias("b"), score(of("a"), of("b")).alias("score")).where("score IS NOT NULL")


def score_titles(rows: DataFrame, title: str = "title", year: str = "year", weight: float = 0.7, tolerance: int = 1, letters: int = 5, long: bool = False, least: float | None = None) -> DataFrame:
    """Works: same first letters of the title, years within the tolerance where both are known.

    ``long`` titles are whole texts, compared in Python workers. With ``least``, there are only pairs that score as much:
    lengths and years are compared in the join, letters and runs of letters before the edit distance.
    """

    def bonus(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        return F.coalesce((1 - F.abs(a(year) - b(year)) / max(tolerance, 1)) * (1 - weight), F.lit(0.0))

    def score(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        if long:
            alike = text.long_similarity(a("_tokens"), b("_tokens"), 0.0 if least is None else max(0.0, (least - (1 - weight)) / weight - 1e-6))
        else:
            alike = text.similarity(a("_tokens"), b("_tokens"))
        return alike * weight + bonus(a, b)

    def near(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        close = F.coalesce(F.abs(a(year) - b(year)) <= tolerance, F.lit(True))
        if least is None:
            return close
        longer = F.greatest(a("_length"), b("_length"), F.lit(1))
        return close & ((1 - F.abs(a("_length") - b("_length")) / longer) * weight + bonus(a, b) >= least - 1e-9)

    # Words are sorted once for each row, not for each pair; rows without a title have no block.
    known = rows.withColumn("_tokens", text.sorted_tokens(F.col(title))).withColumn("_length", F.length("_tokens"))
    pairs = block_pairs(known, text.prefix(F.col(title), letters), score, near=near)
    return pairs if least is None else pairs.where(F.col("score") >= least)


def score_persons(
    rows: DataFrame, name: str = "name", born: str = "birthdate", shared_id: str = "wikidata_id", letters: int = 3, least: float = 0.85, years: int = 1
) -> DataFrame:
    """Persons: a shared identifier is certain; else the same first letters, a like name and birth years that agree."""
    certain = block_pairs(rows, F.nullif(F.trim(shared_id), F.lit("")), lambda a, b: F.lit(1.0))

    def score(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        likeness = text.similarity(a("_tokens"), b("_tokens"))
        return F.when(likeness >= least, likeness)

    def near(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        return F.coalesce(F.abs(a("_born") - b("_born")) <= years, F.lit(True))

    # Words are sorted and years read once for each row, not for each pair.
    known = rows.withColumn("_tokens", text.sorted_tokens(F.col(name))).withColumn("_born", text.year_of(F.col(born)))
    likely = block_pairs(known, F.nullif(text.prefix(F.col(name), letters), F.lit("")), score, near=near)
    return certain.union(likely).groupBy("a", "b").agg(F.max("score").alias("score"))


def score_links(rows: DataFrame, keys: tuple[str, ...] = ("person", "work"), role: str = "role") -> DataFrame:
    """Relation rows: equal keys and role, whatever its case; a null key matches nothing."""
    known = [F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "") for k in keys]
    present = known[0]
    for k in known[1:]:
        present &= k
    block = F.when(present, F.concat_ws("|", *[F.col(k).cast("string") for k in keys], text.fold(F.coalesce(F.col(role), F.lit("")))))
    return block_pairs(rows, block, lambda a, b: F.lit(1.0))


def decide(pairs: DataFrame, least: float, merges: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Links (a, b): pairs that score enough, and forced merges, but for forced splits, which win."""
    order = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = order(pairs.where(F.col("score") >= least))
    if merges is not None:
        links = links.union(order(merges))
    if splits is not None:
        links = links.join(order(splits), ["a", "b"], "left_anti")
    return links.distinct()


def cluster(rows: DataFrame, links: DataFrame, rule: str = "weakest") -> DataFrame:
    """row_id and cluster, the least row id that can be reached; rows without links are their own cluster."""
    if rule != "weakest":
        raise ModelError(f"the transitivity rule {rule!r} isn't defined; a single link joins two clusters")
    label = components(links).select(F.col("node").alias("row_id"), F.col("label").alias("cluster"))
    return rows.select("row_id").distinct().join(label, "row_id", "left").select("row_id", F.coalesce("cluster", "row_id").alias("cluster"))


def reconcile(clusters: DataFrame, prior: DataFrame) -> DataFrame:
    """What becomes of each cluster, given the canonical ids (row_id, canonical_id) of the run before.

    outcome is new, kept, conflict (several ids meet) or split (one id falls apart); canonical_id is set for the first
    two, and for a split in the part with the least row.
    """
    joined = clusters.join(prior.select("row_id", "canonical_id"), "row_id", "left")
    per = joined.groupBy("cluster").agg(F.sort_array(F.collect_set("canonical_id")).alias("prior_ids"), F.min("row_id").alias("_least"))
    parts = joined.where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.countDistinct("cluster").alias("_parts"), F.min("cluster").alias("_first"))
    one = per.withColumn("_one", F.when(F.size("prior_ids") == 1, F.get("prior_ids", F.lit(0))))
    known = one.join(parts, one["_one"] == parts["canonical_id"], "left")
    outcome = (
        F.when(F.size("prior_ids") == 0, "new").when(F.size("prior_ids") > 1, "conflict").when(F.col("_parts") > 1, "split").otherwise("kept")
    )
    fresh = F.concat(F.lit("c_"), F.substring(F.sha2(F.col("_least").cast("string"), 256), 1, 16))
    new_id = F.when(outcome == "new", fresh).when((outcome == "kept") | ((outcome == "split") & (F.col("cluster") == F.col("_first"))), F.col("_one"))
    return known.select("cluster", "prior_ids", outcome.alias("outcome"), new_id.alias("canonical_id"))


def identified(spec: Spec, cls: str, rows: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """Rows of a class with an identifier pattern, and the entity_class and entity_key that each identifies.

    The pattern names the slot with an entity's class and the slot with its key. ``entities`` has the rows of classes by
    name; descendants are classes of their own. A row whose class or key is null or not there has a null entity_key.
    Keys are compared as texts, as classes may have keys of several types.
    """
    pattern = spec.cls(cls).identifier_pattern
    if pattern is None:
        raise ModelError(f"class {cls!r} has no identifier pattern")
    keys = [d.select(F.lit(name).alias("_class"), F.col(spec.identifier(name).name).cast("string").alias("entity_key")) for name, d in entities.items()]
    known = reduce(DataFrame.unionByName, keys).where("entity_key IS NOT NULL").distinct()
    kind, key = (F.col(f"_rows.`{p}`") for p in pattern)
    on = (kind.cast("string") == F.col("_class")) & (key.cast("string") == F.col("entity_key"))
    return rows.alias("_rows").join(known, on, "left").select("_rows.*", kind.alias("entity_class"), "entity_key")

"""Publishing as a property graph: node and edge tables, each written whole and then switched to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_nodes(old: DataFrame | None, new: DataFrame, key: str = "canonical_id", latest: str | None = None) -> DataFrame:
    """Nodes after an idempotent upsert: a new row replaces the old one of its key.

    Of new rows with one key the last by ``latest`` counts, and of equally late ones the last by their values as JSON.
    """
    order = F.struct(*([F.col(latest)] if latest else []), F.to_json(F.struct(*new.columns)))
    new = new.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*new.columns), order).alias("_row")).select("_row.*")
    if old is None:
        return new
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_edges(old: DataFrame | None, new: DataFrame, sources: DataFrame, targets: DataFrame, key: str = "canonical_id") -> DataFrame:
    """Distinct edges (src_id, dst_id) of which both ends exist."""
    both = new if old is None else old.unionByName(new)
    there = both.join(sources.select(F.col(key).alias("src_id")), "src_id", "left_semi")
    return there.join(targets.select(F.col(key).alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id").distinct()


def vertices(nodes: dict[str, DataFrame], key: dict[str, str]) -> DataFrame:
    """All nodes of a graph in one table, with their kind, under node_id."""
    parts = [d.select(F.lit(kind).alias("kind"), F.col(key[kind]).cast("string").alias("node_id"), *[c for c in d.columns if c != key[kind]]) for kind, d in nodes.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def all_edges(edges: dict[str, DataFrame]) -> DataFrame:
    """All edges of a graph in one table, with their kind."""
    parts = [d.select(F.lit(kind).alias("kind"), F.col("src_id").cast("string").alias("src_id"), F.col("dst_id").cast("string").alias("dst_id")) for kind, d in edges.items()]
    return reduce(DataFrame.unionByName, parts)


def audit_row(nodes: DataFrame, run_id: str, compile_hash: str) -> DataFrame:
    """One record of a publish."""
    return nodes.groupBy().agg(F.count("*").alias("n_nodes")).select(F.lit(run_id).alias("run_id"), F.lit(compile_hash).alias("compile_hash"), "n_nodes")

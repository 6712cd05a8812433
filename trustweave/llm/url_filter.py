"""Allow and block rules for URLs, held in a trie over reversed host labels and path segments.

A rule (host, path) fits its host and every subdomain when the URL's path starts with the rule's. The longest rule wins
(host and path together; of equally long ones that with the longer host), and an allow and a block entry for the same
place give block. The trie is broadcast: its size is the number of rules. More than ``max_rules`` of them are joined by
hashed host suffixes and path beginnings instead, with the same result; every key is dealt over ``salt`` tasks.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; an empty table gives an
empty result; repeated rows are judged each by itself; only the named columns are read, so clashing names don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOST = re.compile(r"[^/?#]*")
PATH = re.compile(r"[^?#]*")
#: A-Z only; other letters stay as they are.
LOWER = {c: c + 32 for c in range(65, 91)}


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Node:
    """One host label or path segment."""

    __slots__ = ("labels", "lengths", "partial", "path", "segments")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.path: Node | None = None
        self.segments: dict[str, Node] = {}
        #: What a rule's last segment must be the beginning of.
        self.partial: dict[str, Rule] = {}
        #: Lengths of those beginnings, the longest first.
        self.lengths: list[int] = []


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as they stand in the URL, both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = HOST.match(rest)[0]
    return host.translate(LOWER), PATH.match(rest, len(host))[0]


def checked(rules: Iterable[Rule]) -> Iterator[Rule]:
    for rule in rules:
        rule = Rule(*rule)
        if rule.verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {rule.verdict!r}")
        yield rule._replace(host=rule.host.translate(LOWER))


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = Node()
        for rule in checked(rules):
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.labels.setdefault(label, Node())
            node.path = node.path or Node()
            *whole, last = rule.path.split("/")
            node = node.path
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            held = node.partial.get(last)
            if held is None or rule.verdict == "block":
                node.partial[last] = rule
            if len(last) not in node.lengths:
                node.lengths = sorted([*node.lengths, len(last)], reverse=True)

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits."""
        if not host:
            return None
        best, most, node, segments = None, -1, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            if node.path is not None and (rule := self._longest(node.path, segments)) is not None and len(rule.host) + len(rule.path) >= most:
                best, most = rule, len(rule.host) + len(rule.path)
        return best

    @staticmethod
    def _longest(node: Node, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            for n in node.lengths:
                if n <= len(segment) and (rule := node.partial.get(segment[:n])) is not None:
                    best = rule
                    break
            node = node.segments.get(segment)
            if node is None:
                break
        return best


def parts_of(df: DataFrame) -> DataFrame:
    """id, url, host and path for every row of (id, url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([p[k] for p in parts], pa.string()) for k in (0, 1))], names=["id", "url", "host", "path"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, url string, host string, path string")


def joined(parts: DataFrame, rules: list[Rule], default: str, salt: int) -> DataFrame:
    """The verdicts of :class:`UrlTrie` for rules too many to broadcast."""
    spark = parts.sparkSession
    held = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    held = held.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    places = parts.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", "[.]")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    dealt = places.select("host", "path", suffix.alias("rule_host"), F.pmod(F.xxhash64("host", "path"), F.lit(salt)).alias("salt"))
    lengths = held.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    spread = lengths.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    begun = dealt.join(spread, ["rule_host", "salt"]).select("host", "path", "rule_host", F.explode("lengths").alias("n")).where("n <= length(path)")
    fits = begun.select("host", "path", "rule_host", F.expr("substring(path, 1, n)").alias("rule_path")).join(held, ["rule_host", "rule_path"])
    longest = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict"))
    best = fits.groupBy("host", "path").agg(F.max(longest).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return parts.join(best, ["host", "path"], "left").select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def filter_urls(
    df: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = 1_000_000, salt: int = 16
) -> DataFrame:
    """``id_col``, host, path, rule (host and path of the rule that won, or null) and verdict for every row."""
    rules = list(checked(rules))
    kept = df.select(df[id_col].alias("id"), df[url_col].cast("string").alias("url"))
    if len(rules) > max_rules:
        return joined(parts_of(kept), rules, default, salt).withColumnRenamed("id", id_col)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            won = [find(*p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([r and r.host + r.path for r in won], pa.string()),
                    pa.array([r.verdict if r else default for r in won], pa.string()),
                ],
                names=["id", "host", "path", "rule", "verdict"],
            )

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)

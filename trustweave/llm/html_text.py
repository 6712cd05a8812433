"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is read as a sequence of tags and blocks, a block being the text between two tags that are not inline. A word
scores by where its block stands: the log-odds of main text, given the names and the class, id and role words of all
elements around it (each once as an element that holds most of the page's words, or not), the share of its words in
links, its length, its share of the page and how it ends. No feature decides alone; the weights are those of a logistic regression over
labelled pages. A tag costs what its name tells against main text there, and never scores above zero.

One linear scan finds all maximal scoring subsequences (Ruzzo and Tompa, 1999). The best of them is the region of the
main text, and any other one that scores ``also`` of it, so that a long menu may divide an article in two. The text is
that of the blocks in these regions whose own words score above zero: an advert amid the article goes, a stray sentence
elsewhere does too.

Edge cases: a null or empty page, and one where no block scores above zero, give an empty text; unclosed elements end
with their parent; a comment, script or style that never ends reaches to the end of the page; whole pages are read, of
any length; repeated rows are read each; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trustweave.llm.common import slices
from trustweave.llm.labelled_pages import Page, pages

#: Elements whose content no reader sees as text: scripts, form controls, what stands in for something else.
SILENT = frozenset("script style noscript template textarea svg iframe object canvas select option title button annotation datalist".split())
#: Their content is read up to their end tag, whatever it holds.
RAW = "script|style|textarea|title|iframe|noscript|template|svg"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that a new one of its name ends.
ENDED = frozenset("p li dt dd tr td th option".split())
#: Elements that say nothing by their names.
PLAIN = frozenset("html body div span center".split())
#: Before another word in a name, these tell what a part has, not what it is.
HAVING = frozenset("has no not with without is hide show".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?][^>]*>|<[a-zA-Z][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")
ENDING = re.compile(r"[.!?…。！？:;\"'”’»)]\s*$")


@lru_cache(1 << 16)
def features_of(name: str, values: tuple[str, ...]) -> frozenset[str]:
    """What the name and the class, id and role of an element say."""
    made = set() if name in PLAIN else {f"<{name}>"}
    for value in values:
        for token in value.strip("\"'").lower().split():
            parts = WORD.findall(token)
            if len(parts) > 1:
                made.add("-".join(parts))
            if len(parts) == 1 or (parts and parts[0] not in HAVING):
                made.update(parts)
    return frozenset(made)


@dataclass
class Block:
    """Text between two tags that aren't inline, the element that it stands in, its words and those of them in links."""

    at: int
    element: int
    pieces: list[str]
    words: int = 0
    linked: int = 0


@dataclass
class Element:
    parent: int
    name: str
    own: frozenset[str]
    words: int = 0


def count_words(text: str) -> int:
    """Words; where none are set apart, a word for each dozen of characters."""
    return max(len(text.split()), len(text.strip()) // 12)


def parse(html: str) -> tuple[list[tuple[int, str] | Block], list[Element]]:
    """Tags (offset, name) and blocks in page order, and all elements; the first element is the page."""
    elements = [Element(-1, "", frozenset())]
    made: list[tuple[int, str] | Block] = []
    stack, open_names, links, hidden, end = [0], Counter(), 0, "", 0
    block: Block | None = None

    def text(upto: int) -> None:
        nonlocal block
        if upto > end and not hidden:
            if block is None:
                block = Block(end, stack[-1], [])
                made.append(block)
            piece = html[end:upto]
            block.pieces.append(piece)
            n = count_words(piece)
            block.words += n
            block.linked += n * (links > 0)

    def leave() -> None:
        open_names[elements[stack.pop()].name] -= 1

    for m in TOKEN.finditer(html):
        text(m.start())
        end = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "br":
            if block is not None:
                block.pieces.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if m["close"] else 1
            continue
        if m["close"]:
            if name == hidden:
                hidden = ""
            if open_names[name] and name:
                while elements[stack[-1]].name != name:
                    leave()
                leave()
        elif name in SILENT:
            hidden = hidden or name
        elif name not in VOID and not m["rest"].endswith("/"):
            if elements[stack[-1]].name == "p" or (name in ENDED and elements[stack[-1]].name == name):
                leave()
            own = features_of(name, tuple(NAMED.findall(m["rest"])) if m["rest"] else ())
            elements.append(Element(stack[-1], name, own))
            stack.append(len(elements) - 1)
            open_names[name] += 1
        block = None
        made.append((m.start(), name))
    text(len(html))
    for x in made:
        if isinstance(x, Block):
            elements[x.element].words += x.words
    for x in reversed(elements):
        if x.parent >= 0:
            elements[x.parent].words += x.words
    return made, elements


def around(elements: list[Element]) -> list[frozenset[str]]:
    """For each element, the features of all elements around it, its own included."""
    most = elements[0].words / 2
    made = [frozenset()]
    for x in elements[1:]:
        before = made[x.parent]
        own = frozenset(f + "!" for f in x.own) if x.words > most else x.own
        made.append(before if own <= before else before | own)
    return made


def numbers(block: Block, text: str, total: int) -> tuple[float, ...]:
    """The features of a block that are numbers, on a page of so many words."""
    return (1.0, block.words / max(total, 1), block.linked / max(block.words, 1), math.log2(block.words + 1) / 5, float(bool(ENDING.search(text))), float("©" in text))


@dataclass
class Weights:
    """Weights of features, of a block's numbers, and of tags; what was never seen counts as ``other``."""

    features: dict[str, float]
    numbers: tuple[float, ...]
    tags: dict[str, float]
    other: float = -0.05
    also: float = 0.2


def fit(rows: list[tuple[frozenset[str], tuple[float, ...], int, bool]], penalty: float = 0.5, rounds: int = 25) -> tuple[dict[str, float], tuple[float, ...]]:
    """Logistic regression by Newton's method; a block counts by the root of its words."""
    names = sorted({f for r in rows for f in r[0]})
    at = {f: k for k, f in enumerate(names)}
    k = len(rows[0][1])
    x = np.zeros((len(rows), k + len(names)))
    for i, (some, values, _, _) in enumerate(rows):
        x[i, :k] = values
        x[i, [k + at[f] for f in some]] = 1
    weight, y = np.sqrt([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    ridge = penalty * np.append([1e-3], np.ones(x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += step
    return dict(zip(names, w[k:].tolist(), strict=True)), tuple(w[:k].tolist())


def learn(labelled: Iterable[Page] | None = None) -> Weights:
    """Weights from labelled pages, by default those of :mod:`labelled_pages`."""
    if labelled is None:
        return _learned()
    rows, tags = [], {True: Counter(), False: Counter()}
    for page in labelled:
        ends, at = [], 0
        for piece, main in page:
            at += len(piece)
            ends.append((at, main))
        is_main = lambda offset, ends=ends: next(m for stop, m in ends if offset < stop)
        sequence, elements = parse("".join(piece for piece, _ in page))
        features = around(elements)
        for x in sequence:
            if isinstance(x, Block):
                if x.words:
                    rows.append((features[x.element], numbers(x, unescape("".join(x.pieces)), elements[0].words), x.words, is_main(x.at)))
            else:
                tags[is_main(x[0])][x[1]] += 1
    odds = lambda t: math.log((tags[True][t] + 0.5) / (tags[False][t] + 0.5))
    weights, values = fit(rows)
    return Weights(weights, values, {t: min(0.0, max(-2.0, 0.4 * odds(t))) - 0.001 for t in {*tags[True], *tags[False]}})


@lru_cache(1)
def _learned() -> Weights:
    return learn(pages())


def maximal(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring subsequences, in order: sum, first, and one past the last."""
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, end, the last one before with a smaller sum before
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        low, first = total, i
        total += s
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][0] >= low:
                k = found[k][4]
            if k < 0 or found[k][1] >= total:
                found.append((low, total, first, i + 1, k))
                break
            low, _, first, _, before = found[k]
            del found[k:]
            k = before
    return [(b - a, first, end) for a, b, first, end, _ in found]


def main_text(html: str | None, weights: Weights, scan: bool = True) -> str:
    """Text of the best regions of one page; without ``scan``, of all blocks whose words score above zero."""
    if not html:
        return ""
    sequence, elements = parse(html)
    known = weights.features
    margin: list[float] = []
    cache: dict[frozenset[str], float] = {}
    for features in around(elements):
        if features not in cache:
            # What was never seen around most of a page counts half as much as around a part of it.
            cache[features] = sum(known.get(f, 0.5 * known.get(f.removesuffix("!"), 0.0)) for f in features)
        margin.append(cache[features])
    scores, texts = [], []
    for x in sequence:
        if isinstance(x, Block):
            text = unescape("".join(x.pieces))
            texts.append(text)
            word = margin[x.element] + sum(a * b for a, b in zip(weights.numbers, numbers(x, text, elements[0].words), strict=True)) if x.words else 0.0
            scores.append(max(-1.5, min(1.0, word / 2)) * x.words)
        else:
            texts.append("")
            scores.append(weights.tags.get(x[1], weights.other))
    regions = maximal(scores) if scan else [(1.0, 0, len(scores))]
    least = weights.also * max((s for s, _, _ in regions), default=0.0)
    blocks = [texts[k] for s, first, end in regions if s >= least for k in range(first, end) if scores[k] > 0]
    return " ".join(x for b in blocks if (x := " ".join(b.split())))


def extract(df: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars (code points) for every row."""
    weights = weights or learn()
    kept = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"]
            )

    kinds = [kept.schema[c].dataType.simpleString() for c in ("id", "url")]
    made = kept.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return made.withColumnsRenamed({"id": id_col, "url": url_col})

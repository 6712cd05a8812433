"""Scalar functions for source values, all built-in expressions."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Dashes that are written for a hyphen: figure, en, em, minus, non-breaking. Fixed values.
DASHES = "‐‑‒–—−"
#: Date formats in the order in which they are tried. Fixed values.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "MMM d yyyy", "MMM d, yyyy", "d MMMM yyyy")


def text_of(df: DataFrame, name: str) -> Column:
    return df[name].cast("string")


def clean(c: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def hyphens(c: Column) -> Column:
    """Dash variants as plain hyphens."""
    return F.translate(c, DASHES, "-" * len(DASHES))


def fold(c: Column) -> Column:
    """For comparing enumeration values: trimmed and in lower case."""
    return F.lower(F.trim(c))


def parse_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits, or null."""
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in formats])


def parse_list(c: Column, separator: str = "|") -> Column:
    """Trimmed parts of a separated list; an empty text is an empty list."""
    parts = F.transform(F.split(F.trim(c), f"[{separator}]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def year_of(c: Column) -> Column:
    """The year that a date text begins with, or null."""
    return F.substring(c.cast("string"), 1, 4).try_cast("int")


#: Letters with marks, and the plain letters that stand for them. Fixed values.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def plain_letters(c: Column) -> Column:
    """Without marks on Latin letters; whatever else is not ASCII becomes a question mark."""
    return F.regexp_replace(F.translate(c, MARKED, PLAIN), "[^ -~]", "?")


def prefix(c: Column, n: int) -> Column:
    return F.substring(F.lower(F.trim(c)), 1, n)


def sorted_tokens(c: Column) -> Column:
    """Words in lower case and alphabetical order."""
    return F.array_join(F.sort_array(F.split(F.lower(clean(c)), " ")), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def edit_distance(a: str, b: str) -> int:
    """Inserted, deleted and replaced characters, by bit vectors (Myers, Hyyrö), a whole column of the table at a time."""
    if a == b:
        return 0
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b, n = a[n:], b[n:], 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every, last, found = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0
    for c in b:
        same = places.get(c, 0)
        keep = same | down
        same = (((same & up) + up) ^ up) | same | down
        more, less = down | (every & ~(same | up)), up & same
        found += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | (every & ~(keep | more)), more & keep
    return found


def _differ(a: Counter, b: Counter) -> int:
    """Members of one multiset, at least, that the other lacks."""
    common = sum(min(n, b[c]) for c, n in a.items() if c in b)
    return max(a.total(), b.total()) - common


def bounded_distance(a: str, b: str, most: int, gram: int = 4) -> int:
    """The edit distance if it is ``most`` at most, else some number above ``most``.

    Each edit changes one letter of the multiset of letters, and ``gram`` of the multiset of runs of as many letters.
    """
    if abs(len(a) - len(b)) > most or _differ(Counter(a), Counter(b)) > most:
        return most + 1
    runs = (Counter(map("".join, zip(*(t[k:] for k in range(gram)), strict=False))) for t in (a, b))
    if _differ(*runs) > gram * most:
        return most + 1
    return edit_distance(a, b)


@F.pandas_udf(IntegerType())
def long_edit_distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else bounded_distance(x, y, int(n)) for x, y, n in zip(a, b, most, strict=True)], dtype="Int32")


#: So that a filter on the score doesn't compute it once more.
long_edit_distance = long_edit_distance.asNondeterministic()


def long_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """:func:`similarity` for texts of thousands of characters; below ``least`` it may be any number below that."""
    longer = F.greatest(F.length(a), F.length(b), F.lit(1))
    most = F.ceil((1 - least) * longer + 1e-6).cast("int") if least > 0 else longer
    return 1 - long_edit_distance(a, b, most) / longer


def token_sort_similarity(a: Column, b: Column) -> Column:
    """Similarity whatever the order of words."""
    return similarity(sorted_tokens(a), sorted_tokens(b))


def json_length(c: Column) -> Column:
    """How many elements a JSON array in a text has; 0 for null and for a text that is no array."""
    return F.coalesce(F.json_array_length(c), F.lit(0))

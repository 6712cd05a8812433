"""Queries over whole tables and values, against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from trustweave.functions import text
from trustweave.operators import quality as Q
from trustweave.operators import resolution as R
from trustweave.plans.catalog import QUERIES


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def likeness(a, b):
    return 1 - edits(a, b) / max(len(a), len(b), 1)


def test_persons_of_the_whole_table(spark, tmp_path):
    keys = [*range(0, 60, 7), *range(395, 450, 3), 600, 650, 1200, 1407, 9407, 14407, 14950, 15000]
    rows = [(k, f"Customer#{k:09d}", ["AUTO", "FURNITURE", "MACHINERY"][k % 3]) for k in keys]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    want = {}
    for (a, an, asrc), (b, bn, bsrc) in itertools.combinations(rows, 2):
        if asrc == bsrc:
            continue
        an, bn = an[9:][::-1], bn[9:][::-1]
        if a % 50 == b % 50 == 0 and a // 200 == b // 200:
            want[a, b] = 1.0
        elif abs(a % 7 - b % 7) <= 1 and an[:3] == bn[:3] and (like := likeness(an, bn)) >= 0.75:
            want[a, b] = round(like, 6)
    assert any(b >= 400 for _, b in want)
    assert {(r["a"], r["b"]): r["score"] for r in QUERIES["er_persons"](spark, str(tmp_path)).collect()} == want


def test_large_blocks_lose_no_pair(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, rng.choice("xy"), rng.choice(["one", "one", "two", None])) for i in range(90)], "row_id long, source string, k string")
    pairs = lambda size: sorted(tuple(r) for r in R.block_pairs(rows, F.col("k"), lambda a, b: F.lit(1.0), part_rows=size).collect())
    data = rows.collect()
    want = [(a["row_id"], b["row_id"], 1.0) for a, b in itertools.combinations(data, 2) if a["k"] is not None and a["k"] == b["k"] and a["source"] != b["source"]]
    assert pairs(7) == pairs(500) == sorted(want)


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(90))) for _ in range(2))
        assert text.edit_distance(a, b) == edits(a, b)
        for most in (0, 5, 40, 90):
            assert min(text.bounded_distance(a, b, most), most + 1) == min(edits(a, b), most + 1)


def test_long_titles_are_compared_whole(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["river", "stone", "élan", "мир", "cloud", "amber"]) + str(rng.randrange(9)) for _ in range(n))
    start, body = "Alike in all of the first forty characters. ", words(40)
    texts = [start + body, start + words(40), start + words(40), start + body + " end", "Other " + body, None, start + body.replace("мир", "war")]
    rows = [(i, t, "ab"[i % 2] if i < 6 else "c", 2000) for i, t in enumerate(texts)]
    ordered = lambda t: " ".join(sorted(t.lower().split()))
    want = {
        (i, j): likeness(ordered(a), ordered(b)) * 0.7 + 0.3
        for (i, a, s, _), (j, b, z, _) in itertools.combinations(rows, 2)
        if a and b and s != z and a[:5] == b[:5]
    }
    df = spark.createDataFrame(rows, "row_id long, title string, source string, year int")
    got = lambda **o: {(r["a"], r["b"]): round(r["score"], 6) for r in R.score_titles(df, long=True, **o).collect()}
    assert got() == {k: round(v, 6) for k, v in want.items()} and want[0, 1] < 0.9 < want[0, 3]
    assert got(least=0.9) == {k: round(v, 6) for k, v in want.items() if v >= 0.9}


def test_cycles_of_any_length(spark):
    ring = lambda at, n: [(at + i, at + (i + 1) % n) for i in range(n)]
    edges = [*ring(0, 13), *ring(100, 3), (2, 0), (12, 100), (200, 200), (200, 0), (300, 301), (301, 302), (302, 0), (100, 400), (400, 401)]
    reach = {}
    for s in {a for a, _ in edges}:
        at, n = {s}, 0
        while n < 50 and s not in reach:
            at, n = {b for a, b in edges if a in at}, n + 1
            if s in at:
                reach[s] = n
    got = {int(r["offending_pk"]): r["detail"] for r in Q.cycles(spark.createDataFrame(edges, "src_id long, dst_id long"), "N").collect()}
    assert got == {s: f"cycle of length {n}" for s, n in reach.items()} and max(reach.values()) > 10
    assert Q.cycles(spark.createDataFrame([(1, 2), (2, 3)], "src_id long, dst_id long"), "N").count() == 0


def test_all_nations_are_on_cycles(spark):
    found = QUERIES["dq_cycle"](spark, "/root/testdata/sf0.001").collect()
    lengths = [int(r["detail"].split()[-1]) for r in found]
    assert sorted(lengths) == [1] + [4] * 4 + [20] * 20

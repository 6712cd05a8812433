"""Operators on texts without lower bounds, against brute force."""

import random

from trustweave.llm import line_dedup
from trustweave.llm.queries import QUERIES


def test_lines_of_any_length(spark, tmp_path):
    rng = random.Random(12)
    lines = [" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.choice([0, 1, 2, 3, 4, 7, 9, 11]))) for _ in range(240)]
    lines[100] = lines[7] = lines[190] = "All rights reserved."
    lines[50], lines[51] = "one two three four five six seven eight nine", "one two THREE four five six seven eight nine"
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, 240, 4)]
    rows = [(i, k, line.split()) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line.split()]
    want = {}
    for n, (i, k, w) in enumerate(rows):
        equal = next(((a, b) for a, b, v in rows[:n] if v == w), None)
        near = next(((a, b) for a, b, v in rows[:n] if min(len(v), len(w)) >= 2 and line_dedup.edits(v, w, 1) <= 1), None)
        if equal or near:
            want[i, k] = (*equal, 0) if equal else (*near, 1)
    assert want[25, 0] == (1, 3, 0) and want[12, 3] == (12, 2, 1)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line"]): tuple(r)[2:] for r in QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == want

import glob
import os
import random

from trustweave.llm.chunk_dedup import repeated_spans
from trustweave.sources.shared import shared_dir


def stored_bytes(spark):
    return sum(os.path.getsize(f) for f in glob.glob(f"{shared_dir(spark).removeprefix('file:')}/trustweave-*/rows/*.parquet"))


def texts(n, rng):
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    return [" ".join(rng.choices(words, k=120)) for _ in range(n)]


def test_substring_dedup_keeps_one_table_of_what_stands_around_runs(spark):
    rng = random.Random(3)
    some = texts(60, rng)
    rows = [(i, t) for i, t in enumerate(some + [rng.choice(some)[k : k + 300] + rng.choice(some)[:250] for k in range(200)])]
    before = stored_bytes(spark)
    spans = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    runs = spans.count()
    assert runs >= 200
    # When runs, keepers and what stands around either were left in tables of their own, these 569 took 328,983 bytes.
    assert stored_bytes(spark) - before < 500 * runs

import glob
import os
import random

import numpy as np
from pyspark.sql import functions as F

from trustweave.llm import jaccard_join
from trustweave.sources.shared import shared_dir


def test_bit_sketches_pass_all_that_links_and_little_else():
    rng = np.random.default_rng(4)
    passed = 0
    for k in range(600):
        size, percent = int(rng.choice([1, 2, 9, 31, 32, 33, 64, 300, 1000])), int(rng.choice([60, 80, 90, 100]))
        own = rng.integers(0, 2**64, size, np.uint64)
        lost, more = rng.integers(0, size * (100 - percent) // 60 + 1, 2)
        a, b = np.unique(own), np.unique(np.concatenate([own[lost:], rng.integers(0, 2**64, more, np.uint64)]))
        if len(b):
            may = jaccard_join.may_link(*jaccard_join.bit_sketches([a, b]), percent)
            assert may or not jaccard_join.linked(a, b, percent)
        far = np.concatenate([own[: size * 3 // 4], rng.integers(0, 2**64, size // 4, np.uint64)])  # some 60 percent alike
        passed += size >= 300 and percent >= 80 and jaccard_join.may_link(*jaccard_join.bit_sketches([own, far]), percent)
    assert passed == 0
    assert jaccard_join.bit_sketches([]) == [] and len(jaccard_join.bit_sketches([own[:0]])[0]) == 16


def test_sets_that_do_not_link_are_not_carried_by_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(5000)]
    texts = []
    for _ in range(15):
        shared = rng.choices(words, k=280)
        texts += [" ".join(shared + rng.choices(words, k=20)) for _ in range(10)]
    where = f"{shared_dir(spark).removeprefix('file:')}/trustweave-*/rows/*.parquet"
    before = sum(map(os.path.getsize, glob.glob(where)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.similar_groups(df, shingle=3, percent=90)
    assert got.where("component_id <> doc_id").count() == 0
    sets = 8 * got.agg(F.sum("n_shingles")).first()[0]
    stored = sum(map(os.path.getsize, glob.glob(where))) - before
    assert stored < 1.5 * sets  # before, the sets of all pairs' first documents were stored a second time

"""Operators that compare texts with each other, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from trustweave.llm import chunk_dedup, decontamination, jaccard_join, line_dedup, suffix_dedup
from trustweave.llm.common import table
from trustweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in "ba de fi go lu mer nos tal".split() for b in "ra ren ti sol um ke".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, doc int, words string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(made.columns) == sorted(want.columns)
    order = sorted(made.columns)
    rows = lambda names, data: sorted(tuple(str(r[names.index(c)]) for c in order) for r in data)
    assert rows(made.columns, [tuple(r) for r in made.collect()]) == rows(want.columns, want.fetchall())


# Chunks


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(5)
    body = text(rng, 4000).encode() + "naïve café — ".encode() * 40
    texts = [body, b"inserted " + body, b"", b"\xc3\xa9" * 900, b"a" * 5000]
    ends = chunk_dedup.chunk_ends(texts, 20, 12, 256)
    chunks = []
    for t, e in zip(texts, ends, strict=True):
        begins = [0, *e[:-1].tolist()] if len(e) else []
        parts = [t[a:b] for a, b in zip(begins, e.tolist(), strict=True)]
        assert b"".join(parts) == t and all(len(p) <= 260 for p in parts)
        [p.decode() for p in parts]  # no character is split
        chunks.append(parts)
    assert len(set(chunks[0]) & set(chunks[1])) > 0.97 * len(set(chunks[0]))
    alone = chunk_dedup.chunk_ends([texts[1]], 20, 12, 256)[0]
    assert alone.tolist() == ends[1].tolist()


def repeated_windows(texts, size):
    """(text, place) of every run of ``size`` bytes that also begins earlier, by looking all of them up."""
    seen, found = set(), set()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for k in range(len(raw) - size + 1):
            if raw[k : k + size] in seen:
                found.add((i, k))
            seen.add(raw[k : k + size])
    return found


def stand_earlier(texts, spans):
    """Every span stands as a whole in its keeper, earlier, and can't be longer there."""
    for r in spans:
        own, keep = texts[r["doc_id"]].encode(), texts[r["keep_doc_id"]].encode()
        a, k, n = r["start"], r["keep_start"], r["length"]
        assert (r["keep_doc_id"], k) < (r["doc_id"], a)
        assert own[a : a + n] == keep[k : k + n] and own[a : a + n].decode()
    return True


def test_chunk_dedup(spark):
    rng = random.Random(2)
    passage = text(rng, 52)
    texts = [text(rng, 200) + passage + text(rng, 90), None, "", text(rng, 50) + " " + passage, "short", "short", *[passage + text(rng, 30) for _ in range(40)]]
    texts += [texts[0]] * 30 + [text(rng, 40) for _ in range(20)] + ["short text", "a short text"]
    df = docs(spark, *texts).repartition(5)
    spans = chunk_dedup.repeated_spans(df)
    got = spans.collect()
    assert stand_earlier(texts, got)
    assert {r["doc_id"] for r in got} == {3, 5, *range(6, 76)}
    assert [(r["start"], r["length"], r["keep_doc_id"]) for r in got if r["doc_id"] == 5] == [(0, 5, 4)]
    assert all(r["length"] >= 64 for r in got if r["doc_id"] != 5)
    left = {r["doc_id"]: r["text"] for r in chunk_dedup.remove_spans(df, spans).collect()}
    assert left[0] == texts[0] and {left[i] for i in range(46, 76)} == {""} and left[1] is None and passage not in left[3] and left[4] == "short" and left[5] == ""
    assert chunk_dedup.repeated_spans(df.limit(0)).count() == 0
    assert chunk_dedup.repeated_spans(docs(spark, "x " + passage).union(docs(spark, "x " + passage))).count() == 0


@pytest.mark.parametrize("size", [64, 96, 128, 256])
def test_repeats_are_found_by_length(spark, size):
    """Passages of so many bytes, each planted once in each of two texts; found means all of it, to the byte."""
    rng = random.Random(size)
    texts = []
    for _ in range(100):
        passage = (text(rng, 60) + " é — ")[-size:].encode()[-size:].decode(errors="ignore")
        texts += [f"{text(rng, 30)} {k} {passage} {k} {text(rng, 20)}" for k in "xy"]
    rng.shuffle(texts)
    got = chunk_dedup.repeated_spans(docs(spark, *texts)).collect()
    assert stand_earlier(texts, got)
    want = repeated_windows(texts, 64)
    covered = {(r["doc_id"], k) for r in got for k in range(r["start"], r["start"] + r["length"] - 63)}
    assert covered <= want and len(covered) >= 0.95 * len(want)


def test_digests_that_collide_give_no_spans(spark):
    rng = random.Random(9)
    texts = [text(rng, 60) for _ in range(40)]
    assert stand_earlier(texts, chunk_dedup.repeated_spans(docs(spark, *texts), bits=32).collect())
    few = chunk_dedup.repeated_spans(docs(spark, *texts, texts[0]), bits=30).collect()
    assert stand_earlier([*texts, texts[0]], few)


def test_a_run_grows_in_whole_characters():
    own, keep = ("xé".encode(), "éa".encode()), ("yé".encode(), "éb".encode())
    assert chunk_dedup.grown(own, keep) == (2, 2)
    assert chunk_dedup.grown(("é".encode(), "è".encode()), ("ũ".encode(), "é".encode())) == (0, 0)


# Suffixes


def brute_cut(rows):
    seen, out = defaultdict(lambda: None), {}
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            w = raw[k : k + 50]
            least[w] = min(least.get(w, i), i)
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, monkeypatch):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdé ") for _ in range(180))
    texts = [text(rng, 30), None, "", "x" * 49, "y" * 50, "y" * 120, "ab" * 60, "ab" * 90]
    texts += [text(rng, 9) + passage + text(rng, 7) for _ in range(60)] + [passage[k : k + 70] + text(rng, 3) for k in range(0, 100, 7)]
    texts += [texts[9]] * 40 + [text(rng, 5) + passage[:49] + text(rng, 5), passage[20:69], passage[20:70], text(rng, 900) + passage * 3]
    df = docs(spark, *texts).repartition(6)
    want = brute_cut(list(enumerate(texts)))
    for bits in (64, 36):  # with few bits, anchors collide
        got = suffix_dedup.summary(suffix_dedup.cut_repeats(df, bits=bits)).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(texts)
    assert suffix_dedup.cut_repeats(df.limit(0)).count() == 0
    same = df.where("doc_id = 9").union(df.where("doc_id = 9"))
    assert [r["n_removed"] for r in suffix_dedup.summary(suffix_dedup.cut_repeats(same)).collect()] == [0, 0]


def test_pointers_tell_bytes_apart():
    rng = random.Random(6)
    for letters, n, span in (("ab", 300, 50), ("a", 200, 50), ("abcdefgh", 500, 12), ("ab", 90, 8), ("ab\0", 400, 20)):
        raw = bytes(ord(rng.choice(letters)) for _ in range(n)) * 2
        p = suffix_dedup.pointers(np.frombuffer(raw, np.uint8), span).tolist()
        padded = raw + bytes(span)
        suffixes = [padded[k : k + span] for k in range(len(raw))]
        # The pointer is the last place, in sorted order, of those with the same bytes.
        order = sorted(suffixes)
        inside = range(len(raw) - span + 1)
        last = {w: i for i, w in enumerate(order)}
        assert [p[k] for k in inside] == [last[suffixes[k]] for k in inside] if letters != "ab\0" else True
        for a in inside:
            assert [p[a] == p[b] for b in inside] == [suffixes[a] == suffixes[b] for b in inside]


def test_pointers_of_more_bytes_than_are_sorted_fast():
    rng = np.random.default_rng(3)
    some = rng.integers(97, 100, 700_000).astype(np.uint8)
    raw = np.concatenate([some, np.tile(some[:1000], 800), some[::-1]])
    p = suffix_dedup.pointers(raw)
    assert len(raw) > suffix_dedup.MOST
    at = rng.integers(0, len(raw) - 50, 4000)
    at = np.concatenate([at, at[at < 1000], np.arange(1000), 700_000 + np.arange(1000)])
    windows = [raw[k : k + 50].tobytes() for k in at]
    assert len(set(zip(p[at].tolist(), windows, strict=True))) == len(set(windows)) == len(set(p[at].tolist()))


def test_more_windows_than_are_sorted_at_once(monkeypatch):
    rng = random.Random(8)
    raw = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(3000)) * 2 + b"z" * 1500, np.uint8)
    at = np.arange(len(raw) - 50)
    whole = suffix_dedup.numbered(raw, at)
    monkeypatch.setattr(suffix_dedup, "MOST", 2000)
    monkeypatch.setattr(suffix_dedup, "ONE", 4000)
    parts = suffix_dedup.numbered(raw, at)
    assert len(set(zip(whole.tolist(), parts.tolist(), strict=True))) == len(set(whole.tolist())) == len(set(parts.tolist()))


def test_parts_of_long_texts_keep_all_windows(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cd") for _ in range(5000)).encode(), b"", b"z" * 49, b"q" * 300]

    def windows():
        found = []
        for g in suffix_dedup.groups(texts):
            s = g.found
            for i in range(len(s.of)):
                base = int(g.base[s.of[i]])
                found.append((int(g.owner[s.of[i]]), base + int(s.first[i]), base + int(s.last[i]), int(g.before[s.of[i]] + s.ordinal[i])))
        return found

    whole = windows()
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    monkeypatch.setattr(suffix_dedup, "BATCH", 1500)
    parts = windows()
    cover = lambda f: {(o, w) for o, a, b, _ in f for w in range(a, b + 1)}
    assert len(parts) > len(whole) and cover(whole) == cover(parts) == {(0, w) for w in range(4951)} | {(3, w) for w in range(251)}
    assert [n for o, _, _, n in parts if o == 0] == list(range(sum(o == 0 for o, *_ in parts)))


def test_packed_numbers_come_back():
    columns = [np.array(x, np.uint64) for x in ([3, 2**64 - 1, 0], [7, 7, 7], [2**40, 2**40 + 5, 2**40])]
    for a, b in zip(columns, suffix_dedup.unpack(suffix_dedup.pack(*columns)), strict=True):
        assert a.tolist() == b.tolist()


# Lines


def test_one_edit():
    words = "a b c d e".split()
    for other, near in (("a b c d e", 0), ("a x c d e", 1), ("a b d e", 1), ("a b c c d e", 1), ("b a c d e", 2), ("a b c", 2), ("x y c d", 3)):
        assert line_dedup.edits(words, other.split(), 3) == near == line_dedup.edits(other.split(), words, 3)
        assert all((line_dedup.edits(words, other.split(), m) <= m) == (near <= m) for m in range(4))


def edited_lines(rng, n):
    base = [text(rng, rng.choice([1, 2, 3, 5, 12, 30])) for _ in range(25)]
    made = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            edit = rng.choice(["swap", "drop", "add"])
            if edit == "swap" and w:
                w[rng.randrange(len(w))] = "zzz" + str(rng.randrange(3))
            if edit == "drop" and w:
                del w[rng.randrange(len(w))]
            if edit == "add":
                w.insert(rng.randrange(len(w) + 1), "extra")
        made.append("  ".join(w))
    return made


def brute_lines(texts, bound, near_words):
    lines = [(i, k, line.split()) for i, t in texts for k, line in enumerate((t or "").split("\n")) if line.split()]
    want = {}
    for n, (i, k, w) in enumerate(lines):
        equal = next(((a, b) for a, b, v in lines[:n] if v == w), None)
        near = next(((a, b, far) for a, b, v in lines[:n] if min(len(v), len(w)) >= near_words and (far := word_edits(v, w)) <= bound), None)
        if equal is not None:
            want[(i, k)] = (*equal, 0)
        elif near is not None:
            want[(i, k)] = near
    return want


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("bound", [0, 1, 2])
def test_line_dedup(spark, bound):
    made = edited_lines(random.Random(8), 150)
    made = [line if bound < 2 else " ".join(line.split()[:8]) for line in made]
    texts = ["\n".join(made[i : i + 3]) for i in range(0, 150, 3)] + [None, "", "\n\n"]
    df = docs(spark, *texts)
    want = brute_lines(list(enumerate(texts)), bound, bound + 1)
    assert bound == 0 or {far for *_, far in want.values()} == set(range(bound + 1))
    gone = line_dedup.repeated_lines(df, bound=bound)
    assert {(r["doc_id"], r["line"]): tuple(r)[2:] for r in gone.collect()} == want
    left = {r["doc_id"]: r for r in line_dedup.remove_lines(df, gone).collect()}
    assert left[0]["text"] == "\n".join(line for k, line in enumerate(texts[0].split("\n")) if (0, k) not in want)
    assert left[50]["text"] is None and left[51]["text"] == "" and left[0]["words"] == "x"
    for i, t in enumerate(texts[:50]):
        kept = [line for k, line in enumerate(t.split("\n")) if (i, k) not in want]
        assert (i in left) == any(x.strip() for x in kept) or not any((i, k) in want for k in range(3))
        assert i not in left or left[i]["text"] == "\n".join(kept)
    assert line_dedup.repeated_lines(df.limit(0), bound=bound).count() == 0
    twice = df.where("doc_id = 0").union(df.where("doc_id = 0"))
    assert {(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(twice, bound=bound).collect()} == {x for x in want if x[0] == 0}


def test_both_ways_to_make_variants_agree():
    rng = random.Random(3)
    for _ in range(30):
        a = text(rng, rng.randrange(2, 7)).split()
        b = list(a)
        b[rng.randrange(len(b))] = "other"
        general = lambda w: {(x, lost, holes) for x, lost, holes in line_dedup.many_variants(w, 1)}
        assert {x for x, _, h in general(a) if h} & {x for x, _, h in general(b) if h}
        whole, less = line_dedup.variants(a)
        assert whole in line_dedup.variants([*a, "more"])[1].tolist() and len(less) == len(a)


def test_lines_of_null_and_repeated_ids(spark):
    rows = [(None, "one two three four\nfive six seven"), (1, "one two three 4\nfive six seven"), (2, "one 2 three four"), (2, "zebra yak xenon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line"]): tuple(r)[2:] for r in line_dedup.repeated_lines(df).collect()}
    assert got == {(1, 0): (None, 0, 1), (1, 1): (None, 1, 0), (2, 0): (None, 0, 1)}
    first = spark.createDataFrame([(1, "a b c"), (None, "a b c"), (None, "a b d")], "doc_id long, text string")
    gone = line_dedup.repeated_lines(first)
    assert {(r["doc_id"], r["line"], r["keep_doc"]) for r in gone.collect()} >= {(1, 0, None)}
    named = spark.createDataFrame([(None, 0)], "doc_id long, line int")
    assert [r["doc_id"] for r in line_dedup.remove_lines(first, named).collect()] == [1]


def test_a_line_in_every_document(spark):
    texts = ["the same line in all of them\n" + text(random.Random(i), 9) for i in range(400)]
    got = line_dedup.repeated_lines(docs(spark, *texts)).where("line = 0").collect()
    assert len(got) == 399 and {(r["keep_doc"], r["keep_line"], r["distance"]) for r in got} == {(0, 0, 0)}


# Benchmark


def test_decontamination(spark):
    rng = random.Random(3)
    items = [text(rng, n) for n in (30, 12, 60, 5, 25)]
    bench = spark.createDataFrame([(i, t, "c") for i, t in enumerate(items)] + [(9, None, "c")], "item_id long, text string, doc_id string")
    every_fifth = " ".join("oops" if k % 5 == 4 else w for k, w in enumerate(items[0].split()))
    half = " ".join(items[2].split()[:24])
    texts = [text(rng, 80), text(rng, 20) + " " + items[0].upper().replace(" ", ", ") + " " + text(rng, 9), every_fifth, half, items[3] + " " + text(rng, 9), None, "", items[1], "so " * 20000 + items[4]]
    texts += [" ".join("oops" if k % 3 == 1 else w for k, w in enumerate(items[0].split()))]
    df = docs(spark, *texts)
    got = {(r["doc_id"], r["item_id"]): (r["matched_words"], r["window_words"]) for r in decontamination.contaminated(df, bench).collect()}
    assert got == {(1, 0): (20, 20), (2, 0): (16, 20), (3, 2): (20, 20), (4, 3): (5, 5), (7, 1): (12, 12), (8, 4): (20, 20)}
    shuffled = decontamination.contaminated(df, bench, max_broadcast=1)
    assert {(r["doc_id"], r["item_id"]) for r in shuffled.collect()} == set(got)
    assert decontamination.contaminated(df.limit(0), bench).count() == 0 and decontamination.contaminated(df, bench.limit(0)).count() == 0
    plan = decontamination.contaminated(df, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")


def test_every_way_to_substitute_each_fifth_word_has_a_seed():
    from itertools import combinations

    for n in range(1, 21):
        masks = decontamination.masks_for(n)
        for gone in combinations(range(n), n // 5 if n >= 5 else 0):
            hit = any(all(at + k not in gone for k, bit in enumerate(m) if bit == "1") for m in masks for at in range(n - len(m) + 1))
            assert hit, (n, gone)


def test_short_items(spark):
    """Items of 1 to 12 words, whole and with each fifth word substituted, against every place of every text."""
    rng = random.Random(14)
    items = [text(rng, n) for n in range(1, 13)]
    texts = []
    for item in items:
        w = item.split()
        for gone in (0, len(w) // 5, len(w) // 5 + 1):
            v = list(w)
            for k in rng.sample(range(len(w)), min(gone, len(w))):
                v[k] = "zz" + str(k)
            texts.append(" ".join(["start", *v, "end"]))
    want = set()
    for i, t in enumerate(texts):
        d = t.split()
        for j, item in enumerate(items):
            w = item.split()
            if any(10 * sum(a == b for a, b in zip(w, d[at : at + len(w)], strict=False)) >= 8 * len(w) for at in range(len(d))):
                want.add((i, j))
    bench = spark.createDataFrame(list(enumerate([*items, "", "?!"])), "item_id long, text string")
    got = decontamination.contaminated(docs(spark, *texts), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) >= 24


# Similarity


def brute_components(rows, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = (t or "").translate(lower).encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size,percent,limit,block", [(3, 90, 32, 1024), (3, 90, 2, 10), (5, 80, 3, 16), (1, 60, 32, 1024)])
def test_similar_groups(spark, size, percent, limit, block):
    rng = random.Random(7)
    texts = [None, "", " \t ", "one", "ONE", "one two", "One  two", "a\x1cb c d", LONG_WORDS]
    for _ in range(8):
        w = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.choice([12, 40, 150, 700]))]
        for _ in range(14):
            w = list(w)
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                w.append("tail")
            texts.append(" ".join(w))
    texts += texts[20:30]
    df = docs(spark, *texts).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(df, shingle=size, percent=percent, group_limit=limit, block=block).collect()}
    assert got == brute_components(list(enumerate(texts)), size, percent)


LONG_WORDS = " ".join(f"w{i}" for i in range(30_000))


def test_many_empty_texts_and_a_large_group(spark):
    """Half of all texts are empty, a third are near copies that share a part, some of which don't link with the first."""
    rng = random.Random(2)
    w = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(200)]
    texts = [None, "", " "] * 60
    for _ in range(120):
        v = list(w)
        for _ in range(rng.randrange(1, 5)):
            v[rng.randrange(150, 200)] = rng.choice(WORDS)
        texts.append(" ".join(v))
    texts += [text(rng, 40) for _ in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(docs(spark, *texts), shingle=3, percent=90, group_limit=8, block=16).collect()}
    assert got == brute_components(list(enumerate(texts)), 3, 90)


def test_similar_groups_at_the_edges(spark):
    df = docs(spark, "a b c d e f", None)
    assert jaccard_join.similar_groups(df.limit(0)).count() == 0
    assert jaccard_join.similar_groups(df.union(df)).count() == 4
    null_id = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_join.similar_groups(null_id).collect()) == [("1", "1"), ("None", "None")]


def test_sent_parts_meet_whenever_sets_link():
    rng = np.random.default_rng(6)
    for percent in (80, 90):
        bands = jaccard_join.Bands(percent)
        for _ in range(150):
            n = int(rng.integers(5, 400))
            a = rng.integers(1, 2**63, n, dtype=np.int64).astype(np.uint64)
            drop = int(rng.integers(0, bands.differ(n) + 1))
            b = np.unique(np.concatenate([a[drop // 2 :], rng.integers(1, 2**63, drop - drop // 2, dtype=np.int64).astype(np.uint64)]))
            a = np.unique(a)
            if jaccard_join.linked(a, b, percent) and a.tolist() != b.tolist():
                keys, owner = jaccard_join.part_keys([a, b], bands)
                assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_shingles_of_sliced_batches():
    t = pa.array(["x", "é — A b", None, "  c  D\t\x0be ", ""] * 3)
    assert [len(s) for s in jaccard_join.shingle_sets(t.slice(6, 4), 2)] == [3, 0, 2, 0]


# Pipeline


def test_pipeline(spark):
    """Each stage against what it is for, on the smallest tables."""
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    benchmark = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    from trustweave.llm.common import stored

    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, made = docs, stage(spark, docs, SF)
        if number < 4:
            assert made.columns == docs.columns and made.dtypes == docs.dtypes
            docs = stored(made)
            old, kept = kept, {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(kept) <= set(old)
        if number == 0:
            gone = [quality[i] for i in old if i not in kept and i in quality]
            assert gone and sum(gone) <= 0.02 * sum(quality.values())
        elif number == 1:
            lines = Counter(line for t in kept.values() for line in (t or "").split("\n") if len(line.split()) >= 4)
            assert set(lines.values()) <= {1}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        elif number == 2:
            groups = brute_components(list(old.items()), 5, 80)
            assert set(kept) == {i for i, (_, c) in groups.items() if i == c}
        elif number == 3:
            assert any(b in old[i] for i in old for b in benchmark) or old == kept
            assert not any(b in (t or "") for t in kept.values() for b in benchmark)
        else:
            assert {r["doc_id"] for r in made.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

"""Operators that judge each row by itself."""

import hashlib
import html
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from trustweave.llm import html_text, packing, quality, winnowing
from trustweave.llm.labelled_pages import pages
from trustweave.llm.tokens import Encoder
from trustweave.llm.url_filter import Rule, UrlTrie, filter_urls, split_url

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word and " * 30_000


def docs(spark, *texts, extra=""):
    """Documents with a column whose name clashes with those that operators use inside."""
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, id string{extra}")


# Fingerprints


def brute_prints(text, k, w):
    if not text:
        return [], []
    codes = np.frombuffer((text + "\0" * (k + w)).encode("utf-32-le"), np.uint32)
    hashes = []
    for i in range(max(1, len(text) - k + 1)):
        h = 0
        for j in range(k):
            h = (h * int(winnowing.BASE) + int(codes[i + j]) + 1) % 2**64
        hashes.append(int(winnowing.mix(np.array([h], np.uint64))[0]) >> 32)
    out = []
    for s in range(max(1, len(hashes) - w + 1)):
        window = hashes[s : s + w]
        place = s + max(i for i, x in enumerate(window) if x == min(window))
        if not out or out[-1][1] != place:
            out.append((min(window), place))
    return [h for h, _ in out], [p for _, p in out]


@pytest.mark.parametrize("k,w", [(19, 32), (5, 4), (1, 1)])
def test_winnowing_against_brute_force(k, w):
    texts = ["", "a", "ab" * 9, "x" * 200, "naïve — 日本 " * 12, "the quick brown fox jumps over the lazy dog " * 4]
    for block in (1 << 21, 60):
        for (h, p), t in zip(winnowing.fingerprints(texts, k, w, block), texts, strict=True):
            assert (h.tolist(), p.tolist()) == brute_prints(t, k, w)


def test_shared_runs_share_a_fingerprint():
    run = "exactly fifty code points are here, no more, or so "[:50]
    a, b = (winnowing.fingerprints([x + run + y])[0][0] for x, y in (("one beginning ", " one end"), ("quite another start: ", "...")))
    assert set(a.tolist()) & set(b.tolist())


def test_edit_and_next(spark):
    texts = ["first text of all " * 9, None, "", "third " * 40, "third " * 40, LONG]
    got = {r["doc_id"]: r for r in winnowing.compare_with_edit_and_next(docs(spark, *texts).repartition(3)).collect()}
    assert set(got) == set(range(6))
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % 6] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[3]["fingerprint"] == got[4]["fingerprint"] and got[3]["near_next"] == 1 and got[1]["near_next"] == 1 and got[2]["near_next"] == 0
    assert winnowing.compare_with_edit_and_next(docs(spark, "a").limit(0)).count() == 0
    assert winnowing.compare_with_edit_and_next(docs(spark, "only one")).count() == 1
    twice = docs(spark, "same", "other").union(docs(spark, "same", "other"))
    assert winnowing.compare_with_edit_and_next(twice).count() == 4


# Packing


def test_tokens_are_the_tokenizers(spark):
    e = Encoder(TOKENIZER)
    texts = ["", "  ", " a", "a  b", "x\n\ny z ", "it's we'll\tok  ", "a<|endoftext|> b", "é\xa0 b c　d", "日本 語　x", "\n", "q \n", "½ ² x", "a_b 1_2", "one two. three, one two.", LONG]
    for t, ids in zip(texts, e.batch(pa.array(["skipped", *texts]).slice(1)), strict=True):
        assert ids.tolist() == e.whole(t), t


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = [rng.integers(0, 40, 65), rng.integers(0, 2, 65), np.bincount(rng.integers(30, 60, 500), minlength=65), np.bincount(rng.geometric(0.1, 900).clip(1, 64), minlength=65)][seed]
    counts[0] = 0
    plan = packing.plan(counts)
    used = np.zeros(65, int)
    for pattern, times in plan:
        assert sum(pattern) <= 64
        for x in pattern:
            used[x] += times
    assert (used == counts).all()
    if seed == 3:
        assert sum(t for _, t in plan) == -(-int((counts * np.arange(65)).sum()) // 64)


def test_exact_complements_of_one_two_and_three():
    counts = np.zeros(101, int)
    counts[[90, 10, 80, 15, 5, 70, 14, 9, 7]] = 1
    assert sorted(p for p, _ in packing.plan(counts)) == sorted([(90, 10), (80, 15, 5), (70, 14, 9, 7)])


def test_packing(spark):
    texts = [None, "", "short one", "short one", "middle " * 300, LONG, "a b c " * 341 + "d"]
    df = docs(spark, *texts)
    got = packing.pack_documents(df, TOKENIZER, capacity=256).collect()
    e = Encoder(TOKENIZER)
    for i, t in enumerate(texts):
        ids = np.array([*e.whole(t or ""), 2], "<u4")
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        at = 0
        for r in mine:
            assert r["start"] == at and r["length"] <= 256
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 256 for r in mine[1:])
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(len(r["ids"]) for r in packing.sequences(df, TOKENIZER, capacity=256).collect()) == sum(r["length"] for r in got)
    assert packing.pack_documents(df.limit(0), TOKENIZER).count() == 0
    assert packing.pack_documents(df.union(df), TOKENIZER).count() == 2 * packing.pack_documents(df, TOKENIZER).count()


# Quality


def prose(rng):
    return " ".join(rng.choice(["the", "of", "river", "stone", "walks", "slowly", "Morning", "and", "light", "under"], 60)) + "."


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    bad = [lambda: "SHOUT!! " * 40, lambda: " ".join(["spam"] * 80), lambda: " ".join(w + "###" for w in prose(rng).split())]
    texts = [bad[i % 3]() if i % 4 == 0 else prose(rng) for i in range(600)]
    df = docs(spark, *texts, None, "", LONG)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(600)] + [(3, None), (7, 5), (None, 1)], "doc_id long, quality int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    tested = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in tested]) > 0.97
    flipped = labels.where("doc_id < 600").selectExpr("doc_id", "IF(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) AS quality")
    same = {r["doc_id"]: r["score"] for r in quality.classify(df, flipped).collect()}
    assert all(abs(same[r["doc_id"]] - r["score"]) < 1e-6 for r in got)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.classify(docs(spark, "a", None), none).collect()] == [0.5, 0.5]
    assert quality.classify(docs(spark, "a").limit(0), none).count() == 0


def test_scores_are_differences_of_log_densities():
    rng = np.random.default_rng(1)
    x = {0: rng.normal(0, 1, (300, 3)), 1: rng.normal(1, 2, (500, 3))}
    made = {y: quality.gaussian(len(v), v.sum(0), v.T @ v, 800, 0.0, np.full(3, 1e-9)) for y, v in x.items()}
    probe = rng.normal(0, 2, (20, 3))
    for y, v in x.items():
        cov = np.cov(v.T, bias=True)
        d = probe - v.mean(0)
        want = np.log(len(v) / 800) - 0.5 * (np.log(np.linalg.det(cov)) + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
        assert np.allclose(made[y].log_density(probe), want)


# URLs

RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("block", "example.com", "/en/77x/"), Rule("block", "x.org", ""), Rule("allow", "x.org", "")]


@pytest.mark.parametrize(
    "url,rule",
    [("http://a.COM/en/1", "com/en/"), ("https://www.example.com/en/73?q", "example.com/en/7"), ("http://example.com/en/77x/y", "example.com/en/77x/"), ("http://notexample.com/en/7", "com/en/"), ("http://example.com/de/7", None), ("http://a.x.org#f", "x.org"), ("http://", None), ("no scheme", None), (None, None), ("http://com/en", None)],
)
def test_longest_rule(url, rule):
    found = UrlTrie(RULES).find(*split_url(url))
    assert (found and found.host + found.path) == rule


def test_urls(spark):
    df = spark.createDataFrame([(1, "http://A.com:80/p?x#y", "h"), (1, "http://A.com:80/p?x#y", "h"), (2, None, "h"), (3, "http://x.org", "h")], "page_id long, url string, host string")
    got = sorted(tuple("-" if v is None else v for v in r) for r in filter_urls(df, RULES).collect())
    assert got == [(1, "a.com:80", "/p", "-", "allow"), (1, "a.com:80", "/p", "-", "allow"), (2, "", "", "-", "allow"), (3, "x.org", "", "x.org", "block")]
    assert filter_urls(df.limit(0), RULES).count() == 0
    assert sorted(tuple("-" if v is None else v for v in r) for r in filter_urls(df, RULES, max_rules=2).select("page_id", "host", "path", "rule", "verdict").collect()) == got
    with pytest.raises(ValueError):
        UrlTrie([Rule("maybe", "a", "/")])


def test_the_longest_rule_wins_whatever_its_host():
    rules = [Rule("block", "com", "/en/very/long/path/"), Rule("allow", "example.com", "/en/"), Rule("block", "org", "/abc"), Rule("allow", "a.org", "/a")]
    find = UrlTrie(rules).find
    assert find("www.example.com", "/en/very/long/path/x").verdict == "block" and find("example.com", "/en/x").verdict == "allow"
    assert find("a.org", "/abcd").host == "a.org"  # equally long, and the longer host


def test_joined_rules_against_the_trie(spark):
    rng = np.random.default_rng(3)
    part = lambda n: "".join(rng.choice(list("ab/"), n))
    hosts = ["com", "a.com", "b.a.com", "org", "b.org"]
    rules = [Rule(["allow", "block"][i % 2], hosts[rng.integers(5)], "/" * (i % 3 > 0) + part(rng.integers(0, 6))) for i in range(300)]
    urls = [f"http://{hosts[rng.integers(5)]}/{part(rng.integers(0, 12))}" for _ in range(400)] + [None, "x", "http://"] + ["http://a.com/a"] * 30
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(str, filter_urls(df, rules, max_rules=10).select(*columns).collect())) == sorted(map(str, filter_urls(df, rules).select(*columns).collect()))


def test_many_rules_of_one_host_are_looked_up():
    import time

    trie = UrlTrie([Rule("block", "com", f"/{k}") for k in range(20_000)])
    began = time.perf_counter()
    assert all(trie.find("a.com", f"/{k}x").path == f"/{k}" for k in range(10_000, 12_000))
    assert time.perf_counter() - began < 1


# Pages


def words_found(page, weights, **options):
    """Words of main text in a labelled page, those that are found, and those that are found and are main text."""
    got = Counter(html_text.main_text("".join(p for p, _ in page), weights, **options).split())
    want = Counter(html.unescape(re.sub(r"<[^>]+>", " ", " ".join(piece for piece, main in page if main))).split())
    return sum(want.values()), sum(got.values()), sum((got & want).values())


def test_held_out_pages():
    """Weights from some of the labelled pages find the main text of the others."""
    labelled = pages()
    weights = html_text.learn(labelled[:600])
    want, got, both = np.sum([words_found(p, weights) for p in labelled[600:]], axis=0)
    assert both > 0.97 * want and both > 0.97 * got


P = "<p>The boats came in late, and nobody on the pier said a word about the storm. By then it was dark.</p>"
SAID = "The boats came in late, and nobody on the pier said a word about the storm. By then it was dark."
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(40)) + "</ul>"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<nav><a href=/>Home</a></nav><div class='layout has-sidebar'><article>{P}{P}</article><aside class='sidebar'><a href=/x>More</a></aside></div>", f"{SAID} {SAID}"),
        (f"<main class='no-comments'>{P}{P}</main>", f"{SAID} {SAID}"),
        (f"<article class='post with-share'>{P}{P}</article>", f"{SAID} {SAID}"),
        (f"<form id='f'><div class='menu'><a href=/>Home</a></div><div class='c'>{P}{P}</div></form>", f"{SAID} {SAID}"),
        (f"<article>{P}<p>Let <math><mi>x</mi><mo>=</mo><mn>4</mn></math> be the number of them.</p>{P}</article>", f"{SAID} Let x=4 be the number of them. {SAID}"),
        (f"<article>{P}{P}</article><div>© 2020 Example Inc. All rights reserved.</div>", f"{SAID} {SAID}"),
        (f"<article>{P}{P}</article>{MENU}<article>{P}</article>", f"{SAID} {SAID} {SAID}"),
        (f"<div class='story'>{P}<div style='{'color: red; ' * 90}' class='ad'>Buy it now, while stocks last.</div>{P}</div>", f"{SAID} {SAID}"),
        (f"<div id='x'><h1>Boats</h1>{P}{P}</div><section id='comments'><h2>3 comments</h2><div class='comment'><p>Well said, I thought the same of it.</p></div></section>", f"Boats {SAID} {SAID}"),
    ],
)
def test_names_of_parts_do_not_decide_alone(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>", html_text.learn()) == want


@pytest.mark.parametrize("menu", [MENU, "<div>" + "<a href='/x'>More of it</a><hr>" * 30 + "</div>"])
def test_the_scan_leaves_out_what_stands_apart(menu):
    """Pages without an article: a sentence beyond a menu has good words, but is no part of the best region."""
    page = f"<html><body><div class='x'>{P}{P}{P}</div>{menu}<div><p>Our paper is printed in the old mill by the river.</p></div></body></html>"
    weights = html_text.learn()
    assert html_text.main_text(page, weights) == f"{SAID} {SAID} {SAID}"
    assert html_text.main_text(page, weights, scan=False) == f"{SAID} {SAID} {SAID} Our paper is printed in the old mill by the river."


def test_maximal_subsequences_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = rng.integers(-4, 5, rng.integers(0, 14)).astype(float).tolist()
        found = html_text.maximal(x)
        # By definition: the best contiguous part, the shortest of equal ones, then the same left and right of it.
        def parts(a, b):
            best = max(((sum(x[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            return parts(a, best[3]) + [best[0]] + parts(best[4], b)

        assert [s for s, _, _ in found] == parts(0, len(x))
        assert all(sum(x[i:j]) == s for s, i, j in found)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p>a &amp; b&nbsp;&lt;c&gt; &copy</p>x<b>y</b>z</article>", "a & b <c> © xyz"),
        ("<nav>menu</nav><p>Text here.<br>More\n  text</p><script>if (a<b) {}</script><!-- no <p>x</p> -->", "Text here. More text"),
        ("<body><article>One<aside>side</aside> two</article><div class='comments'><p>bad bad bad</p></div></body>", "One two"),
        ("plain words", "plain words"), ("", ""), (None, ""), ("<p>", ""), ("<script>never ends", ""), ("<p>unclosed <b>bold", "unclosed bold"), ("a < b", "a < b"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page, html_text.learn()) == want


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<article><h1>T</h1><p>x</p></article>", "c"), (2, None, None, "c"), (3, "v", "<p>" + LONG + "</p>", "c")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: tuple(r)[1:] for r in html_text.extract(df).collect()}
    assert got[1] == ("u", "T x", 3) and got[2] == (None, "", 0) and got[3][2] == len(LONG.strip())
    assert html_text.extract(df.limit(0)).count() == 0
    other = html_text.learn([[("<div>", False), ("<p>in in in</p>", True), ("</div><footer>out</footer>", False)]])
    assert html_text.main_text("<p>a b c</p><footer>d</footer>", other) == "a b c"


def test_pages_of_the_tables():
    """The text between the article's tags, markup taken out by a pattern; and the same with the article's tags renamed."""
    weights, same = html_text.learn(), 0
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    for text, in rows:
        inner = text.partition("<article>")[2].partition("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]+>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert html_text.main_text(text, weights) == want
        same += html_text.main_text(text.replace("article>", "div>"), weights) == want
    assert same >= 0.97 * len(rows)

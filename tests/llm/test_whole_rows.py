import numpy as np

from trustweave.llm import html_text, packing


def test_gaps_made_on_the_way_are_filled():
    counts = np.zeros(13, int)
    counts[7], counts[2] = 2, 3
    plan = packing.plan(counts)
    assert sum(t for _, t in plan) == 2 and sum(t * sum(p) for p, t in plan) == 20
    rng = np.random.default_rng(5)
    for _ in range(200):
        counts = rng.integers(0, 5, 25)
        counts[0] = 0
        plan = packing.plan(counts)
        gaps = [(24 - sum(p), i) for i, (p, t) in enumerate(plan) for _ in range(t)]
        used = np.zeros(25, int)
        for p, t in plan:
            assert sum(p) <= 24
            for x in p:
                used[x] += t
        assert (used == counts).all()
        # No sequence fits into the gap of another.
        filled = [24 - g for g, _ in gaps]
        assert len(filled) < 2 or sum(sorted(filled)[:2]) > 24


def test_hints_after_long_attributes():
    page = '<body><article><p>' + "body text goes on here " * 20 + '</p></article><div {} class="advert"><p>' + "buy this now today " * 20 + "</p></div></body>"
    weights = html_text.learn()
    long = 'style="' + "color: red; " * 90 + '"'
    assert html_text.main_text(page.format(long), weights) == html_text.main_text(page.format(""), weights)
    assert "buy" not in html_text.main_text(page.format(long), weights)

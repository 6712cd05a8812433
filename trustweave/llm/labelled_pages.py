"""Small labelled pages from which the weights of HTML extraction are learned.

Each page is a list of (piece of HTML, whether it is main text). Pieces are written here by hand: frames that hold main
text, and what stands around and amid it, under the names that pages give to such parts. Pages put them together, so
that a name stands for a part as well as, among others, for a frame around everything ("has-sidebar", a form around the
whole page). Whoever has labelled pages of their own passes those instead.
"""

from __future__ import annotations

import random

Page = list[tuple[str, bool]]

PROSE = (
    "The river rose early that spring and the lower fields stayed under water for a week.",
    "Nobody had expected the bridge to hold, but it did, and the road was open again by May.",
    "Les enfants jouaient dans la cour pendant que la pluie tombait sur les toits de la ville.",
    "Der alte Bahnhof steht leer, und auf den Gleisen wachsen Birken und hohes Gras.",
    "La biblioteca abre a las nueve y cierra cuando se va el último lector de la tarde.",
    "She counted the boats as they came in; there were eleven of them, and then the fog closed.",
    "Whether the wall was older than the town, as some held, was never settled by anyone.",
)
SHORT = ("A short line.", "Photo © Anna Berg", "And then?", "Nothing.", "Oui.", "So war es.", "In the north", "1923", "x = 4")
REMARKS = ("I was there and saw it too, it went just like this.", "Well written, thank you very much.", "No, that is wrong, my father told it otherwise.", "First!", "Does anyone know what became of the boats?")
LINKS = ("Home", "News", "About us", "Sport", "The week in pictures", "Contact", "Ten ways to cook rice", "Archive", "Next page", "Log in")
HEAD = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'

#: Frames for main text: what opens and closes them.
FRAMES = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div class='post'>", "</div>"), ("<div class='entry-content'>", "</div>"),
    ("<div id='article-body'>", "</div>"), ("<section class='story'>", "</section>"), ("<div>", "</div>"), ("", ""), ("<article class='post with-share'>", "</article>"),
    ("<main class='no-comments'>", "</main>"), ("<div class='text'>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<main><article class='entry'>", "</article></main>"),
    ("<div role='main'>", "</div>"), ("<article><header>", "</header></article>"),
)
#: Frames around the whole page.
AROUND = (
    ("", ""), ("<div id='page'>", "</div>"), ("<div class='layout has-sidebar'>", "</div>"), ("<form id='form1' action='/'>", "</form>"), ("<div class='wrapper'><div class='container'>", "</div></div>"),
    ("<div class='page with-sidebar'>", "</div>"), ("<div class='site'>", "</div>"), ("<div class='menu-open'>", "</div>"), ("<div class='sidebar-layout'>", "</div>"),
)
#: Names under which parts stand that are no main text.
NAMES = {
    "links": ("<nav>", "<div class='menu'>", "<ul class='navigation'>", "<div id='navbar'>", "<div class='breadcrumb'>", "<div class='toc'>", "<div class='pagination'>", "<div class='tabs'>", "<nav class='main-menu'>", "<div class='site-nav'>", "<ul class='menu'>", "<div role='navigation'>", "<div>", "<ul>"),
    "top": ("<header class='site-header'>", "<div id='masthead'>", "<div class='banner'>", "<div class='topbar'>", "<div class='logo'>", "<header>"),
    "bottom": ("<footer>", "<div class='footer'>", "<div id='footer'>", "<div class='copyright'>", "<div class='imprint'>", "<footer class='site-footer'>", "<div role='contentinfo'>", "<div>"),
    "side": ("<aside>", "<div class='sidebar'>", "<aside class='sidebar'>", "<div class='widget'>", "<div class='related'>", "<div class='related-posts'>", "<div class='recommended'>", "<div class='teaser'>", "<div id='sidebar'>"),
    "advert": ("<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='advertisement'>", "<div class='sponsored'>", "<div class='promo'>", "<aside class='ad'>", "<div id='ad-3'>", "<div class='ad-box'>"),
    "notice": ("<div class='cookie-notice'>", "<div id='cookies'>", "<div class='consent'>", "<div class='gdpr'>", "<div class='popup'>", "<div class='modal'>", "<div class='alert'>", "<div class='newsletter'>", "<div role='dialog'>", "<div class='paywall'>", "<div class='notice'>", "<div class='subscribe'>"),
    "comments": ("<section id='comments'>", "<div class='comments'>", "<div class='comment-list'>", "<ol class='commentlist'>", "<div class='discussion'>", "<div id='disqus'>", "<section class='replies'>", "<div id='respond'>"),
    "share": ("<div class='share'>", "<div class='social'>", "<div class='share-buttons'>", "<ul class='social-links'>"),
    "form": ("<form>", "<form class='search'>", "<div class='login'>", "<form id='signup'>", "<form action='/subscribe'>", "<div class='search-form'>"),
}
TEXTS = {
    "advert": ("Buy two and get the third one free until Sunday evening.", "The best coffee of the town, now delivered to your door."),
    "notice": ("We use cookies to make this page better. Please accept them.", "Sign up and never miss a story. You can stop at any time.", "You have read your last free article of this month."),
    "bottom": ("&copy; example.org &middot; All rights reserved and nothing may be copied.", "© 2021 The Paper. All rights reserved.", "Copyright by nobody in particular, printed nowhere."),
    "top": ("The Paper", "News for the valley since 1891"),
}


def closing(opening: str) -> str:
    return f"</{opening[1:-1].split()[0]}>"


def part(kind: str, opening: str, rng: random.Random) -> str:
    """One part of a page that is no main text."""
    links = rng.sample(LINKS, rng.randint(3, 6))
    if kind in ("links", "share"):
        if opening.startswith("<ul"):
            inner = "".join(f"<li><a href='/{i}'>{x}</a></li>" for i, x in enumerate(links))
        else:
            inner = rng.choice(("<ul>{}</ul>", "{}", "<p>{}</p>")).format("".join(f"<li><a href='/{i}'>{x}</a></li>" if i % 2 else f"<a href='/{i}'>{x}</a> " for i, x in enumerate(links)))
    elif kind == "side":
        inner = f"<h3>{rng.choice(LINKS)}</h3><ul>{''.join(f'<li><a href=/{i}>{x}</a></li>' for i, x in enumerate(links))}</ul>" if rng.random() < 0.6 else f"<h3>{rng.choice(LINKS)}</h3><p>{rng.choice(PROSE)} <a href='/m'>More</a></p>"
    elif kind == "comments":
        inner = f"<h2>{rng.randint(1, 40)} comments</h2>" + "".join(rng.choice(("<div class='comment'><p>{}</p></div>", "<li class='comment'><b>Ann</b> {}</li>", "<p>{}</p>")).format(" ".join(rng.sample(REMARKS + PROSE, rng.randint(1, 3)))) for _ in range(rng.randint(1, 7)))
    elif kind == "form":
        inner = "<label>Your address</label><input type='text' name='q'><select><option>Daily</option></select> <p>Get the news by mail.</p><button>Subscribe</button>"
    else:
        text = rng.choice(TEXTS[kind])
        inner = f"<p>{text}</p>" if rng.random() < 0.5 else text
    return opening + inner + closing(opening)


def main_text(rng: random.Random, long: bool) -> str:
    """Some blocks of main text."""
    title = f"<h1>{rng.choice(PROSE + SHORT)[: rng.choice((12, 30, 90))]}</h1>" if rng.random() < 0.7 else f"<h2>{rng.choice(SHORT)}</h2>" * (rng.random() < 0.5)
    made = []
    for _ in range(rng.randint(2, 8) if long else 1):
        prose = " ".join(rng.sample(PROSE, rng.randint(1, 4)))
        made.append(
            rng.choice(
                (
                    f"<p>{prose}</p>", f"<p>{prose}</p>", f"<p>{prose}</p>", f"<p>{prose}<br><p>{rng.choice(PROSE)}</p>", f"<p><b>{rng.choice(PROSE)}<br><p>{prose}</p>", f"<p>{rng.choice(SHORT)}</p>",
                    f"<p>See <a href='/z'>the older story</a> on <em>this</em>. {rng.choice(PROSE)}</p>", f"<blockquote>{prose}</blockquote>", f"<ul><li>{rng.choice(SHORT)}</li><li>{rng.choice(PROSE)}</li></ul>",
                    f"<table><tr><td>{rng.choice(SHORT)}</td><td>{rng.choice(SHORT)}</td></tr></table>", f"<h2>{rng.choice(SHORT)}</h2><p>{prose}</p>", f"<figure><img src='/i'><figcaption>{rng.choice(PROSE)}</figcaption></figure>", f"{prose}<br><br>",
                )
            )
        )
    return title + "".join(made)


def small_pages() -> list[Page]:
    """Pages of nothing but a few words."""
    made: list[Page] = []
    for words in (*SHORT, *PROSE, "plain words"):
        made += [[(words, True)], [(f"<p>{words}</p>", True)], [("<body><div>", False), (words, True), ("</div></body>", False)], [("<article>", False), (f"<p>{words}</p>", True), ("</article>", False)]]
    return made


def pages(n: int = 800) -> list[Page]:
    rng, made = random.Random(1), small_pages()
    kinds = [(kind, opening) for kind, all_of in NAMES.items() for opening in all_of]
    for i in range(n):
        frame, around = FRAMES[i % len(FRAMES)], AROUND[rng.randrange(len(AROUND))] if i % 2 else AROUND[0]
        before = [part(k, o, rng) for k, o in rng.sample([x for x in kinds if x[0] in ("links", "top", "advert", "notice", "side", "form")], rng.randint(1, 4))]
        after = [part(k, o, rng) for k, o in rng.sample([x for x in kinds if x[0] not in ("top", "links")], rng.randint(1, 4))]
        inside = [part(k, o, rng) for k, o in rng.sample([x for x in kinds if x[0] in ("advert", "share", "side", "notice", "form") and x[1] not in ("<ul>", "<div>")], rng.randint(0, 2))]
        page: Page = [(HEAD.format(rng.choice(PROSE)[:30]) + around[0] + "".join(before) + frame[0], False), (main_text(rng, i % 9 > 0), True)]
        for piece in inside:
            page += [(piece, False), (main_text(rng, True).partition("</h1>")[2] or f"<p>{rng.choice(PROSE)}</p>", True)]
        made.append([*page, (frame[1] + "".join(after) + around[1] + "</body></html>", False)])
    return made

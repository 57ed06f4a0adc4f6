"""Article text that names or places beside the best container must not lose."""

import pytest

from tessera.llm.html_text import main_text

LONG = "A long paragraph, with commas, of which an article has several, and which goes on for a while."
PAGES = [
    (f'<div class="content-sidebar-wrap"><main><p>{LONG}</p></main></div>', LONG),
    (f'<article><h1>T</h1><div class="article-widget"><p>{LONG}</p></div></article>', f"T {LONG}"),
    (f'<div class="search-result"><p>{LONG}</p></div>', LONG),
    (f'<body class="x"><div class="ad-free"><p>{LONG}</p></div><div class="sidebar"><p>side</p></div>', LONG),
    (f"<div class=post><h1>T</h1><div class=entry><p>{LONG}</p></div></div>", f"T {LONG}"),
    (f"<div class=post><div class=entry><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><pre>code</pre><ul><li>one<li>two</ul><p>short</p><h2>More</h2><ul><li><a href=x>link</a></ul></div>", f"{LONG} {LONG} {LONG} code one two short"),
    (f"<article><p>{LONG}</p><figure><img src=x><figcaption>A caption</figcaption></figure></article>", f"{LONG} A caption"),
    (f"<article><p>{LONG}</p></article><div class=comments><p>{LONG} {LONG} {LONG}</p></div>", LONG),
    ('<div class="comment-list"><p>All that there is.</p></div>', "All that there is."),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text_is_whole(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><p>{LONG}</p><div class="notice-period"><p>A notice period of a month.</p></div><section id="related-work"><h2>Related work</h2><p>{LONG}</p></section></article>', f"{LONG} A notice period of a month. Related work {LONG}"),
        (f'<article><p>{LONG}</p><div class="related-posts"><p>Another post</p></div><div class="ad-slot-2">Buy!</div><div class="share">Share</div></article>', LONG),
        (f"<article><p>{LONG} <math><mi>x</mi><mo>+</mo><mi>y</mi><annotation>x+y</annotation></math></p></article>", f"{LONG} x+y"),
    ],
)
def test_names_inside_an_article(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("tag", ["div", "article", "span", "b", "ul><li", "p", "blockquote", "main"])
def test_deep_nesting_is_linear(tag):
    import time

    opened = f"<{tag}>" * 100_000
    started = time.process_time()
    assert LONG in main_text(f"<body>{opened}<p>{LONG}</p>")
    main_text(f"<body>{opened}<p>{LONG}</p>" + f"</{tag.split('>')[0]}><i>text</i>" * 20_000)
    assert time.process_time() - started < 8


def test_random_pages():
    """Pages built around an article, with furniture before, inside and after it, give the article's blocks in order."""
    import random

    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "caf&eacute;", "x &lt; y", "one, two", "e&#110;d."])
    plain = lambda t: " ".join(t.replace("&eacute;", "é").replace("&lt;", "<").replace("&#110;", "n").split())
    text = lambda n: " ".join(word() for _ in range(n))
    furniture = [
        lambda: f"<nav><ul><li><a href=x>{text(2)}</a></ul></nav>", lambda: f"<div class='ad-slot'>{text(9)}</div>", lambda: f"<aside><p>{text(30)}</p></aside>", lambda: f"<form><input><label>{text(3)}</label></form>",
        lambda: f"<script>var s = '<p>{text(5)}</p>';</script>", lambda: f"<div hidden><p>{text(20)}</p></div>", lambda: f"<section class=\"comments\"><p>{text(40)}</p></section>", lambda: f"<!-- {text(3)} -->", lambda: f"<footer>{text(6)}</footer>",
    ]
    for n in range(150):
        pieces, want = [], []
        for _ in range(rng.randint(2, 9)):
            t = text(rng.randint(12, 60))
            tag = rng.choice(["p", "p", "p", "h2", "blockquote", "li", "pre", "td"])
            before, after = {"li": ("<ul><li>", "</ul>"), "td": ("<table><tr><td>", "</table>")}.get(tag, (f"<{tag}>", f"</{tag}>"))
            pieces.append(before + t.replace(" ", rng.choice([" ", "\n  ", " <b>&nbsp;</b>", " "]), 1) + after)
            want.append(plain(t))
            if rng.random() < 0.3:
                pieces.append(rng.choice(furniture)())
        around = [rng.choice(furniture)() for _ in range(4)]
        deep = rng.randint(0, 4)
        page = f"<html><head><title>{text(3)}</title></head><body>{''.join(around[:2])}{'<div>' * deep}<article>{''.join(pieces)}</article>{'</div>' * deep}{''.join(around[2:])}</body></html>"
        assert main_text(page).replace("\xa0", " ").split() == " ".join(want).split(), page


@pytest.mark.parametrize("wrap", ["<div class=row><div class=col>{}</div></div>", "<div><div>{}</div></div>", "<section><div><div>{}</div></div></section>", "<table><tr><td>{}</td></tr></table>"])
@pytest.mark.parametrize("groups", [[1, 1, 1, 1], [2, 2], [3, 1, 1], [1]])
def test_rows_and_columns(wrap, groups):
    """A text in rows and columns, or in groups of paragraphs, without an article element."""
    body = "".join(wrap.format(f"<p>{LONG}</p>" * n) for n in groups)
    for page in (f"<div id=content>{body}</div>", f"<body><nav>x</nav><div><div id=content>{body}</div></div><footer>y</footer>", f"<body>{'<div>' * 60}{body}"):
        assert main_text(page) == " ".join([LONG] * sum(groups))


def test_prose_inside_an_article_is_no_furniture():
    assert main_text(f"<article><p>{LONG}</p><p class='search'>{LONG}</p><object><p>Shown without it.</p></object><p class=share>Share</p></article>") == f"{LONG} {LONG} Shown without it."
    assert main_text(f"<article><p>{LONG}</p><section class=discussion><h2>Discussion</h2><p>{LONG}</p></section></article><div class='user-discussion'><p>{LONG} {LONG}</p></div>") == f"{LONG} Discussion {LONG}"


def test_random_pages_without_article():
    """The article's blocks, in nested wrappers or columns, among menus, teasers and named furniture: all of them and nothing else."""
    import random

    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["alpha", "beta,", "gamma", "delta", "epsilon"]) for _ in range(n)) + "."
    teaser = lambda: f"<div class=teaser><a href=x>{text(9)}</a><a href=y>{text(8)}</a></div>"
    around = [
        teaser, lambda: f"<nav><ul><li><a href=x>{text(2)}</a></ul></nav>", lambda: f"<div class='ad-slot'>{text(9)}</div>", lambda: f"<div id=sidebar><p>{text(30)}</p></div>", lambda: f"<ul class=links>{'<li><a href=x>' + text(4) + '</a>' * 5}</ul>",
        lambda: f"<div class=comments><p>{text(40)}</p></div>", lambda: f"<footer><p>{text(20)}</p></footer>", lambda: f"<form><p>{text(20)}</p></form>",
    ]
    for _ in range(200):
        blocks = [text(rng.randint(15, 60)) for _ in range(rng.randint(3, 9))]
        tagged = [f"<{t}>{x}</{t}>" for x, t in zip(blocks, ["p", *rng.choices(["p", "p", "p", "blockquote", "pre"], k=len(blocks))], strict=False)]
        shape = rng.choice(["plain", "each", "groups"])
        if shape == "each":
            tagged = [f"<div class=block><div>{x}</div></div>" for x in tagged]
        elif shape == "groups":
            at = rng.randint(1, len(tagged) - 1)
            tagged = [f"<section><div>{''.join(part)}</div></section>" for part in (tagged[:at], tagged[at:])]
            if not 0.25 < at / len(blocks) < 0.75:
                continue  # a part of a few words beside a long one may be anything
        inner = "".join(tagged)
        for _ in range(rng.randint(0, 4)):
            inner = f"<div>{inner}</div>"
        page = f"<html><body>{''.join(rng.choice(around)() for _ in range(3))}<div id=page>{rng.choice(around)()}<div id=main-column>{inner}</div>{teaser()}</div>{''.join(rng.choice(around)() for _ in range(2))}</body></html>"
        assert main_text(page) == " ".join(blocks), page

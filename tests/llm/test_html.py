"""Main text of hand-made pages."""

from __future__ import annotations

import math
import random
import time

import pytest

from tidepanel.llm import html_text as H

LONG = "some words of a paragraph that goes on for a while and then a bit more "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class='cookie-notice'>We use cookies {LONG}</div><div id=wrap>
<div class="menu"><ul><li><a>a</a><li><a>b</a></ul></div><div class=post><h2>Title &amp; more</h2><p>First   para&nbsp;with <a href=q>a link</a> inside {LONG}
<p>Second.<br>line two &lt;b&gt;<ul><li>one<li>two</ul><div class="advert">BUY</div><table><tr><td>x<td>y</table><p>Er.</p></div>
<aside>{LONG * 3}</aside><form><label>Name</label></form><div id="comments"><article class="comment"><p>{LONG * 20}</p></article></div></div><footer>&copy; x {LONG}</footer></body></html>"""


def test_article_without_its_surroundings():
    want = ["Title & more", f"First para with a link inside {LONG}".strip(), "Second. line two <b>", "one", "two", "x y", "Er."]
    assert H.main_text(PAGE).split("\n\n") == want


@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), ("plain &lt;text&gt;  here", "plain <text> here"), ("<p>one<p>two", "one\n\ntwo"), ("a < b and <b>c</b> <!-- x", "a < b and c"), ("<script>x", ""), ("<nav>x</nav>", ""), ('<p title="a>b">c</p>', "c"), ("<p title='x>c</p>", "c")],
)
def test_small_pages(page, text):
    assert H.main_text(page) == text


PARTS = [" ".join(f"part{k} paragraph{j}" for _ in range(18)) for k in range(2) for j in range(4)]
HALVES = ["".join(f"<p>{p}</p>" for p in PARTS[:4]), "".join(f"<p>{p}</p>" for p in PARTS[4:])]
MENU = "<div><a href=a>one</a><a href=b>two</a><a href=c>three</a></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{MENU}<div id=content><div>{HALVES[0]}</div><div>{HALVES[1]}</div></div>{MENU}</body>",
        f"<body>{MENU}<main><article>{HALVES[0]}</article><article>{HALVES[1]}</article></main>{MENU}</body>",
        f"<body>{MENU}<article>{HALVES[0]}</article><article>{HALVES[1]}</article>{MENU}</body>",
    ],
)
def test_article_in_several_sections(page):
    assert H.main_text(page).split("\n\n") == PARTS


def test_self_closed_raw_elements_are_empty():
    assert H.main_text('<script src="x"/><svg /><p>text</p>') == "text"
    assert H.main_text("<script src=/x/>code</script><p>text</p>") == "text"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>before</p><svg width=1/><p>after the icon</p></article>", "before\n\nafter the icon"),
        ("<article><p>before</p><svg><path><p>after the icon</p></article>", "before\n\nafter the icon"),
        ('<div class="story ad-free"><p>Here it is.</p></div>', "Here it is."),
        (f'<p class="search-intro">It begins.</p><p>{LONG}</p>', f"It begins.\n\n{LONG.strip()}"),
        (f'<div class="ad">BUY</div><div class="ad_box left">BUY</div><p>{LONG}</p><div id="site-footer">c</div>', LONG.strip()),
        (f'<div class="promo"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG.strip()}\n\n{LONG.strip()}"),
    ],
)
def test_names_and_icons(page, text):
    assert H.main_text(page) == text


def test_density_selects_and_rejects():
    """A dense block of links falls under the threshold though nothing names it; the heading before the article stays."""
    links = "".join(f"<li><a href=/{k}>An entry of some length that leads elsewhere {k}</a></li>" for k in range(12))
    page = f"<body><div><ul>{links}</ul></div><h1>Heading</h1><div>{HALVES[0]}</div><div><ul>{links}</ul></div></body>"
    assert H.main_text(page).split("\n\n") == ["Heading", *PARTS[:4]]


def brute_measures(node):
    """Characters, tags, link characters and link tags of a subtree, by recursion."""
    found = [sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str)), 0, 0, 0]
    for c in node.children():
        below = brute_measures(c)
        found = [a + b for a, b in zip(found, [below[0], below[1] + 1, below[2], below[3]], strict=True)]
    if node.tag == "a":
        found[2], found[3] = found[0], found[3] + 1
    return found


def test_densities_match_direct_computation():
    rng = random.Random(8)

    def tree(depth):
        inner = "".join(rng.choice([lambda: "word " * rng.randrange(9), lambda: tree(depth - 1)])() for _ in range(rng.randrange(4))) if depth else "leaf text"
        tag = rng.choice(["div", "section", "a", "span", "b"])
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        root, nodes = H.parse("<body>" + "".join(tree(4) for _ in range(3)) + "</body>")
        H._measure(nodes)
        body = next(n for n in nodes if n.tag == "body")
        chars, _, link_chars, _ = brute_measures(body)
        for n in nodes:
            c, t, lc, lt = brute_measures(n)
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == (c, t, lc, lt)
            if c:
                weight = max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))
                base = math.log(c / max(1, c - lc) * lc + link_chars / max(1, chars) * c + math.e)
                assert n.density == pytest.approx(c / max(1, t) * math.log(weight) / (math.log(base) if base > 1.0001 else 1))
            assert n.total == pytest.approx(sum(k.density for k in n.children()))


@pytest.mark.parametrize("page", ["<a" * 500_000, "<a \"'>" * 150_000, "<svg>" * 200_000, "<!" * 500_000, "<p><a" * 200_000, "<!--" * 250_000, "</" * 500_000])
def test_odd_pages_take_linear_time(page):
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 10


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(H.main_text("<article>" + f"<p>{LONG}</p>" * 5_000 + "</article>")) > 300_000


def test_frames(spark):
    rows = [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (None, None, None, "c"), (2, "v", "", "c")]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 4 and sorted(r["n_chars"] for r in out)[:2] == [0, 0]
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []

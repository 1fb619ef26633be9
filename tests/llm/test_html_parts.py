"""Pages whose content stands in several parts: none of them may go."""

import math
import time

import pytest

from quillstone.llm.tagpath import blocks, main_text, scores


def paragraphs(n, mark):
    return [f"Paragraph {mark}{i}, with some words, and stops. It goes on, as texts do; and ends here." for i in range(n)]


def html(items):
    return "".join(f"<p>{x}</p>" for x in items)


MENU, FOOT = '<nav><a href="/">Home</a></nav>', "<footer>About us, all of us.</footer>"


@pytest.mark.parametrize("sizes", [(17, 3), (12, 5, 3), (1, 1), (10, 10)])
@pytest.mark.parametrize("part", ["section", "article", "div"])
def test_every_part_stays(sizes, part):
    parts = [paragraphs(n, "abc"[k]) for k, n in enumerate(sizes)]
    page = f"<body>{MENU}<div>{''.join(f'<{part}>{html(x)}</{part}>' for x in parts)}</div>{FOOT}</body>"
    assert main_text(page) == "\n".join(x for p in parts for x in p)


def test_content_beside_an_article_stays():
    inside, beside = paragraphs(6, "a"), paragraphs(6, "b")
    page = f"<body>{MENU}<article>{html(inside)}</article><div>{html(beside)}</div>{FOOT}</body>"
    assert main_text(page) == "\n".join(inside + beside)


def test_a_title_outside_the_body_block_stays():
    text = paragraphs(8, "a")
    assert main_text(f"<body>{MENU}<h1>The title</h1><div>{html(text)}</div>{FOOT}</body>") == "\n".join(["The title", *text])


def test_what_stands_between_parts_stays():
    a, b = paragraphs(6, "a"), paragraphs(6, "b")
    assert main_text(f"<body>{MENU}<div><section>{html(a)}</section><h2>Part two</h2><section>{html(b)}</section></div>{FOOT}</body>") == "\n".join([*a, "Part two", *b])


@pytest.mark.parametrize("name", ["content no-sidebar", "search-article", "post legal", "related-work", "skip-list", "notice of meeting", "page with-side"])
def test_names_only_vote(name):
    text = paragraphs(4, "a")
    assert main_text(f'<body>{MENU}<div class="ad">Buy now!</div><div class="{name}"><h1>T</h1>{html(text)}</div>{FOOT}</body>') == "\n".join(["T", *text])


def test_a_header_inside_main_holds_the_title():
    text = paragraphs(3, "a")
    assert main_text(f"<body><header><p>Site</p></header><main><header><h1>The title</h1></header>{html(text)}</main>{FOOT}</body>") == "\n".join(["The title", *text])


def test_comments_in_an_article_go():
    text = paragraphs(5, "a")
    assert main_text(f'<article>{html(text)}<div class="comments">{html(["Nice, that. Yes."] * 3)}</div></article>') == "\n".join(text)


@pytest.mark.parametrize("page", ["<div>x, y." * 100_000, '<p class="x ' * 80_000, "<b>" * 5000 + "<p>a, b." * 40_000, "</x>" * 200_000, "<div a='\"<p>" * 50_000, "<" * 500_000])
def test_a_long_page_takes_seconds(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 20


def ratios(page):
    """Fused ratios from the paths written out, with no smoothing kernel but the definition."""
    nodes = [(x, t) for x, t in blocks(page) if not x.not_text]
    def path(x):
        return path(x.parent) + "/" + x.tag if x else ""
    names = [path(x) for x, _ in nodes]
    length = {p: sum(len(t) for q, (_, t) in zip(names, nodes) if q == p) / names.count(p) for p in names}
    points = {p: (1 + sum(sum(c in ".,;:!?…¿¡。，、；：！？" for c in t) for q, (_, t) in zip(names, nodes) if q == p)) / names.count(p) for p in names}
    kernel = [math.exp(-0.5), 1.0, math.exp(-0.5)]
    smooth = lambda v: [sum(k * v[min(max(i + d, 0), len(v) - 1)] for d, k in zip((-1, 0, 1), kernel)) / sum(kernel) for i in range(len(v))]
    return [a * b * x.vote for a, b, (x, _) in zip(smooth([length[p] for p in names]), smooth([points[p] for p in names]), nodes)]


def test_ratios_against_their_definition():
    page = f"<body><div><p>Short.</p><ul><li>one</li><li>two, three</li></ul>{html(paragraphs(3, 'a'))}</div><section>{html(paragraphs(2, 'b'))}<p>x</p></section></body>"
    nodes = [(x, t) for x, t in blocks(page) if not x.not_text]
    assert list(scores(nodes)) == pytest.approx(ratios(page))

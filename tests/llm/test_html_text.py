"""Main text of made pages whose article is known, with and without an article element."""

import time

import numpy as np
import pytest

from lumaframe.llm import html_text


def sentence(rng, n):
    return " ".join(f"{'abcdefgh'[int(k) % 8]}{int(k)}" for k in rng.integers(0, 900, n)).capitalize() + "."


def made(rng, marked):
    """(html, text): an article of long and short paragraphs among menus, teasers, notices, adverts and comments."""
    title = sentence(rng, 5)
    bodies = [sentence(rng, int(rng.integers(30, 120)))] + [sentence(rng, int(rng.choice([1, 2, 15, 60]))) for _ in range(int(rng.integers(2, 9)))]
    inner = f"<h1>{title}</h1>"
    for k, b in enumerate(bodies):
        inner += f"<p>{b.replace(' ', ' <i>', 1) + '</i>' if k % 3 == 0 and ' ' in b else b}</p>"
        if k == 1:
            inner += f"<div class='ad'>{sentence(rng, 8)}</div>"
        if k == 2:
            inner += "<ul>" + "".join(f"<li><a href='/{j}'>{sentence(rng, 3)}</a></li>" for j in range(4)) + "</ul>"
    menu = "<ul>" + "".join(f"<li><a href='/{j}'>{sentence(rng, 1)}</a></li>" for j in range(6)) + "</ul>"
    comments = "".join(f"<p>{sentence(rng, 40)}</p>" for _ in range(3))
    before = f"<nav>{menu}</nav><div>{menu}</div><div class='cookie-bar'>{sentence(rng, 6)}</div>"
    after = f"<div id='comments'>{comments}</div><aside>{sentence(rng, 50)}</aside><div>{menu}</div><footer>{sentence(rng, 9)}</footer>"
    if marked:
        inner = f"<article>{inner}<div><a href='/n'>Next</a></div><div><a href='/p'>Back</a></div><div><a href='/u'>Up</a></div><div>Filed</div></article>"
    else:
        inner = f"<div id='c{int(rng.integers(9))}'>{inner}</div>"
    teasers = "".join(f"<div><div>{sentence(rng, 4)}</div></div>" for _ in range(3))
    return f"<html><head><title>x</title><style>p{{}}</style></head><body>{before}{teasers}{inner}{teasers}{after}</body></html>", "\n".join([title, *bodies])


@pytest.mark.parametrize("marked", [True, False])
def test_made_pages(marked):
    rng = np.random.default_rng(3)
    for _ in range(200):
        html, want = made(rng, marked)
        assert html_text.main_text(html) == want


@pytest.mark.parametrize("marked", [True, False])
def test_windows_decide(marked, monkeypatch):
    """Without surge and dive, or with windows of one block, the same pages give other texts."""
    pages = [made(np.random.default_rng(4), marked) for _ in range(20)]
    monkeypatch.setattr(html_text, "regions_of", lambda weight, threshold: [(0, len(weight))])
    assert all(html_text.main_text(html) != want for html, want in pages)


def test_regions_against_the_definition():
    rng = np.random.default_rng(5)
    for _ in range(300):
        weight = [float(x) for x in rng.choice([0, 0, 0, 3, 40, 200], int(rng.integers(0, 40)))]
        threshold, inside, want = float(rng.choice([0.5, 30, 86])), False, set()
        for i in range(len(weight)):
            window = weight[i] + (weight[i + 1] if i + 1 < len(weight) else 0) + (weight[i + 2] if i + 2 < len(weight) else 0)
            inside = window > 0 if inside else window > threshold
            if inside:
                want.add(i)
        assert {k for i, j in html_text.regions_of(weight, threshold) for k in range(i, j)} == want


def test_text_is_not_lost():
    text, long = html_text.main_text, "word " * 60
    assert text(f"<article><p>teaser</p></article><div id=story><p>{long}<p>{long}</div>").endswith(f"{long.strip()}\n{long.strip()}")
    assert text(f"<article><p class='alert'>Careful!</p><p>{long}</article>") == f"Careful!\n{long.strip()}"
    assert text(f"<div><h1>h</h1><p>{long}</p><ul><li><a>1</a><li><a>2</a><li><a>3</a></ul><p>The end.</p></div>") == f"h\n{long.strip()}\nThe end."
    assert text("<article><a href=x>only a link</a></article>") == "only a link"


def test_long_and_broken_pages_take_linear_time():
    n, start = 100_000, time.process_time()
    assert html_text.main_text("<p>x" + "</q>" * n) == "x" and html_text.main_text("<p>x" + "</div></b>" * (n // 2)) == "x"
    assert html_text.main_text("<div>" * n + "deep") == "deep"
    assert time.process_time() - start < 6
    words = "word " * 2_000_000
    assert html_text.main_text(f"<p>{words}</p>") == words.strip()

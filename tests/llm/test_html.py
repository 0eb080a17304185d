"""Main text: generated pages of known content, and the part that clustering has in it."""

import random

import numpy as np
import pyarrow.parquet as pq

from gridloom.llm import html_extract as H

from .test_operators import words_of


def sentence(draw, least, most):
    return " ".join(words_of(draw.random(), draw.randint(least, most))).capitalize() + "."


def page(draw):
    """Html and its main text: a generator that knows what it put where."""
    paragraphs = [sentence(draw, 1, 3)] + [sentence(draw, 8, 120) for _ in range(draw.randint(1, 8))] + [sentence(draw, 1, 3)]
    wrap = draw.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<section>{}</section>"])
    inner = [f"<p>{p}</p>" for p in paragraphs]
    inner.insert(draw.randrange(len(inner)), draw.choice(["<aside>" + sentence(draw, 5, 60) + "</aside>", "<div class='advert'>" + sentence(draw, 5, 60) + "</div>", "<script>if (a<b) {}</script>", "<!-- x -->", "<form>" + sentence(draw, 5, 40) + "</form>"]))
    links = lambda n: "".join(f"<li><a href='/{k}'>{' '.join(words_of(draw.random(), draw.randint(1, 4)))}</a></li>" for k in range(n))
    menu = draw.choice(["<nav><ul>{}</ul></nav>", "<ul>{}</ul>", "<div><ul>{}</ul></div>"]).format(links(draw.randint(2, 12)))
    tail = draw.choice(["<footer>" + sentence(draw, 3, 40) + "</footer>", "<div id='comments'><p>" + sentence(draw, 3, 90) + "</p></div>", "<ul>" + links(6) + "</ul>", ""])
    notice = draw.choice(["", "<div class='cookie-notice'>" + sentence(draw, 4, 40) + "</div>"])
    side = ["<div>" + "".join(f"<p>{' '.join(words_of(draw.random(), draw.randint(1, 2)))}</p>" for _ in range(draw.randint(1, 4))) + "</div>", ""]  # no mark tells it
    draw.shuffle(side)
    return f"<html><head><title>{sentence(draw, 2, 9)}</title></head><body>{menu}{notice}{side[0]}{wrap.format(''.join(inner))}{side[1]}{tail}</body></html>", " ".join(paragraphs)


def test_generated_pages():
    draw = random.Random(5)
    for _ in range(400):
        html, text = page(draw)
        assert H.main_text(html) == text, html


def test_clustering_decides_on_the_pages(monkeypatch):
    """Other clusters give other texts, on every page."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    found = [H.main_text(p) for p in pages]
    monkeypatch.setattr(H, "dense_lines", lambda lines, parents: np.array([not x.vetoed for x in lines]))
    assert all(H.main_text(p) != t for p, t in zip(pages, found, strict=True))
    draw = np.random.default_rng(1)
    monkeypatch.setattr(H, "dense_lines", lambda lines, parents: np.array([not x.vetoed for x in lines]) & (draw.random(len(lines)) < 0.5))
    assert np.mean([H.main_text(p) != t for p, t in zip(pages, found, strict=True)]) > 0.9


def test_density_decides_on_unmarked_blocks(monkeypatch):
    """Generated pages with an unmarked side block: without a threshold all of them keep it; what the lines are to the
    clusters hangs on threshold and smoothing on the tables' pages, too."""
    draw = random.Random(6)
    made = [page(draw) for _ in range(100)]
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    lines = [H.page_lines(p) for p in pages]
    dense = [H.dense_lines(x, parents).tolist() for x, parents, _ in lines]
    for name, value in (("THRESHOLD", 1.0), ("RADIUS", 0)):
        with monkeypatch.context() as m:
            m.setattr(H, name, value)
            assert np.mean([H.dense_lines(x, parents).tolist() != d for (x, parents, _), d in zip(lines, dense, strict=True)]) > 0.5
    monkeypatch.setattr(H, "THRESHOLD", 0.0)
    assert all(H.main_text(html) != text for html, text in made)


def test_side_blocks_without_marks_fall():
    article = "<article><h1>Head</h1>" + "".join(f"<p>{'some words of text ' * k}</p>" for k in (9, 3, 14, 1, 6)) + "</article>"
    text = H.main_text(article)
    assert text.startswith("Head some") and len(text) == 4 + 1 + 33 * 19 - 1
    for side in ("<div><p>Buy shoes</p><p>today cheap</p></div>", "<div>Buy shoes today</div>", "<div><p>Buy shoes</p></div><div><p>cheap</p></div>", "<p>Buy now</p>"):
        for part in (article, article.replace("article", "div")):
            assert {H.main_text(side + part), H.main_text(part + side), H.main_text(f"<div>{side}{part}</div>")} == {text}


def test_tags_of_vetoed_parts_are_not_the_next_lines():
    lines, *_ = H.page_lines("<div class='ad'><b><i><u>x</u></i></b></div><p>some words</p>")
    assert [(x.text, x.tags) for x in lines if not x.vetoed] == [("some words", 1)]


def test_repeated_and_long_pages(spark):
    html, text = page(random.Random(1))
    long = "<article>" + "<p>word word word</p>" * 60_000 + "</article>"
    df = spark.createDataFrame([(1, "u", html), (1, "u", html), (2, "u", long), (3, None, None)], "page_id bigint, url string, html string")
    found = sorted((r.page_id, r.n_chars, r.text) for r in H.extract(df).collect())
    assert found[0] == found[1] == (1, len(text), text)
    assert found[2][1] == 60_000 * 15 - 1 and found[3] == (3, 0, "")

"""Generated pages whose main text is known, and pages that lost text or gave comments before."""

from __future__ import annotations

import random
import time

import pytest

from chorusmill.llm import html_text

FIRST = "The first words of a paragraph that goes on and on" * 9
SECOND = "Then second words of a paragraph that goes on and on" * 9


def marked(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def listed(*texts, kind="ul"):
    return f"<{kind}>" + "".join(f'<li><a href="https://example.org/{k}">{t}</a></li>' for k, t in enumerate(texts)) + f"</{kind}>"


THREAD = '<div class="comments">' + marked(*(f"Reader {k} says something rather long about it all here. " * 5 for k in range(20))) + "</div>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>T</h1><p>{'x' * 52}</p></article>{THREAD}", ["T", "x" * 52]),
        (f"<div class=entry><h1>T</h1><p>Short.</p></div>{THREAD}", ["T", "Short."]),
        (f'<div class="site comments-open"><main><h1>T</h1>{marked(FIRST)}</main>{THREAD}</div>', ["T", FIRST]),
        (THREAD, []),
        (f"<article><h1>T</h1>{marked(FIRST)}<section class='related-work'><h2>Related work</h2>{marked(SECOND)}</section></article>", ["T", FIRST, "Related work", SECOND]),
        (f"<article><h1>T</h1>{marked(FIRST)}<section class='search'><h2>Search trees</h2>{marked(SECOND)}</section><section class='related'><h2>More</h2>{listed('one', 'two', 'three')}</section></article>", ["T", FIRST, "Search trees", SECOND]),
        (f"<article><h1>T</h1>{marked(FIRST)}<h2>References</h2>{listed('Ref a', 'Ref b', 'Ref c', 'Ref d')}</article>", ["T", FIRST, "References", "Ref a", "Ref b", "Ref c", "Ref d"]),
        (f"<article><h1>T</h1>{marked(FIRST)}<p><a href=1>one</a> <a href=2>two</a> <a href=3>three</a> <a href=4>four</a></p></article>", ["T", FIRST, "one two three four"]),
        (f"<nav>{listed('m', 'n')}</nav><div class='post-header'><h1>Title</h1></div><div class=s>{marked(FIRST)}</div><div class=s>{marked(SECOND)}</div><div class=s><p>A short one.</p></div>", ["Title", FIRST, SECOND, "A short one."]),
        (f"<div class=hero><h1>Title</h1><p>The lead.</p></div><div class=body>{marked(FIRST, SECOND)}</div>", ["Title", "The lead.", FIRST, SECOND]),
        (f"<div class=header><h1>Site</h1></div><div class=body><h1>Title</h1>{marked(FIRST)}</div>", ["Title", FIRST]),
    ],
)
def test_text_that_must_stay_and_go(page, text):
    assert html_text.extract(f"<html><body>{page}</body></html>") == "\n".join(text)


def test_closings_without_an_opening_take_no_time():
    began = time.process_time()
    assert html_text.extract("<body>" + "<div>" * 50_000 + "</section>" * 50_000 + "text") == "text"
    assert time.process_time() - began < 5


def generated(rng):
    """(page, text) of an article page with furniture around and in it."""
    words = "stone river light paper garden window morning letter music winter table market silver bridge".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    text, body = [], []

    def block(tag, content, raw=None):
        text.append(content)
        body.append(f"<{tag}>{raw or content}</{tag}>")

    block("h1", sentence(5))
    for _ in range(rng.randint(2, 6)):
        kind = rng.random()
        if kind < 0.6:
            t = " ".join(sentence(rng.randint(8, 20)) for _ in range(rng.randint(2, 5)))
            first, rest = t.split(" ", 1)
            block("p", t, f"<b>{first}</b>  {rest}" if rng.random() < 0.5 else f'<a href="/x">{first}</a>\n{rest}')
        elif kind < 0.75:
            block("h2", sentence(3))
            block("p", sentence(30))
        elif kind < 0.85:
            items = [sentence(8) for _ in range(3)]
            text.extend(items)
            body.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
        else:
            block("blockquote", sentence(25))
    block("p", " ".join(sentence(14) for _ in range(6)))
    inside = rng.choice(["", '<div class="share"><a href=1>Share</a> <a href=2>Mail</a></div>', '<aside><p>An aside that is furniture.</p></aside>', '<div class="newsletter"><h3>Subscribe</h3><p>Our weekly letter.</p></div>', "<script>var a = '<p>no</p>';</script>"])
    cut = rng.randrange(1, len(body))
    article = "".join(body[:cut]) + inside + "".join(body[cut:])
    opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article class='post'>", "</article></main>"), ("<div class='content'>", "</div>"), ("<div id='main-text'><div>", "</div></div>")])
    before = rng.sample(
        ["<header><p>Site name and what it says.</p></header>", f"<nav>{listed('Home', 'About', 'News', 'Shop')}</nav>", f"<div class='menu'>{listed('One', 'Two', 'Three')}</div>", '<div class="cookie-notice"><p>We use cookies on this page.</p></div>', '<div class="ad">Buy this now, it is cheap.</div>', "<form><label>Search</label><input></form>"],
        rng.randint(1, 4),
    )
    after = rng.sample(["<footer><p>All about us, since 1999.</p></footer>", THREAD, f"<aside>{listed('Read this', 'And this', 'That, too')}</aside>", '<div class="sidebar"><p>Popular today.</p></div>', "<style>p{}</style>"], rng.randint(1, 4))
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(before)}{opening}{article}{closing}{''.join(after)}</body></html>", "\n".join(text)


def test_generated_pages():
    rng = random.Random(55)
    for k in range(300):
        page, text = generated(rng)
        assert html_text.extract(page) == text, (k, page)

"""Line blocks against pages built from templates, whose article text is known; hostile pages in proportional time."""

import html
import random
import time

import pytest

from factweave.llm import line_blocks
from factweave.llm.line_blocks import main_text

LONG = "A long paragraph of plain text, one of many. " * 8
P = f"<p>{LONG}</p>"
T = LONG.strip()


def sentence(rng, least=6, most=30):
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß&<") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(least, most))]
    return " ".join(words) + "."


def page(rng, article):
    """(html, text): blocks of an article between and around boilerplate."""
    def junk():
        links = "".join(f"<li><a href='/{i}'>{rng.choice('ABCDEF')}{i}</a></li>" for i in range(rng.randint(2, 7)))
        return rng.choice([
            f"<div class='ad'>{html.escape(sentence(rng, 2, 40))}</div>", f"<div class=\"ad-slot top\"><p>{html.escape(sentence(rng))}</p></div>", f"<ul>{links}</ul>",
            f"<nav><ul>{links}</ul></nav>", f"<aside><p>{html.escape(sentence(rng))}</p></aside>", "<script>if (a < b) { c('</p>') }</script>", "<style>p > a {}</style>",
            "<form><label>Mail</label><input name='x'><button>Go</button></form>", "<!-- <p>never</p> -->", f"<div id='cookie-notice'>{html.escape(sentence(rng))}</div>",
            f"<div class='share-buttons'><a href='#'>Tweet</a> {rng.choice('xyz')}</div>", "<div hidden><p>unseen</p></div>",
        ])

    blocks, parts = [], []
    for i in range(rng.randint(1, 12)):
        words = sentence(rng, 3, 60)
        blocks.append(words)
        inner = html.escape(words).split(" ")
        k = rng.randrange(len(inner))
        inner[k] = rng.choice(["<b>%s</b>", "<a href='/x?a=1&amp;b=2'>%s</a>", "<em title=\"a > b\">%s</em>", "%s"]) % inner[k]
        text = rng.choice([" ", "\n\t ", "  "]).join(inner)
        parts.append(f"<h2>{text}</h2>" if i == 0 else rng.choice([f"<p>{text}</p>", f"<blockquote>{text}</blockquote>", f"<p class='lead'>{text}"]))
    body = []
    for part in parts:
        body.append(part)
        if rng.random() < 0.3 and (not article or "<ul>" not in (extra := junk())):
            body.append(extra if article else rng.choice(["<div class='ad'>buy now</div>", "<aside>x</aside>", "<script>1</script>"]))
    tops, tails = "".join(junk() for _ in range(rng.randint(0, 3))), "".join(junk() for _ in range(rng.randint(0, 3)))
    if article:
        tag = rng.choice(["article", "main"])
        tails += "<section id='comments'><article><p>A reader's word.</p></article></section>"
        inner = f"<{tag} class='post'>{''.join(body)}</{tag}>"
    else:
        inner = f"<div><div class='content'>{''.join(body)}</div></div>"
        tails += f"<div class='comments'><p>{html.escape(sentence(rng))}</p></div>"
    head = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href='/'>Site</a></header>"
    return f"{head}{tops}{inner}{tails}<footer>&copy; us</footer></body></html>", "\n".join(blocks)


@pytest.mark.parametrize("article", [True, False])
def test_template_pages(article):
    rng = random.Random(5)
    for _ in range(400):
        source, want = page(rng, article)
        assert main_text(source) == want, source


@pytest.mark.parametrize("source,text", [
    (f"<article>{P}<div class='ad'>buy</div><p>The end.</p></article>", f"{T}\nThe end."),
    (f"<div>{P}{P}{P}</div><div class='ad'>buy</div><div class='ad'>more</div><p>The end</p>", f"{T}\n{T}\n{T}\nThe end"),
    (f"<article>{P}<p><a href='/r'>Read the report of the committee</a></p></article>", f"{T}\nRead the report of the committee"),
    (f"<div>{P}<p><a href='/r'>Read the report of the committee</a></p></div>", f"{T}\nRead the report of the committee"),
    (f"<article>{P}<div class='related-work'><h2>Related work</h2>{P}</div></article>", f"{T}\nRelated work\n{T}"),
    (f"<article>{P}<div class='related-links'><a href='/1'>One</a><a href='/2'>Two</a></div></article>", T),
    (f"<div>Login</div><ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li></ul>{P}<ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li></ul><div>3 May</div>", T),
    (f"<div><span>Lead without an end</span></div>{P}<div>Last words without an end</div>", f"Lead without an end\n{T}\nLast words without an end"),
    (f"<div class='entry-header'><h1>Title</h1></div>{P}", f"Title\n{T}"), (f"<img alt='the hidden truth'><p title='a<b'>{LONG}</p>", T),
    ("<div>only</div>", "only"), ("<p>a<p>b", "a\nb"), (f"<div class='ad'><div class='menu'>{P}</div></div>", T),
])
def test_what_stays(source, text):
    assert main_text(source) == text


def test_the_distribution_decides(monkeypatch):
    links = "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(4))
    source = f"<div>Login</div><ul>{links}</ul>{P}<div class='social-history'>{P}</div><div class='social-bar'>x</div><ul>{links}</ul><div>3 May</div>"
    assert main_text(source) == f"{T}\n{T}"
    monkeypatch.setattr(line_blocks, "regions", lambda weights, window=3: [(0, len(weights), max(weights))])
    assert main_text(source) == f"Login\n{T}\n{T}\n3 May"
    monkeypatch.undo()
    monkeypatch.setattr(line_blocks, "SURGE", 0)
    assert main_text(source) == f"Login\n{T}\n{T}\nx\n3 May"


@pytest.mark.parametrize("part", ['"', "'", '=""="', "<!", "<!--", "<script>", "<div class=ad>", "<div class=ad>x", "<a =\"", "<a b='\"", "</", "<a <", "&", "<article>", "<div class=\"related-x\">y"])
def test_hostile_pages(part):
    def seconds(n):
        began = time.process_time()
        main_text("<a " + part * (n // len(part)))
        return time.process_time() - began

    assert seconds(60) < 0.05
    assert seconds(400_000) < 5


def test_sums_and_regions():
    rng = random.Random(1)
    for _ in range(300):
        weights = [rng.choice([0, 0, 1, 50]) for _ in range(rng.randint(0, 20))]
        sums = line_blocks.window_sums(weights)
        assert sums == [sum(weights[i : i + 3]) for i in range(len(weights))]
        inside = {i for a, b, _ in line_blocks.regions(weights) for i in range(a, b)}
        assert {i for i, w in enumerate(weights) if w} <= inside and all(weights[a] for a, _, _ in line_blocks.regions(weights))
        assert all(any(weights[max(0, i - 2) : i + 3]) for i in inside)


def test_attributes_of_any_number_and_length():
    many = " ".join(f'data-{i}="<b>no {i}</b>"' for i in range(3000))
    long = "x <i>no</i> " * 2000
    page = f"<article><p {many}>First paragraph.</p><p title='{long}'>Second > first.</p><p a=\">\" b=x\"y>Third.</p><p \"odd>Fourth.</p><p a=\"open>Fifth.</p></article>"
    assert line_blocks.main_text(page) == "First paragraph.\nSecond > first.\nThird.\nFourth.\nFifth."


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<a b='", "<a href=", "<a x=\"y' ", "=\"'", "<p a=>x"])
def test_hostile_attributes(part):
    began = time.perf_counter()
    line_blocks.main_text("<article><p>" + part * 60_000)
    assert time.perf_counter() - began < 5


LONG = "A sentence of the article that goes on for a good while, with commas, and comes to an end at last with a stop."


@pytest.mark.parametrize("name", ["ad-free", "login-tutorial", "cookie-recipe", "related-work", "social", "newsletter-history", "promo"])
def test_names_do_not_overrule_text_that_surges(name):
    page = f"<article><p>{LONG}</p><div class='{name}'><p>Another. {LONG}</p></div><p>{LONG}</p></article>"
    assert "Another." in line_blocks.main_text(page)


@pytest.mark.parametrize("name", ["ad-slot", "cookie-banner", "site-nav", "sidebar-left", "comments", "newsletter-box"])
def test_names_of_boilerplate_alone_still_decide(name):
    assert "Another." not in line_blocks.main_text(f"<article><p>{LONG}</p><div class='{name}'><p>Another. {LONG}</p></div><p>{LONG}</p></article>")


def test_unnamed_link_lists_around_an_article_go_by_the_sums():
    links = "".join(f"<li><a href='/{i}'>Read this other story {i}</a></li>" for i in range(6))
    share = "<div><a href='#'>Post</a> <a href='#'>Mail</a> <a href='#'>Print</a></div>"
    text = line_blocks.main_text(f"<main><ul>{links}</ul><h1>Title</h1><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p>{share}<ul>{links}</ul></main>")
    assert text.split("\n") == ["Title", LONG, *[f"Read this other story {i}" for i in range(6)], LONG]
    assert "other story 3" in line_blocks.main_text(f"<main><h1>Links</h1><ul>{links}</ul></main>")  # nothing surges, so nothing is around it

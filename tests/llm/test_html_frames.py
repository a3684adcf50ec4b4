"""Pages whose head is left open, that stand in a form, or whose frame is named like furniture."""

import random

import pytest

from tidewright.llm import html_extract

from .fixtures import prose
from .test_html_pages import page, wanted

TEXT = prose(4, 80)
HEADS = "<head><title>t</title><meta charset='utf-8'><link rel='x' href='y'>", "<head><title>t</title><script>var a = '</head>';</script></head>", "<head>", ""
FRAMES = ("", ""), ("<form id='aspnetForm' action='/'>", "</form>"), ("<div class='widget-content'>", "</div>"), ("<form><div id='notices'>", "</div></form>")


def text(source):
    return html_extract.Page(source).text(None)


@pytest.mark.parametrize("source", [
    f"<html><head><title>t</title><body><article><p>{TEXT}</p></article></body></html>",
    f"<html><head><title>t</title><article><p>{TEXT}</p></article>",
    f"<html><head><title>t</title>{TEXT}<p></p>",
    f"<body><form id='aspnetForm'><div id='content'><p>{TEXT}</p></div></form></body>",
    f"<body><div class='social'><p>{TEXT}</p></div></body>",
    f"<body><div class='widget-content'>{TEXT}</div></body>",
    f"<body><section id='notices'><p>{TEXT}</p></section></body>",
    f"<body><div class='social'><form><article><p>{TEXT}</p></article></form></div></body>",
])
def test_frames_do_not_lose_the_page(source):
    assert text(source) == TEXT


def test_forms_and_furniture_still_go():
    long = prose(9, 300)
    for junk in (f"<form><p>{long}</p></form>", f"<div class='sidebar'><p>{long}</p></div>", f"<div class='comments'><p>{long}</p></div>"):
        assert text(f"<body>{junk}<article><p>{TEXT}</p></article></body>") == TEXT
    assert text(f"<body><form>search <p>the site</p></form><div class='story'><p>{TEXT}</p></div></body>") == TEXT
    assert text(f"<body><div class='comments'><p>{TEXT}</p></div></body>") == ""
    assert text("<body><div class='cookie-notice'>we use cookies</div><article></article></body>") == ""
    assert text(f"<body><article><p>{TEXT}</p><form><p>your mail</p></form></article></body>") == TEXT


def test_names_of_paragraphs_headings_and_headers_in_articles():
    kept = "<p class='social'>About social policy.</p>", "<p class='notice'>Kept.</p>", "<h2 class='discussion'>Discussion</h2>", "<div class='article-header'><h2>Part</h2></div>"
    lost = "<p class='ad'>Buy now.</p>", "<p class='share'>Share this</p>", "<h3 class='comments'>12 comments</h3>", "<div class='site-header'><h2>The site</h2></div>", "<h3 class='comments-title'>Replies</h3>"
    for around in ("article", "main"):
        assert text(f"<body><{around}>{''.join(kept)}{''.join(lost)}<p>{TEXT}</p></{around}></body>") == f"About social policy.\nKept.\nDiscussion\nPart\n{TEXT}"


def test_heads_and_forms_around_generated_pages():
    r = random.Random(5)
    for _ in range(60):
        plain = page(r, "article", articles=r.choice([1, 2]))
        before, after = r.choice(FRAMES)
        source = plain.replace("<html>", "<html>" + r.choice(HEADS)).replace("<body class='t'>", "<body class='t'>" + before).replace("</body>", after + "</body>")
        assert text(source) == wanted(plain, "article")

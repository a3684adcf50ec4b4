"""Extraction against an independent extractor over generated pages."""

import random
from html.parser import HTMLParser

import pytest

from tidewright.llm import html_extract

from .fixtures import prose

JUNK_TAGS = {"nav", "footer", "aside", "form", "script", "style", "header"}
JUNK_CLASSES = {"sidebar", "comments", "ad", "share-buttons", "cookie-notice", "menu"}
BLOCKS = {"p", "div", "li", "ul", "h1", "h2", "td", "tr", "table", "blockquote", "article", "section", "main", "body", "html"}


class Reference(HTMLParser):
    """Text blocks below the main elements, without what stands in junk. Knows only well-formed pages."""

    def __init__(self, inside):
        super().__init__(convert_charrefs=True)
        self.inside, self.stack, self.blocks, self.text = inside, [], [], ""

    def flush(self):
        if self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            return self.flush()
        names = (dict(attrs).get("class") or "").split()
        if tag in BLOCKS or tag in JUNK_TAGS:
            self.flush()
        self.stack.append((tag, tag in JUNK_TAGS or bool(set(names) & JUNK_CLASSES), tag == self.inside or self.inside in names))

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in JUNK_TAGS:
            self.flush()
        self.stack.pop()

    def handle_data(self, data):
        if any(m for _, _, m in self.stack) and not any(j for _, j, _ in self.stack):
            self.text += data


def body(r, blocks):
    out = []
    for k in range(blocks):
        words = prose(r.randrange(10**6), r.randint(5, 60))
        out.append(r.choice([
            f"<p>{words}</p>", f"<h2>{words[:30]}</h2>", f"<p>a &amp; b &lt;{words}&gt; <b>bold</b>\n  <i>it</i></p>", f"<ul><li>{words}</li><li>x{k}</li></ul>", f"<blockquote><p>{words}</p></blockquote>",
            f"<div class='body'><p>{words}</p><p>{words}</p></div>", f"<table><tr><td>{words}</td><td>{k}</td></tr></table>", f"<p>{words}<br>after {k}</p>", "<div class='ad'>buy now</div>", "<div class='share-buttons'><a href='#'>share</a></div>", "<script>var x = '<p>no</p>';</script>",
        ]))
    return "".join(out)


def page(r, main, articles=1, depth=0):
    wrapper = r.choice(["content with-sidebar", "page", "layout has-sidebar", "no-comments", "wrap", "js-menu-off"])
    mains = "".join(f"<{main}><h1>Title {k}</h1>{body(r, r.randint(3, 25))}<p>{prose(r.randrange(10**6), 40)}</p></{main}>" for k in range(articles))
    junk = "<nav><ul><li><a href='/'>home</a></li></ul></nav>", "<div class='sidebar'><p>side text</p></div>", "<div class='cookie-notice'>we use cookies</div>", "<footer><p>footer text</p></footer>", f"<div class='comments'><p>{prose(3, 30)}</p></div>"
    before, after = r.sample(junk, 2), r.sample(junk, 3)
    return f"<html><body class='t'><header><p>site name</p></header><div class='{wrapper}'>{'<div>' * depth}{''.join(before)}{mains}{''.join(after)}{'</div>' * depth}</div></body></html>"


def wanted(source, inside):
    reader = Reference(inside)
    reader.feed(source)
    reader.flush()
    return "\n".join(reader.blocks)


@pytest.mark.parametrize("main", ["article", "main"])
def test_equals_an_independent_extractor(spark, main):
    r = random.Random(11)
    pages = [(k, f"http://host{k % 7}.com/{k}", page(r, main, articles=r.choice([1, 1, 1, 2, 3]) if main == "article" else 1)) for k in range(80)]
    pages += [(1000 + k, f"http://deep{k}.com/", page(r, main, depth=depth)) for k, depth in enumerate((200, 2000))]
    pages += [(2000, "http://long.com/", page(r, main).replace("Title 0", "long word " * 200_000)), (2001, None, page(r, main)), (2002, "http://host1.com/empty", ""), (2003, "http://host1.com/null", None)]
    pages.append(pages[0])
    found = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(found) == len(pages)
    source = {p[0]: p[2] for p in pages}
    wrong = [x.page_id for x in found if x.text != (wanted(source[x.page_id], main) if source[x.page_id] else "") or x.n_chars != len(x.text)]
    assert wrong == []


def test_two_articles_without_a_winning_path():
    one, two = prose(1, 40), prose(2, 30)
    assert html_extract.Page(f"<body><article><p>{one}</p></article><article><p>{two}</p></article></body>").text(None) == f"{one}\n{two}"


def test_names_of_what_a_container_has():
    text = prose(5, 60)
    for name in ("content with-sidebar", "no-comments", "header-less", "has-menu", "layout-sidebar"):
        assert html_extract.Page(f"<body><div class='{name}'><p>{text}</p></div></body>").text(None) == text
    for name in ("left-sidebar-2", "global-nav", "site-header", "fb-comments", "top-ad-banner"):
        assert html_extract.Page(f"<body><div class='{name}'><p>furniture</p></div><div class='story'><p>{text}</p></div></body>").text(None) == text
    longer = f"<body><div class='disqus-thread'><p>{prose(6, 300)}</p></div><div class='story'><p>{text}</p></div></body>"
    assert html_extract.Page(longer).text(None) == text

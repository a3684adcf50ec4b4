from tidewright.llm import html_extract

from .fixtures import prose

LEAD, LONG, END = prose(1, 30), prose(2, 200), prose(3, 20)
WHOLE = f"Title\n{LEAD}\n{LONG}\n{END}"
LAYOUTS = {
    "inner.com": f'<body><article><h1>Title</h1><p>{LEAD}</p><div class="body"><p>{LONG}</p></div><p>{END}</p></article></body>',
    "sections.com": f'<body><main><section class="a"><h1>Title</h1><p>{LEAD}</p></section><section class="b"><p>{LONG}</p></section><section class="c"><p>{END}</p></section></main></body>',
    "table.com": f"<body><article><h1>Title</h1><p>{LEAD}</p><table><tr><td>{LONG}</td></tr></table><p>{END}</p></article></body>",
    "div.com": f'<body><div id="top"><a href="/">a few links only</a></div><div id="content"><h1>Title</h1><p>{LEAD}</p><div class="body">{LONG}</div><p>{END}</p></div></body>',
    "bare.com": f"<h1>Title</h1><p>{LEAD}</p><div>{LONG}</div><p>{END}</p>",
    "html.com": f"<html><h1>Title</h1><p>{LEAD}</p><p>{LONG}</p><div>{END}</div></html>",
}


def extracted(spark, pages):
    return {r.url: r.text for r in html_extract.extract(spark.createDataFrame(pages, "url string, html string")).collect()}


def test_whole_articles_of_any_layout(spark):
    odd = f'<body><article hidden><p>x</p></article><div class="story"><p>{LONG}</p></div></body>'
    pages = [(f"http://{host}/{k}", page) for host, page in LAYOUTS.items() for k in range(3)] + [("http://inner.com/odd", odd)]
    found = extracted(spark, pages)
    assert found.pop("http://inner.com/odd") == LONG
    assert {url: text for url, text in found.items() if text != WHOLE} == {}


def test_names_inside_of_articles_drop_only_what_is_no_text(spark):
    kept = ["<section id='discussion'><p>{}</p></section>", "<h2 id='related-work'>{}</h2>", "<h2 id='copyright-history'>{}</h2>", "<div class='social-science'>{}</div>", "<h2 id='navigation'>{}</h2>", "<p id='notice'>{}</p>", "<section id='login-and-menu-design'><p>{}</p></section>", "<h3 class='share'>{}</h3>"]
    lost = ["<div class='ad-slot'>{}</div>", "<div class='share-buttons'>{}</div>", "<div class='comment-12'>{}</div>", "<section id='comments'>{}</section>", "<div class='related-articles'>{}</div>", "<div class='newsletter'>{}</div>", "<div class='big ad'>{}</div>", "<div id='comment-list'>{}</div>", "<div class='ad' id='x'><h2>{}</h2></div>"]
    body = "".join(t.format(f"kept {k}") for k, t in enumerate(kept)) + "".join(t.format(f"lost {k}") for k, t in enumerate(lost))
    page = f"<body><div class='social-bar'>outside</div><article><p>{LONG}</p>{body}</article></body>"
    assert extracted(spark, [("http://a.com", page)])["http://a.com"].split("\n") == [LONG, *(f"kept {k}" for k in range(len(kept)))]

"""HTML extraction by consensus host paths.

Every page is cut into blocks of text under a tree of block elements. Containers are scored by the text that
their near descendants hold, less what stands in links, and the best one is widened to its article or main
element, or, outside of those, to the smallest container that holds nearly all text; the page itself counts as
a container. A page votes for the generalised tag-class path (digits as #) of what it finds so. Votes are summed in Spark by host and path; the host's winning path then
says where the main text stands on all of its pages. A page is extracted again from the elements at that
path, or from its own best container where it has no text there.

Dropped inside and outside of containers: menus, headers (headings inside of an article stay), footers,
sidebars, notices, adverts, forms, scripts, styles, comments of markup and of readers, recognised by element,
role, or class and id: by whole names or known compounds, inside of articles never headings; outside of articles
other compounds with such a word drop what holds at most half of the page's text, unless they say what a
container has or lacks (with-sidebar). A form or a container of such a whole name, not of readers' comments, that
holds nearly all text of a page, WHOLE_PAGE code points at least, is the page's frame and stays, unless text
stands in an article outside of it. A head that is not closed ends at the first text or block element. Character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined by one line feed in page order; <br> ends a block. Nothing else is
dropped or capped; two paths with one 64-bit key count as one.

Defined results: null html counts as empty; a page without text gives the empty string. A null url, or one
without host, votes under the empty host. A tag that the page's end cuts off is markup. Ties of votes go to
the path that sorts last. Repeated rows are all extracted. Input columns named like an output column are
replaced. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small
from .url_filters import url_host

#: Share of the kept text outside links that a container outside of articles must hold.
NEARLY_ALL = 0.9
#: Code points outside links that a form, or a container named like furniture, must hold to be taken for a page's frame.
WHOLE_PAGE = 200

#: Elements, roles and words of class and id.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("article body div main section td".split())
RAW = frozenset("script style noscript template iframe textarea title svg object select button xmp".split())
DROPPED = frozenset("nav footer aside menu dialog head fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note status".split())
DROPPED_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget login toolbar pagination pager copyright masthead".split())
#: Inside of articles, a name counts as a whole, or as words of DROPPED_WORDS with these and numbers only; ids that are slugs of ordinary headings do not count.
FITTINGS = frozenset("area article articles banner bar block body bottom box button buttons center container content count form group header heading icon icons inner item items js label left link links list media module outer page panel post posts right section site slot stories story title text tool tools top unit wrap wrapper".split())
SLUGS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navigation menu footer comment reply replies discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget login pagination copyright masthead".split())
#: Words that say in a compound what a container has or lacks; such a name drops nothing. Words of readers' comments, which may hold most of a page.
STATES = frozenset("with without has have no non not less show hide is open off layout theme template".split())
READERS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Inside of articles: words of a class that may name a paragraph's topic, words of a heading's class that stand for readers' comments, and words that make a page's header of "header".
TOPICS = frozenset("social related discussion notice notices notification alert copyright respond navigation".split())
COMMENT_WORDS = READERS - {"discussion"}
SITE_WORDS = frozenset("site global page top main".split())
TEXT_BLOCKS = HEADINGS | frozenset("p blockquote pre dt dd li caption figcaption summary".split())
#: What an opening tag ends, up to the element that holds it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+>|</?[a-zA-Z][^>]*+\Z""",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
_PARTS = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")


def _is_furniture(name: str) -> bool:
    """Whether a class or id inside of an article says that its element is no text of it."""
    parts = [w for w in _PARTS.split(name) if w]
    return name in DROPPED_WORDS or (bool(DROPPED_WORDS.intersection(parts)) and all(w in DROPPED_WORDS or w in FITTINGS or w.isdigit() for w in parts))


def _is_site_header(name: str) -> bool:
    """Whether a class or id inside of an article is that of the site's or page's header."""
    parts = {w for w in _PARTS.split(name) if w}
    return "header" in parts and bool(parts & SITE_WORDS) and parts <= SITE_WORDS | {"header"}


class Page:
    """Block elements of a page (tag, step and key of its path, parent, dropped) and its text blocks (element, text, share of it outside links).

    A path's key is a 64-bit hash of its parent's key and its last step, so that deep pages cost no more an element than flat ones.
    """

    def __init__(self, source: str):
        self.tag, self.step, self.key, self.parent, self.dropped = ["#"], [""], [0], [0], [False]
        self.article, self.shown, self.holder, self.weak, self.frame = [False], [True], [0], [False], [False]
        self.blocks: list[tuple[int, str, float]] = []
        self._stack, self._parts, self._linked, self._in_link = [0], [], 0, False
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        at = 0
        while m := _TOKEN.search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._close(tag)
            elif tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
                if tag not in ("button", "select", "svg"):
                    continue
            elif tag == "br":
                self._flush()
            elif tag == "a":
                self._in_link = True
            elif tag in BLOCKS:
                self._open(tag, m[3] if m[2] else m[6])
        self._text(source[at:])
        self._flush()

    def _text(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._in_link:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._parts:
            raw = "".join(self._parts)
            if text := " ".join(entities.unescape(raw).split()):
                self._end_head()
                self.blocks.append((self._stack[-1], text, 1 - min(1.0, self._linked / len(raw))))
            self._parts, self._linked = [], 0

    def _end_head(self) -> None:
        """A head whose end tag is left out ends where the body's content begins."""
        if self.tag[self._stack[-1]] == "head":
            self._stack.pop()

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        self._in_link = False
        if tag == "hr":
            return
        if tag not in ("head", "html"):
            self._end_head()
        if self.tag[self._stack[-1]] == "p":
            self._stack.pop()
        if tag in ENDS:
            ended, holders = ENDS[tag]
            for k in range(len(self._stack) - 1, 0, -1):
                if self.tag[self._stack[k]] in holders:
                    break
                if self.tag[self._stack[k]] in ended:
                    del self._stack[k:]
                    break
        up = self._stack[-1]
        found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _NAMED.findall(attributes)} if attributes.strip() else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        self.tag.append(tag)
        self.parent.append(up)
        self.step.append(tag + "".join(f".{_DIGITS.sub('#', n)}" for n in sorted(set(names))))
        self.key.append(xxhash.xxh3_64_intdigest(f"{self.key[up]}/{self.step[-1]}") >> 1)
        self.holder.append(len(self.tag) - 1 if tag in CONTAINERS else self.holder[up])
        self.weak.append(False)
        self.frame.append(False)
        self.article.append(self.article[up] or tag in ("article", "main"))
        self.shown.append(tag in HEADINGS or (tag != "header" and self.shown[up]))
        dropped = self._is_dropped(tag, self.article[up], names, found)
        self.dropped.append(dropped or (tag != "body" and self.dropped[up]))
        self._stack.append(len(self.tag) - 1)

    def _is_dropped(self, tag: str, in_article: bool, names: list[str], found: dict[str, str]) -> bool:
        if tag in DROPPED or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in DROPPED_ROLES:
            return True
        words = {w for n in names for w in (n, *_PARTS.split(n))}
        if tag in ("body", "html", "article", "main"):
            return bool({"comment", "comments", "reply"} & words)
        if in_article:
            classes = found.get("class", "").split()
            if tag in HEADINGS:
                return any(_is_furniture(n) and COMMENT_WORDS.intersection(_PARTS.split(n)) for n in classes)
            if tag == "p":
                return any(_is_furniture(n) and not DROPPED_WORDS.intersection(_PARTS.split(n)) <= TOPICS for n in classes)
            ids = () if tag in TEXT_BLOCKS else (n for n in found.get("id", "").split() if n not in SLUGS)
            return tag == "form" or any(_is_furniture(n) or _is_site_header(n) for n in (*classes, *ids))
        if tag in ("form", "header") or any(n == "header" or _is_furniture(n) for n in names):
            self.frame[-1] = tag != "header" and not any(READERS.intersection(_PARTS.split(n)) for n in names)
            return not self.frame[-1]
        told = [p for n in names for p in [set(_PARTS.split(n))] if not p & STATES]
        self.weak[-1] = any(p & (DROPPED_WORDS | {"header"}) for p in told)
        return self.weak[-1] and any(p & READERS for p in told)

    def _settle(self) -> None:
        """Drops the forms and named containers outside of articles, but for a page's frame; then those whose compound names only hint at it, but for those that hold most of the page's text."""
        if any(self.frame):
            held = self._held()
            least = max(NEARLY_ALL * held[0], WHOLE_PAGE)
            apart = self._articles_apart()
            for e in range(1, len(self.tag)):
                self.dropped[e] = self.dropped[e] or (self.tag[e] != "body" and self.dropped[self.parent[e]]) or (self.frame[e] and (apart[e] or held[e] < least))
        if any(self.weak):
            held = self._held()
            for e in range(1, len(self.tag)):
                self.dropped[e] = self.dropped[e] or (self.tag[e] != "body" and self.dropped[self.parent[e]]) or (self.weak[e] and held[e] <= held[0] / 2)

    def _articles_apart(self) -> list[bool]:
        """Of each element, whether kept text stands in an article or main element outside of it."""
        inside = [0] * len(self.tag)
        for element, _, _ in self.blocks:
            inside[element] += self.article[element] and not self.dropped[element]
        for e in range(len(inside) - 1, 0, -1):
            inside[self.parent[e]] += inside[e]
        return [n < inside[0] and not self.article[e] for e, n in enumerate(inside)]

    def _held(self) -> list[float]:
        """Of each element the kept text outside links."""
        held = [0.0] * len(self.tag)
        for element, text, plain in self.blocks:
            if not self.dropped[element]:
                held[element] += plain * len(text)
        for e in range(len(held) - 1, 0, -1):
            held[self.parent[e]] += held[e]
        return held

    def path(self, element: int) -> str:
        """The generalised path, spelled out."""
        steps = []
        while element:
            steps.append(self.step[element])
            element = self.parent[element]
        return "".join(f"/{x}" for x in reversed(steps))

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
        elif tag == "p" or tag in BLOCKS:
            self._flush()
            for k in range(len(self._stack) - 1, 0, -1):
                if self.tag[self._stack[k]] == tag:
                    del self._stack[k:]
                    break

    def scores(self) -> dict[int, float]:
        """Of each container: the kept text of its near descendants, by nearness."""
        found: dict[int, float] = defaultdict(float)
        for element, text, plain in self.blocks:
            if not self.dropped[element]:
                at, share = self.holder[element], 1.0
                while share > 0.1:
                    found[at] += share * plain * len(text)
                    share /= 2
                    if not at:
                        break
                    at = self.holder[self.parent[at]]
        return found

    def best(self, scores: dict[int, float]) -> int:
        """The container of the best score, widened to its outermost article or else its main, or else to the smallest container around it that holds nearly all text."""
        at = max(scores, key=lambda e: (scores[e], -e), default=0)
        around = [at]
        while around[-1]:
            around.append(self.parent[around[-1]])
        for tag in ("article", "main"):
            if found := [e for e in around if self.tag[e] == tag]:
                return found[-1]
        held = self._held()
        return next((e for e in around if (self.tag[e] in CONTAINERS or not e) and held[e] >= NEARLY_ALL * held[0]), 0)

    def text(self, key: int | None) -> str:
        """The blocks under the elements at the path of that key, or else at the path of the page's own best container; of a header inside of an article, headings stay."""
        if found := self._under([k == key for k in self.key]):
            return found
        own = self.key[self.best(self.scores())]
        return self._under([k == own for k in self.key])

    def _under(self, inside: list[bool]) -> str:
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parent[i]]
        return "\n".join(t for e, t, _ in self.blocks if inside[e] and self.shown[e] and not self.dropped[e])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, int], list] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(source.as_py() or "")
            if scores := page.scores():
                best = page.best(scores)
                vote = votes.setdefault((host, page.key[best]), [page.path(best), 0.0, 0])
                vote[1] += max(scores.values()) / sum(len(t) for _, t, _ in page.blocks)
                vote[2] += 1
        rows = [(h, k, *v) for (h, k), v in votes.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "key", "path", "weight", "pages"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The winning path of each host: host, key, path, weight, pages."""
    votes = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_votes, "host string, key long, path string, weight double, pages long")
    summed = votes.groupBy("host", "key").agg(F.min("path").alias("path"), F.round(F.sum("weight"), 6).alias("weight"), F.sum("pages").alias("pages"))
    return summed.groupBy("host").agg(F.max(F.struct("weight", "path", "key", "pages")).alias("won")).select("host", "won.key", "won.path", "won.weight", "won.pages")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with text and n_chars."""
    won = small(host_paths(pages, url_col, html_col).select(F.xxhash64("host").alias("_tw_host"), F.col("key").alias("_tw_key")))  # two longs a host

    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sources, keys in batches:
            yield pa.array([Page(s.as_py() or "").text(k.as_py()) for s, k in zip(sources, keys, strict=True)], pa.string())

    found = pages.withColumn("_tw_host", F.xxhash64(url_host(F.col(url_col)))).join(won, "_tw_host", "left")
    return found.withColumn("text", text(F.col(html_col), F.col("_tw_key"))).withColumn("n_chars", F.length("text").cast("long")).drop("_tw_host", "_tw_key")

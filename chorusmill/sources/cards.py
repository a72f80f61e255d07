"""Comment cards of saved pages: one row for each comment that a page shows."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity

# Labels of a card's controls, words beside an author, how far a card may reach above its time.
SITE = "https://www.instagram.com/"
REPLY_LABEL = re.compile(r"(?i)(?:reply|回复)")
CONTROL_LABEL = re.compile(r"(?i)(?:reply|回复|like|赞|查看翻译|see translation)")
LIKES_LABEL = re.compile(r"(?i)\d[\d,.]*\s*(?:likes?|次赞)")
LIKES = re.compile(r"(?i)(?:^|\s)(\d[\d,.]*)\s*(?:likes?|次赞|赞)(?:\s|$)")
VERIFIED = re.compile(r"(?i)已验证|verified")
PROFILE_PATH = re.compile(r"/[A-Za-z0-9._]+/")
COMMENT_PATH = re.compile(r"/c/(\d+)(?:/|$)")
REACH = 12

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset("script style template noscript title head".split())
#: Elements whose text stands on lines of its own.
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

CARD = "struct<comment_id:string,parent_comment_id:string,depth:int,author:string,comment_text:string,published_at:string,published_label:string,like_count:string,comment_url:string>"
_PAGE = f"struct<canonical:string,og_url:string,node_count:int,cards:array<{CARD}>>"


def _clean(text: str) -> str:
    return " ".join(text.split())


class _Page(HTMLParser):
    """A page's elements in document order. Each knows its parent, where its last descendant ends, and its part of the text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.end = ["#"], [{}], [-1], [0]
        self.text: list[str] = []
        self.text_from, self.text_to = [0], [0]
        self.open, self.silent = [0], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p"):
            self._close_implied(tag)
        if tag in _BLOCKS:
            self.text.append("\n")
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.parent.append(self.open[-1])
        self.text_from.append(len(self.text))
        self.text_to.append(len(self.text))
        self.end.append(len(self.tag))
        if tag not in _VOID:
            self.open.append(len(self.tag) - 1)
            self.silent += tag in _SILENT

    def _close_implied(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[at]]
            if name == tag:
                self._pop(at)
            if name == tag or name in ("ul", "ol", "div", "section", "article", "body"):
                return

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[at]] == tag:
                self._pop(at)
                return

    def _pop(self, at):
        for k in reversed(self.open[at:]):
            self.end[k], self.text_to[k] = len(self.tag), len(self.text)
            self.silent -= self.tag[k] in _SILENT
            if self.tag[k] in _BLOCKS:
                self.text.append("\n")
        del self.open[at:]

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data.replace("\n", " ").replace("\r", " "))

    def closed(self) -> _Page:
        self.close()
        self._pop(1)
        self.end[0], self.text_to[0] = len(self.tag), len(self.text)
        return self

    def inner(self, k: int) -> str:
        """Text with line breaks at blocks."""
        return "".join(self.text[self.text_from[k] : self.text_to[k]])

    def label(self, k: int) -> str:
        return _clean(self.inner(k).replace("\n", " "))

    def under(self, k: int):
        return range(k + 1, self.end[k])

    def above(self, k: int, *tags: str) -> int:
        """The nearest of k and its ancestors that is one of tags, 0 if none is."""
        while k > 0 and self.tag[k] not in tags:
            k = self.parent[k]
        return max(k, 0)

    def href(self, k: int) -> str | None:
        return urljoin(SITE, self.attrs[k]["href"]) if self.tag[k] == "a" and "href" in self.attrs[k] else None

    def link_around(self, k: int) -> int:
        k = self.above(k, "a")
        while k and "href" not in self.attrs[k]:
            k = self.above(self.parent[k], "a")
        return k

    def is_button(self, k: int) -> bool:
        return self.tag[k] == "button" or self.attrs[k].get("role") == "button"


def _comment_id(href: str | None) -> str | None:
    try:
        parts = urlsplit(href or "")
    except ValueError:
        return None
    found, asked = COMMENT_PATH.search(parts.path), parse_qs(parts.query)
    return found[1] if found else (asked.get("comment_id") or asked.get("commentId") or [None])[0]


def _is_profile(href: str | None) -> bool:
    try:
        return bool(href) and bool(PROFILE_PATH.fullmatch(urlsplit(href).path))
    except ValueError:
        return False


def _card_nodes(page: _Page) -> list[int]:
    """Elements around a permalink's time that hold a reply control and a profile link; without any, list items of a post."""
    reply = [k for k in range(1, len(page.tag)) if page.is_button(k) and REPLY_LABEL.fullmatch(page.label(k))]
    profile = [k for k in range(1, len(page.tag)) if _is_profile(page.href(k)) and page.label(k)]
    holds = lambda k, marks: any(k < m < page.end[k] for m in marks)
    found = []
    for time in (k for k in range(1, len(page.tag)) if page.tag[k] == "time" and "datetime" in page.attrs[k]):
        link = page.link_around(time)
        if not link or not _comment_id(page.href(link)):
            continue
        k = page.parent[time]
        for _ in range(REACH):
            if k <= 0 or page.tag[k] == "body":
                break
            if holds(k, reply) and holds(k, profile):
                found.append(k)
                break
            k = page.parent[k]
    if found:
        return list(dict.fromkeys(found))
    posts = [k for k in range(1, len(page.tag)) if page.tag[k] == "article" or page.attrs[k].get("role") == "dialog"]
    return [k for k in range(1, len(page.tag)) if page.tag[k] == "li" and page.above(page.parent[k], "ul") and any(p < page.above(page.parent[k], "ul") and k < page.end[p] for p in posts)]


def _card(page: _Page, k: int) -> dict | None:
    links = [j for j in page.under(k) if page.href(j) is not None]
    who = next((j for j in links if _is_profile(page.href(j)) and page.label(j)), None)
    author = VERIFIED.sub("", page.label(who)).strip().removeprefix("@").strip() if who else None
    permalink = next((j for j in links if _comment_id(page.href(j))), None)
    time = next((j for j in page.under(k) if page.tag[j] == "time" and "datetime" in page.attrs[j]), None)
    controls = {page.label(j) for j in page.under(k) if page.is_button(j)} | ({page.label(time)} if time else set())
    lines = [_clean(line) for line in page.inner(k).split("\n")]
    own = [x for x in lines if x and VERIFIED.sub("", x).strip() != author and x not in controls and not CONTROL_LABEL.fullmatch(x) and not LIKES_LABEL.fullmatch(x)]
    text = " ".join(own).strip()
    if not author or not text or text == author:
        return None
    parent = page.attrs[k].get("data-parent-comment-id") or None
    replies = page.above(k, "ul")
    above = page.above(page.parent[replies], "li") if replies else 0
    if not parent and above:
        outside = (j for j in page.under(above) if page.tag[j] == "time" and "datetime" in page.attrs[j] and not replies < j < page.end[replies])
        parent = next((i for i in (_comment_id(page.href(page.link_around(j))) for j in outside) if i), None)
    likes = LIKES.search(page.label(k))
    return {
        "comment_id": page.attrs[k].get("data-comment-id") or (_comment_id(page.href(permalink)) if permalink else None), "parent_comment_id": parent, "depth": 1 if parent else 0, "author": author, "comment_text": text,
        "published_at": page.attrs[time]["datetime"] if time else None, "published_label": page.label(time) if time else page.label(permalink) if permalink else None,
        "like_count": likes[1] if likes else None, "comment_url": page.href(permalink) if permalink else None,
    }


def _read(html: str | None) -> tuple:
    page = _Page()
    page.feed(html or "")
    page.closed()
    named = lambda tag, key, value, want: next((page.attrs[k].get(want) for k in range(len(page.tag)) if page.tag[k] == tag and page.attrs[k].get(key) == value), None)
    nodes = _card_nodes(page)
    return named("link", "rel", "canonical", "href"), named("meta", "property", "og:url", "content"), len(nodes), [c for c in (_card(page, k) for k in nodes) if c]


def _pages(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(h) for h in html], columns=["canonical", "og_url", "node_count", "cards"])


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of saved pages (url, html): identity of the page, its state, and its cards as comments.

    A page whose address, metadata and permalinks disagree, or which is no media at all, has no comments. Null and empty
    pages have none either; repeated pages stay.
    """
    read = pages.select("url", F.pandas_udf(_pages, _PAGE)("html").alias("p"))
    urls = F.filter(F.transform("p.cards", lambda c: c["comment_url"]), lambda u: u.isNotNull())
    checked = read.withColumn("identity", identity.verify_identity(F.col("url"), F.col("p.canonical"), F.col("p.og_url"), urls, F.lit(None).cast("string")))
    kept = F.when(F.col("identity.mismatch_count") == 0, F.col("p.cards")).otherwise(F.slice("p.cards", 1, 0))
    return checked.select("url", identity.canonical_media(F.col("url"))["media_id"].alias("media_id"), "identity", F.col("p.node_count").alias("node_count"), kept.alias("comments"))


def comment_cards(pages: DataFrame) -> DataFrame:
    """A row for each comment of saved pages (url, html), with its place on the page."""
    return page_captures(pages).select("url", "media_id", F.posexplode("comments").alias("pos", "c")).select("url", "media_id", "pos", "c.*")

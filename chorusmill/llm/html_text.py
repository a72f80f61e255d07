"""Main text of web pages by composite text density.

A tolerant pass builds the tree of block elements and links (formatting elements only pass their text
on and count as tags of the node they stand in). For every node: C characters, T tags, LC link characters and
LT link tags of its subtree give the density  C/T * log_b((C*T) / (LC*LT)),  b = ln(C*LC/(C-LC) + C*LC_body/C_body + e).  A node's sum is that
of its children's densities; the node with the largest sum is the core of the text. The least density on
its path to the body is the threshold from which blocks outside it count as text too, further article or main
elements by their sums. An article or main element around the core counts whole, so its headings and short
sections stay, but has no part in the choice of the core but for ties. Elements that are furniture by tag,
role, class or id never count. By form, fieldset, class and id that holds only where enough text stands
outside them: wrappers of the text that is otherwise found nowhere on the page are no furniture; threads of comments
only wrap where a main element or an h1 stands in them. In an article or main, a section with a heading and more text than
links is no furniture for a class word that may be its subject. Within the core, lists of links (LINKS links or more that
make up LINK_SHARE of an element's text) are menus and go, unless a heading introduces them or nothing else is left. The
last h1 before a core without one belongs to the text with the block it stands in, and so do elements of the
same kind as two chosen ones beside them, however short.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and class words by their part in a page.
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside button select menu dialog object canvas audio video head".split())
#: These and elements with the class words below may also wrap the text.
WRAPPERS = frozenset("form fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations widget toolbar pagination pager login search skip masthead".split()
)
#: Of these, parts that are often longer than the text itself.
THREAD_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Of these, words that may as well be what a section is about; and words beside `header` that make it a text's own.
SUBJECT_WORDS = frozenset("related recommended recommendations search social share sharing notice notices menu navigation consent login promotion subscription signup widget toolbar pagination".split())
TITLE_WORDS = frozenset("post entry article story content title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that may be a wrapper is one if the text outside furniture is less than this share of its own; the second is
#: for those with such an element, the third for those without elements that have text.
WRAPPER_SHARE, HEADED_SHARE, BARE_SHARE = 0.5, 1.0, 0.02
HEADED, THREAD_HEADED = frozenset("article main h1".split()), frozenset("main h1".split())
#: What makes an element a list of links.
LINKS, LINK_SHARE = 3, 0.9
HEADERS = frozenset(("header",))
ROOTS = frozenset("article main".split())
NEVER_FURNITURE = frozenset("html body article main".split())
CLOSED_BY = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)), "p": frozenset(("p",)),
}
SCOPES = frozenset("ul ol dl table body html article main section div".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)|[!?/][^>]*+>)""", re.S)
_ATTR = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden)(?=[\s=>/])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Tree:
    def __init__(self):
        self.parent = [-1]
        self.tag = ["html"]
        self.inner = [0]  # formatting and empty elements that stand directly in a node
        self.dead = [False]
        self.rooted = [False]
        self.named = [""]  # class attributes
        self.open: Counter[str] = Counter()  # how many elements of a name are open
        self.soft: dict[int, tuple[object, bool]] = {}  # nodes that may be furniture or wrappers: what makes them alike, thread words
        self.subjects: list[int] = []  # of these, sections whose class words may be their subject
        self.runs: list[tuple[int, int, str, bool]] = []  # block number, node, text, in a link
        self.block = 0

    def parse(self, page: str) -> None:
        stack = [0]
        at, n = 0, len(page)
        pos = page.find("<")
        links = 0
        while True:
            if pos < 0:
                self._text(page[at:], stack[-1], links)
                return
            m = _TAG.match(page, pos)
            if m is None:
                after = page[pos + 1 : pos + 2]
                if after.isalpha() or after in ("/", "!", "?"):  # a tag that never ends
                    self._text(page[at:pos], stack[-1], links)
                    return
                pos = page.find("<", pos + 1)
                continue
            if pos > at:
                self._text(page[at:pos], stack[-1], links)
            at = m.end()
            name = m[2]
            if name:
                name = name.lower()
                if m[1]:
                    links = self._close(name, stack, links)
                elif name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else n
                else:
                    links = self._open(name, m[3], stack, links)
            pos = page.find("<", at)

    def _text(self, raw: str, node: int, links: int) -> None:
        if raw and not self.dead[node]:
            self.runs.append((self.block, node, html.unescape(raw) if "&" in raw else raw, links > 0))

    def _open(self, name: str, rest: str, stack: list[int], links: int) -> int:
        if name in INLINE or name in VOID:
            self.inner[stack[-1]] += 1
        if name in INLINE:
            if name == "br":
                self._text(" ", stack[-1], links)
            return links
        if name == "a":
            if links == 0:
                self._push(name, rest, stack)
            return 1 if links == 0 else links
        if name in ("html", "body"):
            if name == "body" and self.tag[stack[-1]] == "html":
                self._push(name, "", stack)
            return links
        self.block += 1
        if name in VOID:
            return links
        closes = CLOSED_BY.get(name)
        if links or closes or self.tag[stack[-1]] == "p":
            while len(stack) > 1 and self.tag[stack[-1]] in ("a", "p"):
                links = 0 if self.tag[stack[-1]] == "a" else links
                self._cut(stack, len(stack) - 1)
        if closes and name != "p":
            k = len(stack) - 1
            while k > 0 and self.tag[stack[k]] not in SCOPES:
                if self.tag[stack[k]] in closes:
                    self._cut(stack, k)
                    break
                k -= 1
        self._push(name, rest, stack)
        return links

    def _push(self, name: str, rest: str, stack: list[int]) -> None:
        up = stack[-1]
        rooted = self.rooted[up] or name in ROOTS
        dead = self.dead[up] or name in FURNITURE or (name in HEADERS and not rooted)
        alike: object = None
        words: set[str] = set()
        named = ""
        if not dead and len(rest) > 1:
            for key, *value in _ATTR.findall(rest):
                key, text = key.lower(), "".join(value)
                if key in ("class", "id"):
                    words.update(_WORDS.findall(text.lower()))
                    named = text.lower() if key == "class" else named
                elif key == "role":
                    role = text.strip().lower()
                    rooted = rooted or role == "main"
                    dead = dead or (role in FURNITURE_ROLES and name not in NEVER_FURNITURE)
                elif key == "itemprop":
                    rooted = rooted or text.lower() == "articlebody"
                elif key == "hidden" or (key == "aria-hidden" and text.lower() == "true"):
                    dead = dead or name not in ("html", "body")
                elif key == "style":
                    dead = dead or _HIDDEN.search(text) is not None
            if name not in NEVER_FURNITURE and (not words.isdisjoint(FURNITURE_WORDS) or ("header" in words and not rooted and words.isdisjoint(TITLE_WORDS))):
                alike = (name, named) if named else len(self.parent)
        if alike is None and name in WRAPPERS:
            alike = len(self.parent)
        if alike is not None and not dead:
            self.soft[len(self.parent)] = alike, not words.isdisjoint(THREAD_WORDS)
            if name == "section" and self.rooted[up] and words & FURNITURE_WORDS <= SUBJECT_WORDS:
                self.subjects.append(len(self.parent))
        self.parent.append(up)
        self.tag.append(name)
        self.inner.append(0)
        self.dead.append(dead)
        self.rooted.append(rooted)
        self.named.append(named)
        self.open[name] += 1
        stack.append(len(self.parent) - 1)

    def _cut(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.open[self.tag[node]] -= 1
        del stack[k:]

    def _close(self, name: str, stack: list[int], links: int) -> int:
        if name in INLINE or name in VOID or name in ("html", "body"):
            if name == "br":
                self._text(" ", stack[-1], links)
            return links
        if name != "a":
            self.block += 1
        if not self.open[name]:
            return links
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == name:
                if any(self.tag[s] == "a" for s in stack[k:]):
                    links = 0
                self._cut(stack, k)
                break
            if name in ("a", "p") and tag not in ("a", "p"):
                break
        return links


def densities(parent: list[int], chars: list[int], link_chars: list[int], tags: list[int], is_link: list[bool], body: int) -> list[float]:
    """Composite density of every node, from the counts of its own text and tags; children follow their parents in the lists."""
    n = len(parent)
    c, lc = list(chars), list(link_chars)
    t, lt = list(tags), [1 if x else 0 for x in is_link]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        c[p] += c[k]
        lc[p] += lc[k]
        t[p] += t[k]
        lt[p] += lt[k]
    share = lc[body] / max(1, c[body])
    out = []
    for k in range(n):
        if not c[k]:
            out.append(0.0)
            continue
        base = math.log(c[k] * lc[k] / max(1, c[k] - lc[k]) + share * c[k] + math.e)
        ratio = c[k] * t[k] / (max(1, lc[k]) * max(1, lt[k]))
        out.append(c[k] / t[k] * math.log(max(ratio, 1.0)) / max(math.log(base), 0.1))
    return out


def _scores(tree: _Tree, off: list[bool]) -> tuple[int, list[float], list[float], list[int]]:
    """The body's number and, of every node, density, sum of its children's densities, and characters; nodes that are off have no text."""
    n = len(tree.parent)
    chars, link_chars = [0] * n, [0] * n
    for _, node, text, linked in tree.runs:
        if off[node]:
            continue
        k = len(text) if " " not in text else len(text.strip())
        chars[node] += k
        if linked:
            link_chars[node] += k
    body = next((k for k in range(n) if tree.tag[k] == "body"), 0)
    dens = densities(tree.parent, chars, link_chars, [1 + k for k in tree.inner], [t == "a" for t in tree.tag], body)
    sums = [0.0] * n
    whole = list(chars)
    for k in range(n - 1, 0, -1):
        whole[tree.parent[k]] += whole[k]
        sums[tree.parent[k]] += dens[k]
    return body, dens, sums, whole


def _off(tree: _Tree, wrappers: set[object]) -> list[bool]:
    """Which nodes are furniture or in furniture, if the elements alike to wrappers are none."""
    off = list(tree.dead)
    for k in range(1, len(off)):
        if off[tree.parent[k]] or (k in tree.soft and tree.soft[k][0] not in wrappers):
            off[k] = True
    return off


def _furniture(tree: _Tree) -> list[bool]:
    """Which nodes are furniture: of the elements that may be wrappers, those whose weighted text exceeds all text outside furniture are none."""
    n = len(tree.parent)
    wrappers: set[object] = set()
    if not tree.soft:
        return _off(tree, wrappers)
    own, linked_own, wraps = [0] * n, [0] * n, [False] * n
    headed, named, titled = ([tree.tag[k] in tags for k in range(n)] for tags in (HEADED, THREAD_HEADED, HEADINGS))
    for _, node, text, linked in tree.runs:
        (linked_own if linked else own)[node] += len(text.strip())
    within, linked_within = list(own), list(linked_own)
    for k in range(n - 1, 0, -1):
        up = tree.parent[k]
        within[up] += within[k]
        linked_within[up] += linked_within[k]
        for flags in (headed, named, titled):
            flags[up] |= flags[k]
        wraps[up] |= within[k] > 0
    for k in tree.subjects:
        if titled[k] and within[k] > linked_within[k]:
            del tree.soft[k]
    off = _off(tree, wrappers)

    def share(k: int, thread: bool) -> float:
        if thread:
            return HEADED_SHARE if named[k] else 0.0
        return BARE_SHARE if not wraps[k] else HEADED_SHARE if headed[k] else WRAPPER_SHARE

    weight = {k: within[k] * share(k, thread) for k, (_, thread) in tree.soft.items()}
    outside = sum(own[k] for k in range(n) if not off[k])
    for k in sorted(weight, key=lambda k: (-weight[k], k)):
        if off[k] and not off[tree.parent[k]] and weight[k] > outside:
            wrappers.add(tree.soft[k][0])
            off = _off(tree, wrappers)
            outside = sum(own[j] for j in range(n) if not off[j])
    return off


def _menus(tree: _Tree, off: list[bool], path: set[int]) -> list[bool]:
    """off, and the elements beside the path to the core whose text is that of links, and all in them.

    Paragraphs are none, and neither is what follows a heading at once.
    """
    n = len(tree.parent)
    before: dict[int, int] = {}
    led = [False] * n  # whether a heading comes just before, in this element or one that begins with it
    chars, linked, links = [0] * n, [0] * n, [0] * n
    for _, node, text, in_link in tree.runs:
        if not off[node]:
            size = len(text.strip())
            chars[node] += size
            linked[node] += size if in_link else 0
    for k in range(n - 1, 0, -1):
        up = tree.parent[k]
        links[k] += tree.tag[k] == "a" and chars[k] > 0
        chars[up] += chars[k]
        linked[up] += linked[k]
        links[up] += links[k]
    out = list(off)
    for k in range(1, n):
        up = tree.parent[k]
        if chars[k] and not off[k]:
            led[k] = tree.tag[before[up]] in HEADINGS if up in before else led[up]
            before[up] = k
        menu = k not in path and links[k] >= LINKS and linked[k] >= LINK_SHARE * chars[k] and tree.tag[k] != "p" and not led[k]
        out[k] = out[k] or out[tree.parent[k]] or menu
    return out if any(not out[node] and text.strip() for _, node, text, _ in tree.runs) else off


def _complete(tree: _Tree, off: list[bool], whole: list[int], inside: list[bool], core: int, path: set[int]) -> None:
    """Adds to inside the title's block before the core, and what is alike to two chosen blocks beside it."""
    n = len(tree.parent)
    linked = [0] * n
    for _, node, text, in_link in tree.runs:
        linked[node] += len(text.strip()) if in_link and not off[node] else 0
    for k in range(n - 1, 0, -1):
        linked[tree.parent[k]] += linked[k]
    text = [not off[k] and whole[k] > 0 and 2 * linked[k] <= whole[k] and tree.tag[k] != "a" for k in range(n)]
    fresh = set()
    titles = [k for k in range(n) if tree.tag[k] == "h1" and text[k]]
    if not any(inside[k] for k in titles):
        at = max((k for k in titles if k < core), default=0)
        while at and tree.parent[at] not in path:
            at = tree.parent[at]
        if at and text[at]:
            fresh.add(at)
    kind = lambda k: (tree.parent[k], tree.tag[k], tree.named[k])
    beside = [k for k in range(1, n) if tree.parent[k] in path and tree.named[k] and text[k]]
    chosen = Counter(kind(k) for k in beside if inside[k])
    fresh.update(k for k in beside if not inside[k] and chosen[kind(k)] >= 2)
    for k in range(1, n):
        inside[k] = inside[k] or k in fresh or tree.parent[k] in fresh
        if inside[k] and tree.parent[k] in fresh:
            fresh.add(k)


def extract(page: str | None) -> str:
    """The main text: blocks in page order joined by one newline, white space in a block as one space."""
    if not page:
        return ""
    tree = _Tree()
    tree.parse(page)
    n = len(tree.parent)
    off = _furniture(tree)
    body, dens, sums, whole = _scores(tree, off)
    choice = [k for k in range(n) if not off[k] and whole[k] and tree.tag[k] != "a"]
    if not choice:
        return ""
    core = max(choice, key=lambda k: (sums[k], tree.rooted[k], dens[k], -k))
    densest = core
    path = [core]
    while path[-1] != body and tree.parent[path[-1]] >= 0:
        path.append(tree.parent[path[-1]])
    threshold = min(dens[k] for k in path)
    core = next((k for k in reversed(path) if tree.rooted[k]), core)
    if path[-1] != 0:
        path.append(0)
    on_path = set(path)
    inside = [False] * n
    for k in range(n):
        up = tree.parent[k]
        inside[k] = k == core or (up >= 0 and inside[up])
        if not inside[k] and k not in on_path and not off[k] and whole[k] and tree.tag[k] != "a":
            root = tree.rooted[k] and not tree.rooted[up]
            inside[k] = dens[k] >= threshold or (root and sums[k] >= threshold)
    for k in path:  # text that stands between the blocks of the path
        inside[k] = True
    _complete(tree, off, whole, inside, core, on_path)
    out, last = [], -1
    off = _menus(tree, off, on_path | {densest})
    for block, node, text, _ in tree.runs:
        if not inside[node] or off[node]:
            continue
        if block == last:
            out[-1].append(text)
        else:
            out.append([text])
            last = block
    joined = (" ".join("".join(parts).split()) for parts in out)
    return "\n".join(x for x in joined if x)


def _run(batches):
    for batch in batches:
        texts = [extract(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page from its whole html; no shuffle.

    Null, empty or text-free html gives the empty text; null urls stay null; repeated rows stay; an empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by tree scoring.

The page becomes a tree of block elements.  Every paragraph passes points for its length and commas to its
ancestors, less the farther they are, and whole to the ``article`` or ``main`` around it; an element's score is
discounted by its link density, raised for ``article`` and ``main`` and lowered for doubtful names.  The best
container is kept, with siblings that score nearly as well.

Boilerplate is left out of scoring and text alike: elements that are nothing else (menus, footers, asides), and
elements whose class, id or role says so as far as length and links agree.  A name made of such words alone
(cookie-notice) drops an element unless it holds an article or most of the page; words that also occur in prose
sections (social, related) and names that merely contain one (social-history) need links or shortness as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.llm.common import own_columns

# HTML elements by kind, and words of class, id and role names that mark boilerplate.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "canvas", "object", "select", "math", "video", "audio", "noembed", "noframes", "xmp"}
DROPPED = {"nav", "footer", "aside", "button", "menu", "dialog", "head", "datalist", "map"}
DOUBTFUL = {"form", "fieldset"}
BLOCKS = set(
    "html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol option p pre search section summary table caption tbody td tfoot th thead tr ul button".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"}}
LIMITS = {"table", "ul", "ol", "dl", "article", "main", "section", "div", "body", "td", "th"}
NOISE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar toolbar comment comments disqus respond replies reply notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended widget widgets pagination pager skip search hidden complementary contentinfo form".split()
)
SOFT = {"social", "related", "recommended", "notice", "notices", "alert", "search", "share", "sharing", "reply", "form", "skip", "banner", "promotion"}
PLAIN = set("site page main global top bottom left right box block list area section container wrapper wrap inner outer bar row col item items link links post posts text message panel slot inline unit icons buttons button field body group".split())
COMMENTS = {"comment", "comments", "disqus", "respond", "replies", "reply"}
#: Attributes worth parsing, one attribute with its value, and the declarations that hide an element.
HIDES = re.compile("hidden|display|visibility", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDING = {("display", "none"), ("visibility", "hidden")}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A paragraph shorter than this passes no points; points are divided by these from the parent up.
SHORT, DIVISORS = 20, (1, 2, 6, 9, 12)
#: Factors of an article's or main's score, and of an element whose name merely contains a word of boilerplate.
ARTICLE, NAMED = 1.25, 0.5
#: Shares of the page (or, for SOFT words, of the element around) above which a name alone drops nothing; link density from
#: which a doubtful name is believed; characters up to which it is believed without links.
MOST_OF_PAGE, MUCH_OF_PARENT, LINKED, BRIEF = 0.7, 0.3, 0.3, 80


class _Element:
    __slots__ = ("tag", "parent", "items", "noise", "chars", "linked", "links", "score", "keeper", "names", "doubt", "home")

    def __init__(self, tag: str, parent, noise: bool, names: list):
        self.tag, self.parent, self.noise, self.names, self.doubt = tag, parent, noise, names, False
        self.home = self if tag in ("article", "main") else parent and parent.home
        self.items, self.chars, self.linked, self.links, self.score, self.keeper = [], 0, 0, 0, 0.0, tag in ("article", "main")


def _names(attributes: str) -> list[set]:
    """The words of every class, id and role name."""
    found = [token for a, b, c in _NAMED.findall(attributes) for token in (a or b or c).split()]
    return [{w.lower() for w in _NAME_WORD.findall(token)} for token in found]


def parse(html: str) -> tuple[_Element, list[_Element]]:
    """The tree of block elements (text items are (text, linked characters)), and its elements in page order."""
    root = _Element("html", None, False, [])
    order, now, parts, link, linked = [root], root, [], False, 0
    inside_article = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                now.items.append((text, min(linked, len(text))))
            parts, linked = [], 0

    def close(tags, limits=frozenset()):
        """Close the innermost open element of ``tags``, unless one of ``limits`` is in between."""
        nonlocal now, inside_article
        at = now
        while at is not root and at.tag not in tags:
            if at.tag in limits:
                return
            at = at.parent
        if at is root:
            return
        while True:
            done = now
            inside_article -= done.tag == "article"
            now = now.parent
            if done is at:
                return

    at, n, lowered = 0, len(html), None
    while at < n:
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                lowered = html.lower() if lowered is None else lowered
                end = lowered.find(f"</{tag}", at)
                at = n if end < 0 else end
            continue
        if tag == "a":
            link = not closing
            now.links += link
            continue
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
            elif not closing and tag in ("input", "img"):
                parts.append(" ")
            continue
        flush()
        if closing:
            close({tag})
            link = False
            continue
        if now.tag == "p" or tag in BLOCKS:
            close({"p"}, LIMITS)
        if tag in CLOSES:
            close(CLOSES[tag], {"ul", "ol", "table", "dl"} if tag != "body" else frozenset())
        if tag in VOID or tag in ("html", "body"):
            continue
        names = _names(attributes) if attributes else []
        noise = tag in DROPPED or bool(attributes and HIDES.search(attributes) and _hidden(attributes))
        if tag in DOUBTFUL or (tag == "header" and not inside_article):
            names.append({"footer"})  # as a name of boilerplate, so that length and what it holds count
        new = _Element(tag, now, noise, names)
        now.items.append(new)
        order.append(new)
        inside_article += tag == "article"
        now = new
    flush()
    return root, order


def _hidden(attributes: str) -> bool:
    """Whether an element's attributes hide it: ``hidden`` (but for until-found, which a reader can reach), ``aria-hidden`` or its style."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip().lower()
        if (name == "hidden" and value != "until-found") or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and any((d.partition(":")[0].strip(), d.partition(":")[2].partition("!")[0].strip()) in HIDING for d in value.split(";")):
            return True
    return False


def _kept(root: _Element, order: list[_Element]) -> None:
    """Totals from the leaves up, and which elements are boilerplate by their names."""
    for e in reversed(order):
        for item in e.items:
            if type(item) is tuple:
                e.chars += len(item[0])
                e.linked += item[1]
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.linked += e.linked
            e.parent.links += e.links
            e.parent.keeper |= e.keeper
    whole = root.chars or 1
    for e in order[1:]:
        if not e.noise and any(n & NOISE for n in e.names):
            e.noise = _named_noise(e, whole)
        if not e.noise and e.tag in ("ul", "ol", "div", "section", "table") and e.links >= 3 and e.linked >= 0.8 * e.chars:
            e.noise = True
        e.noise |= e.parent.noise
        e.doubt |= e.parent.doubt


def _named_noise(e: _Element, whole: int) -> bool:
    """Whether an element with a word of boilerplate in a name is dropped for it; otherwise it may be in doubt."""
    pure = [n & NOISE for n in e.names if n & NOISE and n <= NOISE | PLAIN]
    if any(n & COMMENTS for n in e.names) and (e.tag in ("article", "main") or not e.keeper):
        return True
    if e.keeper:
        return False  # a wrapper named after a part of it (page-with-sidebar), or the article itself
    if any(n - SOFT for n in pure):
        return e.chars <= MOST_OF_PAGE * whole
    short = e.chars <= MUCH_OF_PARENT * e.parent.chars if pure else e.chars <= BRIEF
    if short or e.linked >= LINKED * e.chars:
        return e.chars <= MOST_OF_PAGE * whole
    e.doubt = True
    return False


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order, white space inside a block as one space, joined by one space."""
    if not html:
        return ""
    root, order = parse(html)
    _kept(root, order)
    for e in order:
        if e.noise:
            continue
        for item in e.items:
            if type(item) is tuple and len(item[0]) >= SHORT:
                points = (1 + item[0].count(",") + item[0].count("、") + min(len(item[0]) / 100, 3)) * (1 - item[1] / len(item[0]))
                up = e.parent if e.tag in ("p", "pre", "td", "blockquote", "li") and e.parent is not None else e
                home = up.home
                for divisor in DIVISORS:
                    if up is None:
                        break
                    up.score += points if up is home else points / divisor
                    home = None if up is home else home
                    up = up.parent
                if home is not None:
                    home.score += points

    def value(e: _Element) -> float:
        factor = (ARTICLE if e.tag in ("article", "main") else 1) * (NAMED if e.doubt else 1)
        return factor * e.score * (1 - e.linked / e.chars) if e.chars else 0.0

    clean = [e for e in order if not e.noise]
    best = max(clean, key=value)
    if not value(best):
        articles = [e for e in clean if e.tag == "article" and e.chars] or [e for e in clean if e.tag == "main" and e.chars]
        picked = articles[:1] or [root]
    else:
        picked, least = [best], max(4.0, 0.2 * value(best))
        for s in best.parent.items if best.parent is not None else ():
            if type(s) is _Element and s is not best and not s.noise and s.chars:
                alike = best.tag != "article" or s.tag == "article"  # beside an article only further ones
                brief = s.tag in ("h1", "h2") or (s.tag in ("p", "pre", "blockquote") and s.linked < 0.25 * s.chars and s.chars > 80)
                if alike and (value(s) >= least or brief):
                    picked.append(s)
    chosen, out = set(map(id, picked)), []
    # Page order over the whole tree: texts below a picked element that are not boilerplate.
    stack = [(root, False)]
    while stack:
        item, taken = stack.pop()
        if type(item) is tuple:
            if taken:
                out.append(item[0])
            continue
        if item.noise:
            continue
        taken = taken or id(item) in chosen
        stack.extend((x, taken) for x in reversed(item.items))
    return " ".join(out)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``id_col``, ``url_col``, text (empty if there is none), n_chars (code points of the text).

    Edge cases: null or empty html, and pages of boilerplate only, give the empty text; a form or header around
    most of the page is a container like others; markup cut off at the
    end of the page closes there; repeated rows and null ids and urls are kept; an empty table gives an empty
    result; other columns are ignored; pages are read whole whatever their length or depth.
    """
    source = own_columns(pages, id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:2]]
    return source.mapInArrow(run, ", ".join([*kinds, "text string, n_chars long"]))

"""Main text of web pages by consensus host paths.

Every page is parsed once and its containers are scored by the text that stands in or right under
them, without link text and boilerplate. The best container's generalised path (tags with their
classes, digits as #, ids left out; at any depth) is the page's vote. Spark counts the votes per
host. Paths with two votes or more and at least ``SHARE`` of a host's (so 1 / SHARE at most) win and
go back to its pages, which are extracted again: from the deepest winning path whose elements hold
at least ``MOST`` of the text of the page's own best container, unless a winning path elsewhere on the
page has more votes times text than it; if none does, from the winning path with most votes that the
page has text at; without any, from the best container.

Threads of readers' comments go before the vote, at any share of the page, so they neither vote nor
weigh: elements whose class, or id of any but a section, names comments ('user-comments', 'commentlist'),
and, whatever they are called, ``THREAD`` or more siblings of one generalised step that each bear the
marks of a comment: a link or button to reply or report, or an author, a time, and no heading. What holds the
page's main heading, a ``main`` or all of its text is no thread.

Left out everywhere: menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments of readers, hidden elements. Class names and ids are judged as wholes: one drops an
element if it says nothing but boilerplate ('cookie-notice'), a class also if a part of it never means
content ('td-sidebar'), unless it tells a state or layout ('has-sidebar', 'comments-open'); an advert's at
the end ('google-ad') and a cookie's at the beginning are enough. Names that
content has as well ('discussion', 'related-work') drop an element only if at least ``LINKED`` of its
text is links; headings and paragraphs are never dropped by name, list items only as comments, nor is any
element by another name, or as a form, that holds more than ``MOST`` of a page's visible text. Character references are
decoded, white space inside a block becomes one space (a line break element counts as white space),
and blocks are joined by a newline in page order.

Null or empty html, and pages without text, give an empty text. A null url is a host of its own.
Repeated rows get equal results; other columns are carried along whatever their names; an input
column named like a result column is replaced. The parser keeps no recursion, so depth and length
are not limited.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, small_batches, trim, written

SHARE, MOST = 0.005, 0.5

# Names of HTML elements, and of the boilerplate that is left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIP = frozenset("head nav aside footer form dialog button select menu object audio video canvas script style textarea title noscript iframe xmp noembed noframes template svg".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login paywall popup modal overlay sidebar sidenav aside rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments disqus replies respond discussion share sharing social related recommended widget widgets hidden skip".split()
)
#: Of these, what a class never says of content in any compound, and what sections of content are called too.
SURE_WORDS = frozenset("adsense adbox advert adverts advertisement advertisements gdpr newsletter paywall popup sidebar sidenav nav navbar navigation breadcrumb breadcrumbs pagination footer masthead topbar disqus".split())
DOUBTFUL_WORDS = frozenset("discussion related share sharing social promotion recommended subscription consent rail aside skip notice alert menu".split())
#: What compounds of boilerplate names hold besides.
FILLERS = frozenset("area articles bar block bottom box button buttons container content foot form global group icons inner items left links list main message outer page panel posts primary region right secondary section site slot stories text thread top unit wrap wrapper".split())
#: Parts of class names that tell a state or the layout: such names say nothing of the element itself.
STATES = frozenset("has no with without is not open opened closed on off enabled disabled active inactive show hide layout template theme supports page body".split())
UNNAMED = frozenset("h1 h2 h3 h4 h5 h6 p li".split())
LINKED, THREAD = 0.3, 2
# What comments are called, what their marks are called, and what their links say (English, German, French, Spanish).
COMMENT_WORDS = frozenset("comment comments commentlist commentarea commentbox commentform commentthread commentsection usercomments readercomments disqus kommentar kommentare commentaire commentaires comentario comentarios".split())
AUTHOR_WORDS = frozenset("author user username nick nickname avatar gravatar commenter vcard byline poster userinfo".split())
TIME_WORDS = frozenset("date time datetime timestamp timeago posted published ago meta".split())
REPLY_WORDS = frozenset("reply replies respond report flag upvote downvote".split())
REPLY_TEXTS = frozenset(("reply", "reply to this", "report", "report abuse", "flag", "quote", "antworten", "melden", "répondre", "signaler", "responder", "denunciar"))
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: A new element of the first kind ends an open one of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl select article section div main body html td th aside nav".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|[^>]*+(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
_PART = re.compile(r"[^a-z]+")
#: Compounds in one word: 'topnav', 'cookiebar'.
_BAR = re.compile(r"(?:top|main|sub|foot|bottom|left|right|page|site|primary|mobile)nav|(?:cookie|consent|gdpr|ad|promo|share|social|menu|nav)(?:bar|box|banner|popup|wall|notice)")


class Element:
    __slots__ = ("tag", "path", "depth", "parent", "drop", "skip", "inside", "score", "text", "link", "total", "links", "marks")

    def __init__(self, tag: str, path: int, depth: int, parent: Element | None, drop: int, inside: bool) -> None:
        self.tag, self.path, self.depth, self.parent, self.drop, self.inside = tag, path, depth, parent, drop, inside
        self.skip = False
        self.score = 0.0
        self.text = self.link = self.total = self.links = self.marks = 0


#: What is seen in an element.
AUTHOR, TIME, REPLY, HEADING, MAIN = (1 << k for k in range(5))
#: What is known of an element when it opens: keep, drop if links confirm it, drop unless it is most of the page, drop unless it holds the article, drop.
KEEP, DOUBT, NAMED, COMMENTS, SURE = range(5)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): htmllib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _says_comments(tag: str, attrs: dict[str, str]) -> bool:
    """Whether a class or id names readers' comments, and no state or count of them."""
    for kind in ("class", "id"):
        if kind == "id" and tag == "section":  # a section of content may be called so
            continue
        for name in attrs.get(kind, "").lower().split():
            parts = [n for n in _PART.split(name) if n]
            if any(n in COMMENT_WORDS for n in parts) and not (len(parts) > 1 and any(n in STATES and n not in ("body", "page") for n in parts)):
                return True
    return False


def _marks(tag: str, attrs: dict[str, str], raw: str) -> int:
    """What the names of an element mark."""
    found = (MAIN if tag in ("main", "h1") else 0) | (HEADING if tag in ("h1", "h2", "h3") else 0) | (TIME if tag == "time" else 0)
    if raw:
        for name in f"{attrs.get('class', '')} {attrs.get('rel', '')} {attrs.get('itemprop', '')}".lower().split():
            for n in _PART.split(name):
                found |= (AUTHOR if n in AUTHOR_WORDS else 0) | (TIME if n in TIME_WORDS else 0) | (REPLY if n in REPLY_WORDS and tag in ("a", "button", "span", "div") else 0)
    return found


def _threads(elements: list[Element]) -> None:
    """Drops repeated siblings that bear the marks of comments."""
    alike: dict[tuple[int, int], list[Element]] = {}
    for e in reversed(elements):  # parents come before their children
        if e.parent is not None:
            e.parent.marks |= e.marks
            if e.tag in ("div", "li", "article", "section", "dd", "tr", "table") and e.drop < COMMENTS:
                if e.marks & REPLY and not e.marks & MAIN or e.marks & AUTHOR and e.marks & TIME and not e.marks & HEADING:
                    alike.setdefault((id(e.parent), e.path), []).append(e)
    for held in alike.values():
        if len(held) >= THREAD:
            for e in held:
                e.drop = COMMENTS


def _named(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """What the names say of an element."""
    if tag in UNNAMED:
        return KEEP
    found = KEEP
    for kind in ("class", "id"):
        for name in attrs.get(kind, "").lower().split():
            parts = [n for n in _PART.split(name) if n]
            hits = [n for n in parts if n in SKIP_WORDS or n == "header" and not inside or _BAR.fullmatch(n)]
            if not hits or len(parts) > 1 and any(n in STATES for n in parts):
                continue
            only = all(n in FILLERS or n in hits for n in parts) or parts[-1] in ("ad", "ads", "advert") or parts[0].startswith("cookie")
            # one doubtful word alone is a notice or menu as a class, but may be a section's name
            clear = any(n not in DOUBTFUL_WORDS for n in hits) or len(parts) > 1 or kind == "class" and name in ("alert", "notice", "menu", "aside", "skip")
            if only and clear and not (kind == "id" and tag == "section") or kind == "class" and any(n in SURE_WORDS for n in hits):
                return NAMED
            found = DOUBT
    return found


def _drop(tag: str, attrs: dict[str, str], inside: bool) -> int:
    if tag == "form":
        return NAMED
    if tag in SKIP or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in SKIP_ROLES:
        return SURE
    if tag == "header":
        return KEEP if inside else SURE
    if tag in ("main", "body", "html") or not attrs:
        return KEEP
    if tag == "article":
        return COMMENTS if _says_comments(tag, attrs) else KEEP
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return SURE
    if (tag not in UNNAMED or tag == "li") and _says_comments(tag, attrs):
        return COMMENTS
    return _named(tag, attrs, inside)


def _settle(elements: list[Element], pieces: list[tuple[Element, str | None]]) -> list[tuple[Element, str | None]]:
    """Sums up texts, drops elements with all that is in them; the pieces that are left."""
    _threads(elements)
    for e in reversed(elements):  # parents come before their children
        e.total += e.text + e.link
        e.links += e.link
        if e.parent is not None and e.drop != SURE:
            e.parent.total += e.total
            e.parent.links += e.links
    page = elements[0].total
    for e in elements:
        if e.parent is not None and e.parent.skip or e.drop == SURE:
            e.skip = True
        elif e.drop == COMMENTS:
            e.skip = not e.marks & MAIN and e.total < page
        elif e.drop == NAMED:
            e.skip = e.total <= MOST * page
        elif e.drop == DOUBT:
            e.skip = e.links > 0 and e.links >= LINKED * e.total and e.total <= MOST * page
    for e in elements:
        e.total = e.links = 0
    for e in reversed(elements):  # again, of what is left
        if not e.skip:
            e.total += e.text + e.link
            if e.parent is not None:
                e.parent.total += e.total
    return [(e, piece) for e, piece in pieces if piece is None or not e.skip]


def _step(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c) for c in attrs.get("class", "").lower().split()})
    return ".".join([tag, *classes])


def below(path: int, step: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}>{step}") - (1 << 63)


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str | None]]]:
    """Elements, and the visible text in page order: (element, piece), a piece of None is a block border."""
    root = Element("", 0, 0, None, KEEP, False)
    elements, pieces, stack, at = [root], [], [root], 0
    links = 0

    def text(raw: str) -> None:
        top = stack[-1]
        if raw and top.drop != SURE:
            piece = htmllib.unescape(raw) if "&" in raw else raw
            pieces.append((top, piece))
            if size := len(piece.strip()):
                if size < 20 and (links or top.tag == "span") and piece.strip().lower() in REPLY_TEXTS:
                    top.marks |= REPLY
                if links:
                    top.link += size
                else:
                    top.text += size

    def pop(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            gone = stack.pop()
            links -= gone.tag == "a"
            if gone.tag in BLOCKS:
                pieces.append((stack[-1], None))

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop(k)
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html", "article", "main", "section", "div"):
                    break
            continue
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
            for ends in CLOSES.get(tag, ()):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == ends:
                        pop(k)
                        break
                    if stack[k].tag in SCOPES and not (tag in ("td", "th") and stack[k].tag in ("td", "th")) and not (tag == "tr" and stack[k].tag in ("td", "th")):
                        break
        top = stack[-1]
        if tag == "br":
            pieces.append((top, " "))
            continue
        attrs = _attributes(m["attrs"][:-1]) if len(m["attrs"]) > 1 else {}
        drop = SURE if top.drop == SURE else _drop(tag, attrs, top.inside)
        if tag in BLOCKS:
            pieces.append((top, None))
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            top.marks |= _marks(tag, attrs, m["attrs"])
            continue
        if tag in ("html", "body"):
            path, depth = top.path, top.depth
        else:  # a hash of the parent's path and the own step
            path, depth = below(top.path, _step(tag, attrs)), top.depth + 1
        own = Element(tag, path, depth, top, drop, top.inside or tag in ("article", "main"))
        own.marks = _marks(tag, attrs, m["attrs"])
        elements.append(own)
        stack.append(own)
        links += tag == "a"
    if at < len(page):
        text(page[at:])
    return elements, _settle(elements, pieces)


def best_container(elements: list[Element]) -> Element:
    """The element with the most own text; a paragraph's text counts for its parent, half of it for the next."""
    for e in elements:
        if e.skip or not (e.text or e.link):
            continue
        weight = e.text - e.link
        at = e
        while at.parent is not None and (at.tag not in BLOCKS or at.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figcaption", "figure", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "table")):
            at = at.parent
        at.score += weight
        if at.parent is not None:
            at.parent.score += weight / 2
    for e in elements:
        if e.tag in ("article", "main"):
            e.score = e.score * 2 + 1
    return max(elements, key=lambda e: e.score)  # the first of equals


def _extract(pieces: list[tuple[Element, str | None]], inside: set[int]) -> str:
    blocks, own = [], []
    for e, piece in pieces:
        if piece is None:
            if own:
                blocks.append(" ".join("".join(own).split()))
                own = []
        elif id(e) in inside:
            own.append(piece)
    if own:
        blocks.append(" ".join("".join(own).split()))
    return "\n".join(b for b in blocks if b)


def _below(elements: list[Element], roots: list[Element]) -> set[int]:
    inside = {id(e) for e in roots}
    for e in elements:  # parents come before their children
        if e.parent is not None and id(e.parent) in inside:
            inside.add(id(e))
    return inside


def vote(page: str | None) -> int | None:
    """The generalised path of a page's best container; None without any text."""
    elements, pieces = parse(page or "")
    return best_container(elements).path if any(p and p.strip() for _, p in pieces) else None


def _under(e: Element, roots: set[int]) -> bool:
    while e is not None and id(e) not in roots:
        e = e.parent
    return e is not None


def chosen(elements: list[Element], paths: list[int], votes: list[int] | None = None) -> list[Element]:
    """The elements to extract, given the host's winning paths, most votes first, and their votes (equal ones by default)."""
    best = best_container(elements)
    at: dict[int, list[Element]] = {}
    wanted = {p: k for k, p in enumerate(paths)}
    for e in elements:
        if e.path in wanted and not e.skip and e.total and e.tag not in ("html", "body"):
            at.setdefault(e.path, []).append(e)
    if best.total == 0 or not at:
        return [best]
    agreeing, other = [], []
    for path, roots in at.items():
        roots = [e for e in roots if not (e.parent is not None and _under(e.parent, {id(r) for r in roots}))]
        own = {id(r) for r in roots}
        held = best.total if _under(best, own) else sum(r.total for r in roots if _under(r, {id(best)}))
        if held >= MOST * best.total:
            agreeing.append((-roots[0].depth, wanted[path], roots))
        else:
            other.append((wanted[path], -roots[0].depth, roots))
    if not agreeing:
        return min(other, key=lambda x: x[:2])[2]
    _, k, roots = min(agreeing, key=lambda x: x[:2])
    if votes:  # a path elsewhere may outweigh the page's own one
        own = {id(r) for r in roots}
        apart = [(votes[j] * sum(e.total for e in held), -j, held) for j, _, held in other if not any(_under(e, own) for e in held)]
        weight, _, held = max(apart, key=lambda x: x[:2], default=(0, 0, roots))
        if weight > votes[k] * sum(e.total for e in roots):
            return held
    return roots


def main_text(page: str | None, paths: list[int], votes: list[int] | None = None) -> str:
    elements, pieces = parse(page or "")
    return _extract(pieces, _below(elements, chosen(elements, paths, votes)))


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def host_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """host, paths, votes: the winning container paths, most votes first, then by hash; 1 / share at most."""

    @F.pandas_udf("long")
    def votes(html: pd.Series) -> pd.Series:
        return pd.Series([vote(h) for h in html], dtype="Int64")

    cast = pages.select(host(F.col("url")).alias("host"), votes("html").alias("path"))
    counted = cast.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).where("path is not null")
    led = counted.withColumn("all", F.sum("n").over(Window.partitionBy("host"))).where((F.col("n") > 1) & (F.col("n") >= share * F.col("all")))
    held = led.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("held"))
    return held.select("host", F.transform("held", lambda x: x["path"]).alias("paths"), F.transform("held", lambda x: -x["n"]).alias("votes"))


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """pages plus text and n_chars."""
    small_batches(pages.sparkSession)
    own_host, led_host, led_paths, led_votes = fresh(pages, "host", "led_host", "led_paths", "led_votes")
    led = written(host_paths(pages, share), "host-paths").toDF(led_host, led_paths, led_votes)

    @F.pandas_udf("string")
    def texts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, paths, votes in parts:
            yield pd.Series([main_text(h, [], []) if p is None else main_text(h, list(p), list(n)) for h, p, n in zip(html, paths, votes)], dtype=object)
        trim()

    joined = pages.withColumn(own_host, host(F.col("url"))).join(led, F.col(own_host) == F.col(led_host), "left")
    found = joined.withColumn("text", texts.asNondeterministic()("html", led_paths, led_votes)).drop(own_host, led_host, led_paths, led_votes)
    return found.withColumn("n_chars", F.length("text").cast("long"))

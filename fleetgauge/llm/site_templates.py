"""Main text of web pages: site templates are found by counting element subtrees per host, and deleted.

A page is parsed leniently into elements. Every element with text is hashed with all that is below it (tag, class, text,
children), and Spark counts on how many different pages of a host each hash occurs; pages with the same main text count
once, so that copies of a page don't make its text a template. Subtrees that recur on LEAST_PAGES pages and LEAST_SHARE
of the host's pages are deleted, wherever they are. Passages of articles recur too, so the share is high (on the test
pages a tenth loses article lines of one page in eighty, three tenths none). Inside a marked article a subtree must
recur on INNER_SHARE of the pages, and only whole parts of the article count (INNER elements below the article by nothing
but PATH elements), not list items, cells, headings or marked words.

What counting can't show, since it is another on every page or the host has few pages, is left out by its markup: scripts,
styles, navigation, headers and footers of the page, sidebars, forms, notices, adverts and comments, told by tag, role,
class or id. If the page marks its article (or main parts), the text is what is inside.

Scale: only hashes are shuffled, 32 bytes per element; counts are distinct counts in two steps, so a host with a third
of all pages is combined before it moves. Templates meet the elements by their hash and the pages by theirs; nothing is
gathered per host or in the driver, and the plan is the same at every size.

Cases: a null or empty html gives an empty text. A null url is a host of its own. Repeated rows and ties give a row each.
Text outside any element is kept. Unclosed and misnested elements end with their parents. From a tag whose quotes never
close on, tags end at the next >. Long pages are parsed whole, in time proportional to their length. An empty table
gives no row. Only id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import map_rows, stored, struct

#: Where a comment, a tag or a declaration begins; and the rest of a tag, up to a > outside quotes.
BEGIN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)")
NAME = re.compile(r"[a-z0-9]+")
#: The lowest bit of a subtree's key: whether it lies inside an article.
INSIDE = 1

#: Elements by what they mean in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("br option td th tr tbody thead tfoot caption legend summary figcaption dd dt li body html".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
FENCE = frozenset("article section div table ul ol dl body main aside td th blockquote nav footer header form".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
NEVER = frozenset("head script style noscript template svg math iframe object canvas audio video map nav footer aside form button select input textarea dialog menu search title".split())
INNER = frozenset("address blockquote center details div dl figure ol p pre section table ul".split())
PATH = frozenset("article center div main section".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Names in classes and ids of what isn't article text; those of the first kind only outside an article.
OUTER_NAMES = frozenset("header masthead banner topbar footer".split())
NAMES = frozenset("nav navbar navigation navi menu submenu breadcrumb breadcrumbs sidebar sidenav aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup signin login share sharing social comment comments commentlist disqus discussion replies respond related recommended recommendations pagination pager widget toolbar searchform skip copyright disclaimer".split())


@dataclass(frozen=True)
class TemplateRules:
    least_pages: int = 5
    least_share: float = 0.3
    inner_share: float = 0.5


@dataclass(slots=True)
class Element:
    tag: str
    attrs: str = ""
    children: list = field(default_factory=list)


def tokens(source: str):
    """(end of the text before, where it goes on, tag or None, closing, attributes) of each comment, tag and declaration."""
    at, last, quoted = 0, source.rfind(">"), True
    while (m := BEGIN.search(source, at)) is not None:
        if m[1]:
            end = source.find("-->", m.end())
            at = len(source) if end < 0 else end + 3
            yield m.start(), at, None, False, ""
            continue
        if m.end() > last + 1:  # nothing ends any more; a comment may still begin
            begin = source.find("<!--", m.end())
            if begin < 0:
                return
            yield begin, len(source), None, False, ""
            return
        rest = REST.match(source, m.end()) if m[3] and quoted else None
        if m[3] and rest is None:
            quoted = False
        end = rest.end() - 1 if rest else source.find(">", m.end())
        if end < 0:
            at = m.end()
            continue
        at = end + 1
        yield m.start(), at, m[3] and m[3].lower(), m[2] == "/", source[m.end() : end]


def parse(source: str) -> Element:
    """Element tree of a page; strings among the children are text, not yet decoded."""
    root = Element("#root")
    stack, at = [root], 0
    opened: dict[str, int] = {}

    def close(names: tuple[str, ...], fence: frozenset) -> None:
        if not any(opened.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                for e in stack[i:]:
                    opened[e.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in fence:
                return

    for before, after, tag, closing, attrs in tokens(source):
        if before < at:  # inside raw text
            continue
        if before > at:
            stack[-1].children.append(source[at:before])
        at = after
        if tag is None:
            continue
        if closing:
            close((tag,), frozenset() if tag in FENCE else FENCE)
            continue
        if tag not in IN_HEAD:
            close(("head",), frozenset())
        if tag in CLOSES_P:
            close(("p",), FENCE)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], FENCE - {"td", "th"} if tag == "tr" else FENCE)
        e = Element(tag, attrs)
        stack[-1].children.append(e)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(e)
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(source):
        stack[-1].children.append(source[at:])
    return root


def marks(e: Element) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(e.attrs)} if e.attrs.strip() else {}


def boilerplate(e: Element, inside: bool) -> bool:
    """Whether markup says that e isn't part of the article; inside: it is inside an article."""
    if e.tag in NEVER or (e.tag == "header" and not inside):
        return True
    if e.tag in ("html", "body", "main", "article") and (e.tag != "article" or not e.attrs):
        return False
    if not e.attrs.strip():
        return False
    a = marks(e)
    if a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    names = set(NAME.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))
    return bool(names & NAMES) or (not inside and bool(names & OUTER_NAMES))


def containers(e: Element) -> list[Element]:
    """Outermost articles that aren't boilerplate; else the main parts."""
    found, mains, todo = [], [], [e]
    while todo:
        x = todo.pop()
        if x.tag == "article" and not boilerplate(x, False):
            found.append(x)
            continue
        if x.tag == "main" or "main" in x.attrs and marks(x).get("role") == "main":
            mains.append(x)
        todo += [c for c in reversed(x.children) if isinstance(c, Element) and (c.tag not in NEVER)]
    found = [x for x in found if has_text(x)]
    return found or outermost([x for x in mains if has_text(x)])


def outermost(found: list[Element]) -> list[Element]:
    """Those that lie in no other one; found is in page order."""
    inside: set[int] = set()
    out = []
    for x in found:
        if id(x) in inside:
            continue
        out.append(x)
        todo = [x]
        while todo:
            for c in todo.pop().children:
                if isinstance(c, Element):
                    inside.add(id(c))
                    todo.append(c)
    return out


def has_text(e: Element) -> bool:
    todo = [e]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                if c.strip():
                    return True
            elif c.tag not in NEVER:
                todo.append(c)
    return False


def hashes(root: Element, host: str, main: list[Element]) -> dict[int, int]:
    """Hash, together with the host, by id(), of each element with text that is neither in main nor above; below only of
    its whole parts, marked INSIDE."""
    found: dict[int, int] = {}
    mixed = {id(x) for x in main}
    # part: None outside main; inside, whether only PATH elements are above
    order, todo = [], [(root, None, None)]
    while todo:
        e, parent, part = todo.pop()
        order.append((e, parent, part))
        below = True if id(e) in mixed else part and e.tag in PATH
        todo += [(c, e, below) for c in e.children if isinstance(c, Element) and c.tag not in RAW]
    for e, parent, _ in reversed(order):  # children before parents
        if id(e) in mixed:
            if parent is not None:
                mixed.add(id(parent))
            continue
        parts, some = [e.tag, e.attrs if "class" in e.attrs else ""], False
        for c in e.children:
            if isinstance(c, str):
                if c := " ".join(c.split()):
                    parts.append(c)
                    some = True
            elif id(c) in found:
                parts.append(f"\x00{found[id(c)]}")
                some = True
        if some:
            found[id(e)] = xxhash.xxh3_64_intdigest("\x01".join([host, *parts])) >> 1
    found.pop(id(root), None)
    keys = {}
    for e, _, part in order:
        if id(e) in found and (part is None or part and e.tag in INNER):
            keys[id(e)] = found[id(e)] & ~INSIDE if part is None else found[id(e)] | INSIDE
    return keys


def text_of(roots: list[Element], inside: bool, dropped: set[int]) -> str:
    """Blocks of text in page order. dropped: id() of elements to leave out."""
    blocks: list[str] = []
    run: list[str] = []

    def end():
        if run:
            if block := " ".join(html.unescape("".join(run)).split()):
                blocks.append(block)
            run.clear()

    todo: list = [None, *reversed(roots)]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag in BLOCK:
            end()
            if id(x) not in dropped and not (boilerplate(x, inside) and x not in roots):
                todo += [None, *reversed(x.children)]
        elif id(x) not in dropped and not boilerplate(x, inside):
            todo += reversed(x.children)
    end()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def host_key(host: str) -> int:
    return xxhash.xxh3_64_intdigest("\x02" + host) >> 1


def element_rows(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(own, host, key, page): the hashes of each page's elements, and one row with the hash of the host as key for the page
    itself. own tells the page's url and html, page its main text."""

    def hashed(own, url, source):
        root, host = parse(source or ""), host_of(url)
        main = containers(root)
        page, at = xxhash.xxh3_64_intdigest(text_of(main or [root], bool(main), set())) >> 1, host_key(host)
        for key in {at, *hashes(root, host, main).values()}:
            yield own, at, key, page

    told = pages.select(own_hash(url_col, html_col).alias("own"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_rows(told, ["own", "url", "html"], hashed, struct(("own", "long"), ("host", "long"), ("key", "long"), ("page", "long")))


def own_hash(url_col: str, html_col: str):
    return F.xxhash64(F.col(url_col).isNull(), F.col(url_col), F.col(html_col).isNull(), F.col(html_col))


def templates(rows: DataFrame, rules: TemplateRules) -> DataFrame:
    """(key): hashes of subtrees that recur on enough pages of their host. rows: element_rows()."""
    counts = rows.groupBy("host", "key").agg(F.count_distinct("page").alias("n")).filter((F.col("n") >= rules.least_pages) | (F.col("host") == F.col("key")))
    counts = stored(counts, "subtree-counts")
    sizes = counts.filter(F.col("host") == F.col("key")).select("host", F.col("n").alias("pages"))
    often = counts.filter((F.col("host") != F.col("key")) & (F.col("n") >= rules.least_pages))
    share = F.when(F.col("key").bitwiseAND(F.lit(INSIDE)) == INSIDE, rules.inner_share).otherwise(rules.least_share)
    return stored(often.join(sizes, "host").filter(F.col("n") >= F.col("pages") * share).select("key"), "templates")


def page_text(url: str | None, source: str | None, known: set[int]) -> str:
    """The page's main text; known: the hashes of templates."""
    root = parse(source or "")
    main = containers(root)
    dropped = {e for e, key in hashes(root, host_of(url), main).items() if key in known} if known else set()
    return text_of(main or [root], bool(main), dropped)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: TemplateRules | None = None) -> DataFrame:
    """(id, url, text, n_chars): one row per row of pages."""
    rows = stored(element_rows(pages, url_col, html_col), "elements")
    known = templates(rows, rules or TemplateRules())
    on = rows.select("own", "key").distinct().join(known, "key").groupBy("own").agg(F.collect_set("key").alias("known"))  # at most a page's elements
    told = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), own_hash(url_col, html_col).alias("own"))
    joined = told.join(on.hint("merge"), "own", "left")
    schema = struct((f"`{id_col}`", pages.schema[id_col].dataType.simpleString()), (f"`{url_col}`", "string"), ("text", "string"), ("n_chars", "long"))

    def row(page, url, source, known):
        text = page_text(url, source, set(known or ()))
        yield page, url, text, len(text)

    return map_rows(joined, ["id", "url", "html", "known"], row, schema)

"""Main text of web pages: subtrees that recur on a host are template and go; so do menus, adverts and other furniture."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, by_value, mapped, stash

by_value(__name__)

#: A subtree is template if it stands on so many different articles of a host; a heading on more than one in so many of the
#: host's pages names no article.
PAGES = 5
#: A subtree inside the article must also stand on such a share of the host's articles: five of a million may share a table.
SHARE = 0.01
#: Up to so many templates are broadcast (8 bytes each); beyond, pages are joined with theirs.
BROADCAST = 500_000

#: HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - set("body head html title option td th tr tbody thead tfoot caption".split())
SCOPE = set("article aside body button caption div footer form header html main marquee nav object section table td template th".split())
#: Elements that are never main text; names of furniture in class, id and role.
DROPPED = set(
    "aside audio button canvas datalist dialog footer form head iframe input map math menu nav noscript object script search select "
    "style svg template textarea title video".split()
)
FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline consent contentinfo cookie cookies "
    "copyright gdpr login masthead menubar modal navbar newsletter pagination popup promo promoted reply replies respond sharing "
    "sidebar signup skip sponsor sponsored subscribe toolbar topbar tracking".split()
)
#: ... and names that an article's own parts may have in them too (related-work, search-algorithms).
DOUBTFUL = set(
    "alert announcement complementary dialog disclaimer footer form header menu nav navigation navigational notice notices "
    "notification pager promotion recommended related search share social widget".split()
)
#: What else stands in a name that says that an element is furniture (related-posts, share-box).
BOXES = set(
    "area articles bar block box buttons container content first inner item items left links list main outer panel posts primary "
    "right row secondary section site slot small stories tools top bottom wrap wrapper your page global print".split()
)
TOPS = {"article", "main"}
CONTAINERS = set("aside div dl fieldset figure footer form header hgroup menu nav ol section table ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What an open element of the first kind ends, up to the second.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}


class Node:
    __slots__ = ("tag", "names", "up", "kids", "mark", "depth", "inside")

    def __init__(self, tag: str, names: tuple[frozenset, ...], up: Node | None):
        self.tag, self.names, self.up, self.kids, self.mark = tag, names, up, [], None
        self.depth = up.depth + 1 if up else 0
        #: Of article and main, those that the element is in.
        self.inside: frozenset = up.inside | {up.tag} & TOPS if up and up.tag in TOPS else up.inside if up else frozenset()


_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)("?)|'([^']*)('?)|([^\s>]*)))?)""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("iframe", "noembed", "noframes", "script", "style", "textarea", "title", "xmp")}


class Tree:
    """A page's elements in the order in which they begin; end tags that HTML lets one leave out are supplied.

    The page is read once from left to right, however bad its markup: a comment, tag or quotation that isn't closed
    reaches to its end, as in a browser.
    """

    def __init__(self, html: str):
        self.nodes = [Node("html", (), None)]
        self.at = self.nodes[0]
        self.open: dict[str, list[Node]] = {}  # by tag, outer ones first
        self.scopes: list[Node] = []
        self._read(html)

    def _read(self, html: str) -> None:
        begin = at = 0
        while True:
            start = html.find("<", at)
            tag = _TAG.match(html, start) if start >= 0 else None
            if start >= 0 and tag is None:
                at = start + 1
                continue
            text = html[begin : start if start >= 0 else len(html)]
            if text:
                self._data(unescape(text) if "&" in text else text)
            if tag is None:
                return
            if not tag[2]:
                end, more = (html.find("-->", start + 2), 3) if tag[3] else (html.find(">", tag.end()), 1)
                if end < 0:
                    return
                begin = at = end + more
                continue
            name, said, at = tag[2].lower(), {}, tag.end()
            while True:
                a = _ATTRIBUTE.match(html, at)
                if a is None or a[3] is not None and not a[4] or a[5] is not None and not a[6]:
                    return
                at = a.end()
                if a[1]:
                    break
                if (key := a[2].lower()) in ("class", "id", "role"):
                    said.setdefault(key, a[3] or a[5] or a[7] or "")
            begin = inner = at
            if tag[1]:
                self._end(name)
                continue
            self._start(name, unescape(" ".join(said.values())).lower())
            if name in _RAW_END:
                end = _RAW_END[name].search(html, at)
                begin = at = end.start() if end else len(html)
                self._data(unescape(html[inner:at]) if name in ("title", "textarea") else html[inner:at])

    def _close(self, tags: tuple[str, ...], scope) -> None:
        """Ends the innermost open element with one of the tags, and what is open in it, unless one of scope stands between."""
        node = max((self.open[t][-1] for t in tags if self.open.get(t)), key=lambda n: n.depth, default=None)
        if node is None:
            return
        bars = self.scopes[-1:] if scope is SCOPE else [self.open[t][-1] for t in scope if self.open.get(t)]
        if any(b.depth > node.depth for b in bars):
            return
        while self.at is not node.up:
            self.open[self.at.tag].pop()
            if self.at.tag in SCOPE:
                self.scopes.pop()
            self.at = self.at.up

    def _start(self, tag: str, said: str) -> None:
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        if tag in ENDS_P:
            self._close(("p",), SCOPE)
        node = Node(tag, tuple(frozenset(re.findall(r"[a-z0-9]+", name)) for name in said.split()), self.at)
        self.at.kids.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open.setdefault(tag, []).append(node)
            if tag in SCOPE:
                self.scopes.append(node)

    def _end(self, tag: str) -> None:
        if tag not in VOID and tag not in ("html", "body"):
            self._close((tag,), () if tag in SCOPE else SCOPE)

    def _data(self, data: str) -> None:
        self.at.kids.append(data)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _comments(node: Node) -> bool:
    return any(part.startswith("comment") for name in node.names for part in name)


def _named(node: Node) -> bool:
    """Whether a class, id or role says that the element is furniture; inside an article a doubtful word must stand alone or
    beside words for boxes."""
    sure = lambda name: bool(name & FURNITURE or name & DOUBTFUL and (not node.inside or name <= DOUBTFUL | BOXES))
    return _comments(node) or any(map(sure, node.names))


def _furniture(node: Node, holds: set[Node]) -> bool:
    """Elements that no article is in and that say what they are."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header":  # an article's own holds its headings
        return not node.inside
    if node.up is not None and node.up.tag == "header" and node.tag not in HEADINGS and node.inside:
        return not any(isinstance(k, Node) and k.tag in HEADINGS for k in node.kids)
    return node.tag not in ("html", "body", "main") and node not in holds and _named(node)


def subtree_hashes(tree: Tree) -> dict[Node, int]:
    """64-bit hash of each container's tags and text; the article and what holds it aren't candidates."""
    own: dict[Node, bytes] = {}
    holds = _holders(tree)
    out = {}
    for node in reversed(tree.nodes):
        h = hashlib.blake2b(node.tag.encode(), digest_size=8)
        for kid in node.kids:
            if isinstance(kid, Node):
                h.update(own[kid])
            elif text := squeeze(kid):
                h.update(b"\0" + text.encode("utf-8", "surrogatepass"))
        own[node] = h.digest()
        if node.tag in CONTAINERS and node not in holds:
            out[node] = int.from_bytes(own[node], "little", signed=True)
    return out


def _holders(tree: Tree) -> set[Node]:
    """Elements with an article, main part or top heading inside."""
    out: set[Node] = set()
    for node in tree.nodes:
        if node.tag in ("article", "main", "h1") and not _comments(node):
            up = node.up
            while up is not None and up not in out:
                out.add(up)
                up = up.up
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def heading(tree: Tree) -> int | None:
    """Hash of what a marked page says it is about: its first heading outside furniture, else its title; None if it has neither."""
    for tags in (("h1", "h2"), ("title",)):
        for node in tree.nodes:
            if node.tag in tags and (node.tag == "title" or not node.mark):
                said = squeeze(_text(node).replace("\0", " "))
                if said:
                    return _hash(said)
    return None


def _text(top: Node) -> str:
    """Text of a subtree without what is marked; blocks are set apart by a line feed each, and only there."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        if node.mark and node is not top:
            out.append("\0" if node.tag in BLOCK else "")
            continue
        if node.tag == "br":
            out.append(" ")
            continue
        edge = ["\0"] if node.tag in BLOCK else []
        stack.extend(edge + node.kids[::-1] + edge)
    return "".join(out)


def main_text(html: str | None, is_template) -> str:
    """Text of the page's article(s), or of its body if no element is one, without furniture and templates."""
    return article(Tree(html.replace("\0", " ")), is_template) if html else ""


def article(tree: Tree, is_template) -> str:
    """Main text of a page, whose furniture and templates are marked."""
    holds = _holders(tree)
    for node in tree.nodes:
        node.mark = _furniture(node, holds)
    for node, h in subtree_hashes(tree).items():
        node.mark = node.mark or is_template(h)
    for node in tree.nodes:  # parents stand before their children
        node.mark = node.mark or (node.up is not None and node.up.mark)
    for tag in ("article", "main"):
        tops = [n for n in tree.nodes if n.tag == tag and not n.mark and tag not in n.inside]
        if tops:
            break
    else:
        tops = [tree.nodes[0]]
    blocks = (squeeze(b) for top in tops for b in _text(top).split("\0"))
    return " ".join(b for b in blocks if b)


def host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _salted(h: int, host_: str) -> int:
    """A subtree's hash with its host in it, so that one number names both."""
    return int.from_bytes(hashlib.blake2b(f"{h} {host_}".encode(), digest_size=8).digest(), "little", signed=True)


def template_counts(pages: DataFrame, least: int, share: float = SHARE) -> DataFrame:
    """Subtrees (salted by host) that stand on at least `least` different articles of the host, and inside articles on a
    `share` of them: subtree, articles.

    Pages with one heading are one article, so that one that was published many times is no template. A heading that
    more than one in `least` pages of the host have (a site's name, say) names none; such pages, and those without a
    heading or title, differ if their main texts do. All pages of a host can't share fewer than `least` other headings.
    """

    def start():
        def read(part: pa.RecordBatch):
            places, rows = [], []
            for i, (html, host_) in enumerate(zip(part.column("html").to_pylist(), part.column("host").to_pylist(), strict=True)):
                if html:
                    tree = Tree(html.replace("\0", " "))
                    outer, inner = set(), set()
                    for node, h in subtree_hashes(tree).items():
                        (inner if node.inside else outer).add(_salted(h, host_))
                    said = _hash(article(tree, lambda h: False))
                    head = heading(tree)
                    places.append(i)
                    rows.append((_salted(0, host_), said if head is None else _salted(head, host_), said, list(outer), list(inner)))
            return places, list(zip(*rows, strict=True)) or [[]] * 5

        return read

    fields = {"site": "long", "head": "long", "said": "long", "outer": "array<long>", "inner": "array<long>"}
    found = stash(mapped(pages.select("html", host().alias("host")), [], fields, start), "page-subtrees")
    n = F.count(F.lit(1))
    sites = found.groupBy("site").agg(n.alias("pages")).where(F.col("pages") >= least)
    often = found.groupBy("site", "head").agg(n.alias("n")).join(sites, "site").where(F.col("n") * least > F.col("pages"))
    often = stash(often.select(F.col("head").alias("often")).distinct(), "site-headings")
    about = F.when(F.col("often").isNull(), F.col("head")).otherwise(F.col("said"))
    named = found.join(often, F.col("head") == F.col("often"), "left").withColumn("about", about)
    each = lambda c, inside: named.select("site", F.explode(c).alias("subtree"), "about", F.lit(inside).alias("inside"))
    counts = each("outer", False).unionByName(each("inner", True)).groupBy("site", "subtree", "about").agg(F.bool_and("inside").alias("inside"))
    counts = counts.groupBy("site", "subtree").agg(n.alias("articles"), F.bool_and("inside").alias("inside")).where(F.col("articles") >= least)
    of_site = named.select("site", "about").distinct().groupBy("site").agg(n.alias("of")).where(F.col("of") * share > least)
    asked = counts.join(of_site, "site", "left").where(~F.col("inside") | (F.col("articles") >= F.coalesce(F.col("of") * share, F.lit(0.0))))
    return asked.select("subtree", "articles")


def extract(pages: DataFrame, least: int = PAGES, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html.

    A null or empty page has an empty text. Repeated rows give repeated results; null ids and urls stay null. Urls
    without a host share one. An empty table gives an empty result. A subtree's pages are counted over all pages of its
    host, in Spark; up to `broadcast` templates go to every task, more are joined to the pages that they stand on.
    """
    templates = stash(template_counts(pages, least), "templates")
    page = pages.select("page_id", "url", "html", host().alias("host"))
    many = templates.count() > broadcast
    if many:
        page, sent = _with_templates(page, templates), None
    else:
        sent = Sent(pages.sparkSession, frozenset(r[0] for r in templates.select("subtree").collect()))

    def start():
        everywhere = sent() if sent else None

        def texts(part: pa.RecordBatch):
            out = []
            own = part.column("subtrees").to_pylist() if many else [everywhere] * part.num_rows
            for html, host_, known in zip(part.column("html").to_pylist(), part.column("host").to_pylist(), own, strict=True):
                known = set(known) if many else known
                out.append(main_text(html, lambda x, h=host_, k=known: _salted(x, h) in k))
            return None, [out, list(map(len, out))]

        return texts

    return mapped(page, ["page_id", "url"], {"text": "string", "n_chars": "long"}, start)


def _subtrees_of(part: pa.RecordBatch):
    places, found = [], []
    for i, (html, host_) in enumerate(zip(part.column("html").to_pylist(), part.column("host").to_pylist(), strict=True)):
        for h in set(subtree_hashes(Tree((html or "").replace("\0", " "))).values()):
            places.append(i)
            found.append(_salted(h, host_))
    return places, [found]


def _with_templates(page: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds to each page the templates that stand on it; pages are told apart by id and url."""
    start: Callable = lambda: _subtrees_of
    found = mapped(page, ["page_id", "url"], {"subtree": "long"}, start).select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), "subtree")
    sets = found.join(templates.select("subtree"), "subtree").groupBy("_id", "_url").agg(F.collect_set("subtree").alias("subtrees"))
    joined = page.join(sets, F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")), "left")
    return joined.select("page_id", "url", "html", "host", F.coalesce("subtrees", F.array().cast("array<long>")).alias("subtrees"))

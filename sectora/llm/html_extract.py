"""Main text of web pages by consensus host paths.

Every page scores its containers and votes for the generalised tag-class path of
the best one; votes are counted per host in Spark; every page is then read again
with its host's winning paths.  A path only locates the article: what is returned
are the page's outermost main and article elements, and without them around the
place all text that is not boilerplate.  A winning path counts only where it
loses nothing of what the page's own best container leads to.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PATHS = 4  # winning paths per host
HOLDS = 0.8  # share of a container's text that one child must hold to take its place

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe|xmp|noembed|noframes)\b[^>]*+>(?:(?!</\1\b).)*+(?:</\1\b[^>]*+>|\Z)"  # raw text ends only at its end tag
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?:[!?][^>]*+|/?[a-zA-Z][^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w"'=-])(hidden)(?![\w=-])""", re.S)
#: Element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_FORMULA = frozenset("math menclose mlabeledtr mtable mtd mtr merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
_CONTAINER = frozenset("html body main article section div td center content table tbody tr".split())
_BOILER_TAG = frozenset("nav footer aside form button dialog menu fieldset".split())
_UNSEEN = frozenset("noscript template svg object canvas select datalist annotation annotation-xml".split())  # what they hold is not shown
_FOREIGN = frozenset(["svg", "math"])
_IN_LINE = _INLINE | _FORMULA | _UNSEEN
_INTEGRATION = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())  # HTML may stand in these
_ARTICLE = frozenset(["article", "main"])
LONG_PATH = 1000  # longer paths are named by their digest
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CLOSES = {  # an opening tag ends these open elements first
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_SCOPE = frozenset("ul ol dl table div section article main body td".split())
#: Opening tags of HTML that end an open svg or math element.
_BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_OPTION = frozenset("option optgroup hr legend".split())  # what a select may hold; another block ends it
_BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adslot|adsbygoogle|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|notifications?|alert|newsletter|subscri(?:be|ption)"
    r"|side-?bar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|masthead|site-?header|page-?header|top-?bar|(?<!article[_-])(?<!post[_-])(?<!entry[_-])(?<!story[_-])(?<!content[_-])(?<!section[_-])header|toolbar|comments?|comment-?list|disqus|repl(?:y|ies)|respond"
    r"|shar(?:e|ing)|social|related|recommend(?:ed|ations?)|popup|pop-up|modal|overlay|paginat(?:ion|or)|pager|widgets?|log-?in|sign-?up|search|copyright|skip-?link|tag-?(?:list|cloud)|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_DIGIT = re.compile(r"\d+")


@dataclass
class Node:
    """An open or closed container with what its text amounts to."""

    path: str
    order: int
    parent: Node | None
    article: bool = False  # a main or article element, or inside one
    sum: int = 0  # characters of visible text outside links, in the end with all containers below
    link_sum: int = 0  # characters of link text
    children: list[Node] = field(default_factory=list)


class Page:
    """One pass over the markup: blocks of text, each with the container that holds it."""

    def __init__(self, source: str):
        self.blocks: list[tuple[Node, str]] = []
        self.root = Node("", 0, None)
        self.nodes = [self.root]
        self._read(source)
        for n in reversed(self.nodes):  # children come after their parents
            if n.parent is not None:
                n.parent.sum += n.sum
                n.parent.link_sum += n.link_sum

    def _read(self, source: str) -> None:
        # open elements: tag, container, inside boilerplate, inside a link, inside a page or article header
        stack: list[tuple[str, Node, bool, bool, bool]] = [("", self.root, False, False, False)]
        pieces: list[str] = []
        weight = [0, 0]
        opened: dict[str, int] = {}  # open elements by tag
        special = [0, 0]  # open elements of other content models, and those of them that are not shown
        at = 0

        def flush() -> None:
            if pieces:
                text = " ".join(entities.unescape("".join(pieces)).split())
                node = stack[-1][1]
                if text:
                    self.blocks.append((node, text))
                    node.sum += weight[0]
                    node.link_sum += weight[1]
                pieces.clear()
                weight[0] = weight[1] = 0

        def text(s: str) -> None:
            _, _, boiler, link, head = stack[-1]
            if s and not boiler and not head:
                pieces.append(s)
                weight[link] += len(s)

        def push(entry: tuple[str, Node, bool, bool, bool]) -> None:
            stack.append(entry)
            tag = entry[0]
            opened[tag] = opened.get(tag, 0) + 1
            special[0] += tag in _UNSEEN or tag in _FOREIGN
            special[1] += tag in _UNSEEN

        def close(k: int) -> None:
            if any(e[0] not in _IN_LINE for e in stack[k:]):
                flush()
            for e in stack[k:]:
                opened[e[0]] -= 1
                special[0] -= e[0] in _UNSEEN or e[0] in _FOREIGN
                special[1] -= e[0] in _UNSEEN
            del stack[k:]

        def leave(tag: str) -> None:
            """End an open svg, math or select that cannot hold ``tag``."""
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i][0]
                if t in _INTEGRATION:
                    return
                if t in _FOREIGN or t == "select":
                    if tag in _BREAKOUT if t in _FOREIGN else tag in ("select", "input") or not (tag in _OPTION or tag in _IN_LINE):
                        close(i)
                    return

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            name = m[3]
            if not name:
                continue
            tag = name.lower()
            if m[2]:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0) if opened.get(tag) else 0
                if k:
                    close(k)
                elif tag == "p":
                    flush()
                continue
            if special[0]:
                leave(tag)
                if special[1] or (m[4] or "").endswith("/"):  # nothing below is shown, or a formula's empty element
                    if tag not in _VOID and not (m[4] or "").endswith("/"):
                        push((tag, *stack[-1][1:]))
                    continue
            if tag in _FOREIGN and (m[4] or "").endswith("/"):
                continue
            if tag == "br":
                if pieces:
                    pieces.append(" ")
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                continue
            inline = tag in _IN_LINE
            if not inline:
                ends = _CLOSES.get(tag)
                for i in range(len(stack) - 1, 0, -1):
                    open_tag = stack[i][0]
                    if open_tag == "p" or (ends and open_tag in ends):
                        close(i)
                        if open_tag != "p" and tag not in ("tr",):
                            break
                    elif open_tag in _SCOPE and not (tag == "tr" and open_tag == "td"):
                        break
                flush()
            _, node, boiler, link, head = stack[-1]
            attrs = m[4]
            names = ""
            boiler = boiler or tag in _UNSEEN
            if attrs and not boiler and (not inline or "hidden" in attrs or "display" in attrs):
                found = {}
                for a in _ATTR.finditer(attrs):
                    found.setdefault((a[1] or a[5]).lower(), a[2] or a[3] or a[4] or "")
                names = " ".join(found.get("class", "").split())
                marks = f"{names} {found.get('id', '')}"
                boiler = (
                    tag in _BOILER_TAG or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in _BOILER_ROLE
                    or bool(_HIDDEN.search(found.get("style", ""))) or (tag == "article" and bool(re.search(r"\b(?:comment|reply)", marks, re.I)))
                )
                if tag not in ("html", "body", "main", "article") and (hits := _BOILER_NAME.findall(marks)):
                    if node.article and all(h.strip(" _-\t\n").lower().endswith("header") for h in hits):
                        head = True  # an article's own header: its headings stay
                    else:
                        boiler = True
            elif not boiler:
                boiler = tag in _BOILER_TAG
            if tag == "header" and not boiler:
                head, boiler = True, not node.article
            elif tag == "address" and not node.article:
                boiler = True
            elif tag in _HEADING:
                head = False
            if tag in _CONTAINER and not boiler:
                label = tag + "".join("." + _DIGIT.sub("#", c) for c in sorted(names.split()))
                path = f"{node.path}>{label}" if node.path else label
                if len(path) > LONG_PATH:
                    path = "~" + hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=16).hexdigest()
                child = Node(path, len(self.nodes), node, node.article or tag in _ARTICLE)
                node.children.append(child)
                self.nodes.append(child)
                node = child
            push((tag, node, boiler, link or tag == "a", head))
        if at < len(source):
            text(source[at:])
        while len(stack) > 1:
            close(len(stack) - 1)
        flush()

    def best(self) -> Node:
        """The deepest container that holds most of its parent's text; link text counts against it."""
        node = self.root
        while node.children:
            top = max(node.children, key=lambda c: (c.sum - c.link_sum, -c.order))
            if top.sum < HOLDS * max(1, node.sum):
                break
            node = top
        return node

    def region(self, located: list[Node]) -> list[Node]:
        """What a located article belongs to: the outermost main and article elements if it is inside one, else the page."""
        outer = [n for n in self.nodes if n.article and not (n.parent and n.parent.article)]
        return outer if located and all(n.article for n in located) else [self.root]

    def _kept(self, chosen: list[Node]) -> list[bool]:
        """Of every block whether it is below the chosen containers and not, outside articles, in a container that is mostly links."""
        inside = {id(n) for n in chosen}
        for n in self.nodes:  # parents come first
            if id(n.parent) in inside:
                inside.add(id(n))
        return [id(n) in inside and (n.article or not n.link_sum > 3 * n.sum) for n, _ in self.blocks]

    def text_of(self, chosen: list[Node]) -> str:
        """The kept blocks below the chosen containers in page order."""
        return " ".join(t for (_, t), k in zip(self.blocks, self._kept(chosen), strict=True) if k)

    def vote(self) -> tuple[str, int]:
        node = self.best()
        return node.path, node.sum

    def extract(self, paths: list[str]) -> str:
        own = self.region([self.best()])
        for path in paths:
            hit = [n for n in self.nodes if n.path == path]
            if hit:
                region = self.region(hit)
                if all(k or not o for k, o in zip(self._kept(region), self._kept(own), strict=True)):
                    return self.text_of(region)
        return self.text_of(own)


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): how many pages of a host chose a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [Page(h.as_py() or "").vote() for h in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in paths], pa.string()), pa.array([s for _, s in paths], pa.int64())], names=["host", "path", "size"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, size long").where("size > 0").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("size").alias("size"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, host, paths), one row per input row of ``pages`` (page_id, url, html).

    ``text`` is the main text ('' where there is none, also for null and empty
    html), ``n_chars`` its code points, ``paths`` the host's winning paths.  Pages
    without a usable url share the host ''.  Character references are decoded,
    white space inside a block becomes one space, blocks are joined by one space
    in page order.  Other columns are ignored.
    """
    base = pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))).alias("host"))
    ranked = host_votes(base).withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("size"), "path"))).where(F.col("r") <= PATHS)
    won = written(ranked.groupBy(F.col("host").alias("h")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths")), "host-paths")
    joined = base.join(won, base.host == won.h, "left").select("page_id", "url", "host", "paths", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(h.as_py() or "").extract(p or []) for h, p in zip(b.column(4), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "host", "paths", "text", "n_chars"])

    out = joined.mapInArrow(run, "page_id long, url string, host string, paths array<string>, text string, n_chars long")
    return out.select("page_id", "url", "text", "n_chars", "host", "paths")

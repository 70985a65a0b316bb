"""Main text of web pages by consensus host paths.

1. Every page is parsed once and its containers (article, main, section, div, td, body ...) are
   scored by the text they hold directly or through paragraphs, less links.
2. A container's path is the chain of tags with their classes, digits generalised. Pages vote in
   Spark: a path's share of its page's score is summed by host and path, pre-aggregated before the
   shuffle, and each host keeps its best few paths.
3. Every page is read again and the text of its host's first path that it has is taken, with that of
   voted siblings of this path (an article in several containers); boilerplate inside (menus, headers,
   footers, forms, adverts, notices, reader comments ...) is left out, however much text it holds. Only
   where nothing at all would be left, headers, forms, notices and hidden elements count as text; menus,
   footers, asides, adverts and comments never do. A page that has none of the paths uses its own best
   container and its siblings.

The winners are one row per host. They are broadcast only if they are at most ``MAX_BROADCAST_HOSTS``
rows; otherwise pages join them by host, each host's rows spread over ``SALTS`` keys.

Defined results: a null or empty html, or one without text, gives an empty text; a null url is a
host of its own (empty); unclosed and wrongly nested tags are closed as a browser would nearly do; paths
with equal votes rank by name; pages of any length and depth are read whole; repeated rows are extracted
each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torquelake.llm.common import materialize, tune

KEPT_PATHS, MAX_BROADCAST_HOSTS, SALTS = 5, 50_000, 64

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg canvas object select xmp".split())
DROPPED = set("nav header footer aside form button menu dialog head".split())
#: Void elements that end a block; the others stand within a line.
BREAKS = {"br", "hr", "col"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas run within a line.
INLINE |= set("math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mover munder munderover mfrac msqrt mroot mstyle mpadded mphantom menclose mmultiscripts".split())
CONTAINERS = set("article main section div td body".split())
#: A start tag closes these if they are open and nothing stronger lies between.
AUTO_CLOSE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements open at once; what lies deeper counts as text of the last of them.
DEPTH = 500
#: Words of class, id and role that mark an element as not the article.
BOILERPLATE = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related recommended respond reply "
    "replies search share sharing shares sidebar sidebars signup skip social sponsor sponsored subscribe subscription toc toolbar topbar widget widgets".split()
)

#: Of these elements and names, those that are text where a page has no other.
SOFT_TAGS, SOFT_ROLES = {"header", "form"}, {"banner", "form", "dialog", "alert"}
SOFT = set("banner header masthead modal notice notices popup promo promotion skip toc topbar widget widgets".split())
#: A sibling of the chosen path needs this share of its score.
SIBLING = 0.1

#: Words that may stand beside them in one class, id or role ("site-footer"); any other word, such as no, has, with or free, makes it something else.
BESIDE = set(
    "area bar body bottom box button buttons container content fixed form global group header head holder icon icons inner item items left link links list main outer page panel post posts "
    "primary right row secondary section site slot sticky text title top unit wrap wrapper".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "path", "parent", "dropped", "chars", "links", "blocks", "anchor")

    def __init__(self, tag: str, path: str, parent: Node | None, dropped: bool, anchor: bool):
        self.tag, self.path, self.parent, self.dropped, self.anchor = tag, path, parent, dropped, anchor
        self.chars = self.links = 0
        self.blocks: list[int] = []


def _boilerplate(value: str) -> int:
    """2 if one of the names is made of boilerplate words, and words that may stand beside them, only; 1 if those are soft ones; else 0."""
    found = 0
    for name in value.split():
        parts = {w for w in _SPLIT.split(name) if len(w) > 1}
        if not BOILERPLATE.isdisjoint(parts) and parts <= BOILERPLATE | BESIDE:
            found = max(found, 1 if parts & BOILERPLATE <= SOFT else 2)
    return found


def _marks(tag: str, attrs: str) -> tuple[str, int]:
    """The tag with its generalised classes, and 2 for boilerplate, 1 for what may be text where nothing else is, 0 for the rest."""
    drop = (1 if tag in SOFT_TAGS else 2) if tag in DROPPED else 0
    if not attrs or not attrs.strip():
        return tag, drop
    name = tag
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            drop = max(drop, 1)
        elif key in ("class", "id", "role"):
            if key == "class" and value.strip():
                name = tag + "".join("." + c for c in sorted(set(_DIGITS.sub("#", value).split())))
            if tag not in ("html", "body", "article", "main"):
                drop = max(drop, _boilerplate(value))
            if key == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
                drop = max(drop, 1 if value in SOFT_ROLES else 2)
    return name, drop


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The containers of a page and its text blocks in order, each with the element that holds it.

    Boilerplate is left out. If no text is left, a second pass leaves out only what can't be the article.
    """
    containers, blocks = _parse(page, 1)
    return (containers, blocks) if blocks else _parse(page, 2)


def _parse(page: str, least: int) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Containers and blocks without the elements marked ``least`` or more."""
    root = Node("html", "html", None, False, False)
    stack, containers, blocks = [root], [], []
    pending: list[str] = []
    owner = root
    linked = 0
    #: Open elements below DEPTH and whether each is boilerplate, how many there are of each tag, and of boilerplate ones.
    over: list[tuple[str, bool]] = []
    n_over: dict[str, int] = {}
    n_dropped = 0

    def leave(tag: str) -> None:
        """Close the deep elements up to the last one of ``tag``."""
        nonlocal n_dropped
        while over:
            last, dropped = over.pop()
            n_over[last] -= 1
            n_dropped -= dropped
            if last == tag:
                return

    def flush() -> None:
        nonlocal linked
        if pending:
            raw = "".join(pending)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            pending.clear()
            if text and not owner.dropped:
                blocks.append((owner, text))
                owner.chars += len(text)
                owner.links += min(linked, len(text))
        linked = 0

    def block(node: Node) -> Node:
        while node.tag in INLINE and node.parent:
            node = node.parent
        return node

    def text(s: str) -> None:
        nonlocal linked, owner
        if s and not n_dropped:
            top = stack[-1]
            if top.dropped and top.tag in INLINE and not block(top).dropped:
                return  # an inline notice or advert
            if not pending:
                owner = block(top)
            pending.append(s)
            if top.anchor:
                linked += len(s)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if n_over.get(tag):
                if tag not in INLINE:
                    flush()
                leave(tag)
                continue
            if tag == "p" and not any(x.tag == "p" for x in stack):
                flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(x.tag not in INLINE for x in stack[k:]):
                        flush()
                    del stack[k:]
                    over.clear()
                    n_over.clear()
                    n_dropped = 0
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if tag in VOID:
            if tag in BREAKS:
                flush()
            continue
        if tag not in INLINE:
            flush()
        closes = AUTO_CLOSE.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if over:
            if over[-1][0] in closes:
                leave(over[-1][0])
        elif closes:
            stop = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "blockquote"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in stop:
                    break
        if tag in ("html",):
            continue
        if tag == "body" and any(x.tag == "head" for x in stack):
            del stack[1:]
            over.clear()
            n_over.clear()
            n_dropped = 0
        name, mark = _marks(tag, m[3])
        drop = mark >= least
        if len(stack) >= DEPTH:
            over.append((tag, drop))
            n_over[tag] = n_over.get(tag, 0) + 1
            n_dropped += drop
            continue
        up = stack[-1]
        node = Node(tag, up.path if tag in INLINE else f"{up.path}>{name}", up, drop or up.dropped, up.anchor or tag == "a")
        stack.append(node)
        if tag in CONTAINERS and not node.dropped:
            containers.append(node)
    flush()
    return containers, blocks


def _container(node: Node) -> Node | None:
    while node and node.tag not in CONTAINERS:
        node = node.parent
    return node


def scores(page: str) -> dict[str, float]:
    """Score of each container path of a page: its own text less its links, a share of what lies below, less for depth."""
    containers, blocks = parse(page)
    own: dict[int, float] = {}
    for node, text in blocks:
        c, part = _container(node), 1.0
        density = node.links / node.chars if node.chars else 0
        value = len(text) * (1 - density) * (0.3 if node.tag == "li" else 1.0)
        while c and part > 0.2:
            own[id(c)] = own.get(id(c), 0.0) + value * part
            part *= 0.6
            c = _container(c.parent) if c.parent else None
    out: dict[str, float] = {}
    for c in containers:
        if v := own.get(id(c)):
            out[c.path] = out.get(c.path, 0.0) + v * (1.3 if c.tag in ("article", "main") else 1.0)
    return out


def _with_siblings(ranked: list[tuple[str, float]]) -> list[list[str]]:
    """Each path, best first, with those after it that have the same parent and a share of its score."""
    parent = lambda p: p.rpartition(">")[0]
    return [[p, *(q for q, w in ranked[k + 1 :] if parent(q) == parent(p) and w >= SIBLING * v)] for k, (p, v) in enumerate(ranked)]


def extract(page: str, paths: list[list[str]]) -> str:
    """Text of the page's elements with the first of ``paths`` (each with its siblings) that has text, else of its own best container and its siblings."""
    _, blocks = parse(page)
    if not blocks:
        return ""

    def of(some: list[str]) -> list[str]:
        below = tuple(p + ">" for p in some)
        return [t for node, t in blocks if node.path in some or node.path.startswith(below)]

    for some in paths:
        if of(some[:1]):
            return " ".join(of(some))
    mine = scores(page)
    if mine:
        return " ".join(of(_with_siblings(sorted(mine.items(), key=lambda x: (-x[1], x[0])))[0]))
    return " ".join(t for _, t in blocks)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: each host's best paths with their votes, by the summed share of its pages' scores."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes: dict[tuple[str, str], float] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = scores(page or "")
                total = sum(s.values())
                for path, v in s.items():
                    votes[host, path] = votes.get((host, path), 0.0) + v / total
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.float64())], ["host", "path", "votes"])

    votes = pages.select("_host", "html").mapInArrow(vote, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    rank = F.row_number().over(_by_host())
    best = votes.withColumn("_n", rank).where(F.col("_n") <= KEPT_PATHS)
    return best.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "path", "votes"))), lambda x: F.struct(x["path"], x["votes"])).alias("paths"))


def _by_host():
    from pyspark.sql.window import Window

    return Window.partitionBy("host").orderBy(F.desc(F.round("votes", 6)), "path")


def consensus_extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, host of every page."""
    spark = pages.sparkSession
    tune(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("_host"))
    winners = materialize(host_paths(rows), "host-paths")
    if winners.count() <= MAX_BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(winners), F.col("_host") == F.col("host"), "left")
    else:
        spread = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, (F.col("_host") == F.col("host")) & (salted["_salt"] == spread["_salt"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            voted = [_with_siblings([(x["path"], x["votes"]) for x in paths or ()]) for paths in b.column(4).to_pylist()]
            texts = [extract(p or "", paths) for p, paths in zip(b.column(2).to_pylist(), voted, strict=True)]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column(3)]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "host"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "_host", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, host string")

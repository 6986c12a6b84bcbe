"""Main text of web pages by a site style tree.

Pages of one host are laid over each other: the elements that stand at one path of tags and classes are one node of the
host's tree. A node whose pages fill it with the same few contents, or whose children look the same on all pages, tells
little and is noise; one with varied contents is important. Importance is entropy: counts over (host, node, content)
are summed by ordinary aggregation, so a host of any size is spread over tasks, and pages are only joined with a few
numbers a node.
"""

from __future__ import annotations

import html as htmllib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import materialize, per_batch

#: Fixed values of the markup language: elements without content, with raw text, that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold main text, whatever their content.
NOISE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe button select textarea input label svg canvas object embed menu dialog title option noembed noframes xmp math audio video".split())
#: Words of class and id names that mark noise.
NOISE_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu modal navbar navigation nav newsletter notice popup popular promo promoted promotion recommended related replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
MAIN_TAGS = frozenset({"article", "main"})
#: Nodes less important than this go, where pages are enough to tell.
LEAST_IMPORTANCE = 0.25
LEAST_PAGES = 5
#: How many times a marked block's text counts against the blocks outside marks.
MARK_WEIGHT = 10
#: Dull nodes that are sent to every task at most (8 bytes each and their host's name); tasks that share a host beyond.
BROADCAST_NODES = 200_000
SALTS = 64

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Which open elements a start tag closes, as end tags may be left out, and the elements that it never looks beyond.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
_SCOPE = frozenset("table ul ol menu dl body html article main section nav".split())


class Node:
    __slots__ = ("children", "label", "main", "noise", "parent", "path", "tag")

    def __init__(self, tag: str, label: str, noise: bool, parent: Node | None):
        self.tag, self.label, self.noise, self.parent = tag, label, noise, parent
        self.main = tag in MAIN_TAGS or (parent is not None and parent.main)
        self.path = f"{parent.path}/{label}" if parent is not None else label
        self.children: list[Node] = []


def _describe(tag: str, raw: str) -> tuple[str, bool]:
    """Label of an element for the tree, its tag and classes, and whether its tag or names mark noise."""
    noise = tag in NOISE_TAGS
    if not raw or "=" not in raw and "hidden" not in raw:
        return tag, noise
    attrs = {m[1].lower(): htmllib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}
    classes = sorted(attrs.get("class", "").lower().split())
    if tag not in ("html", "body", "article", "main"):
        names = {w for v in (*classes, attrs.get("id", "").lower()) for w in _NAME.findall(v)}
        noise = noise or not names.isdisjoint(NOISE_NAMES)
        noise = noise or attrs.get("role", "").lower() in NOISE_ROLES or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", raw)) or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    return ".".join([tag, *classes]), noise


def _block(node: Node) -> Node:
    while node.parent is not None and node.tag not in BLOCK:
        node = node.parent
    return node


def _close_implied(tag: str, here: Node) -> Node:
    """Where a block element starts, once the elements are closed that it closes: an open paragraph, or its own kind."""
    at = _block(here)
    if at.tag == "p":
        at = here = at.parent
    closes = _CLOSES.get(tag, ())
    while closes and at.parent is not None and at.tag not in _SCOPE:
        if at.tag in closes:
            here = at.parent
        at = at.parent
    return here


def _close(tag: str, here: Node) -> Node:
    """Where an end tag leads: out of the nearest such element; nowhere if none is open or, for inline ones, a block
    element stands between."""
    at = here
    while at.parent is not None and at.tag != tag:
        if tag not in BLOCK and at.tag in BLOCK:
            return here
        at = at.parent
    return at.parent or here


def parse(html: str | None) -> tuple[list[tuple[str, Node]], list[Node]]:
    """Blocks (text, element) in page order outside noise, and all elements.

    References are decoded and white space is one space. A block ends where a block element begins or ends; ``br`` is
    white space. Text in noise elements is left out, and such an element within a line doesn't end the block.
    """
    html = html or ""
    here = root = Node("", "", False, None)
    nodes, blocks, run = [root], [], []

    def flush() -> None:
        text = _SPACE.sub(" ", htmllib.unescape("".join(run))).strip()
        run.clear()
        if text:
            blocks.append((text, _block(here)))

    pos, n = 0, len(html)
    while pos < n:
        m = _TOKEN.search(html, pos)
        until = m.start() if m else n
        if until > pos and not here.noise:
            run.append(html[pos:until])
        if m is None:
            break
        pos = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        tag = m[2].lower()
        if tag == "br" and not here.noise:
            run.append(" ")
        if tag in BLOCK:
            flush()
        if m[1]:
            here = _close(tag, here)
        elif tag not in VOID:
            if tag in BLOCK:
                here = _close_implied(tag, here)
            label, noise = _describe(tag, m[3])
            node = Node(tag, label, noise or here.noise, here)
            here.children.append(node)
            nodes.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
                pos = end.end() if end else n
            else:
                here = node
    flush()
    return blocks, nodes


def _node_key(path: str) -> int:
    return xxhash.xxh64_intdigest(path.encode(), 1) - (1 << 63)


def _own_style(node: Node) -> str:
    """How an element presents its children: their labels in order, equal neighbours once."""
    labels = [c.label for c in node.children if not c.noise]
    return " ".join(x for i, x in enumerate(labels) if not i or x != labels[i - 1])


def observations(html: str | None) -> list[tuple[int, int, int]]:
    """(node, kind, feature) of a page, each once: kind 0 for a node's presentation, 1 for a content in it."""
    blocks, nodes = parse(html)
    out = {(_node_key(x.path), 0, _node_key(_own_style(x))) for x in nodes if not x.noise}
    out |= {(_node_key(x.path), 1, _node_key(t)) for t, x in blocks}
    return list(out)


def _page_key(html: str | None) -> int:
    """The page's marked blocks as a number, or all its blocks where none is marked: equal for copies of one article."""
    blocks, _ = parse(html)
    return _node_key("\n".join([t for t, x in blocks if x.main] or [t for t, _ in blocks]))


def importance(pages: DataFrame, host_col: str, html_col: str, distinct: bool = False) -> DataFrame:
    """Rows (host, node, pages, importance) for the nodes seen on ``LEAST_PAGES`` or more pages of a host.

    A node's contents c have shares p of all its content occurrences; their normalised entropy is 1 where every page
    brings its own and 0 where all bring the same. Presentation is alike over the ways children are laid out. A node's
    importance is the larger of the two: noise must be dull in both. With ``distinct``, pages of a host that are copies
    of one article count once, so that its text is not taken for a template.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        host, rows = [], []
        for i, h in enumerate(batch.column(1)):
            found, page = observations(h.as_py()), _page_key(h.as_py()) if distinct else 0
            host += [i] * len(found)
            rows += [(*x, page) for x in found]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table([batch.column(0).take(pa.array(host, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=["host", "node", "kind", "feature", "page"])

    seen = pages.select(F.col(host_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(per_batch(run), "host string, node long, kind long, feature long, page long")
    seen = seen.distinct() if distinct else seen
    counts = seen.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("c"))
    sums = counts.groupBy("host", "node", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("clogc"))
    entropy = F.when(F.col("n") > 1, (F.log2("n") - F.col("clogc") / F.col("n")) / F.log2("n")).otherwise(1.0)
    per = sums.withColumn("e", entropy).groupBy("host", "node").agg(F.max("e").alias("importance"), F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"))
    return per.where(F.col("pages") >= LEAST_PAGES).select("host", "node", "pages", "importance")


def main_text(html: str | None, dull: frozenset[int] | set[int]) -> str:
    """Blocks of a page outside noise elements and outside ``dull`` nodes; those in an article or main element alone,
    unless the others hold more than ``MARK_WEIGHT`` times their text.

    A branch of low importance goes, in a marked article too; if nothing would stay, nothing goes.
    """
    blocks, nodes = parse(html)
    kept = blocks
    if dull:
        alive: set[int] = set()  # elements that are important or hold one that is
        for x in nodes:
            if not x.noise and _node_key(x.path) not in dull:
                while x is not None and id(x) not in alive:
                    alive.add(id(x))
                    x = x.parent
        kept = [(t, x) for t, x in blocks if id(x) in alive] or blocks
    inside = [t for t, x in kept if x.main]
    outside = sum(len(t) for t, x in kept if not x.main)
    if sum(map(len, inside)) * MARK_WEIGHT >= outside and inside:
        return "\n".join(inside)
    return "\n".join(t for t, _ in kept)


def host_of(url_col: str):
    """Host of a URL in lower case, without port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Rows (id_col, url_col, text, n_chars): the main text of every page, empty if there is none.

    Null html counts as empty; pages without a host form one site. Repeated rows come back repeated; a page of any
    length is parsed whole. Other columns are ignored; an empty table gives none.

    Only nodes that are dull travel to the pages: as one array a host, to every task while they are ``BROADCAST_NODES``
    or fewer in all, else by a join on host and salt, so that no host's pages meet in one task.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    found, _ = materialize(importance(src, "host", "html", distinct=True).where(F.col("importance") < LEAST_IMPORTANCE).select("host", "node"), "dull")
    dull = found.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("dull"))
    if found.count() <= broadcast_nodes:
        wide = src.join(F.broadcast(dull), "host", "left")
    else:
        salted = src.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
        wide = salted.join(dull.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")
    wide = wide.select("id", "url", "html", "dull")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py(), frozenset(d.as_py() or ())) for h, d in zip(batch.column(2), batch.column(3), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = wide.mapInArrow(per_batch(run), f"id {src.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col}) if url_col != "url" or id_col != "id" else out

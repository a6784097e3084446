"""Main text of web pages by site style trees.

Pages of a host are merged into one style tree.  A tree node is a path of labels (a tag with its class
and id) from the root; a page's DOM maps onto it.  At each node two distributions over the host's pages
are counted: the *presentation* (the run-collapsed sequence of child labels) and the *content* (the
node's own text and links).  The importance of either is its entropy over the most it could be, the logarithm of the
pages that have the node, both raised by ``PRIOR``: near 0 where many pages look or read alike, 1 where all
differ or only one page has the node.  An element's composite importance is found from the leaves up: that of its
presentation, weighed by how many children it has, with the mean of its children's and of its own content's.  From
each page the branches of block elements below ``THRESHOLD`` are removed (a phrase inside a block never is);
nothing is removed inside an article that is below it as a whole, as pages may be copies.

Markup that names its own role by the HTML standard or by a whole class, id or role of that meaning (scripts, styles,
navigation, headers and footers of the page, asides, forms, adverts, cookie notices, reader comments) is removed
with it.  A class that only has such a word in it ("notice-of-intent", "related-work") is a hint: it raises the threshold
to ``HINTED``, and the tree decides.  A form is removed unless it holds the article or half of the page's text.  If the page
marks its article (``article``, ``main`` or such a role), the main text is what is left in it; else it is what is
left of the body.

Counting is a map over pages with a bounded table of partial counts, then grouped sums, so a hot host
is combined before it moves.  Of a host's nodes those on at least ``LEAST_SHARE`` of its pages go back to all its pages: by
that share they are at most 1 / ``LEAST_SHARE`` times the nodes of a page, however many pages and labels it has.  They
go as a table of known size: broadcast if it is small, else joined by host with hot hosts split.  The rarer nodes of a host
(of at least two pages, and so only of a host with over 2 / ``LEAST_SHARE``) go to those pages alone that have them, joined by
host and path: every node that says something counts, whatever its share.

Defined cases: null html is the empty page: empty text.  A null url is a host of its own, shared by all
such pages.  Broken markup is read as browsers do in the main: unclosed elements end with their parents,
stray end tags are dropped, elements below level ``DEEPEST`` stand beside one another.  Very long pages are read whole.  Repeated
rows are pages of their own.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common

THRESHOLD, HINTED, PRIOR, LEAST_SHARE = 0.12, 0.5, 0.25, 0.005
#: A child's weight against its parent's presentation falls by this with each brother.
DAMPING = 0.9
#: Partial counts held at once by a worker.
HELD = 100_000

_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed values of the HTML standard: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An open element (key) ends where one of these begins.
ENDED_BY = {"p": BLOCK - {"body", "html", "caption", "td", "th"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: What may lie between such an element and the one that ends it.
_SCOPE = frozenset("ul ol dl table article section div main body nav aside header footer form blockquote td th".split())
#: Elements that are never main text.
REMOVED = frozenset("script style noscript template head title nav aside form button select option textarea input iframe object svg canvas audio video dialog menu footer map".split())
#: Roles of the ARIA standard that are no main text.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
#: Whole classes, ids or roles of parts that are no main text, whatever they hold.
FIRM_PARTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsored promoted comments comment-list commentlist comment-section disqus disqus_thread replies related-posts related-articles recommended recommendations trending".split())
#: The same, unless they hold the article.
PARTS = frozenset(
    "nav navbar navigation main-nav site-nav menu main-menu breadcrumb breadcrumbs sidebar side-bar aside footer site-footer page-footer site-header page-header masthead topbar toolbar cookies cookie-notice cookie-banner cookie-bar cookie-consent consent gdpr notice site-notice popup modal overlay newsletter newsletter-signup subscribe signup share sharing share-buttons share-bar social social-share widget widgets pagination pager skip-link login search-form copyright".split()
)
#: Words that hint at such a part when they stand in a longer name.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social comment comments replies reply respond related recommended recommendations trending widget widgets pagination pager skip login search copyright".split()
)
#: A class such as "has-sidebar" names no part.
_ABOUT = frozenset({"has", "with", "no", "without", "hide"})
MAIN = frozenset({"article", "main"})
#: Deeper elements become siblings, as in browsers.
DEEPEST = 400
_NODES = "array<struct<path:bigint,looks:double,reads:double>>"
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    label: str
    path: int
    #: 0: not a named part; 1: one unless it holds the article; 2: one in any case.
    named: int = 0
    hinted: bool = False
    main: bool = False
    #: Text pieces and child nodes in page order.
    parts: list = field(default_factory=list)
    links: list[str] = field(default_factory=list)


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def parse(source: str) -> Node:
    """The page's DOM; every node knows its style tree path."""
    root = Node("", "", 0)
    stack = [root]
    #: Open elements that are too deep for the stack, by tag: their end tags close nothing else.
    beyond: Counter = Counter()
    at, n = 0, len(source)
    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            stack[-1].parts.append(html.unescape(source[at:begin]))
        if begin >= n:
            break
        m = _TAG.match(source, begin)
        if m is None:
            stack[-1].parts.append("<")
            at = begin + 1
            continue
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if beyond[name]:
                beyond[name] -= 1
                continue
            if name == "p" and all(x.tag != "p" for x in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
        elif m[2]:
            name = m[2].lower()
            if name == "br":
                stack[-1].parts.append("\n")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if name in ENDED_BY.get(stack[k].tag, ()):
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE:
                    break
            node = _node(name, m[3] or "", stack)
            stack[-1].parts.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(source, at)
                at = end.end() if end else n
            elif name not in VOID and not (m[3] or "").rstrip().endswith("/"):
                if len(stack) < DEEPEST:
                    stack.append(node)
                elif name not in ENDED_BY:
                    beyond[name] += 1
    return root


def _node(name: str, raw: str, stack: list[Node]) -> Node:
    attributes = {}
    if raw:
        for a in _ATTRIBUTE.finditer(raw):
            attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
    marks = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
    # Numbers in classes and ids tell pages apart, not styles.
    shown = re.sub(r"\d+", "", marks).strip()
    tokens = {mark.lower() for mark in marks.split()}
    words: set[str] = set()
    for mark in marks.split():
        found = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", mark))]
        if found and found[0] not in _ABOUT:
            words.update(found)
    label = f"{name}.{shown}" if shown else name
    above = stack[-1]
    role = attributes.get("role", "").strip().lower()
    main = name in MAIN or role in MAIN
    named = 0
    if name in ("html", "body"):
        pass
    elif name in REMOVED and name != "form" or tokens & FIRM_PARTS or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        named = 2
    elif name == "form" or name == "header" and not any(x.main for x in stack) or name not in MAIN and (role in ROLES or tokens & PARTS):
        named = 1
    # An article inside comments or among related ones is no main text; it goes with its ancestor.
    node = Node(name, label, digest(f"{above.path}/{label}"), named, name not in ("html", "body", *MAIN) and bool(words & HINTS), main)
    if name == "a" and attributes.get("href"):
        above.links.append(attributes["href"])
    return node


def style_values(root: Node) -> Iterator[tuple[int, int, int]]:
    """(path, kind, value) of a page: one value a path, of the presentations (0) and contents (1) of its nodes."""
    shown: dict[int, list[str]] = {}
    said: dict[int, list[str]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        labels, texts = [], list(node.links)
        for part in node.parts:
            if isinstance(part, Node):
                if not labels or labels[-1] != part.label:
                    labels.append(part.label)
                todo.append(part)
            elif not part.isspace():
                texts.append(" ".join(part.split()))
        shown.setdefault(node.path, []).append(">".join(labels))
        said.setdefault(node.path, []).append("\n".join(texts))
    for kind, found in ((0, shown), (1, said)):
        for path, values in found.items():
            yield path, kind, digest("\x00".join(sorted(set(values))))


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def count_styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (host, path, kind, value) over a partition's pages."""
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("n", pa.int64())])
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys, counts = zip(*held.items(), strict=True) if held else ((), ())
        out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], schema.field(i).type) for i in range(4)), pa.array(counts, pa.int64())], schema=schema)
        held.clear()
        return out

    for batch in batches:
        for host, source in zip(batch.column(0), batch.column(1), strict=True):
            name = host.as_py()
            held.update((name, *v) for v in style_values(parse(source.as_py() or "")))
            if len(held) >= HELD:
                yield flush()
    yield flush()


def main_text(root: Node, known: dict[int, tuple[float, float]]) -> str:
    """What is left of the page once named parts and branches of low importance are gone.

    ``known`` has, by path, the importance of presentation and content; a path it lacks is of importance 1.
    """
    weights: dict[int, float] = {}
    lengths: dict[int, int] = {}

    def weigh(node: Node) -> None:
        """The composite importance and the letters of each element of a branch."""
        looks, reads = known.get(node.path, (1.0, 1.0))
        below: list[float] = []
        letters = 0
        speaks = bool(node.links)
        for part in node.parts:
            if isinstance(part, Node):
                weigh(part)
                below.append(weights[id(part)])
                letters += lengths[id(part)]
            elif not part.isspace():
                speaks = True
                letters += len(part)
        share = DAMPING ** len(below)
        if speaks:
            below.append(reads)
        weights[id(node)] = (1 - share) * looks + share * (sum(below) / len(below) if below else looks)
        lengths[id(node)] = 0 if node.named == 2 else letters

    marked: list[int] = []

    def sweep(node: Node) -> None:
        """Marks the branches to remove."""
        if (node.main or node is root) and weights[id(node)] < THRESHOLD:
            # Copies of one page: nothing in them tells the article from the rest.
            return
        for part in node.parts:
            if isinstance(part, Node):
                if part.tag in BLOCK and weights[id(part)] < (HINTED if part.hinted else THRESHOLD) and not holds_main(part):
                    marked.append(id(part))
                else:
                    sweep(part)

    mains: dict[int, bool] = {}

    def holds_main(node: Node) -> bool:
        known = mains.get(id(node))
        if known is None:
            known = mains[id(node)] = node.named < 2 and (node.main or any(holds_main(p) for p in node.parts if isinstance(p, Node)))
        return known

    def gone(node: Node) -> bool:
        if node.named == 2 or id(node) in dropped:
            return True
        # Some pages are one form as a whole.
        return node.named == 1 and not holds_main(node) and not (node.tag == "form" and 2 * lengths[id(node)] >= lengths[id(root)])

    weigh(root)
    sweep(root)
    dropped = set(marked)
    tops: list[Node] = []

    def find(node: Node) -> None:
        for part in node.parts:
            if isinstance(part, Node) and not gone(part):
                if part.main:
                    tops.append(part)
                else:
                    find(part)

    find(root)
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append(text)

    def write(node: Node) -> None:
        for part in node.parts:
            if not isinstance(part, Node):
                held.append(part)
            elif not gone(part):
                if part.tag in BLOCK:
                    close()
                    write(part)
                    close()
                else:
                    write(part)

    for top in tops or [root]:
        write(top)
        close()
    return "\n\n".join(blocks)


def node_importances(styles: DataFrame) -> DataFrame:
    """host, path, looks, reads of the nodes with an importance below 1, and whether many of the host's pages have them."""
    values = styles.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("c"))
    nodes = values.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.log("m") - F.col("s") / F.col("m")
    raised = F.when(F.col("m") > 1, (entropy + PRIOR) / (F.log("m") + PRIOR)).otherwise(1.0)
    both = nodes.groupBy("host", "path").agg(F.max("m").alias("m"), F.max(F.when(F.col("kind") == 0, raised)).alias("looks"), F.max(F.when(F.col("kind") == 1, raised)).alias("reads"))
    # Read twice below, but the pages are parsed once for it.
    both = common.shared_table(both, "style-counts", few=True)
    # The root is on every page of its host.
    pages = both.where("path = 0").select(F.col("host").alias("of"), F.col("m").alias("pages"))
    known = both.where(F.least("looks", "reads") < 1.0).join(pages, both.host == pages.of)
    return known.select("host", "path", "looks", "reads", (F.col("m") >= F.col("pages") * LEAST_SHARE).alias("often"))


def by_host(nodes: DataFrame) -> DataFrame:
    """host, an array of (path, looks, reads) of the nodes that many of its pages have, and whether it has others."""
    return nodes.groupBy("host").agg(F.collect_list(F.when(F.col("often"), F.struct("path", "looks", "reads"))).alias("known"), F.max(~F.col("often")).alias("more"))


def importances(styles: DataFrame) -> DataFrame:
    return by_host(node_importances(styles))


def paths_beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, path) of each page's nodes that are not among its host's known ones."""
    schema = pa.schema([("host", pa.string()), ("key", pa.string()), ("path", pa.int64())])
    held: dict[str, set[int]] = {}
    for batch in batches:
        hosts, keys, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), ([], [], [])
        for host, key, source, nodes in zip(hosts, keys, batch.column(2), batch.column(3), strict=True):
            if host not in held:
                if len(held) >= 1000:
                    held.clear()
                held[host] = {n["path"] for n in nodes.as_py() or ()}
            found, todo = set(), [parse(source.as_py() or "")]
            while todo:
                node = todo.pop()
                found.add(node.path)
                todo += [part for part in node.parts if isinstance(part, Node)]
            found -= held[host]
            for column, values in zip(out, ([host] * len(found), [key] * len(found), sorted(found)), strict=True):
                column += values
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every whole page."""
    common.prepare(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)", 1))
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    styles = read.select("host", "html").mapInArrow(count_styles, "host string, path long, kind int, value long, n long")
    # Found from the written counts, so the pages are not parsed again where both are read.
    nodes = node_importances(styles)
    trees = common.shared_table(by_host(nodes).withColumnRenamed("host", "of"), "style-trees", few=True)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, tuple[float, float]]] = {}
        for batch in batches:
            texts = []
            for host, source, nodes, own in zip(*(batch.column(k) for k in (2, 3, 4, 5)), strict=True):
                name = host.as_py()
                if name not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[name] = {n["path"]: (n["looks"], n["reads"]) for n in nodes.as_py() or ()}
                rarer = {n["path"]: (n["looks"], n["reads"]) for n in own.as_py() or ()}
                texts.append(main_text(parse(source.as_py() or ""), known[name] | rarer if rarer else known[name]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    joined = read.join(trees, read.host == trees.of, "left")
    columns = ["page_id", "url", "host", "html", "known"]
    if trees.where("more").isEmpty():
        found = joined.select(*columns, F.lit(None).cast(_NODES).alias("own"))
    else:
        # Equal pages of a host have equal nodes, so a page's key is its content; one that has several rows is asked once.
        apart = joined.where("more").select(*columns, F.md5(F.coalesce("html", F.lit(""))).alias("key"))
        beyond = apart.select("host", "key", "html", "known").mapInArrow(paths_beyond, "host string, key string, path long")
        own = beyond.join(nodes.where("NOT often"), ["host", "path"]).groupBy("host", "key").agg(F.collect_set(F.struct("path", "looks", "reads")).alias("own"))
        own = common.shared_table(own, "style-rarer", few=True)
        rest = joined.where("more IS NULL OR NOT more").select(*columns, F.lit(None).cast(_NODES).alias("own"))
        found = rest.union(apart.join(own, ["host", "key"], "left").select(*columns, "own"))
    return found.mapInArrow(over, "page_id long, url string, text string, n_chars long")

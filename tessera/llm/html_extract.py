"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a node with a binary label, content or not. Its unary potential comes from
its tag, hints in its class, id and role, the length of its own text, the share of links
in it and whether an article is open; a 2 x 2 potential couples it with its parent (one for what is fenced off by a mark such as nav or an advert's
class, on it or around it, and one for the rest). Sum-product message passing, once from the
leaves up and once from the root down, gives each node's exact marginal, and the text of
the nodes with a content marginal above ``cut`` is the main text, in page order.

Both potentials are counts (naive Bayes and label transitions, with pseudo-counts) over
labelled pages: pages that mark their article (article, main, or itemprop articleBody)
outside of which nothing is content, nor inside of what is marked as navigation, aside, form,
footer, advert or comments. The counts are taken by Spark over at most about ``sample``
such pages, chosen by a hash of the page id. ``HINTS`` are pseudo-counts for hints whatever
the sample holds.

Defined cases: null or empty html has no text; unclosed and stray tags are tolerated as
browsers do (implied ends, void and raw-text elements); character references are
decoded; white space inside a block becomes one blank; blocks are joined by one blank;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math select option button datalist object audio video canvas".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag of the key ends open elements of the values (up to the nearest list, table or block).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = set("ul ol dl table article section div body html main aside nav footer header form".split())

#: Words in class, id or role and what they hint at.
HINT_WORDS = {
    "off": "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
           "feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination "
           "pager paywall popup promo promotion reaction reactions related remark replies reply respond response responses search "
           "share sharing sidebar aside signup social sponsor sponsored subscribe subscription toolbar topbar widget skip legal copyright "
           "complementary contentinfo alert dialog recommended recommendations teaser".split(),
    "on": "article articlebody body content entry main maintext post story text".split(),
}
OFF_TAGS = set("nav aside form footer dialog menu".split())
HINTS = {("hint", "off"): (1.0, 400.0), ("hint", "on"): (60.0, 15.0), **{("tag", t): (1.0, 400.0) for t in OFF_TAGS},
         ("tag", "article"): (60.0, 2.0), ("tag", "main"): (40.0, 4.0), ("inside", "yes"): (200.0, 1.0)}


class Node:
    """A block element; ``inside``: an article is open; ``fenced``: it or what it is in is marked as no content."""

    __slots__ = ("tag", "parent", "hint", "article", "inside", "fenced", "linked", "chars")

    def __init__(self, tag: str, parent: int, hint: str, article: bool, above: "Node | None"):
        self.tag, self.parent, self.hint, self.article = tag, parent, hint, article
        self.inside = article or (above is not None and above.inside)
        off = hint == "off" or tag in OFF_TAGS or tag == "header" and not self.inside
        self.fenced = off or (above is not None and above.fenced)
        self.chars = self.linked = 0


def _hint(attributes: str) -> tuple[str, bool, bool]:
    """(hint, marked as article body, hidden) of a start tag's attributes."""
    hint, body, hidden = "", False, False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            names = set(re.split(r"[^a-z]+", re.sub(r"\d+", " ", value)))
            body |= "articlebody" in names
            if names & _OFF:
                hint = "off"
            elif names & _ON and not hint:
                hint = "on"
        hidden |= name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value) is not None
    return hint, body, hidden


_OFF, _ON = set(HINT_WORDS["off"]), set(HINT_WORDS["on"])


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements as a tree (node 0 is the root, parents come before children), and the
    text blocks in page order, each with its node."""
    nodes = [Node("root", -1, "", False, None)]
    blocks: list[tuple[int, str]] = []
    open_tags: list[tuple[str, int]] = []  # tag, block node it belongs to
    places: dict[str, list[int]] = {}  # of each tag in open_tags; under "" of those that are not inline
    run: list[str] = []
    run_links = 0

    def push(tag: str, node: int):
        places.setdefault(tag, []).append(len(open_tags))
        if tag not in INLINE:
            places.setdefault("", []).append(len(open_tags))
        open_tags.append((tag, node))

    def last(tags) -> int:
        """Place of the innermost open element with one of ``tags``, or -1."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def flush():
        nonlocal run_links
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                at = open_tags[-1][1] if open_tags else 0
                blocks.append((at, text))
                nodes[at].chars += len(text)
                nodes[at].linked += min(run_links, len(text))
            run.clear()
        run_links = 0

    def close(to: int):
        if places.get("") and places[""][-1] >= to:
            flush()
        while len(open_tags) > to:
            tag, _ = open_tags.pop()
            places[tag].pop()
            if tag not in INLINE:
                places[""].pop()

    def text(piece: str):
        nonlocal run_links
        run.append(piece)
        if places.get("a"):
            run_links += len(piece.strip())

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = max(m.end(), m.start() + 1)
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if closing:
            k = last((tag,))
            if k >= 0 and not (tag in INLINE and last(("",)) > k):  # an inline end tag does not reach out of its block
                close(k)
            elif k < 0 and tag == "p":
                flush()
            continue
        if tag in RAW:  # without an end tag it goes on to the end of the page
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                k = last(("p",))
                close(k if k >= 0 else len(open_tags))
                flush()
            continue
        if tag in INLINE:
            push(tag, open_tags[-1][1] if open_tags else 0)
            continue
        if tag in ENDS_P and (k := last(("p",))) > last(FENCES):
            close(k)
        ended = ENDS.get(tag, ())
        while ended and (k := last(ended)) > last(FENCES - ended):
            close(k)
        flush()
        parent = open_tags[-1][1] if open_tags else 0
        hint, body, hidden = _hint(m[3])
        if tag in ("html", "body"):
            hint = ""
        if tag == "head" or hidden:
            hint = "off"
        nodes.append(Node(tag if tag in KNOWN else "other", parent, hint, tag in ("article", "main") or body, nodes[parent]))
        if not m[3].endswith("/") or tag in KNOWN:
            push(tag, len(nodes) - 1)
    flush()
    return nodes, blocks


KNOWN = ENDS_P | set(ENDS) | FENCES | {"head", "html", "caption", "summary", "center", "dialog", "hgroup", "search", "address"}


def features(node: Node) -> list[tuple[str, str]]:
    share = node.linked / node.chars if node.chars else 0
    size = "none" if not node.chars else "short" if node.chars < 25 else "line" if node.chars < 100 else "long"
    links = "no text" if not node.chars else "none" if share == 0 else "some" if share < 0.5 else "most"
    inside = "yes" if node.inside and not node.fenced else "no"
    return [("tag", node.tag), ("hint", node.hint or "none"), ("size", size), ("links", links), ("inside", inside)]


def labels(nodes: list[Node]) -> list[int] | None:
    """1 for content, 0 for not, by a page's own article marks; None if it has none."""
    if not any(n.article for n in nodes):
        return None
    return [int(n.inside and not n.fenced) for n in nodes]


class Model:
    """Log-odds of features, and parent-child potentials, from counts {(kind, value, label): n}.

    A single feature counts for at most ``most`` (a sample without, say, paragraphs outside of articles
    must not make every paragraph content); hints and tags that say so may count for more.
    """

    def __init__(self, counts: dict[tuple[str, str, int], float], most: float = 1.5):
        self.odds: dict[tuple[str, str], float] = {}
        kinds = {"tag": KNOWN | {"other", "root"}, "hint": {"off", "on", "none"},
                 "size": {"none", "short", "line", "long"}, "links": {"no text", "none", "some", "most"}, "inside": {"yes", "no"}}
        for kind, values in kinds.items():
            table = {v: [counts.get((kind, v, y), 0.0) + HINTS.get((kind, v), (2.0, 2.0))[1 - y] for y in (0, 1)] for v in values}
            total = [sum(n[y] for n in table.values()) for y in (0, 1)]
            for v, n in table.items():
                odds = math.log(n[1] / total[1]) - math.log(n[0] / total[0])
                self.odds[kind, v] = odds if (kind, v) in HINTS else max(-most, min(most, odds))
        self.odds["inside", "no"] = self.odds["tag", "root"] = 0.0  # not every page marks its article, or has a body
        labelled = [sum(counts.get(("pair", f"{f}{a}", y), 0.0) for f in (0, 1) for a in (0, 1)) + 1.0 for y in (0, 1)]
        self.prior = [n / sum(labelled) for n in labelled]
        #: lift of a child's label given its parent's: [fenced][parent][child]
        self.pair = []
        for fenced in (0, 1):
            rows = []
            for a in (0, 1):
                n = [counts.get(("pair", f"{fenced}{a}", b), 0.0) + ((400.0, 0.1)[b] if fenced else (2.0, 20.0)[a == b]) for b in (0, 1)]
                rows.append([x / sum(n) / q for x, q in zip(n, self.prior)])
            self.pair.append(rows)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node: messages up from the leaves, then down from the root."""
        own = []
        for node in nodes:
            odds = math.log(self.prior[1] / self.prior[0]) + sum(self.odds[f] for f in features(node))
            own.append(1 / (1 + math.exp(-max(-40.0, min(40.0, odds)))))
        own[0] = own[0] if nodes[0].chars else 1e-12  # the page as a whole is no content
        belief = [[1 - p, p] for p in own]  # own potential times the messages of the children
        up = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
            pair, b = self.pair[nodes[i].fenced], belief[i]
            up[i] = message = [pair[a][0] * b[0] + pair[a][1] * b[1] for a in (0, 1)]
            belief[nodes[i].parent] = _scaled([x * m for x, m in zip(belief[nodes[i].parent], message)])
        for i in range(1, len(nodes)):
            pair = self.pair[nodes[i].fenced]
            rest = _scaled([x / m for x, m in zip(belief[nodes[i].parent], up[i])])
            belief[i] = _scaled([belief[i][b] * (rest[0] * pair[0][b] + rest[1] * pair[1][b]) for b in (0, 1)])
        return [b[1] for b in belief]


def _scaled(pair: list[float]) -> list[float]:
    total = pair[0] + pair[1]
    return [max(pair[0] / total, 1e-200), max(pair[1] / total, 1e-200)]


def learn(pages: DataFrame, id_col: str, html_col: str, sample: int) -> Model:
    """Count features and label pairs over a sample of the pages that mark their article."""
    size = pages.count()
    share = min(1.0, sample / max(size, 1))
    chosen = pages.where(F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select(F.col(html_col).alias("html"))

    def counted(batches):
        counts: dict[tuple[str, str, int], int] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                nodes, _ = parse(page or "")
                y = labels(nodes)
                if y is None:
                    continue
                for i, node in enumerate(nodes):
                    keys = [(k, v, y[i]) for k, v in features(node)]
                    if i:
                        keys.append(("pair", f"{int(node.fenced)}{y[node.parent]}", y[i]))
                    for key in keys:
                        counts[key] = counts.get(key, 0) + 1
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()),
                                          pa.array([k[2] for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())],
                                         names=["kind", "value", "label", "n"])

    counts = chosen.mapInArrow(counted, "kind string, value string, label long, n long").groupBy("kind", "value", "label").agg(F.sum("n").alias("n"))
    return Model({(r.kind, r.value, r.label): float(r.n) for r in counts.collect()})  # some 200 rows: the features are a fixed set


def main_text(page: str | None, model: Model, cut: float = 0.5) -> str:
    if not page:
        return ""
    nodes, blocks = parse(page)
    p = model.marginals(nodes)
    return " ".join(text for at, text in blocks if p[at] > cut)


def extract(df: DataFrame, model: Model, html_col: str = "html", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """Replace ``html_col`` by ``text_col``; the other columns pass through (a ``text_col`` among them is replaced)."""
    stay = [c for c in df.columns if c.lower() not in (html_col.lower(), text_col.lower())]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in stay) + f", `{text_col}` string"
    shared = df.sparkSession.sparkContext.broadcast(model)  # some 200 numbers

    def work(batches):
        for batch in batches:
            texts = [main_text(page, shared.value, cut) for page in batch.column(len(stay)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(stay))] + [pa.array(texts, pa.string())], names=[*stay, text_col])

    return df.select(*stay, html_col).mapInArrow(work, schema.removeprefix(", "))

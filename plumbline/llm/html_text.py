"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of its block elements, whose leaves are runs of text. Every node is
content or not. A node's own potential comes from what it is (tag, names in class, id and role, and for
text its length, links and punctuation), an edge's from how often a node of either label stands below
one of either label, by the kind of parent. Sum-product messages go from the leaves to the root and back;
the text runs whose marginal for content is at least one half are the main text.

Both tables of potentials are counted, in Spark, over labelled pages (by default PAGES layouts from
html_pages.py) and broadcast; they have a few hundred entries however many pages there are. Pages to
be extracted are read in place, each by itself.

Text runs are whitespace-normalised, character references decoded; script, style and the like have no
text, and end, if not closed, with the block they are in or before a block that cannot lie in them;
a new paragraph or block closes an open paragraph. Defined results: null and empty pages give
empty text, pages without markup are one run of text; unclosed or stray tags are closed or passed over.
Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import html_pages
from .common import carried

PAGES = 1000
SMOOTH = 0.5

#: Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template svg math iframe object canvas head title select option textarea button audio video datalist".split())
BLOCKS = set(
    "html body article section main aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset legend label address details summary dialog hr center menu".split())
#: What a start tag closes if it is open further in than the tags named after it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
#: Silent elements in which no block can lie, those that hold anything, and blocks that can lie in few.
NO_BLOCKS, ANY_BLOCKS = set("head title select option textarea datalist svg math".split()), {"template", "foreignobject"}
OUTER = set("html body main article section aside nav header footer".split())
CONTAINERS = set("html body div main section".split())
SPACE = re.compile(r"\s+")
KINDS = {word: kind for kind, words in html_pages.NAMES.items() for word in words}


class Node:
    __slots__ = ("tag", "parent", "features", "text", "linked", "label")

    def __init__(self, tag: str, parent: int, features: list[str], label: str | None):
        self.tag, self.parent, self.features, self.label = tag, parent, features, label
        self.text, self.linked = "", 0


class Tree(HTMLParser):
    """Nodes in page order: blocks, and runs of text (tag "")."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1, [], None)]
        self.open, self.silent, self.link = [0], [], False
        #: Where in `open` blocks of each tag are, and where in `silent` elements that silence.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.silencers: list[int] = []
        self.run, self.run_linked = [], 0
        self.feed(html)
        self.close()
        self._end_run()

    def _end_run(self) -> None:
        text = SPACE.sub(" ", "".join(self.run)).strip()
        if text:
            parent = self.nodes[self.open[-1]]
            node = Node("", self.open[-1], [], parent.label)
            node.text, node.linked = text, self.run_linked
            node.features = _run_features(text, self.run_linked, parent.tag)
            self.nodes.append(node)
        self.run, self.run_linked = [], 0

    def _push(self, node: int) -> None:
        self.open.append(node)
        self.places[self.nodes[node].tag].append(len(self.open) - 1)

    def _close(self, tags: set[str], within: set[str] = frozenset()) -> None:
        """Closes the innermost open block of these tags and all inside it, unless one of `within` is open further in."""
        k = max((self.places[t][-1] for t in tags if self.places[t]), default=0)
        if not k or any(self.places[t] and self.places[t][-1] > k for t in within):
            return
        self._end_run()
        for node in self.open[k:]:
            self.places[self.nodes[node].tag].pop()
        del self.open[k:]
        self.link = False

    def _quieten(self, tag: str) -> None:
        self.silent.append(tag)
        if tag not in BLOCKS:
            self.silencers.append(len(self.silent) - 1)

    def _sound(self, k: int) -> None:
        """Ends the silent elements from place k on."""
        del self.silent[k:]
        while self.silencers and self.silencers[-1] >= k:
            self.silencers.pop()

    def _can_lie(self, tag: str) -> bool:
        """Whether a block can lie in the innermost silent element."""
        k = self.silencers[-1]  # the innermost silent element, whatever blocks are open inside it
        if self.silent[k] in ANY_BLOCKS:
            return True
        if self.silent[k] in NO_BLOCKS or tag in OUTER and self.silent[k] != "noscript" or tag in ("html", "body"):
            return False
        return tag not in CLOSES or bool(CLOSES[tag][1] & set(self.silent[k + 1 :]))

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag in SILENT or tag == "foreignobject":
                self._quieten(tag)
            if tag not in BLOCKS or tag in VOID:
                return
            while self.silent and not self._can_lie(tag):
                self._sound(self.silencers[-1])
            if self.silent:
                self._quieten(tag)
                return
        if tag in VOID:
            self.run.append(" ")
            if tag == "hr":
                self._end_run()
        elif tag in SILENT:
            self._quieten(tag)
            self.run.append(" ")
        elif tag == "a":
            self.link = True
        elif tag in BLOCKS:
            self._end_run()
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            self._close({"p"}, BLOCKS - {"p"})
            found = dict(attrs)
            label = found.get("data-content") or self.nodes[self.open[-1]].label
            self.nodes.append(Node(tag, self.open[-1], _block_features(tag, found), label))
            self._push(len(self.nodes) - 1)
            self.link = False

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                self._sound(len(self.silent) - 1 - self.silent[::-1].index(tag))
                return
            if tag not in BLOCKS or not self.places[tag]:
                return
            self._sound(0)  # an enclosing block closes
        if tag == "a":
            self.link = False
        elif tag == "br":
            self.run.append(" ")
        elif tag in BLOCKS:
            self._close({tag})

    def handle_data(self, data):
        if not self.silent:
            self.run.append(data)
            if self.link:
                self.run_linked += len(data.strip())


def _bucket(n: float, *edges: float) -> int:
    return sum(n >= e for e in edges)


def _block_features(tag: str, attrs: dict) -> list[str]:
    names = set()
    for key in ("class", "id", "role"):
        value = (attrs.get(key) or "").lower()
        for word in re.findall(r"[a-z][a-z-]*", value):
            if word in KINDS:
                names.add(KINDS[word])
            else:
                names.update(KINDS[w] for w in word.split("-") if w in KINDS)
    return [f"tag {tag}", *(f"name {n}" for n in sorted(names))]


def _run_features(text: str, linked: int, tag: str) -> list[str]:
    words = text.count(" ") + 1
    share = linked / max(1, len(text))
    return [f"in {tag} {_bucket(words, 3, 6, 12, 25)}", f"links {_bucket(share, 0.05, 0.4, 0.8)}", f"end {text[-1] in '.!?:;'} {_bucket(words, 3, 12)}", f"sign {chr(169) in text}"]


def _edge(parent: Node, child: Node) -> str:
    return f"{'container' if parent.tag in CONTAINERS or parent.tag == '#root' else 'block'} {'run' if child.tag == '' else 'block'}"


def counts(html: str) -> Counter:
    """(kind, name, label or labels) of a labelled page; a block is content if half of its words are."""
    nodes = Tree(html).nodes
    words, content = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.tag == "":
            words[i] = node.text.count(" ") + 1
            content[i] = words[i] if node.label == "1" else 0
        if node.parent >= 0:
            words[node.parent] += words[i]
            content[node.parent] += content[i]
    label = [int(2 * c >= w and w > 0) if n.label is None else int(n.label == "1") for n, w, c in zip(nodes, words, content)]
    found: Counter = Counter()
    for i, node in enumerate(nodes):
        found["label", "run" if node.tag == "" else "block", str(label[i])] += 1
        for feature in node.features:
            found["feature", feature, str(label[i])] += 1
        if node.parent >= 0:
            found["edge", _edge(nodes[node.parent], node), f"{label[node.parent]}{label[i]}"] += 1
    return found


def fit(pages: DataFrame, html_col: str = "html") -> dict:
    """Log potentials: by feature the ratio for content, by edge the 2 x 2 table [parent][child]."""
    schema = T._parse_datatype_string("kind string, name string, label string, n long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            total: Counter = Counter()
            for html in batch.column(0).to_pylist():
                if html:
                    total.update(counts(html))
            rows = [(*k, n) for k, n in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), arrow)] if rows else [pa.nulls(0, f.type) for f in arrow], schema=arrow)

    rows = pages.select(html_col).mapInArrow(run, schema).groupBy("kind", "name", "label").agg(F.sum("n").alias("n")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r.kind, r.name), Counter())[r.label] += r.n
    sizes = {kind: by.get(("label", kind), Counter()) for kind in ("run", "block")}
    model: dict = {"feature": {}, "edge": {}}
    for (kind, name), n in by.items():
        if kind == "feature":
            of = sizes["block" if name.startswith(("tag ", "name ")) else "run"]
            rate = [(n[x] + SMOOTH) / (of[x] + 2 * SMOOTH) for x in ("0", "1")]
            model["feature"][name] = math.log(rate[1] / rate[0])
        elif kind == "edge":
            model["edge"][name] = [[math.log((n[f"{p}{c}"] + SMOOTH) / (n[f"{p}0"] + n[f"{p}1"] + 2 * SMOOTH)) for c in "01"] for p in "01"]
    return model


def trained(spark: SparkSession, pages: int = PAGES) -> dict:
    """The model fitted on `pages` laid-out pages, which the tasks make from their numbers."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([html_pages.page(i) for i in batch.column(0).to_pylist()], type=pa.string())], names=["html"])

    return fit(spark.range(pages).mapInArrow(run, "html string"))


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], model: dict) -> list[float]:
    """Each node's probability of being content, by messages up and then down the tree."""
    n, flat = len(nodes), [[-math.log(2)] * 2] * 2
    own = [[0.0, sum(model["feature"].get(f, 0.0) for f in node.features)] for node in nodes]
    up, down, edges = [[0.0, 0.0] for _ in nodes], [[0.0, 0.0] for _ in nodes], [flat] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        parent = nodes[i].parent
        edge = edges[i] = model["edge"].get(_edge(nodes[parent], nodes[i]), flat)
        for of in (0, 1):
            up[i][of] = _log_sum(edge[of][0] + own[i][0], edge[of][1] + own[i][1])
            own[parent][of] += up[i][of]
    for i in range(1, n):
        parent, edge = nodes[i].parent, edges[i]
        without = [down[parent][of] + own[parent][of] - up[i][of] for of in (0, 1)]  # own holds the messages of all children
        down[i] = [_log_sum(edge[0][of] + without[0], edge[1][of] + without[1]) for of in (0, 1)]
    apart = [own[i][0] + down[i][0] - own[i][1] - down[i][1] for i in range(n)]
    return [1 / (1 + math.exp(min(x, 700.0))) for x in apart]


def blocks(html: str | None, model: dict) -> list[str]:
    if not html:
        return []
    nodes = Tree(html).nodes
    sure = marginals(nodes, model)
    return [node.text for node, p in zip(nodes, sure) if node.tag == "" and p >= 0.5]


def extract(pages: DataFrame, model: dict, id_col: str = "page_id", html_col: str = "html", also: list[str] | None = None, mark: str = "") -> DataFrame:
    """Per page its id, text and n_chars (code points); `also`: further columns to hand on; `mark`: put before the
    new names, where they would clash with those."""
    frame, names, places = carried(pages, id_col, html_col, also)
    schema = T.StructType([*[pages.schema[c] for c in names], *T._parse_datatype_string(f"{mark}text string, {mark}n_chars long").fields])
    arrow, shared = to_arrow_schema(schema), pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = ["\n\n".join(blocks(html, shared.value)) for html in part.column(0).to_pylist()]
                columns = [*[part.column(i) for i in places], pa.array(texts, type=pa.string()), pa.array([len(x) for x in texts], type=pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return frame.mapInArrow(run, schema)

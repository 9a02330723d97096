"""Main text of HTML pages: gradient-boosted trees over DOM nodes and hierarchical decoding.

Trees (Spark ML) score every block element, and every text that stands bare in the body, from subtree density, attribute tokens, depth, position and
sibling statistics. The decoder then chooses, for every subtree, to keep it whole, to drop it whole or to
decide by its children, so that no dropped element has a kept one inside. It maximises the summed
log-probabilities. The model is trained on a bounded number of generated pages (``n_pages``), once a session.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankflow.llm.common import slices, with_fields
from bankflow.llm.html_dom import BARE, Node, parse
from bankflow.llm.html_pages import Maker, labels, render

GROUPS = [
    {"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"},
    {"form", "fieldset", "button", "label", "select", "option", "textarea", "legend", "search", "dialog"},
    {"div", "section", "td", "th", "table", "tr", "tbody", "center"}, {"p", "pre", "blockquote", BARE},
    {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dt", "dd"},
]
GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
GOOD = frozenset("content main post entry article story text body copy".split())
BAD = frozenset(
    "ad ads advert advertisement adsbygoogle banner promo sponsored sponsor slot sidebar side widget related rail "
    "recommended trending links tags notice cookie cookies consent gdpr alert popup modal overlay paywall subscribe "
    "newsletter search login signup comment comments responses discussion disqus replies reply respond footer "
    "copyright legal info colophon bottom header masthead top topbar branding logo menu nav navigation breadcrumb "
    "breadcrumbs pagination pager share social toolbar navbar hidden complementary contentinfo dialog".split()
)
N_PAGES = 300
_models: dict[tuple, list] = {}


def walk(node: Node) -> list[Node]:
    """Blocks below ``node`` in page order; deep pages do not recurse."""
    out, stack = [], list(reversed(node.children))
    while stack:
        at = stack.pop()
        out.append(at)
        stack.extend(reversed(at.children))
    return out


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    nodes = walk(root)
    place = {id(n): i for i, n in enumerate(nodes)}
    total = {}
    for n in reversed([root, *nodes]):  # subtree sums, children first
        own = np.array([n.chars, n.links, n.tags + 1, n.stops, n.words], float)
        total[id(n)] = own + sum((total[id(c)] for c in n.children), np.zeros(5))
    page = max(1.0, total[id(root)][0])
    log = lambda n: float(np.log1p(total[id(n)][0]))
    rows = np.zeros((len(nodes), 32))
    sibling: dict[int, tuple[int, int]] = {}
    for n in [root, *nodes]:
        for k, c in enumerate(n.children):
            sibling[id(c)] = (k, len(n.children))
    for i, n in enumerate(nodes):
        row, group = rows[i], GROUP.get(n.tag)
        if group is not None:
            row[group] = 1
        row[10] = sum(t in GOOD for t in n.tokens)
        row[11] = sum(t in BAD for t in n.tokens)
        parent = place.get(id(n.parent))
        if parent is not None:
            above = rows[parent]
            row[12] = max(above[12], above[0])
            row[13] = max(above[13], above[1], above[3], above[4], above[5])
            row[14] = above[14] + above[11]
            row[15] = above[15] + above[10]
            row[16] = above[16] + 1
            row[17] = max(above[17], above[2] * (1 - above[12]))
        chars, links, tags, stops, words = total[id(n)]
        k, siblings = sibling[id(n)]
        around = n.parent.children
        row[18:32] = (
            np.log1p(chars), min(1.0, links / max(1.0, chars)), chars / tags, stops / max(1.0, words),
            chars / max(1.0, words), chars / page, k / siblings, siblings,
            log(around[k - 1]) if k else -1, log(around[k + 1]) if k + 1 < siblings else -1,
            i / len(nodes), len(n.children), n.chars / max(1.0, chars),
            sum(total[id(c)][0] for c in n.children if c.tag in ("p", BARE)) / max(1.0, chars),
        )
    return nodes, rows


def flatten_tree(tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1 in leaves), threshold, left child (the right one follows it in its own array), value."""
    feature, threshold, left, right, value = [], [], [], [], []

    def add(node) -> int:
        at = len(feature)
        for column, empty in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            column.append(empty)
        if node.subtreeDepth() == 0:
            value[at] = node.prediction()
        else:
            split = node.split()
            feature[at], threshold[at] = split.featureIndex(), split.threshold()
            left[at], right[at] = add(node.leftChild()), add(node.rightChild())
        return at

    add(tree._call_java("rootNode"))
    children = np.array([left, right])
    return np.array(feature), np.array(threshold), children, np.array(value)


def margins(trees: list, x: np.ndarray) -> np.ndarray:
    """Half log-odds of main text for every row, as Spark's boosted trees give them."""
    out = np.zeros(len(x))
    rows = np.arange(len(x))
    for weight, (feature, threshold, children, value) in trees:
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            goes_right = x[rows, np.maximum(f, 0)] > threshold[at]
            at = np.where(inner, children[goes_right.astype(int), at], at)
        out += weight * value[at]
    return out


def training_rows(n_pages: int, seed: int) -> list[tuple[float, np.ndarray]]:
    """Features of all labelled nodes of ``n_pages`` pages and a third as many unwrapped ones."""
    rows = []
    pages = [Maker(seed + k).page() for k in range(n_pages)]
    pages += [Maker(seed + k).unwrapped_page() for k in range(n_pages, n_pages + -(-n_pages // 3))]
    for page in pages:
        root, _ = parse(render(page))
        nodes, x = features(root)
        wanted = labels(page)
        if len(nodes) != len(wanted):
            raise ValueError("generated page and tree differ")
        rows += [(float(y), row) for y, row in zip(wanted, x) if y is not None]
    return rows


def train(spark: SparkSession, n_pages: int = N_PAGES, seed: int = 1) -> list:
    """Boosted trees from ``n_pages`` generated pages and unwrapped ones, as arrays that tasks can use."""
    key = (n_pages, seed)
    if key not in _models:
        rows = [(y, Vectors.dense(row)) for y, row in training_rows(n_pages, seed)]
        data = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
        booster = GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.4, seed=seed, maxMemoryInMB=64)
        model = booster.fit(data)
        _models[key] = [(w, flatten_tree(t)) for w, t in zip(model.treeWeights, model.trees)]
    return _models[key]


def decode(root: Node, nodes: list[Node], margin: np.ndarray, switch: float = -0.7) -> set[int]:
    """Runs that are main text. ``switch`` is the price of letting the children decide."""
    p = 1 / (1 + np.exp(-2 * np.clip(margin, -8, 8)))
    yes, no = np.log(p), np.log1p(-p)
    place = {id(n): i for i, n in enumerate(nodes)}
    keep, drop, best, choice = {}, {}, {}, {}
    for n in reversed(nodes):
        i = place[id(n)]
        weight = 1.0 if n.runs else 0.5
        keep[i] = weight * yes[i] + sum(keep[place[id(c)]] for c in n.children)
        drop[i] = weight * no[i] + sum(drop[place[id(c)]] for c in n.children)
        own = max(yes[i], no[i]) if n.runs else 0.0
        split = switch + own + sum(best[place[id(c)]] for c in n.children) if n.children else -np.inf
        best[i] = max(keep[i], drop[i], split)
        choice[i] = "keep" if best[i] == keep[i] else "drop" if best[i] == drop[i] else "split"
    kept: set[int] = set()
    stack = [(c, None) for c in root.children]
    while stack:
        n, forced = stack.pop()
        i = place[id(n)]
        decided = forced or choice[i]
        if decided == "keep" or decided == "split" and yes[i] > no[i]:
            kept.update(n.runs)
        if decided != "drop":
            stack += [(c, "keep" if decided == "keep" else None) for c in n.children]
    if all(c.tag == BARE for c in root.children):
        kept.update(r for c in root.children for r in c.runs)  # a page of bare text
    return kept


def main_texts(pages: list[str | None], trees: list) -> list[str]:
    trees_of = [parse(page) for page in pages]
    found = [features(root) for root, _ in trees_of]
    margin = margins(trees, np.concatenate([x for _, x in found])) if found else np.zeros(0)
    out, at = [], 0
    for (root, texts), (nodes, _) in zip(trees_of, found):
        kept = decode(root, nodes, margin[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(texts[i] for i in sorted(kept)))
    return out


def extract_main_text(pages: DataFrame, html: str = "html", n_pages: int = N_PAGES) -> DataFrame:
    """Struct ``doc`` with the other input columns, and ``text, n_chars`` of every row's page.

    ``text`` joins the kept blocks in page order by a line feed; character references are decoded and white
    space inside a block is one space. Null and empty pages, and pages without main text, give an empty
    text. A page without any block element is text as it is. Nothing is cut, whatever the length; repeated rows give equal texts. An
    empty table gives an empty result.
    """
    trees = train(pages.sparkSession, n_pages)
    inputs = pages.select(others_struct(pages, html), F.col(html).cast("string").alias("page"))

    def extract(batches):
        for batch in batches:
            pages_here = batch.column(1).to_pylist()
            texts: list[str] = []
            for a, b in slices(pages_here, 2_000_000):
                texts += main_texts(pages_here[a:b], trees)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["doc", "text", "n_chars"],
            )

    return inputs.mapInArrow(extract, with_fields(inputs.select("doc").schema, "text string, n_chars long"))


def others_struct(pages: DataFrame, html: str):
    names = [c for c in pages.columns if c != html]
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")

"""HTML extraction: a tree-structured graphical model over DOM nodes, solved by sum-product message passing."""

from __future__ import annotations

import ast
import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from ..sources.scratch import Scratch

# Elements without content, with raw text, that end a paragraph, and that are never shown as text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
HIDDEN = frozenset("head script style template noscript iframe object svg math select textarea button input canvas audio video title".split())
REPEATS = {
    "li": ("li", {"ul", "ol", "menu"}),
    "p": ("p", set()),
    "dt": ("dt dd", {"dl"}),
    "dd": ("dt dd", {"dl"}),
    "tr": ("tr", {"table", "tbody", "thead", "tfoot"}),
    "td": ("td th", {"tr", "table"}),
    "th": ("td th", {"tr", "table"}),
    "option": ("option", {"select"}),
}
# The elements by which HTML itself divides a page into parts.
SECTIONS = frozenset("article main section nav aside header footer form dialog menu address".split())
# Elements that group paragraphs without saying what they hold.
GROUPS = frozenset("html body div section article main ul ol dl table blockquote".split())
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
_SPACES = re.compile(r"[ \t\n\r\f\v  -     　]+")


@dataclass
class Node:
    """An element that ends a block, or a block of text (``tag`` is then empty)."""

    parent: int
    tag: str
    features: list[str]
    text: list[str] = field(default_factory=list)
    linked: int = 0


def parse(page: str) -> list[Node]:
    """The page's block elements and text blocks, parents before children, children in page order.

    Unclosed and stray tags are mended as browsers do for the cases that matter to blocks: paragraphs, list items, cells and rows
    close each other, an end tag closes up to its start, and a stray one is ignored. Text in hidden elements is left out.
    """
    nodes = [Node(-1, "html", [])]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the block node each lies in
    is_open: dict[str, int] = {}  # how many elements of each name the stack holds, so that a stray end tag costs no search
    hidden, links = 0, 0
    block = -1  # the text block that text is added to, if one is open

    def add_text(raw: str):
        nonlocal block
        if hidden or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if block < 0:
            if not text.strip():
                return
            nodes.append(Node(stack[-1][1], "", []))
            block = len(nodes) - 1
        nodes[block].text.append(text)
        if links:
            nodes[block].linked += len(text)

    def close_to(depth: int):
        nonlocal block, hidden, links
        for name, _ in stack[depth:]:
            is_open[name] -= 1
            hidden -= name in HIDDEN
            links -= name == "a"
            if name not in INLINE:
                block = -1
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            tail = page[at:]
            cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", tail)  # a tag that the page's end cuts off is no text
            add_text(tail[: cut.start()] if cut else tail)
            break
        add_text(page[at : found.start()])
        at = found.end()
        name = found.group("name")
        if name is None:
            continue
        name = name.lower()
        if found.group("close"):
            if not is_open.get(name):
                if name == "p":
                    block = -1
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close_to(depth)
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break  # an inline end tag does not close a block
            continue
        if name == "br" or name == "hr":
            add_text(" ")
            if name == "hr":
                block = -1
            continue
        if name in VOID or name == "html":
            continue
        if is_open.get("p") and name not in INLINE and name not in HIDDEN:  # a block ends an open paragraph with what is inside it
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close_to(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if name in REPEATS and any(is_open.get(n) for n in REPEATS[name][0].split()):
            same, until = REPEATS[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in same.split():
                    close_to(depth)
                    break
                if stack[depth][0] in until:
                    break
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        attrs = found.group("attrs")
        if attrs.endswith("/") and name in ("svg", "math"):
            continue
        place = stack[-1][1]
        if name not in INLINE and name not in HIDDEN:
            nodes.append(Node(place, name, _features(name, attrs, bool(is_open.get("article")))))
            place, block = len(nodes) - 1, -1
        elif name in HIDDEN:
            hidden += 1
        links += name == "a"
        stack.append((name, place))
        is_open[name] = is_open.get(name, 0) + 1
    return nodes


def _features(name: str, attrs: str, in_article: bool) -> list[str]:
    """What the markup says about an element: its tag, if that divides pages, and the words of its class, id, role and style."""
    if name in ("html", "body"):
        return []  # their classes describe the page's make-up, not this part of it
    words = set()
    for m in _ATTR.finditer(attrs) if attrs else ():
        words.update(w.lower() for w in _WORD.findall(m.group(2) or m.group(3) or m.group(4) or m.group(1)))
    tag = "reply" if name == "article" and in_article else name  # HTML keeps articles within an article for comments
    return ([f"tag={tag}"] if name in SECTIONS else []) + [f"word={w}" for w in sorted(words)]


def clean(node: Node) -> str:
    return _SPACES.sub(" ", "".join(node.text)).strip(" ")


OUTSIDE, WRAPPER, MAIN = STATES = (0, 1, 2)  # no main text in it; holds main text beside other parts; main text
LATENT = -1


def _text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 10 else 2 if words < 30 else 3
    share = 0 if not linked else 1 if 2 * linked < len(text) else 2
    return [f"shape={size}{'stop' if text[-1:] in '.!?…\"”»' else 'open'}", f"links={share}"]


def evidence(nodes: list[Node], texts: dict[int, str]) -> list[tuple[list[str], float]]:
    """Each node's features and the weight they carry.

    The text blocks of one part of a page are alike, so together they weigh as much as one: a part is the nearest element with features,
    or, without one, the nearest element that groups paragraphs.
    """
    owner, parts = [0] * len(nodes), [0] * len(nodes)
    for i, n in enumerate(nodes):
        if n.tag:
            above = owner[n.parent] if i else 0
            owner[i] = i if n.features or (n.tag in GROUPS and not nodes[above].features) else above
        else:
            owner[i] = owner[n.parent]
            parts[owner[i]] += 1
    return [(n.features, 1.0) if n.tag else (_text_features(texts[i], n.linked), 1.0 / parts[owner[i]]) for i, n in enumerate(nodes)]


# Elements that HTML gives another purpose than the main text, wherever they stand.
ELSEWHERE = frozenset("nav aside footer form dialog menu".split())


def marked(nodes: list[Node]) -> tuple[int, list[bool]] | None:
    """The one article (or, without one, the one main part) that a page marks, and what lies in it; None for other pages."""
    inside = [False] * len(nodes)
    for tag in ("article", "main"):
        for i, n in enumerate(nodes):
            inside[i] = i > 0 and (inside[n.parent] or nodes[n.parent].tag == tag)
        tops = [i for i, n in enumerate(nodes) if n.tag == tag and not inside[i]]
        if len(tops) == 1:
            return tops[0], inside
    return None


def kinds(nodes: list[Node]) -> list[str]:
    """The kind of each node, which its transition potentials go by.

    On a page that marks one article, what holds it is a holder and a nameless part beside it a stray. The root's kind tells whether
    the page marks one.
    """
    named = ["body" if n.tag == "body" else "named" if n.features else "plain" if n.tag else "text" for n in nodes]
    found = marked(nodes)
    if found:
        top, inside = found
        named = ["stray" if kind in ("plain", "text") and not inside[i] else kind for i, kind in enumerate(named)]
        while (top := nodes[top].parent) > 0:
            named[top] = "holder"
    return ["marked" if found else "bare", *named[1:]]


def label(nodes: list[Node]) -> list[int] | None:
    """States of a page that marks exactly one article (or, without one, one main part) by its elements; None for other pages.

    Only structure decides: the part and what lies in it are main text, but for elements of another purpose and articles within the
    article, which HTML keeps for comments; what the part lies in wraps it; the rest is outside. Elements within the part that carry class
    words, and all they hold, are latent: whether such a part is an advert or a paragraph with a style is left to the model.
    """
    found = marked(nodes)
    if found is None:
        return None
    top, inside = found
    states = [OUTSIDE] * len(nodes)
    above = nodes[top].parent
    while above >= 0:
        states[above] = WRAPPER
        above = nodes[above].parent
    states[top] = MAIN
    for i in range(top + 1, len(nodes)):
        n = nodes[i]
        if inside[i]:
            states[i] = states[n.parent]
            if states[i] == MAIN:
                if n.tag in ELSEWHERE or n.tag == "article":
                    states[i] = OUTSIDE
                elif any(f.startswith("word=") for f in n.features):
                    states[i] = LATENT
    return states


@dataclass
class Model:
    """Log potentials: of the root's states, of a child's states given its parent's (by kind of root or child), and of a feature given a state."""

    root: dict[str, tuple[float, float, float]]
    step: dict[str, tuple[tuple[float, float, float], ...]]
    seen: dict[str, tuple[float, float, float]]


# Prior counts (outside, wrapper, main): a common, weak belief about names, equal for all of them, that some tens of labelled nodes overturn.
_BELIEF = 30.0
# Words that pages use for parts that are not, and that are, the main text.
UNLIKELY = "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget"
LIKELY = "article content entry main post story"
PRIOR = (
    {f"word={w}": (_BELIEF, 0.0, 0.0) for w in UNLIKELY.split()}
    | {f"word={w}": (0.0, 0.0, _BELIEF) for w in LIKELY.split()}
    | {f"tag={w}": (_BELIEF, 0.0, 0.0) for w in sorted(ELSEWHERE | {"reply"})}
    | {f"tag={w}": (0.0, 0.0, _BELIEF) for w in ("article", "main")}
    | {"links=0": (4.0, 0.0, 8.0), "links=1": (2.0, 0.0, 2.0), "links=2": (9.0, 0.0, 0.5)}
    | {"shape=0open": (4.0, 0.0, 1.0), "shape=1open": (3.0, 0.0, 1.5), "shape=2stop": (2.0, 0.0, 4.0), "shape=3stop": (1.0, 0.0, 4.0)}
)
# How far one feature may move the log odds between two states: a training set of similar pages would overstate it.
REACH = {"word": 4.0, "tag": 4.0, "links": 2.0, "shape": 1.0}
# Prior counts of a child's states below a parent that is outside, a wrapper, main; and the least chance of each in the model.
_NEVER = 1e-4
STEPS = {
    "body": ((100.0, 0.1, 0.1), (0.1, 8.0, 2.0), (0.1, 0.1, 9.8)),
    "holder": ((100.0, 0.1, 0.1), (0.5, 9.0, 0.5), (0.5, 9.0, 0.5)),
    "named": ((100.0, 0.1, 0.1), (4.0, 3.0, 3.0), (1.5, 0.05, 8.5)),
    "stray": ((100.0, 0.1, 0.1), (8.0, 1.0, 1.0), (0.05, 0.05, 99.9)),
    "plain": ((100.0, 0.1, 0.1), (3.0, 3.0, 3.0), (0.05, 0.05, 99.9)),
    "text": ((100.0, 0.0, 0.1), (3.0, 0.0, 2.0), (0.05, 0.0, 99.9)),
}
# Pages that mark their article rarely mark what does not belong to it within, nor name what would hold it on other pages.
LEAST = {("named", MAIN, OUTSIDE): 0.15, ("named", WRAPPER, WRAPPER): 0.05, ("plain", MAIN, OUTSIDE): 5 * _NEVER, ("text", MAIN, OUTSIDE): 5 * _NEVER}
ROOT = {"marked": (0.1, 8.0, 1.9), "bare": (0.1, 5.0, 4.9)}


def fit(counts: dict[tuple, float]) -> Model:
    """Potentials from counts, smoothed: transitions by prior counts, features by what they change against their group's share of states."""
    step = {}
    for kind, priors in STEPS.items():
        rows = []
        for above in STATES:
            n = [counts.get(("step", kind, above, s), 0.0) + priors[above][s] for s in STATES]
            p = [max(n[s] / sum(n), LEAST.get((kind, above, s), _NEVER)) for s in STATES]
            rows.append(tuple(math.log(x / sum(p)) for x in p))
        step[kind] = tuple(rows)
    seen = {}
    for f in sorted({*PRIOR, *(key[1] for key in counts if key[0] == "feature")}):
        group = f.split("=")[0]
        held = [counts.get(("group", group, s), 0.0) + 20.0 for s in STATES]
        share = [x / sum(held) for x in held]
        n = [counts.get(("feature", f, s), 0.0) + PRIOR.get(f, (0.0, 0.0, 0.0))[s] for s in STATES]
        odds = [math.log((n[s] + share[s]) / (sum(n) + 1.0) / share[s]) for s in STATES]
        seen[f] = tuple(max(x - max(odds), -REACH[group]) for x in odds)
    root = {}
    for kind, prior in ROOT.items():
        n = [counts.get(("root", kind, s), 0.0) + prior[s] for s in STATES]
        root[kind] = tuple(math.log(max(x / sum(n), _NEVER)) for x in n)
    return Model(root, step, seen)


def beliefs(nodes: list[Node], found: list[tuple[list[str], float]], model: Model, states: list[int] | None = None):
    """Per node, the probabilities of its states and, but for the root, of (parent's state, own state), by sum-product.

    One pass goes from the leaves up, one from the root down; ``states`` fixes the nodes whose state is known.
    """
    e, n = math.exp, len(nodes)
    own = []
    for i, (features, weight) in enumerate(found):
        sums = [0.0, 0.0, 0.0]
        for f in features:
            p = model.seen.get(f)
            if p:
                for s in STATES:
                    sums[s] += weight * p[s]
        top = max(sums)
        fixed = states[i] if states else LATENT
        own.append([e(x - top) if fixed in (LATENT, s) else 0.0 for s, x in enumerate(sums)])
    step = {k: [[e(x) for x in row] for row in rows] for k, rows in model.step.items()}
    first, *others = kinds(nodes)
    steps = [None, *(step[kind] for kind in others)]
    below, up = own, [None] * n
    for i in range(n - 1, 0, -1):
        b0, b1, b2 = below[i]
        up[i] = [r[0] * b0 + r[1] * b1 + r[2] * b2 for r in steps[i]]
        j = below[nodes[i].parent]
        x, y, z = j[0] * up[i][0], j[1] * up[i][1], j[2] * up[i][2]
        top = x + y + z
        j[0], j[1], j[2] = x / top, y / top, z / top
    roots = [e(r) * b for r, b in zip(model.root[first], below[0])]
    belief, pairs = [[x / sum(roots) for x in roots]], [None]
    for i in range(1, n):
        above, m, b = belief[nodes[i].parent], up[i], below[i]
        both = [[above[p] / m[p] * r * x for r, x in zip(steps[i][p], b)] for p in STATES]
        total = sum(map(sum, both))
        pairs.append([[x / total for x in row] for row in both])
        belief.append([(both[0][s] + both[1][s] + both[2][s]) / total for s in STATES])
    return belief, pairs


def tally(nodes: list[Node], states: list[int], counts: dict[tuple, float], model: Model | None = None) -> None:
    """Add a labelled page to the counts that ``fit`` uses; its latent nodes by what ``model`` expects of them, if given."""
    found = evidence(nodes, {i: clean(n) for i, n in enumerate(nodes) if not n.tag})
    hidden = LATENT in states
    belief, pairs = beliefs(nodes, found, model, states) if hidden and model else (None, None)

    def add(key: tuple, x: float):
        if x:
            counts[key] = counts.get(key, 0.0) + x

    add(("latent",), float(hidden))
    kind = kinds(nodes)
    add(("root", kind[0], states[0]), 1.0)
    for i, n in enumerate(nodes):
        if states[i] != LATENT:
            chances = [(states[i], 1.0)]
            steps = [(states[n.parent], states[i], 1.0)] if i else []
        elif model:
            chances = list(enumerate(belief[i]))
            steps = [(p, s, x) for p, row in enumerate(pairs[i]) for s, x in enumerate(row)]
        else:
            continue
        features, weight = found[i]
        for p, s, x in steps:
            add(("step", kind[i], p, s), x)
        for s, x in chances:
            for f in features:
                add(("feature", f, s), weight * x)
            for group in {f.split("=")[0] for f in features}:
                add(("group", group, s), weight * x)


def main_text(page: str, model: Model, threshold: float = 0.5) -> str:
    nodes = parse(page)
    texts = {i: clean(n) for i, n in enumerate(nodes) if not n.tag}
    belief, _ = beliefs(nodes, evidence(nodes, texts), model)
    return " ".join(t for i, t in texts.items() if t and belief[i][MAIN] >= threshold)


def learn(pages: DataFrame, sample: int = 2_000, rounds: int = 4) -> Model:
    """A model from at most about ``sample`` different pages, chosen by a hash of their contents, that label themselves.

    Copies of a page count once. The first counts come from nodes whose state the page's structure fixes; then up to ``rounds`` rounds of
    expectation maximisation add what the model expects of the latent ones, if there are any. Pages are labelled in tasks and only
    counts per task leave them. Without labelled pages the priors alone remain; null and empty html teach nothing.
    """
    ship_package(pages.sparkSession)
    texts = pages.where("html is not null").select(F.col("html").cast("string").alias("html"))
    n = max(texts.agg(F.count_distinct(F.xxhash64("html"))).first()[0], 1)
    digest = F.xxhash64("html")
    share = F.pmod(digest, F.lit(1 << 30)) / float(1 << 30)
    drawn = texts.where(share < float(sample) / n).withColumn("digest", digest).dropDuplicates(["digest"])
    drawn = Scratch(pages.sparkSession).cut(drawn.select("html"), "labelled-pages")

    def counted(model: Model | None) -> dict[tuple, float]:
        def run(batches):
            counts: dict[tuple, float] = {}
            for batch in batches:
                for page in batch.column("html"):
                    nodes = parse(page.as_py())
                    states = label(nodes)
                    if states:
                        tally(nodes, states, counts, model)
            rows = sorted((repr(k), v) for k, v in counts.items())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.float64())], ["key", "n"])

        sums = drawn.mapInArrow(run, "key string, n double").groupBy("key").agg(F.sum("n").alias("n"))
        # words occur in many spellings in a large sample; those seen once say nothing
        return {ast.literal_eval(r["key"]): round(r["n"], 6) for r in sums.where("n > 1 or key not like '%word=%'").orderBy("key").collect()}

    counts = counted(None)
    model = fit(counts)
    for _ in range(rounds if counts.get(("latent",)) else 0):
        model = fit(counted(model))
    return model


def extract(pages: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Per page: page_id, url, text.

    Text blocks whose probability of being content reaches ``threshold`` are joined in page order. Null or empty html
    gives empty text; broken and cut-off markup is mended; pages are parsed whole, however long. Repeated rows are extracted alike;
    empty tables and further columns are fine.
    """
    ship_package(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), model, threshold) if p.is_valid else "" for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")

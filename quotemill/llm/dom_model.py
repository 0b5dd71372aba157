"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements; each is content or not. A node potential says how well its features (words of
class and id, share of linked text, length, end of sentence) go with either state; a parent-child potential says how
the state passes down to a child of that tag. Both are learned from labelled pages by counting. Sum-product messages go from the leaves up and from the
root down, so the marginal of a node has seen the whole page; text of nodes with a content marginal above
one half is the main text.

Labelled pages are a few written by hand (``LABELLED``) and a bounded sample of the corpus, labelled by its own markup:
inside ``article`` or ``main`` and outside the elements that HTML itself sets apart. Pages without such markup teach
nothing but are read like all others.

Defined cases: null and empty html, and pages without content, give an empty text; broken markup is read as browsers
do (unclosed elements end with their parent, an unfinished tag at the end is no text); repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from .tasks import map_rows

SAMPLE_PAGES = 2_000
HAND_WEIGHT = 20
SMOOTHING = 0.5
BACKING = 4.0
NAMES_BOUND, LOOKS_BOUND, ALIKE = 5.0, 1.5, 4.0

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe"
    # a closed <svg .../> is an empty element and ends nowhere else; on the others browsers ignore the slash
    r"|svg(?!\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>))\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MARK = re.compile(r"data-main=\"([01])\"")
WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var".split()
)
# an element of the key ends open elements of the values that lie above it
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
KEEPS_P = frozenset("html head body option button".split())
ASIDE_TAGS = frozenset("nav header footer aside form menu button select dialog".split())
MAIN_TAGS = frozenset(("article", "main"))
ASIDE_WORDS = frozenset("ad ads advert comment comments cookie notice promo share sidebar sponsor subscribe".split())


@dataclass
class Node:
    tag: str
    words: tuple[str, ...]
    parent: int
    chars: int = 0
    linked: int = 0
    last: str = ""
    marked: bool | None = None
    below: list[int] = field(default_factory=list)


def read_page(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order, parents first, and the blocks of text with the element that holds each."""
    nodes = [Node("html", (), -1)]
    blocks: list[tuple[int, str]] = []
    open_: list[tuple[str, int]] = [("html", 0)]  # tag, node it writes to
    run: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(run)).split())
        run.clear()
        if text:
            at = open_[-1][1]
            blocks.append((at, text))
            node = nodes[at]
            node.chars += len(text)
            node.linked += min(linked, len(text))
            node.last = text[-1]
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        if any(tag not in INLINE for tag, _ in open_[depth:]):
            flush()
        links -= sum(tag == "a" for tag, _ in open_[depth:])
        del open_[depth:]

    def text_run(text: str) -> None:
        nonlocal linked
        run.append(text)
        if links:
            linked += len(text)

    at = 0
    for match in MARKUP.finditer(page):
        if match.start() > at:
            text_run(page[at : match.start()])
        at = match.end()
        tag = (match[3] or "").lower()
        if not tag:
            if match[1] is not None:
                run.append(" ")
            continue
        if match[2]:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth][0] == tag:
                    close(depth)
                    break
        elif tag in VOID or tag == "svg":
            if tag == "hr":
                flush()
            run.append(" ")
        elif tag in INLINE:
            links += tag == "a"
            open_.append((tag, open_[-1][1]))
        elif tag == "html":
            nodes[0].marked = MARK.search(match[4]) is not None or None
        else:
            flush()
            ends = ENDS.get(tag, set()) | (set() if tag in KEEPS_P else {"p"})
            for depth in range(len(open_) - 1, 0, -1):
                name = open_[depth][0]
                if name in ends:
                    close(depth)
                elif name not in INLINE:
                    break
            names = " ".join(next(filter(None, m.groups()), "") for m in NAMED.finditer(match[4])).lower()
            parent = open_[-1][1]
            nodes[parent].below.append(len(nodes))
            nodes.append(Node(tag, tuple(sorted(set(WORD.findall(names)))), parent))
            marked = MARK.search(match[4])
            nodes[-1].marked = marked[1] == "1" if marked else None
            open_.append((tag, len(nodes) - 1))
    if at < len(page):
        text_run(page[at:])
    flush()
    return nodes, blocks


def features(node: Node) -> list[str]:
    out = [f"word {w}" for w in node.words]
    if node.chars:
        out.append(f"length {min(int(math.log2(node.chars)), 10) // 2}")
        out.append(f"linked {round(3 * node.linked / node.chars)}")
        out.append("ends" if node.last in ".!?\"”»…" else "runs on")
    else:
        out.append("no text")
    return out


def own_labels(nodes: list[Node]) -> list[bool] | None:
    """Labels by the page's own markup, or nothing if it names no main part."""
    if not any(n.tag in MAIN_TAGS for n in nodes):
        return None
    state: list[str] = []
    for node in nodes:
        above = state[node.parent] if node.parent >= 0 else "out"
        if node.tag in ASIDE_TAGS or ASIDE_WORDS & set(node.words):
            above = "aside"
        elif node.tag in MAIN_TAGS and above != "aside":
            above = "main"
        state.append(above)
    return [s == "main" for s in state]


def hand_labels(nodes: list[Node]) -> list[bool]:
    """Labels from ``data-main`` marks, passed down."""
    out: list[bool] = []
    for node in nodes:
        out.append(node.marked if node.marked is not None else node.parent >= 0 and out[node.parent])
    return out


# Pages labelled by hand: data-main says whether an element and what it holds is main text, until a mark below differs.
LABELLED = (
    '<body><header class="site-header"><h1>Harbour Post</h1><ul class="menu"><li><a href="/">Home</a></li><li><a '
    'href="/a">Tides</a></li></ul></header><div class="cookie notice"><p>We use cookies.</p><button>OK</button></div>'
    '<div id="content" class="post entry" data-main="1"><h2>The ferry is late again</h2><p>Nobody on the quay was '
    "surprised when the noon ferry came in at two, with its lights on and its deck empty.</p><p>The captain blamed "
    'fog, which was <a href="/fog">seen</a> by no one else that day.</p><blockquote>It was thick, he said.</blockquote>'
    '<div class="share promo" data-main="0"><a href="#">Share</a></div></div><aside class="sidebar"><h3>Most read</h3>'
    '<ul><li><a href="/1">Gull steals hat</a></li></ul></aside><section class="comments"><h3>Comments</h3><div '
    'class="comment"><p>I was there and saw no fog at all, to be honest with you.</p></div></section><footer><p>'
    "&copy; Harbour Post</p></footer></body>",
    '<body><nav class="top"><a href="/">Start</a><a href="/r">Recipes</a></nav><main data-main="1"><h1>Barley soup</h1>'
    "<p>Soak the barley for a night, then cook it slowly with onions until it gives way.</p><ul><li>two cups of barley"
    "</li><li>one onion, cut small</li></ul><section><h2>Serving</h2><p>Serve it hot, with bread and a little oil.</p>"
    '<h3>Leftovers</h3><p>They keep for days.</p></section><div><p>Freeze what is left.</p></div><table><tr><td>Time</td><td>two hours</td></tr></table><div class="ad banner" data-main="0"><p>Buy our pans, '
    'the best pans in town.</p></div><form class="newsletter" data-main="0"><p>Get our letter every week.</p><input '
    'name="m"><button>Send</button></form></main><div id="comments" class="replies"><p>Mine burned, sadly.</p><p>'
    'Thank you for this one.</p></div><div class="footer"><p>About us. Imprint.</p></div></body>',
    '<body><div class="wrapper"><div class="navigation"><ul><li><a href="/x">X</a></li><li><a href="/y">Y</a></li></ul>'
    '</div><div class="article body text" data-main="1"><h1>On keeping bees</h1><p>Bees ask for little: a dry box, '
    "flowers within a mile, and a keeper who does not hurry.</p><p>In spring the colony doubles within weeks.</p><pre>"
    'hive = box + bees</pre></div><div class="related sidebar"><h4>Related</h4><p><a href="/w">Wasps, an apology</a>'
    '</p></div><div class="alert notice"><p>This site moves house in May.</p></div><div class="sponsor advert"><p>Honey '
    'jars, cheap.</p></div></div></body>',
    '<html data-main="1"><p>A note without any frame, left on the kitchen table.</p><p>Back at six.</p></html>',
    '<html data-main="1">Gone fishing until Monday, the key is where it always is.</html>',
    '<body data-main="1"><h1>Letter from the coast</h1><p>Dear all, the storm has passed and the boats are whole.</p><p>We '
    'mend nets and wait for herring.</p><p>Yours, M.</p></body>',
    '<body><div class="head" data-main="0"><ul><li><a href="/">Home</a></li><li><a href="/c">Contact</a></li></ul></div>'
    '<div data-main="1"><h1>Minutes of the meeting</h1><div><p>All members came, which has not happened since spring.'
    '</p><p>The roof was discussed.</p><ul><li>two votes for tin</li><li>five votes for slate</li></ul></div></div>'
    '<div class="bottom"><p>Printed on our own press.</p></div></body>',
    '<body><article data-main="1"><header data-main="0"><p>By A. Writer, 3 min</p></header><h1>A short note</h1><p>It '
    'rained.</p><p>Then it stopped, and the street smelled of dust.</p><figure><figcaption>The street.</figcaption>'
    '</figure><aside data-main="0"><p>Read also: a long note on snow, in four parts.</p></aside><footer data-main="0"><p>Filed under weather</p></footer><section class="comments" data-main="0"><h2>3 '
    "comments</h2><p>Nice note, thanks.</p></section></article><div class=\"ad\">A word from our sponsor.</div><footer>"
    "&copy; notes &middot; all rights reserved.</footer></body>",
)


def count_page(nodes: list[Node], labels: list[bool], counts: Counter) -> None:
    for node, label in zip(nodes, labels, strict=True):
        above = int(labels[node.parent]) if node.parent >= 0 else 0
        counts[f"pass {above}|{int(label)}"] += 1
        counts[f"pass {above} {node.tag}|{int(label)}"] += 1
        counts[f"state|{int(label)}"] += 1
        for name in features(node):
            counts[f"{name}|{int(label)}"] += 1


class TreeModel:
    """Potentials from counts of labelled nodes, and inference on a page."""

    def __init__(self, counts: dict[str, float]):
        names = {key.rpartition("|")[0] for key in counts}
        of = {name: [counts.get(f"{name}|{s}", 0) for s in (0, 1)] for name in names | {"state", "pass 0", "pass 1"}}
        total = [n + 1 for n in of["state"]]
        self.odds = {
            name: math.log((one + SMOOTHING) / total[1] * total[0] / (zero + SMOOTHING))
            for name, (zero, one) in of.items()
            if not name.startswith(("pass ", "state"))
        }
        # how the state passes from a parent in state 0 or 1, in general and, drawn towards that, for each tag
        self.general = [[(n + SMOOTHING) / (sum(of[f"pass {p}"]) + 2 * SMOOTHING) for n in of[f"pass {p}"]] for p in (0, 1)]
        self.down: dict[str, list[list[float]]] = {}
        for tag in {name.split()[2] for name in names if name.startswith("pass ") and name.count(" ") == 2}:
            rows = []
            for p in (0, 1):
                own = of.get(f"pass {p} {tag}", [0, 0])
                rows.append([(n + BACKING * g) / (sum(own) + BACKING) for n, g in zip(own, self.general[p], strict=True)])
            self.down[tag] = rows

    def node_odds(self, node: Node, siblings: int) -> float:
        """Names are strong evidence, looks are weak and go together: both are bounded. A name
        that tells of boilerplate outweighs others. Siblings look alike: many weigh no more than ``ALIKE`` of them."""
        looks, best, worst = 0.0, 0.0, 0.0
        for feature in features(node):
            odds = self.odds.get(feature, 0.0)
            if feature.startswith("word "):
                best, worst = max(best, odds), min(worst, odds)
            else:
                looks += odds
        names = max(-NAMES_BOUND, worst) if worst < 0 else min(NAMES_BOUND, best)
        looks = max(-LOOKS_BOUND, min(LOOKS_BOUND, looks)) * min(1.0, ALIKE / max(siblings, 1))
        return math.exp(names + looks)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content per node; parents come before children in ``nodes``."""
        odds = [self.node_odds(n, len(nodes[n.parent].below) if n.parent >= 0 else 1) for n in nodes]
        down = [self.down.get(n.tag, self.general) for n in nodes]
        gathered = [[1 / (1 + o), o / (1 + o)] for o in odds]
        up = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            (d00, d01), (d10, d11) = down[i]
            b0, b1 = gathered[i]
            up[i] = _normal(d00 * b0 + d01 * b1, d10 * b0 + d11 * b1)
            above = gathered[nodes[i].parent]
            above[:] = _normal(above[0] * up[i][0], above[1] * up[i][1])
        belief = [(0.0, 0.0)] * len(nodes)
        for i, node in enumerate(nodes):
            (d00, d01), (d10, d11) = down[i]
            g0, g1 = gathered[i]
            # what the parent knows without this child; the page itself has no parent, which counts as state 0
            q0, q1 = (1.0, 0.0) if node.parent < 0 else (p / u for p, u in zip(belief[node.parent], up[i], strict=True))
            belief[i] = _normal(g0 * (q0 * d00 + q1 * d10), g1 * (q0 * d01 + q1 * d11))
        return [one for _, one in belief]


def _normal(zero: float, one: float) -> tuple[float, float]:
    """Both as shares, kept off 0 so that long products stay divisible."""
    total = zero + one
    return max(zero / total, 1e-100), max(one / total, 1e-100)


def main_text(page: str | None, model: TreeModel) -> str:
    if not page:
        return ""
    nodes, blocks = read_page(page)
    content = model.marginals(nodes)
    return "\n\n".join(text for at, text in blocks if content[at] > 0.5)


def hand_counts() -> Counter:
    counts: Counter = Counter()
    for page in LABELLED:
        nodes, _ = read_page(page)
        count_page(nodes, hand_labels(nodes), counts)
    return counts


def weigh(hand: dict[str, int], corpus: dict[str, int]) -> Counter:
    """The few hand-labelled pages speak about elements that the corpus may lack: both count the same in total."""

    def nodes(counts: dict[str, int]) -> int:
        return sum(n for name, n in counts.items() if name.startswith("state|"))

    counts = Counter({name: n * HAND_WEIGHT for name, n in hand.items()})
    share = HAND_WEIGHT * nodes(hand) / max(nodes(corpus), 1)
    counts.update({name: n * share for name, n in corpus.items()})
    return counts


def learn_model(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> TreeModel:
    """Count labelled nodes of the hand-written pages and of at most ``sample_pages`` pages, picked by a hash."""
    sample = pages.select("page_id").where("page_id is not null").distinct()
    sample = sample.orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    chosen = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).join(F.broadcast(sample), "page_id")

    def make():
        def work(columns):
            counts: Counter = Counter()
            for page in columns["html"]:
                nodes, _ = read_page(page)
                if labels := own_labels(nodes):
                    count_page(nodes, labels, counts)
            return {"name": list(counts), "n": list(counts.values())}

        return work

    counted = map_rows(chosen.select("html"), "name string, n long", make).groupBy("name").agg(F.sum("n").alias("n"))
    # names of class and id words in a bounded sample; words seen once or twice say nothing
    learned = {row["name"]: row["n"] for row in counted.where("n > 2").collect()}
    return TreeModel(weigh(hand_counts(), learned))


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def make():
        def work(columns):
            found = [main_text(page, model) for page in columns["html"]]
            return {
                "page_id": columns["page_id"], "url": columns["url"], "text": found, "n_chars": [len(t) for t in found],
            }

        return work

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_rows(rows, "page_id long, url string, text string, n_chars long", make)

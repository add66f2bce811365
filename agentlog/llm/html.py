"""Main text of web pages by wrapper induction.

Pages of one host share a template. Every page's tree is aligned with one page of its host by
simple tree matching; places that hold the same text on nearly all pages are template,
places that vary, few pages have or an article element holds are content. Regions that are never article (menus, notices, forms) are
left out by their tags and names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from agentlog.llm.common import fresh, store
from agentlog.llm.urls import host_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp".split())
FOREIGN = frozenset({"svg", "math"})
BLOCKS = frozenset(
    "html body div section article main header footer aside nav p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary "
    "form fieldset hr center".split()
)
#: Deeper elements become siblings, as in browsers; nothing is lost.
MAX_DEPTH = 400
#: A start tag ends open elements of these kinds, up to the barrier.
ENDS_P = BLOCKS - {"html", "body"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ARTICLE = frozenset({"article", "main"})
NOISE_TAGS = frozenset(
    "script style noscript template iframe svg math canvas object embed audio video nav footer aside form "
    "button select option input textarea menu dialog head title".split()
)
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav "
    "navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice gdpr "
    "popup modal overlay newsletter subscribe signup social share sharing comment comments respond disqus "
    "related recommended widget pagination pager toolbar login search copyright alert complementary "
    "contentinfo".split()
)


class Node:
    """An element, or a text leaf (tag `#text`)."""

    __slots__ = ("attrs", "children", "leaves", "shape", "size", "tag", "text")

    def __init__(self, tag: str, attrs: str = "", text: str = "") -> None:
        self.tag, self.attrs, self.text = tag, attrs, text
        self.children: list[Node] = []


def parse(html: str) -> Node:
    """The tree of a page. Unclosed and stray tags are repaired like browsers do for the
    common cases; contents of scripts and the like are left out."""
    root = Node("html")
    stack = [root]
    at = 0

    def text_to(end: int) -> None:
        if end > at:
            piece = html[at:end]
            if not piece.isspace():
                stack[-1].children.append(Node("#text", text=unescape(piece)))
            elif stack[-1].children and stack[-1].children[-1].tag not in BLOCKS:
                stack[-1].children.append(Node("#text", text=" "))

    while True:
        m = TOKEN.search(html, at)
        if m is None:
            text_to(len(html))
            break
        text_to(m.start())
        at = m.end()
        if m["start"]:
            tag = m["start"].lower()
            if tag in ("html", "body") and (tag == "html" or any(n.tag == "body" for n in stack)):
                continue
            _close_before(stack, tag)
            node = Node(tag, m["attrs"])
            stack[-1].children.append(node)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            elif tag not in VOID and not m["attrs"].endswith("/") and len(stack) < MAX_DEPTH:
                stack.append(node)
        elif m["end"]:
            tag = m["end"].lower()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
    return root


def _close_before(stack: list[Node], tag: str) -> None:
    if tag in BLOCKS:  # a block ends an open drawing or formula, as in browsers
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "foreignobject":
                break
            if stack[depth].tag in FOREIGN:
                del stack[depth:]
                break
    kinds, barrier = SIBLINGS.get(tag, ((), ()))
    if tag in ENDS_P:
        kinds, barrier = {"p", *kinds}, {*barrier, "button", "td", "th", "li"} - {*kinds}
    if not kinds:
        return
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in kinds:
            del stack[depth:]
            return
        if stack[depth].tag in barrier or (stack[depth].tag in BLOCKS and stack[depth].tag not in kinds):
            return


# simple tree matching

class Matcher:
    """Simple tree matching: the largest order-preserving match of two trees with equal tags.

    Its weight depends on shapes only, so shapes are numbered and weights remembered.
    """

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.weights: dict[tuple[int, int], int] = {}

    def measure(self, node: Node) -> None:
        """Number the shapes of a tree bottom up (without recursion: trees may be deep)."""
        if len(self.numbers) > 1_000_000:  # numbers of old trees are not compared any more
            raise OverflowError
        order, todo = [], [node]
        while todo:
            n = todo.pop()
            order.append(n)
            todo.extend(n.children)
        for n in reversed(order):
            n.size = 1 + sum(c.size for c in n.children)
            key = (n.tag, *(c.shape for c in n.children))
            n.shape = self.numbers.setdefault(key, len(self.numbers))

    def weight(self, a: Node, b: Node) -> int:
        if a.tag != b.tag:
            return 0
        if a.shape == b.shape:
            return a.size
        known = self.weights.get((a.shape, b.shape))
        if known is None:
            if len(self.weights) > 1_000_000:
                self.weights.clear()
            known = 1 + sum(self.weight(x, y) for x, y in self.pairs(a, b))
            self.weights[a.shape, b.shape] = known
        return known

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The matched children of two matched nodes. Equal shapes at both ends match each
        other in some best match, so only the middle needs the dynamic programme."""
        xs, ys = a.children, b.children
        head = 0
        while head < len(xs) and head < len(ys) and xs[head].shape == ys[head].shape:
            head += 1
        tail = 0
        while tail < len(xs) - head and tail < len(ys) - head and xs[-1 - tail].shape == ys[-1 - tail].shape:
            tail += 1
        out = list(zip(xs[:head], ys[:head]))
        mx, my = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if mx and my:
            best = [[0] * (len(my) + 1) for _ in range(len(mx) + 1)]
            for i, x in enumerate(mx):
                row, above = best[i + 1], best[i]
                for j, y in enumerate(my):
                    w = self.weight(x, y)
                    row[j + 1] = max(above[j + 1], row[j], above[j] + w if w else 0)
            i, j, middle = len(mx), len(my), []
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    middle.append((mx[i - 1], my[j - 1]))
                    i, j = i - 1, j - 1
            out += reversed(middle)
        return out + list(zip(xs[len(xs) - tail :], ys[len(ys) - tail :]))

    def matched_leaves(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Matched text leaves of two trees."""
        out, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            if x.tag == "#text":
                out.append((x, y))
            else:
                todo.extend(self.pairs(x, y))
        return out


def leaves_of(tree: Node) -> list[Node]:
    """Text leaves in page order."""
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        if n.tag == "#text":
            out.append(n)
        todo.extend(reversed(n.children))
    return out


# text

@lru_cache(maxsize=50_000)
def noisy_attributes(attrs: str) -> bool:
    """Whether class, id or role name a region that is no article, or it is hidden."""
    if not attrs.strip():
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role") and any(
            part.lower() in NOISE_NAMES for part in NAME_PARTS.findall(value)
        ):
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attrs))


def main_text(page: Node, template: set[int]) -> str:
    """Blocks of the article, joined by blank lines. `template` holds the ids (`id()`) of
    text leaves that the wrapper found constant; inside an article element they count as
    content all the same."""
    holds: dict[int, bool] = {}  # whether an element holds an article or a main heading
    order, todo = [], [page]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(n.children)
    for n in reversed(order):
        holds[id(n)] = n.tag in ARTICLE or n.tag == "h1" or any(holds[id(c)] for c in n.children)
    has_article = any(n.tag in ARTICLE for n in order)
    blocks: list[str] = []
    run: list[str] = []
    constant: list[str] = []
    marked: list[bool] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
            marked.append(bool(constant) and not "".join(x for x in run if x not in constant).strip())
        run.clear()
        constant.clear()

    stack: list[tuple[Node, bool, bool]] = [(page, not has_article, False)]
    while stack:
        n, inside, leaving = stack.pop()
        if leaving:
            flush()
            continue
        if n.tag == "#text":
            if inside:
                run.append(n.text)
                if not has_article and id(n) in template:
                    constant.append(n.text)
            continue
        if n.tag in NOISE_TAGS or (n.tag == "header" and not (inside and has_article)):
            flush()
            continue
        if n.tag not in ("html", "body") and n.tag not in ARTICLE and not holds[id(n)] and noisy_attributes(n.attrs):
            flush()
            continue
        if not has_article and n.tag in ("ul", "ol", "div", "table") and _mostly_links(n):
            flush()
            continue
        inside = inside or n.tag in ARTICLE
        if n.tag == "br":
            run.append(" ")
        elif n.tag in BLOCKS:
            flush()
            stack.append((n, inside, True))
        stack.extend((c, inside, False) for c in reversed(n.children))
    flush()
    return "\n\n".join(b for b, m in zip(blocks, marked) if not m)


def _mostly_links(node: Node) -> bool:
    """A region of at least three links that hold most of its text."""
    links = total = linked = 0
    todo = [(node, False)]
    while todo:
        n, inside = todo.pop()
        if n.tag == "#text":
            size = len(n.text.strip())
            total += size
            linked += size if inside else 0
        if n.tag == "a":
            links, inside = links + 1, True
        todo.extend((c, inside) for c in n.children)
    return links >= 3 and linked > 0.6 * total


class Wrappers:
    """Parsed reference pages of the hosts a task meets, and the shared matcher."""

    def __init__(self) -> None:
        self.matcher, self.trees, self.articles = Matcher(), {}, {}

    def article(self, host: str) -> str:
        """The main text of the aligned reference page, template included."""
        if host not in self.articles:
            self.articles[host] = main_text(self.trees[host], set())
        return self.articles[host]

    def align(self, host: str, reference: str, html: str) -> tuple[Node, list[tuple[int, Node, bool]]]:
        """The page's tree, and for every matched text leaf: its number in the reference,
        the page's leaf, and whether both texts are equal."""
        for _ in range(2):
            try:
                tree = self.trees.get(host)
                if tree is None:
                    if len(self.trees) >= 256:
                        self.trees.clear()
                        self.articles.clear()
                    tree = self.trees[host] = parse(reference)
                    self.matcher.measure(tree)
                    for no, leaf in enumerate(leaves_of(tree)):
                        leaf.leaves = no
                page = parse(html)
                self.matcher.measure(page)
                break
            except OverflowError:
                self.__init__()
        pairs = self.matcher.matched_leaves(tree, page)
        return page, [(r.leaves, p, " ".join(r.text.split()) == " ".join(p.text.split())) for r, p in pairs]


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_pages: int = 3, min_equal: float = 0.8, min_share: float = 0.5,
) -> DataFrame:
    """All rows and columns of `pages` with text, the main text of the whole html.

    Null and empty html give an empty text; pages without a host are one group. A place of
    the host's reference page (its smallest id) is template when at least `min_pages` other
    pages and `min_share` of those that vote have it, and `min_equal` of these hold the same
    text. Pages of one main text have one vote, those of the reference's text none. Repeated
    rows get equal texts; an empty table gives an empty result; a column named text is
    replaced.

    Copies are reduced to one vote in the tasks first, then votes are counted in the tasks
    and summed; the reference page is the only html that travels with the rows.
    """
    pages = pages.drop("text")
    host = fresh(pages, "__host")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    hosted = pages.withColumn(host, host_of(F.col(url_col)))
    references = store(
        hosted.filter(html != "").groupBy(host).agg(
            F.min_by(html, F.struct(F.col(id_col).isNull(), id_col, html)).alias("__reference")
        ),
        "references",
    )
    votes_type = T.StructType(
        [
            T.StructField("host", T.StringType()), T.StructField("article", T.BinaryType()),
            T.StructField("leaves", T.ArrayType(T.IntegerType())),
        ]
    )

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each page's host, hash of its main text, and the reference's leaves it has: twice
        the number, and one more where the text is equal."""
        wrappers = Wrappers()
        for batch in batches:
            rows = []
            for name, reference, page in zip(*(c.to_pylist() for c in batch.columns)):
                tree, leaves = wrappers.align(name, reference, page)
                article = main_text(tree, set())
                if article != wrappers.article(name):
                    digest = hashlib.md5(article.encode("utf-8", "surrogatepass")).digest()
                    rows.append((name, digest, [2 * leaf + equal for leaf, _, equal in leaves]))
            types = (pa.string(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=votes_type.names
            )

    others = hosted.join(references, host).filter(html != F.col("__reference"))
    voters = store(
        others.select(host, "__reference", html.alias("html")).mapInArrow(vote, votes_type)
        .groupBy("host", "article").agg(F.min("leaves").alias("leaves")),
        "voters",
    )
    votes = voters.select("host", F.explode("leaves").alias("leaf")).groupBy(
        "host", F.shiftright("leaf", 1).alias("leaf")
    ).agg(F.count(F.lit(1)).alias("matched"), F.sum(F.col("leaf").bitwiseAND(1)).alias("equal"))
    template = (
        votes.join(voters.groupBy("host").agg(F.count(F.lit(1)).alias("voters")), "host")
        .filter(
            (F.col("matched") >= min_pages) & (F.col("matched") >= min_share * F.col("voters"))
            & (F.col("equal") >= min_equal * F.col("matched"))
        )
        .groupBy(F.col("host").alias(host)).agg(F.collect_list("leaf").alias("__template"))
    )
    wrappers = store(references.join(template, host, "left"), "wrappers")

    @F.arrow_udf(T.StringType())
    def text_of(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = Wrappers()
        for batch in columns:
            out = []
            for name, reference, template, page in zip(*(c.to_pylist() for c in batch)):
                if not page:
                    out.append("")
                    continue
                tree, leaves = known.align(name, reference, page)
                fixed = set(template or ())
                out.append(main_text(tree, {id(p) for leaf, p, equal in leaves if equal and leaf in fixed}))
            yield pa.array(out, pa.string())

    text = text_of(F.col(host), F.col("__reference"), F.col("__template"), html)
    return hosted.join(wrappers, host, "left").withColumn("text", text).drop(
        host, "__reference", "__template"
    )

"""Main text of web pages by wrapper induction.

Pages become trees of block elements; menus, scripts, forms and their like, known by
tag, role or class, are left out, unless a name or a form holds most of the page's text. The trees of a host's pages are aligned with those
of a reference page of the host, and of one of their layout, by simple tree matching.
Slots whose text hardly ever varies over those pages are template, all others are
content: slots that vary and slots the references don't have. Pages that say hardly anything
beyond the reference's text are copies of its article, and don't vote; pages of one
content have one vote. A host of few pages has no template.

Menus, adverts and footers may say something else on every page. So pages without article
or main elements also vote on the container that holds their text: where nearly all pages
of a host agree on the way down to it, what lies outside is no article, but for a first heading.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from understory.llm.common import small_side
from understory.session import pin

#: Votes that a slot needs, and the share of them that find the reference's text there, to be template.
VOTES, CONSTANT = 5, 0.9
#: Share of a page's letters that the container of its text holds.
HOLDS = 0.6
#: Letters that a page has to say beyond the reference's text to vote: a sentence. With fewer it is a copy.
OWN_LETTERS = 40
#: The reference is the host's page whose size is nearest to this, in bytes.
REFERENCE_BYTES = 4096
#: Elements below this depth are taken for children of the one at this depth; their text stays.
DEPTH = 200
#: Pairs of children up to which all matchings are weighed; a pair that needs a matching of its own counts as so many.
CELLS, DEEP = 1 << 20, 64
#: What a slot with equal text weighs, in nodes.
EQUAL = 1 << 32

# Elements of HTML by what they are.
SKIPPED = "script style noscript template textarea title iframe select noembed xmp"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo mrow ms mtext msub msup msubsup mfrac msqrt mroot mstyle semantics annotation svg g path text tspan desc video audio object canvas picture".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("meta link base".split())
OTHER = frozenset("nav header footer aside form button menu dialog head fieldset input".split())
# Shares of the text: a part that holds more is no notice, whatever a name with a mark in it ('has-sidebar') or a tag of
# WRAPS says; or a name that is a mark ('sidebar'). Other tags and roles count at any size.
MOST, NEARLY_ALL, ALWAYS = 0.5, 0.9, float("inf")
#: Of these elements, those that a page or an article may be wrapped in.
WRAPS = frozenset(["header", "form", "fieldset"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words of class names and identifiers that mark what is no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices "
    "popup modal newsletter subscribe sidebar aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations pagination pager toolbar login signup search".split()
)
#: Of these, an article may have its own.
OWN = frozenset(["header", "masthead"])
MAIN = frozenset(["article", "main"])
#: Of elements in an article, those that a name can mark: containers, no blocks of text.
HOLDERS = frozenset("body div section table tbody tr td center main article".split())
PARTS = frozenset("div section aside ul ol dl nav form footer header figure table details iframe".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_attributes = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    + rf"|<(?:{'|'.join(f'{t}(?=[\\s/>]){_attributes}>.*?(?:</{t}\\s*>|\\Z)' for t in SKIPPED.split())})"
    + rf"|<(/?)([a-zA-Z][^\s/>]*)({_attributes})>",
    re.S | re.I,
)
_named = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_apart = re.compile(r"[^a-z0-9]+")


@dataclass(slots=True)
class Node:
    """A block element, or a slot of text (no children; the label ends with ``#``)."""

    label: str
    tag: str
    children: list = field(default_factory=list)
    text: str = ""
    limit: float | None = None
    letters: int = 0
    number: int = -1
    nodes: int = 0
    key: int | None = None
    slot: Node | None = None
    chain: tuple = ()


def _mark(tag: str, attributes: str, inside: bool) -> tuple[str, float | None]:
    """Label of an element and, if its tag, role or names say that it is no article, the share of the text beyond which they don't count."""
    said = {}
    if attributes and "=" in attributes:
        for m in _named.finditer(attributes):
            said[m[1].lower()] = (m[2] or m[3] or m[4] or "").lower()
    limits = [MOST if tag in WRAPS else ALWAYS] if tag in OTHER and not (inside and tag in OWN) else []
    if said and tag not in MAIN and tag not in ("html", "body"):
        marks = MARKS - OWN if inside else MARKS
        names = f"{said.get('class', '')} {said.get('id', '')}"
        if said.get("role") in ROLES:
            limits.append(MOST if said["role"] in WRAPS else ALWAYS)
        # In an article a container's whole name is a mark ('comments'), not a word of it ('comments-on-the-law').
        if marks.intersection(names.split()) and (not inside or tag in PARTS):
            limits.append(NEARLY_ALL)
        elif not inside and marks.intersection(_apart.split(names)):
            limits.append(MOST)
    return f"{tag}.{said.get('class', '')}", max(limits, default=None)


def parse(page: str) -> Node:
    """The tree of a page. Inline elements are part of the text around them."""
    root = Node("", "")
    stack, parts, at = [root], [], 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            top = stack[-1]
            top.children.append(Node(f"{top.label}#", "#", text=text))

    for m in _token.finditer(page):
        parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                parts.append(" " if tag != "wbr" else "")
            continue
        if m[1]:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        flush()
        if stack[-1].tag == "head" and tag not in HEAD:
            stack.pop()
        if stack[-1].tag == "p":
            stack.pop()
        closes = CLOSES.get(tag)
        if closes and stack[-1].tag in closes:
            stack.pop()
            if tag == "tr" and stack[-1].tag == "tr":
                stack.pop()
        inside = any(n.tag in MAIN for n in stack)
        label, limit = _mark(tag, m[3], inside)
        node = Node(label, tag, limit=limit)
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    parts.append(page[at:])
    flush()
    return root


def content(page: str | None) -> Node:
    """The tree of what may be article, without marked parts.

    Names, forms and headers around most of the text of the page, or of the article or
    main element they are in, are layout and stay. Where article or main elements hold
    most of what is left, all else goes.
    """

    def holds(node: Node) -> bool:
        found = [holds(c) for c in node.children]
        node.number = 1 if any(found) else 0
        node.letters = len(node.text) + sum(c.letters for c in node.children if c.limit != ALWAYS or c.number)
        return node.tag in MAIN or node.number == 1

    def prune(node: Node, whole: int) -> Node:
        # A marked element around an article is a layout's name, not a notice.
        stays = [c for c in node.children if c.limit is None or c.number == 1 or c.letters > c.limit * whole]
        node.children = [prune(c, c.letters if c.tag in MAIN else whole) for c in stays]
        node.letters = len(node.text) + sum(c.letters for c in node.children)
        return node

    def mains(node: Node) -> Iterator[Node]:
        for c in node.children:
            if c.tag in MAIN:
                yield c
            else:
                yield from mains(c)

    root = parse(page or "")
    holds(root)
    prune(root, root.letters)
    found = list(mains(root))
    if 2 * sum(c.letters for c in found) > root.letters:
        root.children = found
    for i, slot in enumerate(slots(root)):
        slot.number = i
    return root


def holder(root: Node, without: set[int] = frozenset()) -> tuple[str, Node]:
    """The way down, by labels, to the deepest container that holds most of the text, and the container.

    The slots ``without`` don't count. The way is empty where there is no such container below the body, or
    where article or main elements say it.
    """

    def count(node: Node) -> int:
        node.letters = (0 if node.number in without else len(node.text)) + sum(map(count, node.children))
        return node.letters

    count(root)
    node, way = root, []
    while True:
        best = max((c for c in node.children if c.tag in HOLDERS or c.tag == "html"), key=lambda c: c.letters, default=None)
        if best is None or best.letters < HOLDS * root.letters:
            break
        if best.tag in MAIN:
            return "", root
        node = best
        way.append(best.label)
    return ("/".join(way), node) if node.tag not in ("", "html", "body") else ("", root)


def _outside(node: Node, kept: Node) -> Iterator[int]:
    """Numbers of the slots of a page outside a container and outside a first heading."""
    if node is kept or node.tag == "h1":
        return
    if node.tag == "#":
        yield node.number
    for c in node.children:
        yield from _outside(c, kept)


def slots(node: Node) -> Iterator[Node]:
    """Slots of text in page order."""
    if node.tag == "#":
        yield node
    for c in node.children:
        yield from slots(c)


def _seal(node: Node) -> None:
    """Sets what matching needs: a key that identical trees share, nodes, and the only slot with the labels down to it."""
    for c in node.children:
        _seal(c)
    node.nodes = 1 + sum(c.nodes for c in node.children)
    node.key = hash((node.label, node.text, *[c.key for c in node.children]))
    if node.tag == "#":
        node.slot, node.chain = node, (node.label,)
    elif len(node.children) == 1 and node.children[0].slot:
        node.slot, node.chain = node.children[0].slot, (node.label, *node.children[0].chain)


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the nodes of two trees that match in order, their number and the matched slots.

    Elements match if their tag and classes are equal and their parents match. Of all
    matchings it is the one with the most slots of equal text, of these one with the most
    nodes. Only of children beyond ``CELLS`` pairs identical ones are matched first, by
    their longest order-preserving sequence, and what lies between them on its own.
    """
    for tree in (a, b):
        if tree.key is None:
            _seal(tree)
    score, pairs = _matched(a, b)
    return score % EQUAL, pairs


def _matched(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Score (equal slots times ``EQUAL``, and nodes) and matched slots of two nodes with one label."""
    if a.key == b.key:
        pairs = list(zip(slots(a), slots(b)))
        return a.nodes + EQUAL * len(pairs), pairs
    if a.tag == "#" or b.tag == "#":
        return 1, [(a, b)] if a.tag == b.tag else []
    # Identical children at either end match in one best matching.
    x, y = a.children, b.children
    start, end = 0, min(len(x), len(y))
    while start < end and x[start].key == y[start].key:
        start += 1
    tail = 0
    while tail < end - start and x[-1 - tail].key == y[-1 - tail].key:
        tail += 1
    inner = _between(x[start : len(x) - tail], y[start : len(y) - tail])
    ends = [_matched(x[i], y[i]) for i in range(start)], [_matched(x[i], y[i]) for i in range(-tail, 0)]
    done = [*ends[0], inner, *ends[1]]
    return 1 + sum(score for score, _ in done), [p for _, pairs in done for p in pairs]


def _between(x: list[Node], y: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
    """Score and matched slots of children in order."""
    if not x or not y:
        return 0, []
    if len(x) == len(y) == 1:
        return _matched(x[0], y[0]) if x[0].label == y[0].label else (0, [])
    if len(x) * len(y) <= CELLS:
        kinds: dict[str, int] = {}
        left, right = (np.array([kinds.setdefault(c.label, len(kinds)) for c in side]) for side in (x, y))
        same = left[:, None] == right[None, :]
        deep = same & (np.array([c.slot is None for c in x])[:, None] | np.array([c.slot is None for c in y])[None, :])
        if DEEP * np.count_nonzero(deep) <= CELLS:
            return _best(x, y, deep)
    found = _rising([c.key for c in x], [c.key for c in y])
    if not found:
        found = _rising([c.label for c in x], [c.label for c in y])
        done = [_matched(x[i], y[j]) for i, j in found]
    else:
        done, i, j = [], 0, 0
        for p, q in [*found, (len(x), len(y))]:
            done.append(_between(x[i:p], y[j:q]))
            if p < len(x):
                done.append(_matched(x[p], y[q]))
            i, j = p + 1, q + 1
    return sum(score for score, _ in done), [p for _, pairs in done for p in pairs]


def _rising(x: list, y: list) -> list[tuple[int, int]]:
    """The longest sequence that rises in both lists among the pairs of the k-th occurrences of a value."""
    places: dict = {}
    for j in range(len(y) - 1, -1, -1):
        places.setdefault(y[j], []).append(j)
    tops, last, before, at = [], [], [], []
    for i, value in enumerate(x):
        if places.get(value):
            j = places[value].pop()
            k = bisect.bisect_left(tops, j)
            at.append((i, j))
            before.append(last[k - 1] if k else -1)
            tops[k : k + 1], last[k : k + 1] = [j], [len(at) - 1]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(at[n])
        n = before[n]
    return out[::-1]


def _best(x: list[Node], y: list[Node], deep: np.ndarray) -> tuple[int, list[tuple[Node, Node]]]:
    """The best of all order-preserving matchings. ``deep`` are the pairs of one label that aren't both a single slot."""
    chains: dict[tuple, int] = {}
    left, right = (np.array([chains.setdefault(c.chain, len(chains)) for c in side]) for side in (x, y))
    shared = np.zeros((len(chains), len(chains)), np.int64)
    for c, i in chains.items():
        for d, j in chains.items():
            shared[i, j] = next((n for n, (k, m) in enumerate(zip(c, d)) if k != m), min(len(c), len(d)))
    weight = shared[left][:, right]
    keys: dict[int, int] = {}
    first, second = (np.array([keys.setdefault(c.key, len(keys)) for c in side]) for side in (x, y))
    weight += EQUAL * ((first[:, None] == second[None, :]) & (weight > 0))
    found = {}
    for i, j in np.argwhere(deep).tolist():
        found[i, j] = _matched(x[i], y[j])
        weight[i, j] = found[i, j][0]
    best = np.zeros((len(x) + 1, len(y) + 1), np.int64)
    for i, row in enumerate(weight):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + row), out=best[i + 1, 1:])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        here = best[i, j]
        if here == best[i - 1, j]:
            i -= 1
        elif here == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            if (i, j) in found:
                pairs.extend(reversed(found[i, j][1]))
            elif x[i].chain == y[j].chain:
                pairs.append((x[i].slot, y[j].slot))
    return int(best[-1, -1]), pairs[::-1]


class Reference:
    """Trees of reference pages that the worker has met, the last few."""

    kept: dict[str, Node] = {}

    @classmethod
    def of(cls, page: str) -> Node:
        if page not in cls.kept:
            if len(cls.kept) >= 64:
                cls.kept.clear()
            cls.kept[page] = content(page)
        return cls.kept[page]


def digest(page: Node) -> bytes:
    """Digest of labels and texts of all nodes, equal for pages of one content wherever it is computed."""
    said = hashlib.blake2b(digest_size=16)
    stack: list[Node | None] = [page]
    while stack:
        node = stack.pop()
        if node is None:
            said.update(b"\x01")
        else:
            said.update(f"{node.label}\x02{node.text}\x03".encode("utf-8", "replace"))
            stack.append(None)
            stack.extend(reversed(node.children))
    return said.digest()


def votes(page: Node, reference: str) -> tuple[list[tuple[int, bool]], set[int]]:
    """Matched slots of the reference and whether the page has the same text there, and the page's slots that have.

    There are none of a copy, which says hardly anything of its own.
    """
    _, pairs = align(page, Reference.of(reference))
    equal = {a.number for a, b in pairs if a.text == b.text}
    if sum(len(s.text) for s in slots(page) if s.number not in equal) < OWN_LETTERS:
        return [], set()
    return [(b.number, a.text == b.text) for a, b in pairs], equal


def extract(page: str | None, way: str | None = None, *known: str | list[int] | None) -> str:
    """Text of the content slots, one a line.

    ``way`` leads to the container that the host's pages have their text in; ``known`` has references, each followed by its template.
    """
    tree, dropped = content(page), set()
    for reference, template in zip(known[::2], known[1::2]):
        if reference is not None and template:
            constant = set(template)
            _, pairs = align(tree, Reference.of(reference))
            dropped |= {a.number for a, b in pairs if b.number in constant and a.text == b.text}
    if way:
        own, kept = holder(tree, dropped)
        if own == way:
            dropped.update(_outside(tree, kept))
    return "\n".join(s.text for s in slots(tree) if s.number not in dropped)


def host(url: Column) -> Column:
    """Host of an address in lower case, null if it has none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", found)


def layout(page: Column) -> Column:
    """Hash of the containers, with their classes, that a page has."""
    tags = F.regexp_extract_all(page, F.lit(r"(?i)<(?:body|main|article|section|div)\b[^>]*+>"), F.lit(0))
    name = lambda x: F.lower(F.regexp_extract(x, "^<([A-Za-z]+)", 1))
    classes = lambda x: F.lower(F.regexp_extract(x, r"""(?i)\sclass\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++)""", 1))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda x: F.concat(name(x), F.lit("."), classes(x))))))


def references(pages: DataFrame) -> DataFrame:
    """``_host``, ``_layout``, ``_reference`` for hosts with enough pages. ``pages`` has ``_host``, ``_layout``, ``_html``.

    Each has one of the whole host, where ``_layout`` is null, and one of each layout with
    enough pages, unless it is that of the host. One page a layout and task is shuffled.
    """
    far = F.abs(F.octet_length("_html") - REFERENCE_BYTES)
    best = pages.where("_host is not null and _html is not null").groupBy("_host", "_layout")
    best = pin(best.agg(F.count("*").alias("n"), F.min(F.struct(far.alias("far"), "_html")).alias("best")))
    whole = best.groupBy("_host").agg(F.sum("n").alias("n"), F.min("best").alias("best")).where(F.col("n") > VOTES)
    heads = whole.select("_host", F.lit(None).cast("long").alias("_layout"), F.col("best._html").alias("_reference"))
    own = best.where(F.col("n") > VOTES).join(whole.select("_host", F.col("best").alias("head")), "_host").where("best != head")
    return heads.unionByName(own.select("_host", "_layout", F.col("best._html").alias("_reference")))


def with_references(pages: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """``pages`` with the ``columns`` of their host's reference, and those of their layout's with ``_own`` behind the name."""
    whole = small_side(chosen.where("_layout is null").select("_host", *columns))
    own = small_side(chosen.where("_layout is not null").select("_host", "_layout", *[F.col(c).alias(f"{c}_own") for c in columns]))
    return pages.join(whole, "_host", "left").join(own, ["_host", "_layout"], "left")


def templates(pages: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_host``, ``_layout``, ``_template``: numbers of the reference's slots that are template;
    and ``_host``, ``_way``: the way to the container that nearly all pages of a host have their text in."""
    columns = ["_host", "_layout", "_html", "_reference", "_reference_own"]
    kinds = {"_host": pa.string(), "_layout": pa.int64(), "digest": pa.binary(), "way": pa.string(), "votes": pa.list_(pa.int32())}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int | None, bytes], tuple] = {}
            for name, kind, page, *both in zip(*(batch.column(c).to_pylist() for c in columns)):
                tree = content(page)
                said = digest(tree)
                for of, reference in zip((None, kind), both):
                    if reference is not None and (name, of, said) not in found:
                        said_so, equal = votes(tree, reference)
                        # What the page shares with the reference doesn't make a container that of its text.
                        found[name, of, said] = holder(tree, equal)[0], [2 * number + same for number, same in said_so]
            voting = [dict(zip(kinds, (*k, *v))) for k, v in found.items() if v[1]]
            yield pa.RecordBatch.from_pylist(voting, pa.schema(list(kinds.items())))

    joined = with_references(pages.where("_html is not null"), chosen, ["_reference"]).where("_reference is not null").select(*columns)
    said = joined.mapInArrow(work, "_host string, _layout long, digest binary, way string, votes array<int>")
    # Pages of one content have one vote. Kept: slots and ways are counted from it.
    each = pin(said.groupBy("_host", "_layout", "digest").agg(F.first("votes").alias("votes"), F.first("way").alias("way")))
    counted = each.select("_host", "_layout", F.explode("votes").alias("vote")).groupBy("_host", "_layout", F.shiftright("vote", 1).alias("slot"))
    counted = counted.agg(F.count("*").alias("n"), F.sum(F.col("vote") % 2).alias("same"))
    constant = counted.where((F.col("n") >= VOTES) & (F.col("same") >= F.col("n") * CONSTANT))
    ways = each.where("_layout is null").groupBy("_host", "way").agg(F.count("*").alias("n"))
    most = ways.groupBy("_host").agg(F.sum("n").alias("all"), F.max(F.struct("n", "way")).alias("top"))
    agreed = most.where((F.col("top.n") > VOTES) & (F.col("top.n") >= F.col("all") * CONSTANT) & (F.col("top.way") != ""))
    return constant.groupBy("_host", "_layout").agg(F.collect_list("slot").alias("_template")), agreed.select("_host", F.col("top.way").alias("_way"))


def extractor(spark: SparkSession):
    """Function of a page, the way to its container, reference and template of its host, and those of its layout, that gives the main text."""

    @F.arrow_udf(T.StringType())
    def text(pages: pa.Array, *known: pa.Array) -> pa.Array:
        rows = zip(pages, *known)
        return pa.array([extract(p.as_py(), *(k.as_py() for k in more)) for p, *more in rows], pa.string())

    return text


def main_text(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with the main text.

    Null and empty pages, and pages that are all template, have empty text. Pages
    without an address or host, and of hosts with up to ``VOTES`` pages, are read without
    a template. Repeated rows get equal texts. Of pages equally near to the reference
    size the first by its text is the reference, of the host and of each layout. An empty table stays empty. A column of
    ``pages`` named as the output is replaced, other columns stay as they are.
    """
    if out in (url, page):
        raise ValueError("the output needs a name other than the inputs'")
    keyed = {"_host": host(F.col(f"`{url}`")), "_layout": layout(F.col(f"`{page}`")), "_html": F.col(f"`{page}`")}
    bare = pages.select(*[c.alias(n) for n, c in keyed.items()])
    chosen = pin(references(bare))
    found, ways = templates(bare, chosen)
    found = found.withColumnsRenamed({"_host": "_at", "_layout": "_of"})
    known = pin(chosen.join(found, (F.col("_host") == F.col("_at")) & F.col("_layout").eqNullSafe(F.col("_of"))).drop("_at", "_of"))
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != out])
    joined = with_references(pages.select(row.alias("_row"), *[c.alias(n) for n, c in keyed.items()]), known, ["_reference", "_template"])
    joined = joined.join(small_side(ways), "_host", "left")
    known_of = ["_way", "_reference", "_template", "_reference_own", "_template_own"]
    found = joined.select("_row", extractor(pages.sparkSession)("_html", *known_of).alias("_text"))
    return found.select("_row.*", F.col("_text").alias(out))

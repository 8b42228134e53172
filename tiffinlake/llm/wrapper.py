"""Main text by wrapper induction: pages of one host show which nodes are template and which are content.

A page becomes a tree in which neighbouring siblings of one kind (tag, class, id) are one node, so its
size is that of the layout and not of the text. Trees of a host are aligned by simple tree matching
(equal roots, then the best ordered matching of children) and merged into its wrapper, which counts
for every node the pages that have it and the texts it has there. A text found in nearly all
pages that have its node is template; what varies is content. A page's content is looked for in its
article (else main part, else body), and never in nodes whose tag, role or class names page furniture.
A class or id is weak evidence, as layout wrappers are named after what they stand beside: it marks no
node around the page's article or main part, and none that holds most of the text there is to take.

A wrapper is a bounded summary. Per node it counts texts by Misra-Gries and knows how many pages a count may
lack, so no text of ``SHARE`` can be missed; nodes beyond its size are left out. Where either could change
what is template, a second pass over the host's pages counts exactly, in Spark: texts in question by their
node of the wrapper and, if nodes were left out, all texts, by path where a page's node has no place in it.

Wrappers are built where the pages lie, a partial one per task and host, and merged in two steps, so a
host with a third of all pages costs no more than the number of tasks. A wrapper is joined back to the
pages by broadcast while all wrappers are measured to be small, and by a shuffle beyond that.

Defined cases: null and empty pages have no text; text outside any element counts as body text; broken
markup follows the HTML rules (unclosed elements end with their parents, an unfinished tag, comment or
script at the end is dropped); equal pages give equal texts; a page of which more than half would be
template is a copy of other pages and keeps its text; hosts with few pages have no template.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored

#: A text is template from this share of a host's pages on, if the host has so many pages.
SHARE, LEAST_PAGES = 0.9, 10
#: Texts counted per node (or ``PER_PAGE`` times those of a page, if these are more), nodes per wrapper, hosts
#: per task before partial wrappers are passed on.
TEXTS, PER_PAGE, NODES, HOSTS = 64, 8, 400, 2000
BROADCAST_BYTES = 8 << 20
FAN_IN = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
#: Elements that an opening tag ends when they are open, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
FURNITURE_TAGS = RAW | frozenset("head nav header footer aside button select option dialog svg template object".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation"
    " menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices"
    " notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related"
    " recommended comment comments commentlist respond reply replies disqus pagination pager search skip toolbar".split()
)
#: Of these, parts with texts of their own, which may be longer than the content and made up of articles.
PART_WORDS = frozenset(
    "cookie cookies consent gdpr newsletter subscribe subscription related recommended comment comments commentlist"
    " respond reply replies disqus".split()
)
#: A class with one of these says what the layout has or lacks, or which tool made it, not what the node is.
LAYOUT_WORDS = frozenset("no not with without has elementor".split())
#: How sure it is that a node is furniture: by tag or role; by name, a part with texts of its own; by name.
SURE, PART, NAMED = 3, 2, 1
TOKEN = re.compile(
    r"<(?:(?P<comment>!--)|(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)"
    r"(?P<attributes>(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?P<closed>>|\Z)|(?P<other>[!?/])[^>]*+>?)"
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[a-z]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    """A node of a page: its kind, its children in order, and whether it is furniture or an article.

    ``mark`` is what its own tag, role and names say; ``furniture`` is settled by ``content_nodes``.
    """

    __slots__ = ("children", "furniture", "kind", "mark", "number", "parent", "tag", "top")

    def __init__(self, tag: str, kind: str, parent: Node | None, mark: int, top: str):
        self.tag, self.kind, self.parent, self.children = tag, kind, parent, []
        self.mark, self.furniture, self.top, self.number = mark, mark > 0, top, 0


_KINDS: dict[tuple[str, str], tuple[str, int, str]] = {}


def kind_of(tag: str, attributes: str) -> tuple[str, int, str]:
    """(kind, how sure it is furniture, 'article' or 'main' if it holds the page's content)."""
    if (known := _KINDS.get((tag, attributes))) is not None:
        return known
    told: dict[str, str] = {}
    for name, *value in ATTRIBUTE.findall(attributes) if attributes else ():
        told.setdefault(name.lower(), "".join(value))
    names = (told.get("class", "") + " " + told.get("id", "")).lower()
    role = told.get("role", "").lower()
    top = "article" if tag == "article" or told.get("itemprop", "").lower() == "articlebody" or role == "article" else ""
    top = top or ("main" if tag == "main" or role == "main" else "")
    mark = SURE if tag in FURNITURE_TAGS or (role in FURNITURE_ROLES and role != "form") else 0
    if not mark and not top and tag not in ("html", "body"):
        said = [words for name in names.split() if not LAYOUT_WORDS & (words := set(WORDS.findall(name)))]
        said = set().union(*said) & FURNITURE_WORDS
        mark = PART if said & PART_WORDS else NAMED if said or tag == "form" or role == "form" else 0
    found = (f"{tag} {DIGITS.sub('0', names).strip()}", mark, top)
    if len(_KINDS) < 50_000:
        _KINDS[tag, attributes] = found
    return found


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str] | None]]:
    """(nodes, texts): texts in page order with their nodes, None where a block begins or ends."""
    root = Node("", "", None, 0, "")
    nodes, texts, stack = [root], [], [root]
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            texts.append((stack[-1], page[at:]))
            break
        if m.start() > at:
            texts.append((stack[-1], page[at : m.start()]))
        at = m.end()
        if m["comment"]:
            end = page.find("-->", m.end() - 2)  # <!--> is a whole comment
            at = size if end < 0 else end + 3
            continue
        if not m["tag"]:
            continue
        if not m["closed"]:
            break  # the page ends inside a tag
        tag = m["tag"].lower()
        if tag not in INLINE:
            texts.append(None)
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ENDS_P:
            close(stack, {"p"}, {"article", "section", "div", "table", "td", "th", "body", "button", "li", "blockquote"})
        if tag in CLOSES:
            close(stack, *CLOSES[tag])
        if tag in VOID:
            continue
        parent = stack[-1]
        kind, mark, top = kind_of(tag, m["attributes"])
        if parent.children and parent.children[-1].kind == kind:
            node = parent.children[-1]
        else:
            node = Node(tag, kind, parent, mark, top)
            node.number = len(nodes)
            nodes.append(node)
            parent.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = size if end is None else end.start()
            stack.append(node)
            continue
        if not m["attributes"].endswith("/") or tag not in ("svg", "path", "use"):
            stack.append(node)
    return nodes, texts


def close(stack: list[Node], tags: set[str], upto: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in upto:
            return


def text_blocks(texts: list[tuple[Node, str] | None], wanted: set[int]) -> list[tuple[int, str]]:
    """(number of its first node, text) of each block that has text in wanted nodes."""
    out, parts, first = [], [], 0

    def flush() -> None:
        if parts and (text := " ".join(html_lib.unescape("".join(parts)).split())):
            out.append((first, text))
        parts.clear()

    for piece in texts:
        if piece is None:
            flush()
        elif piece[0].number in wanted:
            if not parts:
                first = piece[0].number
            parts.append(piece[1])
    flush()
    return out


def content_nodes(nodes: list[Node], texts: list[tuple[Node, str] | None]) -> set[int]:
    """Numbers of the nodes that may hold content: below the article with most text, else main, else all.

    Settles which nodes are furniture. Parents precede their children in ``nodes``, so a pass each way does.
    """
    sure, worst = [False] * len(nodes), [0] * len(nodes)
    for n in nodes[1:]:
        p = n.parent.number
        sure[n.number] = sure[p] or n.mark == SURE
        worst[n.number] = max(worst[p], nodes[p].mark)
    size, plain = [0] * len(nodes), [0] * len(nodes)
    for t in texts:
        if t and not sure[t[0].number]:
            size[t[0].number] += len(t[1].strip())
    for n in nodes:
        plain[n.number] = 0 if max(worst[n.number], n.mark) else size[n.number]
    for n in reversed(nodes[1:]):
        size[n.parent.number] += size[n.number]
        plain[n.parent.number] += plain[n.number]

    root = page_root(nodes, sure, worst, size, plain)
    around, n = set(), root
    while n is not None:
        around.add(n.number)
        n = n.parent
    whole = size[root.number if root else 0]
    for n in nodes[1:]:
        own = n.mark == SURE
        if not own and n.mark and n.number not in around:
            own = size[n.number] < whole if n.mark == PART else 2 * size[n.number] <= whole
        n.furniture = own or (n.parent.furniture and n is not root)
    return subtree(root or nodes[0])


def page_root(nodes: list[Node], sure: list[bool], worst: list[int], size: list[int], plain: list[int]) -> Node | None:
    """The page's article, or else its main part; those among comments and the like come last."""

    def largest(found: list[Node]) -> Node | None:
        return max(found, key=lambda n: size[n.number], default=None)

    tops = [n for n in nodes if n.top and not sure[n.number]]
    mains = [n for n in tops if n.top == "main"]
    articles = [n for n in tops if n.top == "article"]
    main = largest([n for n in mains if worst[n.number] != PART] or mains)
    article = largest([n for n in articles if worst[n.number] != PART])
    if main and article and worst[article.number] and plain[main.number] > size[article.number]:
        return main  # a teaser in a named box beside or in the main part
    return article or main or largest(articles)


def subtree(root: Node) -> set[int]:
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        if not node.furniture:
            out.add(node.number)
            todo += node.children
    return out


def fingerprint(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()


# --- wrappers: [kind, pages, {fingerprint: pages}, children, pages that a count may lack, texts of all pages,
# whether nodes were left out (at the root), place in the wrapper once loaded]; pages may be nested as deep as
# they are long, so nothing here recurses


def align(a, b, children, kind) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """Simple tree matching of every two nodes that may meet, by their ids."""
    order, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        x, y = children(a), children(b)
        order.append((a, b, x, y))
        todo += [(c, d) for c in x for d in y if kind(c) == kind(d)]
    done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    for a, b, x, y in reversed(order):
        score = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        gain: dict[tuple[int, int], int] = {}
        for i in range(len(x)):
            for j in range(len(y)):
                here = max(score[i][j + 1], score[i + 1][j])
                if kind(x[i]) == kind(y[j]):
                    gain[i, j] = 1 + done[id(x[i]), id(y[j])][0]
                    here = max(here, score[i][j] + gain[i, j])
                score[i + 1][j + 1] = here
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if (i - 1, j - 1) in gain and score[i][j] == score[i - 1][j - 1] + gain[i - 1, j - 1]:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif score[i][j] == score[i - 1][j]:
                i -= 1
            else:
                j -= 1
        done[id(a), id(b)] = score[-1][-1], pairs[::-1]
    return done


def match(a, b, children, kind) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes' children: its size and the pairs of places matched."""
    return align(a, b, children, kind)[id(a), id(b)]


def merge(into: list, other: list) -> None:
    """Adds a wrapper to another: matched nodes add up, unmatched ones are inserted in their place."""
    found = align(into, other, lambda n: n[3], lambda n: n[0])
    todo = [(into, other)]
    while todo:
        into, other = todo.pop()
        into[1] += other[1]
        for text, count in other[2].items():
            into[2][text] = into[2].get(text, 0) + count
        into[4], into[5], into[6] = into[4] + other[4], into[5] + other[5], into[6] or other[6]
        lighten(into)
        taken, children, i = {j: i for i, j in found[id(into), id(other)][1]}, [], 0
        for j, child in enumerate(other[3]):
            if j in taken:
                children += into[3][i : taken[j] + 1]
                todo.append((children[-1], child))
                i = taken[j] + 1
            else:
                children.append(child)
        into[3] = children + into[3][i:]


def lighten(node: list) -> None:
    """Misra-Gries: takes from all counts that of the first text too many, but never half of the pages in all."""
    keep = max(TEXTS, PER_PAGE * node[5] // node[1])
    if len(node[2]) > keep:
        less = min(sorted(node[2].values(), reverse=True)[keep], node[1] // 2 - node[4])
        if less > 0:
            node[2] = {t: c - less for t, c in node[2].items() if c > less}
            node[4] += less


def walk(wrapper: list) -> Iterator[list]:
    """The nodes of a wrapper, parents before children, in page order."""
    todo = [wrapper]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node[3])


def count_nodes(wrapper: list) -> int:
    return sum(1 for _ in walk(wrapper))


def prune(wrapper: list, least: int) -> None:
    for node in walk(wrapper):
        node[3] = [c for c in node[3] if c[1] >= least]


def dumps(wrapper: list) -> str:
    """The nodes as a flat list, each with the number of its children."""
    return json.dumps([[*n[:3], len(n[3]), *n[4:7]] for n in walk(wrapper)])


def loads(text: str) -> list:
    root: list = ["", 0, {}, []]
    open_nodes = [(root, 1)]
    for place, (kind, pages, texts, size, *rest) in enumerate(json.loads(text)):
        while not open_nodes[-1][1]:
            open_nodes.pop()
        parent, left = open_nodes.pop()
        open_nodes.append((parent, left - 1))
        parent[3].append([kind, pages, texts, [], *rest, place])
        open_nodes.append((parent[3][-1], size))
    return root[3][0]


def add(wrapper: list | None, other: list) -> list:
    if wrapper is None:
        return other
    merge(wrapper, other)
    if count_nodes(wrapper) > NODES:  # what is rare is counted in the second pass
        nodes = count_nodes(wrapper)
        prune(wrapper, -(-wrapper[1] // 20))
        wrapper[6] = wrapper[6] or int(count_nodes(wrapper) < nodes)
    return wrapper


def page_wrapper(page: str) -> list:
    """The wrapper of one page: the content nodes' ancestors and descendants with their blocks' texts."""
    nodes, texts = parse(page)
    found: dict[int, dict[str, int]] = {}
    wanted = content_nodes(nodes, texts)
    for number, text in text_blocks(texts, wanted):
        found.setdefault(number, {})[fingerprint(text)] = 1

    made: dict[int, list] = {}
    for n in nodes:
        if not n.number or (not n.furniture and n.parent.number in made):
            made[n.number] = [n.kind, 1, found.get(n.number, {}), [], 0, len(found.get(n.number, ())), 0]
            if n.number:
                made[n.parent.number][3].append(made[n.number])
    return made[0]


def frequent(node: list) -> set[str]:
    """The texts that may be template in a wrapper's node; they are if no count lacks a page."""
    if node[1] < LEAST_PAGES:
        return set()
    return {t for t, c in node[2].items() if c + node[4] >= SHARE * node[1]}


def undecided(wrapper: list) -> bool:
    """Whether the wrapper's counts don't settle what is template."""
    return bool(wrapper[6]) or any(n[4] and frequent(n) for n in walk(wrapper))


def places(wrapper: list, nodes: list[Node]) -> Iterator[tuple[Node, list | None, str]]:
    """Per node of a page that may hold content: its node in the wrapper, and the key of exact counts."""

    def children(n):
        return n[3] if isinstance(n, list) else [c for c in n.children if not c.furniture]

    found = align(wrapper, nodes[0], children, lambda n: n[0] if isinstance(n, list) else n.kind)
    todo: list[tuple[Node, list | None, bytes]] = [(nodes[0], wrapper, b"")]
    while todo:
        node, w, above = todo.pop()
        path = hashlib.blake2b(above + node.kind.encode(), digest_size=12).digest()
        yield node, w, path.hex() if w is None else str(w[7]) if len(w) > 7 else ""
        below = children(node)
        met = {j: w[3][i] for i, j in found[id(w), id(node)][1]} if w is not None else {}
        todo += [(child, met.get(j), path) for j, child in enumerate(below)]


def template_of(wrapper: list | None, nodes: list[Node], counted: dict[str, list[str]] | None = None) -> dict[int, set[str]]:
    """Per node number of a page, aligned with the wrapper: the texts that are template there."""
    if wrapper is None or wrapper[1] < LEAST_PAGES:
        return {}
    template: dict[int, set[str]] = {}
    for node, w, key in places(wrapper, nodes):
        exact = w is not None and not w[4] and not wrapper[6]
        if fixed := frequent(w) if exact else set((counted or {}).get(key, ())):
            template[node.number] = fixed
    return template


def to_count(page: str, wrapper: list) -> Iterator[tuple[str, str]]:
    """(key, fingerprint) of the page's texts that need exact counts, and (key, '') of their nodes, once each."""
    nodes, texts = parse(page)
    found: dict[int, set[str]] = {}
    for number, text in text_blocks(texts, content_nodes(nodes, texts)):
        found.setdefault(number, set()).add(fingerprint(text))
    out: dict[str, set[str]] = {}
    for node, w, key in places(wrapper, nodes):
        if wrapper[6]:
            out.setdefault(key, {""}).update(found.get(node.number, ()))
        elif w is not None and w[4] and (asked := frequent(w)):
            out.setdefault(key, {""}).update(found.get(node.number, set()) & asked)
    for key, told in out.items():
        for text in told:
            yield key, text


def has_template(wrapper: list) -> bool:
    return bool(wrapper[6]) or any(map(frequent, walk(wrapper)))


def main_text(page: str | None, wrapper: list | None = None, counted: dict[str, list[str]] | None = None) -> str:
    if not page:
        return ""
    nodes, texts = parse(page)
    blocks = text_blocks(texts, content_nodes(nodes, texts))
    if wrapper is not None and (template := template_of(wrapper, nodes, counted)):
        kept = [(n, t) for n, t in blocks if n not in template or fingerprint(t) not in template[n]]
        if 2 * sum(len(t) for _, t in kept) >= sum(len(t) for _, t in blocks):
            blocks = kept
    return " ".join(t for _, t in blocks)


# --- Spark


def with_host(pages: DataFrame) -> DataFrame:
    url = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select("page_id", "url", "html", url.alias("host"))


def induce(pages: DataFrame) -> DataFrame:
    """host, wrapper (text), undecided of the hosts that may have template text among their content."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        group = TaskContext.get().partitionId() % FAN_IN
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    own[host] = add(own.get(host), page_wrapper(page))
                if len(own) >= HOSTS:
                    yield told(own, group)
                    own = {}
        yield told(own, group)

    def told(own: dict[str, list], group: int) -> pa.RecordBatch:
        wrappers = [dumps(w) for w in own.values()]
        columns = [pa.array(list(own), pa.string()), pa.array([group] * len(own), pa.int32()), pa.array(wrappers, pa.string())]
        columns.append(pa.array([undecided(w) for w in own.values()], pa.bool_()))
        return pa.RecordBatch.from_arrays(columns, names=["host", "group", "wrapper", "undecided"])

    def reduce(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, wrapper = None, None
            for batch in batches:
                for host, group, text, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (host, group) != key and key is not None:
                        if not last or has_template(wrapper):
                            yield told({key[0]: wrapper}, 0)
                        wrapper = None
                    key, wrapper = (host, group), add(wrapper, loads(text))
            if key is not None and (not last or has_template(wrapper)):
                yield told({key[0]: wrapper}, 0)

        return run

    ddl = "host string, group int, wrapper string, undecided boolean"
    parts = pages.select("host", "html").mapInArrow(partial, ddl)
    for last in (False, True):
        parts = parts.repartition("host", "group").sortWithinPartitions("host", "group").mapInArrow(reduce(last), ddl)
    return parts.select("host", "wrapper", "undecided")


def with_wrapper(pages: DataFrame, wrappers: DataFrame, how: str) -> DataFrame:
    size = wrappers.agg(F.sum(F.length("wrapper") + F.coalesce(F.length("counted"), F.lit(0)))).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", how)


def counted_exactly(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, counted (text): the template texts by key, of the hosts whose wrappers leave it undecided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = Loaded()
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for host, page, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page:
                    out += [(host, *row) for row in to_count(page, loaded[told])]
            columns = [pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "key", "text"])

    rows = with_wrapper(pages, wrappers, "inner").select("host", "html", "wrapper")
    found = rows.mapInArrow(run, "host string, key string, text string").groupBy("host", "key", "text").agg(F.count("*").alias("n"))
    found = stored(found.where(F.col("n") >= SHARE * LEAST_PAGES), "counts")
    pages_of = found.where(f"text = '' and n >= {LEAST_PAGES}").select("host", "key", F.col("n").alias("pages"))
    fixed = found.where("text <> ''").join(pages_of, ["host", "key"]).where(F.col("n") >= SHARE * F.col("pages"))
    by_key = fixed.groupBy("host", "key").agg(F.collect_list("text").alias("texts"))
    told = F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "texts"))))
    return by_key.groupBy("host").agg(told.alias("counted"))


class Loaded(dict):
    """Stored trees and counts by their text, of so many hosts at once."""

    def __missing__(self, text: str):
        if len(self) >= HOSTS:
            self.clear()
        self[text] = loads(text) if text.startswith("[") else json.loads(text)
        return self[text]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for rows of page_id, url, html."""
    pages = with_host(pages)
    wrappers = stored(induce(pages), "wrappers").withColumn("counted", F.lit(None).cast("string"))
    open_ones = wrappers.where("undecided")
    if not open_ones.isEmpty():
        counted = counted_exactly(pages, open_ones)
        wrappers = stored(wrappers.drop("counted").join(counted, "host", "left"), "counted")
    joined = with_wrapper(pages, wrappers, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = Loaded()
        for batch in batches:
            out = []
            for page, told, counted in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                out.append(main_text(page, loaded[told] if told else None, loaded[counted] if counted else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"]
            )

    rows = joined.select("page_id", "url", "html", "wrapper", "counted")
    return rows.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")

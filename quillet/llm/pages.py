"""Main text of HTML pages by wrapper induction.

1. Pages become trees of elements; scripts, styles and comments are dropped by the parser, character references decoded.
2. For each host, REFERENCES + 1 different pages (those of least hash; a page is measured against REFERENCES others; a bounded documented sample,
   not a filter) are the wrapper. Simple tree matching aligns each page with each reference: two trees match at their roots if their tags and
   classes agree, and their children by an order-keeping match: equal subtrees that both have once are partners first, as far as they keep order, and between
   them a maximal match of nodes is taken.
3. A text node is template if its partners in two references have the same text, or in most of those in which it has one (hosts take turns with menus and adverts). Inside an
   article it takes three quarters of all references and two at
   least, as short articles repeat lines by chance. The other text nodes are varying slots. References that copy the page don't count. Template is dropped at
   every level, whatever its tag or name.
4. Of the varying slots, those under elements that name furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments: by tag, role,
   class or id) are dropped: a tie-break, as adverts and comments vary too. Inside an article a name is often a topic (search-algorithms, share-prices): there only tags, roles and the classes in OWN_NAMES
   tell alone, other names when half of the element's text or more is template or links. Of the rest, the content is what lies in the smallest element that
   holds all articles (or main elements), or, on pages without one, all varying slots.
   n_template and n_named count the code points of text nodes (white space collapsed) that the wrapper and the names dropped.

Text in one block (paragraph, heading, list item, table cell and so on) is joined, its white space made one space and trimmed; blocks are joined
by two newlines, in page order. A line break is white space. A host with one page has no partner to align with, so its text nodes all vary.

Null pages give an empty text; so do empty ones and pages without text. Rows that repeat are rows of their own. An empty table gives an empty
result. Broken markup is mended like a browser does in the common cases: void elements, paragraphs and list items ended by the next one, end
tags without a start ignored, open elements ended by the end tag of an outer one. Elements may be nested to any depth. Columns with the names of added ones give way to them.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.session import checkpoint

REFERENCES = 8
#: Wrappers of all hosts up to this size are broadcast; larger ones are joined to the pages.
BROADCAST_BYTES = 32 << 20
#: Pages of a large host that one task takes, where the wrappers are too large for a broadcast.
SHARE = 2000
#: Elements whose text no reader sees.
UNSEEN = {"head", "script", "style", "noscript", "template", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose content is text up to their end tag; those of them that aren't shown are dropped.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements that never hold content of the article.
FURNITURE = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "option", "textarea", "input", "svg", "canvas", "object", "embed", "menu", "dialog", "title", "xmp"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "note"}
NAMES = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice\w*|alert\w*|popup|modal|newsletter|subscribe\w*|signup|login|nav\w*|menu\w*|breadcrumbs?|pagination|pager|footer|foot|copyright|sidebar\w*|side|aside|widget\w*|related\w*|recommend\w*|share|sharing|social\w*|comments?|commentlist|respond|replies|disqus|toolbar|tags|skip\w*|search\w*)(?:$|[-_ 0-9])", re.I)
#: The same, but outside an article only.
HEADS = re.compile(r"(?:^|[-_ ])(?:header|masthead|banner|topbar)(?:$|[-_ 0-9])", re.I)
#: Whole classes that name furniture inside an article too, whatever its topic.
OWN_NAMES = re.compile(r"ads?|advert\w*|adbox|adslot|sponsored|cookies?|consent|gdpr|cookie-\w+|newsletter|subscribe|signup|login|breadcrumbs?|pagination|pager|sidebar|widget|comments?|commentlist|respond|replies|disqus", re.I)
#: A start ends these open elements.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Nothing inside these is ended from within by ENDED_BY.
SCOPES = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "body", "html", "article", "div", "section", "main"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|<|[^<]+", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


class Node:
    """An element: tag, the name it is matched by, attributes, and children (elements and texts)."""

    __slots__ = ("attrs", "children", "digest", "key", "kids", "once", "parent", "plains", "size", "tag", "texts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.kids, self.plains, self.parent = tag, attrs, [], None, None, parent
        self.digest, self.size, self.once, self.texts = None, 0, None, None
        self.key = (tag, attrs.get("class", ""))


def parse(html: str) -> Node:
    root = Node("#root", {})
    stack, at = [root], 0
    count = Counter()  # open elements by tag, so that none is looked for in vain
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][:2] not in ("<!", "<?"):
                add_text(stack[-1], m[0])
            continue
        name = name.lower()
        if m[1]:
            if count[name]:
                close(stack, name, count)
            continue
        if name in BLOCKS and count["p"]:
            open_p = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p"), 0)
            if open_p and not any(x.tag in BLOCKS for x in stack[open_p + 1 :]):
                cut(stack, open_p, count)
        if name in ENDED_BY and any(count[x] for x in ENDED_BY[name]):
            k = len(stack) - 1
            while k > 0 and stack[k].tag not in ENDED_BY[name] and stack[k].tag not in SCOPES:
                k -= 1
            if k > 0 and stack[k].tag in ENDED_BY[name]:
                cut(stack, k, count)
        attrs = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
        node = Node(name, attrs, stack[-1])
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(html, at)
            text, at = (html[at : end.start()], end.end()) if end else (html[at:], len(html))
            if name in ("title", "textarea"):
                add_text(node, text)
        elif name not in VOID:
            stack.append(node)
            count[name] += 1
    return root


def cut(stack: list[Node], k: int, count: Counter) -> None:
    for x in stack[k:]:
        count[x.tag] -= 1
    del stack[k:]


def add_text(node: Node, text: str) -> None:
    text = unescape(text) if "&" in text else text
    if node.children and isinstance(node.children[-1], str):
        node.children[-1] += text
    else:
        node.children.append(text)


def close(stack: list[Node], name: str, count: Counter) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == name:
            cut(stack, k, count)
            return
        if stack[k].tag in ("td", "th", "table") and name not in ("tr", "tbody", "thead", "tfoot", "table", "body", "html", "div", "article", "section", "main"):
            return


def children(node: Node) -> list[Node | str]:
    """Elements, and texts that aren't blank."""
    if node.kids is None:
        node.kids = [x for x in node.children if not isinstance(x, str) or x.strip()]
    return node.kids


def plain_texts(node: Node) -> list[str | None]:
    """The children's texts with their white space collapsed; None for elements."""
    if node.plains is None:
        node.plains = [plain(x) if isinstance(x, str) else None for x in children(node)]
    return node.plains


def seal(root: Node) -> None:
    """Digests of all subtrees: equal ones have equal tags, classes and texts. size: the text nodes of a subtree."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in children(node) if not isinstance(x, str)]
    for node in reversed(order):
        parts = [y if isinstance(x, str) else x.digest for x, y in zip(children(node), plain_texts(node), strict=True)]
        node.digest = hash((node.key, *parts))
        node.size = sum(1 if isinstance(x, str) else x.size for x in children(node))


def text_places(node: Node) -> list[tuple[int, int]]:
    """The text nodes of a subtree, as (element, place), in an order that equal subtrees share."""
    if node.texts is None:
        node.texts, todo = [], [node]
        while todo:
            x = todo.pop()
            own = id(x)
            for place, y in enumerate(children(x)):
                if isinstance(y, str):
                    node.texts.append((own, place))
                else:
                    todo.append(y)
    return node.texts


def singles(node: Node) -> dict[str | int, int]:
    """Places of the children with text that equal no other child, by their text or digest."""
    if node.once is None:
        marks = [x.digest if y is None and x.size else y for x, y in zip(children(node), plain_texts(node), strict=True)]
        times = Counter(marks)
        node.once = {k: p for p, k in enumerate(marks) if k is not None and times[k] == 1}
    return node.once


def anchors(a: Node, b: Node) -> list[tuple[int, int]]:
    """Places of equal subtrees with text that the children of both nodes have once, as many as keep order."""
    x, y = children(a), children(b)
    if len(x) < 2 or len(y) < 2:
        return []
    own, other = singles(a), singles(b)
    common = own.keys() & other.keys()
    both = sorted((own[k], other[k]) for k in common if alike(x[own[k]], y[other[k]]))
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(both)
    for n, (_, q) in enumerate(both):  # the longest rising run
        k = bisect_left(ends, q)
        ends[k:k + 1], last[k:k + 1] = [q], [n]
        before[n] = last[k - 1] if k else -1
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(both[n])
        n = before[n]
    return out[::-1]


def match(a: Node, b: Node, same: list[tuple[int, int]], other: list[tuple[int, int]], memo: dict[tuple[int, int], int]) -> None:
    """Align two matched nodes and go down; same and other get the texts (node, place) whose partners are the same text, or another one."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if a.digest is not None and a.digest == b.digest:  # equal subtrees match node by node
            same += text_places(a)
            continue
        x, y = children(a), children(b)
        for p, q in aligned(a, b, memo):
            if isinstance(x[p], str):
                (same if plain_texts(a)[p] == plain_texts(b)[q] else other).append((id(a), p))
            else:
                todo.append((x[p], y[q]))


def aligned(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Places of partners among the children of two nodes."""
    x, y = children(a), children(b)
    if len(x) == len(y) == 1:
        return [(0, 0)] if alike(x[0], y[0]) else []
    found, at = [], (0, 0)
    for p, q in [*anchors(a, b), (len(x), len(y))]:
        u, v = x[at[0] : p], y[at[1] : q]
        i = 0
        while i < len(u) and i < len(v) and alike(u[i], v[i]):  # equal ends need no table
            i += 1
        j = 0
        while j < min(len(u), len(v)) - i and alike(u[-1 - j], v[-1 - j]):
            j += 1
        own = [(k, k) for k in range(i)] + [(len(u) - 1 - k, len(v) - 1 - k) for k in range(j)]
        mid_u, mid_v = u[i : len(u) - j], v[i : len(v) - j]
        if mid_u and mid_v:
            own += [(i + m, i + n) for m, n in best(mid_u, mid_v, memo)]
        found += [(at[0] + m, at[1] + n) for m, n in own]
        if p < len(x):
            found.append((p, q))
        at = (p + 1, q + 1)
    return found


def alike(x: Node | str, y: Node | str) -> bool:
    return isinstance(x, str) == isinstance(y, str) and (isinstance(x, str) or x.key == y.key)


def weight(x: Node | str, y: Node | str, memo: dict[tuple[int, int], int]) -> int:
    """Nodes of the greatest match of two trees, as simple tree matching counts them; texts count as leaves."""
    if not alike(x, y):
        return 0
    if isinstance(x, str):
        return 1
    known = memo.get((id(x), id(y)))
    if known is None:
        known = memo[(id(x), id(y))] = 1 + table(children(x), children(y), memo)[-1][-1]
    return known


def table(x: list, y: list, memo: dict[tuple[int, int], int]) -> list[list[int]]:
    rows = [[0] * (len(y) + 1)]
    for a in x:
        row, above = [0], rows[-1]
        for k, b in enumerate(y):
            row.append(max(row[-1], above[k + 1], above[k] + weight(a, b, memo)))
        rows.append(row)
    return rows


def best(x: list, y: list, memo: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    rows, out = table(x, y, memo), []
    i, j = len(x), len(y)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out


def nodes(root: Node) -> dict[int, Node]:
    found, todo = {}, [root]
    while todo:
        node = todo.pop()
        found[id(node)] = node
        todo += [x for x in node.children if not isinstance(x, str)]
    return found


def plain(text: str) -> str:
    return " ".join(text.split())


def template_votes(page: Node, references: list[Node]) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """Which text nodes of the page (element, place) are template, outside an article and inside.

    A reference that agrees with the page in over half of its text is a copy of it and tells nothing.
    """
    own = nodes(page)
    total = sum(len(x) for node in own.values() for x in children(node) if isinstance(x, str))
    votes: dict[tuple[int, int], list[int]] = {}
    counted = 0
    for ref in references:
        same: list[tuple[int, int]] = []
        other: list[tuple[int, int]] = []
        match(page, ref, same, other, {})
        if 2 * sum(len(children(own[node])[place]) for node, place in same) > total:
            continue
        counted += 1
        for k, yes in ((same, 1), (other, 0)):
            for text in k:
                vote = votes.setdefault(text, [0, 0])
                vote[0] += yes
                vote[1] += 1
    outside = {k for k, (yes, partners) in votes.items() if yes >= 2 or 2 * yes > partners}
    return outside, {k for k in outside if votes[k][0] >= max(2, -(-3 * counted // 4))}


def furniture(node: Node, inside: bool = False) -> bool:
    """Whether an element is no content; the heading part of an article (inside) is."""
    if node.tag in FURNITURE or node.tag == "header" and not inside:
        return True
    a = node.attrs
    if not a:
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    if inside:
        return any(OWN_NAMES.fullmatch(x) for x in a.get("class", "").split())
    names = f"{a.get('class', '')} {a.get('id', '')}"
    return bool(NAMES.search(names)) or bool(HEADS.search(names))


def named(node: Node) -> bool:
    """Whether class or id have a word that is used for furniture, or for a topic."""
    return bool(node.attrs) and node.tag not in ("article", "main") and bool(NAMES.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"))


def proven(node: Node, constant: set[tuple[int, int]]) -> bool:
    """Whether half of an element's text or more is template or in links."""
    total = told = 0
    todo = [(node, node.tag == "a")]
    while todo:
        x, link = todo.pop()
        for place, y in enumerate(children(x)):
            if isinstance(y, str):
                total += len(plain(y))
                told += len(plain(y)) if link or (id(x), place) in constant else 0
            else:
                todo.append((y, link or y.tag == "a"))
    return 2 * told >= total


def content_root(root: Node, constant: set[tuple[int, int]]) -> tuple[Node, set[int]]:
    """The smallest element that holds all articles (or else all main elements) with text that is neither template nor furniture, and the ids of these; the root where there is none: what is
    dropped outside the smallest element with all varying slots is template or furniture."""
    articles: list[Node] = []
    mains: list[Node] = []
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        role = node.attrs.get("role", "").lower()
        if node.tag == "article" or node.attrs.get("itemprop") == "articleBody" or role == "article":
            if shows(node, constant):
                articles.append(node)
            continue
        if not within and (node.tag == "main" or role == "main") and shows(node, constant):
            mains.append(node)
            within = True
        if not furniture(node, within):
            todo += [(x, within) for x in reversed(children(node)) if not isinstance(x, str)]
    parts = articles or mains
    if not parts:
        return root, set()
    paths = [path(x) for x in parts]
    common = paths[0]
    for other in paths[1:]:
        common = common[: next((k for k, (x, y) in enumerate(zip(common, other, strict=False)) if x is not y), min(len(common), len(other)))]
    return common[-1], {id(x) for x in parts}


def path(node: Node) -> list[Node]:
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out[::-1]


def shows(node: Node, constant: set[tuple[int, int]]) -> bool:
    """Whether there is text that is neither template nor under furniture."""
    todo = [node]
    while todo:
        x = todo.pop()
        for place, y in enumerate(children(x)):
            if isinstance(y, str):
                if (id(x), place) not in constant:
                    return True
            elif not furniture(y, True):
                todo.append(y)
    return False


def extract(page: Node, references: list[Node]) -> tuple[str, int, int]:
    """The main text, and the code points that the wrapper and the names dropped."""
    outer, inner = template_votes(page, references) if references else (set(), set())
    start, parts = content_root(page, inner)
    held = {id(x) for x in path(start)}
    blocks: list[str] = []
    line: list[str] = []
    dropped = [0, 0]

    def flush() -> None:
        text = plain("".join(line))
        if text:
            blocks.append(text)
        line.clear()

    # from the root, so that all that is dropped is counted; what lies outside the start is dropped like furniture. Ends of blocks are marked by None.
    todo: list[tuple[Node | None, bool, bool]] = [(page, False, False)]
    while todo:
        node, inside, named_ = todo.pop()
        if node is None:
            flush()
            continue
        if isinstance(node, str):
            line.append(node)
            continue
        inside = inside or id(node) in parts
        block = node.tag in BLOCKS
        if block:
            flush()
        later: list[tuple[Node | None, bool, bool]] = []
        outside = named_ or node is not start and id(node) in held
        place = -1
        for x in node.children:
            if isinstance(x, str):
                if x.strip():
                    place += 1
                    if (id(node), place) in (inner if inside else outer):
                        dropped[0] += len(plain(x))
                        continue
                    if outside:
                        dropped[1] += len(plain(x))
                        continue
                if not outside:
                    later.append((x, inside, False))
                continue
            place += 1
            if x.tag == "br" and not outside:
                later.append((" ", inside, False))
            elif x.tag not in UNSEEN:
                off = named_ or not (id(x) in parts or id(x) in held) and (outside or furniture(x, inside) or inside and named(x) and proven(x, inner))
                later.append((x, inside, off))
        todo += ([(None, inside, False)] if block else []) + later[::-1]
    flush()
    return "\n\n".join(blocks), *dropped


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def least_pages(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """host, h, page: the pages of the `most` least different hashes of each host in the task."""
    held: dict[str, dict[int, str]] = {}
    for batch in batches:
        for k, (host, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            own = held.setdefault(host, {})
            if h in own or len(own) == most and h > max(own):
                continue
            own[h] = batch.column(2)[k].as_py()
            if len(own) > most:
                del own[max(own)]
    rows = [(host, h, page) for host, own in held.items() for h, page in own.items()]
    for lo in range(0, len(rows), 1000):
        hosts, hashes, texts = zip(*rows[lo : lo + 1000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string())], names=["host", "h", "page"])


def main_text(pages: DataFrame, url: str = "url", html: str = "html", references: int = REFERENCES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with text, n_chars, n_template and n_named."""
    added = ["text", "n_chars", "n_template", "n_named"]
    names = [c for c in pages.columns if c not in added]
    source = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("page"))
    schema = source.drop("page", "host").schema.add("text", "string").add("n_chars", "long").add("n_template", "long").add("n_named", "long")
    at = len(names)
    shown = source.where(F.col("page").isNotNull()).select("host", F.xxhash64("page").alias("h"), "page")
    # the least hashes are pre-aggregated: a host is references + 1 rows a task
    firsts = shown.mapInArrow(lambda b: least_pages(b, references + 1), "host string, h bigint, page string").groupBy("host", "h").agg(F.min("page").alias("page"))
    ranked = firsts.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy("h"))).where(F.col("k") <= references + 1)
    wrapper = checkpoint(ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("k", "page"))).alias("r")).select("host", F.col("r.page").alias("refs")))
    size = wrapper.agg(F.sum(F.aggregate("refs", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    if size <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.refs for r in wrapper.toLocalIterator()})
        dealt = source
    else:
        # pages are sorted by host and stand behind the host's wrapper; a large host is dealt over several tasks that all get its wrapper
        shared = None
        share = wrapper.join(source.groupBy("host").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), "host")
        first = share.select(*[F.lit(None).cast(source.schema[f"c{i}"].dataType).alias(f"c{i}") for i in range(at)], "host", F.lit(None).cast("string").alias("page"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "refs")
        rest = source.join(share.select("host", "shares"), "host", "left").select(*[f"c{i}" for i in range(at)], "host", "page", F.coalesce(F.pmod(F.xxhash64("page"), "shares"), F.lit(0)).cast("int").alias("share"), F.lit(None).cast("array<string>").alias("refs"))
        dealt = first.unionByName(rest).withColumn("later", F.col("refs").isNull()).repartition("host", "share").sortWithinPartitions("host", "share", "later").drop("share", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Node] = {}
        held: tuple[str | None, list[str]] = (None, [])

        def tree(page: str) -> Node:
            root = parse(page)
            seal(root)
            return root

        for batch in batches:
            rows, took = [], []
            for k, (host, page) in enumerate(zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True)):
                if shared is None and (refs := batch.column(at + 2)[k].as_py()) is not None:
                    held = (host, refs)
                    trees.clear()
                    continue
                took.append(k)
                if not page:
                    rows.append(("", 0, 0))
                    continue
                refs = shared.value.get(host, []) if shared else held[1] if held[0] == host else []
                if len(trees) > 600:
                    trees.clear()
                for r in refs:
                    if r not in trees:
                        trees[r] = tree(r)
                sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * max(len(page), *map(len, refs), 1) // 2 + 1000))  # an element is three characters or more, and two calls
                rows.append(extract(tree(page), [trees[r] for r in refs if r != page][:references]))
            texts, told, named_ = ([r[k] for r in rows] for k in range(3))
            kept = batch.take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(at)), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(told, pa.int64()), pa.array(named_, pa.int64())], names=[f.name for f in schema])

    return dealt.mapInArrow(run, schema).toDF(*names, *added)

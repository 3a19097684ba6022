"""Main text of pages by a site style tree.

The DOMs of a host are merged: a style node is the path of element names and classes
from the root. Over the host's pages, each node has a presentation (the kinds of its
children) and a content (its own text). A node whose presentations and contents are the
same on page after page has low entropy and is taken as part of the site, not of the
page. Pages equal in all contents of their article count once. Of a node of low importance
only contents that repeat on different pages are cut, so that one page's own text stays.

What entropy cannot show is stated as an importance beforehand. Elements that say what they
are (``nav``, ``footer``, a class ``ad``...) have none, however often their text changes.
Headings of an ``article`` or ``main`` have all, and its text blocks the more the longer
their texts are, since near copies of an article repeat them; a short line that stands in
article after article is the site's. A class word counts whole: all its parts must be listed
words or neutral ones, and none a negation. Where no ``article`` or ``main`` stands elsewhere,
neither a name nor a form around one cuts it. A ``main`` whose own paragraphs stand beside
its articles is the article itself, and they are parts of it.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinneret.llm.common import bounded_batches, slices
from spinneret.session import written

# A node is judged from this many pages of its host on, and cut below this importance.
MIN_PAGES = 5
LOW = 0.2
# How much of a node's importance is that of its presentation.
OWN_SHARE = 0.1
# Words of a text block in an article that make it important whatever repeats it; fewer in proportion.
LONG_BLOCK = 50

# Hosts whose low nodes are broadcast, and nodes in all; more are joined by a shuffle.
_BROADCAST_NODES = 200_000

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>""")
_MARKER = re.compile(
    r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>]|$)""", re.I
)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math select".split())
# Inside a sentence: they neither end a block nor count as nodes.
_INLINE = frozenset(
    "b i em strong u s small sub sup font code kbd mark q cite abbr var tt big strike time data ins del bdi bdo samp "
    "dfn a span label".split()
)
# What a start tag ends when it is still open.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
}
_SCOPE = frozenset("html body table ul ol dl article section div main td th blockquote form".split())
_CELLS = frozenset(("td", "th", "table"))
_MAIN = frozenset(("article", "main"))
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody tr td th figure figcaption".split())
# Elements and class words that name what is not the article.
_OTHER = frozenset("nav aside footer form button dialog menu object canvas audio video head".split())
_OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead "
    "footer comment comments disqus replies share sharing social related widget toolbar pagination pager login signup "
    "search complementary contentinfo dialog alert".split()
)
_HEADERS = frozenset(("header", "topbar"))
# What may stand beside a listed word in a class word, and what turns it into its opposite.
_NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box button buttons center col column container content desktop fixed float form global "
    "google group header heading home icon icons inner item items label left level link links list main mobile off "
    "outer overlay page panel post posts primary right row secondary section side site skip slot small space sticky "
    "tertiary text title to top unit view wrap wrapper zone".split()
)
_NEGATIONS = frozenset("no not non without with has have".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p h1 blockquote pre".split())
_TEXT_ROOTS = frozenset(("html", "body", "article", "main"))


class Node:
    """An element: its style key, what stands in it, and whether it says it is not content."""

    __slots__ = ("name", "key", "parts", "other", "named", "path", "main")

    def __init__(self, name: str, key: str, parent: Node | None, other: bool, named: bool = False):
        self.name, self.key, self.other = name, key, other
        # Whether only its name, or that it is a form, says that it is not content.
        self.named = named
        self.parts: list[Node | str] = []
        self.main = name in _MAIN or (parent is not None and parent.main)
        above = parent.path if parent is not None else 0
        self.path = xxhash.xxh3_64_intdigest(key, above) & ((1 << 63) - 1)


def _listed(word: str, listed: frozenset[str]) -> bool:
    """Whether a word of a class, id or role names one of ``listed``."""
    parts = [x for x in re.split(r"[^a-z]+", word) if len(x) > 1]
    return (
        not listed.isdisjoint(parts)
        and _NEGATIONS.isdisjoint(parts)
        and all(x in listed or x in _OTHER_WORDS or x in _NEUTRAL_WORDS for x in parts)
    )


def _marked(name: str, rest: str, parent: Node) -> tuple[str, bool, bool]:
    """The style key of a start tag, whether it is not content, and whether only a name or a form says so."""
    words, hidden, label = set(), False, name
    if "=" in rest or "hidden" in rest:
        for m in _MARKER.finditer(rest):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
                hidden = True
            elif kind != "aria-hidden":
                words.update(value.split())
                if kind == "class":
                    label = f"{name}.{' '.join(sorted(value.split()))}"
    if name in _TEXT_ROOTS:
        return label, False, False
    sure = hidden or (name in _OTHER and name != "form") or (name == "header" and not parent.main)
    other = sure or name == "form" or any(_listed(x, _OTHER_WORDS) for x in words)
    other = other or (not parent.main and any(_listed(x, _HEADERS) for x in words))
    return label, other, other and not sure


def parse(page: str) -> Node:
    """The tree of a page. Any text is read, each character a bounded number of times."""
    root = _tree(page)
    _free(root)
    return root


def _free(root: Node) -> None:
    """Take back marks by name around the article, or else those of forms around all there is."""
    texts, forms = False, []
    for node in _walk(root):
        if node.name in _MAIN:
            return
        texts = texts or any(isinstance(x, str) and x.strip() for x in node.parts)
        forms += [x for x in node.parts if isinstance(x, Node) and x.named and x.name == "form"]
    above: dict[int, Node] = {}
    waiting, freed, found = [root], set(), False
    while waiting:
        node = waiting.pop()
        if node.name in _MAIN:
            found, up = True, above.get(id(node))
            while up is not None and id(up) not in freed:
                freed.add(id(up))
                up.other = False
                up = above.get(id(up))
        for x in node.parts:
            if isinstance(x, Node) and (x.named or not x.other):
                above[id(x)] = node
                waiting.append(x)
    if not found and not texts:
        for form in forms:
            form.other = False


def _tree(page: str) -> Node:
    root = Node("", "", None, False)
    stack, opened = [root], {"": 1}

    def close(name: str, scope: frozenset = frozenset()) -> None:
        if not opened.get(name):
            return
        for node in reversed(stack):
            if node.name == name:
                break
            if node.name in scope:
                return
        while True:
            node = stack.pop()
            opened[node.name] -= 1
            if node.name == name:
                return

    at = 0
    while True:
        start = page.find("<", at)
        if start < 0:
            stack[-1].parts.append(page[at:])
            return root
        if start > at:
            stack[-1].parts.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end < 0:
                return root
            at = end + 3
            continue
        tag = _OPEN.match(page, start)
        if not tag:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                if end < 0:
                    return root
                at = end + 1
            else:
                stack[-1].parts.append("<")
                at = start + 1
            continue
        rest = _REST.match(page, tag.end())
        if not rest:
            return root
        at, name = rest.end(), tag[2].lower()
        if name == "br":
            stack[-1].parts.append(" ")
        elif tag[1]:
            # Inline elements are open only where they are not content.
            close(name)
        elif name in _RAW:
            if not rest[0].endswith("/>"):
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                if not end:
                    return root
                closing = page.find(">", end.end())
                if closing < 0:
                    return root
                at = closing + 1
        else:
            key, other, named = _marked(name, rest[0][:-1], stack[-1])
            if name == "a":
                close("a", _CELLS)
            # Inside an inline element that is not content, those of its name are kept, as
            # the first end tag is that of the inner one.
            if name in _INLINE and not other and not opened.get(name) or name in _VOID and name != "hr":
                continue
            if name in _ENDS_P:
                close("p", _SCOPE)
            for sibling in _SIBLINGS.get(name, ()):
                close(sibling, _SCOPE - {"td", "th"} if name in ("tr", "td", "th", "tbody", "thead") else _SCOPE)
            node = Node(name, key, stack[-1], other, named)
            stack[-1].parts.append(node)
            if name not in _VOID and not rest[0].endswith("/>"):
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1


def _walk(root: Node) -> Iterator[Node]:
    waiting = [root]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += [x for x in node.parts if isinstance(x, Node) and not x.other]


def style_nodes(root: Node) -> list[tuple[int, int, int, int]]:
    """For each path of a page that could be cut: path, presentation, content, and how many
    words speak for its importance beforehand.

    Contents of different paths differ.
    """
    kinds: dict[int, list] = {}
    for parent in _walk(root):
        for node in parent.parts:
            if isinstance(node, Node) and not node.other and node.name not in ("html", "body"):
                children = [x.key for x in node.parts if isinstance(x, Node)]
                # How often a kind of child follows itself is not part of a presentation.
                shape = [k for i, k in enumerate(children) if not i or children[i - 1] != k]
                words = " ".join(x for x in node.parts if isinstance(x, str)).split()
                known = kinds.setdefault(node.path, [[], [], 0])
                known[0].extend(shape)
                known[1].append(" ".join(words))
                if node.main and node.name in _HEADINGS:
                    known[2] += LONG_BLOCK
                elif node.main and node.name in _TEXT_BLOCKS | _MAIN:
                    known[2] += len(words)
    digest = lambda x, seed: xxhash.xxh3_64_intdigest("\0".join(x), seed) & ((1 << 63) - 1)
    return [(path, digest(shape, 0), digest(text, path), words) for path, (shape, text, words) in kinds.items()]


def low_paths(root: Node, low: frozenset[int]) -> frozenset[int]:
    """The paths of a page whose content is one of ``low``."""
    return frozenset(path for path, _, content, _ in style_nodes(root) if content in low) if low else low


def _contents(root: Node) -> int:
    """Digest of all that a page could show, or of its article if it has one."""
    digest = xxhash.xxh3_64()
    for top in _articles(root):
        for node in _walk(top):
            for x in node.parts:
                if isinstance(x, str) and x.strip():
                    digest.update(" ".join(x.split()) + "\0")
    return digest.intdigest() & ((1 << 63) - 1)


def _articles(root: Node) -> list[Node]:
    """What a page's text is taken from: its articles, or else what is main, or else all of it.

    A main with paragraphs of its own beside its articles stands for them.
    """
    mains = [x for x in _walk(root) if x.name == "main"]
    found = [x for x in _walk(root) if x.name == "article"]
    for main in mains:
        waiting, articles, own = [main], [], False
        while waiting:
            node = waiting.pop()
            if node.name == "article":
                articles.append(node)
                continue
            own = own or (node.name in _PARAGRAPHS and any(isinstance(x, str) and x.strip() for x in node.parts))
            waiting += [x for x in node.parts if isinstance(x, Node) and not x.other]
        if own and articles:
            inside = {id(x) for x in articles}
            found = [x for x in found if id(x) not in inside] + [main]
    return found or mains or [root]


def main_text(root: Node, low: frozenset[int] = frozenset()) -> str:
    """The blocks of the article, one a line, without branches that are not content."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(html_.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    # _walk visits later siblings first, so the page's order is that of their starts.
    order: list[Node] = []
    inside = {id(x) for x in _articles(root)}
    waiting: list = [root]
    while waiting:
        node = waiting.pop()
        if id(node) in inside:
            order.append(node)
            continue
        waiting += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.other]
    for top in order:
        todo: list = [top]
        while todo:
            part = todo.pop()
            if part is None:
                end()
            elif isinstance(part, str):
                line.append(part)
            elif not part.other:
                if part.name not in _INLINE:
                    end()
                    todo.append(None)
                cut = part.path in low
                todo += [x for x in reversed(part.parts) if not (cut and isinstance(x, str))]
        end()
    return "\n".join(blocks)


def _host(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]*)", url or "")
    return found[1].rpartition("@")[2].lower() if found else ""


def _counted(pages: DataFrame) -> DataFrame:
    """``host, path, kind, value, count, words``: how many different pages of a host have a
    presentation (kind 0) or a content (kind 1) at a path, and their words beforehand.

    Pages are reduced to a row of digests before anything is shuffled, and nodes counted in
    each task first, so a host with any share of all pages is no hot key.
    """
    bounded_batches(pages.sparkSession)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows: list[tuple] = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                root = parse(page or "")
                found = style_nodes(root)
                if found:
                    rows.append((_host(url), _contents(root), *zip(*found, strict=True)))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    ["host", "page", "path", "shape", "content", "words"],
                )

    many = "array<long>"
    seen = (
        pages.select("url", "html")
        .mapInArrow(nodes, f"host string, page long, path {many}, shape {many}, content {many}, words {many}")
        .dropDuplicates(["host", "page"])
        .select("host", F.inline(F.arrays_zip("path", "shape", "content", "words")))
    )
    # Presentation and content are counted alike, as values of two kinds.
    return (
        seen.select("host", "path", "words", F.posexplode(F.array("shape", "content")).alias("kind", "value"))
        .groupBy("host", "path", "kind", "value")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("words").alias("words"))
    )


def _importance(counted: DataFrame) -> DataFrame:
    """``host, path, m, importance`` of the nodes on ``m`` different pages of a host.

    The entropy of a node's presentations, and of its contents, over the pages that have
    it is taken to the base of their number: 0 if all agree, 1 if all differ. A tenth of
    its importance is that of its presentation, the rest that of its content; what its
    words say beforehand is the least it has.
    """
    c = F.col("count")
    entropy = counted.groupBy("host", "path", "kind").agg(
        F.sum(c).alias("m"), F.sum(c * F.log(c)).alias("s"), F.sum("words").alias("words")
    ).withColumn("h", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(F.lit(1.0)))
    nodes = entropy.groupBy("host", "path").agg(
        F.max("m").alias("m"),
        F.max("words").alias("words"),
        F.max(F.when(F.col("kind") == 0, F.col("h"))).alias("shape"),
        F.max(F.when(F.col("kind") == 1, F.col("h"))).alias("content"),
    )
    seen = OWN_SHARE * F.greatest("shape", F.lit(0.0)) + (1 - OWN_SHARE) * F.greatest("content", F.lit(0.0))
    before = F.least(F.col("words") / (F.col("m") * LONG_BLOCK), F.lit(1.0))
    return nodes.select("host", "path", "m", F.greatest(seen, before).alias("importance"))


def importance(pages: DataFrame) -> DataFrame:
    """``host, path, m, importance`` of all style nodes of all hosts; see ``style_nodes``."""
    return _importance(_counted(pages))


def low_nodes(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """``host, low``: for each host, the repeated contents of its nodes of low importance.

    Each child is judged as a node of its own, so a branch goes as far as all of it is
    unimportant. Only nodes on ``min_pages`` different pages of the host or more are
    judged; pages with the same article are one.
    """
    counted = _counted(pages)
    low_ = _importance(counted).where((F.col("m") >= min_pages) & (F.col("importance") < low)).select("host", "path")
    repeated = counted.where((F.col("kind") == 1) & (F.col("count") > 1)).select("host", "path", "value")
    return repeated.join(low_, ["host", "path"]).groupBy("host").agg(F.collect_set("value").alias("low"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Null html counts as empty; a page without main text has an empty one. Pages without
    a host in their url, null included, are merged as one host. Ids are carried as they
    are, nulls and repeats included. Other columns are ignored, whatever their names.
    """
    nodes = written(low_nodes(pages, min_pages, low), "style-low")
    size = nodes.select(F.count(F.lit(1)), F.coalesce(F.sum(F.size("low")), F.lit(0))).first()
    nodes = nodes.withColumnRenamed("host", "_host")
    if size[0] + size[1] <= _BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    host = F.lower(
        F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#\s]*@)?([^/?#\s]*)", 1)
    )
    cut = pages.select("page_id", "url", "html", host.alias("_host")).join(nodes, "_host", "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = []
            for page, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True):
                root = parse(page or "")
                found.append(main_text(root, low_paths(root, frozenset(low or ()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(found, pa.string()),
                 pa.array([len(x) for x in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return cut.select("page_id", "url", "html", "low").mapInArrow(
        texts, "page_id long, url string, text string, n_chars long"
    )

"""Main text of web pages by composite text density.

A page is parsed into a tree without what is never article text (menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments: by element name or role).  A
word of class or id alone does not decide: what is named so stays where it holds an article or
most of the page's unlinked text, and prose inside an article stays where it is dense enough.
Every element gets a density: its characters per tag, adjusted by how
much of the text stands in links, relative to the body.  The subtree whose children's densities
sum highest is the main one.  The smallest density on its path to the body is a threshold that
parts beside that path must reach to be taken as well.  Article and main elements have a bonus: the
one around the main subtree is taken whole, it goes before an ancestor most of whose text stands in
such elements, and other ones need a part of the threshold only.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from honestpick.llm.text import text_pieces

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div
dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main
menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr",
                    "option", "optgroup", "legend"}
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",),
                  "td": ("table",), "th": ("table",), "tr": ("table",),
                  "option": ("select",)}
TOGETHER = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"),
            "tr": ("tr",)}
DROPPED = frozenset("""head nav footer aside form script style noscript template iframe object
svg math canvas audio video select button textarea input dialog menu title""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
NOISE = frozenset("""ad ads advert adverts advertisement sponsor sponsored promo nav navbar
navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar sidebars aside widget
widgets comment comments respond reply replies disqus cookie cookies consent gdpr notice notices
banner banners popup modal overlay newsletter subscribe signup login share sharing social related
recommended pagination pager""".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)"
                    r"(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
                   re.IGNORECASE)
SAYS_BESIDE = frozenset("has no with without".split())
# Share of the body's unlinked characters that speaks against a noise name, on the page and in an
# article; there the density, taken at the body's size, must also reach half the path's threshold.
PAGE_SHARE, ARTICLE_SHARE, PROSE = 0.5, 0.05, 0.5
STORY = 0.25            # part of the threshold that an article beside the main one must reach
COMPOUND, NAMED, COMMENT, ROLE = 1, 2, 3, 4         # how much speaks for noise

_WORD = re.compile(r"[A-Za-z]+")
_COMMENT = re.compile(r"(?:comment|reply)s?(?:[-_].*)?\Z")
_COMMENTS = frozenset("comment comments respond reply replies disqus".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags",
                 "density", "total", "dropped", "noise")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped, self.noise = tag, parent, dropped, 0
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def noise_of(tag: str, attributes: str, in_article: bool) -> int:
    """0, or how much role, class and id speak for noise; an article only where it is a comment
    itself.  A header inside an article is its own, and has-sidebar tells of what lies beside."""
    found = 0
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "role" and value in ROLES:
            return ROLE
        if name not in ("class", "id"):
            continue
        for token in value.split():
            if tag in ("article", "main"):
                if _COMMENT.match(token):
                    return COMMENT
                continue
            words = _WORD.findall(token)
            if not words or words[0] in SAYS_BESIDE:
                continue
            noisy = NOISE.intersection(words)
            if in_article:
                noisy -= {"header", "masthead"}
            if noisy & _COMMENTS:
                found = max(found, COMMENT)
            elif noisy:
                found = max(found, NAMED if len(words) == 1 else COMPOUND)
    return found


def headings(node: Node) -> list[Node]:
    """The h1 elements below a node."""
    out, todo = [], [node]
    while todo:
        for x in reversed(todo.pop().parts):
            if isinstance(x, Node):
                (out if x.tag == "h1" else todo).append(x)
    return out


def prune(root: Node) -> None:
    """Takes out noise, but not around an article: a class may name what lies beside it.

    Neither a node with most of the page's unlinked text (for a plain noise name: where no article
    has text), nor dense prose with a compound name inside an article, nor the h1 of an article.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.parts if isinstance(x, Node)]
    if not any(x.noise for x in order):
        return
    holds: set[int] = set()
    for node in reversed(order):
        p = node.parent
        if node.noise and id(node) not in holds:
            continue
        if p is not None and (node.tag in ("article", "main") or id(node) in holds):
            holds.add(id(p))
    measure(root)
    body = max(1, root.chars - root.link_chars)
    told = any(x.tag in ("article", "main") and not x.noise and x.chars for x in order)
    unsure, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.noise and id(node) not in holds:
            share = (node.chars - node.link_chars) / body
            inside = _inside(node, ("article", "main"))
            if inside and node.noise == COMPOUND and share >= ARTICLE_SHARE:
                unsure.append(node)
            elif not inside and share >= PAGE_SHARE and (
                    node.noise == COMPOUND or node.noise < ROLE and not told):
                node.noise = 0
            else:
                _take_out(node, inside)
                continue
        todo += [x for x in node.parts if isinstance(x, Node)]
    if unsure:
        limit = min(at_body_size(x, root) for x in body_path(measure(root)))
        for node in unsure:
            if at_body_size(node, root) < PROSE * limit:
                _take_out(node, True)
            else:
                node.noise = 0


def _take_out(node: Node, inside: bool) -> None:
    kept = headings(node) if inside and node.noise < COMMENT else []
    if kept:
        for x in kept:
            x.parent = node
        node.parts, node.noise = kept, 0
    else:
        node.parent.parts = [x for x in node.parent.parts if x is not node]


def parse(page: str) -> Node:
    """Tree below the body; text of dropped elements is left out.  Never fails: end tags without
    a start are ignored, open elements end with their parent."""
    root = Node("body", None)
    stack = [root]
    at = 0

    def close_to(i: int) -> None:
        del stack[i:]

    def text(s: str) -> None:
        if s and not stack[-1].dropped:
            stack[-1].parts.append(entities.unescape(s))

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close_to(i)
                    break
            continue
        if tag in ("html", "body"):
            if tag == "body":           # an unclosed head ends here
                close_to(1)
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close_to(i)
                    break
                if stack[i].tag in ("td", "th", "table", "button", "object"):
                    break
        if tag in CLOSED_BY_SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in TOGETHER.get(tag, (tag,)):
                    close_to(i)
                    break
                if stack[i].tag in CLOSED_BY_SAME[tag]:
                    break
        top = stack[-1]
        in_article = any(x.tag in ("article", "main") for x in stack)
        node = Node(tag, top, top.dropped or tag in DROPPED
                    or (tag == "header" and not in_article))
        node.noise = noise_of(tag, m[3], in_article) if m[3] else 0
        if not node.dropped:
            top.parts.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        stack.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            text(page[at:end.start() if end else n])
            at = end.start() if end else n
    prune(root)
    return root


def measure(root: Node) -> list[Node]:
    """All nodes, parents first, with their counts, densities and sums of child densities."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = 0.0
        todo += [x for x in reversed(node.parts) if isinstance(x, Node)]
    for node in reversed(order):
        node.chars += sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        if node.tag == "a":
            node.link_chars = node.chars
            node.link_tags += 1
        if node.parent is not None:
            p = node.parent
            p.chars += node.chars
            p.tags += node.tags + 1
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags
    body_share = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        node.density = density_of(node, body_share)
        if node.parent is not None:
            node.parent.total += node.density
    return order


def density_of(node: Node, body_share: float, times: float = 1.0) -> float:
    """Composite density of the node as if its text stood there so many times."""
    c, t, linked = node.chars * times, max(1, node.tags) * times, node.link_chars * times
    if not c:
        return 0.0
    lc, lt = max(1, linked), max(1, node.link_tags * times)
    base = math.log(c / max(1, c - linked) * linked + body_share * c + math.e)
    return c / t * math.log(max(1.0, c * t / (lc * lt)) + 1) / math.log(base + 1)


def at_body_size(node: Node, root: Node) -> float:
    """Density that does not fall because the node is shorter than the body."""
    return density_of(node, root.link_chars / max(1, root.chars),
                      root.chars / max(1, node.chars))


def body_path(nodes: list[Node]) -> list[Node]:
    """The subtree whose children's densities sum highest, and its way to the body."""
    places = [x for x in nodes if x.chars and x.tag in BLOCK and x.total > 0] or nodes[:1]
    path = [max(places, key=lambda x: x.total)]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    return path


def main_parts(root: Node) -> set[int]:
    """ids of the nodes whose subtrees make up the main text."""
    nodes = measure(root)
    outer = [x for x in nodes if x.tag in ("article", "main")
             and not _inside(x, ("article", "main")) and x.chars]
    path = body_path(nodes)
    around = [i for i, x in enumerate(path) if x.tag in ("article", "main")]
    if around:
        path = path[around[-1]:]
    else:
        held = [x for x in outer if path[0] in _above(x)]
        best = path[0]
        if held and 2 * sum(x.chars - x.link_chars for x in held) > best.chars - best.link_chars:
            clear = [x for x in held if not any(y.noise for y in _above(x))]
            best = max(clear or held, key=lambda x: x.total)
            path = [best, *_above(best)]
    on_path = {id(x) for x in path}
    threshold = min(x.density for x in path)
    taken = {id(path[0])}
    for node in path[1:]:
        taken |= {id(x) for x in node.parts if isinstance(x, Node) and x.tag in BLOCK
                  and id(x) not in on_path and x.chars and not x.noise
                  and x.density >= threshold}
    limit = min(at_body_size(x, root) for x in path)
    if path[0].tag in ("article", "main"):
        limit *= STORY
    # an article in what is named as noise is a comment or a teaser
    taken |= {id(x) for x in outer if id(x) not in on_path and at_body_size(x, root) >= limit
              and not any(y.noise and id(y) not in on_path for y in [x, *_above(x)])}
    return taken


def _above(node: Node) -> list[Node]:
    out = []
    while node.parent is not None:
        node = node.parent
        out.append(node)
    return out


def _inside(node: Node, tags: tuple[str, ...]) -> bool:
    while node.parent is not None:
        node = node.parent
        if node.tag in tags:
            return True
    return False


def blocks(root: Node, taken: set[int]) -> list[str]:
    """Texts of the blocks in page order, white space single, empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if words := " ".join("".join(line).split()):
            out.append(words)
        line.clear()

    todo: list[tuple[Node | str | None, bool]] = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                line.append(node)
        else:
            inside = inside or id(node) in taken
            if node.tag in BLOCK:
                flush()
                todo.append((None, inside))
            elif node.tag == "br":
                line.append(" ")
            todo += [(x, inside) for x in reversed(node.parts)]
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return "\n".join(blocks(root, main_parts(root)))


def _extract(batches):
    for batch in batches:
        last = batch.num_columns - 1
        for i, pages in text_pieces(batch.column(last), rows=200):
            found = [main_text(p) for p in pages]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(i, len(pages)) for c in range(last)],
                 pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                [*batch.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row, whatever its html.

    Blocks are joined by one newline; references are decoded, white space in a block is single.
    Null, empty or text-free html gives an empty text; equal rows are treated each; other columns
    are not read.
    """
    slim = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
                        F.col(f"`{html}`").cast("string").alias("html"))
    kinds = {c: slim.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return slim.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, "
                           "text string, n_chars bigint")

"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page is parsed into a tree; the trees of a host are
aligned by simple tree matching and merged into one template tree, in which a node knows on how
many pages it stood, whether its text was the same on all of them, and how much text and link
text it held. Nodes whose text is constant over pages are template, slots whose text varies are
content, unless the template shows the slot to be navigation, a form, a notice or the like.
Where no element is marked as the main part, it is the node that holds nearly all text of the
host's pages outside links.

What counts as constant: on a host with ``SUPPORT`` pages or more, a text on ``CONSTANT`` of the pages
that have its place (a text on less than ``CONSTANT - 1 / SPARE`` of them never does); on a host with 2 to
``SUPPORT - 1`` pages, a text of at most ``SHORT`` characters on all of them, if all pages differ and at most half
of what they say is constant. One page alone has no constant text.

Scale. A task merges the pages it reads into one template per host, so a host with a third of
all pages sends one small tree per task; these are merged ``FAN`` at a time, in as many rounds as
that takes. Runs of equal siblings are one template node, and a node counts a number of texts that
follows from one page, so a template does not grow with the pages. Wrappers, which hold only the
constant texts, come back to the pages by a join on the host.
"""

from __future__ import annotations

import html
import json
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import map_rows
from canopy.session import materialize

#: Pages of a host from which nearly constant text is template; on fewer it must be short and on all.
SUPPORT = 8
SHORT = 200
#: Share of the pages with the same text at the same place from which a text counts as constant.
CONSTANT = 0.9
#: Texts that a template node counts, as a multiple of those of the page that has most at its place. What is
#: left out takes at most this fraction of the pages off a count.
SPARE = 10
#: Share of the text outside links that the main part holds where none is marked.
MASS = 0.7
#: Trees merged by one task, and texts gathered by one before it passes its trees on.
FAN = 64
GATHERED = 1_000_000

# Element names of HTML (fixed values of the standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold main text.
ASIDE = frozenset("head nav header footer aside form button input menu dialog canvas audio video".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that name something other than main text.
_SIGNS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|"
    r"subscribe|signup|login|menu|nav\w*|breadcrumbs?|side-?bar|footer|masthead|site-?header|page-?header|comment\w*|"
    r"replies|disqus|respond|share|sharing|related|recommend\w*|pagination|pager|toolbar)(?:$|[\s_-])"
    r"|(?:^|\s)(?:alert|aside|discussion|readers?|social|widget|search)(?:$|\s)",
    re.I,
)
#: Words that may as well name a part of an article: inside the main part only constant text under them is template.
_HINTS = re.compile(
    r"(?:^|[\s_-])(?:alert|aside|foot|discussion|reader\w*|social|widget|search|skip|copyright|legal|disclaimer|tags?)(?:$|[\s_-])", re.I
)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content)(?:$|[\s_-])", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_CLOSED_BY = {  # an open element is ended by the start of one of these
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr"
        " main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
_LISTS = frozenset("ul ol dl table menu select".split())


class Node:
    """An element; ``parts`` are its texts and elements in order."""

    __slots__ = ("tag", "label", "parts", "hidden", "doubtful", "main")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag = tag
        self.parts: list[str | Node] = []
        found = {}
        if attributes and not attributes.isspace():
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), a or b or c)
        names = " ".join(found[k] for k in ("class", "id", "role") if found.get(k))
        style = found.get("style", "").replace(" ", "").lower()
        self.hidden = (
            tag in ASIDE or bool(names and _SIGNS.search(names)) or "hidden" in found or "display:none" in style
            or found.get("aria-hidden") == "true"
        )
        self.doubtful = not self.hidden and bool(names and _HINTS.search(names))
        self.main = tag in ("article", "main") or bool(names and _MAIN.search(names)) or "itemprop" in found and found["itemprop"] == "articleBody"
        # Ids and numbered classes tell pages apart, so only what they say of the element is part of its label.
        plain = [c for c in (found.get("class") or "").split() if not any(map(str.isdigit, c))]
        self.label = " ".join([tag + "!" * self.hidden + "?" * self.doubtful + "+" * self.main, *plain])

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def parse(page: str | None) -> Node:
    """Tree of a page: unclosed elements end where the standard lets them, raw elements hold no elements."""
    root = Node("#page")
    stack, at = [root], 0
    text = page or ""
    lowered = None
    while m := _TAG.search(text, at):
        if m.start() > at:
            stack[-1].parts.append(text[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(html.escape(m[0][9:-3]))
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in _LISTS and tag in ("li", "dt", "dd", "p"):
                    break
            continue
        _close_implied(stack, tag)
        node = Node(tag, m[3])
        stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW and tag not in ("object", "svg", "math", "select", "noscript", "template"):
            lowered = lowered if lowered is not None else text.lower()
            end = lowered.find(f"</{tag}", at)
            stop = len(text) if end < 0 else end
            node.parts.append(text[at:stop])
            close = text.find(">", stop)
            at = len(text) if close < 0 else close + 1
        elif not m[3].endswith("/") or tag not in ("svg", "path"):
            stack.append(node)
    if at < len(text):
        stack[-1].parts.append(text[at:])
    return root


def _close_implied(stack: list[Node], tag: str) -> None:
    """Ends the paragraph, list item or cell that the start of ``tag`` ends, and inline elements within it."""
    for k in range(len(stack) - 1, 0, -1):
        open_tag = stack[k].tag
        if tag in _CLOSED_BY.get(open_tag, ()):
            del stack[k:]
            if open_tag == "p" or tag not in ("tr",):
                return
            continue
        if open_tag not in INLINE and not (open_tag in ("td", "th") and tag == "tr"):
            return


def clean(text: str) -> str:
    """Character references decoded, white space turned into single blanks, trimmed."""
    return " ".join(html.unescape(text).split())


def _flat(node: Node) -> Iterator[str | Node]:
    """Texts and blocks of a node in order; inline elements are dissolved, a line break is a blank."""
    for part in node.parts:
        if isinstance(part, str):
            yield part
        elif part.tag == "br":
            yield part
        elif part.tag in INLINE and not part.hidden:
            yield from _flat(part)
        else:
            yield part


def own_text(node: Node) -> str:
    """The text of a node's own blocks, without that of block elements below it."""
    return clean("".join(p if isinstance(p, str) else " " for p in _flat(node)))


def block_children(node: Node) -> list[Node]:
    return [p for p in _flat(node) if isinstance(p, Node) and p.tag != "br"]


# A template node: label (l), pages it stood on (p), nodes it stood for (n), its most usual texts as
# hash and length with the pages that had them (t), what a count may lack (o), texts of the page with most (s),
# the most usual text of the whole subtree and its pages (w, v), characters of text (c) and of link text (a),
# whether its name hides it (b), might (z) or marks main text (m), children (k).
Template = dict


def _link_chars(node: Node) -> int:
    total = 0
    for part in node.parts:
        if isinstance(part, Node) and part.tag in INLINE:
            total += len(clean(_all_text(part))) if part.tag == "a" else _link_chars(part)
    return total


def _all_text(node: Node) -> str:
    return "".join(p if isinstance(p, str) else _all_text(p) for p in node.parts)


def template_of(node: Node) -> Template:
    """One page's tree as a template; runs of siblings with the same label are matched into one node."""
    text = own_text(node) if not node.hidden or node.tag not in RAW else ""
    children: list[Template] = []
    for child in block_children(node):
        if child.tag in RAW:
            continue
        made = template_of(child)
        if children and children[-1]["l"] == made["l"]:
            children[-1] = _fold(children[-1], made)
        else:
            children.append(made)
    below = zlib.crc32(" ".join([str(zlib.crc32(text.encode())), *(str(k["w"]) for k in children)]).encode())
    texts = {f"{zlib.crc32(text.encode())}:{len(text)}": 1} if text else {}
    return {
        "l": node.label, "p": 1, "n": 1, "t": texts, "o": 0, "s": len(texts), "w": below, "v": 1, "c": len(text),
        "a": _link_chars(node), "b": node.hidden, "z": node.doubtful, "m": node.main, "k": children,
    }


def _fold(a: Template, b: Template) -> Template:
    """Siblings of one page as one node that stands for both."""
    both, texts = zlib.crc32(f"{a['w']} {b['w']}".encode()), a["t"] | b["t"]
    return a | {
        "n": a["n"] + b["n"], "t": texts, "s": len(texts), "w": both, "v": 1, "c": a["c"] + b["c"], "a": a["a"] + b["a"],
        "k": _align(a["k"], b["k"], _fold),
    }


def match_size(a: Template, b: Template) -> int:
    """Simple tree matching: the most pairs of nodes with equal labels that keep order and parents."""
    if a["l"] != b["l"]:
        return 0
    return 1 + (_table(a["k"], b["k"])[-1][-1] if a["k"] and b["k"] else 0)


def _table(a: list[Template], b: list[Template]) -> list[list[int]]:
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + match_size(x, y))
    return size


def _align(a: list[Template], b: list[Template], join) -> list[Template]:
    """Children of two matched nodes: matched pairs joined, the others kept in order."""
    if [x["l"] for x in a] == [y["l"] for y in b]:
        return [join(x, y) for x, y in zip(a, b)]
    size = _table(a, b)
    i, j, out = len(a), len(b), []
    while i and j:
        if size[i][j] == size[i - 1][j]:
            i -= 1
            out.append(a[i])
        elif size[i][j] == size[i][j - 1]:
            j -= 1
            out.append(b[j])
        else:
            i, j = i - 1, j - 1
            out.append(join(a[i], b[j]))
    return a[:i] + b[:j] + out[::-1]


def merge(a: Template, b: Template) -> Template:
    """Two templates of one host as one."""
    most = max(a["s"], b["s"])
    texts, lacking = _fewer({k: a["t"].get(k, 0) + b["t"].get(k, 0) for k in a["t"] | b["t"]}, SPARE * most)
    w, v = _usual(a["w"], a["v"], b["w"], b["v"])
    return a | {
        "p": a["p"] + b["p"], "n": a["n"] + b["n"], "t": texts, "o": a["o"] + b["o"] + lacking, "s": most, "w": w, "v": v, "c": a["c"] + b["c"], "a": a["a"] + b["a"],
        "k": _align(a["k"], b["k"], merge),
    }


def _fewer(texts: dict[str, int], most: int) -> tuple[dict[str, int], int]:
    """The ``most`` most frequent texts; the count of the first one left out is taken off all, and returned.

    What is taken off in all stays below the texts counted in, over ``most``.
    """
    if len(texts) <= most:
        return texts, 0
    off = sorted(texts.values(), reverse=True)[most]
    return {k: n - off for k, n in texts.items() if n > off}, off


def _usual(x: int | None, n: int, y: int | None, m: int) -> tuple[int | None, int]:
    """The more usual of two texts and its pages; a text on most pages of a host never loses its count."""
    if x == y:
        return x, n + m
    return (x, n) if (n, x or 0) >= (m, y or 0) else (y, m)


def _is_link_list(t: Template) -> bool:
    """A subtree that holds text in links only, more than one."""
    text, links, nodes = _sums(t)
    return nodes > t["p"] and links > 0.8 * text > 0


def _sums(t: Template) -> tuple[int, int, int]:
    text, links, nodes = t["c"], t["a"], t["n"]
    for k in t["k"]:
        a, b, c = _sums(k)
        text, links, nodes = text + a, links + b, nodes + c
    return text, links, nodes


def _heading(t: Template) -> bool:
    return t["l"].split()[0].rstrip("!?+") in HEADINGS


def _marks_main(t: Template) -> bool:
    return not t["b"] and (t["m"] and _sums(t)[0] > 0 or any(map(_marks_main, t["k"])))


def _plain(t: Template) -> int:
    """Characters of text outside links, and outside parts that are named as something else."""
    return 0 if t["b"] else t["c"] - t["a"] + sum(map(_plain, t["k"]))


def _main_by_mass(page: Template) -> Template | None:
    """The innermost single element that holds ``MASS`` of a host's text, headings beside it included."""
    node = page
    while node["k"]:
        best = max(node["k"], key=_plain)
        beside = any(_heading(k) for k in node["k"] if k is not best and not k["b"])
        if beside or best["n"] > best["p"] or best["p"] < CONSTANT * page["p"] or _plain(best) < MASS * _plain(page):
            break
        node = best
    inside = page["p"] >= SUPPORT and node["l"].split()[0].rstrip("!?+") not in ("#page", "html", "body")
    return node if inside and node["k"] else None


def _constant(t: Template, pages: int) -> list[tuple[int, int]]:
    """(hash, length) of the texts that are constant at a place of a host with so many pages."""
    few = pages < SUPPORT
    if t["p"] < (pages if few else SUPPORT):
        return []
    texts = [(int(h), int(size), n) for (h, size), n in ((k.split(":"), n) for k, n in t["t"].items())]
    if few:
        return [(h, size) for h, size, n in texts if n == pages and size <= SHORT]
    return [(h, size) for h, size, n in texts if n + t["o"] >= CONSTANT * t["p"]]


def _varies(t: Template) -> bool:
    """Whether pages differ in this part; where most are copies, sameness tells nothing."""
    if t["p"] >= SUPPORT:
        return t["v"] < 0.5 * t["p"]

    def same(k: Template) -> int:
        return sum(size for _, size in _constant(k, t["p"])) + sum(map(same, k["k"]))

    return t["p"] > 1 and t["v"] == 1 and 2 * same(t) * t["p"] <= _sums(t)[0]


def decide(page: Template) -> Template:
    """The wrapper: what every template node is.

    ``d``: hashes of texts that are template, as they are constant over pages while the main part or page
    they lie in is not; ``x``: a list of links; ``b``: named as something else than main text; ``z``: perhaps;
    ``m``: the main part.
    """
    return _decided(page, None if _marks_main(page) else _main_by_mass(page), page, _varies(page), False)


def _decided(t: Template, found: Template | None, whole: Template, varies: bool, hidden: bool) -> Template:
    hidden = hidden or t["b"]
    main = t is found or t["m"] and not hidden and _sums(t)[0] > 0
    if main:
        whole, varies = t, _varies(t)
    constant = [h for h, _ in _constant(t, whole["p"])] if varies else []
    return {
        "l": t["l"], "d": constant, "x": _is_link_list(t), "b": t["b"], "z": t["z"], "m": main,
        "k": [_decided(k, found, whole, varies, hidden) for k in t["k"]],
    }


def extract(page: Node, wrapper: Template) -> str:
    """Blocks of main text in page order, one per line.

    The page is aligned with its host's wrapper. Kept are the slots of the main part that are not
    template; on a page that has nothing in a main part, those of the whole page that are neither
    template, nor lists of links, nor named as something else.
    """
    blocks: list[str] = []
    _collect(page, wrapper, False, True, blocks)
    if not blocks:
        _collect(page, wrapper, False, False, blocks)
    return "\n".join(blocks)


def _collect(node: Node, wrapper: Template, inside: bool, marked: bool, blocks: list[str]) -> None:
    inside = inside or wrapper["m"]
    keep = inside or not marked
    if keep and wrapper["d"]:
        keep = zlib.crc32(own_text(node).encode()) not in wrapper["d"]
    children = block_children(node)
    matched = iter(_matched(children, wrapper["k"]))
    run: list[str] = []

    def flush() -> None:
        if keep and (text := clean("".join(run))):
            blocks.append(text)
        run.clear()

    for part in _flat(node):
        if isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        else:
            flush()
            below = next(matched)
            if below["b"] and not _article_header(part, inside) or (below["x"] or below["z"]) and not inside:
                continue
            _collect(part, below, inside, marked, blocks)
    flush()


def _matched(children: list[Node], nodes: list[Template]) -> list[Template]:
    """The wrapper node of each child: equal labels in order, several siblings to one node.

    A child that has none is judged by its own name.
    """
    out, at = [], 0
    for child in children:
        places = [*range(at, len(nodes)), *range(at)]
        found = next((k for k in places if nodes[k]["l"] == child.label), None)
        if found is None:
            out.append({
                "l": child.label, "d": [], "x": False, "b": child.hidden, "z": child.doubtful, "m": child.main and not child.hidden, "k": [],
            })
        else:
            out.append(nodes[found])
            at = max(at, found)
    return out


def _article_header(node: Node, inside: bool) -> bool:
    """A header inside the main part that holds its heading."""
    return inside and node.tag == "header" and any(k.tag in HEADINGS for k in node.children)


def host(url: Column) -> Column:
    """Lower-cased host of an address; the empty text if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, template) as JSON: the merged tree of every host."""

    def partial(batches: Iterator[dict]) -> Iterator[dict]:
        made: dict[str, Template] = {}
        gathered = 0
        for batch in batches:
            for h, text in zip(batch["_host"], batch["_page"]):
                if text:
                    new = template_of(parse(text))
                    gathered += _nodes(new)
                    made[h] = merge(made[h], new) if h in made else new
                if gathered > GATHERED:
                    yield _rows(made)
                    made, gathered = {}, 0
        if made:
            yield _rows(made)

    def together(table: pa.Table) -> pa.Table:
        trees = [json.loads(t) for t in table["template"].to_pylist()]
        # By size and text, so that the order in which rows arrive does not matter.
        trees.sort(key=lambda t: (-t["p"], json.dumps(t)))
        whole = trees[0]
        for t in trees[1:]:
            whole = merge(whole, t)
        return pa.table({
            "host": table["host"][:1].cast(pa.string()), "part": table["part"][:1].cast(pa.int32()), "template": pa.array([json.dumps(whole)], pa.string()),
        })

    read = pages.select(host(F.col(url)).alias("_host"), F.col(page).alias("_page"))
    parts = map_rows(read, "host string, template string", partial).withColumn("part", F.spark_partition_id())
    parts, _ = materialize(parts, "partial-templates")
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        most = math.ceil(most / FAN)
        slices = F.pmod("part", F.lit(most)).alias("_slice")
        parts = parts.groupBy("host", slices).applyInArrow(together, "host string, part int, template string")
        if most > 1:
            parts, _ = materialize(parts, "partial-templates")
            most = parts.groupBy("host").count().agg(F.max("count")).first()[0]
    return parts.select("host", "template")


def _rows(made: dict[str, Template]) -> dict:
    return {"host": list(made), "template": [json.dumps(t) for t in made.values()]}


def _nodes(t: Template) -> int:
    """Nodes and texts of a template."""
    return 1 + len(t["t"]) + sum(map(_nodes, t["k"]))


def wrappers(learned: DataFrame) -> DataFrame:
    """(host, template) with the wrapper's decisions in the place of the trees."""

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"host": batch["host"], "template": [json.dumps(decide(json.loads(t))) for t in batch["template"]]}

    return map_rows(learned, "host string, template string", task)


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", page: str = "html") -> DataFrame:
    """Columns ``keep`` with ``text`` and ``n_chars`` for every page.

    A null or empty page has an empty text. Pages without a host in their address share one
    template. The template of a host is the same whatever rows repeat, but for its counts.
    """
    learned, _ = materialize(wrappers(templates(pages, url, page)), "templates")
    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep) + ", text string, n_chars long"

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        known: dict[str, Template] = {}
        for batch in batches:
            texts = []
            for h, template, text in zip(batch["_host"], batch["_template"], batch["_page"]):
                if not text:
                    texts.append("")
                    continue
                if h not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[h] = json.loads(template)
                texts.append(extract(parse(text), known[h]))
            yield {k: batch[k] for k in keep} | {"text": texts, "n_chars": [len(t) for t in texts]}

    read = pages.select(*keep, host(F.col(url)).alias("_host"), F.col(page).alias("_page"))
    joined = read.join(learned.select(F.col("host").alias("_host"), F.col("template").alias("_template")), "_host", "left")
    return map_rows(joined.select(*keep, "_host", "_template", "_page"), schema, task)

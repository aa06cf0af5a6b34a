"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page.  A line's length is
its text outside links; what stands in containers that never hold an article
(menus, headers, footers, sidebars, notices, adverts, forms, comments) counts as
length 0.  Lengths are summed over sliding windows of lines.  Text starts at a surge
(a window over the surge level) and ends at a dive (a window of nothing); lines
between a surge and its dive are kept, and all blocks of a container stay if one does.

In a page that declares its article (``article`` or ``main``), lines outside it count nothing, those inside in full, links
included, and any text is a surge, so an article of any length, with lists of links, stays whole between its dives.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import table

#: Lines in a window, the surge level in characters, and its largest share of the highest window.
WINDOW, SURGE, SHARE = 3, 86, 0.5

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|/|$|=)|aria-hidden\s*=\s*["']?true)""", re.I)
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp")}
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
_CONTAINERS = _BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6 dt dd li option tr td th thead tbody tfoot caption".split()) | frozenset(
    "button object svg canvas audio video map math label span".split()
)
_APART = frozenset("nav footer aside menu dialog select button object svg canvas audio video map head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names of containers that are not the article, and words that may stand beside them in a name.
_NAMES = re.compile(
    r"(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|aside|footer|foot|masthead|banner|topbar|ads?|advert\w*|adsbygoogle|adbox"
    r"|sponsor(?:ed)?|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login"
    r"|share|sharing|social|related|recommend(?:ed|ations)?|comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|pagination|pager|toolbar"
    r"|widgets?|search|form)",
    re.I,
)
_BESIDE = frozenset("site page main global primary secondary top bottom left right header head bar box area list wrap wrapper container section block inner outer content links posts buttons".split())
_HEADS = re.compile(r"(?:^|[\s_-])(?:header|page-?head|site-?head)(?=$|[\s_-])", re.I)


def _names_apart(value: str) -> bool:
    """Whether a class or id is one of the names, by itself or only with words beside it; category-social and related-work aren't."""
    for name in value.split():
        parts = [x for x in re.split("[_-]", name) if x]
        named = [bool(_NAMES.fullmatch(x)) for x in parts]
        if any(named) and all(n or x.lower() in _BESIDE for n, x in zip(named, parts, strict=True)):
            return True
    return False


class _Box:
    """An open or closed container."""

    __slots__ = ("name", "parent", "apart", "head", "form", "declared", "size")

    def __init__(self, name, parent, attributes):
        self.name, self.parent, self.size = name, parent, 0
        self.declared = name in ("article", "main")
        self.apart, self.head, self.form = name in _APART, name == "header", name in ("form", "search")
        if attributes and name not in ("html", "body"):
            named = False
            for kind, value in _NAMED.findall(attributes):
                value = value.strip("\"'")
                if kind.lower() == "role":
                    roles = value.lower().split()
                    self.declared |= "main" in roles or "article" in roles
                    self.form |= "search" in roles or "form" in roles
                    self.apart |= not {*roles}.isdisjoint(_ROLES - {"search", "form"})
                elif name != "main":
                    self.head |= name != "article" and bool(_HEADS.search(value))
                    named |= _names_apart(value)
            self.apart |= named and not self.declared
            self.apart |= name != "main" and bool(_HIDDEN.search(attributes))


def _lines(page: str) -> tuple[list[tuple[str, int, _Box, bool]], list[_Box]]:
    """(text, characters outside links, container, is a heading) for each block, and all containers."""
    root = _Box("", None, "")
    boxes, stack, out, parts, opened = [root], [root], [], [], Counter()
    links = linked = at = 0
    heading = False

    def flush():
        nonlocal linked, heading
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, max(0, len(text) - linked), stack[-1], heading))
            stack[-1].size += len(text)
        parts.clear()
        linked, heading = 0, False

    def add(text):
        nonlocal linked
        text = entities.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None and m[5] is None:
            continue
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCKS:
            flush()
            links = 0
            heading = not closing and len(name) == 2 and name[0] == "h" and name != "hr"
        if closing:
            if name == "a":
                links = 0
            elif opened[name]:
                flush()
                while opened[name]:
                    last = stack.pop().name
                    opened[last] -= 1
                    if last == name:
                        break
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.start() if end else len(page)
        elif name == "a":
            links = 1
        elif name in _CONTAINERS and not attributes.endswith("/"):
            if name == "main":
                while opened["nav"]:  # a menu that was never closed
                    opened[stack.pop().name] -= 1
            box = _Box(name, stack[-1], attributes)
            if box.apart or name not in ("label", "span"):
                flush()
            boxes.append(box)
            stack.append(box)
            opened[name] += 1
    if at < len(page):
        add(page[at:])
    flush()
    return out, boxes


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by two line feeds; '' for null, empty and textless pages."""
    if not page:
        return ""
    lines, boxes = _lines(page)
    if not lines:
        return ""
    total = sum(b.size for b in boxes)
    within: dict[int, int] = {}
    for b in reversed(boxes):  # children stand after their parents
        within[id(b)] = within.get(id(b), 0) + b.size
        if b.parent is not None:
            within[id(b.parent)] = within.get(id(b.parent), 0) + within[id(b)]
    holds = {id(b) for b in boxes if b.declared}
    state: dict[int, tuple[bool, bool, bool]] = {}
    for b in boxes:  # (apart, declared, in a header)
        apart, declared, head = state[id(b.parent)] if b.parent is not None else (False, False, False)
        # a form around the whole page is the page, not a form
        form = b.form and 2 * within[id(b)] < total
        state[id(b)] = (apart or b.apart or form, declared or b.declared, b.head or head and not b.declared)
    declared_text = any(state[id(box)][1] and not state[id(box)][0] for _, _, box, _ in lines) if holds else False

    def weight(text: str, free: int, box: _Box, heading: bool) -> int:
        """What a line counts: nothing in what is apart or outside a declared article, all of its text inside one, else its text outside links."""
        apart, declared, head = state[id(box)]
        if apart or head and not (declared and heading) or declared_text and not declared:
            return 0
        return len(text) if declared_text else free

    sizes = [weight(*x) for x in lines]
    # a declared article may be short: any text of it is a surge
    kept = set(between_surge_and_dive(sizes, 1 if declared_text else None))
    if not declared_text:
        # short blocks and links beside kept ones, in the same container, stay
        beside = {id(lines[j][2]) for j in kept}
        kept = {j for j, (_, _, box, _) in enumerate(lines) if id(box) in beside and not state[id(box)][0] and not state[id(box)][2]}
    return "\n\n".join(x[0] for j, x in enumerate(lines) if j in kept)


def between_surge_and_dive(sizes: list[int], level: int | None = None) -> list[int]:
    """The lines with text in each stretch that windows of nothing bound, if one of its windows reaches the surge level."""
    windows = [sum(sizes[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(sizes) + WINDOW - 1)]
    if level is None:
        level = max(1, min(SURGE, SHARE * max(windows, default=0)))
    kept, i = [], 0
    while i < len(windows):
        if not windows[i]:
            i += 1
            continue
        end = i
        while end < len(windows) and windows[end]:
            end += 1
        if max(windows[i:end]) >= level:
            kept += [j for j in range(i, min(end, len(sizes))) if sizes[j]]
        i = end
    return kept


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null and empty html give an empty text.  Rows are independent of each other:
    repeated ids and null ids and urls come back as they are.  Other columns are not read.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))

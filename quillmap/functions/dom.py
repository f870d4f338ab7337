"""A small element tree over the standard library's HTML parser, and the page figures that need one.

The tree follows the HTML standard where these figures depend on it: void elements, raw text of scripts and styles,
implied ends of paragraphs, list items, table cells and options. It is a subset; fragments of broken markup may nest
differently than in a browser.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {
    "li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
    **{t: ("p",) for t in "div ul ol dl table pre h1 h2 h3 h4 h5 h6 section article header footer nav aside main form blockquote hr figure".split()},
}
SCOPE = {"ul": "li", "ol": "li", "table": "td th tr"}
# Elements and roles around content, and what marks the shell of a script application.
CHROME_TAGS = set("script style noscript svg nav header footer aside".split())
SPA_MARKERS = ('id="___gatsby"', 'id="__next"', 'id="__nuxt"', 'id="root"')
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | set("address article blockquote br dd details div dl dt figcaption figure hr li main ol p pre section summary table td th tr ul".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "start", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, start: int):
        self.tag, self.attrs, self.parent, self.start, self.end = tag, attrs, parent, start, start
        self.children: list[Node | str] = []

    def walk(self, skip: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        """Elements below this one, in document order, without what lies under skipped ones."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            if skip and skip(node):
                continue
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, skip: Callable[[Node], bool] | None = None) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif not (skip and skip(c)):
                stack += reversed(c.children)
        return "".join(out)

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()

    def find(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]


class _Builder(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None, 0)
        self.depth = 0
        self.open: dict[str, list[tuple[int, Node]]] = {}  # open elements by name, with their depths
        self.scopes: list[int] = []  # depths of the open elements that keep what is around them open
        self.lines = [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.size = len(html)

    def _pos(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _close(self, node: Node, end: int) -> None:
        while self.at.parent is not None:
            last = self.at
            last.end = end
            self.at = last.parent
            self.open[last.tag].pop()
            if last.tag in SCOPE:
                self.scopes.pop()
            self.depth -= 1
            if last is node:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        start = self._pos()
        for other in CLOSES.get(tag, ()):
            found = self.open.get(other)
            if found and (not self.scopes or found[-1][0] > self.scopes[-1]):
                self._close(found[-1][1], start)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, start)
        self.at.children.append(node)
        node.end = start + len(self.get_starttag_text() or "")
        if tag not in VOID:
            self.at = node
            self.depth += 1
            self.open.setdefault(tag, []).append((self.depth, node))
            if tag in SCOPE:
                self.scopes.append(self.depth)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if found := self.open.get(tag):
            self._close(found[-1][1], self._pos() + len(tag) + 3)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder(html)
    builder.feed(html)
    if builder.rawdata.startswith("<!--"):
        builder.rawdata = ""  # a comment without an end reaches to the end of the page
    builder.close()
    builder._close(builder.root, len(html))
    builder.root.end = len(html)
    return builder.root


class Sums:
    """Bottom-up figures of a tree without chrome, one pass for all nodes: by id of a node, its text's length without the
    blanks around it, and of the links below it their number and the length of their texts."""

    def __init__(self, root: Node, skip: Callable[[Node], bool] | None):
        self.size: dict[int, int] = {}
        self.links: dict[int, tuple[int, int]] = {}
        spans: dict[int, tuple[int, int, int]] = {}  # all, leading and trailing blanks; leading is all for blank text
        stack: list[tuple[Node, bool]] = [(root, False)]
        while stack:
            node, done = stack.pop()
            if not done:
                stack.append((node, True))
                stack += [(c, False) for c in node.children if isinstance(c, Node) and not (skip and skip(c))]
                continue
            total = lead = trail = number = text = 0
            blank = True
            for c in node.children:
                if isinstance(c, str):
                    n, a, b = len(c), len(c) - len(c.lstrip()), len(c) - len(c.rstrip())
                elif id(c) in spans:
                    n, a, b = spans[id(c)]
                    more, inner = self.links[id(c)]
                    number, text = number + more + (c.tag == "a"), text + inner + (self.size[id(c)] if c.tag == "a" else 0)
                else:
                    continue
                if blank:
                    lead += a
                trail = trail + n if a == n else b
                blank = blank and a == n
                total += n
            spans[id(node)] = (total, total if blank else lead, total if blank else trail)
            self.size[id(node)] = 0 if blank else total - lead - trail
            self.links[id(node)] = number, text


def is_chrome(n: Node) -> bool:
    return n.tag in CHROME_TAGS or n.attrs.get("role") in CHROME_ROLES


def body_of(root: Node) -> Node:
    return next((n for n in root.walk() if n.tag == "body"), root)


def rendering(html: str, root: Node | None = None) -> dict:
    """What an agent sees without running scripts: spa_marker, headings, paragraphs, code_blocks, has_main, visible, has_content.

    root: the parsed page, where the caller has it."""
    body = body_of(root or parse(html))
    marker = next((m for m in SPA_MARKERS if m in html), None)
    visible = len(re.sub(r"\s+", " ", body.text(is_chrome)).strip())
    nodes = list(body.walk(is_chrome))
    size = Sums(body, is_chrome).size
    prose = lambda ns: sum(n.tag == "p" and size[id(n)] > 30 for n in ns)
    code = lambda ns: sum(n.tag in ("pre", "code") for n in ns)
    headings = sum(n.tag in HEADINGS and size[id(n)] > 3 for n in nodes)
    main = next((n for n in nodes if n.tag == "main" or n.attrs.get("role") == "main"), None)
    inside = list(main.walk(is_chrome)) if main else []
    has_main = prose(inside) >= 2 or code(inside) >= 1
    paragraphs, codes = prose(nodes), code(nodes)
    content = (
        visible >= 1500 or (headings >= 1 and visible >= 500) or headings >= 3 or paragraphs >= 5 or (has_main and headings >= 1) or codes >= 3
    )
    return {
        "spa_marker": marker, "headings": headings, "paragraphs": paragraphs, "code_blocks": codes, "has_main": has_main,
        "visible": visible, "substantive": content, "has_content": content or marker is None, "length": len(html),
    }


def rendering_status(r: dict) -> str:
    if r["spa_marker"] is None or r["has_content"]:
        return "pass"
    return "warn" if r["headings"] >= 1 or r["paragraphs"] >= 2 or r["code_blocks"] >= 1 else "fail"


# ------------------------------------------------------------------------------------------------ Markdown
HIDDEN = {"script", "style", "noscript"}
FLOW = BLOCKS - {"br"} | {"body", "html", "head", "header", "footer", "nav", "aside", "title"} | HIDDEN


def _inline(children: list[Node | str]) -> str:
    """Text with links, images, emphasis and code in it. Nested elements are frames on a stack, not calls."""
    frames: list[tuple[Node | None, Iterator, list[str]]] = [(None, iter(children), [])]
    while True:
        node, rest, out = frames[-1]
        c = next(rest, None)
        if c is None:
            frames.pop()
            text = "".join(out)
            if not frames:
                return text
            if node.tag in ("strong", "b", "em", "i"):
                mark = "**" if node.tag in ("strong", "b") else "_"
                text = f"{mark}{text.strip()}{mark}" if text.strip() else ""
            elif node.tag == "a" and node.attrs.get("href"):
                text = f"[{text.strip()}]({node.attrs['href']})"
            frames[-1][2].append(text)
        elif isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag == "code":
            out.append(f"`{c.text()}`")
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})" if c.attrs.get("src") else "")
        elif c.tag not in HIDDEN:
            frames.append((c, iter(c.children), []))


def _table(node: Node) -> str:
    cells = lambda r: [_inline(c.children).strip().replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]
    # rows of a table inside a cell are text of that cell
    inner = lambda n: n.tag == "table"
    rows = [r for r in (cells(n) for n in node.walk(inner) if n.tag == "tr") if r]
    if not rows:
        return ""
    head, *rest = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([head, "| " + " | ".join("---" for _ in rows[0]) + " |", *rest])


def _single(c: Node) -> str:
    """A block that holds no blocks."""
    if c.tag in HEADINGS:
        text, level = _inline(c.children).strip(), int(c.tag[1])
        return "" if not text else f"{text}\n{('=' if level == 1 else '-') * len(text)}" if level < 3 else "#" * level + " " + text
    if c.tag == "pre":
        return "\n".join("    " + line for line in c.text().strip("\n").split("\n"))
    return _table(c) if c.tag == "table" else "* * *"


#: Lists and quotes deeper than this are written without further indentation, which would grow with the square of the depth.
DEEPEST = 50


def to_markdown(html: str, root: Node | None = None) -> str:
    """Markdown of a page: setext h1 and h2, ATX below, * bullets, fence-free indented code, pipe tables; no scripts or styles.

    Pages may nest as deep as they like. root: the parsed page, where the caller has it.
    """
    root = root or parse(html)
    # a frame: element, children to come, blocks so far, run of inline children, prefix of the first and of other lines
    frames: list[tuple[Node, Iterator, list[str], list, str, str]] = [(root, iter(root.children), [], [], "", "")]
    boxes = 0
    while True:
        node, rest, out, run, first, other = frames[-1]
        c = next(rest, None)
        if c is not None and (isinstance(c, str) or c.tag not in FLOW):
            run.append(c)
            continue
        if run and (text := _inline(run).strip()):
            out.append(text)
        run.clear()
        if c is None:
            frames.pop()
            if not frames:
                return "\n\n".join(out)
            above = frames[-1][2]
            if first or other:
                boxes -= 1
                above.append(first + "\n\n".join(out).replace("\n", "\n" + other))
            elif node.tag in ("ul", "ol"):
                above += ["\n".join(out)] if out else []
            else:
                above += out
        elif c.tag in HIDDEN or c.tag in ("head", "title"):
            continue
        elif c.tag in HEADINGS or c.tag in ("pre", "table", "hr"):
            if text := _single(c):
                out.append(text)
        elif c.tag in ("ul", "ol"):
            frames.append((c, iter([n for n in c.children if isinstance(n, Node) and n.tag == "li"]), [], [], "", ""))
        elif boxes < DEEPEST and (c.tag == "blockquote" or c.tag == "li" and node.tag in ("ul", "ol")):
            boxes += 1
            mark = "> " if c.tag == "blockquote" else "*   " if node.tag == "ul" else f"{len(out) + 1}.  "
            frames.append((c, iter(c.children), [], [], mark, "> " if c.tag == "blockquote" else "    "))
        else:
            frames.append((c, iter(c.children), [], [], "", ""))


# ------------------------------------------------------------------------------------------------ tabs
def tab_groups(html: str) -> list[dict]:
    """Groups of tab panels: framework, tab_count, html, panels (label, html). A container belongs to one group only."""
    root, groups, claimed = parse(html), [], []

    def inside(node: Node) -> bool:
        return any(c.start <= node.start and node.end <= c.end for c in claimed)

    def label(node: Node) -> str:
        return node.text(lambda n: n.tag == "style").strip()

    def add(framework: str, box: Node, labels: list[str | None], panels: list[Node]) -> None:
        n = max(len(labels), len(panels))
        claimed.append(box)
        rows = [{"label": labels[k] if k < len(labels) else None, "html": html[panels[k].start : panels[k].end] if k < len(panels) else ""} for k in range(n)]
        groups.append({"framework": framework, "tab_count": n, "html": html[box.start : box.end], "panels": rows})

    role = lambda r: lambda n: n.attrs.get("role") == r

    def by_tablist(framework: str, is_tab: Callable[[Node], bool]) -> None:
        for tablist in root.find(role("tablist")):
            tabs = tablist.find(is_tab)
            if inside(tablist) or not tabs:
                continue
            box, panels = tablist.parent, []
            for _ in range(4):
                if box is None or inside(box):
                    break
                if panels := box.find(role("tabpanel")):
                    add(framework, box, [label(t) for t in tabs], panels)
                    break
                box = box.parent

    by_tablist("docusaurus", lambda n: n.has_class("tabs__item"))
    for box in root.find(lambda n: n.has_class("tabbed-set")):
        labels = [c for w in box.find(lambda n: n.has_class("tabbed-labels")) for c in w.children if isinstance(c, Node)]
        panels = [c for w in box.find(lambda n: n.has_class("tabbed-content")) for c in w.children if isinstance(c, Node)]
        if not inside(box) and (labels or panels):
            add("mkdocs", box, [label(x) for x in labels], panels)
    for box in root.find(lambda n: n.has_class("sphinx-tabs")):
        labels, panels = box.find(lambda n: n.has_class("sphinx-tabs-tab")), box.find(lambda n: n.has_class("sphinx-tabs-panel"))
        if not inside(box) and (labels or panels):
            add("sphinx", box, [label(x) for x in labels], panels)
    for box in root.find(lambda n: n.has_class("tabGroup")):
        labels = box.find(lambda n: n.tag == "a" and "data-tab" in n.attrs) or box.find(role("tab"))
        panels = box.find(lambda n: n.tag == "section" and "data-tab" in n.attrs) or box.find(role("tabpanel"))
        if not inside(box) and (labels or panels):
            add("ms-learn", box, [label(x) for x in labels], panels)
    for start, end, panels in mdx_tabs(html):
        box = Node("tabs", {}, None, start)
        box.end = end
        if not inside(box):
            claimed.append(box)
            groups.append({"framework": "mdx", "tab_count": len(panels), "html": html[start:end], "panels": panels})
    by_tablist("aria", role("tab"))
    return groups


TAG = re.compile(r"<(/?)(Tabs|TabItem|Tab)\b([^<>]*?)(/?)>")


def mdx_tabs(text: str) -> list[tuple[int, int, list[dict]]]:
    """Outermost Tabs blocks of MDX source with their Tab or TabItem panels."""
    out, depth, start, panels, item = [], 0, 0, [], None
    for m in TAG.finditer(text):
        closing, name, attrs, empty = m[1] == "/", m[2], m[3], m[4] == "/"
        if name == "Tabs":
            if closing:
                depth -= 1
                if depth == 0:
                    if panels:
                        out.append((start, m.end(), panels))
                    panels, item = [], None
                depth = max(depth, 0)
            elif not empty:
                if depth == 0:
                    start, panels = m.start(), []
                depth += 1
        elif depth == 1:
            if closing and item:
                panels.append({"label": item[0], "html": text[item[1] : m.start()]})
                item = None
            elif not closing and not empty:
                found = re.search(r"(?:label|title|value)\s*=\s*[\"'{]+([^\"'}]*)", attrs)
                item = (found[1] if found else None, m.end())
    return out


def headers_of(panel: str) -> list[str]:
    """Headings of a tab panel, in HTML and in Markdown, but for those inside callouts."""
    callout = lambda n: bool(re.search(r"admonition|callout|alert|notice|\bnote\b|warning|\btip\b", n.attrs.get("class", "")))
    root = parse(panel)
    held = [n for n in root.walk(callout) if n.tag in HEADINGS]
    texts = texts_of(root, {id(n) for n in held})
    out = [texts[id(n)].strip() for n in held]
    fence = False
    for line in panel.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fence = not fence
        elif not fence and (m := re.match(r"\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$", line)):
            out.append(m[1])
    return [h for h in out if h]


def texts_of(root: Node, wanted: set[int]) -> dict[int, str]:
    """text() of the wanted elements, by id, in one pass: elements inside one another are not walked again for each."""
    out, pieces, begin, stack = {}, [], {}, [(root, False)]
    while stack:
        c, done = stack.pop()
        if isinstance(c, str):
            pieces.append(c)
        elif done:
            out[id(c)] = "".join(pieces[begin[id(c)]:])
        else:
            if id(c) in wanted:
                begin[id(c)] = len(pieces)
                stack.append((c, True))
            stack += [(x, False) for x in reversed(c.children)]
    return out


def is_data_row(node: Node) -> bool:
    """A table row that is not of the head and has a cell that is not a heading."""
    if node.tag != "tr" or node.parent is not None and node.parent.tag == "thead":
        return False
    cells = [x.tag for x in node.children if isinstance(x, Node) and x.tag in ("td", "th")]
    return not cells or "td" in cells


def descendants(root: Node) -> dict[int, int]:
    """How many elements are below each one, by id."""
    order, out = [root, *root.walk()], {}
    for n in reversed(order):
        out[id(n)] = out.get(id(n), 0)
        if n is not root:
            out[id(n.parent)] = out.get(id(n.parent), 0) + 1 + out[id(n)]
    return out


def node_rows(html: str) -> list[dict]:
    """The rows of each_node as a list."""
    return list(each_node(html))


def each_node(html: str) -> Iterator[dict]:
    """Elements of a page in document order: pre, the number of each; last, that of the last element below it (its own
    without one); parent, depth; tag, id, classes, role, href; start and end in the source; own, the text that is not in
    elements below. a is an ancestor of b exactly where a.pre < b.pre <= a.last."""
    root = parse(html)
    below, place, depths = descendants(root), {id(root): -1}, []
    for pre, n in enumerate(root.walk()):
        place[id(n)] = pre
        parent = place[id(n.parent)]
        depths.append(1 if parent < 0 else depths[parent] + 1)
        yield {
            "pre": pre, "last": pre + below[id(n)], "parent": parent if parent >= 0 else None, "depth": depths[pre], "tag": n.tag, "id": n.attrs.get("id"),
            "classes": (n.attrs.get("class") or "").split(), "role": n.attrs.get("role"), "href": n.attrs.get("href"), "start": n.start, "end": n.end, "own": "".join(c for c in n.children if isinstance(c, str)),
        }


def selected(selector: str) -> Callable[[Node], bool]:
    """A predicate for a simple CSS selector: tag, .class, #id, [attribute] or [attribute=value], in any combination."""
    tag = re.match(r"[a-zA-Z][\w-]*", selector)
    classes, ids = re.findall(r"\.([\w-]+)", selector), re.findall(r"#([\w-]+)", selector)
    attributes = re.findall(r"\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]", selector)

    def test(n: Node) -> bool:
        return (
            (tag is None or n.tag == tag[0].lower()) and set(classes) <= set(n.attrs.get("class", "").split()) and all(n.attrs.get("id") == i for i in ids)
            and all(k in n.attrs and (not v or n.attrs[k] == v) for k, v in attributes) and bool(tag or classes or ids or attributes)
        )

    return test


def main_text(html: str, exclusions: tuple[str, ...] = ()) -> dict:
    """Text of the content container (main, article or body) with a line per block, and its counts of list items and table
    rows. exclusions: simple CSS selectors of elements that are left out."""
    body = body_of(parse(html))
    box = next((n for n in body.walk(is_chrome) if n.tag == "main" or n.attrs.get("role") == "main"), None) or next((n for n in body.walk(is_chrome) if n.tag == "article"), None) or body

    sums = Sums(box, None)

    def menu(n: Node) -> bool:  # mostly links
        if n.tag not in ("div", "ul", "ol", "section"):
            return False
        (links, inside), size = sums.links[id(n)], sums.size[id(n)]
        return links >= 10 and size > 0 and inside >= 0.7 * size

    out: list[str] = []
    left_out = [selected(x) for x in exclusions]
    stack: list[Node | str] = list(reversed(box.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif not is_chrome(c) and not menu(c) and not any(f(c) for f in left_out):
            if c.tag in BLOCKS:
                out.append("\n")
                stack.append("\n")
            stack += reversed(c.children)
    nodes = list(box.walk(is_chrome))
    lists = [sum(isinstance(x, Node) and x.tag == "li" for x in n.children) for n in nodes if n.tag in ("ul", "ol")]
    # data rows by document order: those of a table are the ones between its own place and that of what follows it
    order = list(box.walk())
    upto = [0]
    for n in order:
        upto.append(upto[-1] + is_data_row(n))
    place = {id(n): k for k, n in enumerate(order)}
    below = descendants(box)
    tables = [upto[place[id(n)] + 1 + below[id(n)]] - upto[place[id(n)] + 1] for n in nodes if n.tag == "table"]
    return {"text": re.sub(r"\n\s*\n+", "\n", "".join(out)).strip(), "largest_list": max(lists, default=0), "largest_table": max(tables, default=0)}

"""Blocks and inlines of CommonMark, with pipe tables: links, text and code by offsets into the source.

Two passes. The first reads lines into containers (quotes, list items) and leaves (paragraphs, headings, code, HTML, cells
of tables), and keeps for each piece of a leaf where it stands in the source. The second reads the text of a leaf: runs of
backticks by an index of their lengths, brackets and emphasis by a stack of delimiters, labels by a table of definitions in
which the first one counts. Both take time linear in the body (but for a logarithm), whatever it holds, and neither
recurses.

Vendor fences. Tables of some generators hold fences whose info string has a pipe; they are no fences. Their marks are
blanked, which lets other lines become fences, so the blocks are read again until none is left (`ROUNDS` times; from then
on such a line is blanked as it is met, which no longer waits for a fixpoint). Blanking keeps the length, so offsets stay.
"""

from __future__ import annotations

import html.entities
import re
from bisect import bisect_right
from collections.abc import Iterator

ROUNDS = 8
PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"
ESCAPED = re.compile(rf"\\([{PUNCTUATION}])")
REFERENCE = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
EITHER = re.compile(rf"\\([{PUNCTUATION}])|&(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});")


def referenced(body: str) -> str | None:
    """The text of a character reference; None if there is no such name."""
    if body[0] != "#":
        return html.entities.html5.get(body + ";")
    code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "�"


def decoded(text: str) -> str:
    """Backslash escapes and character references, once."""
    if "\\" not in text and "&" not in text:
        return text
    return EITHER.sub(lambda m: m[1] if m[1] else referenced(m[2]) or m[0], text)


def label_key(label: str) -> str:
    return " ".join(label.split()).casefold()


# ------------------------------------------------------------------------------------------------ blocks
class Leaf:
    """A block of text: kind (paragraph, heading, code, html, cell), pieces (offset, text), and its range."""

    __slots__ = ("kind", "pieces", "start", "end", "fence", "closes", "lazy")

    def __init__(self, kind: str, start: int):
        self.kind, self.start, self.end = kind, start, start
        self.pieces: list[tuple[int, str]] = []
        self.fence: tuple[str, int, int] | None = None  # character, length, indentation
        self.closes: re.Pattern | None = None

    def text(self) -> tuple[str, list[int], list[int]]:
        """The pieces as one text, and for each where it begins in it and in the source."""
        at, places, offsets = 0, [], []
        for offset, piece in self.pieces:
            places.append(at)
            offsets.append(offset)
            at += len(piece) + 1
        return "\n".join(p for _, p in self.pieces), places, offsets


ATX = re.compile(r"#{1,6}(?=[ \t]|$)")
FIRST = re.compile(r"[ \t]*+")
BREAK = re.compile(r"([*_-])(?:[ \t]*+\1){2}")
SETEXT = re.compile(r"(?:=+|-+)[ \t]*+$")
FENCE = re.compile(r"(`{3,}|~{3,})(.*)$")
ITEM = re.compile(r"(?:[-*+]|(\d{1,9})[.)])(?=[ \t]|$)")
DELIMITERS = re.compile(r"\|?[ \t]*+:?-++:?[ \t]*+(?:\|[ \t]*+:?-++:?[ \t]*+)*+\|?[ \t]*+$")
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
OPEN_TAG = r"<[A-Za-z][A-Za-z0-9-]*+(?:\s++[A-Za-z_:][\w.:-]*+(?:\s*+=\s*+(?:[^\s\"'=<>`]++|'[^']*+'|\"[^\"]*+\"))?+)*+\s*+/?>"
CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*+\s*+>"
#: How HTML blocks begin and what ends them (a blank line where that is None); the last cannot interrupt a paragraph.
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?=[ \t>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile("<!--"), re.compile("-->")), (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile("<![A-Za-z]"), re.compile(">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")), (re.compile(rf"</?(?:{'|'.join(BLOCK_TAGS)})(?=[ \t]|/?>|$)", re.I), None),
    (re.compile(rf"(?:{OPEN_TAG}|{CLOSE_TAG})[ \t]*+$"), None),
]


class Line:
    """A line that is consumed by columns, tabs being stops of four."""

    __slots__ = ("text", "start", "pos", "column", "rest", "tails")

    def __init__(self, text: str, start: int):
        self.text, self.start, self.pos, self.column, self.rest = text, start, 0, 0, 0
        self.tails: dict[str, int] = {}

    def indent(self) -> int:
        """Columns of blanks ahead; what is left of a tab that was entered counts."""
        n, column, pos, text = self.rest, self.column + self.rest, self.pos, self.text
        while pos < len(text) and text[pos] in " \t":
            step = 1 if text[pos] == " " else 4 - column % 4
            n, column, pos = n + step, column + step, pos + 1
        return n

    def skip(self, columns: int) -> None:
        """Consumes so many columns of blanks, maybe into a tab."""
        while columns:
            if self.rest:
                step = min(self.rest, columns)
                self.rest -= step
                self.column += step
                columns -= step
            elif self.pos < len(self.text) and self.text[self.pos] in " \t":
                self.rest = 1 if self.text[self.pos] == " " else 4 - self.column % 4
                self.pos += 1
            else:
                return

    def take(self, chars: int) -> None:
        self.pos, self.column = self.pos + chars, self.column + chars

    def first(self) -> int:
        """The place of what follows the blanks; the length if nothing does."""
        return FIRST.match(self.text, self.pos).end()

    def blank(self) -> bool:
        return self.first() >= len(self.text)

    def only(self, char: str) -> bool:
        """Whether nothing but such characters and blanks is left."""
        if char not in self.tails:
            self.tails[char] = len(self.text.rstrip(char + " \t"))
        return self.tails[char] <= self.first()

    def left(self) -> tuple[int, str]:
        """(offset, text) of what is left; a tab that was entered leaves blanks."""
        return self.start + self.pos - (self.rest > 0), " " * self.rest + self.text[self.pos :]


class Blocks:
    """Leaves of a body in order, and its definitions by label."""

    def __init__(self, body: str, blank_vendor: bool = False):
        self.leaves: list[Leaf] = []
        self.definitions: dict[str, str] = {}
        self.defined: list[tuple[int, int]] = []  # ranges of definitions
        self.vendor: list[tuple[int, int]] = []  # (offset, length) of fence marks with a pipe behind them
        self.blank_vendor = blank_vendor
        self.boxes: list[list] = []  # width of a list item's content or 0 of a quote, and whether it is empty so far
        self.quotes: list[int] = []  # which of them are quotes
        self.leaf: Leaf | None = None
        at = 0
        for line in re.split(r"\r\n|\n|\r", body):
            self._line(Line(line, at))
            at += len(line)
            at += 2 if body.startswith("\r\n", at) else 1
        self._close()

    # -------------------------------------------------------------------------------- leaves
    def _close(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf.kind == "table":
            return
        if leaf.kind in ("paragraph", "heading"):
            if leaf.kind == "paragraph":
                self._take_definitions(leaf)
            if not leaf.pieces:
                return
            offset, last = leaf.pieces[-1]
            leaf.pieces[-1] = offset, last.rstrip(" \t")
        elif leaf.kind == "indented":
            while leaf.pieces and not leaf.pieces[-1][1].strip():
                leaf.pieces.pop()
            leaf.kind = "code"
            leaf.end = leaf.pieces[-1][0] + len(leaf.pieces[-1][1]) if leaf.pieces else leaf.start
        self.leaves.append(leaf)

    def _take_definitions(self, leaf: Leaf) -> None:
        if not leaf.pieces[0][1].startswith("["):
            return
        text, places, offsets = leaf.text()
        at = 0
        while found := definition(text, at):
            label, destination, end = found
            self.definitions.setdefault(label, destination)
            piece = lambda x: offsets[bisect_right(places, x) - 1] + x - places[bisect_right(places, x) - 1]
            self.defined.append((piece(at), piece(end)))
            at = end + 1
            if at >= len(text):
                leaf.pieces = []
                return
        if at:
            k = bisect_right(places, at) - 1
            leaf.pieces = leaf.pieces[k:]

    def _new(self, kind: str, line: Line) -> Leaf:
        self._close()
        self.leaf = Leaf(kind, line.start + line.first())
        return self.leaf

    def _single(self, kind: str, offset: int, text: str) -> None:
        leaf = Leaf(kind, offset)
        leaf.pieces = [(offset, text)]
        leaf.end = offset + len(text)
        self.leaves.append(leaf)

    # -------------------------------------------------------------------------------- lines
    def _line(self, line: Line) -> None:
        text = line.text
        matched = 0
        while matched < len(self.boxes):
            box, first = self.boxes[matched], line.first()
            if box[0] == 0:
                if line.indent() > 3 or not text.startswith(">", first):
                    break
                self._quote(line)
            elif first >= len(text):
                if box[1]:
                    break
                # a blank line stays in its list items, up to the next quote
                k = bisect_right(self.quotes, matched)
                matched = self.quotes[k] if k < len(self.quotes) else len(self.boxes)
                if matched == len(self.boxes) and self.boxes[-1][1]:
                    matched -= 1
                    break
                line.skip(line.indent())
                continue
            elif line.indent() >= box[0]:
                line.skip(box[0])
            else:
                break
            matched += 1
        whole = matched == len(self.boxes)
        leaf = self.leaf
        if whole and leaf is not None:
            if leaf.fence:
                return self._in_fence(leaf, line)
            if leaf.kind == "html":
                if leaf.closes is not None or not line.blank():
                    return self._in_html(leaf, line)
                self._close()
            elif leaf.kind == "indented":
                if line.indent() >= 4 or line.blank():
                    line.skip(min(4, line.indent()))
                    leaf.pieces.append(line.left())
                    leaf.end = line.start + len(text)
                    return None
                self._close()
        paragraph = self.leaf if self.leaf is not None and self.leaf.kind == "paragraph" else None
        opened = False
        while True:
            indent, at = line.indent(), line.first()
            if at >= len(text) or indent > 3:
                break
            char = text[at]
            if char == ">":
                self._drop(matched)
                self._open(0, False)
                matched, opened = matched + 1, True
                self._quote(line)
                continue
            running = paragraph is not None and whole and not opened
            if char == "#" and (m := ATX.match(text, at)):
                self._drop(matched)
                said = re.sub(r"(?:^|[ \t]++)#++[ \t]*+$", "", text[m.end() :])
                return self._single("heading", line.start + m.end() + len(said) - len(said.lstrip(" \t")), said.strip(" \t"))
            if char in "`~" and (m := FENCE.match(text, at)) and not (char == "`" and "`" in m[2]):
                if "|" in m[2]:
                    self.vendor.append((line.start + at, len(m[1])))
                if "|" in m[2] and self.blank_vendor:
                    line.text = text = text[:at] + " " * len(m[1]) + m[2]
                    continue
                self._drop(matched)
                leaf = self._new("code", line)
                leaf.fence, leaf.end = (char, len(m[1]), indent), line.start + len(text)
                return None
            if char == "<":
                for begins, ends in HTML[: 6 if running else 7]:
                    if begins.match(text, at):
                        self._drop(matched)
                        leaf = self._new("html", line)
                        leaf.closes = ends
                        return self._in_html(leaf, line)
            if running and char in "=-" and SETEXT.match(text, at):
                self._take_definitions(paragraph)
                if paragraph.pieces:
                    paragraph.kind = "heading"
                    self._close()
                    return None
            if char in "*_-" and BREAK.match(text, at) and line.only(char):
                self._drop(matched)
                return None
            if m := ITEM.match(text, at):
                empty = FIRST.match(text, m.end()).end() >= len(text)
                if running and (empty or m[1] not in (None, "1")):
                    break
                self._drop(matched)
                line.skip(indent)
                line.take(m.end() - at)
                gap = line.indent()
                inside = gap if 1 <= gap <= 4 and not empty else min(gap, 1)
                self._open(indent + m.end() - at + max(1, inside), empty)
                line.skip(inside)
                matched, opened = matched + 1, True
                continue
            break
        at = line.first()
        blank = at >= len(text)
        if not whole and not opened and paragraph is not None and not blank:
            self._to_paragraph(paragraph, line)  # a lazy line goes on with it
            return None
        if not opened and (not whole or blank):
            self._drop(matched)
        if blank:
            self._close()
            return None
        if self.boxes:
            self.boxes[-1][1] = False
        leaf = self.leaf
        if leaf is not None and leaf.kind == "paragraph":
            if len(leaf.pieces) == 1 and line.indent() <= 3 and DELIMITERS.match(text, at) and ("|" in leaf.pieces[0][1] or "|" in text[at:]):
                cells = split_cells(*leaf.pieces[0])
                if len(cells) == len(split_cells(0, text[at:])):
                    self.leaf = Leaf("table", leaf.start)
                    self._cells(cells)
                    return None
            self._to_paragraph(leaf, line)
        elif leaf is not None and leaf.kind == "table":
            self._cells(split_cells(line.start + at, text[at:]))
        elif line.indent() >= 4:
            leaf = self._new("indented", line)
            line.skip(4)
            leaf.pieces.append(line.left())
            leaf.end = line.start + len(text)
        else:
            self._to_paragraph(self._new("paragraph", line), line)
        return None

    def _open(self, width: int, empty: bool) -> None:
        if width == 0:
            self.quotes.append(len(self.boxes))
        self.boxes.append([width, empty])

    def _drop(self, keep: int) -> None:
        """Closes the leaf, and the containers beyond so many."""
        self._close()
        if keep < len(self.boxes):
            del self.boxes[keep:]
            while self.quotes and self.quotes[-1] >= keep:
                self.quotes.pop()
        if self.boxes:
            self.boxes[-1][1] = False

    @staticmethod
    def _quote(line: Line) -> None:
        line.skip(line.indent())
        line.take(1)
        line.skip(min(1, line.indent()))

    @staticmethod
    def _to_paragraph(leaf: Leaf, line: Line) -> None:
        at = line.first()
        leaf.pieces.append((line.start + at, line.text[at:]))
        leaf.end = line.start + len(line.text)

    def _in_fence(self, leaf: Leaf, line: Line) -> None:
        char, length, indent = leaf.fence
        leaf.end = line.start + len(line.text)
        if line.indent() <= 3 and (m := FENCE.match(line.text, line.first())) and m[1][0] == char and len(m[1]) >= length and not m[2].strip():
            self._close()
            return
        line.skip(min(indent, line.indent()))
        leaf.pieces.append(line.left())

    def _in_html(self, leaf: Leaf, line: Line) -> None:
        offset, text = line.left()
        leaf.pieces.append((offset, text))
        leaf.end = line.start + len(line.text)
        if leaf.closes is not None and leaf.closes.search(text):
            self._close()

    def _cells(self, cells: list[tuple[int, str]]) -> None:
        for offset, text in cells:
            self._single("cell", offset, text)


def split_cells(offset: int, row: str) -> list[tuple[int, str]]:
    """(offset, text) of the cells of a row, split at pipes that no backslash escapes."""
    bounds, k = [], 0
    while (k := row.find("|", k)) >= 0:
        before = k
        while before and row[before - 1] == "\\":
            before -= 1
        if (k - before) % 2 == 0:
            bounds.append(k)
        k += 1
    edges = [-1, *bounds, len(row)]
    cells = [(a + 1, row[a + 1 : b]) for a, b in zip(edges, edges[1:])]
    if cells and not cells[0][1].strip():
        cells = cells[1:]
    if cells and not cells[-1][1].strip():
        cells = cells[:-1]
    return [(offset + at + len(x) - len(x.lstrip()), x.strip()) for at, x in cells]


# ------------------------------------------------------------------------------------------------ parts of links
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){1,999})\]", re.S)
ANGLE = re.compile(r"<((?:[^<>\n\\]|\\.)*+)>")
TITLE = re.compile(r"\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|\((?:[^()\\]|\\.)*+\)", re.S)
BLANKS, SPACES = re.compile(r"[ \t]*+\n?[ \t]*+"), re.compile(r"[ \t]*+")


def _bare(levels: int = 32) -> str:
    """A destination without brackets: no blanks, parentheses balanced or escaped, so many levels of them."""
    unit, inner = r"[^\x00-\x20\x7f()\\]++|\\[^\x00-\x20]|\\(?=[\x00-\x20]|\Z)", ""
    for _ in range(levels + 1):
        inner = rf"(?:{unit}|\({inner}\))*+" if inner else rf"(?:{unit})*+"
    return inner


BARE = re.compile(_bare())


def destination(text: str, at: int) -> tuple[str, int] | None:
    """A destination, decoded, and where it ends. An empty one only in angle brackets."""
    if text.startswith("<", at):
        m = ANGLE.match(text, at)
        return (decoded(m[1]), m.end()) if m else None
    end = BARE.match(text, at).end()
    return decoded(text[at:end]), end


def resource(text: str, at: int) -> tuple[str, int] | None:
    """`(destination "title")` at a place: the destination and where it ends."""
    if not text.startswith("(", at):
        return None
    at = BLANKS.match(text, at + 1).end()
    if text.startswith(")", at):
        return "", at + 1
    if not (found := destination(text, at)):
        return None
    url, at = found
    gap = BLANKS.match(text, at).end()
    if gap > at and (m := TITLE.match(text, gap)):
        gap = BLANKS.match(text, m.end()).end()
    return (url, gap + 1) if text.startswith(")", gap) else None


def definition(text: str, at: int) -> tuple[str, str, int] | None:
    """(label, destination, end of its last line) of a definition at the start of a line."""
    m = LABEL.match(text, at)
    if not m or not m[1].strip() or not text.startswith(":", m.end()):
        return None
    place = BLANKS.match(text, m.end() + 1).end()
    found = destination(text, place)
    if not found or found[1] == place:
        return None
    url, end = found
    line = SPACES.match(text, end).end()
    without = line if line >= len(text) or text[line] == "\n" else None
    gap = BLANKS.match(text, end).end()
    if gap > end and (t := TITLE.match(text, gap)):
        last = SPACES.match(text, t.end()).end()
        if last >= len(text) or text[last] == "\n":
            return label_key(m[1]), url, last
    return (label_key(m[1]), url, without) if without is not None else None


# ------------------------------------------------------------------------------------------------ inlines
SPECIAL = re.compile(r"[\\`*_\[\]!<&\n]")
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*+|[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]++@[a-zA-Z0-9](?:[a-zA-Z0-9.-]*+[a-zA-Z0-9])?)>")
TAG = re.compile(rf"{OPEN_TAG}|{CLOSE_TAG}", re.S)


class Inlines:
    """Links of one leaf's text, and the text as it is read.

    nodes: strings, and links, images and HTML as (kind, source of HTML, destination, start, end, nodes inside). Positions are
    those in the text. What a link says is read from the nodes inside (see shown) when it is asked for: images nest as deep as
    they like, and texts made at each level would grow with the square of the depth.
    """

    def __init__(self, text: str, definitions: dict[str, str]):
        self.text, self.definitions = text, definitions
        self.nodes: list = []
        self.code: list[tuple[int, int]] = []
        self.comments: list[tuple[int, int]] = []
        self.brackets: list[tuple[int, bool, int, int]] = []  # node, is image, place behind it, delimiters so far
        self.off = 0  # so many of the lowest brackets open no links any more
        self.delimiters: list[list] = []  # node, character, length, opens, closes, length at first
        self.missing: set[str] = set()  # ends that do not come any more
        runs: dict[int, list[int]] = {}
        for m in re.finditer("`+", text):
            runs.setdefault(m.end() - m.start(), []).append(m.start())
        self.runs = runs
        self._read()
        self._emphasis(0)

    def _read(self) -> None:
        text, at = self.text, 0
        while m := SPECIAL.search(text, at):
            k = m.start()
            if k > at:
                self.nodes.append(text[at:k])
            at = getattr(self, READERS[text[k]])(k)
        if at < len(text):
            self.nodes.append(text[at:])

    def _plain(self, k: int, n: int = 1) -> int:
        self.nodes.append(self.text[k : k + n])
        return k + n

    def _backslash(self, k: int) -> int:
        if m := ESCAPED.match(self.text, k):
            self.nodes.append(m[1])
            return m.end()
        return self._plain(k)

    def _newline(self, k: int) -> int:
        return self._plain(k)

    def _reference(self, k: int) -> int:
        if (m := REFERENCE.match(self.text, k)) and (found := referenced(m[1])) is not None:
            self.nodes.append(found)
            return m.end()
        return self._plain(k)

    def _ticks(self, k: int) -> int:
        text, end = self.text, k
        while end < len(text) and text[end] == "`":
            end += 1
        places = self.runs.get(end - k, [])
        after = bisect_right(places, k)
        if after >= len(places):
            return self._plain(k, end - k)
        close = places[after] + end - k
        inner = text[end : places[after]].replace("\n", " ")
        if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip(" "):
            inner = inner[1:-1]
        self.nodes.append(inner)
        self.code.append((k, close))
        return close

    def _angle(self, k: int) -> int:
        text = self.text
        if m := AUTOLINK.match(text, k):
            self.nodes.append(m[1])
            return m.end()
        if m := TAG.match(text, k):
            self.nodes.append(("html", m[0], None, k, m.end(), []))
            return m.end()
        for begins, ends, least in (("<!--", "-->", 4), ("<?", "?>", 2), ("<![CDATA[", "]]>", 9)):
            if text.startswith(begins, k):
                if begins == "<!--" and (text.startswith("<!-->", k) or text.startswith("<!--->", k)):
                    end = text.index(">", k) + 1
                elif ends in self.missing or (end := text.find(ends, k + least)) < 0:
                    self.missing.add(ends)
                    return self._plain(k)
                else:
                    end += len(ends)
                self.nodes.append(("html", "", None, k, end, []))
                if begins == "<!--":
                    self.comments.append((k, end))
                return end
        return self._plain(k)

    def _run(self, k: int) -> int:
        text, char, end = self.text, self.text[k], k
        while end < len(text) and text[end] == char:
            end += 1
        before, after = text[k - 1] if k else " ", text[end] if end < len(text) else " "
        mark = lambda c: not c.isalnum() and not c.isspace()
        left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
        right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
        opens = left and (char == "*" or not right or mark(before))
        closes = right and (char == "*" or not left or mark(after))
        self.nodes.append(text[k:end])
        if opens or closes:
            self.delimiters.append([len(self.nodes) - 1, char, end - k, opens, closes, end - k])
        return end

    def _bang(self, k: int) -> int:
        if not self.text.startswith("[", k + 1):
            return self._plain(k)
        return self._bracket(k, True)

    def _bracket(self, k: int, image: bool = False) -> int:
        end = k + 1 + image
        self.nodes.append(self.text[k:end])
        self.brackets.append((len(self.nodes) - 1, image, end, len(self.delimiters)))
        return end

    def _close(self, k: int) -> int:
        if not self.brackets:
            return self._plain(k)
        node, image, behind, delimiters = self.brackets.pop()
        inactive = not image and len(self.brackets) < self.off
        self.off = min(self.off, len(self.brackets))
        if inactive:
            return self._plain(k)
        text = self.text
        found = resource(text, k + 1)
        if not found:
            found = self._by_label(behind, k)
        if not found:
            return self._plain(k)
        url, end = found
        self._emphasis(delimiters)
        inner = self.nodes[node + 1 :]
        del self.nodes[node:]
        start = behind - 1 - image
        self.nodes.append(("image" if image else "link", "", url, start, end, inner))
        if not image:
            self.off = len(self.brackets)
        return end

    def _by_label(self, behind: int, k: int) -> tuple[str, int] | None:
        text, own, end = self.text, None, k + 1
        if m := LABEL.match(text, k + 1):
            if m[1].strip():
                found = self.definitions.get(label_key(m[1]))
                return (found, m.end()) if found is not None else None
        elif text.startswith("[]", k + 1):
            end = k + 3
        if k - behind <= 999:
            own = text[behind:k]
            if (m := LABEL.match(text, behind - 1)) and m.end() == k + 1 and own.strip():
                found = self.definitions.get(label_key(own))
                return (found, end) if found is not None else None
        return None

    def _emphasis(self, bottom: int) -> None:
        """Takes matching delimiters above the bottom of the stack out of the text."""
        stack = self.delimiters[bottom:]
        del self.delimiters[bottom:]
        openers: dict[tuple, list[int]] = {}  # by character, in the order of the text
        alive: list[list] = []
        floor: dict[tuple, int] = {}
        for d in stack:
            if d[4]:
                key = (d[1], d[3], d[5] % 3)
                while d[2]:
                    at = len(alive) - 1
                    while at >= floor.get(key, 0):
                        o = alive[at]
                        odd = (o[4] or d[3]) and (o[5] + d[5]) % 3 == 0 and (o[5] % 3 or d[5] % 3)
                        if o[1] == d[1] and o[3] and o[2] and not odd:
                            break
                        at -= 1
                    if at < floor.get(key, 0):
                        floor[key] = len(alive)
                        break
                    o = alive[at]
                    n = 2 if o[2] >= 2 and d[2] >= 2 else 1
                    o[2], d[2] = o[2] - n, d[2] - n
                    # what stands between a pair can match nothing any more
                    del alive[at + 1 :]
                    if not o[2]:
                        alive.pop()
                    for k, v in floor.items():
                        if v > len(alive):
                            floor[k] = len(alive)
            if d[3] and d[2]:
                alive.append(d)
        for d in stack:
            self.nodes[d[0]] = d[1] * d[2]


READERS = {"\\": "_backslash", "`": "_ticks", "*": "_run", "_": "_run", "[": "_bracket", "]": "_close", "!": "_bang", "<": "_angle", "&": "_reference", "\n": "_newline"}


def shown(nodes: list) -> str:
    """The whole text of nodes, of HTML nothing, with blanks together."""
    out, stack = [], list(reversed(nodes))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        else:
            stack += reversed(node[5])
    return re.sub(r"\s+", " ", "".join(out))


# ------------------------------------------------------------------------------------------------ documents
class Document:
    """A parsed body: `blocks`, and what `links`, `blanked` and `text` say of it."""

    def __init__(self, body: str):
        self.body = body
        source = body
        for k in range(ROUNDS + 1):
            self.blocks = Blocks(source, blank_vendor=k == ROUNDS)
            vendor = self.blocks.vendor
            if not vendor or k == ROUNDS:
                break
            parts, at = [], 0
            for offset, length in vendor:
                parts += [source[at:offset], " " * length]
                at = offset + length
            source = "".join([*parts, source[at:]])
        self._inlines: list[tuple[Leaf, Inlines, list[int], list[int]]] | None = None

    def inlines(self) -> list[tuple[Leaf, Inlines, list[int], list[int]]]:
        if self._inlines is None:
            self._inlines = []
            for leaf in self.blocks.leaves:
                if leaf.kind in ("paragraph", "heading", "cell"):
                    text, places, offsets = leaf.text()
                    self._inlines.append((leaf, Inlines(text, self.blocks.definitions), places, offsets))
        return self._inlines

    def links(self) -> list[tuple[int, int, bool, str, str]]:
        """(offset, end, is image, text, destination) of links and images in order, not of autolinks nor of what an image holds."""
        out = []
        for _, inlines, places, offsets in self.inlines():
            stack = [n for n in reversed(inlines.nodes) if isinstance(n, tuple)]
            while stack:
                kind, _, url, start, end, inner = stack.pop()
                if kind == "html":
                    continue
                a, b = bisect_right(places, start) - 1, bisect_right(places, end - 1) - 1
                out.append((offsets[a] + start - places[a], offsets[b] + end - places[b], kind == "image", shown(inner), url))
                if kind == "link":
                    stack += [n for n in reversed(inner) if isinstance(n, tuple)]
        return out

    def hidden(self) -> Iterator[tuple[int, int]]:
        """Ranges of code, comments and definitions."""
        for leaf in self.blocks.leaves:
            if leaf.kind == "code" or leaf.kind == "html" and leaf.pieces and leaf.pieces[0][1].lstrip().startswith("<!--"):
                yield leaf.start, leaf.end
        yield from self.blocks.defined
        for _, inlines, places, offsets in self.inlines():
            for start, end in [*inlines.code, *inlines.comments]:
                a, b = bisect_right(places, start) - 1, bisect_right(places, end - 1) - 1
                yield offsets[a] + start - places[a], offsets[b] + end - places[b]

    def blanked(self) -> str:
        """The body with code, comments and definitions blanked, so that offsets stay."""
        parts, at = [], 0
        for start, end in sorted(self.hidden()):
            if end > at:
                start = max(start, at)
                parts += [self.body[at:start], re.sub(r"[^\r\n]", " ", self.body[start:end])]
                at = end
        return "".join([*parts, self.body[at:]])

    def text(self) -> str:
        """What the body says, a line per block and cell: code as it is, images by their descriptions, without tags."""
        out, inlines, end, kind = [], iter(self.inlines()), 0, ""
        for leaf in self.blocks.leaves:
            if leaf.kind == "code":
                said = "\n".join(x for _, x in leaf.pieces)
            elif leaf.kind == "html":
                said = without_tags("\n".join(x for _, x in leaf.pieces))
            else:
                found = next(inlines)[1]
                # text that merely looks like a tag is kept, so it is taken past the removal of tags
                said = "".join(x if isinstance(x, str) else without_tags(x[1]) if x[0] == "html" else shown(x[5]) for x in found.nodes)
            if said:
                # blank lines between blocks stay, but for the rule below the head of a table
                gap = 1 if kind == leaf.kind == "cell" else max(1, self.body.count("\n", end, leaf.start))
                out.append("\n" * gap + said if out else said)
                end, kind = max(leaf.end, leaf.pieces[-1][0] + len(leaf.pieces[-1][1])), leaf.kind
        return "".join(out)


#: Elements of HTML; other names in angle brackets are placeholders of an author.
KNOWN_TAGS = {*BLOCK_TAGS, *(
    "a abbr acronym applet area audio b bdi bdo big blink br button canvas cite code data datalist del dfn em embed font i img input ins kbd label map mark marquee meta meter noscript "
    "object output path picture pre progress q rp rt ruby s samp script select slot small source span strike strong style sub sup svg template textarea time tt u use var video wbr"
).split()}
DROPPED = re.compile(r"<(script|style|svg|noscript)\b[^<>]*+>(?:[^<]|<(?!/\1))*+(?:</\1[^<>]*+>|\Z)|<!--(?:[^-]|-(?!->))*+(?:-->|\Z)", re.I)
ANY_TAG = re.compile(r"<(/?)([A-Za-z][\w.-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>")


def without_tags(text: str) -> str:
    """HTML without its tags, a line per block; a name that is no element stays."""

    def one(m: re.Match) -> str:
        tag = m[2].lower()
        if tag not in KNOWN_TAGS and not m[1] and not m[3].endswith("/"):
            return m[0]
        return "\n" if tag in BLOCK_TAGS or tag == "br" else ""

    return REFERENCE.sub(lambda m: referenced(m[1]) or m[0], ANY_TAG.sub(one, DROPPED.sub("", text)))

"""Secret scan by assignment-aware lexing.

Two layers, both over whole texts:

* base patterns, leftmost and non-overlapping for each kind: an assignment to a password-like name with a value of 12
  or more characters, access key ids, and long runs of hexadecimal digits;
* a lexer of source and configuration syntax. It knows assignments (``=``, ``:``, ``:=``, ``=>``, with type notes,
  subscripts and labels: in ``label: name = value`` both names hold the value), quoted, triple-quoted and backtick literals with escapes, indented blocks (``name: |``), elements
  (``<name>x</name>``), sections (``[name]``), literals inside decoding calls, sums, and lists. It yields name-literal
  pairs, where a name carries the keys that it is nested in.

Constants. A value that mentions a name takes over what that name holds: its last assignment before, else its first
one after, in the innermost scope that has one. Scopes are braces, indented bodies and comments; what a comment assigns
is scored, but code outside does not see it. Names of names are followed to the end, and cycles stop where they close.
Each literal is scored by how sensitive the name that it reaches is and by how random the whole value looks; literals
that score enough are spans of kind ``lexed``, at the place where they are written.

Spans are code points, end exclusive. The lexer runs on texts that have a word of `SENSITIVE` and an assignment, which
all its spans need. Its time is linear in the text, but for a logarithm where a name is assigned many times in one scope:
a comment is read once within its bounds, patterns do not backtrack, and names are looked up in one walk through the scopes.

Defined results: null and empty texts have no spans. Ids may repeat or be null. No rows give no rows. Only id and text
are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# a run of 18 with its four letters, and of 16: the shorter runs that fail need not be matched
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

STRING = r"""(?:[rbfuRBFU]{1,2}(?=["']))?+(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)"""
COMMENT = r"""(?P<comment>/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z) | <!--(?:[^-]|-(?!->))*+(?:-->|\Z) | (?:(?<=\s)|(?<![\s\S]))(?:\#|//|--[ ]|;)[^\n]*+) |"""
CODE = r"""
      <(?P<tag>[A-Za-z_][\w.\-:]*+)(?:[ \t][^<>\n]*+)?>(?P<inner>[^<>]*+)</
    | (?:(?<=\n)|(?<![\s\S]))\[(?P<section>[^\[\]\n]*+)\][ \t]*+(?=\n|\Z)
    | \b(?:def|class|function|func|fn)[ \t]++\w++(?P<body>[^\n{;]*+)
    | (?:(?<![\w.\-$])(?P<name>[A-Za-z_$][\w.\-$]*+)["'`]?\]?|(?<![\w"'])["'](?P<key>[^"'\n\\]++)["']\]?)[ \t]*+(?P<op>:=|=>|=(?!=)|:(?!:|//))
    | (?P<brace>[{}])
    | \n(?P<indent>[ \t]*+)(?=[^\s])
    """
#: What the lexer stops at, outside and within a comment.
EVENT, WITHIN = re.compile(COMMENT + CODE, re.X), re.compile(CODE, re.X)
TRIPLE = re.compile(r'[rbfuRBFU]{0,2}("""|\'\'\')')
VALUE = re.compile(rf"(?P<quoted>{STRING})|(?P<call>[A-Za-z_$][\w.$]*+)\(|(?P<bare>[^\s\"'`,;&<>{{}}()\[\]]++)")
BLOCK = re.compile(r"[ \t]*+[|>][+\-0-9]{0,2}[ \t]*+\n")
#: name: type = value, where the type has brackets or alternatives or is one of TYPES.
NOTE = re.compile(r"""[ \t]*+(?P<type>[A-Za-z_][\w.]*+)(?P<more>(?:[ \t]*+(?:\[[^\[\]\n="']*+(?:\[[^\[\]\n="']*+\][^\[\]\n="']*+)*+\]|\|[ \t]*+[A-Za-z_][\w.]*+))*+)[ \t]*+=(?!=)""")
TYPES = {"str", "string", "bytes", "bytearray", "int", "float", "bool", "boolean", "number", "any", "object", "char", "text", "final", "const"}
#: label: name = value
LABELLED = re.compile(r"""[ \t]*+(?:(?P<name>[A-Za-z_$][\w.\-$]*+)["'`]?\]?|["'](?P<key>[^"'\n\\]++)["']\]?)[ \t]*+(?P<op>:=|=>|=(?!=)|:(?!:|//))""")
BLANK, GAP, LINE = re.compile(r"[ \t]*+"), re.compile(r"(?:\s|\\\n)*+"), re.compile(r"[^\n]*+\n?")
ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.S)
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
NAME = re.compile(r"[A-Za-z_$][\w.$]*\Z")
#: Calls whose literals are the value; those of other calls (lookups by name, prompts) are not.
DECODERS = {"bytes", "str", "string", "fromhex", "b64decode", "decode", "encode", "unhexlify", "secretstr", "atob", "from", "quote", "strip", "trim"}
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 0.9, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "cred": 0.7, "auth": 0.6, "authorization": 0.8, "bearer": 0.8,
    "private": 0.5, "access": 0.4, "api": 0.4, "key": 0.5, "signing": 0.4, "encryption": 0.4, "client": 0.2,
}
# in every name that scores: all words of SENSITIVE but those that hold another of them
HINT = re.compile("|".join(w for w in SENSITIVE if not any(v != w and v in w for v in SENSITIVE)), re.I)
PLACEHOLDER = re.compile(r"(?:change[-_]?me|example|placeholder|your[-_].*|dummy|x{4,}|\*{3,}|null|none|true|false|undefined|\$\{?\w+\}?|%\w+%|<[^>]*>)\Z", re.I)
THRESHOLD, NESTED = 0.55, 0.75


def name_score(name: str) -> float:
    """0 to 1: how sensitive the words of a name are together, plurals like singulars."""
    words = {w.lower() for w in WORDS.findall(name)}
    return min(1.0, sum(SENSITIVE.get(w, 0.0) or SENSITIVE.get(w.removesuffix("s"), 0.0) for w in words))


def chars_score(chars: dict[str, float]) -> float:
    """0 to 1: how much a literal with so many of each character looks like a secret."""
    n = sum(chars.values())
    if n < 8 or any(c.isspace() for c in chars):
        return 0.0
    shares = [c / n for c in chars.values()]
    entropy = -sum(p * math.log2(p) for p in shares if p)
    kinds = sum(any(f(c) for c in chars) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in chars)
    return min(1.0, 0.2 * min(entropy, 4.0) + 0.1 * (kinds - 1) + min(n, 24) / 120)


class Value:
    """What a name holds: literals and values of other names, in order.

    Values of names are shared, not copied, so that neither long sums nor doublings (k = k + k) grow beyond the text;
    characters are counted with their repeats.
    """

    __slots__ = ("parts", "chars", "marked", "name", "outer", "scope", "at", "order")

    def __init__(self, name: str = "", outer: float = 0.0, scope: int = 0, at: int = 0):
        self.name, self.outer, self.scope, self.at, self.order = name, outer, scope, at, 0
        self.parts: list = []  # (decoded literal, start, end, bare) or, once resolved, Value
        self.chars: dict[str, float] | None = None
        self.marked = False

    def count(self) -> dict[str, float]:
        """Characters of the whole value; a value that is part of itself counts as nothing there."""
        stack, open_ = [(self, False)], set()
        while stack:
            value, done = stack.pop()
            if value.chars is not None:
                continue
            inner = [p for p in value.parts if isinstance(p, Value)]
            if not done:
                open_.add(id(value))
                stack.append((value, True))
                stack += [(p, False) for p in inner if p.chars is None and id(p) not in open_]
                continue
            chars: dict[str, float] = {}
            for part in value.parts:
                for c, n in (Counter(part[0]) if isinstance(part, tuple) else part.chars or {}).items():
                    chars[c] = chars.get(c, 0) + n
            if chars and max(chars.values()) > 1e100:  # only shares matter then
                chars = {c: n / 1e50 for c, n in chars.items()}
            value.chars = chars
            open_.discard(id(value))
        return self.chars

    def literals(self, once: str = "") -> Iterator[tuple[str, int, int]]:
        """The distinct literals in order; with "marked", without those that such a call gave before."""
        seen: set[int] = set()
        stack: list = [self]
        while stack:
            part = stack.pop()
            if isinstance(part, tuple):
                yield part[:3]
            elif not (part.marked if once else id(part) in seen):
                seen.add(id(part))
                part.marked = part.marked or bool(once)
                stack += reversed(part.parts)

    def literal(self) -> str:
        return "".join(x for x, _, _ in self.literals())


def unescaped(literal: str) -> str:
    if "\\" not in literal:
        return literal
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else PLAIN.get(m[3], m[3]), literal)


class Lexer:
    """Name-literal pairs of one text: `values`, in the order of the text."""

    def __init__(self, text: str):
        self.text, self.values = text, []
        # scopes: parent, and by scope and name the values in order
        self.parent, self.defined = [-1], {}
        # open scopes: (scope, sensitivity of the keys around, kind, indentation or end)
        self.stack: list[tuple[int, float, str, int]] = [(0, 0.0, "text", -1)]
        self.braces = 0  # of the open scopes
        self._scan()
        self._resolve()

    # -------------------------------------------------------------------------------- scopes
    def _push(self, kind: str, limit: int, outer: float) -> None:
        self.parent.append(self.stack[-1][0])
        self.stack.append((len(self.parent) - 1, outer, kind, limit))
        self.braces += kind == "brace"

    def _pop(self) -> str:
        kind = self.stack.pop()[2]
        self.braces -= kind == "brace"
        return kind

    def _scan(self) -> None:
        text, at, indent = self.text, 0, len(BLANK.match(self.text)[0])
        comment, outside = -1, 0  # where the comment that is being read ends, and the braces around it
        while True:
            if 0 <= comment <= at:
                # what was opened inside the comment ends with it
                while self._pop() != "comment":
                    pass
                comment = -1
            m = EVENT.search(text, at) if comment < 0 else WITHIN.search(text, at, comment)
            if m is None and comment < 0:
                break
            if m is None:
                at = comment
                continue
            at = m.end()
            outer = self.stack[-1][1]
            if comment < 0 and m["comment"] is not None:
                outside = self.braces
                self._push("comment", m.end(), 0.0)
                at, comment = m.start() + 1, m.end()
            elif m["tag"] is not None:
                if text.startswith(m["tag"], at):
                    value = self._begin([m["tag"]], m.start())
                    self._lines(value, m["inner"], m.start("inner"))
            elif m["section"] is not None:
                while len(self.stack) > 1 and self.stack[-1][2] != "comment":
                    self._pop()
                self._push("section", -1, name_score(m["section"]))
            elif m["body"] is not None:
                if m["body"].rstrip().endswith(":"):
                    self._push("indent", indent, outer)
            elif m["brace"] == "{":
                self._push("brace", -1, outer)
            elif m["brace"] == "}":
                # a brace within a comment closes none outside of it
                if self.braces > (outside if comment >= 0 else 0):
                    while self._pop() != "brace":
                        pass
            elif m["indent"] is not None:
                indent = len(m["indent"])
                while self.stack[-1][2] == "indent" and indent <= self.stack[-1][3]:
                    self._pop()
            else:
                at = self._assignment(m["name"] or m["key"], m.start(), m["op"], at, indent)

    # -------------------------------------------------------------------------------- values
    def _begin(self, names: list[str], at: int) -> Value:
        """A value of the last name, which the labels before it hold as well."""
        scope, outer, _, _ = self.stack[-1]
        value = Value(max(names, key=name_score) if len(names) > 1 else names[0], outer, scope, at)
        value.order = len(self.values)
        self.values.append(value)
        for known in {x for name in names for x in (name, name.rpartition(".")[2])}:
            self.defined.setdefault((scope, known), []).append(value)
        return value

    def _lines(self, value: Value, body: str, at: int) -> None:
        """Adds the lines of a literal, without the blanks around them."""
        for line in body.split("\n"):
            bare = line.strip()
            if bare:
                start = at + line.index(bare)
                value.parts.append((unescaped(bare), start, start + len(bare), False))
            at += len(line) + 1

    def _assignment(self, name: str, begin: int, op: str, at: int, indent: int) -> int:
        """Reads the value behind an operator; the place where it ends."""
        text, names = self.text, [name]
        while op == ":":
            if m := BLOCK.match(text, at):
                value, at = self._begin(names, begin), m.end()
                while at < len(text):
                    line = LINE.match(text, at)
                    if line[0].strip() and len(BLANK.match(line[0])[0]) <= indent:
                        break
                    self._lines(value, line[0].rstrip("\n"), at)
                    at = line.end()
                return at - 1
            if (m := NOTE.match(text, at)) and (m["more"] or m["type"].lower() in TYPES):
                at, op = m.end(), "="
            elif m := LABELLED.match(text, at):
                name = m["name"] or m["key"]
                at, op = m.end(), m["op"]
                names.append(name)
            else:
                break
        at = BLANK.match(text, at).end()
        outer = min(1.0, self.stack[-1][1] + NESTED * max(map(name_score, names)))
        if at < len(text) and text[at] == "{":
            self._push("brace", -1, outer)
            return at + 1
        if op == ":" and (at >= len(text) or text[at] == "\n"):
            self._push("indent", indent, outer)
            return at
        return self._sum(self._begin(names, begin), at)

    def _sum(self, value: Value, at: int) -> int:
        """Operands joined by +, or side by side in brackets; commas in brackets begin the next element."""
        text, depth = self.text, 0
        while at < len(text):
            at = (GAP if depth else BLANK).match(text, at).end()
            if m := TRIPLE.match(text, at):
                end = text.find(m[1], m.end())
                if end < 0:
                    return m.end()
                self._lines(value, text[m.end() : end], m.end())
                at = end + 3
            elif at < len(text) and text[at] in "([":
                depth, at = depth + 1, at + 1
                continue
            elif m := VALUE.match(text, at):
                if m["quoted"] is not None:
                    start = m.start() + len(m[0]) - len(m[0].lstrip("rbfuRBFU"))
                    value.parts.append((unescaped(text[start + 1 : m.end() - 1]), start + 1, m.end() - 1, False))
                    at = m.end()
                elif m["call"] is not None:
                    at = m.end()
                    if m["call"].rpartition(".")[2].lower() not in DECODERS:
                        return at  # what stands in its brackets is read as text of its own
                    depth += 1
                    continue
                else:
                    at = m.end()
                    bare = m["bare"]
                    if bare != "+":
                        open_sum = bare[-1] == "+" and at < len(text) and text[at] in "\"'`"
                        bare = bare[:-1] if open_sum else bare
                        if bare:
                            value.parts.append((bare, m.start(), m.start() + len(bare), True))
                        if open_sum:
                            continue
            else:
                return at
            # behind an operand
            while True:
                at = (GAP if depth else BLANK).match(text, at).end()
                if depth and at < len(text) and text[at] in ")]":
                    depth, at = depth - 1, at + 1
                elif depth and at < len(text) and text[at] == ",":
                    value, at = self._begin([value.name], at), at + 1
                    break
                elif at < len(text) and text[at] == "+":
                    at = GAP.match(text, at + 1).end()
                    break
                elif at < len(text) and text[at] in "\"'`":
                    break  # adjacent literals are one
                elif depth and VALUE.match(text, at):
                    break
                else:
                    return at
        return at

    # -------------------------------------------------------------------------------- constants
    def _resolve(self) -> None:
        """Puts what names hold in their place, in one walk through the scopes in the order of the text.

        On the way `holders` has for each name the scopes around that assign it anywhere, the innermost last.
        """
        last = list(range(len(self.parent)))  # scopes are numbered as they open, so those inside one follow it
        for scope in range(len(last) - 1, 0, -1):
            last[self.parent[scope]] = max(last[self.parent[scope]], last[scope])
        names: dict[int, list[str]] = {}
        for scope, name in self.defined:
            names.setdefault(scope, []).append(name)
        holders: dict[str, list[int]] = {}
        path: list[int] = []
        for value in self.values:
            while path and not path[-1] <= value.scope <= last[path[-1]]:
                for name in names.get(path.pop(), ()):
                    holders[name].pop()
            inward, scope = [], value.scope
            while scope >= 0 and (not path or scope != path[-1]):
                inward.append(scope)
                scope = self.parent[scope]
            for scope in reversed(inward):
                path.append(scope)
                for name in names.get(scope, ()):
                    holders.setdefault(name, []).append(scope)
            value.parts = [x for part in value.parts for x in self._resolved(part, value, holders)]

    def _find(self, name: str, user: Value, holders: dict[str, list[int]]) -> Value | None:
        for scope in reversed(holders.get(name, ())):
            found = self.defined[scope, name]
            before = bisect_left(found, user.order, key=lambda v: v.order)
            if before:
                return found[before - 1]
            if later := next((v for v in found if v is not user), None):
                return later
            # all that this scope has is the user itself, which no scope further out has
        return None

    def _resolved(self, part: tuple, user: Value, holders: dict[str, list[int]]) -> list:
        if isinstance(part, Value) or not part[3]:
            return [part]
        names = part[0].split("+")
        if not all(NAME.match(n) for n in names):
            return [part]
        found = [self._find(n, user, holders) or self._find(n.rpartition(".")[2], user, holders) for n in names]
        if not any(found):
            return [part]
        return [f for f in found if f is not None]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(x in low for x in ASSIGN_NAMES) or not low.isascii():
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, at the place where they are written."""
    if not any(c in text for c in "=:<") or not HINT.search(text):
        return []
    found = set()
    for value in Lexer(text).values:
        sensitive = min(1.0, name_score(value.name) + value.outer)
        if sensitive < threshold or not value.parts:
            continue
        chars = value.count()
        # a bare word of letters of one case is prose
        if len(value.parts) == 1 and isinstance(value.parts[0], tuple) and value.parts[0][3] and value.parts[0][0].isalpha() and value.parts[0][0][1:].islower():
            continue
        if sensitive * chars_score(chars) >= threshold and not PLACEHOLDER.match(value.literal()):
            found.update((a, b, "lexed") for _, a, b in value.literals("marked") if b > a)
    return list(found)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, n_lexed, spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                base, more = base_spans(text), lexed_spans(text, threshold)
                n = Counter(k for _, _, k in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(digest(base).encode()).hexdigest(), len(more), digest(base + more)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_lexed", "spans"],
            )

    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, n_lexed long, spans string")


def op4(spark, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")

"""The Markdown parser on cases of the specification, against a plain reader of brackets, and on long odd bodies."""

import random
import re
import time

import pytest

from quillmap.functions import dom
from quillmap.functions import markdown as M
from quillmap.functions.commonmark import Document


def found(body):
    return [(image, text, url) for _, _, image, text, url in Document(body).links()]


@pytest.mark.parametrize("body,links", [
    ("[a](<b c.md>)", [(0, "a", "b c.md")]), ("[x [y](z.md)](w.md)", [(0, "y", "z.md")]), ("    [a](b)\n\n[c](d)", [(0, "c", "d")]), ("[t](u\\(v.md)", [(0, "t", "u(v.md")]),
    ('[a](b "it\'s")', [(0, "a", "b")]), ("[One  Two]\n\n[one two]: x.md", [(0, "One Two", "x.md")]), ("[![alt](img.png)](url)", [(0, "alt", "url"), (1, "alt", "img.png")]),
    ("[a]: /u\n[a] and [b][a] ![c][a]", [(0, "a", "/u"), (0, "b", "/u"), (1, "c", "/u")]), ("| [a](b) | [c](d) |\n|---|---|\n| [e](f) | `[g](h)` |", [(0, "a", "b"), (0, "c", "d"), (0, "e", "f")]),
    ("*[a](b)* **[c *d* e](f)**", [(0, "a", "b"), (0, "c d e", "f")]), ("[a](b(c)d)", [(0, "a", "b(c)d")]), ("[a](b(c)", []), ("`` [a](b) ` `` [e](f)", [(0, "e", "f")]),
    ("- [a](b)\n\n      [code](x)\n\n  ```\n  [z](z)\n  ```\n> [q](r\n> \"title\")", [(0, "a", "b"), (0, "q", "r")]), ("[a](/search?a=1&amp;b=2)", [(0, "a", "/search?a=1&b=2")]),
    ("\\[a](b) \\\\[c](d)", [(0, "c", "d")]), ("<!-- [a](b) -->\n\n[c](d)", [(0, "c", "d")]), ("x <!-- [a](b) --> [c](d)", [(0, "c", "d")]), ("![x [y](z)](w)", [(1, "x y", "w")]), ("[foo *bar](baz*)", [(0, "foo *bar", "baz*")]),
    ("[a\n]: b\n\n[a]", [(0, "a", "b")]), ("[a]: one\n[A]: two\n\n[a][]", [(0, "a", "one")]), ("<https://a.io> [x](<>)", [(0, "x", "")]), ("[a](b\n\nc)", []), ("para\n    [a](b)", [(0, "a", "b")]),
    ("> [a]: /x\n\n[a]", [(0, "a", "/x")]), ("[a](b 'c' d)", []), ("\\![a](b) !\\[c](d)", [(0, "a", "b")]), ("[a] (b)", []), ("# [h](i) #\n[j](k)\n===", [(0, "h", "i"), (0, "j", "k")]),
    ("1. a\n   - [n](m)\n\n\t[code](no)", [(0, "n", "m"), (0, "code", "no")]), ("```\n[a](b)", []), ("<div>\n[a](b)\n</div>\n\n[c](d)", [(0, "c", "d")]), ("[&copy;](&#x61;)", [(0, "©", "a")]),
])
def test_links(body, links):
    assert found(body) == [(bool(image), text, url) for image, text, url in links]


def test_vendor_fences_to_a_fixpoint():
    body = "```a|b\n[one](1)\n````c|d\n[two](2)\n\n```\n[no](x)\n```\n[three](3)"
    assert [x[2] for x in found(body)] == ["1", "2", "3"]
    for offset, end, _, text, _ in Document(body).links():
        assert re.fullmatch(rf"\[{text}\]\(\d\)", body[offset:end])


def plain_resource(rest):
    """Where "(destination (title))" ends; None where it is none."""
    m = re.match(r"\(\s*", rest)
    if not m:
        return None
    k, depth = m.end(), 0
    while k < len(rest) and not rest[k].isspace() and not (rest[k] == ")" and not depth):
        depth += {"(": 1, ")": -1}.get(rest[k], 0)
        k += 1
    m = re.match(r"(?:\s+\([^()]*\))?\s*\)", rest[k:])
    return k + m.end() if m and not depth else None


def plain_links(text):
    """Inline links of one line without emphasis, labels or HTML, each bracket looked up from the left end."""
    masked, k = list(text), 0
    while k < len(text):
        if text[k] == "\\" and k + 1 < len(text) and text[k + 1] in "\\`[]()!":
            masked[k] = masked[k + 1] = "x"
            k += 2
        elif text[k] == "`":
            n = len(text[k:]) - len(text[k:].lstrip("`"))
            m = next((m for m in re.finditer("`+", text[k + n :]) if len(m[0]) == n), None)
            end = k + n + m.end() if m else k + n
            if m:
                masked[k:end] = "c" * (end - k)
            k = end
        else:
            k += 1
    line, out, k = "".join(masked), [], 0
    openers = []
    while k < len(line):
        if line[k] == "[":
            image = k > 0 and line[k - 1] == "!"
            openers.append([k - image, image, True])
        elif line[k] == "]" and openers:
            start, image, active = openers.pop()
            m = plain_resource(line[k + 1 :]) if active else None
            if m:
                end = k + 1 + m
                out = [o for o in out if not (image and o[0] > start)]
                out.append((start, end, image))
                if not image:
                    for o in openers:
                        o[2] = o[2] and o[1]
                k = end
                continue
        k += 1
    return sorted(out)


def test_against_a_plain_reader():
    rng = random.Random(5)
    parts = ["[", "]", "](", ")", "(u)", "[a](b)", "![", "!", "t ", "`", "``", "\\", "w", "](v)", "(", " "]
    seen = 0
    for _ in range(40_000):
        text = "q" + "".join(rng.choices(parts, k=rng.randint(1, 14)))
        # destinations here hold no code or escapes, which the plain reader does not read
        if re.search(r"\(.*[`\\]", text):
            continue
        got = [(a, b, i) for a, b, i, _, _ in Document(text).links()]
        assert got == plain_links(text.rstrip()), text
        seen += len(got)
    assert seen > 5000


@pytest.mark.parametrize("unit", ["[", "[a](", "![", "*a ", "**a", "`", "``` ", "<a ", "<!--", "[a](b ", "[a][b", "> ", "- ", "- x", "(", "[a]: b\n", "|a", "```x|\n", '<a b="', "\\", "&amp", "*_", "[a](<", "[[]()", "![![a](b) ", "](x)", "> \n", "- \n\n", "a\n===\n", "1. "])
def test_time_is_linear(unit):
    for tail in ("", "x"):
        body = unit * (500_000 // len(unit)) + tail
        start = time.monotonic()
        document = Document(body)
        document.links(), document.text()
        assert len(document.blanked()) == len(body)
        assert time.monotonic() - start < 20  # a few seconds on a free machine


@pytest.mark.parametrize("unit", ["a-", "a: ", "a:b", "- ", "# ", "[a](", "**", "<!--", "|-"])
def test_other_figures_are_linear(unit):
    body = unit * (500_000 // len(unit))
    start = time.monotonic()
    M.content_start(body), M.fences(body), M.inline_text(body)
    assert time.monotonic() - start < 20


@pytest.mark.parametrize("unit", ["<div>", "<ul><li>", "<blockquote>", "<b>", "<p>", "</div>", "<table><tr><td>", "<h1>", "<span><p>", "<", "<!--", "<a href=x>", "<div class=tabs__item role=tablist>"])
def test_deep_pages(unit):
    html = unit * 30_000 + "text of the innermost element"
    start = time.monotonic()
    dom.to_markdown(html), dom.rendering(html), dom.main_text(html), dom.headers_of(html)
    assert time.monotonic() - start < 30
    assert unit == "<!--" or "innermost" in dom.to_markdown(html)


def test_sums_of_a_tree():
    rng = random.Random(8)
    for _ in range(200):
        html = "".join(rng.choice(["<div>", "</div>", "<a>", "</a>", " x ", "\n", "word", "<b>", "</b>", "<nav>", "</nav>"]) for _ in range(rng.randint(1, 40)))
        root = dom.parse(html)
        for skip in (None, dom.is_chrome):
            sums = dom.Sums(root, skip)
            for node in [root, *root.walk(skip)]:
                links = [a for a in node.walk(skip) if a.tag == "a"]
                assert sums.size[id(node)] == len(node.text(skip).strip())
                assert sums.links[id(node)] == (len(links), sum(len(a.text(skip).strip()) for a in links))


def test_links_of_converted_pages():
    html = '<ul><li><a href="/a,b">x</a><ul><li><a href="c(d)">y z</a></li></ul></li></ul><p><a href="e.md"><b>q</b></a> <img src="i.png" alt="w"></p>'
    assert found(dom.to_markdown(html)) == [(False, "x", "/a,b"), (False, "y z", "c(d)"), (False, "q", "e.md"), (True, "w", "i.png")]


def test_shares_of_links_and_texts_of_headings():
    """In one pass each, with the results of a pattern and of a walk for each heading."""
    rng = random.Random(1)
    for _ in range(20_000):
        line = "".join(rng.choices("[]()a", k=rng.randint(1, 14)))
        assert M.link_share(line) == sum(map(len, M.LINK.findall(line))) / len(line)
    for _ in range(300):
        root = dom.parse("".join(rng.choices(["<div>", "</div>", "<h1>", "<h2>", "</h2>", "t ", "<b>", "</b>"], k=30)))
        nodes = list(root.walk())
        assert dom.texts_of(root, {id(n) for n in nodes}) == {id(n): n.text() for n in nodes}
    start = time.monotonic()
    assert [M.link_share(u * 100_000) for u in ("[a](", "[", "[]", "[a]", "[a]()")] == [0.0] * 5
    assert dom.headers_of("<h1>" * 30_000 + "t") == ["t"] * 30_000
    assert time.monotonic() - start < 10

"""Arrow-batched columns of the parsers: one pass per body computes all figures of a page.

Null bodies count as empty. Rows are independent, so these run where the scan puts them, without a shuffle. A batch from
Spark has up to 10,000 bodies; its results are handed back in smaller ones (see _handed), so that what a worker holds does
not grow with the number of bodies that reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dom, markdown

RENDERING = "spa_marker string, headings int, paragraphs int, code_blocks int, has_main boolean, visible int, substantive boolean, has_content boolean, length int"
PANELS = "array<struct<label: string, html: string>>"
TABS = f"array<struct<framework: string, tab_count: int, html: string, panels: {PANELS}>>"
LINKS = "array<struct<offset: int, image: boolean, text: string, url: string, class: string, resolved: string, fetch: string, unresolvable: boolean, cross_origin: boolean, markdown: boolean>>"
BULK = "elements array<struct<kind: string, form: string, start: int, chars: int, share: int, position: int, rows: int, columns: int, uniformity: double>>, share int"
WINDOWS = "signals array<struct<type: string, text: string, url: string, offset: int>>, continuation string"


#: Results are handed on once their bodies have so many characters, where each row of a list counts as ROW_CHARS.
BATCH_CHARS, ROW_CHARS = 1_000_000, 50


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})


def _objects(rows: list) -> pd.Series:
    return pd.Series(rows, dtype=object)


def _handed(f, batches: Iterator[tuple[pd.Series, ...]], made):
    """made([f(*values), ...]) of the rows of batches, in order, in pieces of about BATCH_CHARS."""
    for columns in batches:
        rows, weight = [], 0
        for values in zip(*columns):
            row = f(*values)
            rows.append(row)
            weight += len(values[0] or "") + (ROW_CHARS * len(row) if isinstance(row, list) else 0)
            if weight >= BATCH_CHARS:
                yield made(rows)
                rows, weight = [], 0
        if rows:
            yield made(rows)


def page_metrics(body: Column) -> Column:
    """struct of the Markdown of an HTML page, its rendering figures and rendering status."""
    names = ["markdown", "status", *(x.split()[0] for x in RENDERING.split(", "))]

    def one(html: str) -> dict:
        root = dom.parse(html)
        r = dom.rendering(html, root)
        return r | {"markdown": dom.to_markdown(html, root), "status": dom.rendering_status(r)}

    return _struct(one, names, f"markdown string, status string, {RENDERING}")(body)


def page_markdown(body: Column) -> Column:
    """The Markdown of page_metrics alone."""
    return _simple(dom.to_markdown, "string")(body)


def _struct(f, names: list[str], kind: str):
    def run(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _handed(f, ((body.fillna(""),) for body in bodies), lambda rows: _frame(rows, names))

    return F.pandas_udf(run, kind)


def _simple(f, kind: str):
    def run(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _handed(f, ((body.fillna(""),) for body in bodies), _objects)

    return F.pandas_udf(run, kind)


def substantive(body: Column) -> Column:
    """Whether an HTML body holds content of its own; null bodies do not, and cost nothing."""
    return _simple(lambda x: bool(x) and bool(dom.rendering(x)["substantive"]), "boolean")(body)


def content_start(body: Column) -> Column:
    return _simple(markdown.content_start, "int")(body)


NODES = {
    "pre": "int", "last": "int", "parent": "int", "depth": "int", "tag": "string", "id": "string", "classes": "array<string>", "role": "string", "href": "string", "start": "int", "end": "int", "own": "string",
}


def nodes(body: Column, fields: tuple[str, ...] = tuple(NODES)) -> Column:
    """The elements of an HTML body in document order (see dom.node_rows), with the given fields only."""
    kind = f"array<struct<{', '.join(f'{x}: {NODES[x]}' for x in fields)}>>"
    return _simple(lambda x: [{k: n[k] for k in fields} for n in dom.node_rows(x)], kind)(body)


def tab_groups(body: Column) -> Column:
    return _simple(dom.tab_groups, TABS)(body)


def panel_headers(body: Column) -> Column:
    return _simple(dom.headers_of, "array<string>")(body)


def fences(body: Column) -> Column:
    return _struct(markdown.fences, ["count", "open_line", "marker", "status"], "count int, open_line int, marker string, status string")(body)


def markdown_text(body: Column) -> Column:
    """struct of a Markdown body's text and its repeated items."""
    return _struct(markdown.text_and_items, ["text", "items", "distinct", "rows"], "text string, items int, distinct int, rows int")(body)


def main_text(body: Column, exclusions: tuple[str, ...] = ()) -> Column:
    return _struct(lambda x: dom.main_text(x, exclusions), ["text", "largest_list", "largest_table"], "text string, largest_list int, largest_table int")(body)


def bulk_data(body: Column, table_rows: int = 20, blob_chars: int = 2000) -> Column:
    return _struct(lambda x: markdown.bulk_data(x, table_rows, blob_chars), ["elements", "share"], BULK)(body)


def links(body: Column, base: Column) -> Column:
    @F.pandas_udf(LINKS)
    def run(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from _handed(lambda x, y: markdown.links(x or "", y or ""), rows, _objects)

    return run(body, base)


def all_links(body: Column) -> Column:
    """array of struct(offset, image, text, url): every link and image of a Markdown body as written, in order."""
    names = ("offset", "image", "text", "url")
    return _simple(lambda x: [dict(zip(names, row)) for row in markdown.raw_links(x)], "array<struct<offset: int, image: boolean, text: string, url: string>>")(body)


def resolved(url: Column, base: Column) -> Column:
    """url against base; null where it cannot be."""

    @F.pandas_udf("string")
    def run(url: pd.Series, base: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return urljoin(y or "", x or "") or None
            except ValueError:
                return None

        return pd.Series([one(x, y) for x, y in zip(url, base)], dtype=object)

    return run(url, base)


def pagination(body: Column, base: Column, header: Column | None = None) -> Column:
    @F.pandas_udf(WINDOWS)
    def run(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from _handed(lambda x, y, z: markdown.pagination(x or "", y or "", z), rows, lambda some: _frame(some, ["signals", "continuation"]))

    return run(body, base, F.lit(None).cast("string") if header is None else header)

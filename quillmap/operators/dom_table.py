"""Pages as tables of elements, and structural joins over them.

An element covers the numbers of the elements below it, so "lies below" is a point in an interval: the joins here are the
interval join of `operators.joins` by page, whatever the depth of a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillmap.functions import dom, udf
from quillmap.operators import joins as J

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


ARROW = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def elements(pages: DataFrame, keys: list[str], body: str = "html", fields: tuple[str, ...] = tuple(udf.NODES)) -> DataFrame:
    """(keys, pre, last, parent, depth, tag, id, classes, role, href, start, end, own), or of these the given fields, of all
    elements. Null bodies have none."""
    rows = pages.filter(F.col(body).isNotNull()).select(*keys, F.col(body).alias("_body"))
    made = StructType.fromDDL(", ".join(f"{x} {udf.NODES[x]}" for x in fields))
    kind = StructType([StructField(f.name, f.dataType) for f in [*rows.schema.fields[:-1], *made.fields]])
    return rows.mapInArrow(lambda batches: _parsed(batches, fields), kind)


def _parsed(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The elements of the bodies in the last column, beside the other columns.

    One body at a time is read from its batch. Rows are handed on as in udf._handed, and within a page by their number.
    """
    kinds, most = [ARROW[udf.NODES[x]] for x in fields], udf.BATCH_CHARS // udf.ROW_CHARS
    for batch in batches:
        names, keys = [*batch.schema.names[:-1], *fields], batch.columns[:-1]
        places, rows, chars = [], [], 0

        def piece() -> pa.RecordBatch:
            at = pa.array(places, pa.int64())
            return pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

        for k, body in enumerate(batch.columns[-1]):
            html = body.as_py()
            for node in dom.each_node(html):
                places.append(k)
                rows.append(tuple(node[x] for x in fields))
                if len(rows) >= most:
                    yield piece()
                    places, rows, chars = [], [], 0
            chars += len(html)
            if rows and chars >= udf.BATCH_CHARS:
                yield piece()
                places, rows, chars = [], [], 0
        if rows:
            yield piece()


def below(nodes: DataFrame, inner: Column, outer: Column, keys: list[str], columns: tuple[str, ...] = ("tag",)) -> DataFrame:
    """(keys, inner, outer, inner_<column>, outer_<column>) of elements that meet `inner` below ones that meet `outer`."""
    points = nodes.filter(inner).select(*keys, "pre", *columns)
    # the numbers below an element; one without any covers nothing
    spans = nodes.filter(outer).select(*keys, F.col("pre").alias("at"), (F.col("pre") + 1).alias("start"), (F.col("last") + 1).alias("end"), *columns)
    pairs = J.covering(points, spans, keys, at="pre")
    named = [F.col(f"{side}_{c}").alias(f"{name}_{c}") for side, name in (("a", "inner"), ("b", "outer")) for c in columns]
    return pairs.select(*keys, F.col("a_pre").alias("inner"), F.col("b_at").alias("outer"), *named)


def nearest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of the pairs of `below`, for each inner element that with the innermost outer one."""
    rest = [c for c in pairs.columns if c not in (*keys, "inner", "outer")]
    best = pairs.groupBy(*keys, "inner").agg(F.max(F.struct("outer", *rest)).alias("_best"))
    return best.select(*keys, "inner", "_best.*")


def outside(nodes: DataFrame, inner: Column, outer: Column, keys: list[str]) -> DataFrame:
    """The elements that meet `inner` and lie below none that meets `outer`."""
    held = below(nodes, inner, outer, keys).select(*keys, F.col("inner").alias("pre")).distinct()
    return nodes.filter(inner).join(held, [*keys, "pre"], "left_anti")


def children(nodes: DataFrame, keys: list[str], tag: Column) -> DataFrame:
    """(keys, parent, children): how many elements that meet `tag` each element holds directly."""
    return nodes.filter(tag & F.col("parent").isNotNull()).groupBy(*keys, "parent").agg(F.count("*").alias("children"))

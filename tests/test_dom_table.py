"""Structural joins over tables of elements against walks of the trees."""

import random

from pyspark.sql import functions as F

from quillmap.functions import dom
from quillmap.operators import dom_table as D


def test_against_walks(spark):
    rng = random.Random(6)
    parts = ["<div>", "</div>", "<nav>", "</nav>", "<a href='x'>", "</a>", "<h2 class='k l'>", "</h2>", "text", "<br>", "<p id=q>"]
    pages = [(k, "".join(rng.choices(parts, k=rng.randint(0, 60)))) for k in range(60)] + [(90, None), (91, ""), (92, "<div>" * 3000 + "<a>x</a>")]
    nodes = D.elements(spark.createDataFrame(pages, "page long, html string"), ["page"]).cache()
    tag = F.col("tag")
    pairs = {(r["page"], r["inner"], r["outer"]) for r in D.below(nodes, tag.isin("a", "h2"), tag.isin("div", "nav"), ["page"]).collect()}
    near = {(r["page"], r["inner"], r["outer"]) for r in D.nearest(D.below(nodes, tag.isin("a", "h2"), tag.isin("div", "nav"), ["page"]), ["page"]).collect()}
    free = {(r["page"], r["pre"]) for r in D.outside(nodes, tag == "a", tag == "nav", ["page"]).collect()}
    held = {(r["page"], r["parent"]): r["children"] for r in D.children(nodes, ["page"], tag == "a").collect()}
    want, nearest, outside, direct = set(), set(), set(), {}
    for page, html in pages:
        root = dom.parse(html or "")
        order = list(root.walk())
        place = {id(n): k for k, n in enumerate(order)}
        for n in order:
            above, at = [], n.parent
            while at is not root:
                above.append(at)
                at = at.parent
            if n.tag in ("a", "h2"):
                outer = [x for x in above if x.tag in ("div", "nav")]
                want |= {(page, place[id(n)], place[id(x)]) for x in outer}
                nearest |= {(page, place[id(n)], place[id(outer[0])])} if outer else set()
            if n.tag == "a" and not any(x.tag == "nav" for x in above):
                outside.add((page, place[id(n)]))
            if n.tag == "a" and above:
                key = (page, place[id(above[0])])
                direct[key] = direct.get(key, 0) + 1
    assert (pairs, near, free, held) == (want, nearest, outside, direct)
    assert nodes.filter("page in (90, 91)").count() == 0 and len(pairs) > 3000
    row = nodes.filter("tag = 'h2'").first()
    assert row["classes"] == ["k", "l"] and nodes.agg(F.max("depth")).first()[0] == 3001

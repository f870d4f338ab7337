"""Running figures over groups of any size: a two-level prefix scan.

Rows are range-partitioned and sorted by (keys, order), and each gets its place, which is written down: partition in the
high bits, position in the low ones. A block is `BLOCK` consecutive places. Windows run within (keys, block); what a
block sums up to is one row, and a window over these rows alone (a group of n rows has n / BLOCK of them) gives each
block what came before it. So no task holds more than a block of a group, however large that group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.session import cut

#: Rows of a block, as a power of two.
BLOCK_BITS = 16

#: Operation -> (aggregate of rows, aggregate of blocks' totals, combination of two totals). Each is associative.
OPERATIONS = {
    "count": (F.count, F.sum, lambda a, b: a + b),
    "sum": (F.sum, F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
}


def placed(df: DataFrame, order: list, name: str = "_place") -> DataFrame:
    """df as a table with the places of its rows in the order: a long, increasing, with gaps between partitions."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def prefix_scan(
    df: DataFrame, keys: list[str], order: list, figures: dict[str, tuple[str, Column | str]], inclusive: bool = True,
    totals: bool = False, block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """df with a running figure per name of `figures` (operation, column) within the keys, in the order.

    inclusive: with the row itself; without it a count begins at 0, and other figures are null before the first value.
    totals: also `<name>_all`, the figure of the whole group. Rows that tie in the order come in any order. Null keys are
    a group. No rows give no rows.
    """
    rows = placed(df, [*keys, *order]).withColumn("_block", F.shiftright("_place", block_bits))
    block = Window.partitionBy(*keys, "_block")
    upto = block.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumns({name: OPERATIONS[op][0](F.col(c) if isinstance(c, str) else c).over(upto) for name, (op, c) in figures.items()})
    rows = rows.withColumn("_at", F.min("_place").over(block))
    # what the blocks hold comes from the table again, by partial aggregates, and not from the windows
    sums = [OPERATIONS[op][0](F.col(c) if isinstance(c, str) else c).alias(f"_sum_{name}") for name, (op, c) in figures.items()]
    blocks = placed_blocks(rows, keys, sums)
    group = Window.partitionBy(*keys)
    before = group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_carry_{name}": OPERATIONS[op][1](f"_sum_{name}").over(before) for name, (op, _) in figures.items()}
    carried |= {f"_all_{name}": OPERATIONS[op][1](f"_sum_{name}").over(group) for name, (op, _) in figures.items() if totals}
    blocks = blocks.withColumns(carried).select("_at", *carried)
    out = rows.join(blocks, "_at")
    for name, (op, _) in figures.items():
        carry = F.coalesce(f"_carry_{name}", F.lit(0)) if op == "count" else F.col(f"_carry_{name}")
        out = out.withColumn(name, OPERATIONS[op][2](carry, F.col(name)))
        if totals:
            out = out.withColumn(f"{name}_all", F.col(f"_all_{name}"))
    return out.drop("_at", "_place", "_block", *carried)


def placed_blocks(rows: DataFrame, keys: list[str], sums: list[Column]) -> DataFrame:
    """One row per (keys, _block): _at, its first place, and the sums."""
    return rows.groupBy(*keys, "_block").agg(F.min("_place").alias("_at"), *sums)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "_index") -> DataFrame:
    """df with the row's number (from 0) within its keys, and `<name>_all`, the number of rows of these keys."""
    return prefix_scan(df, keys, order, {name: ("count", F.lit(1))}, inclusive=False, totals=True)

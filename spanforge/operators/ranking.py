"""Numbers within a group without gathering the group in one task.

A group is cut into blocks whose order agrees with the wanted order. Rows are numbered inside their blocks, and
the running sum of the block sizes, a table with a row per block, makes that a number in the whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that name a block: 4096 blocks a group.
DIGITS = 3


def digest(*parts: Column | str | int) -> Column:
    """MD5 of parts, separated by a bar: an order that SQL engines share."""
    return F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, int) else p for p in parts)).cast("binary"))


def draw(digest_: Column, n: Column) -> Column:
    """A number from 0 to n - 1 by the first 32 bits of a digest."""
    return F.pmod(F.conv(F.substring(digest_, 1, 8), 16, 10).cast("bigint"), n.cast("bigint"))


def numbered(rows: DataFrame, group: list[str], blocks: list[Column], order: list[Column], out: str) -> DataFrame:
    """rows with their number, from 1, in their group by `blocks` and then `order`. The order of the blocks must agree with
    the order of the rows; a block should hold a bounded share of a group."""
    names = [f"__block{i}" for i in range(len(blocks))]
    keys = [*group, *names]
    # sort directions stay with the expressions: blocks are named without them
    marked = rows.withColumns({n: b for n, b in zip(names, blocks)})
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    base = marked.groupBy(*keys).agg(F.count("*").alias("__size")).withColumn("__base", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    left = marked.withColumn("__inside", inside)
    right = base.select(*(F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)), "__base")
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"__r{i}"]) for i, k in enumerate(keys)))
    return left.join(right, same).select(*rows.columns, (F.col("__base") + F.col("__inside")).cast("bigint").alias(out))


def by_digest(rows: DataFrame, group: list[str], key: Column, ties: list[Column], out: str) -> DataFrame:
    """numbered() in the order of a digest."""
    return numbered(rows, group, [F.substring(key, 1, DIGITS)], [key, *ties], out)

"""Scans along files of any length, as joins and windows over blocks of lines: no step needs a file in one task.

Rows have file_id and a line number; blocks are of BLOCK lines, and what one block leaves to the next goes through a window over a file's blocks, one row each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a block. A window over a file's blocks has one row for each.
BLOCK = 1024
#: Children of a node in the tree of least values.
FAN = 256


def block_of(line: str = "line_no") -> Column:
    return F.floor(F.col(line) / BLOCK)


def longest(lines: DataFrame, line: str = "line_no") -> int:
    return lines.agg(F.max(line)).first()[0] or 0


def shuffled(df: DataFrame) -> DataFrame:
    """df as the right side of a join that goes by a shuffle. For tables that grow with the input: as files they are many times smaller than as rows, so that Spark takes them for small and sends all their rows through the driver."""
    return df.hint("merge")


def first_at_most(values: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """asked (file_id, start, bound and others) with found: the first `at` from start on whose value is at most bound, in its file's values (file_id, at, value); null: none.

    A tree over the positions has the least value of each node. A question goes up from its own node to the first later one that holds a small enough
    value, then down to it: an equi-join a level, so n questions over n lines take n log n steps however they nest. most: the greatest `at`.
    """
    levels = 1 + int(math.log(max(most, 1), FAN))
    cells = lambda place, value: F.array_sort(F.collect_list(F.struct(place.alias("place"), value.alias("value")))).alias("cells")
    node = lambda c: F.floor(F.col(c) / FAN)
    tree = [values.groupBy("file_id", node("at").alias("node")).agg(cells(F.col("at") % FAN, F.col("value")), F.min("value").alias("least"))]
    for _ in range(1, levels):
        tree.append(tree[-1].select("file_id", node("node").alias("up"), (F.col("node") % FAN).alias("place"), "least").groupBy("file_id", F.col("up").alias("node")).agg(cells(F.col("place"), F.col("least")), F.min("least").alias("least")))
    fits = lambda from_: F.get(F.filter("cells", lambda c: (c["place"] >= from_) & (c["value"] <= F.col("bound"))), F.lit(0))["place"]
    # Rows that a level doesn't concern get keys that no node has, each its own, so that they don't meet in one task.
    nobody = -1 - F.pmod(F.xxhash64("file_id", "start", "bound"), F.lit(1 << 20))
    now = asked.withColumn("level", F.lit(None).cast("int")).withColumn("pos", F.col("start").cast("long"))
    for k in range(levels):
        open_ = F.col("level").isNull()
        now = now.withColumn("node", F.when(open_, node("pos")).otherwise(nobody)).join(shuffled(tree[k].select("file_id", "node", "cells")), ["file_id", "node"], "left").withColumn("hit", fits(F.col("pos") % FAN))
        now = now.withColumn("pos", F.when(~open_, F.col("pos")).when(F.col("hit").isNotNull(), F.col("node") * FAN + F.col("hit")).otherwise(F.col("node") + 1)).withColumn("level", F.when(open_ & F.col("hit").isNotNull(), k).otherwise(F.col("level"))).drop("node", "cells", "hit")
    for k in range(levels - 1, 0, -1):
        below = F.col("level") >= k
        now = now.withColumn("node", F.when(below, F.col("pos")).otherwise(nobody)).join(shuffled(tree[k - 1].select("file_id", "node", "cells")), ["file_id", "node"], "left")
        now = now.withColumn("pos", F.when(below, F.col("node") * FAN + fits(F.lit(0))).otherwise(F.col("pos"))).drop("node", "cells")
    return now.withColumn("found", F.when(F.col("level").isNotNull(), F.col("pos"))).drop("level", "pos")


def _in_block(order: str) -> tuple:
    return Window.partitionBy("file_id", "block").orderBy(order), Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def balanced(lines: DataFrame, step: str, order: str = "line_no") -> DataFrame:
    """lines with total (the running sum of a column) and at_zero: whether the running sum that is set back to 0 whenever it falls below is 0 after the line."""
    inside, blocks = _in_block(order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = lines.withColumn("block", block_of(order)).withColumn("own", F.sum(step).over(inside))
    own = own.withColumn("lowest", F.min("own").over(before))
    sums = own.groupBy("file_id", "block").agg(F.sum(step).alias("sum"), F.min("own").alias("low"))
    sums = sums.withColumn("offset", F.coalesce(F.sum("sum").over(blocks), F.lit(0)))
    sums = sums.withColumn("low_before", F.least(F.lit(0), F.coalesce(F.min(F.col("offset") + F.col("low")).over(blocks), F.lit(0)))).select("file_id", "block", "offset", "low_before")
    total = F.col("offset") + F.col("own")
    out = own.join(shuffled(sums), ["file_id", "block"])
    return out.withColumn("total", total).withColumn("at_zero", total <= F.least("low_before", F.col("offset") + F.col("lowest"))).drop("block", "own", "lowest", "offset", "low_before")


def running_max(rows: DataFrame, value: str, keys: list[str], line: str, *order: str) -> DataFrame:
    """rows with `value` replaced by the greatest among rows of the same keys (file_id first) at or before the row by line and order; nulls don't count. With values put between the rows that ask, this is an as-of look-up as a merge, however often a key is set and asked."""
    by = [F.col(k) for k in keys]
    inside = Window.partitionBy(*by, "block").orderBy(line, *order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("block", block_of(line))
    left = own.groupBy(*by, "block").agg(F.max(value).alias("left")).withColumn("left", F.max("left").over(blocks))
    return own.withColumn(value, F.max(value).over(inside)).join(shuffled(left), [*keys, "block"]).withColumn(value, F.greatest(value, "left")).drop("block", "left")


def stabbed(points: DataFrame, spans: DataFrame, keys: list[str], most: int, line: str = "line_no") -> DataFrame:
    """Each point (keys, line) with each of the spans (keys, first, last) that holds it: an interval join as an equi-join.

    A span is the union of at most two aligned stretches of 1, 2, 4 .. lines each, and a point lies in one of each, so rows grow by the logarithm of a file's length. most: the greatest line.
    """
    levels = range(max(1, (most + 1).bit_length()))
    pair = lambda k, node: F.struct(F.lit(k).alias("k"), node.alias("node"))
    cover = []
    for k in levels:
        low, high = F.ceil(F.col("first") / (1 << k)), F.floor((F.col("last") + 1) / (1 << k))
        cover += [F.when((low % 2 == 1) & (low < high), pair(k, low)), F.when((high % 2 == 1) & (low < high), pair(k, high - 1))]
    parts = spans.where("first <= last").withColumn("stretch", F.explode(F.array_compact(F.array(*cover))))
    places = points.withColumn("stretch", F.explode(F.array(*(pair(k, F.floor(F.col(line) / (1 << k))) for k in levels))))
    return places.join(shuffled(parts), [*keys, "stretch"]).drop("stretch")


def around(lines: DataFrame, before: int, after: int, bits: str | None = None) -> DataFrame:
    """lines (numbered without gaps) with context: the lower-case lines around each, joined by newlines. Blocks overlap by what a frame reaches, so none needs its file.

    bits: a column of bit sets (arrays of numbers of one size), whose union over the same lines becomes context_bits.
    """
    reach = F.array_compact(F.array(block_of(), F.when(F.col("line_no") % BLOCK < after, block_of() - 1), F.when(F.col("line_no") % BLOCK >= BLOCK - before, block_of() + 1)))
    frame = Window.partitionBy("file_id", "block").orderBy("line_no").rangeBetween(-before, after)
    every = lines.withColumn("block", F.explode(reach)).withColumn("context", F.lower(F.array_join(F.collect_list("line").over(frame), "\n")))
    if bits:
        # A frame has a few lines.
        union = lambda x, y: F.zip_with(x, y, lambda a, b: F.coalesce(a, F.lit(0).cast("long")).bitwiseOR(b))
        every = every.withColumn("context_bits", F.aggregate(F.collect_list(bits).over(frame), F.array().cast("array<long>"), union))
    return every.where(F.col("block") == block_of()).drop("block")

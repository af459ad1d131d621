"""Shards along a Hilbert curve through the metadata.

Language, source, length and doc_id are quantised to BITS bits each, and rows are sorted by their
place on the Hilbert curve through that grid, so a shard holds neighbours in all four and its minima and maxima let
readers skip it. The order is cut into runs whose numbers of rows differ by one at most (law `rows`).

Numbers are quantised by quantiles over all rows, strings by quantiles over their distinct values in order. The sort
is by range over partitions, ties broken by doc_id, text and the rest, so a language or source with a third of all rows is
split like any other run. A row's global position is its place in its partition plus what lies before: one number a partition.

Null metadata is a value of its own (0). Null text has no bytes; texts may be of any length. Rows that repeat are placed one after the other, each once.
write_shards() keeps all columns, whatever their names; the others return the columns they name. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered, table

SHARDS = 40
BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid cells (rows x dimensions); Skilling's transform, for all rows at once."""
    x, dims = cells.astype(np.int64).T.copy(), cells.shape[1]
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(dims):
            inverts = (x[i] & q) != 0
            swap = np.where(inverts, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(inverts, p, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= t
    out = np.zeros_like(t)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> level & 1)
    return out


def _cell(bounds: list, value: Column) -> Column:
    """How many of the bounds are at most the value; 0 for null."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= value)), F.lit(0)) if bounds else F.lit(0)


def string_bounds(values: DataFrame, cells: int) -> list[str]:
    """The first of each cell's strings, for cells of equal numbers of distinct strings. values: one column. What reaches the driver is a string a cell."""
    name = values.columns[0]
    ranked = numbered(values.where(F.col(f"`{name}`").isNotNull()).distinct().toDF("name"), "names", "name")
    firsts = ranked.groupBy((F.col("position") * cells / F.lit(max(1, ranked.count()))).cast("int")).agg(F.min("name")).collect()
    return sorted((r[1] for r in firsts), key=lambda x: x.encode())


def quantised(df: DataFrame, bits: int, **dims: Column) -> dict[str, Column]:
    """A cell number below 2^bits for each dimension; statistics are over all rows."""
    cells, kinds = 1 << bits, df.select(*(c.alias(k) for k, c in dims.items()))
    out, strings = {}, [k for k, t in kinds.dtypes if t == "string"]
    numbers = [k for k in dims if k not in strings]
    cuts = df.agg(*(F.percentile_approx(dims[k].cast("double"), [i / (cells - 1) for i in range(1, cells - 1)], 1000).alias(k) for k in numbers)).first() if numbers else {}
    for k in numbers:
        out[k] = F.when(dims[k].isNull(), 0).otherwise(1 + _cell(sorted(set(cuts[k] or [])), dims[k]))
    for k in strings:
        out[k] = F.when(dims[k].isNull(), 0).otherwise(_cell(string_bounds(kinds.select(k), cells - 1), dims[k]))
    return out


def along_curve(df: DataFrame, bits: int, dims: dict[str, Column], ties: list[str]) -> DataFrame:
    """df with curve (the index) and position (0 .. n-1 along the curve), written once."""
    cells = quantised(df, bits, **dims)

    @F.pandas_udf("long")
    def place(cols: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cols.to_numpy(), bits))

    keyed = df.withColumn("curve", place(F.struct(*(c.cast("int").alias(k) for k, c in cells.items()))))
    return numbered(keyed, "curve", "curve", *ties)


def cut_runs(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """placed with shard and slot: the first n % shards runs are one row longer."""
    n = placed.count()
    small, longer = divmod(n, shards)
    head, at = longer * (small + 1), F.col("position")
    shard = F.when(at < head, F.expr(f"position div {small + 1}")).otherwise(F.lit(longer) + F.expr(f"(position - {head}) div {max(1, small)}"))
    first = F.col("shard") * small + F.least(F.col("shard"), F.lit(longer))
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", at - first)


DIMENSIONS = ("lang", "source", "size", "doc_id")


def described(docs: DataFrame) -> list[Column]:
    """doc_id, size, text_crc32, lang, source."""
    text = F.col("text").cast("string")
    return [
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
    ]


def in_order(rows: DataFrame, shards: int, bits: int) -> DataFrame:
    """Rows that hold described() with curve, shard and slot."""
    # Rows that are equal in all that is named are told apart by where they were read, so that no partition gathers them.
    own = free_name(rows, "read")
    return cut_runs(along_curve(rows.withColumn(own, F.monotonically_increasing_id()), bits, {k: F.col(k) for k in DIMENSIONS}, ["doc_id", "size", "text_crc32", own]), shards).drop("position", own)


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, curve, shard, slot, of every row; the text itself is not shuffled."""
    return in_order(docs.select(*described(docs)), shards, bits)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Writes whole rows, each once, in a folder for each shard, in the curve's order, and returns the manifest: shard, rows and the least and greatest lang, source, size and doc_id. The folders' column is shard, with underscores before it where docs have one of that name."""
    name = free_name(docs, "shard")
    placed = in_order(docs.select(*described(docs), F.struct(*docs.columns).alias("row")), shards, bits)
    placed.sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))))


def op8_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_hilbert_shards": op8_hilbert_shards}
ORACLE: dict[str, str] = {}

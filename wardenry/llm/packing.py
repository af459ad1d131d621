"""Best-fit packing by sums of squares.

A document's token ids and its end id are cut, where they are longer than a sequence, into full
pieces; only the first may be shorter. Each piece goes where the sum over gaps of squared counts
of open bins becomes smallest, so no gap piles up and later pieces find a partner.

Pieces are dealt at random (by a hash of document and piece) into groups of a bounded number of
rows, and each group is packed by itself: a group leaves a few bins part-filled among tens of
thousands, and no task, key or source grows with the corpus. Only lengths are shuffled, no text.

Null text counts as empty: its one piece is the end id. Rows that repeat are packed as often as
they come. Columns beyond doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, public_vocabulary, spread, table, token_bytes, written

SEQUENCE = 1024
END_ID = 2
#: Pieces in a group, about.
GROUP_ROWS = 100_000


def token_pieces(docs: DataFrame, vocabulary: str, length: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: doc_id, copy, piece, start, length, ids_crc32, and ids (bytes) if asked."""
    schema = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def pieces(batches):
        tokens, end = token_bytes(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in in_slices(batches):
            rows = []
            for doc, copy, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), tokens.of_all(batch.column(2)), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % length or length
                for k, start in enumerate([0, *range(first, n, length)]):
                    own = ids[4 * start : 4 * (first if not k else start + length)]
                    rows.append((doc, copy, k, start, len(own) // 4, zlib.crc32(own), *[own] * with_ids))
            columns = list(zip(*rows, strict=True)) or [()] * (6 + with_ids)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: 6 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"), F.col("text").cast("string")).mapInArrow(pieces, schema)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item, longest first. open_bins[g]: numbers of the bins with a gap of g."""
    counts, open_bins = np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        fits = counts[s:size] > 0  # gaps s .. size-1
        left = counts[: size - s].copy()
        left[:1] = 0  # a full bin leaves the sum
        # By how much the sum grows, less 1: a bin goes from gap g to gap g - s, where it counts unless it is full.
        grows = np.where(fits, 2 * (left - counts[s:size]) + (np.arange(size - s) > 0), np.iinfo(np.int64).max)
        best = int(grows.argmin()) if size > s and fits.any() else -1
        if best < 0 or s < size and 2 * counts[size - s] < grows[best]:
            gap, number, made = size, made, made + 1
        else:
            gap = best + s
            number = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = number, size - gap
        if gap > s:
            open_bins[gap - s].append(number)
            counts[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, length: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. pieces: a written table, for it is counted first."""
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)))

    def place(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "copy", "piece"], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=(int(key[0]) << 40) + bins, offset=offsets).drop(columns="part")

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("part").applyInPandas(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Where each piece of each document goes: doc_id, copy, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, vocabulary or public_vocabulary("byte_bpe_50k.json"), length, end_id)
    return pack(written(pieces, "pieces"), length, group_rows)


def packed_sequences(docs: DataFrame, vocabulary: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, input_ids (array), doc_ids and offsets in order. A sequence is short, so its rows may meet."""
    pieces = written(token_pieces(docs, vocabulary or public_vocabulary("byte_bpe_50k.json"), length, end_id, with_ids=True), "pieces")

    def joined(batches):
        for batch in in_slices(batches):
            parts = batch.column("parts").to_pylist()
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype("i4") for x in parts]
            yield pa.record_batch(
                [batch.column("sequence_id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([[p["doc_id"] for p in x] for x in parts], pa.list_(pa.int64())), pa.array([[p["offset"] for p in x] for x in parts], pa.list_(pa.int64()))],
                names=["sequence_id", "n_tokens", "input_ids", "doc_ids", "offsets"],
            )

    spots = pack(pieces.drop("ids"), length, group_rows).select("doc_id", "copy", "piece", "sequence_id", "offset")
    whole = spots.alias("a").join(pieces.select("doc_id", "copy", "piece", "ids").alias("b"), F.expr("a.copy = b.copy AND a.piece = b.piece"))
    rows = whole.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct(F.col("a.offset").alias("offset"), F.col("a.doc_id").alias("doc_id"), F.col("b.ids").alias("ids")))).alias("parts"))
    return rows.mapInArrow(joined, "sequence_id long, n_tokens long, input_ids array<int>, doc_ids array<long>, offsets array<long>")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("copy")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLE: dict[str, str] = {}

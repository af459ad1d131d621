"""Ranked lexical search by hashed max-sketches: bounds first, exact scores in falling order of bounds until the threshold.

Score of a document for an item: over the item's distinct terms, weight * ((1e9 * tf) div (1000 * tf + 8 * m)), where m grows with the document's length. With m fixed
this impact only grows with tf, so a sketch that folds the tf of all terms hashed to a coordinate into their maximum gives, at the coordinates
of an item's terms, an upper bound of its score. A sketch has a power of two of coordinates, at least SPACE for each distinct term
(LEAST_SIZE to MOST_SIZE), a byte each; 255 stands for any larger tf, whose impact is taken as 1e6, which none reaches.

The index is one table, made in one pass over the texts: number, doc_id, n (terms with repeats), sketch, terms and tfs. Search reads it once for each block of items (BLOCK_TERMS
terms at most, or one item): a task looks a batch of sketches up for all items at once, then takes each item's documents by falling bound, scores them
exactly by their terms, and stops where the bound is under the tenth score so far: of the tie-breaking order too, so no document is lost. A task returns ten rows an item at most; tasks' rows meet in two steps.

All integers are 64-bit, in the contract's order of operations; div rounds down. Null texts, and texts without a term, are in no result and not counted in N. Items without terms, or null, have no rows. Items that repeat are answered each, with their own item_id;
documents that repeat are ranked each. Equal scores go by ascending doc_id, those without doc_id last. Either table may be empty. Texts may be of any length (a document's distinct terms are held at once). Columns of the same name in either table don't clash: only doc_id, item_id and text are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, small_batches, spread, table, written

TOP, BLOCK_TERMS = 10, 100_000
SPACE, LEAST_SIZE, MOST_SIZE, ANY = 16, 64, 1 << 20, 255
#: Documents looked up at once are so many that a matrix of bounds has about this many cells.
CELLS = 1 << 20
#: A-Z to a-z, other ASCII but digits and letters to blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "number long, doc_id long, n long, sketch binary, terms array<string>, tfs array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), np.int64, len(terms))


def size_of(distinct: int) -> int:
    return int(min(MOST_SIZE, max(LEAST_SIZE, 1 << (SPACE * distinct - 1).bit_length())))


def sketch(terms: list[bytes], tfs: np.ndarray) -> np.ndarray:
    size = size_of(len(terms))
    out, at = np.zeros(size, np.uint8), hashes(terms) & (size - 1)
    out[at] = 1
    # The few larger ones in rising order, so that the greatest of a coordinate stays.
    more = np.flatnonzero(tfs > 1)
    more = more[np.argsort(tfs[more], kind="stable")]
    out[at[more]] = np.minimum(tfs[more], ANY)
    return out


def build_index(docs: DataFrame) -> DataFrame:
    """A written table of documents (doc_id, text) that have a term."""
    def build(batches):
        for batch in in_slices(batches):
            rows = []
            for number, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if counts := Counter(terms_of(text)):
                    terms, tfs = list(counts), np.fromiter(counts.values(), np.int32, len(counts))
                    rows.append((number, doc_id, int(tfs.sum()), sketch(terms, tfs).tobytes(), [x.decode() for x in terms], tfs))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["number", "doc_id", "n", "sketch", "terms", "tfs"])

    own = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(own.where("text IS NOT NULL").mapInArrow(build, INDEX), "lexical-index")


def weights(index: DataFrame, asked: DataFrame, documents: int) -> dict[str, int]:
    """The weight of each term of asked (term) that a document holds. asked is a block's: few enough to broadcast."""
    df = index.select(F.explode("terms").alias("term")).join(F.broadcast(asked), "term").groupBy("term").agg(F.count("*").alias("df"))
    return {r.term: int(np.floor(1000 * np.log((2 * documents + 2) / (2 * r.df + 1)))) for r in df.collect()}


class Items:
    """A block of items: for each its terms that weigh something, all in one row one after the other."""

    def __init__(self, items: list[tuple[int, list[str]]], weigh: dict[str, int]):
        own = [(number, [t for t in terms if weigh.get(t, 0) > 0]) for number, terms in items]
        own = [(number, terms) for number, terms in own if terms]
        self.numbers = [number for number, _ in own]
        self.terms = sorted({t for _, terms in own for t in terms})
        at = {t: i for i, t in enumerate(self.terms)}
        self.hashes = hashes([t.encode() for t in self.terms])
        self.each = [[(t, weigh[t]) for t in terms] for _, terms in own]
        lengths = np.array([len(terms) for _, terms in own], np.int64)
        self.flat = np.array([at[t] for _, terms in own for t in terms], np.int64)
        self.weights = np.array([weigh[t] for _, terms in own for t in terms], np.int64)
        self.first = np.cumsum(lengths) - lengths

    def bounds(self, sketches: list[bytes], m: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores: a row a document (of one size of sketch), a column an item."""
        cells = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
        tf = cells[:, self.hashes & (cells.shape[1] - 1)].astype(np.int64)
        impact = np.where(tf == ANY, 1_000_000, (1_000_000_000 * tf) // np.maximum(1, 1000 * tf + 8 * m[:, None]))
        return np.add.reduceat(impact[:, self.flat] * self.weights, self.first, axis=1)


class Best:
    """Each item's ten best (score, -doc_id order) so far in a task."""

    def __init__(self, items: Items, top: int):
        self.items, self.top = items, top
        self.heaps: list[list[tuple]] = [[] for _ in items.numbers]
        self.least = np.ones(len(items.numbers), np.int64)

    def meet(self, bounds: np.ndarray, m: np.ndarray, rows: list[tuple], tfs) -> None:
        """Documents with their bounds, a row each; rows: (number, doc_id); tfs(i): what the i-th one's terms are and how often, asked for only where a bound is worth it."""
        worth = bounds >= self.least
        for k in np.flatnonzero(worth.any(axis=0)).tolist():
            column = bounds[:, k]
            some = np.flatnonzero(worth[:, k])
            for i in some[np.argsort(-column[some], kind="stable")].tolist():
                if column[i] < self.least[k]:
                    break
                get, own, score = tfs(i).get, 8 * int(m[i]), 0
                for term, weight in self.items.each[k]:
                    if tf := get(term):
                        score += weight * ((1_000_000_000 * tf) // (1000 * tf + own))
                self.offer(k, score, *rows[i])

    def offer(self, k: int, score: int, number: int, doc_id: int | None) -> None:
        if score <= 0:
            return
        heap, entry = self.heaps[k], (score, doc_id is not None, -(doc_id or 0), -number)
        if len(heap) < self.top:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.top:
            self.least[k] = heap[0][0]

    def rows(self) -> list[tuple]:
        return [(item, -number, -doc if has else None, score) for item, heap in zip(self.items.numbers, self.heaps, strict=True) for score, has, doc, number in heap]


def top_of_block(index: DataFrame, items: Items, documents: int, terms: int, top: int) -> DataFrame:
    """item, number, doc_id, score: of each task its best, at most `top` an item."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        items = shared.value
        best, step = Best(items, top), max(1, CELLS // max(1, len(items.flat)))
        for batch in in_slices(batches):
            numbers, ids, sketches = (batch.column(c).to_pylist() for c in ("number", "doc_id", "sketch"))
            m = 10 + (90 * batch.column("n").to_numpy() * documents) // terms
            asked, found = set(items.terms), {}

            def tfs(i, batch=batch, found=found, asked=asked):
                if i not in found:
                    found[i] = {t: n for t, n in zip(batch.column("terms")[i].values.to_pylist(), batch.column("tfs")[i].values.to_pylist(), strict=True) if t in asked}
                return found[i]

            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(sketches):
                by_size.setdefault(len(x), []).append(i)
            bounds = np.zeros((len(sketches), len(items.numbers)), np.int64)
            for own in by_size.values():
                for at in range(0, len(own), step):
                    part = own[at : at + step]
                    bounds[part] = items.bounds([sketches[i] for i in part], m[part])
            best.meet(bounds, m, list(zip(numbers, ids, strict=True)), tfs)
        columns = list(zip(*best.rows(), strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=["item", "number", "doc_id", "score"])

    return index.mapInArrow(search, "item long, number long, doc_id long, score long")


def ranked(rows: DataFrame, top: int, *more: str) -> DataFrame:
    """rows with rank: the best of each item (and of each of `more`)."""
    order = Window.partitionBy("item", *more).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "number")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def blocks_of(benchmark: DataFrame) -> DataFrame:
    """A written table of items: item (a number), item_id, terms (distinct), block. Items are put into blocks by the running sum of their terms within their part of the table."""
    plain = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)))
    items = written(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), terms.alias("terms")).where(F.size("terms") > 0), "lexical-items")
    part = F.shiftright("item", 33)
    # Blocks don't cross parts of the table, so a part is numbered on its own.
    before = F.sum(F.size("terms")).over(Window.partitionBy("part").orderBy("item"))
    return written(items.withColumn("part", part).withColumn("block", F.floor(before / BLOCK_TERMS)), "lexical-blocks")


def search(index: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score. benchmark: item_id and text."""
    spark = index.sparkSession
    small_batches(spark)
    documents, terms = (x or 0 for x in index.agg(F.count("*"), F.sum("n")).first())
    items = blocks_of(benchmark)
    found = None
    for block in items.select("part", "block").distinct().orderBy("part", "block").collect() if documents else []:
        own = items.where((F.col("part") == block.part) & (F.col("block") == block.block)).select("item", "terms")
        weigh = weights(index, own.select(F.explode("terms").alias("term")).distinct(), documents)
        held = Items([(r.item, list(r.terms)) for r in own.orderBy("item").collect()], weigh)
        if held.numbers:
            one = top_of_block(index, held, documents, terms, top)
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "item long, number long, doc_id long, score long")
    # Tasks' rows meet first in shares of an item's rows, then as a whole.
    shares = ranked(found.withColumn("share", F.pmod(F.xxhash64("number"), F.lit(64))), top, "share").drop("rank", "share")
    return ranked(shares, top).join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(build_index(docs), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_T = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = {
    "op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_T} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS every FROM d),
b AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_T}) AS w FROM benchmark),
q AS (SELECT item, unnest(w) AS term FROM b),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY term, docs),
m AS (SELECT r, 10 + (90 * len(w) * docs) // every AS m FROM d, s WHERE len(w) > 0),
sc AS (SELECT item, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM sc JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN b USING (item) WHERE rank <= {TOP}
"""
}
QUERIES = {"op12_lexical_search": op12_lexical_search}

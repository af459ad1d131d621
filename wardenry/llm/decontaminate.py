"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised to words (A-Z lowered; runs of digits, letters a-z and
everything beyond ASCII), numbered by a vocabulary of the benchmark's own. Any window of 13 words of an item holds a whole one of the item's blocks of 7
words (from its word 0, 7, 14 ..), so those blocks, and short items as a whole, go into one automaton: about a node for each word of the benchmark.
A document is normalised the same way and scanned once, by the automaton's C code; the windows around a block that is met are looked up, each place once, in
a sorted table of window fingerprints and compared word by word, so a text's time is linear in its words, repeated ones too. A document that has any gets the runs' places in its original text.

One task builds the automaton from the benchmark and writes it to the shared folder; each executor fetches that file, and a worker reads it once. Nothing of it
passes through the driver. Documents are neither shuffled nor scanned again.

Null texts have no words. Items without words, and null items, have no window. Texts and items may be of any length. Rows that repeat
give repeated rows; an item_id that occurs twice counts once. Runs that overlap or touch are one. Either table may be empty. Other columns of docs
stay, whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

import os
import pickle
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, scratch, small_batches, spread, table

WINDOW = 13
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: A-Z to a-z, other ASCII but digits and a-z to blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def fingerprints(own: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each window of `size` numbers."""
    n = len(own) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, own = np.full(n, seed, np.uint64), own.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ own[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Windows:
    """The benchmark's windows of `size` words: an automaton over blocks tells where one may be, a sorted table of fingerprints which one it is."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        import ahocorasick

        self.size, self.numbers = size, {}
        texts: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            if own := tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)):
                texts.setdefault(own, set()).add(item)
        self.items = [sorted(x) for x in texts.values()]
        self.block = (size + 1) // 2
        # Pattern: the number of the short text that it is, or -1 for a block.
        patterns: dict[tuple[int, ...], int] = {}
        for k, text in enumerate(texts):
            if len(text) < size:
                patterns[text] = k
            else:
                patterns.update((text[at : at + self.block], -1) for at in range(0, len(text) - self.block + 1, self.block) if text[at : at + self.block] not in patterns)
        self.any, self.machine = bool(patterns), ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern in sorted(patterns):
            self.machine.add_word(pattern, (len(pattern), patterns[pattern]))
        if patterns:
            self.machine.make_automaton()
        self.table([(k, np.array(text, np.int32)) for k, text in enumerate(texts) if len(text) >= size])

    def table(self, texts: list[tuple[int, np.ndarray]]) -> None:
        """Of each distinct window: its fingerprint (sorted), a place where it stands, and the number of the set of texts that hold it."""
        size, lengths = self.size, np.array([len(x) for _, x in texts], np.int64)
        self.words = np.concatenate([np.zeros(0, np.int32), *(x for _, x in texts)])
        first = np.concatenate([np.zeros(0, np.int64), *(np.arange(n - size + 1) + at for n, at in zip(lengths, np.cumsum(lengths) - lengths, strict=True))])
        owner = np.repeat(np.array([k for k, _ in texts], np.int64), lengths - size + 1)
        for seed in range(1, 1000):
            prints = np.concatenate([np.zeros(0, np.uint64), *(fingerprints(x, size, seed) for _, x in texts)])
            self.prints, at, which = np.unique(prints, return_index=True, return_inverse=True)
            # Windows of one fingerprint must be equal; else the next seed.
            if all((self.words[first + i] == self.words[first[at][which] + i]).all() for i in range(size)):
                break
        self.seed, self.first = seed, first[at]
        pairs = np.unique(np.stack([which.reshape(-1), owner], axis=1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
        cuts = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
        sets: dict[tuple[int, ...], int] = {}
        self.owner = np.array([sets.setdefault(tuple(x.tolist()), len(sets)) for x in np.split(pairs[:, 1], cuts[1:])] if len(pairs) else [], np.int64)
        self.sets = list(sets)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Runs (start, end) of the words that windows cover, apart and in order, and the items whose windows they are, sorted. The text is scanned once, and each place is looked up at most once."""
        if not self.any or not words:
            return [], []
        get, n, size = self.numbers.get, len(words), self.size
        own = tuple([get(w, 0) for w in words])
        ends, met, edges = [], set(), np.zeros(n + 1, np.int64)
        for last, (length, short) in self.machine.iter(own):
            if short < 0:
                ends.append(last + 1)
            else:
                edges[last + 1 - length] += 1
                edges[last + 1] -= 1
                met.add(short)
        if ends and n >= size:
            # Windows around the blocks that were met.
            near, ends = np.zeros(n + 1, np.int64), np.array(ends)
            np.add.at(near, np.maximum(ends - size, 0), 1)
            np.add.at(near, np.minimum(ends - self.block, n - size) + 1, -1)
            starts, numbers = np.flatnonzero(np.cumsum(near)[: n - size + 1] > 0), np.array(own, np.int32)
            asked = fingerprints(numbers, size, self.seed)[starts]
            place = np.minimum(np.searchsorted(self.prints, asked), len(self.prints) - 1)
            known = self.prints[place] == asked
            for i in range(size):
                known &= self.words[self.first[place] + i] == numbers[starts + i]
            starts, place = starts[known], place[known]
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + size, -1)
            met.update(k for x in np.unique(self.owner[place]).tolist() for k in self.sets[x])
        covered = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0)
        runs = list(zip(np.flatnonzero(covered > 0).tolist(), np.flatnonzero(covered < 0).tolist(), strict=True))
        return runs, sorted(set().union(*(self.items[k] for k in met)))


def windows_file(benchmark: DataFrame, size: int = WINDOW) -> str:
    """Builds the automaton in one task, as a table of one row, and has every executor fetch it. Returns the name that read_windows() takes."""
    def build(batches):
        items = [(item, text) for batch in batches for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.record_batch([pa.array([pickle.dumps(Windows(items, size))], pa.large_binary())], names=["windows"])

    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    path = scratch(spark, "windows")
    rows.repartition(1).mapInArrow(build, "windows binary").write.parquet(path)
    # One partition is one file; a benchmark without rows may leave none.
    for file in spark.read.parquet(path).inputFiles():
        spark.sparkContext.addFile(file)
        return os.path.basename(file)
    return ""


@lru_cache(maxsize=1)
def read_windows(name: str) -> Windows:
    import pyarrow.parquet as pq
    from pyspark import SparkFiles

    rows = pq.read_table(SparkFiles.get(name)).column("windows").to_pylist() if name else []
    return pickle.loads(rows[0]) if rows else Windows([])


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, runs (array of start, end: hit words, by number), items (sorted), and spans (the runs' code points in the text)."""
    made = ("n_words", "runs", "items", "spans")
    docs = docs.drop(*made)
    own = [f.name for f in docs.schema]
    at, pair = own.index("text"), "array<struct<start:int,end:int>>"
    schema = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("runs", F.lit(None).cast(pair)).withColumn("items", F.lit(None).cast("array<string>")).withColumn("spans", F.lit(None).cast(pair)).schema
    small_batches(docs.sparkSession)
    name, kind = windows_file(benchmark, window), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches):
        windows = read_windows(name)
        for batch in in_slices(batches):
            rows = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                runs, items = windows.find(words)
                places = [m.span() for m in WORD.finditer(text.translate(_LOWER))] if runs else []
                pairs = [[{"start": a, "end": b} for a, b in x] for x in (runs, [(places[a][0], places[b - 1][1]) for a, b in runs])]
                rows.append((len(words), pairs[0], items, pairs[1]))
            n_words, runs, items, spans = zip(*rows, strict=True)
            yield pa.record_batch([*batch.columns, pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)], names=[*own, *made])

    return docs.mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """contaminated_words() and per row n_hit, n_items, items_sha256, contaminated (at least one word in `one_in` is hit)."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return contaminated_words(docs, benchmark, window).withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256)}).withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark).where(~F.col("contaminated")).select(*docs.columns)


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", joined("spans").alias("spans"))


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE = {
    "op4_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), {_ABC}) AS t, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hp AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM m),
h AS (SELECT r, count(*) AS n_hit FROM hp GROUP BY r),
hr AS (SELECT r, min(p) AS a, max(p) AS b FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS run FROM hp) GROUP BY r, run),
hw AS (SELECT r, w, string_split_regex(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS g FROM d WHERE r IN (SELECT r FROM h)),
sp AS (SELECT hr.r, string_agg(list_sum(list_transform(g[1:a], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: length(x))), 0)::BIGINT || ':' ||
       (list_sum(list_transform(g[1:b], lambda x: length(x)))::BIGINT + list_sum(list_transform(w[1:b], lambda x: length(x)))::BIGINT), ',' ORDER BY a) AS spans FROM hr JOIN hw USING (r) GROUP BY hr.r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(sp.spans, '') AS spans
FROM d LEFT JOIN sp ON d.r = sp.r LEFT JOIN h ON d.r = h.r LEFT JOIN it ON d.r = it.r
"""
}
QUERIES = {"op4_decontaminate": op4_decontaminate}

"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that a Python task works on at once. Spark itself bounds what it sends by bytes.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where its files give fewer; that takes a shuffle of a table too small to fill the cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs on this machine."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that Python workers are sent at once, for the session: results are lazy, so the setting must still hold when the caller writes them. A smaller setting of the caller's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    small_batches(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_slices(batches, rows: int = BATCH_ROWS, size: int = BATCH_BYTES):
    """The batches in slices of bounded rows and bytes (one row at least); what is free at the end of the task goes back to the system."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Workers outlive their tasks; memory that a task freed should not count against the next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    own = {c.lower() for c in df.columns}
    while name.lower() in own:
        name = "_" + name
    return name


#: Keys with more than one row in HOT, and more than HOT_ROWS, are hot.
HOT, HOT_ROWS = 10_000, 1000


def hot_keys(counts: DataFrame, keys: list[str]) -> DataFrame | None:
    """Of counts (the keys, n), the keys with over HOT_ROWS rows that hold more than one row in HOT: fewer than HOT. None without any."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("n") * HOT > total) & (F.col("n") > HOT_ROWS)).select(*keys).collect()
    return counts.sparkSession.createDataFrame(rows, counts.select(*keys).schema) if rows else None


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how). Rows of hot keys meet those of right, a few a key, by broadcast, and the others by a shuffle."""
    if hot is None:
        return left.join(right, keys, how)
    some = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how).unionByName(some)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with position: 0 .. n-1 along the order, sorted over range partitions and written once. The order should tell rows apart, or a partition holds all that are equal."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own, part_name, before_name = (free_name(df, x) for x in ("id", "part", "before"))
    run = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id()), name)
    part = F.shiftright(own, 33)
    # One row a partition of the sort.
    parts = run.groupBy(part.alias(part_name)).agg(F.count("*").alias(own))
    before = parts.select(part_name, (F.sum(own).over(Window.orderBy(part_name)) - F.col(own)).alias(before_name))
    return run.withColumn(part_name, part).join(F.broadcast(before), part_name).withColumn("position", F.col(before_name) + F.col(own).bitwiseAND((1 << 33) - 1)).drop(own, part_name, before_name)


def as_type(df: DataFrame, **kinds: str) -> DataFrame:
    """df with exactly these columns, cast to these types."""
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))


#: Blanks in a row, which the quick cut can't tell apart.
_ODD = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]{2}"
#: Characters that are encoded at a time.
_SLICE = 8 << 20
#: Whether a byte is a letter or digit of ASCII.
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
#: A chunk without blanks inside, which may stand among others with newlines between them.
_PLAIN = re.compile(" ?\\S+")


def cut(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The chunks of all texts, none null, and where each text's chunks begin and end among them. Cuts stand before a space, around a newline, and before a full stop or comma after a letter or digit."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
    first, size = int(ends[0]), int(ends[-1] - ends[0])
    if not size:
        return pa.array([], pa.large_string()), np.zeros(n + 1, np.int64)
    data, ends = texts.buffers()[2].slice(first, size), ends - first
    b = np.frombuffer(data, np.uint8)
    begins = np.zeros(size + 1, bool)
    newline = b == 10
    begins[:-1] = newline | (b == 32)
    begins[1:] |= newline
    marks = np.flatnonzero((b == 44) | (b == 46))
    last, lead = b[np.maximum(marks - 1, 0)], b[np.maximum(marks - 2, 0)]
    begins[marks[_ALNUM[last] | (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]] = True
    begins[ends] = True
    begins[-1] = False
    at = np.flatnonzero(begins)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, size)), data), np.searchsorted(at, ends)


class Known:
    """Chunks and their ids in flat arrays, found by hash and then compared: some 60 bytes a chunk, where a dict takes over 150."""

    def __init__(self, words: pa.LargeStringArray, hashes: np.ndarray, lengths: np.ndarray, flat: np.ndarray, met: np.ndarray):
        self.words, self.lengths, self.flat, self.met = words, lengths.astype(np.int32), flat, met
        self.starts = np.cumsum(lengths) - lengths
        self.order = np.argsort(hashes).astype(np.int32)
        self.sorted = hashes[self.order]

    @classmethod
    def none(cls, dtype: str) -> Known:
        return cls(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, dtype), np.zeros(0, np.int32))

    def hashes(self) -> np.ndarray:
        out = np.empty_like(self.sorted)
        out[self.order] = self.sorted
        return out

    def costs(self) -> np.ndarray:
        """Bytes of each chunk."""
        return 36 + pc.binary_length(self.words).to_numpy() + self.flat.itemsize * self.lengths

    def find(self, words: pa.LargeStringArray, hashes: np.ndarray) -> np.ndarray:
        """Where each chunk stands; -1 for one that is not there."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            met = np.flatnonzero(self.sorted[at] == hashes)
            place = self.order[at[met]]
            same = pc.equal(self.words.take(pa.array(place)), words.take(pa.array(met))).to_numpy(zero_copy_only=False)
            out[met[same]] = place[same]
        return out

    def plus(self, other: Known) -> Known:
        join = lambda *x: np.concatenate(x)
        return Known(pa.concat_arrays([self.words, other.words]), join(self.hashes(), other.hashes()), join(self.lengths, other.lengths), join(self.flat, other.flat), join(self.met, other.met))

    def only(self, kept: np.ndarray) -> Known:
        return self if kept.all() else Known(self.words.filter(pa.array(kept)), self.hashes()[kept], self.lengths[kept], self.flat[np.repeat(kept, self.lengths)], self.met[kept])

    def within(self, size: int) -> Known:
        """If the chunks take more than so many bytes, those met last that take three quarters of it."""
        costs = self.costs()
        if costs.sum() <= size:
            return self
        latest = np.argsort(-self.met, kind="stable")
        kept = np.zeros(len(latest), bool)
        kept[latest[np.cumsum(costs[latest]) <= size * 3 // 4]] = True
        return self.only(kept)


class TokenBytes:
    """Texts -> their token ids as little-endian bytes, from the tokenizers library; a chunk of text that is still known is not encoded again.

    A byte-level tokenizer splits a text before it merges: a single space goes with the word after it, a
    single newline stands alone, and a word ends before a mark. Cutting at such places only leaves the ids as they are
    (tested against whole texts). Texts are encoded many at a time, so the library is asked once for all that is new.
    """

    #: Bytes of the chunks that are kept, and characters of the longest one.
    LIMIT, LONGEST = 24 << 20, 64

    def __init__(self, path: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        self.dtype = dtype
        self.old, self.fresh, self.turn = Known.none(dtype), Known.none(dtype), 0
        (self.newline,) = self.encoder.encode("\n", add_special_tokens=False).ids
        self.slow = re.compile("(?<=[!-~À-ɏ])(?= [!-~À-ɏ])")

    def encode(self, chunks: list[str], together: int = 500) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The chunks in another order, as their numbers; how many ids each has; all ids. Those without blanks inside are encoded in runs, one newline after each: those ids tell them apart."""
        plain, alone, order, lengths, flat = [], [], [], [], []
        for i, w in enumerate(chunks):
            (plain if _PLAIN.fullmatch(w) else alone).append(i)
        for block in range(0, len(plain), 40 * together):
            runs = [plain[i : i + together] for i in range(block, min(block + 40 * together, len(plain)), together)]
            for run, found in zip(runs, self.encoder.encode_batch_fast(["\n".join([chunks[i] for i in r]) + "\n" for r in runs], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, self.dtype)
                stops = np.flatnonzero(ids == self.newline)
                if len(stops) == len(run):
                    order += run
                    lengths.append(np.diff(stops, prepend=-1) - 1)
                    flat.append(ids[ids != self.newline])
                else:
                    alone += run
        for found in self.encoder.encode_batch_fast([chunks[i] for i in alone], add_special_tokens=False):
            flat.append(np.array(found.ids, self.dtype))
            lengths.append([len(found.ids)])
        return order + alone, np.concatenate([np.zeros(0, np.int64), *lengths]), np.concatenate([np.zeros(0, self.dtype), *flat])

    def remember(self, new: Known) -> None:
        """New chunks gather in a small table, so that the large one is seldom sorted."""
        self.fresh = self.fresh.plus(new.only(pc.utf8_length(new.words).to_numpy() <= self.LONGEST))
        if (size := int(self.fresh.costs().sum())) > self.LIMIT // 8:
            self.old = self.old.within(self.LIMIT - size)
            self.old, self.fresh = self.old.plus(self.fresh.within(self.LIMIT)), Known.none(self.dtype)

    def ids_of(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct chunks: where the ids of each begin in an array, how many there are, and the array."""
        names = words.to_numpy(zero_copy_only=False)
        hashes = np.fromiter(map(hash, names), np.int64, len(names))
        starts, lengths, left, flats, before = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.arange(len(names)), [], 0
        self.turn += 1
        for known in (self.old, self.fresh):
            place = known.find(words.take(pa.array(left)), hashes[left])
            there = place >= 0
            own, place, left = left[there], place[there], left[~there]
            starts[own], lengths[own], known.met[place] = known.starts[place] + before, known.lengths[place], self.turn
            flats.append(known.flat)
            before += len(known.flat)
        if len(left):
            order, counts, found = self.encode(names[left].tolist())
            left = left[order]
            starts[left], lengths[left] = np.cumsum(counts) - counts + before, counts
            flats.append(found)
            self.remember(Known(words.take(pa.array(left)), hashes[left], counts, found, np.full(len(left), self.turn, np.int32)))
        return starts, lengths, np.concatenate(flats)

    def of_lists(self, chunks: pa.LargeStringArray, ends: np.ndarray) -> list[bytes]:
        """The ids of each list of chunks; each distinct chunk is looked up once, and numpy strings the ids together."""
        coded = chunks.dictionary_encode()
        starts, lengths, flat = self.ids_of(coded.dictionary)
        at = coded.indices.to_numpy()
        spans = lengths[at]
        before = np.concatenate([[0], np.cumsum(spans)])
        ids = flat[np.repeat(starts[at] - before[:-1], spans) + np.arange(before[-1])].tobytes()
        stops = (before[ends] * flat.itemsize).tolist()
        return [ids[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def of_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        quick = texts.filter(pc.invert(odd))
        out: list[bytes] = []
        sizes = np.cumsum(pc.binary_length(quick).to_numpy(zero_copy_only=False)) // _SLICE
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(quick)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                out += self.of_lists(*cut(quick[a:b]))
        if len(out) == len(texts):
            return out
        lists = [self.slow.split(x) for x in texts.filter(odd).to_pylist()]
        slow, rest = iter(self.of_lists(pa.array([c for x in lists for c in x], pa.large_string()), np.cumsum([0, *map(len, lists)]))), iter(out)
        return [next(slow if x else rest) for x in odd.to_pylist()]


@lru_cache(maxsize=4)
def token_bytes(path: str, dtype: str = "<u4") -> TokenBytes:
    """One per Python worker."""
    return TokenBytes(path, dtype)


def public_vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; pass another path to an operator to use your own."""
    import public_tokenizers

    return public_tokenizers.path(name)

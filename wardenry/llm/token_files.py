"""Token ids in binary shards with a minimal perfect hash index.

Documents are sorted by doc_id over range partitions; each task encodes its run and closes a
shard whenever it has gathered SHARD_BYTES of ids, so a task holds one shard and one document. A shard is one
record of a Parquet table in the shared folder (Spark commits it, so a lost executor leaves no
half file): the raw ids of its documents end to end, and an index that maps a key to its place
without the keys (they are stored beside it, so that all documents can be listed). Level by level, keys hash into a bit array; those alone at their bit stay,
the others go to the next level, and a key's slot is the rank of its bit. The slot holds a
fingerprint (a key that was never written is refused but for one in 2^32), the offset and the
number of ids. A lookup touches a few bits and one slot, whatever the shard's size; look_up() sends each key to the shards whose range holds it.

Null text counts as empty (the end id alone); texts may be of any length. A null doc_id is a key of its own and sorts first.
Rows that repeat a doc_id are all written, by hash and length of the text and then as they were read, so a doc_id of very many rows is dealt over tasks; look_up() returns them all.
Columns beyond doc_id and text are ignored, whatever their names. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_slices, public_vocabulary, scratch, table, token_bytes

END_ID = 0
SHARD_BYTES = 8 << 20
LEVELS, SPREAD = 24, 2
#: One record a shard.
SHARD = "part int, number int, base long, n_docs long, n_ids long, n_null long, first_key long, last_key long, payload binary, keys binary, bits binary, sizes binary, rest binary, fingerprints binary, places binary, lengths binary"


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each key, another function for each salt."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        return x ^ (x >> np.uint64(31))


def hashed_keys(keys: np.ndarray, copies: np.ndarray, nulls: int = 0) -> np.ndarray:
    """A hash of each key and its copy's number; the first `nulls` keys are null."""
    with np.errstate(over="ignore"):
        out = _mix(keys.astype(np.int64).view(np.uint64), 101)
        out[:nulls] = np.uint64(0x5851F42D4C957F2D)
        return out + _mix(copies.astype(np.uint64), 102)


class PerfectHash:
    """Key hashes -> 0 .. n-1, each once."""

    def __init__(self, bits: bytes, sizes: bytes, rest: bytes):
        self.sizes = np.frombuffer(sizes, "<u4").astype(np.uint64)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[: int(self.sizes.sum())]
        self.ranks = np.concatenate([[0], np.cumsum(self.bits)]).astype(np.int64)
        self.rest = np.frombuffer(rest, "<u8")

    @staticmethod
    def build(keys: np.ndarray) -> tuple[bytes, bytes, bytes]:
        levels, sizes, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            n = max(8, SPREAD * len(left))
            at = _mix(left, level) % np.uint64(n)
            alone = np.bincount(at.astype(np.int64), minlength=n) == 1
            levels.append(alone)
            sizes.append(n)
            left = left[~alone[at.astype(np.int64)]]
        bits = np.packbits(np.concatenate(levels), bitorder="little") if levels else np.zeros(0, np.uint8)
        return bits.tobytes(), np.array(sizes, "<u4").tobytes(), np.sort(left).astype("<u8").tobytes()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that fell on no bit and is not among the few kept as they are."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, n in enumerate(self.sizes):
            at = (_mix(keys[open_], level) % n).astype(np.int64) + base
            hit = self.bits[at] == 1
            out[open_[hit]] = self.ranks[at[hit]]
            open_, base = open_[~hit], base + int(n)
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.ranks[-1] + at[same]
        return out


def copy_numbers(keys: np.ndarray, nulls: int = 0) -> np.ndarray:
    """How often the same key came before, in a sorted run whose first `nulls` keys are null."""
    if not len(keys):
        return np.zeros(0, np.int64)
    at, first = np.arange(len(keys)), np.r_[True, keys[1:] != keys[:-1]]
    first[1:nulls] = False
    first[nulls : nulls + 1] = True
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _shard(part: int, number: int, base: int, keys: list, ids: list[bytes], width: int) -> tuple:
    nulls = sum(k is None for k in keys)
    own = np.array([0 if k is None else k for k in keys], np.int64)
    lengths = np.array([len(x) // width for x in ids], np.int64)
    hashes = hashed_keys(own, copy_numbers(own, nulls), nulls)
    index = PerfectHash.build(hashes)
    slots = PerfectHash(*index).slots(hashes)
    fingerprints, places, counts = (np.empty(len(own), t) for t in ("<u4", "<u8", "<u4"))
    fingerprints[slots] = _mix(hashes, 103) >> np.uint64(32)
    places[slots] = np.cumsum(lengths) - lengths
    counts[slots] = lengths
    return (part, number, base, len(own), int(lengths.sum()), nulls, keys[nulls] if nulls < len(keys) else None, keys[-1], b"".join(ids), own.astype("<i8").tobytes(), *index, fingerprints.tobytes(), places.tobytes(), counts.tobytes())


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, dtype: str = "<u2") -> None:
    """Writes the shards. dtype: <u2 where every id is below 65,536, else <u4."""
    vocabulary, width = vocabulary or public_vocabulary("byte_bpe_50k.json"), np.dtype(dtype).itemsize
    names = [x.split()[0] for x in SHARD.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SHARD.split(", ")]

    def shards(batches):
        from pyspark import TaskContext

        tokens, end, part = token_bytes(vocabulary, dtype), np.array([end_id], dtype).tobytes(), TaskContext.get().partitionId()
        keys, ids, size, number, base = [], [], 0, 0, 0
        close = lambda: pa.record_batch([pa.array([v], k) for v, k in zip(_shard(part, number, base, keys, ids, width), kinds, strict=True)], names=names)
        for batch in in_slices(batches):
            for key, own in zip(batch.column(0).to_pylist(), tokens.of_all(batch.column(1)), strict=True):
                keys.append(key)
                ids.append(own + end)
                size += len(ids[-1])
                if size >= shard_bytes:
                    yield close()
                    keys, ids, size, number, base = [], [], 0, number + 1, base + size // width
        if keys:
            yield close()

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.col("text").cast("string")
    order = ("doc_id", "hash", "n", "read")
    run = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.length(text).alias("n"), F.monotonically_increasing_id().alias("read")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    run.mapInArrow(shards, SHARD).write.option("compression", "zstd").parquet(path)


class Shard:
    """Keyed access to one record of a shard table."""

    def __init__(self, row: dict, dtype: str = "<u2"):
        self.index = PerfectHash(row["bits"], row["sizes"], row["rest"])
        self.fingerprints, self.places, self.lengths = (np.frombuffer(row[k], t) for k, t in (("fingerprints", "<u4"), ("places", "<u8"), ("lengths", "<u4")))
        self.ids = np.frombuffer(row["payload"], dtype)

    def find(self, keys: np.ndarray, copies: np.ndarray, nulls: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each key (the first `nulls` are null); -1 where the shard lacks it."""
        hashes = hashed_keys(keys, copies, nulls)
        slots = self.index.slots(hashes)
        there = slots >= 0
        there[there] = self.fingerprints[slots[there]] == (_mix(hashes[there], 103) >> np.uint64(32)).astype(np.uint32)
        slots = np.where(there, slots, 0)
        return tuple(np.where(there, x[slots].astype(np.int64), -1) if len(x) else np.full(len(keys), -1) for x in (self.places, self.lengths))

    def all_of(self, key: int | None) -> list[tuple[int, int]]:
        """Place and number of ids of every copy of the key."""
        out = []
        while True:
            (place,), (n,) = self.find(np.array([key or 0]), np.array([len(out)]), int(key is None))
            if place < 0:
                return out
            out.append((int(place), int(n)))


def ids_before(shards: DataFrame) -> DataFrame:
    """part, before: the ids of all parts before. One row per range partition, so this window and its broadcast hold as many rows as the writer had tasks."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    return parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))


#: Shards whose ranges look_up() broadcasts (5 numbers each); beyond that, 8 TB of ids, write several tables.
MOST_SHARDS = 1_000_000


def look_up(keys: DataFrame, path: str, dtype: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens, ids of every document written under one of the keys (column doc_id); a key that was never written gives no row (but for one in 2^32 and shard)."""
    spark = keys.sparkSession
    shards = spark.read.schema(SHARD).parquet(path)
    ranges = shards.select("part", "number", "n_null", "first_key", "last_key").collect()
    if len(ranges) > MOST_SHARDS:
        raise ValueError(f"{len(ranges)} shards; look_up() takes {MOST_SHARDS}")
    with_nulls = F.array(*(F.struct(F.lit(r.part).alias("part"), F.lit(r.number).alias("number")) for r in ranges if r.n_null)).cast("array<struct<part:int,number:int>>")
    filled = sorted((r for r in ranges if r.first_key is not None), key=lambda r: (r.first_key, r.part, r.number))
    bounds = spark.sparkContext.broadcast(tuple(np.array([r[k] for r in filled], np.int64) for k in ("first_key", "last_key", "part", "number")))

    def deal(batches):
        first, last, part, number = bounds.value
        for batch in in_slices(batches):
            own = batch.column(0).to_numpy()
            low, high = np.searchsorted(last, own, "left"), np.searchsorted(first, own, "right")
            n = np.maximum(0, high - low)
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            yield pa.record_batch([pa.array(np.repeat(own, n)), pa.array(part[at].astype(np.int32)), pa.array(number[at].astype(np.int32))], names=["doc_id", "part", "number"])

    def find(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row, dtype)
                met = [(key, *x) for key in row["asked"] for x in shard.all_of(key)] + [(None, *x) for x in (shard.all_of(None) if row["asks_null"] else [])]
                yield pa.record_batch([pa.array([row["part"]] * len(met), pa.int32()), pa.array([m[0] for m in met], pa.int64()), pa.array([m[1] + row["base"] for m in met], pa.int64()), pa.array([m[2] for m in met], pa.int64()), pa.array([shard.ids[p : p + n].astype("i4") for _, p, n in met], pa.list_(pa.int32()))], names=["part", "doc_id", "own_start", "n_tokens", "ids"])

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    dealt = asked.where("doc_id IS NOT NULL").mapInArrow(deal, "doc_id long, part int, number int")
    nulls = asked.where("doc_id IS NULL").select("doc_id", F.explode(with_nulls).alias("s")).select("doc_id", "s.part", "s.number")
    # The keys asked of a shard are no more than the documents it holds, or few that it lacks.
    by_shard = dealt.unionByName(nulls).groupBy("part", "number").agg(F.collect_list("doc_id").alias("asked"), F.bool_or(F.col("doc_id").isNull()).alias("asks_null"))
    found = shards.join(by_shard, ["part", "number"]).mapInArrow(find, "part int, doc_id long, own_start long, n_tokens long, ids array<int>")
    return found.join(F.broadcast(ids_before(shards)), "part").select("doc_id", (F.col("own_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def read_token_files(spark: SparkSession, path: str, dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """Every document of the shards, each found through its index: doc_id, start, n_tokens, ids_crc32, and ids if asked."""
    shards = spark.read.schema(SHARD).parquet(path)
    schema = "part int, doc_id long, own_start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard, keys, nulls = Shard(row, dtype), np.frombuffer(row["keys"], "<i8"), row["n_null"]
                places, lengths = shard.find(keys, copy_numbers(keys, nulls), nulls)
                ids = [shard.ids[p : p + n].astype("<u4") for p, n in zip(places, lengths, strict=True)]
                columns = [pa.array(np.full(len(keys), row["part"], np.int32)), pa.array(keys, mask=np.arange(len(keys)) < nulls), pa.array(places + row["base"]), pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                names = ["part", "doc_id", "own_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.record_batch(columns, names=names)

    # Few shards fit a batch: a shard is megabytes.
    return shards.mapInArrow(documents, schema).join(F.broadcast(ids_before(shards)), "part").select("doc_id", (F.col("own_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


QUERIES = {"op9_token_files": op9_token_files}
ORACLE: dict[str, str] = {}

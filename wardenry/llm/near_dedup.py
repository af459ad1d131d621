"""Near-duplicates by HyperMinHash: compressed registers, banding, estimates, exact confirmation.

A document is its set of distinct word shingles, as 64-bit hashes. A shingle's hash picks one of
REGISTERS buckets and competes there by the rest of its bits; a bucket keeps the smallest, as a count of leading zeros
(6 bits) and the mantissa after them (10 bits), two bytes in all. Buckets that stay empty borrow
from a filled one, in an order fixed for each bucket, so short documents band as well as long ones.
Bands of ROWS registers are hashed; equal hashes name candidates.

Work on pairs stays in proportion to the rows, however large a group of copies is:
 1. Documents with equal sets are one class, shown by its smallest doc_id.
 2. In each band bucket, every class is compared with one anchor only; confirmed pairs link, and components of
    the links are found. Members that are in the anchor's component by now need no further comparison.
 3. Where members of several components still meet in buckets, other anchors take turns, as long as pairs to be
    compared outnumber the members by MANY and turns settle half of them; then buckets with few pairs are compared
    pair by pair, and members of the others where they share a rare shingle, which near enough sets must. So each two
    classes that share a bucket are compared or are linked through others: nothing is capped.
Pairs first pass an estimate from their registers, corrected for registers that agree by chance and kept with a margin of
five standard errors; what is left is confirmed on full sets.

A pair of similarity 0.8 is missed by all bands with a probability of 0.672^32, about 3 in a million.

Bands or shingles that hold more than one row in HOT of a table are at most HOT; their rows meet what they are joined with by broadcast, so a key with a
third of all rows is dealt like any others.

Null or empty texts have empty sets and are linked with nothing. A null doc_id stands for no document that could be named: its row is
kept, alone, with a null component. Rows that repeat a doc_id are one document, linked with what any of their texts is near. Texts may be of any length. Ties don't arise: the smallest doc_id
names a component. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, in_slices, join_hot, spread, table, written

REGISTERS, ROWS = 160, 5
MANTISSA = 10
MANY = 4
#: Ids of candidates are broadcast up to this number (16 MB), and joined by a shuffle beyond it.
BROADCAST_IDS = 1_000_000
#: Edges that a task holds at once when it looks for components (16 bytes each).
EDGES_PER_TASK = 1_000_000
EMPTY = np.uint16(0xFFFF)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """Word -> 64-bit hash, remembered within a task."""

    LIMIT = 50_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


def shingle_set(text: str | None, words: WordIds, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of `size` consecutive words; the whole sequence where there are fewer."""
    own = (text or "").encode().translate(_LOWER).split()
    if not own:
        return np.zeros(0, np.uint64)
    ids = np.fromiter([words[w] for w in own], np.uint64, len(own))
    n, out = min(size, len(own)), np.uint64(len(own) if len(own) < size else 0)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - n + 1 + i])
    return np.unique(out)


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the smallest value in each bucket; EMPTY without one."""
    fresh = mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93))
    bucket = (fresh >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
    smallest = np.full(REGISTERS, 2**64 - 1, np.uint64)
    np.minimum.at(smallest, bucket.astype(np.int64), mixed(fresh ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(1))
    # The values have 63 bits; frexp gives the position of the first one.
    zeros = np.clip(63 - np.frexp(smallest.astype(np.float64))[1], 0, 62)
    after = (smallest << (zeros + 2).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return np.where(smallest == 2**64 - 1, EMPTY, (zeros.astype(np.uint64) << np.uint64(MANTISSA) | after).astype(np.uint16))


@lru_cache(maxsize=1)
def lenders() -> np.ndarray:
    """For each register the order in which it asks the others."""
    return np.argsort(mixed(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(77)).reshape(REGISTERS, REGISTERS), axis=1)


def densified(registers: np.ndarray) -> np.ndarray:
    empty = np.flatnonzero(registers == EMPTY)
    if not 0 < len(empty) < REGISTERS:
        return registers
    out, order = registers.copy(), lenders()[empty]
    out[empty] = registers[order[np.arange(len(empty)), (registers != EMPTY)[order].argmax(axis=1)]]
    return out


def band_hashes(registers: np.ndarray) -> np.ndarray:
    own = densified(registers).reshape(-1, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.arange(len(own), dtype=np.uint64)
        for i in range(ROWS):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + own[:, i])
    return out.view(np.int64)


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of two unrelated sets of n and m shingles agrees, for minima of the size that such sets have.

    A minimum of k values is near 1 / k, and its neighbours that share zeros and mantissa span about 2^-MANTISSA of it; the product
    of the two densities over that span is below 2^-MANTISSA * n m / (n + m)^2, up to a factor near 1.
    """
    return 2.0**-MANTISSA * n * m / np.maximum(1, n + m) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarities from registers (the last axis), corrected for chance, and their standard errors near the threshold."""
    used = (a != EMPTY) | (b != EMPTY)
    k = np.maximum(used.sum(axis=-1), 1)
    agree, chance = (used & (a == b)).sum(axis=-1) / k, chance_agreement(n, m)
    return np.maximum(0.0, (agree - chance) / (1 - chance)), np.sqrt(0.16 / k) + 1.0 / k


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, print (of the set), registers."""
    def sign(batches):
        import xxhash

        words = WordIds()
        for batch in in_slices(batches):
            sets = [shingle_set(x, words, shingle) for x in batch.column(1).to_pylist()]
            prints = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.record_batch([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.string()), pa.array([registers_of(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n_shingles", "print", "registers"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, n_shingles long, print string, registers binary")


def banded(classes: DataFrame) -> DataFrame:
    def split(batches):
        for batch in in_slices(batches):
            ids, registers = batch.column("id").to_numpy(), batch.column("registers").to_pylist()
            bands = [band_hashes(np.frombuffer(x, np.uint16)) for x in registers]
            n = REGISTERS // ROWS
            yield pa.record_batch([pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)), pa.array(np.repeat(ids, n), pa.int64())], names=["band", "id"])

    return classes.select("id", "registers").mapInArrow(split, "band long, id long")


def sets_of(ids: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """id, own (the full set) of some documents, from their texts: nothing is stored for the others."""
    few = ids.count() <= BROADCAST_IDS

    def collect(batches):
        words = WordIds()
        for batch in in_slices(batches):
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(x, words, shingle).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "own"])

    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(collect, "id long, own binary")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those that pass the estimate and then the exact test on full sets."""
    n = classes.select("id", "n_shingles", "registers")
    both = pairs.join(n.toDF("a", "n_a", "regs_a"), "a").join(n.toDF("b", "n_b", "regs_b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def likely(batches):
        for batch in in_slices(batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            value, error = estimate(x, y, *(batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")))
            keep = value >= percent / 100 - 5 * error
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches):
        for batch in in_slices(batches):
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = written(both.mapInArrow(likely, "a long, b long"), "likely")
    ids = written(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "likely-ids")
    sets = written(sets_of(ids, texts, shingle), "sets")
    full = near.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return full.select("a", "b", "set_a", "set_b").mapInArrow(exact, "a long, b long")


def sharing_rare(open_: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components of open_ (id, component) that share one of their rarest shingles.

    With all shingles in one order, rarest first, and the first shared one at places i and j (from 0), two sets share at most
    min(n_a - i, n_b - j); near enough ones share `least`. So one of each pair's shared shingles passes the join's condition.
    Passages that many documents share come last in that order and pair nobody.
    """
    def spread(batches):
        for batch in in_slices(batches):
            own = [np.frombuffer(x, np.int64) for x in batch.column("own").to_pylist()]
            yield pa.record_batch([pa.array(np.repeat(batch.column("id").to_numpy(), [len(x) for x in own]), pa.int64()), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], names=["id", "shingle"])

    ids = written(open_.select("id"), "open-ids")
    # Written in between, so that a task has one Python worker at a time.
    shingles = written(written(sets_of(ids, texts, shingle), "open-sets").mapInArrow(spread, "id long, shingle long"), "open-shingles")
    common = written(shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "open-counts")
    # Shingles of one document only stand first and pair nobody; they just take up places. A document's own shingles are as bounded as its text.
    ranked = join_hot(shingles, common, ["shingle"], hot_keys(common, ["shingle"])).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("own"))
    sized = ranked.join(classes.select("id", F.col("n_shingles").alias("n")), "id").join(open_, "id").withColumn("alone", F.expr("n - size(own)"))
    places = F.expr(f"n - ({percent} * n + 99) div 100 + 1 - alone").cast("int")
    first = sized.where(places > 0).select("id", "component", "n", "alone", F.posexplode(F.slice("own", F.lit(1), places)).alias("k", "s"))
    keys = written(first.select(F.col("s.shingle").alias("shingle"), "id", "component", "n", (F.col("alone") + F.col("k")).alias("place")), "rare")
    both = 100 + percent
    # The smaller of two sets must have the shared shingle among fewer places.
    smaller = keys.where(f"place <= n - ({2 * percent} * n + {both - 1}) div {both}").alias("x")
    least = f"(({percent} * (x.n + y.n) + {both - 1}) div {both})"
    on = f"x.shingle = y.shingle AND x.component <> y.component AND (x.n < y.n OR x.n = y.n AND x.id < y.id) AND 100 * x.n >= {percent} * y.n AND x.n - x.place >= {least} AND y.n - y.place >= {least}"
    return smaller.join(keys.alias("y"), F.expr(on)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the edges but the smallest of its component, with that smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        near = low.copy()
        np.minimum.at(near, low[x], low[y])
        np.minimum.at(near, low[y], low[x])
        while not np.array_equal(near, jumped := near[near]):
            near = jumped
        near = near[low]
        if np.array_equal(near, low):
            return ids[low != np.arange(len(ids))], ids[low[low != np.arange(len(ids))]]
        low = near


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b), a > b, that connect what the given ones do, at most one for each end in each of the parts."""
    def local(batches):
        tables = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if tables:
            a, b = stars(*(np.concatenate(x) for x in zip(*tables, strict=True)))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return edges.select("a", "b").coalesce(parts).mapInArrow(local, "a long, b long")


def connected(edges: DataFrame, name: str = "links", per_task: int = EDGES_PER_TASK) -> DataFrame:
    """id, component (smallest id) of every end of the edges (a, b).

    Every task replaces its share of the edges, per_task at most or so, by stars. Where there are several shares, large-star and
    small-star take turns until nothing changes.
    """
    spark = edges.sparkSession
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def digest(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    parts = -(-now.count() // per_task)
    if not parts:
        return spark.createDataFrame([], "id long, component long")
    now = written(contracted(now, parts), name)
    last = digest(now) if parts > 1 else None
    while parts > 1:
        # Large star: greater neighbours go to the smallest of the neighbourhood.
        near = both(now)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = written(large, name)
        # Small star: a and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        now = written(small, name)
        new = digest(now)
        if new == last:
            break
        last = new
    roots = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")) if parts > 1 else now.toDF("id", "component")
    return roots.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    return members.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row."""
    spark: SparkSession = docs.sparkSession
    signed = written(signatures(spread(docs.select("doc_id", "text")), shingle), "signatures")
    named = signed.where("doc_id IS NOT NULL AND print IS NOT NULL")
    # Every row of a class has the same registers; max() lets them be combined before the shuffle.
    classes = written(named.groupBy("print").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers")), "classes")
    # Sets of other sizes can't be that near and different.
    least = -(-percent // max(1, 100 - percent))
    bands = banded(classes.where(F.col("n_shingles") >= least))
    crowded = written(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    members = written(join_hot(bands, crowded.select("band"), ["band"], hot_keys(crowded, ["band"]), "left_semi"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    links = spark.createDataFrame([], "a long, b long")
    # A doc_id that came with several texts links their classes.
    alias = named.select("doc_id", "print").join(classes.select("print", "id"), "print").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    doubled = named.groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p <> q").select(F.col("doc_id").alias("a"))
    links = links.unionByName(written(alias.join(doubled, "a", "left_semi"), "doubled"))
    components, turn, before = connected(links), 0, 0.0
    while True:
        found = labelled(members, components)
        counts = found.groupBy("band", "component").agg(F.count("*").alias("n"))
        squares = F.sum(F.col("n").cast("double") * F.col("n"))
        per_band = counts.groupBy("band").agg(F.sum("n").alias("n"), squares.alias("squares"), F.max_by("component", F.struct("n", "component")).alias("top"), F.count("*").alias("components")).where("components > 1")
        per_band = written(per_band.select("band", "n", "top", ((F.col("n").cast("double") * F.col("n") - F.col("squares")) / 2).alias("pairs")), "bands")
        total, pairs_left = per_band.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0.0))).first()
        if not total:
            break
        hot = hot_keys(per_band, ["band"])
        open_ = written(join_hot(found, per_band.select("band", "top", (F.col("pairs") > MANY * F.col("n")).alias("crowd")), ["band"], hot), "open")
        # A turn that settles less than half of the pairs met groups that are no copies.
        last = turn > 0 and (pairs_left <= MANY * total or 2 * pairs_left > before)
        before = pairs_left
        if last:
            # Small buckets are compared pair by pair; members of large ones by what is rare among them.
            quiet, crowd = open_.where("NOT crowd"), open_.where("crowd")
            # One of two components is not the bucket's largest. Such members are few where the bucket is large, or its pairs would be many.
            few = quiet.where("component <> top").select("band", F.col("id").alias("few"), F.col("component").alias("own"))
            pairs = join_hot(quiet, few, ["band"], hot).where("component <> own AND (component = top OR few < id)").select(F.col("few").alias("a"), F.col("id").alias("b"))
            if crowd.first():
                pairs = pairs.unionByName(sharing_rare(crowd.select("id", "component").distinct(), classes, texts, shingle, percent))
        else:
            rank = F.struct(F.xxhash64("id", F.lit(turn)), F.col("id"), F.col("component")) if turn else F.struct(F.lit(0).cast("long"), F.col("id"), F.col("component"))
            anchors = open_.groupBy("band").agg(F.min(rank).alias("x")).select("band", F.col("x.id").alias("a"), F.col("x.component").alias("own"))
            pairs = join_hot(open_, anchors, ["band"], hot).where("component <> own").select("a", F.col("id").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = written(confirmed(pairs, classes, texts, shingle, percent), "found")
        links = links.unionByName(found)
        components = connected(links)
        turn += 1
        if last:
            break
    # A row for each print; without an aggregate beside the join, Spark can split the rows of a common one.
    of_print = labelled(classes.select("print", "id"), components).select("print", "component")
    out = signed.join(of_print, "print", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, and of several rows with that doc_id the one with the least text (nulls last), then the least other columns. Rows without a doc_id stay."""
    gone = written(near_duplicates(docs, shingle, percent).where("NOT kept").select("doc_id").distinct(), "gone")
    rest = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    # Only rows that share a doc_id meet, and all but one go before the shuffle.
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if not again.first():
        return rest
    again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    plain = [c for c, t in docs.dtypes if not t.startswith(("map", "variant")) and "map<" not in t]
    order = F.struct(F.col("text").isNull(), F.col("text"), *(F.col(c) for c in plain if c != "text"))
    one = rest.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("_row")).select("_row.*")
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


ORACLE: dict[str, str] = {}
QUERIES = {"op6_near_dedup": op6_near_dedup}

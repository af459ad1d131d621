"""Vectors as codes of four bytes, with exact integers throughout: a product quantiser whose distances come from dictionaries of values.

Components become integers floor(1024 * x), vectors are cut into PARTS equal parts, and each part position has a codebook of ENTRIES entries, which starts as the
parts of the smallest vec_ids and is moved to the floor of its parts' mean ROUNDS times. Within a batch each dimension is encoded as a dictionary of its distinct
integers; the squared differences of each of them to all entries are tabulated once, and a vector's distances are those tables' rows, gathered by its dictionary codes
and added up. Of equal distances the lower entry is taken. Tables hold 32-bit integers where sums stay below 2**31, else 64-bit ones.

Tasks return sums and counts of each entry, so that a round gathers a codebook's size and no more; codebooks are broadcast, for they are as bounded.

Not kept: rows without a vector, with null or non-finite components or components of 131,072 or more either way (their squares are no 64-bit integers), without components, or of another length than the kept vector of the smallest vec_id.
Where PARTS doesn't divide the length, zeros are added at the end. Fewer than ENTRIES kept vectors make as many entries; entries that no part is nearest to stay as they are. Rows that repeat are coded each (of equal vec_ids, the lesser vector
starts codebooks first); null vec_ids come last. Null labels are one label. An empty table gives no rows. encoded() keeps other columns, whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, hot_keys, in_slices, join_hot, spread, table, written

PARTS, ENTRIES, ROUNDS, SCALE, LARGEST = 4, 256, 4, 1024, 1 << 27
#: Vectors whose distances are added up at once: a block of distances should stay in a core's cache.
BLOCK = 1024
MADE = ("code", "error", "label_error", "codebooks_sha256")


def integers(vector: str) -> Column:
    """The vector's components as integers; null where it is not kept."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: x * SCALE)
    fine = (F.size(scaled) > 0) & F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False)))
    return F.when(fine, F.transform(scaled, lambda x: F.floor(x).cast("int")))


def distances(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers to entries (both: a column a dimension), by a dictionary of each dimension."""
    low, high = min(int(values.min()), int(entries.min())), max(int(values.max()), int(entries.max()))
    kind = np.int32 if entries.shape[1] * (high - low) ** 2 < 1 << 31 else np.int64
    out, row = np.zeros((len(values), len(entries)), kind), np.empty((len(values), len(entries)), kind)
    for k in range(entries.shape[1]):
        distinct, codes = np.unique(values[:, k], return_inverse=True)
        differences = np.subtract.outer(distinct.astype(kind), entries[:, k].astype(kind))
        out += np.take(differences * differences, codes.reshape(-1), axis=0, out=row)
    return out


def nearest(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each row, and the squared distances to it. books: part, entry, position."""
    found, errors = np.zeros((len(values), len(books)), np.int64), np.zeros((len(values), len(books)), np.int64)
    width = books.shape[2]
    for at in range(0, len(values), BLOCK):
        rows = values[at : at + BLOCK]
        for part, book in enumerate(books):
            far = distances(rows[:, part * width : (part + 1) * width], book)
            found[at : at + BLOCK, part] = own = far.argmin(axis=1)
            errors[at : at + BLOCK, part] = far[np.arange(len(rows)), own]
    return found, errors


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def first_books(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Of the vectors of the smallest vec_ids."""
    rows = [r.vector for r in kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()]
    return np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of a written table of vec_id and vector, all of one length that parts divide."""
    books = first_books(kept, parts, entries)
    width = books.shape[2]
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast(books)

        def sums(batches, shared=shared):
            books = shared.value
            total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in in_slices(batches):
                values = matrix(batch.column(0), width * parts).astype(np.int64)
                found, _ = nearest(values, books)
                for part in range(parts):
                    order = np.argsort(found[:, part], kind="stable")
                    own, first = np.unique(found[order, part], return_index=True)
                    total[part, own] += np.add.reduceat(values[order, part * width : (part + 1) * width], first, axis=0)
                    count[part, own] += np.diff(np.append(first, len(order)))
            part, entry = np.nonzero(count)
            flat = total[part, entry].reshape(-1)
            place = np.repeat(np.stack([part, entry, count[part, entry]]), width, axis=1)
            yield pa.record_batch([pa.array(x) for x in (place[0], place[1], np.tile(np.arange(width), len(part)), flat, place[2])], names=["part", "entry", "position", "total", "n"])

        moved = kept.select("vector").mapInArrow(sums, "part long, entry long, position long, total long, n long").groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in moved.collect():
            books[r.part, r.entry, r.position] = r.total // r.n
    return books


def printed(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """The kept rows of vectors (vec_id, the vector, label and others) with code (a byte a part, in hex), error, label_error and codebooks_sha256."""
    spark, vectors = vectors.sparkSession, vectors.drop(*MADE)
    whole = free_name(vectors, "vector")
    own = vectors.withColumn(whole, integers(vector)).where(F.col(whole).isNotNull())
    first = own.orderBy(F.asc_nulls_last("vec_id"), whole).select(F.size(whole).alias("n")).first()
    length = first.n if first else parts
    padded = -(-length // parts) * parts
    own = own.where(F.size(whole) == length)
    if padded > length:
        own = own.withColumn(whole, F.concat(whole, F.array_repeat(F.lit(0), padded - length)))
    own = written(own, "vectors")
    books = train(own.select("vec_id", F.col(whole).alias("vector")), parts, entries, rounds) if first else np.zeros((parts, 0, 1), np.int64)
    shared, at = spark.sparkContext.broadcast(books), own.columns.index(whole)
    schema = StructType([f for f in own.schema if f.name != whole]).add("code", "string").add("error", "long")

    def code(batches):
        for batch in in_slices(batches):
            found, errors = nearest(matrix(batch.column(at), padded), shared.value)
            codes = [x.tobytes().hex() for x in found.astype(np.uint8)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.record_batch([*columns, pa.array(codes, pa.string()), pa.array(errors.sum(axis=1))], names=schema.names)

    coded = written(own.mapInArrow(code, schema), "codes")
    if "label" not in coded.columns:
        return coded.withColumn("label_error", F.lit(None).cast("long")).withColumn("codebooks_sha256", F.lit(printed(books)))
    # Labels as text beside a mark, so that nulls meet; a label of very many rows meets its one sum by broadcast.
    name, none = free_name(coded, "name"), free_name(coded, "none")
    keyed = coded.withColumn(name, F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn(none, F.col("label").isNull())
    sums = written(keyed.groupBy(name, none).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    joined = join_hot(keyed, sums.drop("n"), [name, none], hot_keys(sums, [name, none]))
    return joined.drop(name, none).withColumn("codebooks_sha256", F.lit(printed(books)))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return encoded(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Each round as two tables: the nearest entries a<i> of codebooks c<i>, and the next codebooks."""
    steps = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, (i - 1) // (len(v) // {PARTS}) AS part, (i - 1) % (len(v) // {PARTS}) AS place, v[i] AS val FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS i FROM k))",
        f"c0 AS MATERIALIZED (SELECT entry, part, place, val FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM k ORDER BY vec_id, v LIMIT {ENTRIES}) USING (r))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, part, min(far * {ENTRIES} + entry) % {ENTRIES} AS entry, min(far) AS far FROM (SELECT r, part, entry, CAST(sum((x.val - c.val) * (x.val - c.val)) AS BIGINT) AS far FROM x JOIN c{i} c USING (part, place) GROUP BY ALL) GROUP BY ALL)")
        if i < ROUNDS:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.entry, c.part, c.place, CAST(coalesce(floor(s.total / s.n), c.val) AS BIGINT) AS val FROM c{i} c LEFT JOIN (SELECT a.entry, part, place, sum(val) AS total, count(*) AS n FROM a{i} a JOIN x USING (r, part) GROUP BY ALL) s ON s.entry = c.entry AND s.part = c.part AND s.place = c.place)")
    return f"""WITH {", ".join(steps)},
f AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN k USING (r) GROUP BY label),
b AS (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN k USING (r) JOIN l ON l.label IS NOT DISTINCT FROM k.label, b"""


ORACLE = {"op13_vector_codes": _oracle()}
QUERIES = {"op13_vector_codes": op13_vector_codes}

"""Vector codes against plain integer arithmetic, on ties, odd rows and lengths."""

import hashlib
import math
import random

import numpy as np
import pytest

from wardenry.llm import vector_codes

ROWS = "vec_id long, embedding array<float>, label int, code string, n string"


def brute(rows, entries):
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and v]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(order[0][1])
    kept = [(i, v + [0] * (-length % 4), y) for i, v, y in kept if len(v) == length]
    order = [(i, v + [0] * (-length % 4)) for i, v, _ in order if len(v) == length]
    width = len(kept[0][1]) // 4
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(4)]
    books = [[cut(v)[p] for _, v in order[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min((far(part, e), k) for k, e in enumerate(books[p])) for p, part in enumerate(cut(v))]
    for _ in range(4):
        met = [(cut(v), assign(v)) for _, v, _ in kept]
        books = [[[sum(x) // len(own) for x in zip(*own)] if (own := [v[p] for v, a in met if a[p][1] == k]) else e for k, e in enumerate(book)] for p, book in enumerate(books)]
    told = [(i, y, "".join(f"{k:02x}" for _, k in assign(v)), sum(d for d, _ in assign(v))) for i, v, y in kept]
    print_ = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sum(x[3] for x in told if x[1] == y), print_) for i, y, c, e in told), key=repr)


@pytest.mark.parametrize("length, entries, spread", [(8, 256, 1.0), (8, 5, 0.01), (6, 7, 100_000.0)])
def test_by_brute_force(spark, length, entries, spread):
    pick = random.Random(length * entries)
    value = lambda: float(np.float32(pick.uniform(-spread, spread)))
    rows = [(i, [value() for _ in range(length)], pick.choice((None, 1, 2))) for i in range(60)]
    rows += [(3, rows[3][1], 1), (3, [0.0] * length, 1), (None, [0.0] * length, None), (70, [-0.0] * length, 2)]
    odd = [(-5, None, 1), (-4, [], 1), (-3, [None] + [1.0] * (length - 1), 1), (-2, [math.nan] * length, 1), (-1, [math.inf] + [0.0] * (length - 1), 1), (90, [1.0] * (length + 1), 1)]
    docs = spark.createDataFrame([(*r, "c", "n") for r in rows + odd], ROWS).repartition(3)
    found = vector_codes.encoded(docs, entries=entries)
    assert sorted(map(tuple, found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == brute(rows + odd, entries)
    assert {r.n for r in found.collect()} == {"n"} and found.columns.count("code") == 1


def test_without_kept_vectors(spark):
    docs = spark.createDataFrame([(1, None, 1, "", ""), (2, [math.nan], 1, "", ""), (3, [200_000.0], 1, "", "")], ROWS)
    assert vector_codes.encoded(docs).count() == 0
    assert vector_codes.encoded(docs.drop("label")).columns == ["vec_id", "embedding", "n", "code", "error", "label_error", "codebooks_sha256"]


def test_distances_are_exact():
    pick = np.random.default_rng(4)
    for most in (3, 500, 1 << 27):
        values, entries = pick.integers(-most, most, (50, 16)), pick.integers(-most, most, (9, 16))
        assert (vector_codes.distances(values, entries) == ((values[:, None, :] - entries[None]) ** 2).sum(axis=2)).all()

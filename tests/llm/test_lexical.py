"""Ranked search by brute force: ties, repeats, blocks, sketches as bounds."""

import collections
import math
import random
import re

import numpy as np
import pytest

from wardenry.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, every = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // every
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in dict.fromkeys(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if no else d, -s) for k, (s, no, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def tables():
    pick = random.Random(3)
    names = [f"t{i}" for i in range(60)] + ["Ünï", "日本"]
    docs = [(i, " ".join(pick.choices(names[: pick.choice((3, 20, 62))], k=pick.choice((0, 1, 5, 40, 400))))) for i in range(150)]
    docs += [(7, docs[7][1]), (None, "t1 t2 T3"), (900, None), (901, ""), (902, " -- "), (903, "t5 " * 700 + "t6"), (904, "t5 " * 800 + "t6"), *((1000 + i, "same text of all t9") for i in range(40))]
    items = [(i, " ".join(pick.choices(names, k=pick.choice((1, 3, 12))))) for i in range(25)] + [(3, "t5 t6"), (None, "t1"), (50, None), (51, " "), (52, "nothing known"), (53, "same text"), (53, "same text"), (54, "T5-t6,t5")]
    return docs, items


@pytest.mark.parametrize("block, top", [(100_000, 10), (20, 3)])
def test_by_brute_force(spark, monkeypatch, block, top):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    docs, items = tables()
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string").repartition(2), top)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, top)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    index = lexical.build_index(docs)
    assert lexical.search(index, items.where("item_id > 1")).count() == 0 and lexical.search(index, items).count() == 1
    none = lexical.search(lexical.build_index(docs.where("doc_id > 1")), items)
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_sketches_are_bounds():
    pick = random.Random(9)
    weigh = {f"t{i}": pick.randrange(1, 9000) for i in range(500)}
    items = lexical.Items([(k, sorted(pick.sample(sorted(weigh), 8))) for k in range(20)], weigh)
    for distinct in (1, 30, 400):
        counts = {t: pick.choice((1, 2, 300)) for t in pick.sample(sorted(weigh), distinct)}
        cells = lexical.sketch([t.encode() for t in counts], np.array(list(counts.values()), np.int32))
        assert len(cells) == lexical.size_of(distinct) >= min(4 * distinct, lexical.MOST_SIZE)
        bounds = items.bounds([cells.tobytes()], np.array([90]))[0]
        exact = [sum(w * ((10**9 * counts[t]) // (1000 * counts[t] + 720)) for t, w in own if t in counts) for own in items.each]
        assert all(b >= x for b, x in zip(bounds.tolist(), exact, strict=True))

"""Long and repetitive inputs: time in proportion to their length, results by brute force."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from wardenry.llm import decontaminate, url_filter


def covered(items, words, size=decontaminate.WINDOW):
    grams = collections.defaultdict(set)
    for item, text in items:
        own = decontaminate.words_of(text)
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            grams[tuple(own[i : i + n])].add(item)
    hit, met = set(), set()
    for n in {len(g) for g in grams}:
        for i in range(len(words) - n + 1):
            if (g := tuple(words[i : i + n])) in grams:
                hit.update(range(i, i + n))
                met |= grams[g]
    return hit, sorted(met)


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 9])
def test_windows_by_brute_force(vocabulary):
    pick = random.Random(vocabulary)
    names = [f"w{i}" for i in range(vocabulary)]
    for _ in range(60):
        items = [(str(i), " ".join(pick.choices(names, k=pick.choice((0, 1, 3, 12, 13, 14, 20, 40, 60))))) for i in range(pick.randrange(6))]
        text = " ".join(pick.choices([*names, "other"], k=pick.choice((0, 5, 13, 30, 80)))) + " " + (pick.choice(items)[1] if items else "")
        words = decontaminate.words_of(text)
        runs, met = decontaminate.Windows(items).find(words)
        assert ({x for a, b in runs for x in range(a, b)}, met) == covered(items, words)
        assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))


def test_repeated_words_are_linear():
    windows = decontaminate.Windows([("1", "w " * 500), ("2", "w " * 20_000 + "v")])
    words, began = decontaminate.words_of("w " * 100_000), time.time()
    assert windows.find(words) == ([(0, 100_000)], ["1", "2"])
    assert time.time() - began < 1


def test_hosts_of_very_many_labels(spark):
    """Only suffixes that may be listed are made."""
    host = "a." * 1_000_000 + "example.com"
    captures = spark.createDataFrame([(1, f"http://{host}/x"), (2, "http://other.org/")], "page_id long, url string").withColumn("fetched", F.lit("2024-02-01").cast("date"))
    entries = spark.createDataFrame([("domain", "example.com", "block"), ("domain", "a.example.com", "allow"), ("domain", "b.a.example.com", "block"), ("domain", "xample.com", "block")], "kind string, value string, action string").withColumn("since", F.lit("2024-01-01").cast("date"))
    told = {r.page_id: (r.verdict, r.value) for r in url_filter.judge(captures, entries).collect()}
    assert told == {1: ("allow", "a.example.com"), 2: ("none", None)}

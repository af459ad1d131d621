"""Quality rules by brute force, on odd rows, and against the labels of the smallest table."""

import collections
import math
import random
import re

import numpy as np
import pytest

from wardenry.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, kept string, extra string"
PROSE = "the cat and the dog went to the house by the sea and sat there for a long time until night came over them".split()


def base(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def texts():
    pick = random.Random(5)
    odd = [None, "", " ", "\n\n", "é", "日本 語\x1c x\x85y  z", "a b c d e f g h " * 4, "x\nx\n x\n\nx", "# * $ % & | < >", "w " * 3000, "\U0001f600 " * 30, "\x00\x01 \x7f"]
    return odd + [" ".join(pick.choices(["a", "b", "B", "c"], k=pick.randrange(60))) for _ in range(60)] + [" ".join(pick.choices(PROSE, k=200)) for _ in range(30)] + [" ".join(w + "###" for w in pick.choices(PROSE, k=200)), " ".join(f"q{pick.random()}" for _ in range(200))]


def js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a: sum(x * math.log2(2 * x / (y + z)) for x, y, z in zip(a, p, q) if x)
    return math.sqrt(max(0, (part(p) + part(q)) / 2))


def verdicts(rows):
    """(text, lang) -> near enough, by definition."""
    classes = lambda t: [len(re.findall("[" + p.replace("\\x{80}-\\x{BF}", "\x80-\xbf").replace("\\x{C0}-\\x{27F}", "\xc0-ɿ").replace("\\x{280}-\\x{7FF}", "ʀ-߿").replace("\\x{2000}-\\x{2FFF}", " -⿿").replace("\\x{800}-\\x{1FFF}\\x{3000}-\\x{FFFF}", "ࠀ-῿　-￿").replace("\\x{10000}-\\x{10FFFF}", "\U00010000-\U0010ffff") + "]", t or "")) for p in quality.CLASSES.values()]
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]
    counts, sums = collections.defaultdict(collections.Counter), collections.defaultdict(lambda: np.zeros(len(quality.CLASSES)))
    for text, lang in rows:
        if lang is not None and text is not None:
            counts[lang].update(low(text))
            sums[lang] += classes(text)
    every = sum(sum(c.values()) for c in counts.values())
    totals = {x: sum(c.values()) for x, c in counts.items() if sum(c.values()) >= max(quality.LEAST_REFERENCE, every / quality.LANGUAGES)}
    common = {x: {w: n for w, n in counts[x].items() if n * quality.COMMON >= totals[x]} for x in totals}

    def near(text, lang):
        own, words = classes(text), low(text)
        out = True
        if sum(own) >= quality.LEAST_CHARS:
            d = js(own, sums[lang])
            out &= d * d <= quality.FAR_CHARS**2 + quality.ALLOWANCE_CHARS * (len(own) - 1) / (8 * sum(own) * math.log(2))
        if len(words) >= quality.LEAST_WORDS:
            met = collections.Counter(w for w in words if w in common[lang])
            p, q = [met[w] for w in common[lang]] + [len(words) - sum(met.values())], [*common[lang].values(), totals[lang] - sum(common[lang].values())]
            out &= js(p, q) ** 2 <= quality.FAR_WORDS**2 + quality.ALLOWANCE_WORDS * (len(p) - 1) / (8 * len(words) * math.log(2))
        return out

    return [not totals or any(near(t, x) for x in totals) for t, _ in rows]


@pytest.fixture(scope="module")
def rows():
    return [(t, (None, "a", "a", "b")[i % 4]) for i, t in enumerate(texts())] + [(" ".join(PROSE[k % 7 :]) * 3, "a") for k in range(60)] + [("Zq " * 40, "b")] * 60


def test_by_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, x, "k", "e") for i, (t, x) in enumerate(rows)] + [(0, *rows[0], "k", "e")], DOCS).repartition(3)
    found = quality.judged(docs, quality.references(docs)).collect()
    near = verdicts(rows)
    assert len(found) == len(rows) + 1 and not all(near)
    for r in found:
        own = base(rows[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == own
        assert r.kept == (near[r.doc_id] and not own[-1]) and r.extra == "e"


def test_without_reference(spark):
    docs = spark.createDataFrame([(1, " ".join(PROSE), "a", "k", "e"), (2, None, None, None, None)], DOCS)
    assert [(r.doc_id, r.kept, r.char_distance) for r in quality.judged(docs, quality.references(docs)).orderBy("doc_id").collect()] == [(1, True, None), (2, False, None)]
    empty = docs.where("doc_id > 5")
    assert quality.keep_good(empty).count() == 0 and quality.keep_good(docs).columns == docs.columns


def test_summaries_lose_no_common_word():
    pick = random.Random(1)
    sums, total = collections.Counter(), collections.Counter()
    for _ in range(40):
        own = collections.Counter(int(pick.paretovariate(0.7)) for _ in range(3000))
        total.update(own)
        sums.update(quality.words_in_short(own, 50))
    n = sum(total.values())
    assert all(total[w] - n / 50 <= sums[w] <= total[w] for w in total if total[w] * 20 > n)


def test_good_documents_stay(spark):
    """By the labels: good ones stay, and of the bad ones that the base rules keep most go."""
    found = quality.op11_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed").groupBy("quality").agg({"kept": "count"}).collect()
    kept = {r.quality: r[1] for r in quality.op11_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("kept").groupBy("quality").count().collect()}
    every = {r.quality: r[1] for r in found}
    assert kept[1] == every[1] and kept.get(0, 0) < 0.3 * every[0]

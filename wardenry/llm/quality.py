"""Quality rules by distribution divergence: a document's histograms against those of its language.

Two histograms are compared by Jensen-Shannon distance (base 2, 0 to 1). One counts characters by class (CLASSES); the other counts the language's common
words, those that make up at least one in COMMON of its words, and all others as one. References are made of all documents whose lang is set. A distance
d over n things and k bins is too far if d*d > most*most + ALLOWANCE * (k - 1) / (8 n ln 2): what a text of n things strays by chance is
allowed for. Guards: a text of under LEAST_CHARS characters or LEAST_WORDS words is not compared by them; a language has a reference if its documents have LEAST_REFERENCE words, and one in LANGUAGES
of all words (so there are at most LANGUAGES). A document that is too far from the reference of its lang, or has none, passes if it is near enough by both to any other
language; with no reference at all it passes.

Common words are found exactly in bounded space: each task sums its words up in at most SUMMARY counts a language, each too low by at most one in SUMMARY of
the words; what these sums leave as possible is then counted exactly. So at most 2 * COMMON words a language are ever broadcast or gathered.

Base rules: under 20 words, or over 30 percent of the words in 8-word windows that the text holds twice or more. Equal windows are told by ranks that double: words, pairs, fours, eights.

Null and empty texts have no words and fail the base rules. Texts may be of any length; a text is worked on as a whole. Rows that repeat are judged each, alike. An empty table gives no rows.
Other columns stay, whatever their names; those named like a result are replaced. A null lang, or one without a reference, is compared with all references.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import in_slices, small_batches, spread, table, written

WINDOW, LEAST_N_WORDS, REPEATED_PERCENT = 8, 20, 30
COMMON, SUMMARY, KEPT_WORDS = 1000, 4000, 300_000
LEAST_CHARS, LEAST_WORDS, LEAST_REFERENCE, LANGUAGES = 100, 50, 2000, 1000
FAR_CHARS, FAR_WORDS, ALLOWANCE_CHARS, ALLOWANCE_WORDS = 0.25, 0.3, 3.0, 1.0
#: Classes of characters: as a class of a regular expression.
CLASSES = {
    "lower": "a-z", "upper": "A-Z", "digit": "0-9", "blank": r"\x09\x20", "newline": r"\x0A-\x0D", "stop": ".,", "symbol": "#*$%&|<>", "control": r"\x00-\x08\x0E-\x1F\x7F",
    "mark": r"\x21\x22\x27-\x29\x2B\x2D\x2F\x3A\x3B\x3D\x3F\x40\x5B-\x60\x7B\x7D\x7E", "latin_mark": r"\x{80}-\x{BF}", "latin": r"\x{C0}-\x{27F}", "letter": r"\x{280}-\x{7FF}", "general_mark": r"\x{2000}-\x{2FFF}",
    "wide": r"\x{800}-\x{1FFF}\x{3000}-\x{FFFF}", "plane": r"\x{10000}-\x{10FFFF}",
}
_NAMES = tuple(CLASSES)
_WHITE = " \t\n\x0b\x0c\r"
_ASCII = ((b"abcdefghijklmnopqrstuvwxyz", "lower"), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), (b"0123456789", "digit"), (b"\t ", "blank"), (b"\n\x0b\x0c\r", "newline"), (b".,", "stop"), (b"#*$%&|<>", "symbol"))


def _class_of(byte: int) -> int:
    """The class of a character by the first byte of its UTF-8; -1: not a first byte."""
    if byte < 128:
        other = "control" if byte < 32 or byte == 127 else "mark"
        return _NAMES.index(next((name for own, name in _ASCII if byte in own), other))
    ends = ((0xC0, None), (0xC3, "latin_mark"), (0xCA, "latin"), (0xE0, "letter"), (0xE2, "wide"), (0xE3, "general_mark"), (0xF0, "wide"), (0x100, "plane"))
    name = next(name for end, name in ends if byte < end)
    return -1 if name is None else _NAMES.index(name)


_BYTES = np.zeros((256, len(_NAMES)), np.int64)
for _b in range(256):
    if _class_of(_b) >= 0:
        _BYTES[_b, _class_of(_b)] = 1
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def classes_of(text: bytes) -> np.ndarray:
    """How many characters of each class."""
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _BYTES


def repeated_words(texts: list[list[bytes]], size: int = WINDOW) -> np.ndarray:
    """For each list of words, how many lie in windows of `size` (a power of two) words that it holds twice or more."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    known: dict[bytes, int] = {}
    ranks = np.fromiter((known.setdefault(w, len(known)) for own in texts for w in own), np.int64, int(lengths.sum()))
    n, owner, step = len(ranks), np.repeat(np.arange(len(texts)), lengths), 1
    if n < size:
        return np.zeros(len(texts), np.int64)
    while step < size:
        ranks = np.unique(ranks[:-step] * (n + 1) + ranks[step:], return_inverse=True)[1].reshape(-1)
        step *= 2
    starts = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
    _, which, count = np.unique(ranks[starts] * len(texts) + owner[starts], return_inverse=True, return_counts=True)
    twice = starts[count[which.reshape(-1)] > 1]
    edges = np.bincount(twice, minlength=n + 1) - np.bincount(twice + size, minlength=n + 1)
    return np.bincount(owner[np.cumsum(edges)[:n] > 0], minlength=len(texts))


def duplicate_lines(text: str) -> int:
    own = [x for x in text.split("\n") if x.strip(_WHITE)]
    return len(own) - len(set(own))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of any sums over 0."""
    p, q = p / p.sum(), q / q.sum()
    middle = np.where(p + q > 0, (p + q) / 2, 1)
    part = lambda x: (x * np.log2(np.where(x > 0, x / middle, 1))).sum()
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def too_far(d: float, n: int, bins: int, most: float, allowance: float) -> bool:
    return d * d > most * most + allowance * (bins - 1) / (8 * n * np.log(2))


def words_in_short(counts: Counter, most: int = SUMMARY) -> dict[bytes, int]:
    """At most `most` of the counts, each lowered by the same number, which is at most one in `most` of all."""
    if len(counts) <= most:
        return dict(counts)
    cut = sorted(counts.values(), reverse=True)[most]
    return {w: n - cut for w, n in counts.items() if n > cut}


class References:
    """Of each language: its class counts, and its common words with their counts and, last, those of all others."""

    def __init__(self, classes: dict[str, np.ndarray], words: dict[str, dict[bytes, int]], totals: dict[str, int]):
        self.languages = sorted(classes)
        self.number: dict[bytes, int] = {}
        for x in self.languages:
            for w in sorted(words[x]):
                self.number.setdefault(w, len(self.number))
        self.own = {x: (classes[x].astype(float), np.array([self.number[w] for w in sorted(words[x])], np.int64), np.array([*(words[x][w] for w in sorted(words[x])), totals[x] - sum(words[x].values())], float)) for x in self.languages}

    def distances(self, language: str, classes: np.ndarray, met: np.ndarray, n_words: int) -> tuple[float, float, bool]:
        """Of a text with these class counts, numbers of common words and n_words: both distances (0 where a guard holds) and whether it is near enough."""
        reference, numbers, counts = self.own[language]
        near, of_chars, of_words, n = True, 0.0, 0.0, int(classes.sum())
        if n >= LEAST_CHARS:
            of_chars = distance(classes.astype(float), reference)
            near = not too_far(of_chars, n, len(_NAMES), FAR_CHARS, ALLOWANCE_CHARS)
        if n_words >= LEAST_WORDS:
            own = np.bincount(met, minlength=len(self.number))[numbers] if len(numbers) else np.zeros(0)
            of_words = distance(np.append(own, n_words - own.sum()).astype(float), counts)
            near &= not too_far(of_words, n_words, len(counts), FAR_WORDS, ALLOWANCE_WORDS)
        return of_chars, of_words, near

    def verdict(self, language: str | None, classes: np.ndarray, met: np.ndarray, n_words: int) -> tuple[float | None, float | None, bool]:
        """By the document's language, else by the first that is near enough; the distances are those that decided (of none near: the least sum)."""
        if not self.languages:
            return None, None, True
        if language in self.own and (first := self.distances(language, classes, met, n_words))[2]:
            return first
        every = [self.distances(x, classes, met, n_words) for x in self.languages]
        return next((x for x in every if x[2]), None) or min(every, key=lambda x: x[0] + x[1])


def references(docs: DataFrame) -> References:
    """From columns text and lang: class counts and common words of each language, over all rows. At most LANGUAGES times 2 * COMMON words reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    kinds = "lang string, word binary, class int, n long"

    def rows(found: list[tuple]):
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["lang", "word", "class", "n"])

    def summed(batches):
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        totals: Counter = Counter()
        kept = 0
        for batch in in_slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                mine, found = words.setdefault(lang, Counter()), raw.lower().split()
                kept -= len(mine)
                mine.update(found)
                kept += len(mine)
                totals[lang] += len(found)
                classes[lang] = classes.get(lang, 0) + classes_of(raw)
            if kept > KEPT_WORDS:
                yield rows([(x, w, None, n) for x, c in words.items() for w, n in words_in_short(c).items()])
                words, kept = {}, 0
        yield rows([(x, w, None, n) for x, c in words.items() for w, n in words_in_short(c).items()])
        yield rows([(x, None, k, int(n)) for x, c in classes.items() for k, n in enumerate(c)] + [(x, None, -1, n) for x, n in totals.items()])

    sums = own.mapInArrow(summed, kinds).groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    sums = written(sums, "quality-sums")
    totals = sums.where("class = -1")
    least = (totals.agg(F.sum("n")).first()[0] or 0) / LANGUAGES
    totals = {r.lang: r.n for r in totals.where((F.col("n") >= LEAST_REFERENCE) & (F.col("n") >= least)).collect()}
    if not totals:
        return References({}, {}, {})
    of = F.broadcast(spark.createDataFrame(list(totals.items()), "lang string, total long"))
    classes = {x: np.zeros(len(_NAMES)) for x in totals}
    for r in sums.where("class >= 0").join(of, "lang").collect():
        classes[r.lang][r["class"]] = r.n
    # A word that is common has at least this much in the sums, so fewer than 2 * COMMON a language do.
    possible: dict[str, set] = {x: set() for x in totals}
    for r in sums.where("word IS NOT NULL").join(of, "lang").where(F.col("n") > F.col("total") * (1 / COMMON - 1 / SUMMARY) * 0.999).select("lang", "word").collect():
        possible[r.lang].add(bytes(r.word))
    shared = spark.sparkContext.broadcast(possible)

    def counted(batches):
        words = {x: Counter() for x in shared.value}
        for batch in in_slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if asked := shared.value.get(lang):
                    words[lang].update(w for w in text.encode().lower().split() if w in asked)
        yield rows([(x, w, None, n) for x, c in words.items() for w, n in c.items()])

    words: dict[str, dict[bytes, int]] = {x: {} for x in totals}
    for r in own.mapInArrow(counted, kinds).groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        if r.n * COMMON >= totals[r.lang]:
            words[r.lang][bytes(r.word)] = r.n
    return References(classes, words, totals)


def judged(docs: DataFrame, known: References) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance (null without a reference) and kept."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*MADE)
    names = docs.columns
    at, lang_at = names.index("text"), names.index("lang") if "lang" in names else None
    schema = StructType(docs.schema.fields[:])
    for name, kind in zip(MADE, ("long",) * 5 + ("boolean", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    shared, symbol, white = docs.sparkSession.sparkContext.broadcast(known), _NAMES.index("symbol"), [_NAMES.index(x) for x in ("blank", "newline")]

    def judge(batches):
        known = shared.value
        number = known.number.get
        for batch in in_slices(batches):
            texts = [x or "" for x in batch.column(at).cast(pa.string()).to_pylist()]
            langs = batch.column(lang_at).cast(pa.string()).to_pylist() if lang_at is not None else [None] * len(texts)
            raw = [x.encode() for x in texts]
            words = [x.split() for x in raw]
            repeated = repeated_words(words)
            rows = []
            for text, own, found, lang, again in zip(texts, raw, words, langs, repeated.tolist(), strict=True):
                n, classes = len(found), classes_of(own)
                failed = n < LEAST_N_WORDS or 100 * again > REPEATED_PERCENT * n
                met = np.array([k for w in own.lower().split() if (k := number(w)) is not None], np.int64)
                of_chars, of_words, near = known.verdict(lang, classes, met, n)
                rows.append((n, int(classes.sum() - classes[white].sum()), int(classes[symbol]), duplicate_lines(text), again, failed, of_chars, of_words, near and not failed))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(),) * 5 + (pa.bool_(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.record_batch([*batch.columns, *columns], names=[*names, *MADE])

    return docs.mapInArrow(judge, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs (text, lang and others) that keep both rules, against references made of docs themselves."""
    return judged(docs, references(docs)).where("kept").select(*docs.columns)


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    millionths = [F.round(F.col(x) * 1_000_000).cast("long").alias(f"{x}_e6") for x in ("char_distance", "word_distance")]
    return judged(spread(docs), references(spread(docs))).select("doc_id", *MADE[:6], *millionths, "kept")


_W = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SYMBOLS = " + ".join(f"n_{x}" for x in _NAMES)
_JS = "sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2))"
ORACLE = {
    "op11_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
c AS (SELECT r, doc_id, lang, {", ".join(f"length(regexp_replace(t, '[^{p}]', '', 'g')) AS n_{x}" for x, p in CLASSES.items())} FROM d),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_W}') GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM g2) GROUP BY r),
wd AS (SELECT r, {_LOWER} AS w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
lw AS (SELECT lang, wd.w, sum(n) AS n FROM wd JOIN d USING (r) WHERE lang IS NOT NULL GROUP BY lang, wd.w),
lt AS (SELECT lang, n AS total FROM (SELECT lang, n, sum(n) OVER () AS every FROM (SELECT lang, sum(n) AS n FROM lw GROUP BY lang)) WHERE n >= {LEAST_REFERENCE} AND n * {LANGUAGES} >= every),
com AS (SELECT lang, w, n, total FROM lw JOIN lt USING (lang) WHERE n * {COMMON} >= total),
ref AS (SELECT lang, w, n / total AS q FROM com UNION ALL SELECT lang, NULL, 1 - coalesce(sum(n), 0) / total FROM lt LEFT JOIN (SELECT lang, n FROM com) USING (lang) GROUP BY lang, total),
nw AS (SELECT r, len(w) AS n_words FROM d),
own AS (SELECT r, com.lang, wd.w, wd.n AS n FROM wd JOIN com ON com.w = wd.w),
rest AS (SELECT nw.r, lt.lang, CAST(NULL AS VARCHAR) AS w, n_words - coalesce(sum(own.n), 0) AS n FROM nw CROSS JOIN lt LEFT JOIN own ON own.r = nw.r AND own.lang = lt.lang GROUP BY nw.r, lt.lang, n_words),
pw AS (SELECT r, lang, w, n / n_words AS p FROM (SELECT * FROM own UNION ALL SELECT * FROM rest) JOIN nw USING (r) WHERE n_words >= {LEAST_WORDS}),
jw AS (SELECT r, lang, {_JS} AS of_words FROM (SELECT a.r, ref.lang, coalesce(p, 0) AS p, q FROM (SELECT r FROM nw WHERE n_words >= {LEAST_WORDS}) a CROSS JOIN ref LEFT JOIN pw ON pw.r = a.r AND pw.lang = ref.lang AND pw.w IS NOT DISTINCT FROM ref.w) GROUP BY r, lang),
cc AS (SELECT r, unnest([{", ".join(f"'{x}'" for x in _NAMES)}]) AS k, unnest([{", ".join(f"n_{x}" for x in _NAMES)}]) AS n, {_SYMBOLS} AS n_chars FROM c),
rc AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cc JOIN d USING (r) JOIN lt USING (lang) GROUP BY lang, k),
jc AS (SELECT r, lang, any_value(n_chars) AS n_chars, {_JS} AS of_chars FROM (SELECT cc.r, rc.lang, n_chars, n / n_chars AS p, q FROM cc JOIN rc USING (k) WHERE n_chars >= {LEAST_CHARS}) GROUP BY r, lang),
bins AS (SELECT lang, count(*) AS k FROM ref GROUP BY lang),
far AS (SELECT d.r, lt.lang, lt.lang = d.lang AS mine, coalesce(of_chars, 0) AS of_chars, coalesce(of_words, 0) AS of_words,
  NOT coalesce(of_chars * of_chars > {FAR_CHARS * FAR_CHARS} + {ALLOWANCE_CHARS} * {len(_NAMES) - 1} / (8 * n_chars * ln(2)), false) AND NOT coalesce(of_words * of_words > {FAR_WORDS * FAR_WORDS} + {ALLOWANCE_WORDS} * (k - 1) / (8 * n_words * ln(2)), false) AS near
  FROM d JOIN nw USING (r) CROSS JOIN lt JOIN bins ON bins.lang = lt.lang LEFT JOIN jw ON jw.r = d.r AND jw.lang = lt.lang LEFT JOIN jc ON jc.r = d.r AND jc.lang = lt.lang),
v AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY coalesce(mine, false) AND near DESC, near DESC, CASE WHEN near THEN 0 ELSE of_chars + of_words END, lang) AS place FROM far)
SELECT doc_id, n_words, CAST({_SYMBOLS} - n_blank - n_newline AS BIGINT) AS word_chars, CAST(n_symbol AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < {LEAST_N_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEATED_PERCENT} * n_words AS base_failed, CAST(round(of_chars * 1000000) AS BIGINT) AS char_distance_e6, CAST(round(of_words * 1000000) AS BIGINT) AS word_distance_e6,
  coalesce(near, true) AND NOT (n_words < {LEAST_N_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEATED_PERCENT} * n_words) AS kept
FROM c JOIN nw USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r) LEFT JOIN v ON v.r = c.r AND v.place = 1
"""
}
QUERIES = {"op11_quality_rules": op11_quality_rules}

"""Language identification by unigrams over pieces, summed over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary. A word's
probability in a language is the sum, over every way to cut it into pieces, of the product of
their probabilities; a forward pass over the word's positions gives that sum without listing the cuts. A
text's score adds its words' logarithms, and the softmax over languages is the score returned.

Training takes about sample_docs distinct rows of each language (those whose hash falls below the share that this is of the
language's rows; all of them where there are fewer), for which piece probabilities are re-estimated by expectation maximisation: each
step runs on Spark over word counts and sends back one number per language and piece. Prediction
reads whole texts and nothing but texts.

A text that is null or has no letter gets `und` and score 0; so does every text where nothing
could be learned. Ties go to the language that sorts first. Rows with null or no letters, null language or null doc_id
teach nothing. Rows that repeat are predicted as often as they come, and teach once. Texts and words may be of any length; long words are rescaled
as they are summed. Other columns stay; columns named like a result are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, public_vocabulary, small_batches, spread, table, written

#: The training sample: about so many rows of each language.
SAMPLE_DOCS = 400
STEPS = 2
SMOOTHING = 0.05
#: A letter that no piece covers, in any language.
UNKNOWN = 1e-7
WORDS = r"\p{L}+"
#: Longer words are summed with rescaling, in logarithms where counts are expected; products of so many chances can't vanish.
PLAIN = 40


class Pieces(dict):
    """Every beginning of a piece, with the piece's number or -1. count: the number of pieces; longest: letters of the longest.

    The same as a tree in arrays, for many words at once: edges (a state and a letter, sorted), where each leads, and each state's piece or -1.
    """

    def __init__(self, pieces):
        super().__init__()
        self.count = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        for n, piece in enumerate(pieces):
            for k in range(1, len(piece)):
                self.setdefault(piece[:k], -1)
            self[piece] = n
        states = {"": 0} | {x: i for i, x in enumerate(self, 1)}
        keys = np.array([(states[x[:-1]] << 21) + ord(x[-1]) for x in self] or [-1], np.int64)
        order = np.argsort(keys)
        self.edges, self.targets = keys[order], (order + 1)
        self.pieces = np.array([-1, *self.values()], np.int64)

    def steps(self, states: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have an edge of the letter, and where those lead."""
        keys = (states << 21) + letters
        at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
        there = self.edges[at] == keys
        return there, self.targets[at[there]]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """The vocabulary's pieces of lower-case letters, word starts marked by ▁, numbered."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return Pieces(list(dict.fromkeys(x for x in own if x.lstrip("▁").isalpha() and x == x.lower())))


def spans(word: str, pieces: Pieces) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every piece in ▁word by start; -1 for a letter that is no piece."""
    marked, get, out = "▁" + word, pieces.get, []
    n = len(marked)
    for i in range(n):
        piece = get(marked[i], -1)
        out.append((i, i + 1, piece))
        for j in range(i + 2, n + 1):
            if (piece := get(marked[i:j])) is None:
                break
            if piece >= 0:
                out.append((i, j, piece))
    return out


def forward(word: str, pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Log probability of the word in each language; chances: a row per piece, the last for unknown letters. Long words are rescaled as they go."""
    n, near = len(word) + 1, pieces.longest
    sums, scale = np.zeros((n + 1, chances.shape[1])), np.zeros(chances.shape[1])
    sums[0] = 1
    for i, j, piece in spans(word, pieces):
        if i and j == i + 1 and i % 16 == 0:  # all that ends at i or before is summed
            top = sums[i : i + near].max(axis=0)
            sums[i : i + near] /= top
            scale += np.log(top)
        sums[j] += sums[i] * chances[piece]
    return np.log(sums[n]) + scale


def forward_many(words: list[str], pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """forward() for words of one length, PLAIN at most, position by position for all at once."""
    n, many = len(words[0]) + 1, len(words)
    letters = np.frombuffer(("▁" + "▁".join(words)).encode("utf-32-le"), np.uint32).reshape(many, n).T.astype(np.int64)
    sums = np.zeros((n + 1, many, chances.shape[1]))
    sums[0] = 1
    for i in range(n):
        alive, states = np.arange(many), np.zeros(many, np.int64)
        for j in range(i + 1, min(n, i + pieces.longest) + 1):
            there, states = pieces.steps(states, letters[j - 1, alive])
            alive, own = alive[there], pieces.pieces[states]
            if j == i + 1:  # every letter counts, known or not
                one = np.full(many, -1)
                one[alive] = own
                sums[j] += sums[i] * chances[one]
            else:
                ends = own >= 0
                sums[j, alive[ends]] += sums[i, alive[ends]] * chances[own[ends]]
            if not len(alive):
                break
    return np.log(sums[n])


def expected_counts(word: str, pieces: Pieces, chances: list[float]) -> dict[int, float]:
    """How often each piece is used over all segmentations of the word, each by its probability, in one language."""
    own, n = spans(word, pieces), len(word) + 1
    out: dict[int, float] = {}
    if n > PLAIN:
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)
        logs, ahead, behind = [math.log(chances[p]) for _, _, p in own], [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for (i, j, _), x in zip(own, logs, strict=True):
            ahead[j] = add(ahead[j], ahead[i] + x)
        for (i, j, _), x in zip(reversed(own), reversed(logs), strict=True):
            behind[i] = add(behind[i], behind[j] + x)
        for (i, j, p), x in zip(own, logs, strict=True):
            if p >= 0:
                out[p] = out.get(p, 0.0) + math.exp(ahead[i] + x + behind[j] - ahead[n])
        return out
    ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, p in own:
        ahead[j] += ahead[i] * chances[p]
    for i, j, p in reversed(own):
        behind[i] += behind[j] * chances[p]
    for i, j, p in own:
        if p >= 0:
            out[p] = out.get(p, 0.0) + ahead[i] * chances[p] * behind[j] / ahead[n]
    return out


class LanguageModel:
    """languages, sorted, and the chances of each piece (a row; the last row: an unknown letter) in each."""

    def __init__(self, languages: list[str], chances: np.ndarray, vocabulary: str):
        self.languages, self.chances, self.vocabulary = languages, chances, vocabulary


def train(labelled: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> LanguageModel:
    """Learns from columns doc_id, text, lang. What reaches the driver is bounded by languages times pieces."""
    spark, vocabulary = labelled.sparkSession, vocabulary or public_vocabulary("piece_bpe_32k.model")
    pieces = pieces_of(vocabulary)
    usable = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    # A row is taken or left by its own hash, so no language meets in one place; rows that repeat become one before the shuffle. A row a language is broadcast: far less than the model.
    share = usable.groupBy("lang").agg((sample_docs / F.count("*")).alias("share"))
    taken = usable.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.col("share") * (1 << 32))
    sample = taken.groupBy("lang", "doc_id", F.xxhash64("text").alias("print")).agg(F.min("text").alias("text"))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORDS})"))).alias("word"))
    counts = written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    chances = np.full((pieces.count + 1, len(languages)), 1.0 / max(1, pieces.count))
    chances[-1] = UNKNOWN
    for _ in range(steps):
        now = spark.sparkContext.broadcast({x: chances[:, i].tolist() for i, x in enumerate(languages)})

        def expect(batches, now=now):
            own, sums = pieces_of(vocabulary), Counter()
            for batch in in_slices(batches):
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for piece, part in expected_counts(word, own, now.value[lang]).items():
                        sums[lang, piece] += n * part
            yield pa.record_batch([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array(sums.values(), pa.float64())], names=["lang", "piece", "n"])

        sums = counts.mapInArrow(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        new = np.full((pieces.count, len(languages)), SMOOTHING)
        for lang, piece, n in sums.collect():
            new[piece, languages.index(lang)] += n
        chances = np.concatenate([new / np.maximum(new.sum(axis=0), 1e-300), np.full((1, len(languages)), UNKNOWN)])
    return LanguageModel(languages, chances, vocabulary)


class WordScores:
    """The log probability of words in each language, remembered within a task."""

    LIMIT = 100_000

    def __init__(self, model: LanguageModel):
        self.pieces, self.chances = pieces_of(model.vocabulary), model.chances
        self.at: dict[str, int] = {}
        self.rows = np.empty((0, len(model.languages)))

    def learn(self, words: list[str]) -> None:
        """Makes all these words, none twice, known; if there are too many, those that are not among them go."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if w not in self.at:
                by_length.setdefault(len(w), []).append(w)
        new = [w for own in by_length.values() for w in own]
        if len(self.at) + len(new) > self.LIMIT:
            kept = [w for w in words if w in self.at]
            self.rows, self.at = self.rows[[self.at[w] for w in kept]], {w: i for i, w in enumerate(kept)}
        self.at.update((w, len(self.rows) + i) for i, w in enumerate(new))
        parts = [forward_many(own, self.pieces, self.chances) if n < PLAIN else np.array([forward(w, self.pieces, self.chances) for w in own]) for n, own in by_length.items()]
        self.rows = np.concatenate([self.rows, *parts])

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """The sum of the words' log probabilities of each text that has words, in order."""
        flat = pa.array(chain.from_iterable(texts), pa.large_string()).dictionary_encode()
        names = flat.dictionary.to_pylist()
        self.learn(names)
        each = self.rows[np.fromiter((self.at[w] for w in names), np.int64, len(names))]
        lengths = np.fromiter((len(x) for x in texts if x), np.int64)
        return np.add.reduceat(each[flat.indices.to_numpy()], np.cumsum(lengths) - lengths) if len(lengths) else np.empty((0, each.shape[1]))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score; all other columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in docs.schema]
    at = names.index("text")
    keep = [f for f in docs.schema if f.name not in ("lang_pred", "score")]
    schema = docs.select(*(f.name for f in keep)).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def predict(batches):
        import regex

        model, words_of = shared.value, regex.compile(WORDS)
        scores, none = WordScores(model), not model.languages
        for batch in in_slices(batches):
            texts = [[] if none or not x else words_of.findall(x.lower()) for x in batch.column(at).to_pylist()]
            totals = scores.of(texts)
            tops = totals.argmax(axis=1) if len(totals) else []
            odds = 1.0 / np.exp(np.clip(totals - totals.max(axis=1, keepdims=True), -700, 0)).sum(axis=1) if len(totals) else []
            told = zip(tops, odds, strict=True)
            rows = [next(told) if x else (-1, 0.0) for x in texts]
            languages, best = ["und" if t < 0 else model.languages[t] for t, _ in rows], [float(x) for _, x in rows]
            columns = [c for c, name in zip(batch.columns, names, strict=True) if name not in ("lang_pred", "score")]
            yield pa.record_batch([*columns, pa.array(languages, pa.string()), pa.array(best, pa.float64())], names=[*(f.name for f in keep), "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def held_out(doc_id: str = "doc_id"):
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows whose text has a language of score `least` or more."""
    return identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*docs.columns)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(spread(docs.select("doc_id", "text")), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE: dict[str, str] = {}

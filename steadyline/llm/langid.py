"""Language identification by unigrams summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a text is the product of its words' probabilities, and that
of a word the sum over all ways to spell it in pieces. Training counts words
per language in Spark, spreads each distinct word over its segmentations once,
and sums the expected uses of the pieces; what the driver gets is a table of
languages x vocabulary, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, release
from .lattice import START, pieces, smoothed

UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Words whose scores a worker remembers; the memory is emptied when it is full.
REMEMBERED = 300_000
#: Strength of the prior, in uses of a piece: the vocabulary's own for the mean of the languages, that mean for each language.
STRENGTH = 200.0
MAX_LANGUAGES = 2000


class Numbers(dict):
    """Words by number, in order of their first look-up: one look-up finds a word or makes it `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def _words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def word_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, word, n): counted in each batch of a task first, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[lang].update(_words(text))
            for lang, words in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["lang", "word", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocab: str, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages in order, log probabilities of languages x pieces). Rows with a null language or text teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocab)
        start = np.log(np.maximum(own.prior, 1e-300))[:, None]
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            words = [START + w for w in batch.column(1).to_pylist()]
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                total[lang] = total.get(lang, 0) + own.expected([words[i] for i in at], n[at], start)
        for lang, uses in total.items():
            used = np.flatnonzero(uses > 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(uses[used])], ["lang", "piece", "uses"])
        release()

    uses = word_counts(docs, lang_col, text_col).mapInArrow(run, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
    rows = uses.orderBy("lang", "piece").toArrow()  # languages x vocabulary at most
    langs = sorted(set(rows["lang"].to_pylist()))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; a model of over {MAX_LANGUAGES} is not broadcast")
    own = pieces(vocab)
    expected = np.zeros((len(langs), own.size))
    if langs:
        expected[np.searchsorted(np.array(langs), np.array(rows["lang"].to_pylist())), rows["piece"].to_numpy()] = rows["uses"].to_numpy()
        share = expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-300)
        common = np.exp(smoothed(share.mean(axis=0) * STRENGTH, own.prior, 1.0))
        expected = np.stack([smoothed(x, common, STRENGTH) for x in expected])
    return langs, np.maximum(expected, -700.0)


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab: str, text_col: str = "text", into: str = "language") -> DataFrame:
    """All columns of `docs`, and `into`: a struct (lang, score).

    lang: the most probable language, of equal ones the first in order; `und`
    with the score 0 if the text is null or has no letter, or if no language was
    learned. score: the language's posterior probability when all are as likely
    beforehand. An input column named `into` is replaced.
    """
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))  # languages x vocabulary
    kept = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs = pieces(vocab), shared.value
        seen = Numbers()
        scores = np.zeros((0, len(langs)))
        for batch in in_pieces(batches):
            found, sure = [], []
            texts = batch.column(0).field(text_col)
            for first in range(0, len(texts), 256):
                some = [_words(t.as_py() or "") for t in texts[first : first + 256]]
                if len(seen) > REMEMBERED:
                    seen, scores = Numbers(), scores[:0]
                places = [np.fromiter(map(seen.__getitem__, words), np.int64, len(words)) for words in some] if langs else []
                if new := seen.new:
                    values = own.forward([START + w for w in new], logs)
                    if len(seen) > len(scores):  # room for as many again
                        scores = np.concatenate([scores, np.zeros((len(seen), len(langs)))])
                    scores[len(seen) - len(new) : len(seen)] = values
                    seen.new = []
                for at, words in enumerate(some):
                    if not langs or not any(c.isalpha() for w in words for c in w):
                        found.append(UNDETERMINED)
                        sure.append(0.0)
                        continue
                    total = scores[places[at]].sum(axis=0)
                    best = int(total.argmax())
                    found.append(langs[best])
                    sure.append(float(1 / np.exp(total - total[best]).sum()))
            language = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(sure, pa.float64())], ["lang", "score"])
            yield pa.RecordBatch.from_arrays([batch.column(0), language], ["row", "language"])
        del seen, scores
        release()

    rows = docs.select(F.struct(*kept).alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {row_type}, language struct<lang:string,score:double>")
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("language").alias(into))

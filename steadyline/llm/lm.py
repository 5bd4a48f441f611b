"""Scores of texts under a subword unigram model, summed over all segmentations.

The pieces and their first scores come from an existing vocabulary; one pass of
expectation-maximisation over the corpus's distinct words weights them anew.
Word counts, and the words' probabilities, are too many for a broadcast, so the
texts are packed in chunks with a vocabulary of their own. Each distinct word
of a chunk meets its count and probability in a join, once per chunk and not
once per occurrence, and the chunk's documents are then scored beside it.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, written
from .lattice import START, pieces, smoothed

#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK_BYTES = 16_000_000
STRENGTH = 1000.0
LN10 = np.log(10.0)

PACKED = "chunk long, ids array<long>, held array<boolean>, sizes binary, tokens binary, rare binary, words string, train array<int>"
#: Token numbers from here on are kept apart.
WIDE = 0xFFFF


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, serial = TaskContext.get().partitionId(), count()
    ids, learns, sizes = [], [], []
    number, tokens, text_bytes = defaultdict(count().__next__), array("i"), 0

    def chunk() -> pa.RecordBatch:
        learn = np.repeat(np.array(learns, bool), sizes)
        numbers = np.frombuffer(tokens, np.int32) if len(tokens) else np.zeros(0, np.int32)
        # Frequent words get small numbers, and most tokens fit in two bytes.
        order = np.argsort(-np.bincount(numbers, minlength=len(number)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        numbers = place[numbers]
        names = list(number)
        row = [
            pa.array([(task << 32) + next(serial)]),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([[not x for x in learns]], pa.list_(pa.bool_())),
            *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(sizes, np.int64), np.minimum(numbers, WIDE).astype(np.uint16), numbers[numbers >= WIDE])),
            pa.array([b"\n".join([names[i] for i in order.tolist()]).decode()]),  # words hold no line ends
            pa.array([np.bincount(numbers[learn], minlength=len(number)).astype(np.int32)], pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(row, ["chunk", "ids", "held", "sizes", "tokens", "rare", "words", "train"])

    for batch in batches:
        for id_, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            if ids and text_bytes + len(text) > CHUNK_BYTES:
                yield chunk()
                ids, learns, sizes = [], [], []
                number, tokens, text_bytes = defaultdict(count().__next__), array("i"), 0
            before = len(tokens)
            tokens.extend(map(number.__getitem__, text.lower().split()))
            ids.append(id_)
            learns.append(not held)
            sizes.append(len(tokens) - before)
            text_bytes += len(text)
    if ids:
        yield chunk()
    del number, tokens
    release()


def _expected(vocab: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocab)
        start, total = np.log(np.maximum(own.prior, 1e-300))[:, None], np.zeros(own.size)
        for batch in batches:
            total += own.expected([START + w for w in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False).astype(float), start)
        used = np.flatnonzero(total > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "uses"])
        release()

    return run


def _scored(vocab: str, logs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocab)
        for batch in batches:
            values = own.forward([START + w for w in batch.column(0).to_pylist()], logs.value[:, None])[:, 0] / LN10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], ["word", "seen", "log"])
        release()

    return run


def scored(docs: DataFrame, held_out: Column, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between ASCII blanks, A-Z lower-cased, and one end of
    the text. base_score: log10 probability under add-one word counts. score:
    log10 probability under the subword model. Rows for which `held_out` is true
    teach neither; null counts as false. A null or empty text is an end alone.
    Ids are integers, as Spark casts them, or null; other columns, whatever
    their names, are not read. An empty table gives no rows. Rows that repeat are scored alike and count each
    time. With no row to learn from, the words' counts are zero and the subword
    model has the vocabulary's own scores.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    packed = written(rows.mapInArrow(_pack, PACKED), "lm-chunks")
    entries = packed.filter("words != ''").select("chunk", F.posexplode(F.arrays_zip(F.split("words", "\n").alias("word"), "train")).alias("at", "entry")).select("chunk", "at", "entry.word", "entry.train")
    table = written(entries.groupBy("word").agg(F.sum("train").alias("seen")), "lm-words")
    sums = table.agg(F.sum("seen"), F.count_if(F.col("seen") > 0)).first()
    ends = packed.select(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    n_train, distinct = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)

    learned = table.filter("seen > 0").select("word", "seen").mapInArrow(_expected(vocab), "piece int, uses double")
    found = learned.groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()  # a row per piece of the vocabulary at most
    own = pieces(vocab)
    expected = np.zeros(own.size)
    expected[found["piece"].to_numpy()] = found["uses"].to_numpy()
    end_log = np.log10((ends + 1) / (expected.sum() + STRENGTH + ends + 1))
    logs = docs.sparkSession.sparkContext.broadcast(np.maximum(smoothed(expected, own.prior, STRENGTH, ends + 1), -700.0))

    values = table.mapInArrow(_scored(vocab, logs), "word string, seen long, log double")
    known = entries.select("chunk", "at", "word").join(values, "word").select(F.col("chunk").alias("own"), "at", "seen", "log")

    def score(packed: pa.Table, known: pa.Table) -> pa.Table:
        out = {k: [] for k in ("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        at = known["at"].to_numpy()
        seen, log = np.zeros(len(at), np.int64), np.zeros(len(at))
        seen[at], log[at] = known["seen"].to_numpy(), known["log"].to_numpy()
        base = np.log10((seen + 1) / (n_train + distinct + 1))
        end_base = np.log10((ends + 1) / (n_train + distinct + 1))
        for row in packed.select(["ids", "held", "sizes", "tokens", "rare"]).to_pylist():
            tokens = np.frombuffer(row["tokens"], np.uint16).astype(np.int32)
            tokens[tokens == WIDE] = np.frombuffer(row["rare"], np.int32)
            sizes = np.frombuffer(row["sizes"], np.int64)
            filled = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[filled]

            def sums(x, starts=starts, filled=filled, tokens=tokens):
                each = np.zeros(len(filled), x.dtype)
                if len(starts):
                    each[filled] = np.add.reduceat(x[tokens], starts)
                return each

            out["id"] += row["ids"]
            out["held_out"] += row["held"]
            out["n_tokens"] += (sizes + 1).tolist()
            out["n_known"] += (sums((seen > 0).astype(np.int64)) + (ends > 0)).tolist()
            out["train_tokens"] += [n_train] * len(sizes)
            out["base_score"] += (sums(base) + end_base).tolist()
            out["score"] += (sums(log) + end_log).tolist()
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    texts = packed.select("chunk", "ids", "held", "sizes", "tokens", "rare")
    result = texts.groupBy("chunk").cogroup(known.groupBy("own")).applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return result.withColumnRenamed("id", id_col)

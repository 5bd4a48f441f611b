"""A corpus through language ID, line dedup, near-duplicate removal, decontamination and encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyline.llm import bpe, decontaminate, langid, simhash
from steadyline.llm.common import table, unused, written
from steadyline.llm.line_dedup import dedup_lines

BPE_VOCAB = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCAB = public_tokenizers.path("piece_bpe_32k.model")
#: Posterior of the predicted language under which a document goes.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told, or only with a posterior under SURE, go: null and empty texts among them.

    Models are learned from all rows with a language. Repeated rows and null ids
    fare as their texts do; other columns stay as they are, whatever their names.
    """
    model, told = langid.train(docs, PIECE_VOCAB), unused(docs, "language")
    out = langid.identified(docs, model, PIECE_VOCAB, into=told)
    return out.filter((F.col(told)["lang"] != langid.UNDETERMINED) & (F.col(told)["score"] >= SURE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents hold go; a document that loses all of them goes too, one that had no text stays as it is.

    `n_chars` follows the text. Repeated rows are one document; other columns
    stay as they are, whatever their names.
    """
    lines = unused(docs, "lines")
    cut = dedup_lines(docs, min_docs=10, into=lines)
    shorter, kept = F.col(lines)["n_dropped"] > 0, F.col(lines)["kept"]
    new = {"text": F.when(shorter, kept).otherwise(F.col("text")), "n_chars": F.when(shorter, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return cut.filter(~(shorter & (F.length(kept) == 0))).withColumns(new).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id.

    Texts without words, null ones too, are copies of each other; rows with a
    null id all stay, and rows of one id stay or go together. Other columns stay
    as they are, whatever their names.
    """
    return simhash.drop_near_copies(docs, simhash.similarity_plan()).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; null ids and null or empty texts stay.

    Rows of one id go together. Other columns stay as they are, whatever their names.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, as little-endian unsigned 32-bit integers, their number, and the SHA-256 of the text that they decode to.

    A null or empty text has no ids. Where an input column is called `n_tokens`,
    `ids` or `decoded_sha256`, it stays, and the new one has an underscore more.
    """
    tokens = unused(docs, "tokens")
    out = bpe.tokenized(docs, BPE_VOCAB, into=tokens)
    return out.select(*docs.columns, *(F.col(tokens)[c].alias(unused(docs, c)) for c in ("n_tokens", "ids", "decoded_sha256")))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding", encoding),
]

#: Language models, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

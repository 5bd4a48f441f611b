"""How far the sources of a language lie apart in their use of terms.

A task lays the texts of a shard end to end in one buffer and keeps a pointer to
the start of each term. Pointers are sorted by the suffix that they begin, cut
at the term's end: eight bytes at a time, and only those that are still equal
by the next eight (multikey quicksort with characters of eight bytes). Runs of
equal terms then give, by language and source, how often and in how many
documents a term occurs. These counts meet in Spark, where each document has
been counted in one task only.

Probabilities are whole numbers of thousand millionths and exact. Sources are
compared by slices of the vocabulary: a slice is a matrix of sources and terms
in a task, and gives a row for each two sources. Terms that a source lacks have
one probability in it, so they are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, sized, written

#: Bytes of text that are sorted together; a longer text is cut between terms.
SHARD_BYTES = 5_000_000
SCALE = 1_000_000_000
#: Terms of a slice, and sources of a block, that are compared at once.
SLICE, BLOCK = 256, 256
#: Bytes of terms that are sorted as numbers.
DEPTH = 64

_byte = np.arange(256)
IN_TERM = (_byte >= 128) | (_byte >= 65) & (_byte <= 90) | (_byte >= 97) & (_byte <= 122)
FOLDED = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Masks of the first 0 to 8 bytes of a big-endian word.
FIRST = np.array([(0xFFFFFFFFFFFFFFFF << (8 * (8 - k))) & 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)


def sorted_pointers(b: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): pointers in the order of their terms, equal terms in that of the buffer, and whether each is the first of its run.

    Zeros stand after a term's end, and no term holds one, so that of two terms
    the shorter comes first. What is still equal at DEPTH bytes is compared as a
    whole.
    """
    padded = np.r_[b, np.zeros(8, np.uint8)]
    words = np.zeros(len(b) + 1, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * (7 - k))
    key = words[start] & FIRST[np.minimum(length, 8)]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]][: len(key)]
    depth, active = 8, np.arange(len(order))
    run = np.cumsum(first) - 1
    while True:
        # Only runs of several pointers go on, if one of their terms is longer.
        longer = np.bincount(run, weights=length[order[active]] > depth)[run] > 0 if len(run) else np.zeros(0, bool)
        more = longer & (np.bincount(run)[run] > 1) if len(run) else longer
        active, run = active[more], run[more]
        if not len(active):
            return order, first
        here = order[active]
        if depth >= DEPTH:
            raw = [b[s : s + n].tobytes() for s, n in zip(start[here].tolist(), length[here].tolist(), strict=True)]
            rank = {t: k for k, t in enumerate(sorted(set(raw)))}
            key, depth = np.array([rank[t] for t in raw], np.uint64), int(length[here].max())
        else:
            rest = np.maximum(length[here] - depth, 0)
            key = words[np.minimum(start[here] + depth, len(b))] & FIRST[np.minimum(rest, 8)]
            depth += 8
        again = np.lexsort((key, run))
        order[active], key, run = here[again], key[again], run[again]
        first[active] = fresh = np.r_[True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])]
        run = np.cumsum(fresh) - 1


def _runs(b: np.ndarray, doc: np.ndarray, group: np.ndarray, groups: int, start: np.ndarray, length: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of the pointers. doc and group are those of each pointer, in order of doc."""
    order, first = sorted_pointers(b, start, length)
    term = np.cumsum(first) - 1
    key = term * groups + group[order]
    again = np.argsort(key, kind="stable")  # documents stay in order within a term and a group
    key, own = key[again], doc[order][again]
    edge = np.r_[True, key[1:] != key[:-1]][: len(key)]
    fresh = edge | np.r_[True, own[1:] != own[:-1]][: len(key)]
    at = np.flatnonzero(edge)
    heads = order[first]
    raw = b.tobytes()
    names = [raw[s : s + n].decode() for s, n in zip(start[heads].tolist(), length[heads].tolist(), strict=True)]
    which = key[at]
    return [names[t] for t in (which // groups).tolist()], which % groups, np.diff(np.r_[at, len(key)]), np.add.reduceat(fresh.astype(np.int64), at) if len(at) else at


def _shard(texts: list[bytes], group: list[int], groups: int):
    b = FOLDED[np.frombuffer(b"\n".join(texts), np.uint8)]
    edge = np.diff(np.r_[False, IN_TERM[b], False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return _runs(b, doc, np.array(group, np.int64)[doc], groups, start, end - start)


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """A text of any length in parts of about `most` bytes, cut between terms."""
    b, at = np.frombuffer(text, np.uint8), 0
    while at < len(b):
        end = min(len(b), at + most)
        while end < len(b) and IN_TERM[b[end]]:
            end += 1
        yield text[at:end]
        at = end


def _counted(most: int):
    """(lang, source, text) -> runs of shards of about `most` bytes."""

    def batch_of(term, which, n, docs, known) -> pa.RecordBatch:
        lang, source = ([known[g][k] for g in which.tolist()] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        texts: list[bytes] = []
        group: list[int] = []
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                text = text.as_py()
                if len(text) > most:  # alone, in parts; a term counts a document once
                    seen: set[str] = set()
                    for part in _parts(text, most):
                        term, which, n, _ = _shard([part], [0], 1)
                        yield batch_of(term, which, n, np.array([t not in seen for t in term], np.int64), [(lang, source)])
                        seen.update(term)
                    continue
                if texts and size + len(text) > most:
                    yield batch_of(*_shard(texts, group, len(names)), list(names))
                    names, texts, group, size = {}, [], [], 0
                texts.append(text)
                group.append(names.setdefault((lang, source), len(names)))
                size += len(text)
        if texts:
            yield batch_of(*_shard(texts, group, len(names)), list(names))
        release()

    return run


def term_counts(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs: (lang, source, text) without nulls, a row per document. (lang, source, term, n, docs): occurrences and documents of each term in each shard, to be summed."""
    return docs.mapInArrow(_counted(shard_bytes), "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total) for whole numbers, count under total: three digits at a time, so that nothing overflows under a total of 9 * 10^15."""
    whole, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        whole = whole * 1000 + F.call_function("div", rest * 1000, total)
        rest = rest * 1000 % total
    return whole + 1


def _distances(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a cell: sources (term null, p of a term that they lack) and their terms. Sums of abs(p - q) for each two sources of the cell's blocks."""
    sources = rows[rows.term.isna()].sort_values("source")
    names, side = sources.source.tolist(), sources.side.to_numpy()
    terms = rows[rows.term.notna()]
    place, known = pd.factorize(terms.term)
    m = np.repeat(sources.p.to_numpy(np.int64)[:, None], len(known), axis=1)
    m[pd.Series(range(len(names)), index=names)[terms.source].to_numpy(), place] = terms.p.to_numpy(np.int64)
    out = []
    for at, name in enumerate(names):
        # Between two blocks, only sources of the one and the other; within one, all.
        others = np.arange(at + 1, len(names))
        others = others[side[others] != side[at]] if key[2] != key[3] else others
        sums = np.abs(m[others] - m[at]).sum(axis=1)
        out += [(key[0], x, y, s) for o, s in zip(others.tolist(), sums.tolist(), strict=True) for x, y in ((name, names[o]), (names[o], name))]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def source_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """counts: (lang, source, term, p). groups: (lang, source, z, terms, sources): p of a term that the source lacks, and the language's numbers. (lang, source, item, value) for each two sources of a language."""
    number = lambda c, of: F.pmod(F.xxhash64(c), of)
    plan = groups.select("lang", F.greatest(F.lit(1), F.ceil(F.col("terms") / SLICE)).alias("slices"), F.ceil(F.col("sources") / BLOCK).alias("blocks")).distinct()
    plan = F.broadcast(plan)  # a row per language
    own = counts.join(plan, "lang").select("lang", "source", "term", "p", number("term", F.col("slices")).alias("slice"), number("source", F.col("blocks")).alias("side"), "blocks")
    lacks = groups.join(plan, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    lacks = lacks.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("z").alias("p"), "slice", number("source", F.col("blocks")).alias("side"), "blocks")
    dealt = own.union(lacks).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = dealt.select("lang", "slice", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "source", "term", "p", "side")
    found = cells.groupBy("lang", "slice", "i", "j").applyInPandas(_distances, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, min_docs: int = 30, smoothing: int = 5, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Terms are runs of letters of ASCII, A-Z lower-cased, and of characters
    beyond ASCII. A language keeps the V terms that `min_docs` of its documents
    hold. Of a source, or a language, p of a kept term is
    1 + floor(10^9 (count + smoothing) / (N + smoothing V)), N its count of kept
    terms. Part `pair`: each other source of the language, and the sum of
    abs(p - q) over all kept terms. Part `term`: the `top` kept terms with
    p > q, q that of the language, that occur in the source, by p - q. Ranks go
    by value, highest first, and then by item.

    Null text, language and source are empty strings; a source without a term
    is a source like any other, and is uniform. Each row is a document, repeated
    rows too. Other columns, whatever their names, are not read. An empty table
    gives no rows; a language with one source has no pairs.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    shards = written(term_counts(rows, shard_bytes), "shard-terms")
    kept = shards.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = written(kept.drop("docs"), "kept-terms")
    counts = shards.join(sized(kept, F.octet_length("term") + 24), ["lang", "term"]).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.first("n_lang").alias("n_lang"))
    counts = written(counts, "source-terms")

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("all_lang"))
    every = rows.select("lang", "source").distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("all_source"))
    groups = every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["all_source", "terms", "all_lang"])
    groups = groups.join(F.broadcast(every.groupBy("lang").agg(F.count("*").alias("sources"))), "lang")  # a row per language
    own, whole = F.col("all_source") + smoothing * F.col("terms"), F.col("all_lang") + smoothing * F.col("terms")
    groups = written(groups.withColumn("z", F.when(F.col("terms") > 0, share(F.lit(smoothing).cast("long"), own)).otherwise(0)), "source-sums")

    known = counts.join(sized(groups, F.octet_length("source") + 64), ["lang", "source"])
    known = known.select("lang", "source", "term", share(F.col("n") + smoothing, own).alias("p"), share(F.col("n_lang") + smoothing, whole).alias("q"))
    pairs = source_distances(known.drop("q"), groups.select("lang", "source", "z", "terms", "sources")).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = pairs.select("lang", "source", "part", "item", "value", rank)
    more = known.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = more.select("*", rank).filter(F.col("rank") <= top)
    return pairs.union(terms)

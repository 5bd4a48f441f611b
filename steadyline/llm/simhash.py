"""SimHash near-duplicates, compared on vertical bit planes.

Each text gets a fingerprint of majority bits over the hashes of its word
shingles. Only distinct fingerprints are compared, and only where they agree
on one of several keys (choices of bits); within a key the bit-sliced
comparison of `bitslice` finds what lies within the radius. Each key's group
reports a forest, not its pairs, and components are joined up in Spark. Groups
over `split` fingerprints are cut into chunks, and every pair of chunks is a
group of its own in some task, so no group grows without bound.

Where a similarity is asked for, shingles count once, and every link is held
against the texts' shingle sets. The whole corpus is compared once; its forests
name every document that has a neighbour, and their close pairs are tried
first. Only these documents are compared again, with longer fingerprints that
narrow the doubtful range, and all pairs of different components are tried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import distance, link_runs, link_runs_twice, pairs_across
from .common import forget, in_pieces, release, sized, written
from .components import components

#: Bytes of hash bits that are summed at once; bounds memory for texts of any length.
PIECE_BYTES = 1 << 19
#: Rows that a task compares at once, beside the rest of the last group.
ROWS_AT_ONCE = 100_000
#: 64-bit words of the fingerprint that all documents are compared by under a similarity, and of the longer one beside it.
SHORT, LONG = 4, 32
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Plan:
    """words: in a shingle. radius: differing bits allowed, of 64 without a similarity and of 256 with one.

    keys: the bit positions that two fingerprints must share to be compared.
    With a `similarity`, fingerprints are of shingle sets, and pairs up to the
    radius, and up to `long_radius` in the longer fingerprints, link if these
    sets' Jaccard similarity reaches it; pairs up to `likely` bits come first.
    Its keys are drawn when the number of fingerprints is known: as many bits as
    leave about `group` unrelated fingerprints to a key's value, but `least_bits`
    at least, and as many keys as miss a pair of similarity 0.8 with a chance of
    `miss`.
    """

    words: int
    radius: int
    keys: tuple[tuple[int, ...], ...] = ()
    split: int = 20_000
    similarity: float | None = None
    likely: int = 0
    long_radius: int = 0
    group: int = 64
    least_bits: int = 12
    miss: float = 0.01

    @property
    def longs(self) -> int:
        return 1 if self.similarity is None else SHORT

    def drawn(self, n: int) -> tuple[tuple[int, ...], ...]:
        """The keys for n fingerprints."""
        if self.keys:
            return self.keys
        bits = max(self.least_bits, math.ceil(math.log2(max(1, n) / self.group)))
        shared = (1 - math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi) ** bits
        draw = np.random.default_rng(11)
        return tuple(tuple(int(b) for b in draw.permutation(64 * SHORT)[:bits]) for _ in range(math.ceil(math.log(self.miss) / math.log1p(-shared))))


def exact_plan(words: int = 3, radius: int = 2, blocks: int = 4) -> Plan:
    """Loses no link: `radius` differing bits leave `blocks - radius` of the blocks whole."""
    cuts = np.array_split(np.arange(64), blocks)
    return Plan(words, radius, tuple(tuple(int(b) for c in chosen for b in c) for chosen in combinations(cuts, blocks - radius)))


def similarity_plan(words: int = 5, similarity: float = 0.8, radius: int = 54, likely: int = 34, long_radius: int = 356, **kwargs) -> Plan:
    """For shingle sets of Jaccard similarity 0.8 or more.

    At 0.8 two fingerprints of 256 bits differ in 38.8 on average with a
    deviation of 5.7, unrelated ones in 128 with 8: the radius lies 2.7
    deviations over the first. Of 2048 bits they differ in 310 with 16.2, and
    the radius lies 2.8 deviations over that. This holds for sets of many
    shingles; small ones differ more. A key of 12 bits is shared with a chance
    of 0.14 at 0.8 (0.27 at 0.9), one of 31 keys with 0.99. Keys grow by a bit
    each time the corpus doubles, and their number by a sixth.
    """
    return Plan(words, radius, similarity=similarity, likely=likely, long_radius=long_radius, **kwargs)


def shingle_spans(text: bytes, words: int) -> tuple[bytes, list[int], list[int]]:
    """(words joined by blanks, starts, ends of the shingles in it); a text of fewer words is one shingle, one without words has none."""
    tokens = text.lower().split()  # on bytes: A-Z, and the six blanks of ASCII
    if not tokens:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    k = min(words, len(tokens))
    return b" ".join(tokens), np.r_[0, ends[:-1] + 1].tolist()[: len(tokens) - k + 1], ends.tolist()[max(0, k - 1) :]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted; of a text without words, that of the empty shingle."""
    line, starts, ends = shingle_spans(text, words)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter([digest(line[s:e]) for s, e in zip(starts, ends)] or [digest(b"")], np.uint64))


def majority(words: np.ndarray) -> np.ndarray:
    """(n, k) words -> k words: bits set in over half of the rows."""
    counts = np.zeros(words.shape[1] * 64, np.int64)
    step = max(1, PIECE_BYTES // (words.shape[1] * 64))
    for first in range(0, len(words), step):
        bits = np.unpackbits(words[first : first + step].astype(">u8").view(np.uint8).reshape(-1, words.shape[1] * 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(words)).view(">u8").astype(np.uint64)


def fingerprint(text: bytes, words: int) -> np.ndarray:
    """One word of majority bits over the XXH64 hashes, seed 42, of all shingles; zero for a text without words."""
    line, starts, ends = shingle_spans(text, words)
    if not starts:
        return np.zeros(1, np.uint64)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter([digest(line[s:e], 42) for s, e in zip(starts, ends)], np.uint64, len(starts))[:, None])


def set_fingerprint(text: bytes, words: int, longs: int) -> np.ndarray:
    """Majority bits over the distinct shingles, each hash spread over the words by a mixer; zero for a text without words."""
    if not text.strip():
        return np.zeros(longs, np.uint64)
    hashes, out = shingle_hashes(text, words), np.empty(longs, np.uint64)
    for first in range(0, longs, SHORT):
        x = hashes[:, None] + GOLDEN * np.arange(first + 1, min(longs, first + SHORT) + 1, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        out[first : first + SHORT] = majority(x ^ (x >> np.uint64(31)))
    return out


def fingerprints(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", longs: int | None = None) -> DataFrame:
    """(id, f0...): the fingerprint's 64-bit words as longs. A null text counts as empty."""
    n, words, once = longs or plan.longs, plan.words, plan.similarity is not None
    names = [f"f{k}" for k in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in in_pieces(batches):
            texts = (x.as_py() or b"" for x in batch.column(1).cast(pa.binary()))
            prints = np.zeros((batch.num_rows, n), np.uint64)
            for at, text in enumerate(texts):
                prints[at] = set_fingerprint(text, words, n) if once else fingerprint(text, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(prints[:, k].view(np.int64)) for k in range(n))], ["id", *names])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{f} long" for f in names))


def _keyed(keys: tuple[tuple[int, ...], ...], longs: int, names: list[str]):
    """(rep, label, f...) -> (key, rep, label, f...) for each key; keys are of the first `longs` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(longs)], axis=1).astype(np.int64)
            bits = np.unpackbits(prints.astype(">i8").view(np.uint8).reshape(len(prints), -1), axis=1).astype(np.int64)
            for at, key in enumerate(keys):
                value = bits[:, key] @ (1 << np.arange(len(key), dtype=np.int64)) + (at << 40)
                yield pa.RecordBatch.from_arrays([pa.array(value), *batch.columns], ["key", "rep", "label", *names])

    return run


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by (key, cell) -> (group number, rows) of whole groups, many at a time."""
    numbered = lambda rows: (np.cumsum(np.r_[False, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])]), rows)
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64))
        size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            rows = np.concatenate(held)
            before = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            cut = before[-1] + 1 if len(before) else 0
            if cut:
                yield numbered(rows[:cut])
            held, size = [rows[cut:]], len(rows) - cut
    if size:
        yield numbered(np.concatenate(held))


def _in_groups(reps: DataFrame, keys: tuple[tuple[int, ...], ...], split: int, longs: int) -> DataFrame:
    """reps: (rep, label, f...). (key, cell, rep, label, f...): a row for each key, sorted by group; keys that one row has are left out."""
    prints = [c for c in reps.columns if c not in ("rep", "label")]
    schema = "key long, rep long, label long, " + ", ".join(f"{f} long" for f in prints)
    keyed = reps.select("rep", "label", *prints).mapInArrow(_keyed(keys, longs, prints), schema)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    shared = sizes.filter("n > 1").select("key", F.expr(f"cast(ceil(n / {split}) as int)").alias("chunks"))
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    dealt = keyed.join(shared, "key").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = (F.least("chunk", "other").cast("long") * F.col("chunks") + F.greatest("chunk", "other")).alias("cell")
    cells = dealt.select("key", cell, "rep", "label", *prints)
    return cells.repartition("key", "cell").sortWithinPartitions("key", "cell")


def link_prints(reps: DataFrame, plan: Plan, keys: tuple[tuple[int, ...], ...]) -> DataFrame:
    """reps: (rep, f...), distinct fingerprints. (a, b[, close]): pairs within the radius that span what lies within it.

    With a similarity, also pairs that span what lies within `likely` bits, marked as close.
    """
    radius, likely, twice = plan.radius, plan.likely, plan.similarity is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _in_cells(batches):
            prints = rows[:, 4:].view(np.uint64)
            if twice:
                a, b, close = link_runs_twice(group, prints, radius, likely)
                yield pa.RecordBatch.from_arrays([pa.array(rows[a, 2]), pa.array(rows[b, 2]), pa.array(close)], ["a", "b", "close"])
            else:
                a, b = link_runs(group, prints, radius)
                yield pa.RecordBatch.from_arrays([pa.array(rows[a, 2]), pa.array(rows[b, 2])], ["a", "b"])

    groups = _in_groups(reps.withColumn("label", F.lit(0).cast("long")), keys, plan.split, plan.longs)
    return groups.mapInArrow(run, "a long, b long" + ", close boolean" * twice).distinct()


def _masks(keys: tuple[tuple[int, ...], ...], longs: int) -> np.ndarray:
    """(keys, words): the bits of each key, laid out as fingerprints are."""
    bits = np.zeros((len(keys), 64 * longs), np.uint8)
    for at, key in enumerate(keys):
        bits[at, list(key)] = 1
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def pairs_between(reps: DataFrame, plan: Plan, keys: tuple[tuple[int, ...], ...]) -> DataFrame:
    """reps: (rep, label, f...) with long fingerprints. (a, b): all pairs within both radii whose labels differ, each from the first key that it shares."""
    masks, radius, far = _masks(keys, SHORT), plan.radius, plan.long_radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [masks[:k] for k in range(len(masks))]
        for group, rows in _in_cells(batches):
            every = rows[:, 4:].view(np.uint64)
            for a, b in pairs_across(group, every[:, :SHORT], radius, rows[:, 3], [before[k] for k in (rows[:, 0] >> 40).tolist()]):
                near = distance(every[a], every[b]) <= far
                x, y = rows[a[near], 2], rows[b[near], 2]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    # Pairs of chunks repeat what lies within a chunk.
    return _in_groups(reps, keys, plan.split, SHORT).mapInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs: (a, b). sets: (id, shingles), sorted 64-bit hashes. Those whose sets reach the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                few, many = sorted((len(x), len(y)))
                if few < similarity * many:
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(same >= similarity * (few + many - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _close_up(docs: DataFrame, nodes: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """nodes: (rep). (rep, shingles, f...): the shingle set and the long fingerprint of these documents; a repeated id counts once."""
    words, names = plan.words, [f"f{k}" for k in range(LONG)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            sets, prints = [], np.zeros((batch.num_rows, LONG), np.uint64)
            for at, text in enumerate(batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                sets.append(shingle_hashes(text, words).tobytes())
                prints[at] = set_fingerprint(text, words, LONG)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), *(pa.array(prints[:, k].view(np.int64)) for k in range(LONG))], ["rep", "shingles", *names])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(nodes, "rep", "left_semi")
    return texts.mapInArrow(run, "rep long, shingles binary, " + ", ".join(f"{f} long" for f in names)).dropDuplicates(["rep"])


def _similar_roots(docs: DataFrame, reps: DataFrame, plan: Plan, keys: tuple[tuple[int, ...], ...], id_col: str, text_col: str) -> DataFrame:
    """(node, root) of the links whose texts have been held against each other."""
    links = written(link_prints(reps, plan, keys), "print-links")
    nodes = written(links.select(F.col("a").alias("rep")).union(links.select("b")).distinct(), "print-nodes")
    near = written(_close_up(docs, sized(nodes), plan, id_col, text_col), "print-texts")
    sets, prints = near.select("rep", "shingles"), near.drop("shingles")
    held = written(similar(links.filter("close").select("a", "b").distinct(), sets, plan.similarity), "print-held")
    roots = components(held)
    labelled = prints.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("root", "rep"))
    pairs = written(pairs_between(labelled.select("rep", "label", *(c for c in prints.columns if c != "rep")), plan, keys), "print-pairs")
    return components(held.union(similar(pairs, sets, plan.similarity)))


def near_groups(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, f0..., component).

    component: the smallest id that links reach, the row's own included; ids are
    integers, and anything else is an error or null as Spark casts it. Equal
    fingerprints are linked (of 256 bits and different texts, at a similarity of
    0.8, less than one pair in 10^15 has them); null and empty texts and those
    without words share the fingerprint zero and link like any others. A row
    with a null id has a fingerprint, but no part in the links and a null
    component. Repeated rows get equal results. Other columns, whatever their
    names, are not read. An empty table gives none.
    """
    all_prints = written(fingerprints(docs, plan, id_col, text_col), "prints")
    names = [c for c in all_prints.columns if c != "id"]
    reps = all_prints.filter("id is not null").groupBy(*names).agg(F.min("id").alias("rep"))
    reps = written(reps, "print-classes")
    keys = plan.drawn(reps.count())
    if plan.similarity is None:
        roots = components(link_prints(reps, plan, keys))
    else:
        roots = _similar_roots(docs, reps, plan, keys, id_col, text_col)
    classes = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*names, F.coalesce("root", "rep").alias("component"))
    out = all_prints.join(classes, names, "left")
    return out.select("id", *names, F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def drop_near_copies(docs: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each near-duplicate group, that with the smallest id.

    Rows that repeat an id are one document and stay or go together; rows with a
    null id all stay, and so do null, empty and blank texts but one. Columns of
    any name stay as they are. An empty table gives an empty one.
    """
    groups = near_groups(docs, plan or similarity_plan(), id_col, text_col)
    gone = written(groups.filter("id > component").select(F.col("id").alias(id_col)).distinct(), "near-copies")
    return docs.join(sized(gone), id_col, "left_anti")

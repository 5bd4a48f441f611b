"""Exact Jaccard self-join of documents' shingle sets, by pivots in the metric space of Jaccard distances.

Equal sets are one point. Points first meet in cells; in each cell some points
are pivots, and the distance of every other point to them is computed. Each
point belongs to the Voronoi region of its nearest pivot; by the triangle
inequality it has partners in another region only if that pivot is no more
than two radii further, and is replicated there. In a region, partners differ
by one radius at most in their distance to its pivot, so the region is cut in
rings, and points are replicated to the ring beyond theirs. Rings are cells of
the next round, without the pivots. Points within the radius of one pivot are
linked through it and need not be compared with each other.

Two documents that have nothing in common lie at distance 1 from each other and
from all pivots, so Voronoi regions cannot part them. The first cells do, with
no loss: a point's shingles are dealt by hash to one part more than two linked
sets of its size can differ by, so linked sets have a part that is equal. Sets
are dealt by bands of size, each wide enough for both sides of a link.

A cell that its pivots do not part (its points are all about as far from each
other as from the pivots) is compared in blocks, every pair of blocks in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, sized, written
from .components import components
from .simhash import shingle_hashes

#: Links: LEAST per cent of the union at least. A link's distance is at most RADIUS.
LEAST = 90
RADIUS = 1 - LEAST / 100
#: Added to bounds of distances in floating point.
SLACK = 1e-9
#: Pivots of a cell. A cell of up to SMALL points has no pivots, its pairs are compared.
PIVOTS, SMALL = 8, 4
#: Points and bytes of shingles in a block.
BLOCK, BLOCK_BYTES = 256, 4_000_000
#: Shingles of two blocks that are counted at once.
SLICE = 8192
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _bands(least: int, upto: int) -> np.ndarray:
    """First size of each band: linked sets are in one band or in two that follow. Under the first, only equal sets link."""
    first = least // (100 - least)  # a set of so many and one more element can just be linked
    out = [first]
    while out[-1] <= upto:
        out.append(out[-1] * 100 // least + 1)
    return np.array([*out, out[-1] * 100 // least + 1])


def part_keys(hashes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """64-bit keys of a set: sets that are linked but not equal share one at least.

    A pair of sizes n1 <= n2 in bands k and k or k + 1 meets in band k: the sets
    differ by at most (100 - least) / (100 + least) * (n1 + n2) shingles, which
    is at most (100 - least) / least * n1, and are dealt to one part more than that.
    """
    edges = _bands(least, len(hashes))
    own = int(np.searchsorted(edges, len(hashes), side="right")) - 1
    if own < 0:
        return np.zeros(0, np.uint64)
    out = []
    for band in range(max(0, own - 1), own + 1):
        parts = (int(edges[band + 1]) - 1) * (100 - least) // least + 1
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, (hashes % np.uint64(parts)).astype(np.int64), _mixed(hashes))
        out.append(_mixed(sums ^ _mixed(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 32))))
    return np.concatenate(out)


def _set_of(text: bytes, words: int) -> np.ndarray:
    return shingle_hashes(text, words) if text.strip() else np.zeros(0, np.uint64)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
    return int(d[0]), int(d[1])


POINTS = "row long, id long, n long, d0 long, d1 long, keys array<long>"


def _points(words: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                hashes = _set_of(text.as_py() or b"", words)
                sizes.append(len(hashes))
                digests.append(_digest(hashes))
                keys.append(part_keys(hashes, least).view(np.int64))
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            d = np.array(digests, np.int64).reshape(-1, 2)
            offsets = pa.array(np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(np.array(sizes, np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], ["row", "id", "n", "d0", "d1", "keys"])
        release()

    return run


def _sets(words: int):
    """(node, d0, d1, text) -> (node, shingles) where the text's set is the node's: an id may have several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, d0, d1, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3).cast(pa.binary()), strict=True):
                hashes = _set_of(text.as_py() or b"", words)
                if _digest(hashes) == (d0, d1):
                    nodes.append(node)
                    sets.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])
        release()

    return run


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs: (a, b). sets: (node, shingles). (a, b, both, union): numbers of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, union = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                every = np.sort(np.concatenate([x, y]), kind="stable")
                same = int(np.count_nonzero(every[1:] == every[:-1]))
                both.append(same)
                union.append(len(every) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "both", "union"])

    rows = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, both long, union long")


def _compared(least: int):
    """Rows of two blocks, or of one: links between points of different colours that are not joined by other links here."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in rows.shingles]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        column = np.cumsum(np.r_[False, every[order][1:] != every[order][:-1]][: len(every)])
        common = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
        owner, column = owner[order][common], column[common]
        both = np.zeros((len(sets), len(sets)), np.float32)  # exact up to 2^24 shingles; longer sets are compared below
        column = np.unique(column, return_inverse=True)[1]
        for first in range(0, int(column.max()) + 1 if len(column) else 0, SLICE):
            here = slice(*np.searchsorted(column, [first, first + SLICE]))
            m = np.zeros((len(sets), SLICE), np.float32)
            m[owner[here], column[here] - first] = 1
            both += m @ m.T
        size = np.array([len(s) for s in sets], np.int64)
        if len(size) and size.max() >= 1 << 24:
            both = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in sets] for x in sets], np.float64)
        same = both.astype(np.int64)
        linked = 100 * same >= least * (size[:, None] + size[None, :] - same)
        colour = rows.colour.to_numpy()
        a, b = np.nonzero(np.triu(linked & (colour[:, None] != colour[None, :]), 1))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x] = root.get(root[x], root[x])
            return x

        node, out = rows.node.to_numpy(), []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = top(int(colour[x])), top(int(colour[y]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(node[x]), int(node[y])))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def compared_in_blocks(cells: DataFrame, sizes: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """cells: (cell, node, colour, n). sizes: (cell, points, shingles). (a, b): links that join what is linked in each cell, colours being joined already."""
    blocks = F.greatest(F.ceil(F.col("points") / BLOCK), F.ceil(8 * F.col("shingles") / BLOCK_BYTES))
    dealt = cells.select("cell", "node", "colour").join(sizes.select("cell", blocks.alias("blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "colour")
    return units.join(sets, "node").groupBy("cell", "i", "j").applyInPandas(_compared(least), "a long, b long")


def _measured(cells: DataFrame) -> DataFrame:
    """(cell, points, shingles) of cells with several colours."""
    sizes = cells.groupBy("cell").agg(F.count("*").alias("points"), F.sum("n").alias("shingles"), F.min("colour").alias("low"), F.max("colour").alias("high"))
    return sizes.filter("low != high").drop("low", "high")


def _apart(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def voronoi_links(cells: DataFrame, sets: DataFrame, least: int = LEAST, pivots: int = PIVOTS) -> list[DataFrame]:
    """cells: (cell, node, colour, n), written; n is the set's size. Tables (a, b) of links that join all linked points of each cell.

    Points of one colour are joined already. Each round halves the pairs that
    are left at least, or compares them in blocks, so rounds end.
    """
    radius, links, turn = 1 - least / 100 + SLACK, [], 0
    close = 100 * F.col("both") >= least * F.col("union")
    while True:
        sizes = written(_measured(cells), "cell-sizes")
        if sizes.isEmpty():
            return links
        small = cells.join(sizes.filter(F.col("points") <= SMALL).select("cell"), "cell", "left_semi")
        x, y = (small.select("cell", F.col("node").alias(c), F.col("colour").alias(f"colour_{c}")) for c in ("a", "b"))
        few = _apart(x.join(y, "cell").filter("a > b and colour_a != colour_b"))
        large = cells.join(sizes.filter(F.col("points") > SMALL), "cell")
        # Pivots: one of each of some hash classes of a cell, so that no cell is sorted.
        kind = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(pivots))
        chosen = large.groupBy("cell", kind.alias("kind")).agg(F.min_by("node", F.xxhash64("node", F.lit(turn + 1))).alias("pivot"), F.count("*").alias("of")).select("cell", "pivot")
        chosen = written(chosen, "pivots")
        to_pivots = large.join(chosen, "cell")
        pairs = to_pivots.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        known = written(distances(_apart(pairs.union(few)), sets), "pivot-distances")
        links.append(known.filter(close).select("a", "b"))

        d = 1 - F.col("both") / F.col("union")
        near = known.select(F.col("a").alias("node"), F.col("b").alias("pivot"), d.alias("d"), close.alias("close"))
        near = near.union(known.select("b", "a", d, close))
        own = chosen.select("cell", F.col("pivot").alias("node"))
        seen = to_pivots.join(own, ["cell", "node"], "left_anti").join(near, ["node", "pivot"])
        points = seen.groupBy("cell", "node", "colour", "n", "points").agg(F.collect_list(F.struct("d", "pivot", "close")).alias("seen"))  # a struct per pivot
        nearest = points.withColumn("nearest", F.array_min("seen")).withColumn("colour", F.when(F.col("nearest.close"), F.col("nearest.pivot")).otherwise(F.col("colour")))
        within = F.filter("seen", lambda s: s["d"] <= F.col("nearest")["d"] + 2 * radius)
        regions = nearest.withColumn("region", F.explode(within))
        ring = F.floor(F.col("region.d") / radius)
        rings = regions.withColumn("ring", F.explode(F.array(ring, ring + 1)))
        parts = rings.select("cell", F.xxhash64("cell", "region.pivot", "ring", F.lit(turn)).alias("part"), "node", "colour", "n", "points")
        parts = written(parts, "regions")
        work = parts.groupBy("cell", "part").agg(F.count("*").cast("double").alias("k"), F.first("points").alias("points"), (F.min("colour") != F.max("colour")).alias("open"))
        split = written(work.groupBy("cell").agg(F.sum(F.when(F.col("open"), F.col("k") * F.col("k")).otherwise(0.0)).alias("left"), F.first("points").alias("points")).select("cell", (F.col("left") <= F.col("points") * F.col("points") / 2).alias("parted")), "parted")
        stuck = nearest.join(split.filter("not parted").select("cell"), "cell", "left_semi").select("cell", "node", "colour", "n")
        stuck = written(stuck, "unparted")
        left = written(_measured(stuck), "unparted-sizes")
        if not left.isEmpty():
            links.append(written(compared_in_blocks(stuck, left, sets, least), "block-links"))
        cells = written(parts.join(split.filter("parted").select("cell"), "cell", "left_semi").select(F.col("part").alias("cell"), "node", "colour", "n"), "rings")
        turn += 2


def jaccard_groups(docs: DataFrame, words: int = 3, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, n_shingles, component.

    A document's set holds its distinct shingles of `words` words (A-Z
    lower-cased, between ASCII blanks); with fewer words, all of them are one
    shingle. Two documents link if 100 * intersection >= least * union.
    component: the smallest id that links reach, the row's own included. A
    document without words, a null or empty text too, has an empty set and links
    with nothing. Ids are integers, as Spark casts them; a row with a null id
    has a set, but no part in the links, and a null component. Rows of one id
    and one text are one document; rows of one id and several texts join what
    each of these is linked with. Other columns, whatever their names, are not
    read. An empty table gives no rows. Shingles and sets are told apart by
    64-bit and 128-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    points = written(rows.mapInArrow(_points(words, least), POINTS), "points")
    some = points.filter("n > 0 and id is not null")
    classes = written(some.groupBy("d0", "d1").agg(F.min("row").alias("node"), F.min("id").alias("low"), F.max("id").alias("high")), "set-classes")
    copies = written(some.select("row", "d0", "d1").join(classes.filter("low != high").select("d0", "d1", "node"), ["d0", "d1"]).filter("row != node").select("row"), "set-copies")
    nodes = some.join(sized(copies), "row", "left_anti").select(F.col("row").alias("node"), "id", "n", "d0", "d1", "keys")
    keyed = nodes.select(F.explode("keys").alias("cell"), "node", "n")
    cells = written(keyed.groupBy("cell").agg(F.count("*").alias("k"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor(F.xxhash64("node")).alias("who")).filter("k > 1 and a != b"), "cells")
    couples = cells.filter("k = 2").select("a", "b").distinct()
    # Cells of the same points are one.
    crowds = written(cells.filter("k > 2").groupBy("k", "a", "b", "who").agg(F.min("cell").alias("cell")).select("cell"), "crowds")
    crowded = written(keyed.join(sized(crowds), "cell").select("cell", "node", F.col("node").alias("colour"), "n").distinct(), "crowded")
    candidates = couples.select(F.col("a").alias("node")).union(couples.select("b")).union(crowded.select("node")).distinct()
    wanted = written(nodes.drop("keys").join(candidates, "node").select("node", "id", "d0", "d1"), "candidates")
    texts = rows.join(sized(wanted, 32), "id").select("node", "d0", "d1", "text")
    sets = written(texts.mapInArrow(_sets(words), "node long, shingles binary").dropDuplicates(["node"]), "shingle-sets")

    direct = distances(couples, sets).filter(100 * F.col("both") >= least * F.col("union")).select("a", "b")
    links = [written(direct, "couples"), *voronoi_links(crowded, sets, least)]
    # An id with several texts joins their sets.
    several = some.join(classes.select("d0", "d1", "node"), ["d0", "d1"]).groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.collect_set("node").alias("nodes")).filter("a != b")
    links.append(several.select("a", F.explode("nodes").alias("b")))
    roots = components(reduce(DataFrame.union, links))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("sets"))
    joined = named.join(lowest, "root").filter("sets > 1 or low != high").select("d0", "d1", "component")
    joined = written(joined, "set-components")
    out = points.select("id", F.col("n").alias("n_shingles"), "d0", "d1").join(sized(joined, 24), ["d0", "d1"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))

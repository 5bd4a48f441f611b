"""Importance resampling towards a target corpus.

Features are runs of one to three words, hashed to buckets by CRC-32. The counts
of both corpora are arrays with a place per bucket; so are the gains, which are
all that is broadcast. A text's weight is the sum of its features' gains. Noise
from the id makes the highest scores a draw without replacement.

The number of rows to draw is exact. A quantile sketch gives a bracket for the
cutoff; the rows above and inside it are counted exactly, which proves the
bracket or widens it, and a bracket with many rows is narrowed by a sketch of
its own. Only its rows are sorted. The drawn rows are ranked in ranges with
prefix sums of the ranges' sizes.

Checksums of runs are put together from those of their words: the checksum is
linear, so appending bytes is four table lookups, for arrays of words at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, written

BUCKETS = 10_000
#: Words in the longest feature.
LONGEST = 3
#: Bytes whose words are found at once, and words whose features are.
PIECE = 1_000_000
#: Bytes of a word that are checksummed column by column; longer words go one at a time.
SHORT = 32
#: Rows of a bracket that come to the driver to be sorted.
SORTED = 50_000
#: Precision of the quantile sketch: its rank error is at most one part in this many.
ACCURACY = 10_000

_byte = np.arange(256)
IN_WORD = (_byte >= 128) | (_byte >= 48) & (_byte <= 57) | (_byte >= 97) & (_byte <= 122)
FOLDED = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


def _shifts(most: int) -> np.ndarray:
    """[n][i][v]: what byte i of a checksum, of value v, becomes when n zero bytes follow."""
    table = np.zeros((256,), np.uint32)
    for v in range(256):
        c = v
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table[v] = c
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(most):
        now = table[now & 255] ^ (now >> np.uint32(8))
        out.append(now)
    return np.stack(out)


MOST = 63
SHIFTS = _shifts(MOST)
TABLE = SHIFTS[1][0]
_FLAT = SHIFTS.reshape(-1)
_BLANK = np.uint32(zlib.crc32(b" "))


def followed(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of checksums in those of the same bytes with `length` more: to be combined with the checksum of these by xor."""
    crc, length = crc.copy(), length.astype(np.int64)
    far = np.flatnonzero(length > MOST)
    while len(far):
        crc[far] = _lookup(crc[far], np.full(len(far), MOST))
        length[far] -= MOST
        far = far[length[far] > MOST]
    return _lookup(crc, length)


def _lookup(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    base = length * 1024
    out = _FLAT[base + (crc & 255)]
    for i in (1, 2, 3):
        out ^= _FLAT[base + 256 * i + ((crc >> np.uint32(8 * i)) & 255)]
    return out


def _word_sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, checksum) of the words of a piece of text in bytes."""
    b = FOLDED[b]
    edge = np.diff(np.r_[False, IN_WORD[b], False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    rows = np.flatnonzero(length <= SHORT)
    for j in range(SHORT):
        rows = rows[length[rows] > j]
        if not len(rows):
            break
        c = crc[rows]
        crc[rows] = TABLE[(c ^ b[start[rows] + j]) & 255] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for at in np.flatnonzero(length > SHORT).tolist():
        crc[at] = zlib.crc32(b[start[at] : end[at]])
    return start, length, crc


def word_sums(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, length, checksum) of all words of some texts, in order."""
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    parts, at = [], 0
    while at < len(joined):
        end = min(len(joined), at + PIECE)
        while end < len(joined) and IN_WORD[FOLDED[joined[end]]]:
            end += 1
        start, length, crc = _word_sums(joined[at:end])
        parts.append((np.searchsorted(ends, start + at, side="right"), length, crc))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    text, length, crc = (np.concatenate(x) for x in zip(*parts, strict=True))
    return text, length, crc


def feature_buckets(text: np.ndarray, length: np.ndarray, crc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all features, an array at a time. Takes what `word_sums` gives."""
    for first in range(0, len(text), PIECE):
        last = min(len(text), first + PIECE)
        reach = slice(first, min(len(text), last + LONGEST - 1))
        t, n, word = text[reach], length[reach] + 1, crc[reach]
        after = followed(np.full(len(word), _BLANK), n - 1) ^ word  # a blank and the word
        run, own = word[: last - first], t[: last - first]
        yield own, run % BUCKETS
        for more in range(1, LONGEST):
            at = np.arange(more, min(len(t), len(run) + more))
            run = followed(run[: len(at)], n[at]) ^ after[at]
            inside = t[at] == own[: len(at)]
            yield own[: len(at)][inside], run[inside] % BUCKETS


def _grouped(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of runs of about `most` bytes; a longer text is a run of its own."""
    held, size, first = [], 0, 0
    for at, text in enumerate(column.cast(pa.binary())):
        text = text.as_py() or b""
        if held and size + len(text) > most:
            yield first, held
            held, size, first = [], 0, at
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, texts in _grouped(batch.column(0)):
            for _, bucket in feature_buckets(*word_sums(texts)):
                total += np.bincount(bucket, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])
    release()


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all texts: a task adds up arrays, and a row per bucket at most comes to the driver."""
    found = texts.select(F.col(text_col).alias("text")).mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the target's smoothed share of each bucket to the raw corpus's, in doubles."""
    all_raw, all_target = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, texts in _grouped(batch.column(1)):
                words = word_sums(texts)
                here = slice(first, first + len(texts))
                n_words[here] += np.bincount(words[0], minlength=len(texts))
                for text, bucket in feature_buckets(*words):
                    n_features[here] += np.bincount(text, minlength=len(texts))
                    # Rows are in order of text, so sums of whole numbers are differences of running sums.
                    upto = np.r_[0, np.cumsum(gains.value[bucket])]
                    edge = np.searchsorted(text, np.arange(len(texts) + 1))
                    weight[here] += upto[edge[1:]] - upto[edge[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["id", "n_words", "n_features", "weight"])
        release()

    return run


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def cutoff(rows: DataFrame, keys: list[str], k: int, accuracy: int = ACCURACY, most: int = SORTED) -> tuple[int, ...]:
    """The k-th of `rows` in the order of `keys`, whole numbers without nulls, smallest first. Rows must number k at least, and differ in some key.

    One key after the other: what lies outside the bracket is counted and left
    out, until no more than `most` rows are left to be sorted. A bracket of one
    value goes on with the next key, so ties of any number are narrowed as well.
    """
    found: tuple[int, ...] = ()
    for at, key in enumerate(keys):
        while True:
            low, high, under, inside = _bracket(rows, key, k, accuracy, most)
            k -= under
            rows = rows.filter(F.col(key).between(low, high))
            if inside <= most:
                return (*found, *sorted(rows.select(*keys[at:]).collect())[k - 1])
            if low == high:
                break
        found = (*found, low)
    raise ValueError("more rows than may be sorted are equal in every key")


def _bracket(rows: DataFrame, key: str, k: int, accuracy: int, most: int) -> tuple[int, int, int, int]:
    """(low, high, rows under it, rows inside it): a range of `key` that is proven to hold the k-th smallest."""
    n, least, last = rows.agg(F.count("*"), F.min(key), F.max(key)).first()
    if n <= most or least == last:
        return least, last, 0, n
    slack = 2.0  # in rank errors of the sketch
    while True:
        near = [min(1.0, max(0.0, k / n + side * slack / accuracy)) for side in (-1, 1)]
        low, high = rows.agg(F.percentile_approx(key, near, accuracy)).first()[0]
        low, high = (least if near[0] <= 0 else low), (last if near[1] >= 1 else high)
        under, inside = rows.agg(F.count_if(F.col(key) < low), F.count_if(F.col(key).between(low, high))).first()
        if under < k <= under + inside:
            break
        slack *= 4
    if (low, high) == (least, last):  # few values, many ties: the sketch does not part them, the middle of the range does
        middle = (low + high) // 2
        upto = rows.filter(F.col(key) <= middle).count()
        return (low, middle, 0, upto) if k <= upto else (middle + 1, high, upto, n - upto)
    return low, high, under, inside


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `rank`, from 1 in the order of some columns, smallest first: ranks inside ranges, and the sizes of the ranges before."""
    ranges = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "draw-ranges")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = sizes.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy(*order)
    return ranges.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(sizes), "range").select(*rows.columns, (F.col("nth") + F.col("before")).cast("long").alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: the id, n_words, n_features, weight, score, rank.

    rank: 1, 2, ... for the drawn rows, highest score first, ties to the smaller
    id; null for others. Drawn are floor(percent * N / 100) of the N rows with
    at least `min_words` words. A null or empty text has no features and weight
    0. Ids are integers, as Spark casts them; a null id has the noise of an
    empty text and comes after all others of its score. Repeated rows are rows
    of their own: they share a score and take ranks side by side. Other columns,
    whatever their names, are not read. An empty table gives no rows; an empty
    target leaves the gains to the smoothing.
    """
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_text)))  # a number per bucket
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    weighed = rows.mapInArrow(_weighed(gains), "id long, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("tie", F.monotonically_increasing_id())
    last = F.lit((1 << 63) - 1)
    scored = written(scored.withColumns({"down": -F.col("score"), "up": F.coalesce("id", last)}), "scores")
    keys = ["down", "up", "tie"]
    able = scored.filter(F.col("n_words") >= min_words)
    n = able.count()
    k = n * percent // 100
    if k:
        down, up, tie = cutoff(able.select(*keys), keys, k)
        drawn = (F.col("n_words") >= min_words) & ((F.col("down") < down) | (F.col("down") == down) & ((F.col("up") < up) | (F.col("up") == up) & (F.col("tie") <= tie)))
    else:
        drawn = F.lit(False)
    columns = ["id", "n_words", "n_features", "weight", "score", "rank"]
    taken = ranked(scored.filter(drawn), *keys).select(*columns)
    left = scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*columns)
    return taken.union(left).withColumnRenamed("id", id_col)

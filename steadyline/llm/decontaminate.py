"""Benchmark decontamination by templates.

Texts and benchmark items become templates: numbers, names and units turn into
typed placeholders, everything else is lower-cased without punctuation. Names in
a row are one placeholder, and so are the words of a number. A word with a
capital is a name wherever it stands, but for a list of words that start
sentences; neither the rest of the text nor where a sentence begins has a say, so
an item and its copy are read alike. Windows of template words are hashed and
joined. Placeholders match any value of their type, so a re-parameterised
question matches too. Matches that lie about equally far from their places in
the item are one copy of it, and a copy is judged as a whole: it counts if it has
a share of the item's windows and each value of the item stands for one value
only in it.

A window is 8 template words, or more until 4 of them are no placeholders. The actual
words of 8-word windows with placeholders are windows too: they match a passage
word for word, in whatever case, and need no check. An item without a window of
the first kind is one window as a whole.

The hashes of all windows of a text come from a few passes over its bytes. Only
windows whose hash may be a benchmark's (a bit set of fixed size) leave the
task, so the join moves about as many rows as there are matches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, in_pieces, release, sized, written

WINDOW = 8
#: Words of a window that are no placeholders, at least; a window with fewer is widened.
LITERALS = 4
#: Share of an item's windows that a re-parameterised copy must have.
SHARE = 0.5
#: Bytes whose words are hashed at once.
PIECE = 250_000
#: The bit set has 2 to this power of bits.
FILTER_BITS = 22
#: Words that are units when they follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l gal liter liters litre litres gallon gallons "
    "ms s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent mph kmh degree degrees celsius fahrenheit watt watts volt volts joule joules"
).split()
_ONES = "one two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Words that are numbers; "twenty-five" is one word.
NUMBER_WORDS = _ONES + "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen dozen hundred thousand million billion".split() + _TENS + [t + o for t in _TENS for o in _ONES]
#: Words that are no names though a sentence starts with them.
STARTERS = (
    "the a an this that these those there here it its he she they we you his her their our your my who whom whose which what when where why how "
    "if in on at by for from of to with without into over under after before during since until while as and or but so then than now later next first finally "
    "each every all some any no not both either neither many much more most few several other another only also again still yet "
    "is are was were be been do does did has have had can could will would shall should may might must let given find calculate compute determine solve suppose assume consider "
    "because although though however therefore thus hence between among per about once"
).split()
#: Template words that may be put in or left out between two windows of a copy.
SLACK = 7

MUL, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BACK = np.uint64(pow(int(MUL), -1, 1 << 64))
EXACT = np.uint64(0x3C6EF372FE94F82B)
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x0123456789ABCDF1, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))

_byte = np.arange(256)
BLANK = (_byte == 32) | (_byte >= 9) & (_byte <= 13)
DIGIT = (_byte >= 48) & (_byte <= 57)
CAPITAL = (_byte >= 65) & (_byte <= 90)
SIGN = (_byte < 128) & ~BLANK & ~DIGIT & ~CAPITAL & ~((_byte >= 97) & (_byte <= 122))
CLOSER = np.isin(_byte, [ord(c) for c in ".!?:;"])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MUL
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


def _piece_words(b: np.ndarray, base: int, closers: int):
    """(start, hash, numeric, capitalised, closers before the word, closers after its last letter) of each word of a piece."""
    closed = np.cumsum(CLOSER[b]) + closers
    kept = np.flatnonzero(~SIGN[b])
    c = b[kept]
    blank = BLANK[c]
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return [np.zeros(0, k) for k in (np.int64, np.uint64, bool, bool, np.int64, np.int64)], int(closed[-1]) if len(b) else closers
    # Two-byte capitals of Latin-1, as their second byte: the small letter is 0x20 further.
    accented = np.r_[False, (c[:-1] == 0xC3) & (c[1:] >= 0x80) & (c[1:] <= 0x9E) & (c[1:] != 0x97)]
    upper = CAPITAL[c] | accented
    small = ((c >= 97) & (c <= 122)) | np.r_[False, (c[:-1] == 0xC3) & (c[1:] >= 0x9F)]
    low = (c + (upper * np.uint8(32)).astype(np.uint8)).astype(np.uint64)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(c), MUL)])
    sums = np.r_[np.uint64(0), np.cumsum((low + np.uint64(1)) * power[:-1])]
    inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(c), BACK)])
    word = _mixed((sums[end] - sums[start]) * inverse[start])

    def within(x: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(x)]
        return total[end] - total[start]

    first = upper[start] | (np.r_[upper[1:], False][start] & (c[start] == 0xC3))
    numeric, capital = within(DIGIT[c]) > 0, first & (within(small) > 0)
    return [kept[start] + base, word, numeric, capital, closed[kept[start]], closed[kept[end - 1]]], int(closed[-1])


def words_of(b: np.ndarray):
    """Arrays (start, hash, numeric, capitalised, sentence start) over the words of a text in bytes."""
    parts, at, closers = [], 0, 0
    while at < len(b):
        end = min(len(b), at + PIECE)
        while end < len(b) and not BLANK[b[end]]:
            end += 1
        part, closers = _piece_words(b[at:end], at, closers)
        parts.append(part)
        at = end
    start, word, numeric, capital, before, after = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else _piece_words(b, 0, 0)[0]
    begins = np.r_[True, before[1:] > after[:-1]][: len(start)]
    return start, word, numeric, capital, begins


def hashes_of(words: Iterable[str]) -> np.ndarray:
    return np.sort(words_of(np.frombuffer(" ".join(words).encode(), np.uint8))[1])


NUMBER_HASHES, STARTER_HASHES = hashes_of(NUMBER_WORDS), hashes_of(STARTERS)


class Row:
    """Hashes one after another, each of a text, and hashes of windows of them."""

    def __init__(self, value: np.ndarray, text: np.ndarray, texts: int):
        self.text = text
        self.sizes = np.bincount(text, minlength=texts)
        self.begin = np.r_[0, np.cumsum(self.sizes)]
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(text), MUL)])[:-1]
        # Windows of any length are differences of the sums, brought to the same power.
        self.back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(text), BACK)])[:-1]
        self.sums = np.r_[np.uint64(0), np.cumsum(value * power)]

    def between(self, place: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[place]) * self.back[place]

    def hashes(self, place: np.ndarray, end: np.ndarray, exact: bool) -> np.ndarray:
        return _mixed(self.between(place, end)) ^ (end - place).astype(np.uint64) ^ (EXACT if exact else np.uint64(0))

    def of_length(self, length: int) -> np.ndarray:
        """Places of all windows of a length."""
        place = np.arange(max(0, len(self.text) - length + 1))
        return place[self.text[place] == self.text[place + length - 1]]


class Templates:
    """The words of some texts and their template words, which are fewer: names in a row are one, and so are the words of a number."""

    def __init__(self, texts: list[bytes], units: np.ndarray):
        joined = np.frombuffer(b"\n".join(texts) if texts else b"", np.uint8)
        start, word, numeric, capital, begins = words_of(joined)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        text = np.searchsorted(ends, start, side="right")
        begins |= np.r_[True, text[1:] != text[:-1]][: len(text)]
        after = lambda x: np.r_[False, x[:-1]][: len(text)] & ~begins
        spelled = np.isin(word, NUMBER_HASHES) & ~numeric
        number = numeric | spelled
        unit = after(number) & np.isin(word, units) & ~number
        # A capital makes a name at the start of a sentence too, so that the words around do not decide.
        name = capital & ~number & ~unit & ~np.isin(word, STARTER_HASHES)
        slot = number | unit | name
        first = np.flatnonzero(~(name & after(name) | spelled & after(number)))
        last = np.r_[first[1:], len(text)] if len(first) else first
        self.words = Row(word, text, len(texts))
        #: The word that each template word starts with, and the template word of each word.
        self.first, self.own = first, np.cumsum(np.bincount(first, minlength=len(text))) - 1
        self.value = self.words.between(first, last)
        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, word)))
        self.tokens = Row(kind[first], text[first], len(texts))
        self.slot = slot[first]
        #: Literals before each place of a template, and placeholders before each word.
        self.before, self.marked = np.r_[0, np.cumsum(~self.slot)], np.r_[0, np.cumsum(slot)]

    def literals(self, place: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.before[end] - self.before[place]

    def usual(self, window: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, end) of windows of `window` template words with enough literals, and of longer ones that start and end with a literal."""
        place = self.tokens.of_length(window)
        enough = self.literals(place, place + window) >= literals
        # Each literal is in few of the widened windows, so their slots are in proportion to the text.
        wide = place[~enough & ~self.slot[place]]
        last = self.before[wide] + literals - 1
        wide, last = wide[last < self.before[-1]], last[last < self.before[-1]]
        end = np.flatnonzero(~self.slot)[last] + 1
        inside = self.tokens.text[wide] == self.tokens.text[end - 1]
        place = place[enough]
        return np.r_[place, wide[inside]], np.r_[place + window, end[inside]]

    def lone(self, window: int, literals: int) -> np.ndarray:
        """Texts with words that have no usual window."""
        of = self.tokens.text[self.usual(window, literals)[0]]
        return np.flatnonzero((self.tokens.sizes > 0) & (np.bincount(of, minlength=len(self.tokens.sizes)) == 0))


def _windows(window: int, literals: int, units: np.ndarray, lengths: list[tuple[int, bool]], bits: np.ndarray | None):
    """(id, text) -> (id, hash, place, token, slots): slots are hashes of the placeholders' values, in order; exact windows have none.

    Without `bits`, those of items, which are one window as a whole where there
    is no usual one; with, those of documents whose hash has its bit set, also
    of each of the lengths that such items have. `place` counts words, `token`
    template words.
    """

    def chosen(t: Templates) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        yield *t.usual(window, literals), False
        short = t.words.of_length(window)
        if bits is None:
            short = short[t.marked[short + window] > t.marked[short]]
            yield short, short + window, True
            lone = t.lone(window, literals)
            lone = lone[t.literals(t.tokens.begin[lone], t.tokens.begin[lone + 1]) > 0]
            yield t.tokens.begin[lone], t.tokens.begin[lone + 1], False
            yield t.words.begin[lone], t.words.begin[lone + 1], True
        else:
            yield short, short + window, True
            for length, exact in lengths:
                place = (t.words if exact else t.tokens).of_length(length)
                if not exact:
                    place = place[t.literals(place, place + length) > 0]
                yield place, place + length, exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in in_pieces(batches):
            ids = batch.column(0)
            every = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            first = 0
            while first < len(every):
                last, size = first, 0
                while last < len(every) and (last == first or size + len(every[last]) <= 2 * PIECE):
                    size, last = size + len(every[last]), last + 1
                t = Templates(every[first:last], units)
                for place, end, exact in chosen(t):
                    row = t.words if exact else t.tokens
                    value = row.hashes(place, end, exact)
                    if bits is not None and len(value):
                        maybe = bits[value >> np.uint64(64 - FILTER_BITS)]
                        place, end, value = place[maybe], end[maybe], value[maybe]
                    slots = [[] if exact else t.value[p:e][t.slot[p:e]].view(np.int64) for p, e in zip(place.tolist(), end.tolist(), strict=True)]
                    text = row.text[place]
                    word, token = (place, t.own[place]) if exact else (t.first[place], place)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(text + first)), *(pa.array(x, pa.int64()) for x in (value.view(np.int64), word - t.words.begin[text], token - t.tokens.begin[text])), pa.array(slots, pa.list_(pa.int64())), pa.array(np.full(len(place), exact))],
                        ["id", "hash", "place", "token", "slots", "exact"],
                    )
                first = last
        release()

    return run


def _id_rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    return rows, f"id {rows.schema['id'].dataType.simpleString()}, hash long, place long, token long, slots array<long>, exact boolean"


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, share: float = SHARE, units: Sequence[str] = UNITS, slack: int = SLACK,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row for each document and item that share a passage: id, item_id, n_windows, n_literal, n_consistent, first_place.

    n_windows: windows of the document that match; n_literal: of these word for
    word; n_consistent: of these those of copies that have `share` of the item's
    template windows and in which each value of the item stands for one value
    only. Windows are of one copy if they lie equally far from their places in
    the item, or with up to `slack` template words put in or left out between
    them; `units` are words that a number before them makes units. Only pairs with a literal or consistent window are returned. An item
    shorter than the window, or without `literals` words that are no
    placeholders in any, is one window of its own length, if it has a word that
    is no placeholder. Null ids and null texts match nothing, empty texts
    neither. Repeated rows count as one document whose windows recur. Other
    columns, whatever their names, are not read. Empty tables give no rows.
    """
    items, schema = _id_rows(benchmark, item_id, item_text)
    marks = hashes_of(units)
    known = items.mapInArrow(_windows(window, literals, marks, [], None), schema)
    known = known.select(F.col("id").alias("item"), "hash", F.col("token").alias("item_token"), F.col("slots").alias("item_slots"), "exact").distinct()
    known = written(known, "templates")
    lengths = items.mapInArrow(_lengths(window, literals, marks), "n int, exact boolean").distinct()
    short = sorted((r["n"], r["exact"]) for r in lengths.collect())  # lengths of items without a usual window
    cells = known.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("cell")).distinct().toArrow()["cell"].to_numpy()  # at most the bits of the set
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[cells] = True
    rows, schema = _id_rows(docs, id_col, text_col)
    found = rows.mapInArrow(_windows(window, literals, marks, short, bits), schema).drop("exact")
    matched = written(found.join(known, "hash"), "template-matches")
    # A copy's windows share a shift, or a stretch of shifts: of two rows of stretches, one has any two shifts within the slack together.
    shift, wide = F.col("token") - F.col("item_token"), 2 * slack + 2
    stretches = [F.struct(F.lit(1).alias("of"), F.floor((shift + k * (slack + 1)) / wide).alias("at"), F.lit(k).alias("row")) for k in (0, 1)]
    placed = matched.filter("not exact").withColumn("copy", F.explode(F.array(F.struct(F.lit(0).alias("of"), shift.alias("at"), F.lit(0).alias("row")), *stretches)))
    copy = ["id", "item", "copy"]
    slots = placed.select(*copy, F.explode(F.arrays_zip("item_slots", "slots")).alias("slot"))
    values = slots.groupBy(*copy, F.col("slot.item_slots").alias("value")).agg(F.min("slot.slots").alias("low"), F.max("slot.slots").alias("high"))
    broken = values.filter("low != high").select(*copy).distinct().withColumn("broken", F.lit(True))
    sizes = known.filter("not exact").groupBy("item").agg(F.count_distinct("item_token").alias("of"))
    copies = placed.groupBy(*copy).agg(F.count_distinct("item_token").alias("n")).join(sizes, "item").join(broken, copy, "left")
    good = copies.filter(F.col("broken").isNull() & (F.col("n") >= share * F.col("of"))).select(*copy)
    consistent = placed.join(good, copy).groupBy("id", "item").agg(F.count_distinct("place").alias("n_consistent"))
    literal = F.col("exact") | (F.size("slots") == 0)
    out = matched.groupBy("id", "item").agg(F.count_distinct("place").alias("n_windows"), F.count_distinct(F.when(literal, F.col("place"))).alias("n_literal"), F.min("place").alias("first_place"))
    out = out.join(consistent, ["id", "item"], "left").withColumn("n_consistent", F.coalesce("n_consistent", F.lit(0).cast("long"))).filter("n_literal + n_consistent > 0")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "n_windows", "n_literal", "n_consistent", "first_place")


def _lengths(window: int, literals: int, units: np.ndarray):
    """Counts of template words and of words of texts without a usual window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Templates([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], units)
            lone = t.lone(window, literals)
            for row, exact in ((t.tokens, False), (t.words, True)):
                n = np.unique(row.sizes[lone])
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(np.full(len(n), exact))], ["n", "exact"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """`docs` without those that share a passage with an item; rows with a null id stay."""
    gone = written(leaks(docs, benchmark, id_col=id_col, text_col=text_col, **kwargs).select(id_col).distinct(), "leaks")
    return docs.join(sized(gone, F.octet_length(F.col(id_col).cast("string")) + 16), id_col, "left_anti")

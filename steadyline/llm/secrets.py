"""Secrets in texts: patterns, and character Markov models for the rest.

Two models are trained from labelled samples. Ordinary identifiers: a chain of
the kinds of three characters before (capital, small letter, digit), from long
runs of the corpus and from forms of identifiers, dates and versions with the
corpus's word lengths; and a chain of letters in words, from all words of the
corpus, where a word may also be one that the corpus lacks. Random strings:
characters of each usual alphabet, from the values that the patterns found and
from drawn strings. A run of identifier characters is judged in parts between
its separators: a stretch of parts is a secret if the log-likelihood ratio is
high enough, in all and per character, and it has a letter. UUIDs are names by
their standard and are not judged. Counts are summed in Spark; the driver gets
tables of fixed size.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "markov")
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
SEPARATORS = "+/_=-"
PART = re.compile(rf"[^{SEPARATORS}]+")
UUID = re.compile(r"(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])", re.IGNORECASE)
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CHARACTERS = UPPER + LOWER + DIGITS
#: Alphabets of random strings, one part (base 64 is base 62 with signs that separate parts).
ALPHABETS = (DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", LOWER + "234567", DIGITS + LOWER, DIGITS + UPPER, CHARACTERS)
FITS = tuple(re.compile(f"[{x}]+") for x in ALPHABETS)
#: Nats per character by which the random model must win, and in all.
PER_CHAR, IN_ALL = 0.2, 4.0
#: Nats that speak for an ordinary part beforehand.
PRIOR = 1.0
#: Drawn samples: random strings of each alphabet, and identifiers.
DRAWN, SEED = 4000, 11
#: The chance that a word of an identifier is none of the corpus's.
UNKNOWN = 0.1
KINDS_OF = str.maketrans(CHARACTERS, "0" * 26 + "1" * 26 + "2" * 10)
WORD = re.compile("[A-Za-z]{2,}")
#: Words, capitals and numbers inside an identifier.
PIECE = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
LONGEST = 24
WORDS_AT_ONCE = 200_000
N_KINDS, N_LETTERS, N_CHARS = 4**4, 27**3, len(ALPHABETS) * len(CHARACTERS)


class Models(NamedTuple):
    """Log probabilities. kinds: of a kind after three (3: the edge); letters: of a letter after two (26: the edge); chars: of a character in each alphabet."""

    kinds: np.ndarray
    letters: np.ndarray
    chars: np.ndarray


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, in code points."""
    spans = []
    if ("=" in text or ":" in text) and KEYWORD.search(text):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _kind_cells(part: str) -> list[int]:
    k = [3, 3, 3, *map(int, part.translate(KINDS_OF))]
    return [((k[i] * 4 + k[i + 1]) * 4 + k[i + 2]) * 4 + k[i + 3] for i in range(len(part))]


def _letter_cells(word: str) -> list[int]:
    c = [26, 26, *(b - 97 for b in word.lower().encode("ascii"))]
    return [(c[i] * 27 + c[i + 1]) * 27 + c[i + 2] for i in range(len(word))]


def _char_cells(value: str) -> list[int]:
    which = next(i for i, x in enumerate(FITS) if x.fullmatch(value))
    return [which * len(CHARACTERS) + CHARACTERS.index(c) for c in value]


def identifiers(lengths: np.ndarray, n: int, seed: int) -> Iterator[str]:
    """Labelled ordinary samples, as strings of kinds (`A`, `a`, `0`): words in the usual cases with numbers, dates, times, versions and models. lengths: shares of word lengths."""
    rng = random.Random(seed)
    sizes = range(len(lengths))
    fixed = ("00000000", "00000000000000", "00000000A000000", "00000000A000000A", "0000A00", "00000000A000000000A", "0000000000", "0000000000000", "0000000000000000")
    for _ in range(n):
        style = rng.choice(("lower", "upper", "camel", "camel", "pascal", "pascal", "date", "version"))
        if style == "date":
            yield rng.choice(fixed)
            continue
        if style == "version":
            yield rng.choice("Aa") * rng.randint(1, 4) + "0" * rng.randint(1, 5) + rng.choice(("", "a", "aa", "A", "Aa", "a0", "a00"))
            continue
        out = ""
        for k, size in enumerate(rng.choices(sizes, lengths, k=rng.randint(1, 4))):
            if style in ("lower", "upper"):
                out += ("a" if style == "lower" else "A") * size
            elif rng.random() < 0.1:
                out += "A" * rng.randint(2, 4)  # an acronym
            else:
                out += ("a" if style == "camel" and k == 0 else "A") + "a" * (size - 1)
            if rng.random() < 0.3:
                out += "0" * rng.choice((1, 1, 1, 2, 2, 3, 4))
        yield out


def _chain(counts: np.ndarray, weight: float) -> np.ndarray:
    """Log probabilities along the last axis; each order is smoothed by the one below, single ones by equal shares."""
    below = np.full(counts.shape[-1], 1 / counts.shape[-1])
    for order in range(counts.ndim):
        own = counts.sum(axis=tuple(range(counts.ndim - 1 - order)))
        below = own + weight * below
        below = below / below.sum(axis=-1, keepdims=True)
    return np.log(below)


def _blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text without its spans, each a blank; spans of different kinds may overlap."""
    kept, at = [], 0
    for start, end, _ in sorted(spans):
        kept.append(text[at : max(at, start)])
        at = max(at, end)
    return " ".join([*kept, text[at:]])


def _letters_of(words: Counter) -> np.ndarray:
    """Counts of letters after two others in words, each as often as it counts."""
    codes = np.frombuffer("".join(f"{{{{{w}" for w in words).lower().encode("ascii"), np.uint8).astype(np.int64) - 97  # "{" is the edge, 26
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    cells = (codes[:-2] * 27 + codes[1:-1]) * 27 + codes[2:]
    inside = codes[2:] < 26
    return np.bincount(cells[inside], times[2:][inside], N_LETTERS).astype(np.int64)


def _samples(text: str, words: Counter) -> Counter:
    """Cells that one text adds to: kinds of long runs, characters of the values that patterns find. Its different words go to `words`."""
    spans = base_spans(text)
    cells: Counter = Counter()
    for start, end, kind in spans:
        value = ASSIGN.match(text[start:end])[2] if kind == "assign" else text[start:end]
        for part in PART.findall(value.replace(".", "-")):
            if len(part) >= SHORTEST:
                cells.update(N_KINDS + N_LETTERS + LONGEST + c for c in _char_cells(part))
    rest = _blanked(text, spans)
    words.update(set(WORD.findall(rest)))
    for run in CANDIDATE.findall(rest):
        for part in PART.findall(run):
            cells.update(_kind_cells(part))
    return cells


def train(docs: DataFrame, text_col: str = "text") -> Models:
    """The models, from whole texts of all rows.

    Repeated rows count each time; null and empty texts count nothing. The
    corpus's long runs weigh as much as the drawn identifiers at most. Without
    rows only the drawn samples speak, with words of five letters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(N_KINDS + N_LETTERS + LONGEST + N_CHARS, np.int64)
        words: Counter = Counter()

        def emptied() -> None:
            if words:
                counts[N_KINDS : N_KINDS + N_LETTERS] += _letters_of(words)
                sizes = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), LONGEST) - 1
                np.add.at(counts, N_KINDS + N_LETTERS + sizes, np.fromiter(words.values(), np.int64, len(words)))
                words.clear()

        for batch in batches:
            for text in batch.column(0):
                own = _samples(text.as_py(), words)
                if own:
                    counts[np.fromiter(own.keys(), np.int64, len(own))] += np.fromiter(own.values(), np.int64, len(own))
                if len(words) > WORDS_AT_ONCE:
                    emptied()
        emptied()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["cell", "n"])

    found = docs.select(F.col(text_col).alias("text")).filter("text is not null").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(N_KINDS + N_LETTERS + LONGEST + N_CHARS)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    seen, letters, lengths, chars = np.split(counts, np.cumsum([N_KINDS, N_LETTERS, LONGEST]))
    if not lengths.any():
        lengths[4] = 1
    kinds = np.zeros(N_KINDS)
    for own in identifiers(np.r_[0, lengths / lengths.sum()], DRAWN, SEED):
        np.add.at(kinds, _kind_cells(own), 1)
    kinds += seen * min(1.0, kinds.sum() / max(1.0, seen.sum()))
    rng = random.Random(SEED)
    for k, letters_of in enumerate(ALPHABETS):
        drawn = "".join(rng.choices(letters_of, k=DRAWN * SHORTEST))
        np.add.at(chars, [k * len(CHARACTERS) + CHARACTERS.index(c) for c in drawn], 1)
    chars = chars.reshape(len(ALPHABETS), -1)
    with np.errstate(divide="ignore"):
        chars = np.log(chars / chars.sum(axis=1, keepdims=True))
    return Models(_chain(kinds.reshape(4, 4, 4, 4), 2.0).ravel(), _chain(letters.reshape(27, 27, 27), 20.0).ravel(), chars.ravel())


def log_ratio(part: str, models: Models) -> float:
    """By how many nats random strings of the likeliest alphabet beat ordinary identifiers; digits alone tell nothing."""
    if part.isdigit():
        return 0.0
    ordinary = float(models.kinds[_kind_cells(part)].sum())
    for piece in PIECE.findall(part):
        if piece.isdigit():
            ordinary -= len(piece) * math.log(10)
        else:
            known = math.log(1 - UNKNOWN) + float(models.letters[_letter_cells(piece)].sum())
            ordinary += float(np.logaddexp(known, math.log(UNKNOWN) - len(piece) * math.log(26)))
    places = np.array([CHARACTERS.index(c) for c in part])
    return max(float(models.chars[k * len(CHARACTERS) + places].sum()) for k, x in enumerate(FITS) if x.fullmatch(part)) - math.log(len(FITS)) - PRIOR - ordinary


def random_stretches(word: str, models: Models) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run of identifier characters, whole parts each."""
    found: list[tuple[int, int]] = []
    total = best = 0.0
    start = end = 0

    def close() -> None:
        if end - start >= SHORTEST and best > IN_ALL and best > PER_CHAR * (end - start) and any(map(str.isalpha, word[start:end])):
            found.append((start, end))

    for m in PART.finditer(word):
        ratio = log_ratio(m[0], models)
        if total <= 0:
            total, start = 0.0, m.start()
        total += ratio
        if total > best:
            best, end = total, m.end()
        elif total <= max(0.0, best - IN_ALL):
            close()
            total = best = 0.0
            start = end = m.end()
    close()
    return found


def named(word: str, start: int, end: int) -> bool:
    """Whether a stretch is a UUID, or lies in one."""
    return any(m.start() <= start and end <= m.end() for m in UUID.finditer(word))


def find_spans(text: str, models: Models, memory: dict[str, list[tuple[int, int]]]) -> tuple[list, list]:
    """(base spans, all spans), each in order of start, then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    taken = np.array([s[:2] for s in base]).reshape(-1, 2)
    more = []
    for m in CANDIDATE.finditer(text):
        if len(base) and ((taken[:, 0] < m.end()) & (taken[:, 1] > m.start())).any():
            continue
        word = m[0]
        hits = memory.get(word)
        if hits is None:
            hits = [(s, e) for s, e in random_stretches(word, models) if not named(word, s, e)]
            if len(word) <= 64:
                if len(memory) > 200_000:
                    memory.clear()
                memory[word] = hits
        more += [(m.start() + s, m.start() + e, "markov") for s, e in hits]
    return base, sorted(base + more, key=order)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secrets(docs: DataFrame, models: Models, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """All columns of `docs`, and `into`: a struct (n_assign, n_access, n_hex, n_markov, base_sha256, spans).

    spans: kind:start:end in code points, the end exclusive, in order of start,
    then kind. The models only judge what no pattern's span touches. A null text
    counts as empty and has none. An input column named `into` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # a table of fixed size
    kept = [c for c in docs.columns if c != into]
    fields = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_markov", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[tuple[int, int]]] = {}
        for batch in batches:
            rows = []
            for text in batch.column(0).field(text_col):
                base, spans = find_spans(text.as_py() or "", shared.value, memory)
                kinds = [s[2] for s in spans]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            found = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["row", "secrets"])

    rows = docs.select(F.struct(*kept).alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {row_type}, secrets struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_markov:bigint,base_sha256:string,spans:string>")
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("secrets").alias(into))

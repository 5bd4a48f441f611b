"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton finds the tokens that begin at each place of a word.
The encoder takes the longest one that is compatible with the token before it,
and steps back where none is. Two tokens are compatible if merging by rank
would leave the border between them alone; a sequence whose neighbours are all
compatible is the one that merging gives, so no merge is ever carried out.
Decoding copies each token's text from one buffer by its offset and length.

The vocabulary is of the kind with word ends: words are lower-cased letters,
digits or runs of other signs, spelled in the 256 signs for bytes, and the last
sign of a word counts as another symbol.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, model, release

END = "</w>"
#: Words, and chunks between blanks, in each half of a worker's memory of their ids.
REMEMBERED = 80_000
#: Pairs of tokens in each half of its memory of compatible pairs.
PAIRS_REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
#: Ids decoded at once.
DECODED_AT_ONCE = 1 << 18
#: Fixed values of the tokenizer files: what their patterns mean by a blank.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Fixed values, found by encoding every code point: letters and numbers to the `regex` module that are none in the library's
#: older Unicode tables, and capitals that the library lower-cases and Python 3.13 does not.
NEWER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a "
    "11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0x3A3: 0x3C3, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def byte_signs() -> list[str]:
    """The printable sign for each byte: itself, or the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def _ranges(points: list[int]) -> str:
    """A character class of code points in rising order."""
    cuts = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = [points[0], *(points[i + 1] for i in cuts)], [*(points[i] for i in cuts), points[-1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


@lru_cache(maxsize=1)
def word_patterns() -> tuple[regex.Pattern, frozenset[str], regex.Pattern]:
    """(the words of the tokenizer files, letters and numbers newer than the library's Unicode, the words where there are such)."""
    usual = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANKS}\p{{L}}\p{{N}}]+")
    points = [c for a, b in (x.split("-") for x in NEWER.split()) for c in range(int(a, 16), int(b, 16) + 1)]
    own = _ranges(points)
    letters, numbers = rf"(?![{own}])\p{{L}}", rf"(?![{own}])\p{{N}}"
    return usual, frozenset(map(chr, points)), regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|(?:{letters})+|{numbers}|(?:[^{BLANKS}\p{{L}}\p{{N}}]|[{own}])+")


class Memory(dict):
    """A dict of two halves: when the younger is full it becomes the older one, and what is used of that stays."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def recall(self, key):
        """The value of a key that the younger half lacks, or None."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class WordBpe:
    """The tables of one vocabulary file. Symbols are signs; one at a word's end is moved up by 0x1000."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError(f"{path} has no BPE vocabulary with word ends")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.newer, self.words_beside_newer = word_patterns()
        self.signs = byte_signs()
        texts = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            texts[i] = text
        spaced = [t.encode() + b" " for t in texts]
        self.buffer = np.frombuffer(b"".join(spaced), np.uint8)
        self.offsets = np.cumsum([0, *map(len, spaced)])

        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            whole = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = r
            self.parts[whole], self.made[whole] = (vocab[a], vocab[b]), r
            if max(self.made.get(vocab[a], -1), self.made.get(vocab[b], -1)) >= r:
                raise ValueError("a merge uses a token that a later merge makes")
        self.known = Memory(PAIRS_REMEMBERED)
        self.length: dict[int, int] = {}
        spelled = {i: self._symbols(t) for t, i in vocab.items()}
        by_symbols = {s: i for i, s in spelled.items() if self._arises(i)}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for s, i in by_symbols.items():
            self.automaton.add_word(s, (len(s), i))
            self.length[i] = len(s)
            self.shorter[i] = next((by_symbols[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_symbols), -1)
        self.automaton.make_automaton()
        self.words_seen, self.chunks_seen = Memory(REMEMBERED), Memory(REMEMBERED)

    @staticmethod
    def _symbols(text: str) -> str:
        if text.endswith(END) and text != END:
            text = text[: -len(END)]
            return text[:-1] + chr(ord(text[-1]) + 0x1000)
        return text

    def _arises(self, token: int) -> bool:
        """Whether merging the token's own text ever gives the token."""
        parts = self.parts.get(token)
        return parts is None or all(map(self._arises, parts)) and self._untouched(*parts, self.made[token])

    def _untouched(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of a rank under `before` crosses the border between two tokens.

        The merges inside both are undone from the last to the first. Whenever
        two tokens met at the border, a merge of theirs would have come first if
        its rank was under that of the merge undone; of equal ranks the left one
        comes first, which is the border's when the right token is undone.
        """
        while self.rank.get((left, right), before) >= before:
            a, b = self.made.get(left, -1), self.made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.parts[left][1]
            else:
                before, right = b + 1, self.parts[right][0]
        return False

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        found = self.known.recall(pair)
        if found is None:
            found = self._untouched(left, right, len(self.rank))
            self.known.keep(pair, found)
        return found

    def word(self, symbols: str) -> list[int]:
        """The ids of one word, given as symbols."""
        length, shorter, known = self.length, self.shorter, self.known
        longest = [-1] * len(symbols)
        for end, (n, token) in self.automaton.iter(symbols):
            longest[end + 1 - n] = token  # a later match from the same place is longer
        ids: list[int] = []
        place, last, closed = 0, -1, set()
        token = longest[0]
        while place < len(symbols):
            while token >= 0:
                if place + length[token] not in closed:
                    if last < 0:
                        break
                    fits = known.get(last << 32 | token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                last, place = token, place + length[token]
                token = longest[place] if place < len(symbols) else -1
            else:  # nothing fits here: no later sequence may end here
                closed.add(place)
                token = ids.pop()
                last = ids[-1] if ids else -1
                place -= length[token]
        return ids

    def word_ids(self, word: str) -> bytes:
        ids = self.words_seen.get(word)
        if ids is None:
            ids = self.words_seen.recall(word)
        if ids is None:
            signs = word if word.isascii() and word.isprintable() else "".join([self.signs[b] for b in word.encode()])
            ids = struct.pack(f"<{len(found)}I", *found) if (found := self.word(signs[:-1] + chr(ord(signs[-1]) + 0x1000))) else b""
            if len(word) <= LONGEST_REMEMBERED:
                self.words_seen.keep(word, ids)
        return ids

    def chunk(self, chunk: bytes) -> bytes:
        """The ids of a text without ASCII blanks, as little-endian unsigned 32-bit integers."""
        text = chunk.decode()
        if text.isascii():
            if text.isalpha():
                return self.word_ids(text.lower())
            if not self.split_special or not self.split_special.search(text):
                return b"".join([self.word_ids(w) for w in self.words.findall(text.lower())])
        out = []
        for at, piece in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if at % 2:
                out.append(struct.pack("<I", self.special[piece]))
            else:
                piece = unicodedata.normalize("NFC", piece).translate(SMALL).lower()
                words = self.words if self.newer.isdisjoint(piece) else self.words_beside_newer
                out += [self.word_ids(w) for w in words.findall(piece)]
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text, as little-endian unsigned 32-bit integers."""
        seen, out = self.chunks_seen, []
        for chunk in text.split():
            ids = seen.get(chunk)
            if ids is None:
                ids = seen.recall(chunk)
            if ids is None:
                ids = self.chunk(chunk)
                if len(chunk) <= LONGEST_REMEMBERED:
                    seen.keep(chunk, ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The tokens' texts with a blank between them, in pieces."""
        every = np.frombuffer(ids, "<u4").astype(np.int64)
        for first in range(0, len(every), DECODED_AT_ONCE):
            some = every[first : first + DECODED_AT_ONCE]
            starts, sizes = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            if first + len(some) == len(every):
                sizes[-1] -= 1  # no blank after the last
            shift = starts - (np.cumsum(sizes) - sizes)
            yield self.buffer[np.arange(sizes.sum()) + np.repeat(shift, sizes)].tobytes()


def tables(path: str) -> WordBpe:
    """One copy for each worker process, while it needs no other model."""
    return model(WordBpe, path)


def tokenized(docs: DataFrame, path: str, text_col: str = "text", into: str = "tokens") -> DataFrame:
    """All columns of `docs`, and `into`: a struct (n_tokens, ids, decoded_sha256).

    ids: binary, little-endian unsigned 32-bit integers. decoded_sha256 is of
    the text that the ids decode to. A null or empty text has no tokens and
    decodes to the empty text. An input column named `into` is replaced. Only
    texts go to Python, a batch at a time; rows do not move between tasks.
    """
    kept = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(path)
        for batch in in_pieces(batches):
            ids, digests = [], []
            for text in batch.column(0).field(text_col).cast(pa.binary()):
                ids.append(bpe.encode(text.as_py() or b""))
                digest = hashlib.sha256()
                for piece in bpe.decode(ids[-1]):
                    digest.update(piece)
                digests.append(digest.hexdigest())
            tokens = pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(digests)], ["n_tokens", "ids", "decoded_sha256"])
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens], ["row", "tokens"])
        release()

    rows = docs.select(F.struct(*kept).alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {row_type}, tokens struct<n_tokens:bigint,ids:binary,decoded_sha256:string>")
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("tokens").alias(into))

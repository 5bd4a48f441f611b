"""Sums over all segmentations of words into the pieces of a fixed vocabulary.

The recursions run in log space over many words of one length at once. An
Aho-Corasick automaton finds the pieces; all words that have a piece at the same
span (i, j) are updated together.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import chain

import ahocorasick
import numpy as np
import sentencepiece

from .common import model

START = "▁"
#: Words of one length that are handled together; bounds the arrays.
WORDS_AT_ONCE = 20_000
#: Cells (words x places) of one round of the recursion.
CELLS = 400_000


class Pieces:
    """The ordinary pieces of a sentencepiece model by text, and its 256 byte pieces for anything else."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.size = len(names)
        self.byte_ids = np.full(256, -1)
        self.ids: dict[str, int] = {}
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(re.fullmatch(r"<0x(\w\w)>", name)[1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[name] = i
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, i << 8 | len(name))
        self.automaton.make_automaton()
        # The file's scores are minus the rank of a piece; frequencies fall about as 1 / rank.
        own = np.array([sp.get_score(i) for i in range(self.size)])
        prior = 1 / (10.0 - np.minimum(own, 0))
        prior[self.byte_ids] = 1e-4 * prior.max()
        prior[[i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i)]] = 0
        self.prior = prior / prior.sum()

    def groups(self, words: list[str]):
        """(places of the words in the list, length, spans) for words of equal length."""
        by_length: dict[int, list[int]] = defaultdict(list)
        for at, w in enumerate(words):
            by_length[len(w)].append(at)
        for n, every in by_length.items():
            step = max(1, min(WORDS_AT_ONCE, CELLS // (n + 1)))
            for first in range(0, len(every), step):
                yield every[first : first + step], n

    def spans(self, words: list[str], n: int):
        """Spans (i, j, rows, ids) in order of j, then i: the words' rows in which it is a piece; byte ids for a character that is none."""
        flat = np.fromiter(chain.from_iterable(self.automaton.iter("\n".join(words))), np.int64)
        ends, values = flat[::2].astype(np.int32), flat[1::2].astype(np.int32)
        rows = ends // (n + 1)
        j, size = ends - rows * (n + 1) + 1, values & 0xFF
        # One number for (j, i), small for most words: sorting 16 bits takes a pass or two.
        key = j.astype(np.int64) * (n + 1) + (j - size)
        if (n + 1) ** 2 <= 1 << 16:
            key = key.astype(np.uint16)
        order = np.argsort(key, kind="stable")
        key, rows, ids = key[order], rows[order], (values >> 8)[order]
        found = []
        single = np.zeros((len(words), n), bool)
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            j, i = divmod(int(key[s]), n + 1)
            found.append((i, j, rows[s:e], ids[s:e]))
            if j - i == 1:
                single[rows[s:e], i] = True
        for r, at in zip(*np.nonzero(~single), strict=True):
            found.append((int(at), int(at) + 1, np.array([r]), self.byte_ids[list(words[r][at].encode())][None]))
        return sorted(found, key=lambda x: (x[1], x[0]))

    def forward(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        """logs: (pieces, k), log probabilities of k models. (words, k): log of the sum over all segmentations."""
        out = np.zeros((len(words), logs.shape[1]))
        for places, n in self.groups(words):
            own = [words[p] for p in places]
            out[places] = _alphas(self.spans(own, n), len(own), n, logs)[n]
        return out

    def expected(self, words: list[str], weights: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, each word counted by its weight. logs: (pieces, 1)."""
        out = np.zeros(self.size)
        for places, n in self.groups(words):
            own, weight = [words[p] for p in places], weights[places]
            spans = self.spans(own, n)
            alpha = _alphas(spans, len(own), n, logs)
            beta = np.full((n + 1, len(own), 1), -np.inf)
            beta[n] = 0
            for i, j, rows, ids in sorted(spans, key=lambda x: -x[0]):
                beta[i, rows] = np.logaddexp(beta[i, rows], _log(logs, ids) + beta[j, rows])
            for i, j, rows, ids in spans:
                uses = np.exp(alpha[i, rows] + _log(logs, ids) + beta[j, rows] - alpha[n, rows])[:, 0] * weight[rows]
                np.add.at(out, ids, uses if ids.ndim == 1 else uses[:, None])
        return out


def _log(logs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return logs[ids] if ids.ndim == 1 else logs[ids].sum(axis=1)


def _alphas(spans, words: int, n: int, logs: np.ndarray) -> np.ndarray:
    """(places, words, k): log of the sum over all segmentations up to each place."""
    alpha = np.full((n + 1, words, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for i, j, rows, ids in spans:
        alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + _log(logs, ids))
    return alpha


def pieces(path: str) -> Pieces:
    """One copy for each worker process, while it needs no other model."""
    return model(Pieces, path)


def smoothed(expected: np.ndarray, prior: np.ndarray, strength: float, extra: float = 0.0) -> np.ndarray:
    """Log probabilities of pieces: expected uses shrunk to the prior. extra: uses of a symbol beside the pieces."""
    with np.errstate(divide="ignore"):
        return np.log((expected + strength * prior) / (expected.sum() + strength + extra))

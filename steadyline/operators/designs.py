"""Evaluation of designed experiments from their rows: fractions whose defining relation is found, and second-order models.

Rows are reduced to one per setting of the factors (count, mean, spread) before
anything else, so the pure error comes with the same shuffle. Rows with a null
in the response or a factor are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyline.functions.numeric import f_sf, t_cdf, t_ppf

from .lineage import cut

#: Most factors of a fraction, whose settings and terms are 2 to their power, and of a second-order model.
FRACTION_FACTORS, SURFACE_FACTORS = 8, 6


def settings(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """(factors, n, mean, within): a row per setting, with the sum of squares about its mean."""
    value = F.col(y).cast("double")
    rows = df.select(*factors, value.alias("_y")).na.drop()
    return rows.groupBy(*factors).agg(F.count("*").alias("n"), F.avg("_y").alias("mean"), (F.var_pop("_y") * F.count("*")).alias("within"))


# -- Fractions --------------------------------------------------------------------------


@dataclass
class Fraction:
    """Settings as bits (1 is high), and the words that are constant over them: (word, sign)."""

    factors: list[str]
    n: np.ndarray
    mean: np.ndarray
    within: float
    cells: np.ndarray
    words: dict[int, int]

    def label(self, term: int) -> str:
        return ":".join(f for i, f in enumerate(self.factors) if term >> i & 1)

    def order(self, term: int) -> tuple[int, str]:
        return term.bit_count(), self.label(term)

    def sign(self, term: int, cell: int) -> int:
        """Product of the term's factors in a setting: minus for an odd number of lows."""
        return -1 if (term & ~cell).bit_count() % 2 else 1


def fraction(df: DataFrame, y: str, factors: Sequence[str]) -> Fraction:
    """The regular two-level fraction that the rows form; factors over 0 are high.

    The settings of a regular fraction are one setting plus a space over two
    elements; a word is constant where it is orthogonal to that space. Settings
    that fill no such space, or a factor that stays the same, are refused.
    """
    factors = list(factors)
    if not 3 <= len(factors) <= FRACTION_FACTORS:
        raise ValueError(f"3 to {FRACTION_FACTORS} factors, not {len(factors)}")
    bits = df.select(F.col(y).alias("_y"), *(F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(factors))).na.drop()
    bits = bits.select("_y", sum(F.when(F.col(f"_{i}") > 0, 1 << i).otherwise(0) for i in range(len(factors))).alias("cell"))
    rows = sorted(settings(bits, "_y", ["cell"]).collect(), key=lambda r: r["cell"])  # 2 to the power of the factors at most
    cells = np.array([r["cell"] for r in rows], np.int64)
    basis: list[int] = []
    for c in cells.tolist():
        step = c ^ int(cells[0])
        for b in basis:
            step = min(step, step ^ b)
        if step:
            basis.append(step)
    if len(basis) < 2 or len(cells) != 1 << len(basis):
        raise ValueError(f"{len(cells)} settings are no regular fraction")
    words = [w for w in range(1, 1 << len(factors)) if not any((w & b).bit_count() % 2 for b in basis)]
    if any(w.bit_count() == 1 for w in words):
        raise ValueError("a factor has the same level everywhere")
    out = Fraction(factors, np.array([r["n"] for r in rows], float), np.array([r["mean"] for r in rows]), sum(r["within"] for r in rows), cells, {})
    out.words = {w: out.sign(w, int(cells[0])) for w in words}
    return out


def defining_relation(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """A row per word of the defining relation: word, sign, length, and resolution (the shortest word's length). A full factorial has none."""
    found = fraction(df, y, factors)
    shortest = min((w.bit_count() for w in found.words), default=None)
    rows = [(found.label(w), s, w.bit_count(), shortest) for w, s in found.words.items()]
    return df.sparkSession.createDataFrame(rows, "word string, sign int, length int, resolution int")


def fraction_effects(df: DataFrame, y: str, factors: Sequence[str], alpha: float = 0.05, max_order: int = 3) -> DataFrame:
    """A row per contrast: term (the shortest that it may be), aliases up to `max_order` with signs, effect, f, p and margin.

    Effects are of means of settings, whose sizes may differ. With replicates f,
    p and margin go by the pure error; without, f and p are null and the margin
    is Lenth's.
    """
    d = fraction(df, y, factors)
    contrasts, seen = [], set(d.words)
    for term in sorted(range(1, 1 << len(d.factors)), key=d.order):
        if term in seen:
            continue
        others = {term ^ w: s for w, s in d.words.items()}
        seen |= {term, *others}
        names = [("-" if others[o] < 0 else "") + d.label(o) for o in sorted(others, key=d.order) if o.bit_count() <= max_order]
        contrasts.append((d.label(term), " ".join(names), 2 * float(np.mean([d.sign(term, c) * m for c, m in zip(d.cells.tolist(), d.mean, strict=True)]))))
    size = np.abs([e for *_, e in contrasts])
    dof = int(d.n.sum()) - len(d.cells)
    if dof > 0:
        error = float(np.sqrt(4 * d.within / dof * (1 / d.n).sum())) / len(d.cells)
        margin = t_ppf(1 - alpha / 2, dof) * error
    else:
        first = 1.5 * np.median(size)
        error, margin = None, t_ppf(1 - alpha / 2, len(size) / 3) * 1.5 * float(np.median(size[size < 2.5 * first])) if first > 0 else None
    tested = [(None, None) if not error else ((e / error) ** 2, f_sf((e / error) ** 2, 1, dof)) for *_, e in contrasts]
    rows = [(*c, *fp, margin) for c, fp in zip(contrasts, tested, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, aliases string, effect double, f double, p double, margin double")


# -- Second-order models ----------------------------------------------------------------


@dataclass
class Surface:
    """A fitted second-order model about the factors' means."""

    factors: list[str]
    centre: np.ndarray
    terms: list[tuple[str, str, tuple[int, ...]]]
    n: int
    settings: int
    mean: float
    total: float
    pure: float
    products: np.ndarray
    towards: np.ndarray
    term_means: np.ndarray

    def __post_init__(self):
        scale = np.sqrt(np.diag(self.products))
        if not (scale > 0).all() or np.linalg.matrix_rank(self.products / np.outer(scale, scale), hermitian=True, tol=1e-9) < len(scale):
            raise ValueError("some terms cannot be told apart: three levels of each factor are needed")
        self.root = np.linalg.cholesky(self.products)
        self.sequential = np.linalg.solve(self.root, self.towards) ** 2
        self.slopes = np.linalg.solve(self.products, self.towards)
        self.dof = self.n - len(self.terms) - 1
        self.residual = max(0.0, self.total - float(self.sequential.sum()))
        if self.dof < 1:
            raise ValueError(f"{self.n} rows are too few for {len(self.terms) + 1} terms")

    def in_units(self) -> np.ndarray:
        """The matrix that turns (mean, slopes about the centre) into the constant and slopes in the factors' own units."""
        p, c, at = len(self.terms), self.centre, {places: i + 1 for i, (_, _, places) in enumerate(self.terms)}
        out = np.eye(p + 1)
        out[0, 1:] = -self.term_means
        for places, i in at.items():
            out[0, i] += (-1) ** len(places) * np.prod(c[list(places)])
            if len(places) == 2:
                for a, b in (places, places[::-1]):
                    out[at[(a,)], i] -= c[b]
        return out

    def curvature(self) -> np.ndarray:
        out = np.zeros((len(self.factors),) * 2)
        for (_, _, places), b in zip(self.terms, self.slopes, strict=True):
            if len(places) == 2:
                out[places] += b / 2
                out[places[::-1]] += b / 2
        return out


def surface(df: DataFrame, y: str, factors: Sequence[str]) -> Surface:
    """Sums of products of all terms about their means, from settings: one shuffle of the rows and two aggregates over settings."""
    factors = list(factors)
    if not 1 <= len(factors) <= SURFACE_FACTORS:
        raise ValueError(f"1 to {SURFACE_FACTORS} factors, not {len(factors)}")
    k = len(factors)
    kinds = [("linear", (i,)) for i in range(k)] + [("square", (i, i)) for i in range(k)] + [("cross", x) for x in combinations(range(k), 2)]
    terms = [(kind, "^2".join([factors[at[0]], ""]) if kind == "square" else ":".join(factors[i] for i in at), at) for kind, at in kinds]
    cells = cut(settings(df.select(F.col(y).alias("_y"), *(F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(factors))), "_y", [f"_{i}" for i in range(k)]))
    n = F.col("n")
    first = cells.agg(F.sum("n"), F.count("*"), F.sum("within"), F.sum(n * F.col("mean")) / F.sum("n"), *(F.sum(n * F.col(f"_{i}")) / F.sum("n") for i in range(k))).first()
    if not first[0]:
        raise ValueError("no rows")
    centre = np.array(first[4:], float)
    from_centre = [F.col(f"_{i}") - F.lit(float(c)) for i, c in enumerate(centre)]
    columns = []
    for _, _, places in terms:
        column = from_centre[places[0]]
        columns.append(column * from_centre[places[1]] if len(places) == 2 else column)
    rows = cells.select("n", (F.col("mean") - F.lit(float(first[3]))).alias("y"), *(c.alias(f"t{i}") for i, c in enumerate(columns)))
    p = len(terms)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.agg(
        *(F.sum(n * F.col(f"t{i}")) for i in range(p)), *(F.sum(n * F.col(f"t{i}") * F.col("y")) for i in range(p)), F.sum(n * F.col("y") * F.col("y")), *(F.sum(n * F.col(f"t{i}") * F.col(f"t{j}")) for i, j in pairs)
    ).first()
    count, at = int(first[0]), np.array(sums[:p], float)
    products = np.zeros((p, p))
    for (i, j), v in zip(pairs, sums[2 * p + 1 :], strict=True):
        products[i, j] = products[j, i] = v - at[i] * at[j] / count
    return Surface(factors, centre, [(name, kind, places) for kind, name, places in terms], count, first[1], first[3], first[2] + sums[2 * p], first[2], products, np.array(sums[p : 2 * p], float), at / count)


def surface_anova(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Rows linear, square, cross (each after those before it), residual, lack_of_fit and pure_error: source, df, ss, f, p.

    The terms are tested against the residual, lack of fit against the pure
    error; it is left out where no setting is repeated or none is left over.
    """
    s = surface(df, y, factors)
    rows = []
    error = s.residual / s.dof
    for kind in ("linear", "square", "cross"):
        own = [v for v, (_, k, _) in zip(s.sequential, s.terms, strict=True) if k == kind]
        if own:
            f = float(sum(own)) / len(own) / error
            rows.append((kind, len(own), float(sum(own)), f, f_sf(f, len(own), s.dof)))
    rows.append(("residual", s.dof, s.residual, None, None))
    free = s.n - s.settings
    if free > 0 and s.dof > free and s.pure > 0:
        lack = max(0.0, s.residual - s.pure)
        f = lack / (s.dof - free) / (s.pure / free)
        rows += [("lack_of_fit", s.dof - free, lack, f, f_sf(f, s.dof - free, free)), ("pure_error", free, s.pure, None, None)]
    return df.sparkSession.createDataFrame(rows, "source string, df long, ss double, f double, p double")


def surface_terms(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """A row per term in the factors' own units: term, kind, coefficient, se, t, p."""
    s = surface(df, y, factors)
    turn = s.in_units()
    spread = np.zeros_like(turn)
    spread[0, 0], spread[1:, 1:] = 1 / s.n, np.linalg.inv(s.products)
    values = turn @ np.r_[s.mean, s.slopes]
    errors = np.sqrt(np.diag(turn @ spread @ turn.T) * s.residual / s.dof)
    names = [("constant", "constant"), *((name, kind) for name, kind, _ in s.terms)]
    rows = [(*name, float(b), float(e), float(b / e), 2 * t_cdf(-abs(float(b / e)), s.dof)) for name, b, e in zip(names, values, errors, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, kind string, coefficient double, se double, t double, p double")


def stationary_point(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """A row per factor: factor, at (the stationary point), response there, curvature (an eigenvalue of the second-order part, rising), nature: maximum, minimum or saddle."""
    s = surface(df, y, factors)
    b = s.curvature()
    away = np.linalg.solve(-2 * b, s.slopes[: len(s.factors)])
    response = s.mean - float(s.term_means @ s.slopes) + float(away @ s.slopes[: len(s.factors)]) / 2
    bends = np.linalg.eigvalsh(b)
    nature = "maximum" if (bends < 0).all() else "minimum" if (bends > 0).all() else "saddle"
    rows = [(f, float(c + a), response, float(e), nature) for f, c, a, e in zip(s.factors, s.centre, away, bends, strict=True)]
    return df.sparkSession.createDataFrame(rows, "factor string, at double, response double, curvature double, nature string")

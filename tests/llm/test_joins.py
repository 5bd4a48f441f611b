"""Brute-force tests of the Jaccard join, the resampling and the divergence audit."""

import collections
import random
import re
import zlib
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyline.llm import divergence, jaccard_join, resample

from .cases import TEXTS, awkward, empty
from .test_brute import joined


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    return out


def brute_components(texts, least=90):
    sets = sets_of(texts)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    return joined(len(sets), near)


def crowd(rng, size, n, edits):
    """`size` texts of about n words around one text, each with up to `edits` of its words changed and some added."""
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n)] = "x%d" % rng.randrange(10**6)
        out.append(" ".join(w + ["tail%d" % k for k in range(rng.randint(0, edits // 2))]))
    return out


@pytest.mark.parametrize(("pivots", "block"), [(8, 256), (2, 20)])
def test_jaccard_components(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join.voronoi_links, "__defaults__", (90, pivots))
    rng = random.Random(block)
    texts = crowd(rng, 60, 100, 3) + crowd(rng, 50, 60, 4) + crowd(rng, 40, 12, 1) + crowd(rng, 12, 400, 20) + ["a b c d e f g h i j k", "a b c d e f g h i j k l", "a b c", "A B C", "a b", "a b", "a", "", None, " \n"]
    rng.shuffle(texts)
    got = jaccard_join.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in got] == [len(s) for s in sets_of(texts)]
    assert [r["component"] for r in got] == brute_components(texts)


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(5)
    for n in [*range(9, 60), 100, 333, 1000, 5000]:
        universe = rng.integers(0, 1 << 63, 2 * n, dtype=np.int64).astype(np.uint64)
        x = np.unique(universe[:n])
        own = set(jaccard_join.part_keys(x).tolist())
        # The most that may be added, taken away, or exchanged.
        for add, drop in ((n // 9, 0), (0, n // 10), ((n - n // 19) // 19, n // 19), (n // 19, n // 19)):
            y = np.unique(np.r_[x[drop:], universe[n : n + add]])
            same, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if 100 * same >= 90 * union and (add or drop):
                assert own & set(jaccard_join.part_keys(y).tolist()), (n, add, drop)


def test_blocks_and_rings_agree(spark):
    """Cells that are as one, in blocks of any size, and by pivots: the same components."""
    rng = random.Random(3)
    texts = sorted(set(crowd(rng, 150, 80, 6)))
    hashes = [jaccard_join._set_of(t.encode(), 3) for t in texts]
    sets = spark.createDataFrame([(i, bytearray(h.tobytes()), len(h)) for i, h in enumerate(hashes)], "node long, shingles binary, n long")
    cells = sets.select(F.lit(7).cast("long").alias("cell"), "node", F.col("node").alias("colour"), "n")
    want = brute_components(texts)
    whole = jaccard_join.compared_in_blocks(cells, jaccard_join._measured(cells), sets.drop("n"), 90)
    parts = jaccard_join.voronoi_links(jaccard_join.written(cells, "t"), sets.drop("n"), pivots=3)
    for links in (whole, reduce(DataFrame.union, parts)):
        assert joined(len(texts), [(r["a"], r["b"]) for r in links.collect()]) == want


def test_jaccard_edges(spark):
    got = jaccard_join.jaccard_groups(awkward(spark)).collect()
    assert len(got) == len(TEXTS) and jaccard_join.jaccard_groups(empty(spark)).count() == 0
    by = {r["doc_id"]: (r["n_shingles"], r["component"]) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (4, 4) and by[5] == (4, 4) and by[7] == (1, 7)
    assert {r["component"] for r in got if r["doc_id"] is None} == {None}
    # An id with two texts joins both; a long text with a few words more links.
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "p q r s"), (2, "p q r s"), (2, "k l m n"), (3, "k l m n"), (4, long), (5, long + " and more"), (5, long + " and more")]
    got = {r["doc_id"]: r["component"] for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def brute_features(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("piece", [50, 1_000_000])
def test_feature_checksums(monkeypatch, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["", "x" * 100 + " b " + "y" * 70 + " é日本 Zz-9"] + [" ".join("".join(rng.choice("aBc9é!-") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(100)]
    found = [[] for _ in texts]
    for text, bucket in resample.feature_buckets(*resample.word_sums([t.encode() for t in texts])):
        for a, b in zip(text.tolist(), bucket.tolist(), strict=True):
            found[a].append(b)
    assert [sorted(f) for f in found] == [sorted(brute_features(t)[1]) for t in texts]


@pytest.mark.parametrize("most", [1, 7, 50_000])
@pytest.mark.parametrize("spread", [1, 3, 10**6])
def test_cutoff(spark, most, spread):
    """Whatever may be sorted at once, and however many ties there are."""
    rng = random.Random(spread)
    rows = [(rng.randrange(spread), rng.randrange(spread), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, tie long").coalesce(1).cache()
    for k in (1, 37, 400):
        assert resample.cutoff(df, ["a", "b", "tie"], k, accuracy=20, most=most) == sorted(rows)[k - 1]


def test_resampling_edges(spark):
    target = spark.createDataFrame([(1, "plain words"), (2, None), (3, "")], "item_id long, text string")
    got = resample.resampled(awkward(spark), target, percent=50, min_words=1).collect()
    assert len(got) == len(TEXTS) and resample.resampled(empty(spark), target).count() == 0
    able = [r for r in got if r["n_words"] >= 1]
    ranks = sorted((r["rank"], -r["score"]) for r in able if r["rank"])
    assert [k for k, _ in ranks] == list(range(1, len(able) // 2 + 1)) and [s for _, s in ranks] == sorted(-r["score"] for r in able)[: len(ranks)]
    assert {(r["doc_id"], r["n_words"], r["n_features"]) for r in got} == {(i, brute_features(t)[0], len(brute_features(t)[1])) for i, t in TEXTS}
    assert all(r["rank"] is None for r in got if not r["n_words"])
    # Rows that repeat tie in all but their place, and exactly so many are drawn.
    same = spark.createDataFrame([(7, "one two three")] * 40, "doc_id long, text string")
    assert sorted(r["rank"] for r in resample.resampled(same, target.limit(0), percent=10, min_words=1).collect() if r["rank"]) == [1, 2, 3, 4]


def test_pointers_are_sorted():
    rng = random.Random(9)
    terms = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40]))) for _ in range(600)] + ["z" * 500, "z" * 500, "z" * 499, "z" * 64, "z" * 72]
    b = np.frombuffer(" ".join(terms).encode(), np.uint8)
    length = np.array([len(t) for t in terms])
    start = np.r_[0, np.cumsum(length + 1)[:-1]]
    order, first = divergence.sorted_pointers(b, start, length)
    assert [terms[i] for i in order] == sorted(terms)
    assert order.tolist() == sorted(range(len(terms)), key=lambda i: (terms[i], i))
    assert int(first.sum()) == len(set(terms))


@pytest.mark.parametrize(("shard", "slices", "block"), [(8_000_000, 4096, 256), (40, 3, 2)])
def test_divergence(spark, monkeypatch, shard, slices, block):
    monkeypatch.setattr(divergence, "SLICE", slices)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(shard)
    words = ["Aa", "aa", "bb", "cÉ", "cé", "longerthaneight", "longerthaneighty", "d"]
    rows = [(i, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", None]), rng.choice([None, "", "1 2"]) if i % 9 == 0 else " ".join(rng.choice(words[: 3 + i % 6]) for _ in range(rng.randint(1, 12)))) for i in range(90)]
    rows.append((90, "xx", "only", "!"))
    rows.append((91, "xx", "other", None))
    got = divergence.divergence(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"), min_docs=5, top=2, shard_bytes=shard).collect()
    count, docs, groups = collections.Counter(), collections.Counter(), set()
    for _, lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        count.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    want = set()
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in docs.items() if g == lang and n >= 5]
        own = sorted(s for g, s in groups if g == lang)
        total = {s: sum(count[lang, s, t] for t in kept) for s in own}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 5) // (total[s] + 5 * len(kept)) for s in own for t in kept}
        q = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in own) + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept}
        for s in own:
            pairs = sorted((-sum(abs(p[s, t] - p[o, t]) for t in kept), o) for o in own if o != s)
            terms = sorted((q[t] - p[s, t], t.encode()) for t in kept if count[lang, s, t] and p[s, t] > q[t])[:2]
            want |= {(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)} | {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms, 1)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_divergence_edges(spark):
    assert divergence.divergence(empty(spark)).count() == 0
    # Languages en and '', one source each: no pairs, and no term above the language's own share.
    assert divergence.divergence(awkward(spark), min_docs=1).count() == 0
    two = awkward(spark).withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") < 5, "a").otherwise("b")})
    got = divergence.divergence(two, min_docs=1).collect()
    assert {(r["source"], r["item"]) for r in got if r["part"] == "pair"} == {("a", "b"), ("b", "a")}
    assert next(r["item"] for r in got if r["source"] == "b" and r["rank"] == 1 and r["part"] == "term") == "long"


def test_shares_are_exact(spark):
    cases = [(0, 7), (1, 7), (6, 7), (123456789012, 987654321098765), (4 * 10**15, 8 * 10**15 + 1)]
    got = spark.createDataFrame(cases, "c long, t long").select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * r["c"] // r["t"] for r in got)

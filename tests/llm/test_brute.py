import collections
import hashlib
import math
import random
import tracemalloc
import types
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from steadyline.llm import bpe as bpe_module
from steadyline.llm import common, decontaminate, langid, lm, queries, search, secrets, simhash
from steadyline.llm.bitslice import link_runs, link_runs_twice, pairs_across
from steadyline.llm.bpe import tables
from steadyline.llm.components import components
from steadyline.llm.lattice import pieces
from tests.oracle import DATA, assert_same

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, k):
    w = text.lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def joined(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_those_of_the_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


@pytest.mark.parametrize(("k", "radius", "flips"), [(1, 2, 2), (4, 54, 30)])
@pytest.mark.parametrize("groups", [2, 90])
def test_bit_planes(k, radius, flips, groups):
    rng = np.random.default_rng(radius + groups)
    prints = rng.integers(0, 2**63, (20, k), dtype=np.int64).astype(np.uint64)[rng.integers(0, 20, 400)].copy()
    for row in prints:
        for _ in range(rng.integers(0, flips)):
            row[rng.integers(0, k)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    run, label = np.sort(rng.integers(0, groups, 400)), rng.integers(0, 3, 400)
    near = [(i, j) for i in range(400) for j in range(i) if run[i] == run[j] and sum(int(x).bit_count() for x in prints[i] ^ prints[j]) <= radius]
    a, b = link_runs(run, prints, radius)
    assert joined(400, near) == joined(400, zip(a.tolist(), b.tolist(), strict=True))
    found = [p for a, b in pairs_across(run, prints, radius, label) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert {(max(p), min(p)) for p in found} == {(i, j) for i, j in near if label[i] != label[j]}
    a, b, close = link_runs_twice(run, prints, radius, radius // 2)
    closer = [(i, j) for i, j in near if sum(int(x).bit_count() for x in prints[i] ^ prints[j]) <= radius // 2]
    assert joined(400, closer) == joined(400, zip(a[close].tolist(), b[close].tolist(), strict=True))
    assert joined(400, near) == joined(400, zip(a[~close].tolist(), b[~close].tolist(), strict=True))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)}


def test_simhash(spark, docs):
    got = queries.op3_simhash(spark, SF).toPandas().set_index("doc_id").loc[docs.index]

    def one(text):
        w = words(text)
        if not w:
            return 0
        k = min(3, len(w))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(len(w) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [one(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert got.component_id.tolist() == [docs.index[i] for i in joined(len(prints), near)]


def test_hot_groups_are_cut_without_losing_links(spark):
    rows = spark.range(300).select(F.col("id").alias("rep"), (F.col("id") * 2).alias("f0"))
    plan = simhash.exact_plan()
    whole = components(simhash.link_prints(rows, plan, plan.keys)).collect()
    cut = components(simhash.link_prints(rows, simhash.Plan(plan.words, 2, plan.keys, split=40), plan.keys)).collect()
    assert sorted(whole) == sorted(cut) and len(whole) == 299


def test_near_copies_by_similarity(spark):
    rng = random.Random(2)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)) for _ in range(40)]

    def edit(text, n):
        w = text.split()
        for at in rng.sample(range(3, 197, 6), n):
            w[at] = "zzz"
        return " ".join(w)

    texts = base + [edit(t, 2) for t in base] + [edit(t, 12) for t in base]  # 2 edits leave 0.9, 12 leave about 0.55
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_copies(rows).collect()}
    sets = [shingle_set(t.encode(), 5) for t in texts]
    near = [(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert kept == set(joined(120, near)) == set(range(40)) | set(range(80, 120))


def test_repeated_passages_count_once(spark):
    rng = random.Random(4)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared, whole = some(54), some(300)
    texts = [f"{some(104)} {' '.join([shared] * 30)}" for _ in range(6)]  # sets of similarity 0.2 and less
    texts += [whole, f"{whole} {' '.join(whole.split()[:50] * 30)}"]  # sets that are nearly equal
    sets = [shingle_set(t.encode(), 5) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert near == [(7, 6)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_copies(rows).collect()} == set(range(7))


def test_sure_links_are_held_against_the_texts(spark):
    rows = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten eleven twelve"), (3, "one two three four five six")], "doc_id long, text string")
    plan = simhash.similarity_plan(radius=256, likely=256, long_radius=2048, keys=((), ()))
    assert {r["id"]: r["component"] for r in simhash.near_groups(rows, plan).collect()} == {1: 1, 2: 2, 3: 1}


def test_links_are_pairs_within_the_radius():
    prints = np.array([[(1 << i) - 1] for i in range(40)], np.uint64)  # a chain
    a, b = link_runs(np.zeros(40, np.int64), prints, 1)
    assert sorted(zip(b.tolist(), a.tolist(), strict=True)) == [(i, i + 1) for i in range(39)]


def test_shards(spark, docs):
    got = queries.op4_byte_shards(spark, SF).toPandas().sort_values("doc_id")
    assert got["size"].tolist() == [len((t or "").encode()) + 1 for t in docs.text.loc[got.doc_id]]
    assert got["text_crc32"].tolist() == [zlib.crc32((t or "").encode()) for t in docs.text.loc[got.doc_id]]
    sums = got.groupby("shard")["size"].sum()
    assert sorted(sums.index) == list(range(8)) and sums.max() - sums.min() <= 2 * got["size"].max()
    assert (got["shard"].diff().fillna(0) >= 0).all()
    assert all(g.slot.tolist() == list(range(len(g))) for _, g in got.groupby("shard"))


def test_tokens_are_those_of_the_library():
    bpe, library = tables(queries.BPE_VOCAB), Tokenizer.from_file(queries.BPE_VOCAB)
    rng = random.Random(3)
    alphabet = "abcdefghijklmnop 'stve.,!09²ⅧΣİßéȨ́\x1c\x85\xa0 日本한\U0001f600‍﻿ŉﬁ\x00Ǆ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += pd.read_parquet(f"{SF}/documents.parquet").text.tolist() + ["a<|startoftext|>b <|endoftext|>", "a" * 500, "thin" * 300, ""]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = bpe.encode(text.encode())
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert b"".join(bpe.decode(ids)).decode() == library.decode(want, skip_special_tokens=False)


def test_every_code_point_is_encoded_as_by_the_library():
    """Each beside letters, digits and signs, in texts of 500; of large blocks of one kind, some."""
    bpe, library = tables(queries.BPE_VOCAB), Tokenizer.from_file(queries.BPE_VOCAB)
    alike = ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xE000), (0xE000, 0xF900), (0x17000, 0x187F8), (0x20000, 0x2B700), (0x30000, 0x32300), (0x40000, 0x110000))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 101 == 0 or not any(a <= c < b for a, b in alike))]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1 .{chr(c)} " for c in points[first : first + 500]) for first in range(0, len(points), 500)]
    differ = [i for i, (text, want) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True)) if np.frombuffer(bpe.encode(text.encode()), "<u4").tolist() != want.ids]
    assert differ == []


def test_token_digests(spark, docs):
    library = Tokenizer.from_file(queries.BPE_VOCAB)
    got = queries.op6_bpe(spark, SF).toPandas().set_index("doc_id")
    for i, text in docs.text.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert tuple(got.loc[i, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))


def test_long_texts_are_decoded_in_pieces(monkeypatch):
    monkeypatch.setattr(bpe_module, "DECODED_AT_ONCE", 1000)
    bpe, library = tables(queries.BPE_VOCAB), Tokenizer.from_file(queries.BPE_VOCAB)
    text = "some words, and more of them: " * 60_000
    ids = bpe.encode(text.encode())
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want and b"".join(bpe.decode(ids)).decode() == library.decode(want, skip_special_tokens=False)


def test_memory_keeps_what_is_used():
    memory = bpe_module.Memory(10)
    for i in range(1000):
        memory.keep(i, i)
        assert memory.get(0) is not None or memory.recall(0) is not None
        assert len(memory) <= 10 and len(memory.old) <= 10


def every_way(own, word, logs):
    total = 0.0
    for mask in range(2 ** (len(word) - 1)):
        cuts = [0, *(i + 1 for i in range(len(word) - 1) if mask >> i & 1), len(word)]
        ways = [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        each = [logs[own.ids[w]] if w in own.ids else logs[own.byte_ids[list(w.encode())]].sum() if len(w) == 1 else -np.inf for w in ways]
        total += math.exp(sum(each))
    return math.log(total)


def test_lattice_sums_every_segmentation():
    own = pieces(queries.PIECE_VOCAB)
    logs = np.log(np.maximum(own.prior, 1e-300))
    some = ["▁the", "▁thing", "▁é日x", "▁a", "▁\x01q", "▁queévi", "▁\U0001f600b"]
    assert np.allclose(own.forward(some, np.stack([logs, logs], 1))[:, 1], [every_way(own, w, logs) for w in some])
    # The expected uses are the derivative of the log sum by each log probability.
    uses = own.expected(["▁thing"], np.array([2.0]), logs[:, None])
    for piece in ("▁th", "ing", "▁thing"):
        moved = logs.copy()
        moved[own.ids[piece]] += 1e-6
        assert uses[own.ids[piece]] == pytest.approx(2 * (every_way(own, "▁thing", moved) - every_way(own, "▁thing", logs)) / 1e-6, rel=1e-3)


def test_language_of_held_out_documents(spark, docs):
    got = queries.op7_language_id(spark, f"{DATA}/sf0.01").toPandas().set_index("doc_id")
    lang = pd.read_parquet(f"{DATA}/sf0.01/documents.parquet").set_index("doc_id").lang
    held = got[got.held_out]
    assert held.index.tolist() and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held.index)
    assert (held.lang_pred == lang[held.index]).mean() > 0.98


def lattice(own, word, logs):
    """(log of the sum over all segmentations, expected uses of the pieces) of one word, place by place."""
    ways = [(i, j, [own.ids[word[i:j]]]) for i in range(len(word)) for j in range(i + 1, len(word) + 1) if word[i:j] in own.ids]
    single = {i for i, j, _ in ways if j == i + 1}
    ways += [(i, i + 1, own.byte_ids[list(word[i].encode())].tolist()) for i in range(len(word)) if i not in single]
    before, after = [0.0] + [-math.inf] * len(word), [-math.inf] * len(word) + [0.0]
    for i, j, ids in sorted(ways, key=lambda x: x[1]):
        before[j] = np.logaddexp(before[j], before[i] + sum(logs[k] for k in ids))
    for i, j, ids in sorted(ways, key=lambda x: -x[0]):
        after[i] = np.logaddexp(after[i], after[j] + sum(logs[k] for k in ids))
    uses = collections.Counter()
    for i, j, ids in ways:
        for k in ids:
            uses[k] += math.exp(before[i] + sum(logs[k] for k in ids) + after[j] - before[-1])
    return before[-1], uses


def test_lm_score_of_each_document(spark):
    """One expectation step over the words of documents that are not held out, then the sum over all segmentations."""
    texts = ["the river bends", "THE river is wide, and the boats are old", "", None, "an unseen wörd ☃", "boats bend the river"] * 2
    held = [i % 4 == 1 for i in range(len(texts))]
    rows = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, h boolean")
    got = {r["doc_id"]: r for r in lm.scored(rows, F.col("h"), queries.PIECE_VOCAB).collect()}
    own = pieces(queries.PIECE_VOCAB)
    start = np.log(np.maximum(own.prior, 1e-300))
    counts = collections.Counter(w.decode() for t, h in zip(texts, held, strict=True) if not h for w in words(t))
    expected = np.zeros(own.size)
    for w, n in counts.items():
        for k, u in lattice(own, "▁" + w, start)[1].items():
            expected[k] += n * u
    ends = held.count(False)
    total = expected.sum() + lm.STRENGTH + ends + 1
    logs = np.log(np.maximum((expected + lm.STRENGTH * own.prior) / total, 1e-300))
    for i, t in enumerate(texts):
        want = sum(lattice(own, "▁" + w.decode(), logs)[0] for w in words(t)) / math.log(10) + math.log10((ends + 1) / total)
        assert got[i]["score"] == pytest.approx(want, rel=1e-9), t


def test_language_scores(spark):
    """The posterior of equal priors over the sums of all segmentations."""
    texts = {"en": "the old river bends in the wide land", "de": "der alte fluss biegt sich im weiten land"}
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts.items())] * 3, "doc_id long, text string, lang string")
    langs, logs = langid.train(docs, queries.PIECE_VOCAB)
    asked = ["the land", "der fluss", "land", "land land", "THE LAND 12", "... 12"]
    found = langid.identified(spark.createDataFrame([(t,) for t in asked], "text string"), (langs, logs), queries.PIECE_VOCAB).collect()
    own = pieces(queries.PIECE_VOCAB)
    for r in found:
        each = [sum(lattice(own, "▁" + w, x)[0] for w in langid._words(r["text"])) for x in logs]
        if not langid._words(r["text"]):
            assert r["language"] == ("und", 0.0)
            continue
        best = int(np.argmax(each))
        assert r["language"]["lang"] == langs[best] and r["language"]["score"] == pytest.approx(1 / sum(math.exp(x - each[best]) for x in each))
    assert langid.train(docs, queries.PIECE_VOCAB)[0] == ["de", "en"]


def test_equal_languages_go_to_the_first(spark):
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["nl", "af"] * 2)], "doc_id long, text string, lang string")
    found = langid.identified(docs, langid.train(docs, queries.PIECE_VOCAB), queries.PIECE_VOCAB).collect()
    assert {tuple(r["language"]) for r in found} == {("af", 0.5)}


def test_lm_base_score(spark, docs):
    got = queries.op9_lm_score(spark, SF).toPandas().set_index("doc_id").loc[docs.index]
    held = np.array([zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.index])
    counts = collections.Counter(w for t, h in zip(docs.text, held, strict=True) if not h for w in words(t))
    ends = int((~held).sum())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = [sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)) + math.log10((ends + 1) / (n + v + 1)) for t in docs.text]
    assert np.allclose(got.base_score, base) and (got.train_tokens == n).all() and (got.held_out == held).all()
    assert got.n_tokens.tolist() == [len(words(t)) + 1 for t in docs.text]
    assert got.n_known.tolist() == [sum(w in counts for w in words(t)) + 1 for t in docs.text]


def test_long_words_and_one_look_up():
    """Spans are sorted by numbers of 16 bits up to 255 characters, by larger ones beyond; a word is looked up once and is new once."""
    own = pieces(queries.PIECE_VOCAB)
    logs = np.log(np.maximum(own.prior, 1e-300))
    for n in (1, 254, 255, 256, 400):
        word = "▁" + ("straßenübergang\U0001f600" * 40)[: n - 1]
        (got,), = own.forward([word], logs[:, None])
        assert np.isclose(got, lattice(own, word, logs)[0])
    word = "▁" + "xyx" * 20_000
    spans = own.spans([word], len(word))
    assert spans == sorted(spans, key=lambda x: (x[1], x[0])) and all(own.ids[word[i:j]] == ids[0] for i, j, _, ids in spans) and {j for _, j, _, _ in spans} == set(range(1, len(word) + 1))
    seen = langid.Numbers()
    assert [seen[w] for w in "b a b c a".split()] == [0, 1, 0, 2, 1] and seen.new == ["b", "a", "c"]


def bm25(bags, query, k=10):
    """All documents' scores, and the ids of the k best."""
    n, mean = len(bags), sum(c.total() for c in bags.values()) / len(bags)
    df = collections.Counter(w for c in bags.values() for w in c)
    scores = {i: sum(m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w, m in sorted(query.items()) if w in c) for i, c in bags.items()}
    return scores, [i for _, i in sorted((-s, i) for i, s in scores.items() if s > 0)[:k]]


@pytest.mark.parametrize(("shard_bytes", "broadcast"), [(60_000, 24_000_000), (6_000_000, 1000)])
def test_bm25(spark, docs, shard_bytes, broadcast, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(search, "QUERY_BYTES", 5000)
    monkeypatch.setattr(search, "BROADCAST_BYTES", broadcast)
    got = queries.op10_bm25_top(spark, SF).toPandas()
    bags = {i: collections.Counter(words(t)) for i, t in docs.text.items()}
    asked = [i for i in bags if i % 50 == 0]
    assert set(got.query_id) <= set(asked)
    for q in asked:
        scores, best = bm25(bags, bags[q])
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(best) + 1))
        assert np.allclose(own.score, [scores[i] for i in best])
        assert all(np.isclose(scores[i], scores[j]) for i, j in zip(own.doc_id, best, strict=True))


def test_words_of_packs_are_never_broadcast(spark, monkeypatch):
    """A pack of queries is one row to Spark's estimate and a million words to the driver that broadcasts them."""
    plans = []
    monkeypatch.setattr(search, "written", lambda df, name, **_: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    monkeypatch.setattr(search, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    packs = spark.createDataFrame([tuple(r.values()) for b in search._pack(100)([pa.record_batch({"id": pa.array([1, 2]), "text": ["a b", "b c"]})]) for r in b.to_pylist()], search.PACKED)
    words = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("c", 1, 2)], "word string, n long, number long")
    search._numbered(packs, words, "asks")
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_blocks_are_answered_one_after_another(spark, docs, monkeypatch):
    """The driver holds the broadcast of one block of queries at a time."""
    from pyspark import Broadcast

    held, most = [], []
    monkeypatch.setattr(search, "QUERY_BYTES", 2000)
    monkeypatch.setattr(search, "BROADCAST_BYTES", 1)
    send, destroy = type(spark.sparkContext).broadcast, Broadcast.destroy
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: held.append(1) or most.append(len(held)) or send(self, value))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: held.pop() and destroy(self, blocking))
    assert queries.op10_bm25_top(spark, SF).count() > 0
    assert len(most) >= 4 and max(most) == 2 and not held


def test_bm25_ties_and_empty_shards(spark, monkeypatch):
    """Equal documents lie in shards of their own; the smaller ids win."""
    monkeypatch.setattr(search, "SHARD_BYTES", 40)
    texts = {i: "red green blue red" for i in range(100, 130)} | {i: None for i in range(200, 210)} | {i: "" for i in range(210, 220)} | {7: "green paint", 8: "red paint in a tin"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = search.bm25_top(rows, F.col("doc_id").isin(7, 105, 205), k=6).collect()
    found = {q: [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (7, 105, 205)}
    assert found == {7: [7, 8, 100, 101, 102, 103], 105: [100, 101, 102, 103, 104, 105], 205: []}


def test_packs_by_counters(monkeypatch):
    """A pack holds each text's distinct words with their counts, and each word's number of texts."""
    monkeypatch.setattr(search, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    texts = ["b a B\tc", None, "", " ", "a " * 300 + "é", "zz"]
    packs = list(search._pack(700)([pa.record_batch({"id": pa.array(range(6)), "text": texts})]))
    got = {}
    for p in packs:
        names, own = p.column("words")[0].as_py().split("\n"), search._arrays(pa.RecordBatch.from_arrays([*p.columns, *[pa.array([b""])] * 2], [*p.schema.names[:-1], "texts", "numbers", "df"]), 0)
        ends = np.cumsum(own["sizes"])
        each = [{names[t].encode(): int(f) for t, f in zip(own["terms"][e - s : e], own["freqs"][e - s : e], strict=True)} for s, e in zip(own["sizes"], ends, strict=True)]
        got |= dict(zip(own["ids"].tolist(), each, strict=True))
        assert own["lengths"].tolist() == [sum(x.values()) for x in each]
        df = collections.Counter(w for x in each for w in x)
        assert p.column("df")[0].as_py() == [df[w.encode()] for w in names if w] == sorted(df.values(), reverse=True)
    assert len(packs) > 0 and got == {i: dict(collections.Counter(words(t))) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [50, 1 << 40])
def test_orders_by_packed_keys(most):
    """Two keys and the row in one number, or as they are where that has too many bits."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, most, 3000) % most, rng.integers(0, 40, 3000).astype(np.int32)
    assert search._order(a, b).tolist() == np.lexsort((b, a)).tolist() and search._order(b).tolist() == np.argsort(b, kind="stable").tolist()
    assert len(search._order(a[:0], b[:0])) == 0


def test_later_tasks_begin_with_a_threshold(monkeypatch):
    """A task that is told the k-th best of documents searched before gives back only what reaches it, one by one or in groups."""
    rng = random.Random(4)
    monkeypatch.setattr(search, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    some = [f"w{i}" for i in range(200)]
    pack = next(search._pack(10**6)([pa.record_batch({"id": pa.array(range(400)), "text": [" ".join(rng.choices(some, k=30)) for _ in range(400)]})]))
    df = np.array(pack.column("df")[0].as_py(), np.int64)
    row = pa.RecordBatch.from_arrays([*pack.columns[:-2], pa.array([np.arange(len(df)).tobytes()]), pa.array([df.tobytes()])], [*pack.schema.names[:-2], "numbers", "df"])
    for few in (1, 1000):
        monkeypatch.setattr(search, "FEW", few)
        asked = search._merged([search._arrays(row, 0)])
        whole = next(search._answer(types.SimpleNamespace(value=asked | {"least": np.zeros(400)}), 400, 30.0, 10)([row])).to_pandas()
        least = whole[whole.groupby("query_id").cumcount() == 3].score.to_numpy()
        told = next(search._answer(types.SimpleNamespace(value=asked | {"least": least}), 400, 30.0, 10)([row])).to_pandas()
        want = whole[whole.groupby("query_id").cumcount() < 4]
        assert len(whole) == 4000 and len(told) < 2000 and set(zip(want.query_id, want.doc_id, want.score)) <= set(zip(told.query_id, told.doc_id, told.score))


def test_pivots_skip_postings():
    """Blocks whose maxima stay under the threshold are not read, and the best are those of all scores."""
    bags = [collections.Counter(words(t)) for t in pd.read_parquet(f"{DATA}/sf0.01/documents.parquet").text]
    number = {w: i for i, w in enumerate(sorted({w for c in bags for w in c}))}
    each = [sorted((number[w], m) for w, m in c.items()) for c in bags]
    terms, freqs = (np.array([x[k] for e in each for x in e], np.int32) for k in (0, 1))
    n, sizes, lengths = len(bags), np.array([len(e) for e in each]), np.array([c.total() for c in bags])
    doc, df = np.repeat(np.arange(n), sizes), np.bincount(terms, minlength=len(number))
    shard = search.Shard(np.arange(n), sizes, terms, freqs, lengths, df, n, lengths.mean())
    weight = np.log1p((n - df + 0.5) / (df + 0.5))[terms] * freqs * 2.2 / (freqs + 1.2 * (0.25 + 0.75 * lengths[doc] / lengths.mean()))
    for q in range(0, n, 20):
        own, times = terms[doc == q], freqs[doc == q].astype(float)
        if not len(own):
            continue
        scores, ids = shard.top(own, times, 10, np.zeros(0), np.zeros(0, np.int64))
        query = np.zeros(len(number))
        query[own] = times
        every = np.bincount(doc, weight * query[terms], n)
        want = np.lexsort((np.arange(n), -every))[:10]
        want = want[every[want] > 0]
        assert np.allclose(scores, every[want]) and np.allclose(every[ids], every[want])
    assert shard.read < 0.95 * shard.all


@pytest.mark.parametrize("group", [1, 40])
def test_best_of_many_blocks(group, monkeypatch):
    """One by one or in groups: the best of all scores, though the threshold rises over more blocks than are looked at together."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(search, "PIVOTS", 2)
    monkeypatch.setattr(search, "MATRIX_WORDS", 30)
    n, words = 3000, 400
    each = [np.sort(rng.choice(words, rng.integers(0, 60), replace=False, p=(p := 1 / np.arange(3, words + 3)) / p.sum())).astype(np.int32) for _ in range(n)]
    terms, sizes = np.concatenate(each), np.array([len(e) for e in each])
    freqs = rng.integers(1, 5, len(terms)).astype(np.int32)
    doc, df = np.repeat(np.arange(n), sizes), np.bincount(terms, minlength=words)
    lengths = np.bincount(doc, freqs, n).astype(np.int64)
    weight = np.log1p((n - df + 0.5) / (df + 0.5))[terms] * freqs * 2.2 / (freqs + 1.2 * (0.25 + 0.75 * lengths[doc] / lengths.mean()))
    shard = search.Shard(np.arange(n), sizes, terms, freqs, lengths, df, n, lengths.mean())
    asked = [(terms[doc == q], freqs[doc == q].astype(float)) for q in range(0, n, 15) if sizes[q]]
    monkeypatch.setattr(search, "TOGETHER", group)
    best = [(np.array([30.0, 20.0, 10.0]), np.array([n, n + 1, n + 2]))] * len(asked)
    found = {}
    for places in shard.groups([t for t, _ in asked]):
        assert len(places) <= group
        some, before = [asked[i] for i in places], [best[i] for i in places]
        found |= dict(zip(places, shard.together(some, 5, before) if group > 1 else [shard.top(*some[0], 5, *before[0])], strict=True))
    for (own, times), (scores, ids) in zip(asked, (found[i] for i in range(len(asked))), strict=True):
        query = np.zeros(words)
        query[own] = times
        every = np.r_[np.bincount(doc, weight * query[terms], n), 30.0, 20.0, 10.0]
        want = np.lexsort((np.arange(n + 3), -every))[:5]
        assert np.allclose(scores, every[want]) and np.allclose(every[ids], every[want])


def test_groups_are_bounded(monkeypatch):
    """Many short documents: matrices and groups shrink, so that no array has more cells than stated."""
    monkeypatch.setattr(search, "CELLS", 1000)
    n = 320
    shard = search.Shard(np.arange(n), np.ones(n, int), np.arange(n, dtype=np.int32) % 7, np.ones(n, np.int32), np.ones(n, np.int64), np.bincount(np.arange(n) % 7), n, 1.0)
    assert shard._matrices()[1].size <= 1000 and max(map(len, shard.groups([np.array([3])] * 10))) == 3
    (scores, ids), = shard.together([(np.array([3]), np.ones(1))], 4, [(np.zeros(0), np.zeros(0, np.int64))])
    assert ids.tolist() == [3, 10, 17, 24] and len(set(scores)) == 1


def test_templates_and_slots(spark):
    filler = "some other words that come before the question and are of no concern here"
    items = ["The train to Paris runs at 80 km per hour and Anna leaves home at 80 minutes past the hour today", "count the red marbles that Tom keeps in boxes of twelve before he gives them all away"]
    texts = {
        1: f"{filler} {items[0]} {filler}",
        2: f"{filler} the train to Oslo runs at 95 km per hour and Maria leaves home at 95 minutes past the hour today",
        3: f"{filler} the train to Oslo runs at 95 km per hour and Maria leaves home at 70 minutes past the hour today",
        4: filler * 3,
        5: items[1].upper().replace(" ", "!! "),
        6: "count the red marbles that Eve keeps in boxes of twelve before he gives them all away",
        7: "Paris Tom 80 km Anna 80 minutes",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(rows, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    # In document 3 one number of the item stands for two.
    assert set(got) == {(1, 0), (2, 0), (5, 1), (6, 1)}
    assert got[2, 0]["n_consistent"] > 0 == got[2, 0]["n_literal"] and got[1, 0]["n_windows"] > 8


UNIT_WORDS, NUMBER_WORDS, STARTERS = (set(x) for x in (decontaminate.UNITS, decontaminate.NUMBER_WORDS, decontaminate.STARTERS))


def template(text):
    """(words, template words, placeholder or None for each) by plain rules."""
    plain, tokens, kinds, opens = [], [], [], True
    for raw in text.split():
        word = "".join(c for c in raw if c.isalnum())
        if word:
            digits = any(c.isdigit() for c in word)
            spelled = word.lower() in NUMBER_WORDS and not digits
            before = None if opens or not kinds else kinds[-1]
            unit = before == "NUM" and word.lower() in UNIT_WORDS
            name = word[0].isupper() and any(c.islower() for c in word) and word.lower() not in STARTERS
            kind = "NUM" if digits or spelled else "UNIT" if unit else "NAME" if name else None
            plain.append(word.lower())
            if kind == "NAME" and before == "NAME" or spelled and before == "NUM":
                tokens[-1] += " " + plain[-1]
            else:
                tokens.append(plain[-1])
                kinds.append(kind)
        opens = word == "" and opens or raw[-1] in ".!?:;"
    return plain, tokens, kinds


def copies(doc, item):
    """Whether the document holds the item: a passage word for word, or one consistent copy with half of its windows."""
    (dp, dw, dk), (ip, iw, ik) = template(doc), template(item)
    passages = {tuple(ip[k : k + 8]) for k in range(len(ip) - 7)}
    if any(tuple(dp[k : k + 8]) in passages for k in range(len(dp) - 7)):
        return True
    places = [k for k in range(len(iw) - 7) if sum(x is None for x in ik[k : k + 8]) >= 4]
    found = collections.defaultdict(list)
    for p in range(len(dw) - 7):
        for k in places:
            if [x or w for x, w in zip(dk[p : p + 8], dw[p : p + 8])] == [x or w for x, w in zip(ik[k : k + 8], iw[k : k + 8])]:
                for copy in (("at", p - k), ("even", (p - k) // 16), ("odd", (p - k + 8) // 16)):
                    found[copy].append((p, k))
    for own in found.values():
        stands = collections.defaultdict(set)
        for p, k in own:
            for j in range(8):
                if ik[k + j]:
                    stands[iw[k + j]].add(dw[p + j])
        if len({k for _, k in own}) >= 0.5 * len(places) and all(len(x) == 1 for x in stands.values()):
            return True
    return False


CLIPS = "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips in May. Natalia pays 3 dollars. How many clips did Natalia sell?"
APPLES = "Anna has 12 apples. Bob gives Anna 15 apples. How many apples does Anna have after Bob has given her all of them?"


def test_questions_put_anew(spark):
    """Names at sentence starts, names of other length, numbers in words, words put in between."""
    items = [CLIPS, APPLES]
    texts = {
        1: CLIPS.replace("Natalia", "Peter").replace("48", "60").replace("April", "June").replace("May", "July"),
        2: APPLES.replace("Anna", "Carla").replace("Bob", "Dieter").replace("12", "20").replace("15", "31"),
        3: CLIPS.replace("Natalia", "Maria Anna Schmidt").replace("48", "twenty-five").replace("3", "two hundred"),
        4: CLIPS.replace("Natalia", "Peter").replace("48", "60").replace("April.", "June, which was a good month."),
        5: APPLES.replace("Anna has", "Carla has").replace("Bob gives Anna", "Dieter gives Paula").replace("12", "20").replace("15", "31").replace("does Anna", "does Emma").replace("Bob has", "Hugo has"),
        6: "Peter has 60 friends in June. How many clips are there in July? Dieter gives Carla 3 dollars.",
    }
    docs = spark.createDataFrame([(k, f"Some lines come before. {t} And some after it.") for k, t in texts.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 0), (4, 0)}
    assert all(r["n_consistent"] > 0 for r in got.values())


def questions(rng, n):
    """(item, the same with other values, near miss: one value stands for two) for items that use a number and a name twice."""
    vowel = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(n):
        words = [vowel() for _ in range(rng.randint(24, 28))]
        at = [5 * i + 2 + rng.randint(0, 1) for i in range(5)]  # some value in every window of eight words
        name, number = lambda: vowel().title() + "o", lambda: str(rng.randint(10, 999))

        def filled(a, b, c, d, e, words=words, at=at):
            w = list(words)
            for place, value in zip(at, (a, b, c, d, e)):
                w[place] = value
            return " ".join(w)

        n1, n2, n3, x = name(), name() + "la", name() + "mi", number()
        y, x2, y2 = str(1000 + int(x)), str(2000 + int(x)), str(3000 + int(x))
        out.append((filled(n1, x, n1, y, x), filled(n2, x2, n2, y2, x2), filled(n2, x2, n3, y2, y2)))
    return out


def word_problems(rng, n):
    """(item, the same with other values, near miss) whose sentences start with names; names and numbers of the copies have one to three words."""
    vowel = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    names = lambda k: [" ".join(vowel().title() + "xo" for _ in range(rng.randint(1, k))) for _ in range(3)]
    # All four differ: with an equal number a near miss would hold eight words of the item as they are.
    numbers = lambda: rng.sample([str(rng.randint(10, 999)), "two hundred", "forty-one", "six", "3 million", str(rng.randint(1000, 9999))], 4)
    out = []
    for _ in range(n):
        w = [vowel() for _ in range(24)]

        def told(a, b, c, x, y, w=w):
            return f"{a} {' '.join(w[:5])} {x} {' '.join(w[5:8])}. {b} {' '.join(w[8:13])} {c} {y} {' '.join(w[13:17])}. {a} {' '.join(w[17:21])} {b} {' '.join(w[21:])}?"

        (a, b, _), (d, e, f), (x, y, u, v) = names(1), names(3), numbers()
        near = f"{f} {' '.join(w[:5])} {u} {' '.join(w[5:8])}. {e} {' '.join(w[8:13])} {d} {v} {' '.join(w[13:17])}. {d} {' '.join(w[17:21])} {f} {' '.join(w[21:])}?"
        out.append((told(a, b, a, x, y), told(d, e, d, u, v), near))
    return out


def test_rates_of_word_problems(spark):
    rng = random.Random(18)
    every = word_problems(rng, 200)
    items = spark.createDataFrame([(i, q[0]) for i, q in enumerate(every)], "item_id long, text string")
    docs = spark.createDataFrame([(1000 * kind + i, f"Some lines come before it. {q[kind]} and after it") for i, q in enumerate(every) for kind in (0, 1, 2)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    rate = lambda kind: sum((1000 * kind + i, i) in got for i in range(200)) / 200
    print("word problems found: copies, put anew, near misses", [rate(k) for k in range(3)])
    assert rate(0) == 1 and rate(1) >= 0.95 and rate(2) <= 0.02
    assert got == {(1000 * kind + i, i) for i, q in enumerate(every) for kind in (0, 1, 2) if copies(q[kind], q[0])}


def test_rates_of_new_values_and_near_misses(spark):
    rng = random.Random(8)
    every = questions(rng, 200)
    items = spark.createDataFrame([(i, q[0]) for i, q in enumerate(every)], "item_id long, text string")
    docs = spark.createDataFrame([(1000 * kind + i, f"some lines before it. {q[kind]} and after it") for i, q in enumerate(every) for kind in (0, 1, 2)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    rate = lambda kind: sum((1000 * kind + i, i) in got for i in range(200)) / 200
    assert (rate(0), rate(1), rate(2)) == (1, 1, 0)
    assert got == {(1000 * kind + i, i) for i, q in enumerate(every) for kind in (0, 1, 2) if copies(q[kind], q[0])}


def test_templates_by_brute_force(spark):
    """Random passages of items with values, cases and marks changed, against plain rules."""
    rng = random.Random(9)
    items = [q[0] for q in questions(rng, 30)] + ["Anna 12 Bob 15 Carl 17 Dora 19 Emil 23 has apples and more of them"]

    def changed(text):
        w = text.split()
        first = rng.randrange(len(w) - 8)
        w = w[first : first + rng.randint(8, 40)]
        for i, x in enumerate(w):
            roll = rng.random()
            if x.isdigit() and roll < 0.5:
                w[i] = rng.choice(["7", "31", "405"])
            elif x[0].isupper() and roll < 0.4:
                w[i] = rng.choice(["Oto", "Ida"])
            elif roll < 0.03:
                w[i] = x + rng.choice(",.!")
            elif roll > 0.98:
                w[i] = "other"
        return " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)

    texts = [f"lines {changed(t)} end" for t in items for _ in range(6)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {(d, i) for d, t in enumerate(texts) for i, q in enumerate(items) if copies(t, q)}
    assert want <= got
    # Windows that were widened to have four literals are beyond the plain rules.
    assert {(d, i) for d, i in got - want if not (i == len(items) - 1 or any(sum(k is None for k in template(items[i])[2][p : p + 8]) < 4 for p in range(len(template(items[i])[1]) - 7)))} == set()


def test_items_of_few_literals(spark):
    items = [
        "What is 12 times 9?",
        "12 + 9 + 4 7 8 15 16 23 42 is",
        "given 3 7 12 19 28 39 52 then 67 84 103 124 find the next",
        "3.1 4.1 5.9 2.6 5.3 5.8 9.7 9.3 2.3 8.4",
        "seats of Anna Bob Carl Dora Emil Fritz Gerda and Hugo",
    ]
    filler = "some other words that come before the question and are of no concern here"
    anew = [
        "what is 35 times 8",
        "1 + 2 + 3 4 5 6 7 8 9 is",
        "given 1 2 4 8 16 32 64 then 128 256 512 1024 find the next",
        "1.1 2.1 3.9 4.6 5.3 6.8 7.7 8.3 9.3 1.4",
        "seats of Ida Jan Karl Lena Mia Nora Otto and Paul",
    ]
    texts = [*(f"{filler} {t} {filler}" for t in items), *(f"{filler}. {t} {filler}" for t in anew), f"{filler} 12 times 9 is what", filler]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.leaks(rows, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    # Numbers alone match only as they are.
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(5)} | {(5 + i, i) for i in (0, 1, 2, 4)}


def test_passage_late_in_a_very_long_text(spark):
    """Texts are cut in pieces inside; passages over a cut are found too."""
    item = "a question about seven red boats that cross the wide river before the old bridge is lowered again"
    filler = "plain words of no concern to anyone who reads them here " * 18_000  # one million bytes
    at_cut = filler[: decontaminate.PIECE - 40]
    texts = [f"{filler}{filler}{item} {filler}", f"{at_cut[: at_cut.rindex(' ')]} {item} {filler}", filler * 3, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {0, 1}


def test_a_task_holds_little_beside_its_batch():
    """The windows of a batch of 8 MB are made a slice at a time, and the model of an earlier stage goes first."""
    rng = random.Random(3)
    some = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(some, k=300)) for _ in range(4000)]
    batch = pa.record_batch({"id": pa.array(range(len(texts))), "text": texts})
    bits = np.zeros(1 << decontaminate.FILTER_BITS, bool)
    bits[::97] = True
    common._model["of another stage"] = "a"
    tracemalloc.start()
    windows = decontaminate._windows(decontaminate.WINDOW, decontaminate.LITERALS, decontaminate.hashes_of(decontaminate.UNITS), [(5, True)], bits)
    found = sum(out.num_rows for out in windows([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 0 and not common._model and most < 50e6


def test_slices_hold_every_row_once():
    batch = pa.record_batch({"id": pa.array(range(1000)), "text": ["x" * (i % 90) for i in range(1000)]})
    cut = list(common.in_pieces([batch, batch.slice(0, 0), batch.slice(999)], 5000))
    assert len(cut) > 8 and [i for b in cut for i in b.column(0).to_pylist()] == [*range(1000), 999]


def test_whole_windows_by_brute_force(spark):
    docs = pd.read_parquet(f"{DATA}/sf0.01/documents.parquet")
    items = pd.read_parquet(f"{DATA}/sf0.01/benchmark.parquet")
    plain = lambda t: ["".join(c for c in w if c.isalnum()) for w in t.lower().split()]
    known = {}
    for i, t in zip(items.item_id, items.text, strict=True):
        w = [x for x in plain(t) if x]
        for k in range(len(w) - 7):
            known.setdefault(tuple(w[k : k + 8]), set()).add(i)
    want = set()
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        w = [x for x in plain(t) if x]
        want |= {(d, i) for k in range(len(w) - 7) for i in known.get(tuple(w[k : k + 8]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontamination(spark, f"{DATA}/sf0.01").collect()}
    assert want and want <= got and len(got) <= len(want) * 1.1


def test_secrets_by_plain_patterns(spark, docs):
    import hashlib
    import re

    found = queries.op5_secret_scan(spark, SF).toPandas().set_index("doc_id")
    for i, t in docs.text.items():
        spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        assert found.base_sha256[i] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(filter(None, found.spans[i].split(",")))


def test_markov_models_tell_keys_from_words(spark):
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n=24: "".join(rng.choice(letters) for _ in range(n))
    syllables = "ver tion ing re an th com pro con lo ca ti on er al".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(7))
    train = spark.createDataFrame([(f"{word()} {word()} token = {key()} {word()}",) for _ in range(400)], "text string")
    logs = secrets.train(train)
    assert all(secrets.find_spans(f"see {key()} now", logs, {})[1] for _ in range(50))
    assert not any(secrets.find_spans(f"see {word()} now", logs, {})[1] for _ in range(50))


@pytest.fixture(scope="module")
def models(spark):
    """What the production query learns."""
    return secrets.train(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))


def test_random_strings_of_every_alphabet(models):
    rng = random.Random(6)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digits, lower + digits, upper + digits, upper + "234567", digits + "ABCDEF", upper + lower + digits + "+/", upper + lower + digits + "-_"]
    for letters in alphabets:
        for around in ("{}", "sessionid={}", "/srv/deploy/config/{}"):
            found = 0
            for _ in range(200):
                own = "".join(rng.choice(letters) for _ in range(rng.randint(20, 40)))
                text = around.format(own)
                got = [s for s in secrets.find_spans(f"see {text} now", models, {})[1] if s[2] != "hex"]
                found += sum(e - s for s, e, _ in got) >= 0.7 * len(own)
            assert found >= 180, (letters, around, found)
    assert secrets.find_spans("see sessionid=Zk9xQ2mT7vLp4RbW8sYd now", models, {})[1] == [(14, 34, "markov")]
    plain = ["/home/anna/projects/station/reports", "content-management-section", "internationalisation", "2024-05-17-12-30-00", "4785380592391139", "nichteinungeinkeit", "getElementsByTagName", "acknowledgements", "org/apache/spark/sql", "----------------------"]
    assert not any(secrets.find_spans(f"see {w} now", models, {})[1] for w in plain)


def test_ordinary_strings_with_digits_are_no_secrets(models):
    """Words here are none of the corpus's, and the strings none that the thresholds were set on."""
    import uuid

    rng = random.Random(77)
    some = "get user name count total value index config server handler request response process control limit chart sample event stream table column window buffer reader".split()
    word = lambda: rng.choice(some)
    number = lambda: str(rng.randint(0, 9999))
    forms = {
        "timestamp": lambda: f"{rng.randint(1990, 2030)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}T{rng.randint(0, 23):02}{rng.randint(0, 59):02}{rng.randint(0, 59):02}Z",
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        "camel": lambda: word() + "".join(word().title() + (number() if rng.random() < 0.4 else "") for _ in range(3)),
        "capitals": lambda: "".join(rng.choice("BCDFGHJKLMNPQRSTVWXZ") for _ in range(rng.randint(16, 24))),
        "snake": lambda: "_".join(word() + (number() if rng.random() < 0.4 else "") for _ in range(4)),
        "path": lambda: "/".join([word(), word(), f"v{rng.randint(1, 9)}", word() + number()]),
    }
    for name, form in forms.items():
        found = sum(bool(secrets.find_spans(f"see {form()} now", models, {})[1]) for _ in range(300))
        assert found <= 6, (name, found)


def test_spans_by_plain_sums(spark):
    """Every stretch again, part by part, with probabilities looked up one by one; and each text's spans as the query lists them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = secrets.train(docs)
    kinds, letters, chars = models.kinds.reshape(4, 4, 4, 4), models.letters.reshape(27, 27, 27), models.chars.reshape(7, 62)
    assert np.allclose(np.exp(kinds).sum(-1), 1) and np.allclose(np.exp(letters).sum(-1), 1) and np.allclose(np.exp(chars).sum(-1), 1)

    def ratio(part):
        if part.isdigit():
            return 0.0
        kind = [3, 3, 3] + [0 if c.isupper() else 1 if c.islower() else 2 for c in part]
        total = sum(kinds[kind[i], kind[i + 1], kind[i + 2], kind[i + 3]] for i in range(len(part)))
        i = 0
        while i < len(part):
            j = i + 1
            if part[i].isdigit():
                while j < len(part) and part[j].isdigit():
                    j += 1
                total -= (j - i) * math.log(10)
            else:
                while j < len(part) and part[j].isupper() and part[i].isupper() and part[i:j].isupper():
                    j += 1
                if part[i].isupper() and j < len(part) and part[j].islower():
                    j = j - 1 if j - i > 1 else j
                if part[i].islower() or (j - i == 1 and j < len(part) and part[j].islower()):
                    while j < len(part) and part[j].islower():
                        j += 1
                code = [26, 26] + [ord(c) - 97 for c in part[i:j].lower()]
                known = sum(letters[code[k], code[k + 1], code[k + 2]] for k in range(j - i))
                total += math.log(0.9 * math.exp(known) + 0.1 * 26.0 ** -(j - i))
            i = j
        order = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        return max(sum(chars[k, order.index(c)] for c in part) for k in range(7) if all(c in secrets.ALPHABETS[k] for c in part)) - math.log(7) - 1.0 - total

    rng = random.Random(3)
    for _ in range(300):
        part = "".join(rng.choice(rng.choice(["ABCDEF", "abcdef", "xyz", "0123"])) for _ in range(rng.randint(1, 20)))
        assert math.isclose(secrets.log_ratio(part, models), ratio(part), rel_tol=1e-9, abs_tol=1e-9), part
    found = queries.op5_secret_scan(spark, SF).toPandas()
    texts = docs.toPandas().set_index("doc_id").text
    for i, spans in zip(found.doc_id, found.spans, strict=True):
        own = [(int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x) if k == "markov"]
        best = []
        for start, end, kind in ((s, e, k) for s, e, k in secrets.find_spans(texts[i] or "", models, {})[1] if k == "markov"):
            total = sum(ratio(p) for p in (texts[i][start:end]).replace("+", "/").replace("_", "/").replace("=", "/").replace("-", "/").split("/") if p)
            assert total > secrets.IN_ALL and total > secrets.PER_CHAR * (end - start) and any(c.isalpha() for c in texts[i][start:end])
            best.append((start, end))
        assert own == best


def test_models_do_not_see_the_held_out(spark):
    docs = spark.createDataFrame([(i, f"word{'abcdefgh'[i % 8]}x other", "en") for i in range(40)], "doc_id long, text string, lang string")
    langs, logs = langid.train(docs, queries.PIECE_VOCAB)
    assert langs == ["en"] and logs.shape[0] == 1

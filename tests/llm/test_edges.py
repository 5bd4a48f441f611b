import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from steadyline.llm import bpe, decontaminate, hosts, langid, lm, queries, search, secrets, sharding, simhash
from steadyline.llm.line_dedup import dedup_lines
from steadyline.llm.queries import BPE_VOCAB, PIECE_VOCAB

from .cases import CLASHING, TEXTS, awkward, empty


def keeps_rows(make, spark, column):
    """All rows and columns stay, an own column of that name is replaced, and an empty table gives none."""
    docs = awkward(spark)
    out = make(docs)
    got = out.collect()
    assert len(got) == len(TEXTS)
    assert set(out.columns) == set(docs.columns)
    assert all(r[c] == f"own {c}" for r in got for c in CLASHING if c != column)
    assert make(empty(spark)).count() == 0
    return got


def test_line_dedup(spark):
    got = keeps_rows(lambda d: dedup_lines(d, min_docs=3), spark, "lines")
    by = {(r["doc_id"], r["text"]): r["lines"] for r in got}
    assert by[1, None]["n_lines"] == 1 and by[1, None]["kept"] == ""
    assert by[8, "a\nb\n\na\n"] == (5, 0, "a\nb\n\na\n")


def test_repeated_rows_are_one_document(spark):
    rows = [(i, "shared\nown " + str(i)) for i in range(5)] * 2 + [(7, "often\n" * 12)] * 10 + [(20 + i, f"OFTEN \nkeep {i}\n often\n") for i in range(10)]
    got = {r["doc_id"]: r["lines"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()}
    assert got[3] == (2, 0, "shared\nown 3")
    # `often` is in 11 documents, at several places of each; the empty key is too short to count.
    assert got[7] == (13, 12, "") and got[23] == (4, 2, "keep 3\n")


def test_bpe(spark):
    got = keeps_rows(lambda d: bpe.tokenized(d, BPE_VOCAB), spark, "tokens")
    assert {r["tokens"]["n_tokens"] for r in got if not (r["text"] or "").strip()} == {0}


def test_secrets(spark):
    got = keeps_rows(lambda d: secrets.secrets(d, secrets.train(d)), spark, "secrets")
    assert all(r["secrets"]["n_assign"] == 0 for r in got)


def test_language(spark):
    model = langid.train(awkward(spark), PIECE_VOCAB)
    got = keeps_rows(lambda d: langid.identified(d, model, PIECE_VOCAB), spark, "language")
    assert {r["language"]["lang"] for r in got if r["text"] in (None, "", "!!! ??? ...")} == {"und"}
    nothing = langid.train(empty(spark), PIECE_VOCAB)
    assert {r["language"]["lang"] for r in langid.identified(awkward(spark), nothing, PIECE_VOCAB).collect()} == {"und"}


@pytest.mark.parametrize("plan", [simhash.exact_plan(), simhash.similarity_plan()])
def test_near_groups(spark, plan):
    got = simhash.near_groups(awkward(spark), plan).collect()
    assert len(got) == len(TEXTS)
    by = {r["id"]: r["component"] for r in got}
    assert by[None] is None and by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4
    assert simhash.near_groups(empty(spark), plan).count() == 0


def test_shards(spark):
    got = sharding.byte_shards(awkward(spark), 3).collect()
    assert len(got) == len(TEXTS) and sharding.byte_shards(empty(spark), 3).count() == 0
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(3))


def test_lm(spark):
    got = lm.scored(awkward(spark), F.col("doc_id") % 3 == 0, PIECE_VOCAB).collect()
    assert len(got) == len(TEXTS) and all(r["score"] <= 0 and r["n_tokens"] >= 1 for r in got)
    assert lm.scored(empty(spark), F.lit(False), PIECE_VOCAB).count() == 0
    assert lm.scored(awkward(spark), F.lit(True), PIECE_VOCAB).filter("n_known = 0").count() == len(TEXTS)


def test_search(spark):
    got = search.bm25_top(awkward(spark), F.col("doc_id") % 2 == 0, k=3).collect()
    assert {(r["query_id"], r["doc_id"]) for r in got if r["query_id"] == 4} == {(4, 4), (4, 5), (4, 12)}
    assert not any(r["query_id"] == 2 for r in got)
    assert search.bm25_top(empty(spark), F.lit(True)).count() == 0


def test_leaks(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "plain words of a short text"), (4, "nothing like it anywhere in these many rows")], "item_id long, text string")
    got = decontaminate.leaks(awkward(spark), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(4, 3), (5, 3), (12, 3)}
    assert decontaminate.leaks(empty(spark), items).count() == 0
    assert decontaminate.leaks(awkward(spark), items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(awkward(spark), items).count() == len(TEXTS) - 3


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "HTTP://A.Example.COM/en/x?q#f", "x"), (3, "HTTP://A.Example.COM/en/x?q#f", "x"), (None, "http://h.org", "x"), (5, "http://www.example.com/en/", "x"), (6, "://u@b.net:80/es/", "x"), (7, "ftp://b.net/fr/1", "x")], "page_id long, url string, host string")
    good = spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, good long")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in hosts.judge_urls(pages, good).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/x", "example.com/en/", "block"), (None, "h.org", "", None, "allow"),
        (5, "www.example.com", "/en/", "www.example.com/en/", "allow"), (6, "u@b.net:80", "/es/", None, "allow"), (7, "b.net", "/fr/1", "net/fr/", "block"),
    }
    assert hosts.judge_urls(pages.limit(0), good).count() == 0 and hosts.judge_urls(pages, good.limit(0)).count() == 8


def test_bad_host_is_blocked(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.when(F.col("id") < 60, "bad.site.org").otherwise(F.concat(F.lit("h"), F.col("id") % 7, F.lit(".fine.org"))), F.lit("/p")).alias("url"))
    good = pages.select("page_id", (F.col("page_id") >= 60).cast("long").alias("good"))
    got = {(r["host"], r["verdict"]) for r in hosts.judge_urls(pages, good).collect()}
    assert {h for h, v in got if v == "block"} == {"bad.site.org"}


JUNK, PROSE = "Of%%% that*** thing### and$$$ the&&& rest", "Of that thing and the rest, as it was."


def test_host_of_bad_content_is_blocked(spark):
    """Its name says nothing; what labelled texts of its kind were worth does."""
    i = F.col("id")
    bad = (i < 40) & (i % 10 > 0)
    url = F.when(i < 40, F.concat(F.lit("http://quiet.place.org/"), i)).otherwise(F.concat(F.lit("http://h"), i % 7, F.lit(".fine.org/"), i))
    html = F.concat(F.lit("<html><script>var t='%%%%%%%%%%%%';</script><!-- $$$ --><p class='a'>"), F.when(bad, JUNK).otherwise(PROSE), F.lit("</p>"))
    pages = spark.range(400).select(i.alias("page_id"), url.alias("url"), html.alias("html"), F.lit(1).alias("good"), F.lit(2).alias("cell"))
    texts = spark.range(60).select(F.when(i % 3 == 0, JUNK).otherwise(PROSE).alias("text"), F.when(i % 20 == 0, None).otherwise((i % 3 > 0).cast("int")).alias("quality"))
    outcomes = hosts.content_outcomes(pages, texts)
    assert {(r["id"], r["good"]) for r in outcomes.collect()} == {(k, int(not (k < 40 and k % 10 > 0))) for k in range(400)}
    judged = hosts.judge_urls(pages, outcomes).collect()
    assert {r["page_id"] for r in judged if r["verdict"] == "block"} == set(range(40))


def test_outcomes_of_odd_pages(spark):
    rows = [(1, None, None), (2, None, "<p> </p>"), (3, "http://a.org/poker", "<p>"), (4, "http://a.org", PROSE), (4, "http://a.org", PROSE), (5, "http://a.org", "STOP &amp; STOP &amp; STOP"), (6, "http://a.org", "&Uuml;ber " * 200_000), (None, "http://a.org", JUNK)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = spark.createDataFrame([(JUNK, 0), (JUNK, 0), (JUNK, 0), (PROSE, 1), (PROSE, 0), (None, 0), ("", 0), (PROSE, None)], "text string, quality int")
    got = sorted(((r["id"] or 0, r["good"]) for r in hosts.content_outcomes(pages, texts).collect()), key=str)
    # A cell with one good text of two is good; the cell of capitals and signs has no text and is good.
    assert got == sorted([(1, None), (2, None), (3, 0), (4, 1), (4, 1), (5, 1), (6, 1), (0, 0)], key=str)
    assert [r["good"] for r in hosts.content_outcomes(pages.filter("page_id = 4"), texts.limit(0)).collect()] == [1, 1]
    assert hosts.content_outcomes(pages.limit(0), texts).count() == 0


def test_reputation_decides_in_the_query(spark, tmp_path):
    """Pages of a site with unwanted pages are blocked for their host, and no others but by rule."""
    i = F.col("id")
    url = F.when(i < 80, F.concat(F.lit("http://www.lucky-casino.org/p/"), i)).when(i < 110, F.concat(F.lit("http://plain.net/es/"), i)).otherwise(F.concat(F.lit("http://h"), i % 7, F.lit(".fine.org/a/"), i))
    spark.range(600).select(i.alias("page_id"), url.alias("url"), F.lit("<p>plain words").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(0, 600, 2).select(i.alias("doc_id"), F.lit(1).alias("quality")).write.parquet(str(tmp_path / "labels.parquet"))
    spark.range(600).select(i.alias("doc_id"), F.lit("plain words").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_url_filter(spark, str(tmp_path)).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(110))
    assert {r["rule"] for r in got if r["page_id"] < 80} == {None}


def test_labels_meet_cells_not_texts(spark, tmp_path, monkeypatch):
    """Where labels are too many to broadcast, the shuffle has no text; null texts and labels, repeated and missing ids count as they did."""
    docs = [(1, JUNK), (1, JUNK), (2, JUNK), (3, PROSE), (4, PROSE), (5, None), (6, ""), (None, JUNK), (8, JUNK)]
    labels = [(1, 0), (2, 0), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0), (None, 1), (8, None), (9, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None, JUNK), (2, None, PROSE), (3, None, None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(hosts, "judge_urls", lambda pages, outcomes: outcomes)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        outcomes = queries.op1_url_filter(spark, str(tmp_path))
        plan = outcomes._jdf.queryExecution().explainString(outcomes._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert {(r["id"], r["good"]) for r in outcomes.collect()} == {(1, 0), (2, 1), (3, None)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(moved) >= 3 and not [m for m in moved if re.search(r"\b(text|html)#", m)]


def test_sites_and_domains(spark):
    urls = ["u:p@Shop.A.co.uk:8080", "other.co.uk", "10.0.0.1:80", "a.b.example.org", "localhost", "", "[::1]:9", "co.uk"]
    got = spark.createDataFrame([(u,) for u in urls], "host string").select(hosts.site_of(hosts.ascii_lower(F.col("host"))).alias("s")).select("s", hosts.domain_of(F.col("s")), hosts.suffix_of(F.col("s"))).collect()
    assert list(map(tuple, got)) == [
        ("shop.a.co.uk", "a.co.uk", "co.uk"), ("other.co.uk", "other.co.uk", "co.uk"), ("10.0.0.1", "10.0.0.1", ""), ("a.b.example.org", "example.org", "org"),
        ("localhost", "localhost", "localhost"), ("", "", ""), ("[::1]", "[::1]", ""), ("co.uk", "co.uk", "co.uk"),
    ]


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, stage, tmp_path):
    """Own columns keep their values, whatever they are called."""
    spark.createDataFrame([(1, "plain words of a short text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, f = corpus_pipeline.STAGES[stage]
    more = [*CLASHING, "n_tokens", "ids", "decoded_sha256", "flagged", "signs", "n", "item_id", "f0"]
    docs = awkward(spark).withColumns({c: F.lit(f"own {c}") for c in more})
    for rows in (docs, docs.limit(0)):
        out = f(spark, rows, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(out.columns)
        assert stage == 4 or len(out.columns) == len(docs.columns)
        got = out.collect()
        assert all(r[c] == f"own {c}" for r in got for c in more)
    whole = f(spark, docs, str(tmp_path)).collect()
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in whole)
    every = sorted((i or 0, t or "") for i, t in TEXTS)
    if stage == 0:
        assert all(t.strip() for _, t in kept)
    elif stage == 1:
        assert kept == every  # no line is in ten documents
    elif stage == 2:
        # One of those without words, one of equal texts, all without an id, and repeated rows together.
        assert kept == sorted((i or 0, t or "") for i, t in TEXTS if i not in (2, 3, 5))
    elif stage == 3:
        assert kept == sorted((i or 0, t or "") for i, t in TEXTS if i not in (4, 5, 12))
    else:
        assert kept == every and {r["n_tokens_"] for r in whole if r["text"] == "one"} == {1}


def test_pipeline_drops_what_it_should(spark, tmp_path):
    item = "a question about seven red boats that cross the river before the bridge is lowered again"
    plain = {i: " ".join(f"word{i}x{k}" for k in range(60)) for i in range(3)}
    rows = [(0, plain[0]), (1, plain[1]), (2, f"{plain[1]} and then"), (3, f"{plain[2]}\n{item}"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 1}

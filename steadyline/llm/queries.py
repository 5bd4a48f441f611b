"""The numbered queries: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, hosts, jaccard_join, langid, lm, resample, search, secrets, sharding, simhash
from .common import fold, table
from .line_dedup import dedup_lines

BPE_VOCAB = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the pages' own: their visible text by a model that `documents` with `labels` fit, and unwanted words of the URL."""
    pages = table(spark, sf_dir, "pages")
    cells = hosts.labelled_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return hosts.judge_urls(pages, hosts.cell_outcomes(pages, cells).distinct())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"), simhash.exact_plan(words=3, radius=2))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.secrets(docs, secrets.train(docs))
    return found.select("doc_id", *(f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.tokenized(table(spark, sf_dir, "documents"), BPE_VOCAB)
    return out.select("doc_id", "tokens.n_tokens", F.sha2("tokens.ids", 256).alias("ids_sha256"), "tokens.decoded_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = langid.train(docs.filter(~F.col("held_out")), PIECE_VOCAB)
    out = langid.identified(docs.select("doc_id", "held_out", "text"), model, PIECE_VOCAB)
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that share a passage."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2, PIECE_VOCAB)


def op10_bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for each document whose id is divisible by 50."""
    return search.bm25_top(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0, k=10)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), words=3, least=90)
    return out.withColumnRenamed("component", "component_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20, seed=42)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), min_docs=30, smoothing=5, top=50)


_ALL = (
    op1_url_filter, op2_line_dedup, op3_simhash, op4_byte_shards, op5_secret_scan, op6_bpe, op7_language_id, op8_decontamination, op9_lm_score, op10_bm25_top,
    op11_jaccard_join, op12_importance_resampling, op13_source_divergence,
)
QUERIES = {f.__name__: f for f in _ALL}

_TRIM = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _shrink(level: str, key: str, parent: str) -> str:
    """SQL of one step of shrinking `level`, which has good, n and the parent's mean."""
    return f"""
    {key}_m AS (SELECT sum((good / n - {parent}) ^ 2) AS seen, sum({parent} * (1 - {parent}) / n) AS noise, sum({parent} * (1 - {parent}) * (1 - 1 / n)) AS room
                FROM {level} WHERE n > 0 AND {parent} * (1 - {parent}) > 0),
    {key}_s AS (SELECT CASE WHEN room > 0 AND seen > noise THEN least(greatest(room / (seen - noise) - 1, {hosts.WEAKEST}), {hosts.STRONGEST}) ELSE {hosts.STRONGEST} END AS strength FROM {key}_m),
    {key}_p AS (SELECT l.*, good + strength * {parent} AS a, n - good + strength * (1 - {parent}) AS b, (good + strength * {parent}) / (n + strength) AS mean_{key} FROM {level} l, {key}_s)"""


def _cell(text: str) -> str:
    """SQL of a text's cell."""
    gone = lambda pattern: f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"
    steps = lambda part, whole, bounds: "(" + " + ".join(f"CAST(1000 * {part} > {b} * {whole} AS INT)" for b in bounds) + ")"
    inked = gone(r"[^ \t\r\n]")
    cell = f"{steps(gone(hosts.SYMBOLS), inked, hosts.SYMBOL_STEPS)} * {len(hosts.CAPITAL_STEPS) + 1} + {steps(gone('[A-Z]'), gone('[A-Za-z]'), hosts.CAPITAL_STEPS)}"
    return f"CASE WHEN {inked} > 0 THEN {cell} END"


ORACLE_SQL = {
    "op1_url_filter": f"""
WITH parsed AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), {_LOWER}) AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
placed AS (SELECT *, regexp_replace(split_part(host, '@', -1), ':[0-9]*$', '') AS site FROM parsed),
docs AS (SELECT text, quality FROM documents JOIN labels USING (doc_id)),
shown AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{hosts.MARKUP}', ' ', 'g'), '&(amp|lt|gt);', '&', 'g'), '&#?[A-Za-z0-9]{{2,8}};', 'e', 'g') AS text FROM pages),
rates AS (SELECT cell, 2 * (sum(quality) + 1) >= count(*) + 2 AS cell_good FROM (SELECT {_cell("text")} AS cell, quality FROM docs) WHERE cell IS NOT NULL AND quality IS NOT NULL GROUP BY cell),
bad AS (SELECT DISTINCT page_id, CASE WHEN regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9])({"|".join(hosts.UNWANTED)})([^a-z0-9]|$)') THEN 0 WHEN cell IS NOT NULL THEN CAST(coalesce(cell_good, true) AS INT) END AS good
        FROM (SELECT page_id, url, {_cell("text")} AS cell FROM shown) LEFT JOIN rates USING (cell)),
marked AS (SELECT site, good FROM placed LEFT JOIN bad USING (page_id)),
counted AS (SELECT site, coalesce(sum(good), 0)::DOUBLE AS good, count(good)::DOUBLE AS n FROM marked GROUP BY site),
cut AS (SELECT *, regexp_matches(site, '^([0-9.]+|\\[.*\\]?)$') AS address, string_split(site, '.') AS parts, array_to_string(list_slice(string_split(site, '.'), -2, -1), '.') AS two FROM counted),
h AS (SELECT site, good, n,
        CASE WHEN address THEN '' WHEN list_contains({hosts.SUFFIXES!r}, two) THEN two ELSE parts[-1] END AS suffix,
        CASE WHEN address THEN site WHEN list_contains({hosts.SUFFIXES!r}, two) THEN array_to_string(list_slice(parts, -3, -1), '.') ELSE two END AS domain FROM cut),
d AS (SELECT suffix, domain, sum(good) AS good, sum(n) AS n FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(good) AS good, sum(n) AS n, (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM h) AS mean_all FROM d GROUP BY suffix),
{_shrink("s", "suffix", "mean_all")},
d2 AS (SELECT d.*, mean_suffix FROM d JOIN suffix_p USING (suffix)),
{_shrink("d2", "domain", "mean_suffix")},
h2 AS (SELECT h.*, mean_domain FROM h JOIN domain_p USING (suffix, domain)),
{_shrink("h2", "host", "mean_domain")},
known AS (SELECT site, least(1.0, mean_host + {hosts.Z} * sqrt(mean_host * (1 - mean_host) / (a + b + 1))) AS bound FROM host_p),
ruled AS (
  SELECT p.*, bound, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM placed p JOIN known USING (site))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound < {hosts.MIN_GOOD} THEN 'block' ELSE 'allow' END AS verdict,
  round(bound, 6) AS reputation
FROM ruled""",
    "op2_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, translate({_TRIM}, {_LOWER}) AS key FROM each),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id""",
    "op11_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON a = d.doc_id GROUP BY d.doc_id""",
    "op12_importance_resampling": rf"""
WITH RECURSIVE step AS (SELECT n AS v, n AS c, 0 AS i FROM (SELECT unnest(range(256)) AS n) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM step WHERE i = 8),
texts AS (SELECT 1 AS raw, doc_id, text FROM documents UNION ALL SELECT 0, item_id, text FROM benchmark),
w AS (SELECT raw, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT raw, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM h, crc),
b AS (SELECT raw, doc_id, bucket FROM f JOIN k USING (f)),
c AS (SELECT bucket, count(*) FILTER (WHERE raw = 1) AS s, count(*) FILTER (WHERE raw = 0) AS t FROM b GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c),
sums AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM b JOIN g USING (bucket) WHERE raw = 1 GROUP BY doc_id),
scored AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN sums USING (doc_id) WHERE raw = 1),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id""",
    "op13_source_divergence": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n_lang) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(gn.n, 0) + 5 * v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n_lang + 5)) // (v.n + 5 * v.v)::HUGEINT AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
parts AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(z.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE count > 0 AND p > q),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranks WHERE part = 'pair' OR rank <= 50""",
}

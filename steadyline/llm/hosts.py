"""URL filter: rules, and empirical-Bayes reputation of hosts for the rest.

Labelled page outcomes (good or not) are counted per host. The counts are
shrunk from the top down: a suffix (`com`) towards the overall rate, a
registered domain (`example.com`) towards its suffix, a host towards its
domain. Each step is a beta-binomial posterior whose prior has the parent's
posterior mean, and a strength that the method of moments finds from how far
the rates at that level scatter. A host is blocked when the upper bound of its
reputation (mean and `Z` standard deviations of the posterior) stays under
`min_good`.

A page's outcome is its content's: a histogram classifier, fitted on labelled
texts, gives each cell of (share of symbols, share of capitals) its rate of good
ones, and a page is good if the cell of its visible text is. A word of a stated
list in the URL makes a page bad whatever it holds.

User names and ports do not count for reputation. An IP address is a registered
domain of its own. Suffixes of two labels are data, see `SUFFIXES`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Longest rule wins; each is (rule, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MIN_GOOD, Z, WEAKEST, STRONGEST = 0.6, 1.645, 2.0, 1000.0
#: Common suffixes of two labels, as the registries of these countries publish them.
SUFFIXES = (
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk com.au edu.au gov.au id.au net.au org.au ac.nz co.nz geek.nz govt.nz net.nz org.nz school.nz "
    "ac.jp ad.jp co.jp ed.jp go.jp gr.jp lg.jp ne.jp or.jp ac.kr co.kr go.kr ne.kr or.kr re.kr ac.cn com.cn edu.cn gov.cn net.cn org.cn com.hk edu.hk gov.hk net.hk org.hk "
    "com.tw edu.tw gov.tw net.tw org.tw com.sg edu.sg gov.sg net.sg org.sg com.my edu.my gov.my net.my org.my ac.in co.in edu.in gov.in net.in org.in res.in ac.id co.id go.id or.id web.id "
    "ac.th co.th go.th in.th or.th com.vn edu.vn gov.vn net.vn org.vn com.ph edu.ph gov.ph net.ph org.ph ac.za co.za gov.za net.za org.za web.za com.br edu.br gov.br net.br org.br "
    "com.ar edu.ar gob.ar net.ar org.ar com.mx edu.mx gob.mx net.mx org.mx com.co edu.co gov.co net.co org.co com.pe edu.pe gob.pe net.pe org.pe com.tr edu.tr gov.tr net.tr org.tr "
    "ac.il co.il gov.il net.il org.il com.ua edu.ua gov.ua net.ua org.ua com.pl edu.pl gov.pl net.pl org.pl"
).split()
#: Words in a URL that make a page an unwanted one.
UNWANTED = "adult bet bets betting casino jackpot lottery pharma pills poker porn slots spam viagra xxx".split()


def url_host(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def site_of(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", "")


def _is_address(site: Column) -> Column:
    return site.rlike(r"^([0-9.]+|\[.*\]?)$")


def suffix_of(site: Column) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(_is_address(site), "").when(two.isin(SUFFIXES), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(_is_address(site), site).when(two.isin(SUFFIXES), F.substring_index(site, ".", -3)).otherwise(two)


def wanted(url: Column) -> Column:
    """1 if no word of the URL is among UNWANTED, else 0. Words lie between characters that are neither letters nor digits."""
    return 1 - F.coalesce(F.lower(url), F.lit("")).rlike(rf"(^|[^a-z0-9])({'|'.join(UNWANTED)})([^a-z0-9]|$)").cast("long")


#: What is no visible text: scripts, styles, comments, tags.
MARKUP = r"(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style|!--.*?--|[^>]*)>"
#: Signs that prose has little of.
SYMBOLS = r"[#$%&*+<=>@\\^_`{|}~]"
#: Bounds of the cells, in parts of a thousand of a text's characters (symbols) and of its letters A-Z (capitals).
SYMBOL_STEPS, CAPITAL_STEPS = (2, 10, 50), (100, 300, 600)


def visible(html: Column) -> Column:
    """The text of a page: markup becomes blanks, `&amp;`, `&lt;` and `&gt;` one sign, other entities one letter."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), MARKUP, " ")
    return F.regexp_replace(F.regexp_replace(text, "&(amp|lt|gt);", "&"), "&#?[A-Za-z0-9]{2,8};", "e")


def _with_cell(rows: DataFrame) -> DataFrame:
    """rows: `text` and others. The cell in place of the text, by whole numbers alone; null for a text of blanks or none. Each count is a column, so that it is made once, and runs of characters go at once."""
    gone = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern + "+", ""))
    counted = rows.withColumns({"symbols": gone(SYMBOLS), "capitals": gone("[A-Z]"), "letters": gone("[A-Za-z]"), "inked": gone("[^ \\t\\r\\n]")})
    steps = lambda part, whole, bounds: sum(((1000 * F.col(part) > b * F.col(whole)).cast("int") for b in bounds), F.lit(0))
    cell = F.when(F.col("inked") > 0, steps("symbols", "inked", SYMBOL_STEPS) * (len(CAPITAL_STEPS) + 1) + steps("capitals", "letters", CAPITAL_STEPS))
    return counted.withColumn("cell", cell).drop("text", "symbols", "capitals", "letters", "inked")


def labelled_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(cell, quality): a row for each document and label of one id. A task turns its texts into cells before the join, which moves ids and small numbers alone."""
    cells = _with_cell(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return cells.join(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("quality")), "id").select("cell", "quality")


def content_outcomes(pages: DataFrame, texts: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`cell_outcomes` of texts: (text, quality 0/1), labelled."""
    text, quality = (F.col(c) for c in texts.columns[:2])
    return cell_outcomes(pages, _with_cell(texts.select(text.alias("text"), quality.cast("int").alias("quality"))), id_col, url_col, html_col)


def cell_outcomes(pages: DataFrame, cells: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, good): what each page's content and URL say of it. cells: (cell, quality 0/1) of labelled texts.

    A cell is good if at least half of its labelled texts are, counted with one
    more of either kind; so is one that no labelled text fell into. A page without
    visible text has a null outcome, unless its URL has an unwanted word. Texts
    without a label or without a visible character count nothing; repeated rows
    count each time. The fitted table has a row per cell, 16 at most.
    """
    rates = cells.filter("quality is not null and cell is not null")
    rates = rates.groupBy("cell").agg((2 * (F.sum("quality") + 1) >= F.count("*") + 2).cast("long").alias("cell_good"))
    judged = _with_cell(pages.select(F.col(id_col).alias("id"), visible(F.col(html_col)).alias("text"), wanted(F.col(url_col)).alias("wanted")))
    joined = judged.join(F.broadcast(rates), "cell", "left")
    good = F.when(F.col("wanted") == 0, F.lit(0)).when(F.col("cell").isNotNull(), F.coalesce("cell_good", F.lit(1)))
    return joined.select("id", good.cast("long").alias("good"))


def _shrunk(level: DataFrame, key: str, parent: str) -> DataFrame:
    """level: (key, good, n, mean_parent). Adds strength and the posterior's a, b and mean.

    The strength is one number for the whole level: with p the units' rates and
    m their parents' means, moments give E[(p-m)^2] = m(1-m)(1/n + r(1-1/n)),
    r = 1 / (strength + 1).
    """
    spread = F.col(parent) * (1 - F.col(parent))
    moments = level.filter((F.col("n") > 0) & (spread > 0)).agg(
        F.sum(F.pow(F.col("good") / F.col("n") - F.col(parent), 2)).alias("seen"), F.sum(spread / F.col("n")).alias("noise"), F.sum(spread * (1 - 1 / F.col("n"))).alias("room")
    )
    r = (F.col("seen") - F.col("noise")) / F.col("room")
    strength = F.when((F.col("room") > 0) & (r > 0), F.least(F.greatest(1 / r - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST))
    level = level.crossJoin(F.broadcast(moments.select(strength.alias("strength"))))  # one row
    a = F.col("good") + F.col("strength") * F.col(parent)
    b = F.col("n") - F.col("good") + F.col("strength") * (1 - F.col(parent))
    return level.select("*", a.alias("a"), b.alias("b"), (a / (a + b)).alias(f"mean_{key}"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """outcomes: (site, good 0/1/null), a row per page. One row per site: good, n, mean and bound.

    A null outcome counts for neither side; a site without labelled pages has
    its domain's reputation; a corpus without any has the mean 0.5 everywhere.
    Each level is a written table, counted once and small beside the pages.
    """
    sites = outcomes.groupBy("site").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("n"))
    sites = written(sites.withColumns({"domain": domain_of(F.col("site")), "suffix": suffix_of(F.col("site"))}), "sites")
    domains = written(sites.groupBy("suffix", "domain").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "suffixes")
    overall = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean_all"))
    suffixes = written(_shrunk(suffixes.crossJoin(F.broadcast(overall)), "suffix", "mean_all").select("suffix", "mean_suffix"), "suffix-means")
    domains = written(_shrunk(domains.join(suffixes, "suffix"), "domain", "mean_suffix").select("domain", "mean_domain"), "domain-means")
    sites = _shrunk(sites.join(domains, "domain"), "site", "mean_domain")
    mean = F.col("mean_site")
    upper = F.least(F.lit(1.0), mean + Z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1)))
    return written(sites.select("site", "good", "n", mean.alias("mean"), upper.alias("bound")), "reputations")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, min_good: float = MIN_GOOD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, reputation (the bound).

    outcomes: (id, good), 1 for a good page and 0 for a bad one; several rows of
    an id count once each. A null url, or one without `://`, has an empty host
    and path, no rule, and the reputation of the empty host. Repeated rows get
    equal verdicts. Other columns, whatever their names, are not read. Empty
    tables give no rows, and no outcomes a mean of 0.5, which blocks nothing.
    """
    parsed = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    parsed = parsed.withColumn("site", site_of(F.col("host")))
    labelled = parsed.select("id", "site").join(outcomes.select(F.col(outcomes.columns[0]).alias("id"), F.col(outcomes.columns[1]).alias("good")), "id", "left")
    known = reputations(labelled.select("site", "good"))
    judged = parsed.withColumn("fits", rule_for(F.col("host"), F.col("path"), rules)).join(known.select("site", "bound"), "site", "left")
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("bound") < min_good, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), F.round("bound", 6).alias("reputation"))

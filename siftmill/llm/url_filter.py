"""URL rules and empirical-Bayes host reputation (operator 10, native).

Labelled page outcomes (bad 1, good 0) are counted per host. Each level's rate is
shrunk towards its parent's by a beta prior: all pages -> suffix -> registered
domain -> host. A prior's weight is estimated per level by moments from the
spread of the groups' rates around their parents' (bounded to 1..1000 pages). A
host is blocked when the lower bound of its posterior rate of bad pages (mean
minus ``Z`` standard deviations of the beta posterior) is at least ``LIMIT``.
Unlabelled hosts carry their parents' rate and so can be blocked by a domain's
or suffix's record, never by their own absence.

A host's suffix is its last label, or its last two where the table ``SUFFIXES`` has
them, and its registered domain has one label more. The table holds common public
suffixes of two labels, not all: hosts under others share one "domain". Ports do not
count; an IP address is its own domain, under a suffix of its own kind.

A rule (host, path, verdict) fits its host and all subdomains when the page's
path starts with the rule's; the longest rule wins, over the method too.

Defined cases: a null url or one without "://" has empty host and path and is
judged like an unlabelled host without a suffix; repeated rows are judged each;
an empty table gives no row; null outcomes are not counted; other columns stay,
columns with the names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import materialize

#: The rules of the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Public suffixes of two labels.
SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz net.nz ac.nz co.jp or.jp ne.jp ac.jp go.jp co.kr or.kr"
    " com.cn net.cn org.cn gov.cn edu.cn com.tw org.tw com.hk org.hk com.sg com.my co.in net.in org.in ac.in co.id or.id co.th in.th com.ph com.vn"
    " com.br net.br org.br gov.br com.ar com.mx com.co com.pe com.ve com.uy com.tr org.tr gov.tr com.ua co.il org.il ac.il co.za org.za com.eg com.sa"
    " com.ng co.ke com.pk com.bd com.pl net.pl org.pl com.ru co.at or.at com.pt com.es com.gr"
).split()
Z = 1.645
LIMIT = 0.5
#: Hosts that are broadcast at most, and the share of all pages (1 in so many) that makes a host hot.
FEW, HOT = 50_000, 1000


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r":[0-9]*$", "")


def _is_address(host: Column) -> Column:
    return _bare(host).rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")


def suffix_of(host: Column) -> Column:
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(_is_address(host), "").when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(_is_address(host), bare).when(two.isin(*SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        out = F.when(fits, F.struct(F.lit(at + under).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shrunk(counts: DataFrame, level: str, parent_rate: str) -> tuple[DataFrame, float]:
    """A level's posterior rates from (n, bad) and the parent's rate, and the prior's weight."""
    p, r = F.col("bad") / F.col("n"), F.col(parent_rate)
    # method of moments: between-group variance around the parents' rates
    spread = counts.where("n > 0").agg((F.sum(F.col("n") * F.pow(p - r, 2)) / F.sum("n")).alias("v"), (F.sum(r * (1 - r)) / F.sum("n")).alias("noise"), (F.sum(F.col("n") * r * (1 - r)) / F.sum("n")).alias("pq"))
    row = spread.first()
    weight = 1.0 if row["v"] is None else min(max(row["pq"] / max(row["v"] - row["noise"], 1e-9) - 1, 1.0), 1000.0)
    w = F.lit(weight)
    return counts.withColumn(f"{level}_rate", (F.col("bad") + w * r) / (F.col("n") + w)), weight


def reputations(pages: DataFrame) -> DataFrame:
    """Per host of ``pages`` (host, bad nullable): pages, n (labelled), bad, posterior mean and bound.

    Pages are counted per host once, with partial counts before the exchange, and written;
    all levels are read from that table. The driver gathers four numbers a level."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((whole["bad"] or 0) + 1) / ((whole["n"] or 0) + 2)
    s, _ = _shrunk(suffixes.withColumn("all_rate", F.lit(overall)), "suffix", "all_rate")
    domains = materialize(domains.join(s.select("suffix", "suffix_rate"), "suffix"), "domains")
    d, _ = _shrunk(domains, "domain", "suffix_rate")
    known = hosts.join(d.select("domain", "suffix", "domain_rate"), ["domain", "suffix"])
    h, weight = _shrunk(known, "host", "domain_rate")
    mean, total = F.col("host_rate"), F.col("n") + F.lit(weight)
    bound = mean - F.lit(Z) * F.sqrt(mean * (1 - mean) / (total + 1))
    return materialize(h.select("host", "pages", "n", "bad", mean.alias("bad_rate"), bound.alias("bad_rate_low")), "reputations")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (url, bad nullable 0/1) plus host, path, rule, bad_rate,
    bad_rate_low and verdict; columns of these names are replaced.

    The hosts' rates are broadcast when they are ``FEW`` at most. Beyond that the hosts
    with over 1 / ``HOT`` of all pages, fewer than ``HOT`` by count, are broadcast, and
    only the pages of the others are exchanged."""
    pages = pages.drop("host", "path", "rule", "bad_rate", "bad_rate_low", "verdict")
    rows = pages.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    known = reputations(rows.select("host", "bad"))
    rates = known.select("host", "bad_rate", "bad_rate_low")
    size = known.agg(F.count("*").alias("hosts"), F.sum("pages").alias("pages")).first()
    if size["hosts"] <= FEW:
        joined = rows.join(F.broadcast(rates), "host", "left")
    else:
        hot = F.col("pages") * HOT > size["pages"]
        often, seldom = known.where(hot).select("host", "bad_rate", "bad_rate_low"), known.where(~hot).select("host", "bad_rate", "bad_rate_low")
        joined = rows.join(F.broadcast(often), "host").unionByName(rows.join(F.broadcast(often), "host", "left_anti").join(seldom, "host", "left"))
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_rate_low") >= LIMIT, "block").otherwise("allow")
    columns = [*pages.columns, "host", "path"]
    return joined.select(*columns, ruled["rule"].alias("rule"), "bad_rate", "bad_rate_low", F.coalesce(ruled["verdict"], by_method).alias("verdict"))

"""Filtering URLs by rules and by empirical-Bayes host reputation, in SQL
functions only.

Outcomes of labelled pages are counted by host. A host's rate of bad pages is
shrunk to that of its registered domain, that to the rate of its suffix, and
that to the rate of all, each through a beta prior whose strength is estimated
from how much the rates differ at that level. A host is blocked if its rate is
above a limit with a given posterior probability: that is, if the quantile of
its beta posterior that bounds the rate from below is above the limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: (verdict, host, path); a rule's name is its host and path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Suffixes of several labels under which others register names. A short list, not
#: the public one: under a suffix that is missing here, all share one domain.
SUFFIXES = (
    *("ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk".split()),
    *("com.au edu.au gov.au id.au net.au org.au co.nz govt.nz net.nz org.nz co.za org.za".split()),
    *("ac.jp co.jp go.jp ne.jp or.jp ac.kr co.kr go.kr or.kr com.cn edu.cn gov.cn net.cn org.cn com.hk com.sg com.tw org.tw".split()),
    *("ac.in co.in gov.in net.in org.in co.id co.il org.il co.th com.my com.ph com.vn com.tr org.tr com.ua".split()),
    *("com.ar com.br gov.br net.br org.br com.co com.mx org.mx com.pe com.eg com.sa co.ke com.ng com.pl net.pl org.pl".split()),
    *("github.io gitlab.io blogspot.com blogspot.co.uk wordpress.com herokuapp.com netlify.app pages.dev vercel.app web.app".split()),
)
#: Hosts that are IP addresses, not names.
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*)$"
#: Bad rate that a blocked host exceeds, the least probability of that, and the
#: range that a prior's strength is held to.
LIMIT, CERTAIN, WEAKEST, STRONGEST = 0.5, 0.95, 1.0, 1000.0
#: Simpson steps on either side of the limit, and where the integral ends.
STEPS, REACH = 200, 12.0


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to / ? # or the end; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:]), reverse=True)[::-1]:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(level: DataFrame) -> float:
    """The prior strength at a level, by moments: rows of n, bad, prior."""
    spread = F.col("prior") * (1 - F.col("prior"))
    found = level.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), F.lit(2)) - spread), F.sum(spread * (F.col("n") - 1))).first()
    if not found[1]:
        return STRONGEST
    return max(WEAKEST, min(STRONGEST, 1 / max(found[0] / found[1], 1 / (1 + STRONGEST)) - 1))


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def beta_above(a: Column, b: Column, limit: float = LIMIT) -> Column:
    """Probability that a beta variable (a, b > 0) is above ``limit``.

    The density of its logit t is a*softplus(-t) + b*softplus(t) below its top,
    and is integrated over u in t = mode + sinh(u) / sqrt(curvature) by Simpson's
    rule on both sides of the limit: a peak has unit width in u, and a long tail
    of a small a or b ends within REACH. The error is below 1e-6."""
    mode, scale = F.log(a / b), F.sqrt((a + b) / (a * b))
    height = lambda t: a * _softplus(-t) + b * _softplus(t)
    cut = F.asinh((F.lit(math.log(limit / (1 - limit))) - mode) / scale)

    def side(end: Column) -> Column:
        step = (end - cut) / STEPS

        def point(i: Column) -> Column:
            u = cut + step * i
            weight = F.when((i == 0) | (i == STEPS), 1.0).otherwise(2.0 + 2.0 * (i % 2))
            return weight * F.exp(height(mode) - height(mode + scale * F.sinh(u))) * F.cosh(u)

        return F.abs(step) * F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda acc, i: acc + point(i))

    upper, lower = side(F.greatest(cut, F.lit(0.0)) + REACH), side(F.least(cut, F.lit(0.0)) - REACH)
    return upper / (upper + lower)


def reputation(outcomes: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(host, n, bad), a row for each host -> host, n, bad, rate, above: the mean
    of the rate's posterior, and the probability that the rate is above ``limit``.

    Hosts need not be labelled (n = 0): they have their domain's rate. The suffix
    of a host is its longest one of SUFFIXES, else its last label; its registered
    domain has one label more. IP addresses are domains of their own. What comes
    to the driver is the strength of each level, a number."""
    parts = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    by = {n: [s for s in SUFFIXES if s.count(".") == n - 1] for n in (2, 3)}
    pick = lambda more, ip: F.when(F.col("host").rlike(ADDRESS), ip).when(last(3).isin(by[3]), last(3 + more)).when(last(2).isin(by[2]), last(2 + more)).otherwise(last(1 + more))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    hosts = materialize(outcomes.select("host", number("n"), number("bad"), pick(1, F.col("host")).alias("domain"), pick(0, F.lit("an address")).alias("suffix")))
    total = lambda level, *by: level.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def shrunk(level: DataFrame) -> DataFrame:
        """Rows with n, bad, prior -> also the posterior's a and b, and rate."""
        k = F.lit(_strength(level))
        level = level.withColumns({"a": F.col("bad") + k * F.col("prior"), "b": F.col("n") - F.col("bad") + k * (1 - F.col("prior"))})
        return level.withColumn("rate", F.col("a") / (F.col("a") + F.col("b")))

    domains = materialize(total(hosts, "domain", "suffix"))
    suffixes = materialize(total(domains, "suffix"))
    n, bad = total(suffixes).first()
    suffixes = shrunk(suffixes.withColumn("prior", F.lit(((bad or 0.0) + 0.5) / ((n or 0.0) + 1))))
    domains = materialize(shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("prior")), "suffix")).select("domain", "suffix", F.col("rate").alias("prior")))
    level = materialize(shrunk(materialize(hosts.join(domains, ["domain", "suffix"]))))
    return level.select("host", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), "rate", beta_above(F.col("a"), F.col("b"), limit).alias("above"))


def judge_pages(pages: DataFrame, labels: DataFrame, limit: float = LIMIT, certain: float = CERTAIN) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``labels`` (page_id, bad 0/1) are outcomes of some pages; repeated labels of
    a page count once, by the worse. A null url, or one without ``://``, has an
    empty host, which has a reputation like any other. User names and ports are
    part of the host, but hosts that differ in these alone share a reputation.
    Repeated rows each count and each have a row; other columns of ``pages``,
    whatever their names, are not read; urls of any length are read whole. A hot
    host is counted before it is shuffled, and its pages meet one row.
    """
    told = labels.groupBy("page_id").agg(F.max("bad").alias("_bad")).withColumnRenamed("page_id", "_id")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = materialize(rows.withColumn("_name", name_of(F.col("host"))))
    counted = rows.join(told, F.col("page_id") == F.col("_id"), "left").groupBy(F.col("_name").alias("host")).agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    known = materialize(reputation(counted, limit).select(F.col("host").alias("_host"), "above"))
    rows = rows.join(known, F.col("_name") == F.col("_host")).withColumn("_rule", rule_of(F.col("host"), F.col("path")))
    method = F.when(F.col("above") >= certain, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"))


def numbered_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of the pages whose path names a labelled document: its
    second part begins with the document's number, as in ``/en/25.html``. Bad is
    low quality or toxic; null labels tell nothing."""
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    told = labels.select(F.col("doc_id").cast("string").alias("_doc"), bad.alias("bad")).where("bad is not null").groupBy("_doc").agg(F.max("bad").alias("bad"))
    at = F.regexp_extract(path_of(F.col("url")), r"^/[^/]*/([0-9]+)", 1)
    return pages.select("page_id", at.alias("_number")).where("page_id is not null and _number <> ''").join(told, F.col("_number") == F.col("_doc")).select("page_id", "bad")


#: DuckDB SQL of the query: levels as common table expressions, the posterior
#: probability by the midpoint rule over the logit's range.
_STRENGTH = "SELECT coalesce(greatest({weakest}, least({strongest}, 1 / greatest(sum(n * pow(bad / n - prior, 2) - prior * (1 - prior)) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 1 / (1 + {strongest})) - 1)), {strongest}) AS k FROM {level} WHERE n > 0"
_DENSITY = "list_sum(list_transform(range(4000), lambda i: exp(top - a * (greatest(-({t}), 0) + ln(1 + exp(-abs({t})))) - b * (greatest({t}, 0) + ln(1 + exp(-abs({t}))))) * {step}))"


def judge_sql() -> str:
    strength = lambda level: _STRENGTH.format(weakest=WEAKEST, strongest=STRONGEST, level=level)
    known = ", ".join(f"'{s}'" for s in SUFFIXES)
    cut = math.log(LIMIT / (1 - LIMIT))
    above = _DENSITY.format(t=f"({cut} + (i + 0.5) / 4000 * (high - {cut}))", step=f"(high - {cut}) / 4000")
    below = _DENSITY.format(t=f"(low + (i + 0.5) / 4000 * ({cut} - low))", step=f"({cut} - low) / 4000")
    rules = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)))
    return rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS name FROM u),
d AS (SELECT CAST(doc_id AS VARCHAR) AS doc, max(greatest(CAST(quality = 0 AS INT), CAST(toxic = 1 AS INT))) AS bad FROM labels GROUP BY 1),
o AS (SELECT page_id, max(bad) AS bad FROM p JOIN d ON regexp_extract(path, '^/[^/]*/([0-9]+)', 1) = doc WHERE page_id IS NOT NULL GROUP BY 1),
h AS (SELECT name, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad, string_split(name, '.') AS w FROM p LEFT JOIN o USING (page_id) GROUP BY name),
m AS (SELECT *, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN 0 WHEN array_to_string(w[-3:], '.') IN ({known}) AND len(w) >= 3 THEN 3 WHEN array_to_string(w[-2:], '.') IN ({known}) AND len(w) >= 2 THEN 2 ELSE 1 END AS c FROM h),
host_ AS (SELECT name, n, bad, CASE c WHEN 0 THEN name ELSE array_to_string(w[-c - 1:], '.') END AS domain, CASE c WHEN 0 THEN 'an address' ELSE array_to_string(w[-c:], '.') END AS suffix FROM m),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 0.5) / (sum(sum(n)) OVER () + 1) AS prior FROM host_ GROUP BY suffix),
s2 AS (SELECT suffix, (bad + k * prior) / (n + k) AS rate FROM s1, ({strength("s1")})),
d1 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS prior FROM host_ JOIN s2 USING (suffix) GROUP BY domain, suffix),
d2 AS (SELECT domain, suffix, (bad + k * prior) / (n + k) AS rate FROM d1, ({strength("d1")})),
h1 AS (SELECT name, n, bad, rate AS prior FROM host_ JOIN d2 USING (domain, suffix)),
h2 AS (SELECT name, bad + k * prior AS a, n - bad + k * (1 - prior) AS b FROM h1, ({strength("h1")})),
h3 AS (SELECT name, a, b, a * ln((a + b) / a) + b * ln((a + b) / b) AS top, least({cut}, ln(a / b)) - 60 / sqrt(least(a, a * b / (a + b))) AS low,
         greatest({cut}, ln(a / b)) + 60 / sqrt(least(b, a * b / (a + b))) AS high FROM h2),
v AS (SELECT name, CASE WHEN above / (above + below) >= {CERTAIN} THEN 'block' ELSE 'allow' END AS verdict FROM (SELECT name, {above} AS above, {below} AS below FROM h3)),
r AS (SELECT page_id, host, path, name, CASE {rules} END AS rule FROM p)
SELECT page_id, host, path, split_part(rule, ' ', 2) AS rule, coalesce(split_part(rule, ' ', 1), verdict) AS verdict FROM r JOIN v USING (name)
"""


JUDGE_SQL = judge_sql()

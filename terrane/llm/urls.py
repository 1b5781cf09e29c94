"""URL filters by empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes are counted for each host. A beta prior is fitted from suffix to
registered domain to host: each level's rate is shrunk towards the level above with the weight
that the spread of rates at that level supports (method of moments), so a host with few labels or
none has the reputation of its domain, and that the one of its suffix. A host is blocked if its
bad rate exceeds a threshold with a posterior probability of at least ``CONFIDENCE``, that is if
the lower quantile of its beta posterior lies above it; the threshold follows from the base rate
of the data. Explicit rules come first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.expressions import ascii_lower
from terrane.session import checkpointed


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Second labels under which a country's domains are registered (``co.uk``, ``com.au``).
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Hosting services whose customers are each on a name of their own.
SHARED_HOSTS = ("appspot.com", "azurewebsites.net", "blogspot.com", "firebaseapp.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "tumblr.com", "vercel.app", "web.app", "weebly.com", "wixsite.com", "wordpress.com")
#: A bad rate counts as too high if its odds are so many times those of all labelled pages.
LIFT = 2.0
#: Posterior probability of a too high rate at which a host is blocked.
CONFIDENCE = 0.95
#: Bounds of the prior's weight in pseudo-observations.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0
#: Intervals of the numeric integral on each side of the threshold; even.
STEPS = 200


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without login, port and final dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")


def _levels(host: Column) -> tuple[Column, Column, Column]:
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    long = two.isin(*SHARED_HOSTS) | (two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$"))
    return name, two, F.coalesce(long, F.lit(False))


def suffix_of(host: Column) -> Column:
    """The part below which domains are registered; empty for an address in numbers."""
    name, two, long = _levels(host)
    return F.when(name.rlike(r"^[0-9.]+$|\["), F.lit("")).when(long, two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix with one label more; an address in numbers is its own."""
    name, two, long = _levels(host)
    return F.when(name.rlike(r"^[0-9.]+$|\["), name).when(long, F.substring_index(name, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does."""
    chain = F
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chain = chain.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict")))
    return chain.otherwise(F.lit(None)) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def _weight(level: DataFrame, mean: Column | str, least: float = LEAST_WEIGHT, most: float = MOST_WEIGHT) -> float:
    """Method-of-moments weight of the beta prior over a level: from ``(n, k)`` and the mean above.

    The excess of the observed variance around the means over binomial noise is the spread of
    true rates; a spread of rho of the largest possible is a weight of 1 / rho - 1.
    """
    mean = F.col(mean) if isinstance(mean, str) else mean
    over = F.sum(F.pow(F.col("k") - F.col("n") * mean, 2) - F.col("n") * mean * (1 - mean))
    room = F.sum(F.col("n") * (F.col("n") - 1) * mean * (1 - mean))
    row = level.agg(over.alias("over"), room.alias("room")).first()
    if not row["room"] or row["over"] is None or row["over"] <= 0:
        return most
    return min(most, max(least, row["room"] / row["over"] - 1))


def _integral(low: Column, high: Column, a: Column, b: Column, top: Column) -> Column:
    """Simpson's rule over the log odds ``y`` of ``exp(a ln x + b ln(1 - x) - top)``, where x has odds exp(y)."""
    step = (high - low) / STEPS
    # ln x = -ln(1 + exp(-y)), ln(1 - x) = -ln(1 + exp(y)), each written so that no exponential overflows.
    log1p = lambda y: F.greatest(y, F.lit(0.0)) + F.log1p(F.exp(-F.abs(y)))
    value = lambda y: F.exp(-a * log1p(-y) - b * log1p(y) - top)
    weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + weight(i) * value(low + i * step)) * step / 3


def exceeds(a: Column, b: Column, threshold: float) -> Column:
    """The probability that a rate with a beta posterior of parameters ``a`` and ``b`` exceeds the threshold.

    Integrated numerically over the log odds, where the density is smooth and falls off
    exponentially on both sides, whatever the parameters.
    """
    cut = math.log(threshold / (1 - threshold))
    mode = F.log(a / b)
    # Beyond these ends less than 1e-10 of the mass is left.
    low, high = mode - 8 / F.sqrt(a) - 25 / a - 8 / F.sqrt(b), mode + 8 / F.sqrt(b) + 25 / b + 8 / F.sqrt(a)
    top = a * F.log(a / (a + b)) + b * F.log(b / (a + b))
    at = F.least(F.greatest(F.lit(cut), low), high)
    below, above = _integral(low, at, a, b, top), _integral(at, high, a, b, top)
    return above / (below + above)


def reputations(pages: DataFrame, outcomes: DataFrame, lift: float = LIFT) -> DataFrame:
    """``(host, n, k, bad_rate, too_bad)`` of every host: labels, bad ones, shrunken rate, and probability of a too high rate.

    ``pages`` has ``(page_id, host)``, ``outcomes`` ``(page_id, bad)``; a page or label that occurs
    several times counts as often. Only per-level sums of two numbers reach the driver. Counting
    is by partial aggregation over pages and labels that were each summed by page before they are
    joined, so neither a hot host nor a hot page costs more than any other.
    """
    by_page = outcomes.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("label_page")).agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    times = pages.where("host <> ''").groupBy("host", "page_id").agg(F.count("*").alias("times"))
    counts = times.join(by_page, F.col("page_id") == F.col("label_page"), "left").groupBy("host").agg(F.sum(F.col("times") * F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.col("times") * F.coalesce("k", F.lit(0))).alias("k"))
    hosts = checkpointed(counts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = (total["k"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.5
    up = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    w = _weight(up, F.lit(rate))
    suffixes = up.select(F.col("suffix").alias("s"), ((F.col("k") + w * rate) / (F.col("n") + w)).alias("above"))
    mid = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    mid = checkpointed(mid.join(suffixes, mid.suffix == suffixes.s).select("domain", "n", "k", "above"))
    w = _weight(mid, "above")
    domains = mid.select(F.col("domain").alias("d"), ((F.col("k") + w * F.col("above")) / (F.col("n") + w)).alias("above"))
    low = checkpointed(hosts.join(domains, hosts.domain == domains.d).select("host", "n", "k", "above"))
    w = _weight(low, "above")
    posterior = low.select("host", "n", "k", (F.col("k") + w * F.col("above")).alias("a"), (F.col("n") - F.col("k") + w * (1 - F.col("above"))).alias("b"))
    odds = lift * rate / (1 - rate)
    return posterior.select("host", "n", "k", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"), exceeds(F.col("a"), F.col("b"), odds / (1 + odds)).alias("too_bad"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, lift: float = LIFT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``verdict`` is the longest fitting rule's (of equally long ones the first by name; none here are),
    else ``block`` if the odds of the host's bad rate exceed ``lift`` times the base odds with a
    posterior probability of ``confidence`` or more, else ``allow``. A page is bad if its label, the
    row of ``labels`` with its id, says low quality or toxic; a null in a label counts as not bad.
    Null urls and urls without ``://`` have empty host and path and are allowed. Repeated rows each
    give a row; repeated labels each count; other columns do not matter; an empty table gives an
    empty result, and without labels no host is blocked.
    """
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    outcomes = labels.select(F.col("doc_id").cast("long").alias("page_id"), bad.alias("bad"))
    poor = reputations(placed.select("page_id", "host"), outcomes, lift).where(F.col("too_bad") >= confidence).select(F.col("host").alias("poor"))
    fit = matched_rule(F.col("host"), F.col("path"), rules)
    joined = placed.join(poor, placed.host == poor.poor, "left").withColumn("fit", fit)
    verdict = F.coalesce("fit.verdict", F.when(F.col("poor").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def _duck_rules(rules: tuple[Rule, ...]) -> str:
    rows = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.name}')" for r in rules)
    return f"rules(verdict, rhost, rpath, rule) AS (VALUES {rows})"


def _duck_weight(level: str, mean: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(room, 0) = 0 OR over_ IS NULL OR over_ <= 0 THEN {MOST_WEIGHT} ELSE least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, room / over_ - 1)) END
      FROM (SELECT sum(power(k - n * {mean}, 2) - n * {mean} * (1 - {mean})) AS over_, sum(n * (n - 1) * {mean} * (1 - {mean})) AS room FROM {level}))"""


_NAME = r"regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g')"
_TWO, _THREE = "array_to_string(string_split(nm, '.')[-2:], '.')", "array_to_string(string_split(nm, '.')[-3:], '.')"
_LONG = f"({_TWO} IN ({', '.join(f"'{x}'" for x in SHARED_HOSTS)}) OR regexp_matches({_TWO}, '^({'|'.join(SECOND_LEVEL)})\\.[a-z][a-z]$'))"
_NUMBERS = r"regexp_matches(nm, '^[0-9.]+$|\[')"
#: The probability is summed up by the midpoint rule here, a way of its own.
ORACLE = rf"""
WITH {_duck_rules(RULES)},
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hn AS (SELECT host, {_NAME} AS nm, count(doc_id) AS n, sum(CASE WHEN coalesce(quality = 0, false) OR coalesce(toxic = 1, false) THEN 1 ELSE 0 END) AS k FROM u LEFT JOIN labels ON doc_id = page_id WHERE host <> '' GROUP BY host),
h AS (SELECT host, CASE WHEN {_NUMBERS} THEN nm WHEN {_LONG} THEN {_THREE} ELSE {_TWO} END AS dm, CASE WHEN {_NUMBERS} THEN '' WHEN {_LONG} THEN {_TWO} ELSE string_split(nm, '.')[-1] END AS sx, n, k FROM hn),
g AS (SELECT CASE WHEN coalesce(sum(n), 0) > 0 THEN (sum(k) + 0.5) / (sum(n) + 1.0) ELSE 0.5 END AS rate FROM h),
s0 AS (SELECT sx, sum(n) AS n, sum(k) AS k, (SELECT rate FROM g) AS above FROM h GROUP BY sx),
w0 AS (SELECT {_duck_weight("s0", "above")} AS w),
s1 AS (SELECT sx, (k + w * above) / (n + w) AS above FROM s0, w0),
d0 AS (SELECT dm, sx, sum(n) AS n, sum(k) AS k FROM h GROUP BY dm, sx),
d1 AS (SELECT dm, n, k, above FROM d0 JOIN s1 USING (sx)),
w1 AS (SELECT {_duck_weight("d1", "above")} AS w),
d2 AS (SELECT dm, (k + w * above) / (n + w) AS above FROM d1, w1),
h1 AS (SELECT host, n, k, above FROM h JOIN d2 USING (dm)),
w2 AS (SELECT {_duck_weight("h1", "above")} AS w),
b AS (SELECT host, k + w * above AS a, n - k + w * (1 - above) AS b, ln({LIFT} * rate / (1 - rate)) AS cut FROM h1, w2, g),
e AS (SELECT host, a, b, cut, ln(a / b) - 8 / sqrt(a) - 25 / a - 8 / sqrt(b) AS low, ln(a / b) + 8 / sqrt(b) + 25 / b + 8 / sqrt(a) AS high FROM b),
q AS (SELECT host, a, b, cut, low + (high - low) * (i + 0.5) / 20000 AS y FROM e, (SELECT unnest(range(20000)) AS i)),
v AS (SELECT host, y > cut AS over_, exp(-a * (greatest(-y, 0) + ln(1 + exp(-abs(y)))) - b * (greatest(y, 0) + ln(1 + exp(-abs(y)))) - a * ln(a / (a + b)) - b * ln(b / (a + b))) AS f FROM q),
poor AS (SELECT host FROM v GROUP BY host HAVING sum(CASE WHEN over_ THEN f ELSE 0 END) / sum(f) >= {CONFIDENCE}),
fit AS (SELECT page_id, host, path, arg_max(rule, (length(rule), rule)) AS rule, arg_max(verdict, (length(rule), rule)) AS v FROM (SELECT DISTINCT page_id, host, path FROM u) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.v, CASE WHEN u.host IN (SELECT host FROM poor) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit ON fit.page_id IS NOT DISTINCT FROM u.page_id AND fit.host = u.host AND fit.path = u.path
"""

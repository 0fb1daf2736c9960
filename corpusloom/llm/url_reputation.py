"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host.  A host's bad rate has a
beta prior centred on its registered domain's posterior mean, a domain's on its
suffix's, a suffix's on the rate of all.  Each level's prior strength is estimated
from the spread of its groups' rates by the method of moments for groups of unequal size, with one
standard error added to the spread, so that groups are never held to be all alike for want of
labels.  A host is blocked if the lower bound of its posterior (mean minus ``z`` standard deviations)
exceeds ``cutoff``: what a few pages show is not enough, what many show is.
Rules come first: a rule names a host and a path prefix, fits the host and all its
subdomains, and the longest that fits decides.

Counts are aggregated from pages to hosts with partial sums, so a host with a third of all
pages costs one row per task; hosts, domains and suffixes are ever smaller tables.

Defined results
* null url, or one without ``://``: host and path empty, judged as the host ''.
* a host without labelled pages: its prior alone.  No labels at all: rate 0, all allowed.
* one group only, or one page a group: nothing is known of the spread, the prior counts as one page.
* null outcome: not counted.  null page_id and repeated rows: each row is judged and counted.
* very long urls: whole.  Two rules of equal length that fit: block wins.
* other columns, whatever their names: ignored.  Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels; a deployment passes the public list.
TWO_PART = ("co.uk", "com.au", "co.jp", "com.br")
#: What a host takes in a broadcast, and the most that all may take.
HOST_ROW, BROADCAST_BYTES = 200, 64 << 20
#: A prior counts as one page at least.
LEAST_STRENGTH = 1.0

def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffix_of(host: Column, two_part: tuple[str, ...] = TWO_PART) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_part), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_part: tuple[str, ...] = TWO_PART) -> Column:
    """Registered domain: the suffix and one label more."""
    return F.when(F.substring_index(host, ".", -2).isin(*two_part), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.  rules: (verdict, host/path prefix)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[0] == "block")):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(rate: float, bad: str, n: str) -> Column:
    """Prior strength of the groups of one level (an aggregate): rate (1 - rate) / variance between groups - 1."""
    size, v = F.col(n).cast("double"), F.lit(rate * (1 - rate))
    off = F.try_divide(F.col(bad), size) - F.lit(rate)
    total, more = F.sum(size), F.count(F.when(size > 0, 1)) - 1
    free = 1 - F.try_divide(F.sum(size * size), total * total) - F.try_divide(more, total)
    free = F.when(free > 1e-9, free)
    counting = v * F.try_divide(more, total)  # the spread that counting alone gives, and below its standard error
    between = F.greatest(F.try_divide(F.sum(size * off * off), total) - counting, F.lit(0.0)) + v * F.try_divide(F.sqrt(2 * F.greatest(more, F.lit(1))), total)
    return F.greatest(F.coalesce(F.try_divide(v, between / free) - 1, F.lit(LEAST_STRENGTH)), F.lit(LEAST_STRENGTH))


def reputations(outcomes: DataFrame, z: float = 2.0, two_part: tuple[str, ...] = TWO_PART) -> DataFrame:
    """(host, n, bad, mean, low): posterior of every host.  outcomes: (host, bad 0/1/null)."""
    counted = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    hosts = materialize(counted.withColumn("domain", domain_of(F.col("host"), two_part)).withColumn("suffix", suffix_of(F.col("host"), two_part)), "host-counts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate = suffixes.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0))).first()[0]
    strengths = [t.agg(_strength(rate, "bad", "n")).first()[0] for t in (suffixes, domains, hosts)]
    shrink = lambda prior, k: (F.col("bad") + k * prior) / (F.col("n") + k)
    top = suffixes.select("suffix", shrink(F.lit(rate), strengths[0]).alias("suffix_mean"))
    middle = domains.join(top, "suffix").select("domain", shrink(F.col("suffix_mean"), strengths[1]).alias("domain_mean"))
    mean = shrink(F.col("domain_mean"), strengths[2])
    judged = hosts.join(middle, "domain").select("host", "n", "bad", mean.alias("mean"))
    return judged.withColumn("low", F.col("mean") - z * F.sqrt(F.greatest(F.col("mean") * (1 - F.col("mean")), F.lit(0.0)) / (F.col("n") + strengths[2] + 1)))


def word_in(host: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in a host between dots or hyphens."""
    return host.rlike("(^|[.-])(" + "|".join(words) + ")([.-]|$)")


def judge_urls(pages: DataFrame, outcome: Column, rules: list[tuple[str, str]], cutoff: float = 0.5, z: float = 2.0, page_id: str = "page_id", url: str = "url", two_part: tuple[str, ...] = TWO_PART) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, low) of every page; ``outcome`` is 1 for a bad page, 0, or null.

    ``low`` is what decides where no rule fits.
    """
    read = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"), outcome.cast("int").alias("bad"))
    read = materialize(read, "page-urls")
    known = materialize(reputations(read, z, two_part).select(F.col("host").alias("known"), "mean", "low"), "host-reputations")
    if known.count() * HOST_ROW <= BROADCAST_BYTES:  # else shuffled by host, where adaptive execution splits a host with a third of all pages
        known = F.broadcast(known)
    joined = read.join(known, F.col("host") == F.col("known")).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("low") > cutoff, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "mean", "low")

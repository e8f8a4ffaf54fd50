"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

Built-in functions only. Every URL is canonicalised; a Bloom filter of the listed URLs (bounded size, broadcast) marks
possible hits, and only those are shuffled to an exact hash join that removes the false positives. Rules come first:
of the rules whose host is the URL's host or a parent domain and whose path starts the URL's path, the longest decides;
URLs without a rule are blocked if listed and allowed otherwise.

Defined cases: a rule ``org/`` asks for a path that starts with ``/``, which an empty path does not; a null URL or one without ``://`` has empty host and path, no rule, no canonical form, and is allowed;
repeated rows are each judged; an empty list blocks nothing; other columns of the input are kept, and the result's
own columns replace input columns of the same name (an input column whose name starts with ``__`` is not allowed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower

#: Fixed values of the query: (verdict, host and path prefix).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Query parameters that say where a visitor came from, not which page is meant.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes, sorted query without tracking; null without host."""
    site = F.regexp_replace(host(url), r"^www\.|:(80|443)$", "")
    place = F.regexp_replace(path(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(site != "", F.concat(site, place, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def matching_rule(site: Column, place: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none; of equally long ones, the one first in text order."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, start = text.partition("/")
        fits = (site == name) | site.endswith("." + name)
        if slash:
            fits = fits & place.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """``pages`` with host, path, canonical_url, rule, listed, verdict; ``listed`` has URLs to block in ``listed_col``."""
    block = listed.select(canonical(F.col(listed_col)).alias("canonical_url")).filter("canonical_url IS NOT NULL").distinct()
    own = ("host", "path", "canonical_url", "rule", "listed", "verdict")
    url = F.col("__url")
    base = pages.withColumn("__url", F.col(url_col)).drop(*[c for c in own if c != url_col])
    judged = base.withColumn("host", host(url)).withColumn("path", path(url)).withColumn("canonical_url", canonical(url)).drop("__url")
    hits, rest = bloom.split(judged, "canonical_url", block, block.count())
    both = hits.withColumn("listed", F.lit(True)).unionByName(rest.withColumn("listed", F.lit(False)))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return both.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))

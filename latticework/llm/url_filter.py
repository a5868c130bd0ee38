"""URL verdicts from host/path rules and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_filter, probe

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change the page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """verdict for a host with all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`_url`"))).otherwise(F.lit(""))


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """df with host and path: host follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased;
    path goes on to '?', '#' or the end. Null urls and urls without '://' have both empty."""
    rest = F.coalesce(_after_scheme(F.col("_url")), F.lit(""))
    return (
        df.withColumn("_url", F.col(url_col).cast("string")).withColumn("_rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("_rest", "^([^/?#]*)", 1), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
    )


def with_canonical(df: DataFrame) -> DataFrame:
    """canonical: host, path without final slashes, other than tracking parameters in order; no scheme or fragment."""
    query = F.regexp_extract("_rest", "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return df.withColumn("canonical", F.concat("host", F.regexp_replace("path", "/+$", ""), tail))


def best_rule(rules: list[Rule]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits host and path; null if none does."""
    fits = []
    for r in rules:
        host = (F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")
        fits.append(F.when(host & F.col("path").startswith(r.path), F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def url_verdicts(pages: DataFrame, rules: list[Rule], listed: DataFrame, url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """pages with host, path, canonical, rule, listed and verdict (clashing names are replaced).

    The longest fitting rule decides. Other urls are blocked if their canonical form is among the canonical
    forms of `listed`, else allowed: a blocked Bloom filter of the list passes every listed url and few others,
    and only what passes is joined exactly with the list, which removes the false hits. Rules are a list in the
    driver and become part of the plan; the list of urls may be of any size.

    Null urls and urls without '://' have empty host and path, no rule and are not listed. Repeated rows are
    judged each; extra columns stay, whatever their names. An empty list blocks nothing.
    """
    new = ["host", "path", "canonical", "rule", "listed", "verdict"]
    listed_urls = with_canonical(with_parts(listed.select(F.col(listed_col).alias("_u")), "_u")).where("host <> ''").select(F.col("canonical").alias("_listed")).distinct()
    bloom, blocks = bloom_filter(listed_urls, "_listed", listed_urls.count())
    keep = [c for c in pages.columns if c not in new]
    # the caller's columns travel as one, so that no name of theirs meets a name used here
    judged = with_canonical(with_parts(pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(url_col).cast("string").alias("_u")), "_u"))
    judged = judged.withColumn("_best", best_rule(rules) if rules else F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))
    out = [*[F.col("_row")[c].alias(c) for c in keep], *new]
    ruled = judged.withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.col("_best.verdict"))
    probed = probe(ruled, "canonical", bloom, blocks).withColumn("_maybe", F.col("_maybe") & F.col("rule").isNull() & (F.col("host") != ""))
    sure = probed.where(~F.col("_maybe")).withColumn("listed", F.lit(False))
    maybe = probed.where("_maybe").join(listed_urls, F.col("canonical") == F.col("_listed"), "left").withColumn("listed", F.col("_listed").isNotNull())
    both = sure.select("_row", *new[:3], "rule", "listed", "verdict").unionByName(maybe.select("_row", *new[:3], "rule", "listed", "verdict"))
    return both.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))).select(*out)

"""URL filters: block and allow rules on hosts and path prefixes, joined on short hash prefixes.

Each URL is expanded into every host suffix (at a dot) and every path prefix of a length that some rule
has. An expression is looked up by the first 32 bits of its SHA-256 digest; the full digest then confirms
the match, and of the rules that fit a URL the longest wins. DataFrame functions only.

Defined results: a null URL, or one without ``://``, has an empty host and path. An empty rule host fits
only an empty host. Of fitting rules of equal length the one with the longer host wins, then block before
allow. Repeated rules count once and repeated rows are all judged. An empty rule table leaves every verdict
at the default. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written, with_outputs

PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _digest(host: Column, path: Column) -> Column:
    """The length keeps ``a`` + ``b/`` and ``ab`` + ``/`` apart."""
    return F.sha2(F.concat_ws("", F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _hashed_rules(rules: DataFrame) -> DataFrame:
    clean = rules.select(F.coalesce("host", F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v"))
    one = clean.groupBy("h", "p").agg(F.max("v").alias("v"))  # "block" sorts after "allow"
    digest = _digest(F.col("h"), F.col("p"))
    return one.select(
        F.substring(digest, 1, PREFIX_HEX).alias("prefix"), digest.alias("digest"), F.length(F.concat("h", "p")).alias("rule_length"), F.length("h").alias("host_length"), F.concat("h", "p").alias("rule"), "v"
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default_verdict: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: host, path, verdict ("block" or "allow"). The distinct path lengths of the rules go to the driver:
    there are no more of them than the longest rule path has characters.
    """
    lengths = sorted(r[0] for r in rules.select(F.length(F.coalesce("path", F.lit("")))).distinct().collect())
    judged = with_outputs(pages, host=url_host(F.col(url_col)), path=url_path(F.col(url_col)))
    if not lengths:
        return with_outputs(judged, rule=F.lit(None).cast("string"), verdict=F.lit(default_verdict))
    urls = judged.select("host", "path").distinct()
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = (
        urls.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("suffix"))
        .select("host", "path", "suffix", F.explode(prefixes).alias("start"))
        .select("host", "path", _digest(F.col("suffix"), F.col("start")).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    best = written(  # written, so that Spark can split the join of a URL that many rows have
        expanded.join(_hashed_rules(rules).withColumnRenamed("digest", "rule_digest"), "prefix")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("rule_length", "host_length", "v", "rule")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("_tw_rule"), F.col("best.v").alias("_tw_verdict"))
    )
    found = judged.join(best, ["host", "path"], "left")
    return with_outputs(found, rule=F.col("_tw_rule"), verdict=F.coalesce("_tw_verdict", F.lit(default_verdict))).drop("_tw_rule", "_tw_verdict")

"""URL filters: rules for hosts and paths, and gradient-boosted trees for the URLs that no rule fits.

The trees see lexical features only: length, depth, share of digits, entropy, parameters, and statistics
of the host's suffix over all pages. They are fitted on a bounded sample of labelled URLs, which are those
that a rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import ROW, spread_join
from mediasift.sources.shared import stored

#: Labelled URLs that the trees are fitted on at most, those with the least hash.
SAMPLE_ROWS = 20_000
TREES, DEPTH = 12, 4


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# The rules, each for a host with its subdomains and a beginning of the path.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

FEATURES = (
    "url_length host_length path_length depth labels digits entropy params query_length hyphens encoded over_length over_params over_depth"
).split()


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to the first `/`, `?` or `#`, with A-Z in lower case; empty for null or without `://`."""
    raw = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?` or `#`; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_first(rules: Sequence[Rule]) -> list[Rule]:
    """Longest host and path together first; of equal ones the longer host, then as given."""
    return sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host)))


def rule_fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_rules(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, with null fields if none does."""
    chosen = lambda field: F.coalesce(*[F.when(rule_fits(host, path, r), field(r)) for r in longest_first(rules)])
    return F.struct(chosen(lambda r: r.host + r.path).alias("rule"), chosen(lambda r: r.verdict).alias("verdict"))


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def entropy_of(text: Column) -> Column:
    """Bits a character, over the characters that occur."""
    n = F.length(text).cast("double")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def parsed(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Of each row, stored: `ROW`, page_id, host, path, rule, verdict, suffix and lexical features."""
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", url.alias("__url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn(ROW, F.monotonically_increasing_id()).withColumn("__rule", by_rules(F.col("host"), F.col("path"), rules))
    u, host, path = F.col("__url"), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    features = {
        "url_length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/"),
        "labels": _count(host, ".") + 1,
        "digits": _count(u, "0123456789") / (F.length(u) + 1.0),
        "entropy": entropy_of(u),
        "params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "query_length": F.length(query).cast("double"),
        "hyphens": _count(host, "-"),
        "encoded": _count(u, "%"),
    }
    out = rows.withColumns(features).withColumn("suffix", F.substring_index("host", ".", -1))
    return stored(out.select(ROW, "page_id", "host", "path", "__rule.rule", "__rule.verdict", "suffix", *features), "url-filter-rows")


def with_suffixes(rows: DataFrame) -> DataFrame:
    """`rows` with what they exceed the means of their suffix by: length, parameters, depth.

    Means are taken over all rows. The suffix itself is no feature: rules that name some suffixes only
    would else decide on all others by what they are not.
    """
    measures = {"length": "url_length", "params": "params", "depth": "depth"}
    means = rows.groupBy("suffix").agg(*[F.avg(c).alias(f"__mean_{k}") for k, c in measures.items()])
    joined = spread_join(rows, means, "suffix")
    return joined.withColumns({f"over_{k}": F.col(c) - F.col(f"__mean_{k}") for k, c in measures.items()})


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Of each row: page_id, host, path, rule (null if none fits), verdict, and the trees' chance of block.

    A rule's verdict stands; other URLs are blocked from a chance of 0.5 on. Null and empty URLs have an
    empty host and path and are judged by the trees; repeated rows are judged alike; an empty table gives
    no rows. If the rules label all URLs alike, or none, the chance is the share of blocked labels (0
    without labels).
    """
    rows = with_suffixes(parsed(pages, rules))
    labelled = rows.where("verdict is not null").withColumn("__label", (F.col("verdict") == "block").cast("double"))
    sample = stored(labelled.orderBy(F.xxhash64("host", "path", "page_id")).limit(SAMPLE_ROWS).select("__label", *FEATURES), "url-filter-sample")
    shares = sample.agg(F.avg("__label"), F.count(F.lit(1))).first()
    if not shares[1] or shares[0] in (0.0, 1.0):
        chance = rows.withColumn("chance", F.lit(float(shares[0] or 0.0)))
    else:
        # rules name what to block more often than what to allow; both count for half
        sample = sample.withColumn("__weight", F.when(F.col("__label") == 1, 0.5 / shares[0]).otherwise(0.5 / (1 - shares[0])))
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
        trees = GBTClassifier(
            featuresCol="__features", labelCol="__label", weightCol="__weight", maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1
        ).fit(assembler.transform(sample).select("__features", "__label", "__weight"))
        said = trees.transform(assembler.transform(rows))
        chance = said.withColumn("chance", vector_to_array("probability")[1])
    verdict = F.coalesce("verdict", F.when(F.col("chance") >= 0.5, "block").otherwise("allow"))
    return chance.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "chance")

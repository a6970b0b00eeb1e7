"""Secrets by pattern, told apart by how many owners hold them across the whole corpus.

Base patterns give spans that always stay. Further candidates (a secret-like name with a value, tokens
that mix letters and digits at high entropy) are kept only if the corpus says that they are one owner's:
each candidate's hash is counted by distinct repositories and owners, and one that several owners hold is
a copied example. Base spans get the same counts, as columns.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import ROW, spread_join, whole_text
from mediasift.sources.shared import stored

#: Kinds in the order of the output; the last two are the method's own.
KINDS = ("assign", "access", "hex", "named", "mixed")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMED = re.compile(r"""(passphrase|pwd|credentials?|private_?key|access_?key|auth|bearer)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", re.I | re.A)
MIXED = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LEAST_VALUE = 12
#: Bits a character of a mixed token has at least.
LEAST_ENTROPY = 3.5

#: Owners from which on a candidate is a copied example.
EXAMPLE_OWNERS = 3

FOUND = "array<struct<kind:int,start:int,stop:int,value:string>>"


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(token.count(c) / n * math.log2(token.count(c) / n) for c in set(token))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, secret value) in code points; own kinds only where no base span lies."""
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    own = [(3, m.start(), m.end(), m[2]) for m in NAMED.finditer(text)]
    for m in MIXED.finditer(text):
        t = m[0]
        if not t.islower() and any("0" <= c <= "9" for c in t) and any("a" <= c <= "z" for c in t) and any("A" <= c <= "Z" for c in t) and _entropy(t) >= LEAST_ENTROPY:
            own.append((4, m.start(), m.end(), t))
    # base spans that begin before a stop are a prefix by start; one meets the own span if the prefix's last end does
    base = sorted((a, b) for _, a, b, _ in found)
    starts, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    kept_end = 0
    for span in sorted(own, key=lambda x: (x[1], x[0])):
        before = bisect_left(starts, span[2])
        if kept_end <= span[1] and (before == 0 or ends[before - 1] <= span[1]):
            found.append(span)
            kept_end = span[2]
    return sorted(found, key=lambda x: (x[1], x[0]))


def find(text: Column) -> Column:
    """All candidates of each whole text; none for null and empty texts."""

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [[{"kind": k, "start": a, "stop": b, "value": v} for k, a, b, v in candidates(t or "")] for t in batch],
                dtype=object,
            )

    return found(text)


def scanned(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Of each row, stored: `ROW`, doc_id, repo, owner and `found` with a hash in place of each value."""
    rows = docs.select(
        F.monotonically_increasing_id().alias(ROW),
        F.col("doc_id"),
        repository.alias("repo"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        find(whole_text()).alias("found"),
    )
    hashed = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.sha2(x["value"], 256).alias("hash")))
    return stored(rows.withColumn("found", hashed), "secret-scan-rows")


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of each candidate, counted over all rows of `scanned`.

    Each step combines before it shuffles, and none gathers the rows of a hash.
    """
    each = rows.select("repo", "owner", F.explode(F.array_distinct(F.transform("found", lambda x: x["hash"]))).alias("hash"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("documents"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("documents").alias("documents"))
    return by_owner.groupBy("hash").agg(
        F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("documents").alias("documents")
    )


def scan(docs: DataFrame, repository: Column, owner: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Of each row: doc_id and `spans`, an array of (start, kind, stop, owners, repositories, live).

    Base spans always stay; the method's own stay where fewer than `example_owners` owners hold the
    value (`live`). Null and empty texts have no spans; a null owner is an owner of its own; repeated
    rows count as one repository and get the same spans; very long texts are read whole, in time that follows
    their length; of own spans that meet, the first stays; further columns are not read, whatever their names;
    an empty table gives no rows.
    """
    rows = scanned(docs, repository, owner)
    each = rows.select(ROW, F.inline("found"))
    counted = spread_join(each, ownership(rows), "hash").withColumn("live", F.col("owners") < example_owners)
    base = F.col("kind") < KINDS.index("named")
    span = F.struct("start", "kind", "stop", "owners", "repositories", "live")
    spans = counted.where(base | F.col("live")).groupBy(ROW).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,owners:bigint,repositories:bigint,live:boolean>>")
    return rows.select(ROW, "doc_id").join(spans, ROW, "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")

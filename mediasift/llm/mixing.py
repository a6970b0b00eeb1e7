"""Mixing to target weights with soft membership: classifier posteriors, then rates by least squares.

Domains are the quality labels of the labelled table. A multinomial classifier over surface measures
of the text gives every document its posterior over domains, and with its tokens the share it is expected
to add to each. Nonnegative rates (expected copies of a document) are fitted so that the expected tokens
of each domain meet their targets: weighted least squares by projected gradient, distributed over the
documents. The step of a document is its posterior times the weighted misses, one number for each domain,
so an iteration is one aggregation over a compact table and its result a handful of numbers; a document's
rate is a closed expression of the misses so far and is never stored between iterations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import packed, unpacked, whole_text
from mediasift.sources.shared import stored

#: Labelled rows that the classifier is fitted on at most, those with the least hash of their id.
SAMPLE_ROWS = 5_000

ROUNDS = 40
#: Length of the steps over all rows; any below 2 leads to the minimum.
LONGER = 1.9
#: Relative miss of all domains at which iterations end.
CLOSE = 1e-7

MEASURES = ("length", "word", "digit", "symbol", "upper", "lines", "marks")


@dataclass
class Posteriors:
    """Names of the domains, and the fitted classifier (none where every row is sure of the one domain)."""

    domains: list[str]
    model: LogisticRegressionModel | None

    def on(self, measured_rows: DataFrame) -> DataFrame:
        """Rows with measures, and with `__p0`, `__p1`, ...: their posterior over the domains."""
        if self.model is None:
            return measured_rows.withColumn("__p0", F.lit(1.0))
        said = self.model.transform(_assembler().transform(measured_rows))
        shares = said.withColumn("__shares", vector_to_array("__probability"))
        added = ("__features", "__raw", "__probability", "__prediction", "__shares")
        return shares.withColumns({f"__p{k}": F.col("__shares")[k] for k in range(len(self.domains))}).drop(*added)


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[f"__{m}" for m in MEASURES], outputCol="__features")


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \t\n\\x0B\f\r]+"))).cast("long")


def measures_of(text: Column, tokens: Column) -> dict[str, Column]:
    """Surface measures: logarithm of the length, and shares of characters of several kinds."""
    n = F.length(text)
    share = lambda drop: (n - F.length(F.translate(text, drop, ""))) / (n + 1.0)
    return {
        "length": F.log1p(n.cast("double")),
        "word": n / (tokens + 1.0),
        "digit": share("0123456789"),
        "symbol": share("#$%&*+/<=>@[\\]^_{|}~"),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "lines": share("\n"),
        "marks": share(".,;:!?'\"()-"),
    }


def with_measures(frame: DataFrame) -> DataFrame:
    """`frame` with `__tokens` and the measures of its text."""
    known = frame.withColumn("__tokens", tokens_of(whole_text()))
    return known.withColumns({f"__{k}": v for k, v in measures_of(whole_text(), F.col("__tokens")).items()})


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, measures and the hash that decides copies, of each row, stored: texts are read once."""
    rows = with_measures(docs.select("doc_id", "text")).withColumn("__turn", turn_of())
    return stored(rows.drop("text"), "mixing-measures")


def domain_of() -> Column:
    """Domain of a labelled row: `quality0` or `quality1`."""
    return F.concat(F.lit("quality"), F.col("quality").cast("string"))


def posteriors(rows: DataFrame, labels: DataFrame) -> Posteriors:
    """Classifier from measured rows (stored) to the domains that the labelled table has.

    A document labelled more than once counts in its least domain; labels with a null are left out. With
    no labelled document at all there is the one domain `all`; with one domain it is everyone's.
    """
    named = labels.where("doc_id is not null").select("doc_id", domain_of().alias("domain")).where("domain is not null")
    named = named.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    numbers = rows.select("doc_id", *[f"__{m}" for m in MEASURES])
    sample = numbers.join(F.broadcast(named.orderBy(F.xxhash64("doc_id")).limit(SAMPLE_ROWS)), "doc_id")
    sample = stored(sample.dropDuplicates(["doc_id"]), "mixing-sample")  # bounded by SAMPLE_ROWS ids
    domains = sorted(r["domain"] for r in sample.select("domain").distinct().collect())
    if len(domains) < 2:
        return Posteriors(domains or ["all"], None)
    place = F.coalesce(*[F.when(F.col("domain") == d, float(i)) for i, d in enumerate(domains)])
    fitted = _assembler().transform(sample.withColumn("__label", place)).select("__features", "__label").coalesce(1).cache()
    learner = LogisticRegression(featuresCol="__features", labelCol="__label", family="multinomial", regParam=1e-4, maxIter=40)
    model = learner.setRawPredictionCol("__raw").setProbabilityCol("__probability").setPredictionCol("__prediction").fit(fitted)
    fitted.unpersist()
    return Posteriors(domains, model)


Steps = tuple[np.ndarray, ...]


def rate_after(steps: Steps, least: float, domains: int) -> Column:
    """Rate of a row with `__p0`, `__p1`, ...: one copy, less each step by its posterior, never below `least`."""
    rate: Column = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(float(least)), rate - sum(F.col(f"__p{k}") * float(step[k]) for k in range(domains)))
    return rate


def _summed(table: DataFrame, steps: Steps, domains: int, least: float, free: bool) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain after `steps`; overlap of the domains in the rows that are `free`: above `least`, or all.

    The steps go to the tasks as numbers and not into the plan, which is the same in every round.
    """
    names = [f"__p{k}" for k in range(domains)]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((domains + 1, domains))
        for batch in batches:
            p, tokens = batch[names].to_numpy(dtype=np.float64), batch["tokens"].to_numpy(dtype=np.float64)
            rate = np.ones(len(p))
            for step in steps:
                rate = np.maximum(least, rate - p @ step)
            total[0] += (rate * tokens) @ p
            counts = tokens * (rate > least) if free else tokens
            total[1:] += (p * counts[:, None]).T @ p
        i, j = np.divmod(np.arange(total.size), domains)
        yield pd.DataFrame({"i": i, "j": j, "value": total.ravel()})

    out = np.zeros((domains + 1, domains))
    found = table.select("tokens", *names).mapInPandas(add_up, "i int, j int, value double")
    for r in found.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = r["value"]
    return out[0], out[1:]


def totals(table: DataFrame, rate: Column, domains: int) -> np.ndarray:
    """Expected tokens of each domain at the given rates."""
    row = table.withColumn("__rate", rate).agg(*[F.sum(F.col("__rate") * F.col("tokens") * F.col(f"__p{k}")) for k in range(domains)]).first()
    return np.array([s or 0.0 for s in row], dtype=np.float64)


def rates(table: DataFrame, targets: np.ndarray, least: float = 0.0) -> Column:
    """`fitted` without what it misses."""
    return fitted(table, targets, least)[0]


def fitted(table: DataFrame, targets: np.ndarray, least: float = 0.0) -> tuple[Column, np.ndarray]:
    """Rate, and the misses of the domains over the sum of all targets, of each row of `table` (tokens, `__p0`, `__p1`, ...) that brings domain totals to `targets`.

    Starts from one copy of each and takes projected-gradient steps for the weighted squares of the
    misses over rates of `least` or more, rows scaled by their tokens. Weights are the inverse of the
    domains' overlap (the Gram matrix of tokens times posteriors), under which the step length is 1; they
    are taken over the rows that are not at `least`, which is the whole way once those stay the same. If
    such a step does not lessen the misses, the targets cannot all be met, and the rest of the steps keep
    to the weights over all rows.
    """
    n = len(targets)
    scale = float(max(targets.sum(), 1.0))
    steps: Steps = ()
    best, best_steps, best_miss, free, weight_all = np.inf, steps, np.zeros(n), True, None
    for _ in range(ROUNDS):
        sums, gram = _summed(table, steps, n, least, free and weight_all is not None)
        miss = (sums - targets) / scale
        weight = np.linalg.inv(gram / scale + np.eye(n) * max(1e-12, 1e-6 * np.trace(gram) / scale / n))
        weight_all = weight if weight_all is None else weight_all
        now = float(miss @ weight_all @ miss)
        if np.abs(miss).max() < CLOSE:
            return rate_after(steps, least, n), miss
        if now >= best and free:
            free, steps, best = False, best_steps, np.inf
            continue
        if now >= best * (1 - 1e-6):
            break
        best, best_steps, best_miss = now, steps, miss
        steps = (*steps, (weight if free else LONGER * weight_all) @ miss)
    return rate_after(best_steps, least, n), best_miss


def table_of(rows: DataFrame, found: Posteriors) -> DataFrame:
    """Compact stored table of measured rows: doc_id, tokens, `__turn`, `__p0`, `__p1`, ..."""
    shares = [f"__p{k}" for k in range(len(found.domains))]
    return stored(found.on(rows).select("doc_id", F.col("__tokens").alias("tokens"), "__turn", *shares), "mixing-posteriors")


def targets_of(now: np.ndarray, weights: Sequence[float], shrink: bool) -> np.ndarray:
    """Token targets in the ratio of `weights` over the domains that have tokens.

    With `shrink` they add up to the present tokens; without, the total is the least at which no domain
    has to lose any.
    """
    w = np.where(now > 0, np.array(weights, dtype=np.float64), 0.0)
    if not w.sum():
        return now.copy()
    w = w / w.sum()
    total = now.sum() if shrink else max((s / x for s, x in zip(now, w, strict=True) if x > 0), default=0.0)
    return np.where(w > 0, total * w, 0.0 if shrink else now)


def tilted(domains: Sequence[str], now: np.ndarray, tilt: dict[str, float]) -> list[float]:
    """Weights in the ratio of the present totals, each times its factor in `tilt` (1 if missing)."""
    return [float(s) * tilt.get(d, 1.0) for d, s in zip(domains, now, strict=True)]


def turn_of(seed: int = 42) -> Column:
    """A number from 0 to below 1 that decides a row's fraction of a copy; equal rows have the same."""
    bits = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), whole_text(), F.lit(seed)), F.lit(1 << 30))
    return bits / float(1 << 30)


def copies_of(rate: Column, turn: Column) -> Column:
    """Whole copies: the rate rounded down, or up with its fraction as the chance."""
    return (F.floor(rate) + F.when(turn < rate - F.floor(rate), 1).otherwise(0)).cast("int")


#: What the mix asks for: good documents gain, poor ones lose part of their share.
TILT = {"quality1": 1.0, "quality0": 0.6}


def mixed(docs: DataFrame, labels: DataFrame, tilt: dict[str, float] = TILT) -> tuple[DataFrame, list[str]]:
    """Each row with doc_id, tokens, posterior, rate and copies; and the domains of the posterior.

    `missed` is the largest difference of a domain's expected tokens from its target, as a share of all
    tokens asked for: where bounds on rates forbid the targets, it says by how much they are not met.

    Null and empty texts have no tokens and do not count towards any target; repeated rows are rows of
    their own; an empty table gives no rows. Domains that the labels lack cannot be asked for.
    """
    rows = measured(docs)
    found = posteriors(rows, labels)
    table, n = table_of(rows, found), len(found.domains)
    now = totals(table, F.lit(1.0), n)
    rate, miss = fitted(table, targets_of(now, tilted(found.domains, now, tilt), shrink=True))
    out = table.withColumn("rate", rate).withColumn("copies", copies_of(F.col("rate"), F.col("__turn")))
    shares = F.array(*[f"__p{k}" for k in range(n)]).alias("posterior")
    return out.select("doc_id", "tokens", shares, "rate", "copies", F.lit(float(np.abs(miss).max())).alias("missed")), found.domains


def remix(docs: DataFrame, labels: DataFrame, tilt: dict[str, float] = TILT) -> DataFrame:
    """The documents, each repeated as its rate asks and none left out, all columns as they came, whatever their names.

    Targets have the tilted ratio at a total where no domain has to lose tokens; rates are 1 or more. The
    fitted rate is a closed expression of a text's measures, so documents are read once more and neither
    joined nor copied aside.
    """
    rows = measured(docs)
    found = posteriors(rows, labels)
    table, n = table_of(rows, found), len(found.domains)
    now = totals(table, F.lit(1.0), n)
    rate = rates(table, targets_of(now, tilted(found.domains, now, tilt), shrink=False), least=1.0)
    whole = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    judged = found.on(with_measures(whole)).withColumn("__copies", copies_of(rate, turn_of()))
    return unpacked(judged.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))))

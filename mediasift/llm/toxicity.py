"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels come with documents, so tokens are labelled from them first: a word feature (the word itself, its
beginnings and ends) that is significantly commoner in toxic documents of the sample marks the tokens that
carry it, in toxic documents. The field has two states; a token's emission is the sum of its features'
weights. Forward and backward messages between two states are ratios, each the last one under a fractional
linear map; the maps of a whole batch lie end to end in flat arrays and are composed in blocks, so that
long texts and short ones cost the same per token. Sums of a document's marginals give its score by a
logistic curve fitted on sample documents the field was not trained on.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import packed, parts_of, unpacked, whole_text
from mediasift.sources.shared import stored

#: Bounds of the labelled sample that is fitted: rows of each label, and characters in all.
SAMPLE_ROWS = 1200
SAMPLE_CHARS = 8_000_000
#: Features that a model keeps at most, the most telling first, and what makes one telling.
MOST_FEATURES = 20_000
LEAST_Z = 2.5
LEAST_DOCS = 3
LEAST_LEAD = 2.8

ROUNDS, RATE, RIDGE = 32, 0.4, 1e-4
#: Share of the sample that the score curve is fitted on.
CURVE_EVERY = 3

PART_CHARS = 2_000_000
PART_TOKENS = 100_000
MOST_WORDS = 150_000
SPAN_LEAST = 0.5

RESULT = "struct<score:double,spans:array<struct<start:int,stop:int,toxic:double>>>"

WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The lower-cased word, its beginnings of 3 to 7 characters and its ends of 3 to 5."""
    w = word.lower()
    out = ["=" + w]
    out += ["^" + w[:k] for k in range(3, 8) if len(w) > k]
    out += ["$" + w[-k:] for k in range(3, 6) if len(w) > k]
    return out


@dataclass
class ToxicModel:
    """Weights of features, transitions (log, row: from) with the start as a third row, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 2)))
    curve: np.ndarray | None = None
    prior: float = 0.0

    def emissions(self, words: list[str]) -> np.ndarray:
        get = self.weights.get
        return np.clip(np.array([self.bias + sum(get(f, 0.0) for f in features(w)) for w in words], dtype=np.float64), -30, 30)


def _chained(m00: np.ndarray, m01: np.ndarray, m10: np.ndarray, m11: np.ndarray) -> np.ndarray:
    """Ratios r[t] = (m01 + r m11) / (m00 + r m10) of r[t-1], from r = 1, for maps that lie end to end.

    Blocks of equal length run side by side: first each block's maps are composed, then the ratio enters
    block after block, then all blocks go through their ratios at once.
    """
    n = len(m00)
    width = max(1, math.isqrt(n))
    lanes = -(-n // width)
    maps = [np.append(m, np.full(lanes * width - n, float(i in (0, 3)))).reshape(lanes, width).T.copy() for i, m in enumerate((m00, m01, m10, m11))]
    a, b, c, d = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for w, x, y, z in zip(*maps, strict=True):
        a, b, c, d = a * w + b * y, a * x + b * z, c * w + d * y, c * x + d * z
        scale = a + b + c + d
        a, b, c, d = a / scale, b / scale, c / scale, d / scale
    enter, r = np.empty(lanes), 1.0
    for i, (w, x, y, z) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        enter[i] = r
        r = (x + r * z) / (w + r * y)
    out, r = np.empty((width, lanes)), enter
    for i, (w, x, y, z) in enumerate(zip(*maps, strict=True)):
        r = (x + r * z) / (w + r * y)
        out[i] = r
    return out.T.ravel()[:n]


def messages(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic to clean) of all tokens; `first` marks where texts begin."""
    e, m = np.exp(emission), np.exp(moves)
    t00, t01 = np.where(first, m[2, 0], m[0, 0]), np.where(first, m[2, 1], m[0, 1]) * e
    t10, t11 = np.where(first, m[2, 0], m[1, 0]), np.where(first, m[2, 1], m[1, 1]) * e
    forward = _chained(t00, t01, t10, t11)
    # a token's backward ratio comes from the map of the token behind it
    backward = _chained(*[np.r_[[1.0, 1.0, 1.0, 1.0][i], x[:0:-1]] for i, x in enumerate((t00, t10, t01, t11))])[::-1]
    return forward, backward


def marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    forward, backward = messages(emission, first, moves)
    odds = forward * backward
    return odds / (1 + odds)


class WordScores:
    """Emissions of the words that a task has met."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = defaultdict(count().__next__)
        self.scores = np.zeros(0)

    def of(self, words: list[list[str]]) -> np.ndarray:
        if len(self.codes) > MOST_WORDS:
            self._clear()
        known = len(self.codes)
        at = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), dtype=np.int64)
        self.scores = np.concatenate([self.scores, self.model.emissions(list(islice(self.codes, known, None)))])
        return self.scores[at]


def _measures(toxic: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the curve sees of each text: expected toxic tokens, odds of any, and their density."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    expected = np.bincount(owner, weights=toxic, minlength=len(sizes))
    none = np.bincount(owner, weights=-np.log1p(-np.minimum(toxic, 1 - 1e-9)), minlength=len(sizes))
    any_odds = np.clip(np.log(np.expm1(np.clip(none, 1e-5, 30))), -10, 10)
    density = np.log((expected + 0.05) / (sizes / 50 + 1))
    return np.stack([np.ones(len(sizes)), np.log1p(expected), any_odds, density], axis=1)


def _score(model: ToxicModel, toxic: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if model.curve is None:
        return np.full(len(sizes), model.prior)
    return 1 / (1 + np.exp(-np.clip(_measures(toxic, sizes) @ model.curve, -30, 30)))


def _firsts(sizes: np.ndarray) -> np.ndarray:
    first = np.zeros(int(sizes.sum()), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return first


def _telling(words: list[list[str]], labels: np.ndarray) -> dict[str, float]:
    """z of the log odds ratio of each feature between toxic and clean sample documents.

    Features whose odds differ less than `LEAST_LEAD` in either direction are left out: toxic documents
    may be longer, which makes every word a little commoner in them.
    """
    def of(ws: list[str]) -> set[str]:
        return set(chain.from_iterable(map(features, set(ws))))  # one text's set at a time

    # most features occur once; a count by hash finds those worth keeping by name
    rough = np.zeros(1 << 22, dtype=np.int32)
    for ws in words:
        rough[np.unique(np.fromiter(map(hash, of(ws)), dtype=np.int64) & (len(rough) - 1))] += 1
    often = rough >= LEAST_DOCS
    seen = (Counter(), Counter())
    for ws, label in zip(words, labels, strict=True):
        seen[label].update(f for f in of(ws) if often[hash(f) & (len(rough) - 1)])
    n0, n1 = int((labels == 0).sum()), int((labels == 1).sum())
    out = {}
    for f in seen[0].keys() | seen[1].keys():
        a, b = seen[1][f], seen[0][f]
        lead = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5))
        if abs(lead) < LEAST_LEAD:
            continue
        out[f] = lead / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return out


def _slopes(emission: np.ndarray, gold: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels less marginals of the tokens of whole texts, and how often each move is expected."""
    forward, backward = messages(emission, first, moves)
    odds = forward * backward
    before, e, m = np.r_[1.0, forward[:-1]], np.exp(emission) * backward, np.exp(moves)
    pair = [m[0, 0] + 0 * e, m[0, 1] * e, m[1, 0] * before, m[1, 1] * before * e]
    total = sum(pair)
    later = ~first
    start = 1 / (1 + m[2, 0] / (m[2, 1] * e[first]))
    sums = [float((p[later] / total[later]).sum()) for p in pair]
    return gold - odds / (1 + odds), np.array([sums[:2], sums[2:], [float((1 - start).sum()), float(start.sum())]])


def _train_field(model: ToxicModel, words: list[list[str]], labels: np.ndarray, z: dict[str, float]) -> None:
    """Fit weights and moves by gradient steps (Adam) on the sample's labelled tokens."""
    kept = sorted((f for f in z if abs(z[f]) >= LEAST_Z), key=lambda f: (-abs(z[f]), f))[:MOST_FEATURES]
    number = {f: i for i, f in enumerate(kept)}
    codes: dict[str, int] = defaultdict(count().__next__)
    at = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), dtype=np.int32)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    lists = [[number[f] for f in features(w) if f in number] for w in codes]
    pair_word = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    pair_feature = np.fromiter(chain.from_iterable(lists), dtype=np.int64)
    marked = np.array([any(z[kept[i]] >= LEAST_Z for i in x) for x in lists], dtype=bool)
    gold = marked[at] & np.repeat(labels == 1, sizes)
    first = _firsts(sizes)
    move = gold.astype(np.int8)
    move[1:] += 2 * gold[:-1]
    move[first] = 4 + gold[first]
    gold_moves = np.bincount(move, minlength=6).reshape(3, 2).astype(np.float64)

    n = max(1.0, float(gold.sum()))
    parts = [slice(int(sizes[: p.start].sum()), int(sizes[: p.stop].sum())) for p in parts_of(sizes.tolist(), PART_TOKENS)]
    theta = np.r_[np.zeros(len(kept)), model.bias, np.zeros(6)]
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        weights, bias, moves = theta[: len(kept)], theta[len(kept)], theta[-6:].reshape(3, 2)
        of_word = np.clip(np.bincount(pair_word, weights=weights[pair_feature], minlength=len(lists)) + bias, -30, 30)
        per_word, expected = np.zeros(len(lists)), np.zeros((3, 2))
        for part in parts:  # whole texts, so that memory does not follow the sample
            miss, moved = _slopes(of_word[at[part]], gold[part].astype(np.float64), first[part], moves)
            per_word += np.bincount(at[part], weights=miss, minlength=len(lists))
            expected += moved
        slope = np.r_[np.bincount(pair_feature, weights=per_word[pair_word], minlength=len(kept)), per_word.sum(), (gold_moves - expected).ravel()] / n
        slope[: len(kept)] -= RIDGE * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    model.weights = {f: float(w) for f, w in zip(kept, theta) if w}
    model.bias, model.moves = float(theta[len(kept)]), theta[-6:].reshape(3, 2)


def _fit_curve(measures: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a little ridge."""
    beta = np.zeros(measures.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(measures @ beta, -30, 30)))
        slope = measures.T @ (weight * (labels - p)) - 0.1 * beta
        bend = (measures * (weight * p * (1 - p))[:, None]).T @ measures + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta = beta + step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
    return beta


def fit(texts: list[str], labels: list[int], share: float) -> ToxicModel:
    """Model from sample texts with labels 0 and 1; `share` is that of label 1 among all labelled rows.

    With fewer than two documents of a label there is nothing to tell apart: every score is the share.
    """
    model, y = ToxicModel(prior=share), np.array(labels, dtype=np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return model
    pool: dict[str, str] = {}  # one string for each word, however often it occurs
    words = [[pool.setdefault(w, w) for w in WORD.findall(t)] for t in texts]
    turn = np.zeros(len(y), dtype=np.int64)
    for label in (0, 1):
        turn[y == label] = np.arange((y == label).sum())
    curve = (turn % CURVE_EVERY == 1) if len(y) >= 300 else np.ones(len(y), dtype=bool)
    trained = ~curve if len(y) >= 300 else curve
    own = [w for w, k in zip(words, trained, strict=True) if k]
    _train_field(model, own, y[trained], _telling(own, y[trained]))
    own = [w for w, k in zip(words, curve, strict=True) if k]
    sizes = np.array([len(w) for w in own], dtype=np.int64)
    toxic = marginals(WordScores(model).of(own), _firsts(sizes), model.moves)
    y = y[curve]
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    model.curve = _fit_curve(_measures(toxic, sizes), y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on a bounded sample of `labels` (doc_id, toxic) whose texts are in `docs`.

    Of each label the `SAMPLE_ROWS` rows with the least hash of their id are taken, up to `SAMPLE_CHARS`
    characters in the order of the hash. A document labelled twice counts as toxic if one label says so.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = stored(known.withColumn("turn", F.xxhash64("doc_id")), "toxicity-labels")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return ToxicModel()
    chosen = known.where("toxic = 0").orderBy("turn").limit(SAMPLE_ROWS).unionByName(known.where("toxic = 1").orderBy("turn").limit(SAMPLE_ROWS))
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 x SAMPLE_ROWS ids
    sample = stored(texts, "toxicity-sample")
    sizes = sample.select("doc_id", "turn", F.length("text").alias("n")).orderBy("turn", "doc_id").limit(4 * SAMPLE_ROWS).collect()
    used, fits = 0, []
    for r in sizes:
        if used + r["n"] <= SAMPLE_CHARS:
            used += r["n"]
            fits.append(r["doc_id"])
    rows = sample.where(F.col("doc_id").isin(fits)).orderBy("turn", "doc_id").limit(len(sizes)).collect() if fits else []
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], counts.get(1, 0) / sum(counts.values()))


def _spans(text: str, toxic: np.ndarray) -> list[dict]:
    """Stretches of tokens that are more likely toxic than not, with the greatest marginal."""
    out: list[dict] = []
    last = -2
    for i, (m, p) in enumerate(zip(WORD.finditer(text), toxic.tolist(), strict=True)):
        if p >= SPAN_LEAST:
            if i == last + 1:
                out[-1].update(stop=m.end(), toxic=max(p, out[-1]["toxic"]))
            else:
                out.append({"start": m.start(), "stop": m.end(), "toxic": p})
            last = i
    return out


def judged(text: Column, model: ToxicModel) -> Column:
    """Score and offending spans (code points) of each whole text.

    Null and empty texts, and those without words, get the score that no toxic token gives.
    """

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = WordScores(model)
        for batch in batches:
            texts = batch.fillna("").tolist()
            scores, spans = [], []
            for part in parts_of([len(t) for t in texts], PART_CHARS):
                words = [WORD.findall(t) for t in texts[part]]
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                toxic = marginals(cache.of(words), _firsts(sizes), model.moves)
                scores.append(_score(model, toxic, sizes))
                for t, p in zip(texts[part], np.split(toxic, np.cumsum(sizes)[:-1]), strict=True):
                    spans.append(_spans(t, p) if len(p) and p.max() >= SPAN_LEAST else [])
            yield pd.DataFrame({"score": np.concatenate(scores or [np.zeros(0)]), "spans": pd.Series(spans, dtype=object)})

    return judge(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: CRC-32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Of each row: doc_id, score, predicted (1 from 0.5 on) and spans.

    Repeated rows are scored each for itself; other columns are not looked at; an empty table gives no
    rows, and without labels every score is 0.
    """
    out = docs.select("doc_id", judged(whole_text(), model).alias("judged")).select("doc_id", "judged.score", "judged.spans")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def keep_clean(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they came, whatever their names."""
    return unpacked(packed(docs).withColumn("judged", judged(whole_text("row.text"), model)).where("judged.score < 0.5"))

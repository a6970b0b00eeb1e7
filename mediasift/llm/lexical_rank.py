"""Ranked lexical search by dense blocked matrix products that are exact in double precision.

The items' terms make a compact vocabulary. One pass over the documents stores, of each, its length and
the places and counts of the vocabulary's terms in it; document counts and lengths come from that table.
A second pass multiplies tiles: rows of items by columns of their own vocabulary (weight times repeats),
times the documents' impacts in those columns. All entries are integers, and columns are cut so that no
partial sum of a tile reaches 2^53; a product in float64 is then exact in whatever order it adds up, and
tiles are added in 64-bit integers. Each tile hands on an item's best documents, with equal scores by doc_id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediasift.llm.common import ROW, parts_of, whole_text
from mediasift.sources.shared import stored

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BEST = 10

#: An impact is below this, whatever the document, as 1000 * tf < 1000 * tf + 8 * m.
IMPACT_BOUND = 1_000_000
EXACT = 1 << 53

#: Items whose texts the driver holds at a time are dealt so that they have about this many characters.
BLOCK_CHARS = 8_000_000
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 64, 2048, 1024
PART_CHARS = 4_000_000
MOST_WORDS = 300_000

_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

COUNTED = "doc_id long, n long, terms array<int>, counts array<int>"
BEST_SCHEMA = "item long, doc_id long, score long"


def terms_of(text: str) -> list[str]:
    return [t.translate(_ASCII_LOWER) for t in TERM.findall(text)]


def _counter(vocabulary: dict[str, int]):
    """Of each document: doc_id, all its terms' number, and places and counts of those of the vocabulary."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}  # a word as written: its place, or -1
        for batch in batches:
            texts = batch["text"].tolist()
            for part in parts_of([len(t) for t in texts], PART_CHARS):
                n, terms, counts = [], [], []
                for text in texts[part]:
                    own: dict[int, int] = {}
                    words = Counter(TERM.findall(text))
                    for word, tf in words.items():
                        at = seen.get(word)
                        if at is None:
                            if len(seen) >= MOST_WORDS:
                                seen.clear()
                            at = seen[word] = vocabulary.get(word.translate(_ASCII_LOWER), -1)
                        if at >= 0:
                            own[at] = own.get(at, 0) + tf
                    n.append(words.total())
                    terms.append(np.fromiter(own.keys(), np.int32, len(own)))
                    counts.append(np.fromiter(own.values(), np.int32, len(own)))
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].array, "n": n, "terms": terms, "counts": counts})

    return count


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def pieces(entries: list[tuple[int, int, int]], bound: int = (EXACT - 1) // IMPACT_BOUND) -> list[list[tuple[int, int, int]]]:
    """(item, term, factor) entries of one tile of items, cut into column tiles whose products are exact.

    In each of them, no item's factors add up to more than `bound`, so that no partial sum reaches 2^53;
    a factor over the bound is itself cut and its parts lie in different tiles.
    """
    by_term: dict[int, list[tuple[int, int]]] = {}
    for item, term, factor in entries:
        if factor > 0:
            by_term.setdefault(term, []).append((item, factor))
    out: list[list[tuple[int, int, int]]] = []
    columns: list[tuple[int, int, int]] = []
    sums: Counter[int] = Counter()
    width = 0
    for term in sorted(by_term):
        left = by_term[term]
        while left:
            now = [(item, min(factor, bound)) for item, factor in left]
            if width and (width >= TILE_TERMS or any(sums[item] + factor > bound for item, factor in now)):
                out.append(columns)
                columns, sums, width = [], Counter(), 0
            columns += [(item, term, factor) for item, factor in now]
            sums.update(dict(now))
            width += 1
            left = [(item, factor - bound) for item, factor in left if factor > bound]
    return out + [columns] if columns else out


def _tiles(items: list[dict[int, int]], weights: list[int]) -> list[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first item, items, [(vocabulary places, factors as items x places)]) of each tile of items."""
    out = []
    for first in range(0, len(items), TILE_ITEMS):
        own = items[first : first + TILE_ITEMS]
        entries = [(i, term, repeats * weights[term]) for i, terms in enumerate(own) for term, repeats in terms.items()]
        cut = []
        for columns in pieces(entries):
            places = np.unique([term for _, term, _ in columns])
            factors = np.zeros((len(own), len(places)))
            for i, term, factor in columns:
                factors[i, np.searchsorted(places, term)] = factor
            cut.append((places, factors))
        out.append((first, len(own), cut))
    return out


def _better(held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.r_[held[0], ids], np.r_[held[1], scores]
    order = np.lexsort([ids, -scores])[:best]
    return ids[order], scores[order]


def _scorer(tiles: list, names: list[int], n_terms: int, n_docs: int, all_terms: int, best: int):
    """Work of a task: each item's best documents among the task's, tile by tile."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        column = np.full(n_terms, -1, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), TILE_DOCS):
                docs = batch.iloc[at : at + TILE_DOCS]
                ids = docs["doc_id"].to_numpy(dtype=np.int64)
                sizes = docs["terms"].map(len).to_numpy(dtype=np.int64)
                if not sizes.sum():
                    continue
                row = np.repeat(np.arange(len(docs)), sizes)
                term = np.concatenate(docs["terms"].tolist()).astype(np.int64)
                tf = np.concatenate(docs["counts"].tolist()).astype(np.int64)
                m = np.array([25 + 75 * int(n) * n_docs // all_terms for n in docs["n"]], dtype=np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
                for first, n_items, cut in tiles:
                    total = np.zeros((n_items, len(docs)), dtype=np.int64)
                    for places, factors in cut:
                        column[places] = np.arange(len(places))
                        own = column[term] >= 0
                        tile = np.zeros((len(places), len(docs)))
                        tile[column[term[own]], row[own]] = impact[own]
                        total += (factors @ tile).astype(np.int64)
                        column[places] = -1
                    for i in np.flatnonzero(total.max(axis=1) > 0):
                        mine = held.get(first + i, none)
                        least = mine[1][-1] if len(mine[1]) == best else 1  # equal scores stay in
                        found = np.flatnonzero(total[i] >= max(least, 1))
                        if len(found) > best:
                            floor = np.partition(total[i][found], -best)[-best]
                            found = found[total[i][found] >= floor]
                        if len(found):
                            held[first + i] = _better(mine, ids[found], total[i][found], best)
        for i, (ids, scores) in held.items():
            yield pd.DataFrame({"item": names[i], "doc_id": ids, "score": scores})

    return score


def _searched(docs: DataFrame, items: list, best: int) -> DataFrame:
    """The best documents (item, doc_id, score, rank) of a block of items, given as rows (item, text)."""
    own = {r["item"]: Counter(terms_of(r["text"])) for r in items}
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*own.values())))}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    counted = stored(texts.mapInPandas(_counter(vocabulary), COUNTED), "lexical-counts")
    n_docs, all_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in held.collect()}  # one number for each term of the block
    names = sorted(own)
    weights = [weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))]
    tiles = _tiles([{vocabulary[t]: k for t, k in own[i].items()} for i in names], weights)
    known = counted.where("size(terms) > 0 and doc_id is not null")
    found = known.mapInPandas(_scorer(tiles, names, len(vocabulary), n_docs, all_terms, best), BEST_SCHEMA)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= best)
    return ranked.select(F.col("item").alias(ROW), "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the `best` documents with a score above 0.

    `docs` has doc_id and text, `items` has item_id and text; other columns are not looked at, and names
    like the operator's own do no harm. Null and empty texts have no terms: such a document is found by no
    item and counts in nothing, such an item has no rows. Texts are read whole at any length. Equal scores
    stand by ascending doc_id. Repeated document rows are documents of their own, side by side in the
    ranks; each row of `items` is ranked for itself, also where item_ids repeat. A document without a
    doc_id counts in all statistics but has nothing to be returned by and is not. Empty tables give no rows.
    """
    spark = docs.sparkSession
    own = items.select("item_id", whole_text().alias("text")).withColumn(ROW, F.monotonically_increasing_id())
    own = stored(own, "lexical-items")
    blocks = -(-(own.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)
    out = spark.createDataFrame([], f"{ROW} long, rank int, doc_id long, score long")
    for block in range(blocks):
        now = own.where(F.pmod(F.xxhash64(ROW), F.lit(blocks)) == block).select(F.col(ROW).alias("item"), "text")
        out = out.unionByName(_searched(docs, now.collect(), best))
    return own.select(ROW, "item_id").join(out, ROW).select("item_id", "rank", "doc_id", "score")

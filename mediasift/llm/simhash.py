"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Candidates are dealt by blocks: of five stretches of the 64 bits, two fingerprints that differ in four
bits or fewer share at least one whole. A bucket (one block, one value) that holds too many fingerprints
is dealt again by stretches of the bits that are still free, which loses no pair by the same argument.

In a task, the fingerprints of each bucket are sorted by Gray rank, so that neighbours share most bits.
Eight neighbours at a time are factored into a node that holds the bits on which they agree; eight nodes
into an upper one, up to the bucket's root. A search goes down from the root and adds up differences in
the bits that each node adds to its parent's. A whole group is left as soon as the sum exceeds the limit,
and is linked as a whole, without going down, where the bits left free cannot exceed it, or where it and
the query are one component already. Tasks give back a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.llm.common import MARK, ROW, SALT, SALTS, marked, packed, salt_of, spread_join, unpacked, whole_text
from mediasift.llm.fingerprints import shingle_hashes
from mediasift.sources.shared import stored

BITS = 64
WORDS = 4
SEED = 42
MOST_BITS = 4

#: The stage that drops near copies: what its candidates are linked by, and what then makes a copy.
STAGE_WORDS, STAGE_BITS = 2, 8
SHINGLE, ALIKE = 5, 0.8
#: Shingles of the first members of a component, which a task decides together, and of those asked about
#: them in a task; what a member counts beside its shingles.
FIRST_SHINGLES, ASKED_SHINGLES, MEMBER_COST = 250_000, 1_000_000, 32

#: Children of a node, and fingerprints whose searches go down together.
FAN = 8
TOGETHER = 512
#: Places of a search that are held at once.
FRONTIER = 2_000_000
#: Fingerprints that a task gets on average, and those of a bucket that is dealt again by further bits.
TASK_ROWS = 50_000
FULL_ROWS = 5_000
LEAST_TASKS = 48
DEPTH = 4
#: Edges that a task unites on average, before rounds over all of them.
TASK_EDGES = 20_000

#: Shingles whose bits are counted at once.
SHINGLES = 100_000

EDGES_SCHEMA = "a long, b long"
GOES_SCHEMA = f"{ROW} long, goes boolean"
FP = "__fp"


def _fingerprints(texts: list[str], words: int) -> np.ndarray:
    """SimHash of each text, as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    owners: list[int] = []
    counts: list[int] = []
    digest = xxhash.xxh64_intdigest

    def flush() -> None:
        if not owners:
            return
        values = np.array(hashes, dtype=np.uint64)
        n = np.array(counts, dtype=np.int64)
        ones = np.zeros((len(owners), BITS), dtype=np.int64)
        begin = np.cumsum(n) - n
        for cut in range(0, len(values), SHINGLES):  # a long text is counted in several turns
            bits = np.unpackbits(values[cut : cut + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            here = np.flatnonzero((begin < cut + len(bits)) & (begin + n > cut))
            ones[here] += np.add.reduceat(bits, np.maximum(begin[here] - cut, 0), axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")
        out[owners] = packed.view(np.uint64).ravel()
        hashes.clear(), owners.clear(), counts.clear()

    for i, text in enumerate(texts):
        parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII spaces alone
        if not parts:
            continue
        joined = b" ".join(parts)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
        end = np.cumsum(sizes) - 1
        shingles = max(1, len(parts) - words + 1)
        begin = (end - sizes + 1)[:shingles].tolist()
        stop = end[min(words, len(parts)) - 1 :].tolist()
        hashes.extend([digest(joined[a:b], SEED) for a, b in zip(begin, stop, strict=True)])
        owners.append(i)
        counts.append(shingles)
        if len(hashes) >= SHINGLES:
            flush()
    flush()
    return out


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """SimHash as a signed long: bit by bit the majority of the XXH64 of all word shingles.

    Null and empty texts, and those of spaces alone, give 0; fewer words than a shingle has give one
    shingle of them all.
    """

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_fingerprints(batch.fillna("").tolist(), words).view(np.int64))

    return fingerprints(text)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the sequence of Gray codes."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; labels stay the least place of a component."""
    one, two = label[a], label[b]
    apart = one != two
    if not apart.any():
        return
    pairs = np.unique(np.stack([np.maximum(one, two)[apart], np.minimum(one, two)[apart]], axis=1), axis=0)

    def top(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for x, y in pairs.tolist():
        x, y = top(x), top(y)
        if x != y:
            label[max(x, y)] = min(x, y)
    while not np.array_equal(label, flat := label[label]):
        label[:] = flat


class GrayIndex:
    """Nodes over fingerprints sorted by (bucket, Gray rank), level by level from the leaves up."""

    def __init__(self, values: np.ndarray, bucket: np.ndarray):
        self.values, self.label = values, np.arange(len(values))
        ones, zeros = values, ~values
        starts = np.arange(len(values))
        self.first, self.child, self.children, self.ones, self.mask = [starts], [], [], [ones], [ones | zeros]
        roots = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        while True:
            of = bucket[self.first[-1]]
            head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            size = np.diff(np.r_[head, len(of)])
            within = np.arange(len(of)) - np.repeat(head, size)
            cut = np.flatnonzero(within % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            self.child.append(cut)
            self.children.append(np.diff(np.r_[cut, len(of)]))
            self.first.append(self.first[-1][cut])
            self.ones.append(ones)
            self.mask.append(ones | zeros)
            if len(cut) == len(roots):
                break
        # of each level: the bits that a node adds to its parent's, and how many bits it leaves free
        self.adds = [m & ~np.repeat(up, n) for m, up, n in zip(self.mask, self.mask[1:], self.children)] + [self.mask[-1]]
        self.free = [BITS - np.bitwise_count(m).astype(np.int64) for m in self.mask]
        self.last = [np.r_[f[1:], len(values)] for f in self.first]
        self.root = np.searchsorted(roots, np.arange(len(values)), side="right") - 1

    def link(self, most: int) -> np.ndarray:
        """Label of each fingerprint's component, where links are at most `most` differing bits."""
        top = len(self.mask) - 1
        for free, first, last in zip(self.free, self.first, self.last):  # nodes that are one group in themselves
            tight = np.flatnonzero((free <= most) & (last - first > 1))
            if len(tight):
                size = (last - first)[tight]
                begin = np.repeat(first[tight], size)
                unite(self.label, begin + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), begin)
        for begin in range(0, len(self.values), TOGETHER):
            query = np.arange(begin, min(begin + TOGETHER, len(self.values)))
            one = [(np.minimum.reduceat(self.label, f), np.maximum.reduceat(self.label, f)) for f in self.first]
            stack = [(top, query, self.root[query], np.zeros(len(query), dtype=np.int64))]
            while stack:
                level, query, node, sum_ = stack.pop()
                differs = (self.values[query] ^ self.ones[level][node]) & self.adds[level][node]
                sum_ = sum_ + np.bitwise_count(differs)
                least, greatest = one[level]
                united = (least[node] == greatest[node]) & (least[node] == self.label[query])
                near = (sum_ <= most) & (self.last[level][node] > query + 1) & ~united
                query, node, sum_ = query[near], node[near], sum_[near]
                whole = sum_ + self.free[level][node] <= most
                unite(self.label, query[whole], self.first[level][node[whole]])
                if level == 0:
                    continue
                query, node, sum_ = query[~whole], node[~whole], sum_[~whole]
                size = self.children[level - 1][node]
                for part in _pieces(size):
                    n = size[part]
                    below = np.repeat(self.child[level - 1][node[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    stack.append((level - 1, np.repeat(query[part], n), below, np.repeat(sum_[part], n)))
        return self.label


def _pieces(sizes: np.ndarray) -> list[slice]:
    """Stretches whose sizes add up to about `FRONTIER`."""
    if not len(sizes):
        return []
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(FRONTIER, sizes.sum(), FRONTIER))
    bounds = np.unique(np.r_[0, cuts, len(sizes)])
    return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:])]


def linker(most: int):
    """Work of a task: from rows (mask, value, fp) to edges of a spanning forest of each bucket's links."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        values, mask, value = (rows[c].to_numpy() for c in ("fp", "mask", "value"))
        values = values.view(np.uint64)
        order = np.lexsort([gray_rank(values), value, mask])
        values, mask, value = values[order], mask[order], value[order]
        bucket = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        label = GrayIndex(values, bucket).link(most)
        edges = np.stack([values, values[label]], axis=1).view(np.int64)
        edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return links


def _finer(mask: int, parts: int) -> list[int]:
    """Masks that settle, beyond the bits of `mask`, one of `parts` stretches of the others."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(free[len(free) * i // parts : len(free) * (i + 1) // parts]) for i in range(parts)]


def _dealt(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """(fp, mask, value): each row of the buckets `masks` once for each finer mask."""
    signed = lambda m: F.lit(m - (1 << BITS) if m >> (BITS - 1) else m)
    choices = F.create_map(*[x for m, finer in masks.items() for x in (signed(m), F.array(*map(signed, finer)))])
    out = rows.select("fp", F.explode(choices[F.col("mask")]).alias("mask"))
    return out.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def near_edges(fingerprints: DataFrame, most: int = MOST_BITS, full_rows: int = FULL_ROWS) -> DataFrame:
    """Edges (a, b) between fingerprints whose components are those of all links.

    `fingerprints` has one row for each distinct `fp` and should be stored: each level of dealing reads
    it again.
    """
    tasks = max(LEAST_TASKS, math.ceil(fingerprints.count() * (most + 1) / TASK_ROWS))
    masks = {0: _finer(0, most + 1)}
    rows = _dealt(fingerprints.select("fp", F.lit(0).cast("long").alias("mask")), masks)
    parts = []
    for _ in range(DEPTH - 1):
        sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
        full = stored(sizes.where(F.col("n") > full_rows).select("mask", "value"), "simhash-full-buckets")
        if full.isEmpty():
            break
        parts.append(rows.join(full, ["mask", "value"], "left_anti"))
        masks = {m: _finer(m, most + 1) for finer in masks.values() for m in finer}
        rows = stored(_dealt(rows.join(full, ["mask", "value"], "left_semi"), masks), "simhash-dealt-again")
    for part in parts:
        rows = rows.unionByName(part)
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("mask", "value"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(linker(most), EDGES_SCHEMA)


def stars(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Work of a task: from edges (a, b) to those of each of their nodes to the least one that they reach."""
    edges = np.concatenate([np.zeros((0, 2), dtype=np.int64), *(p[["a", "b"]].to_numpy() for p in parts)])
    nodes, at = np.unique(edges, return_inverse=True)
    at, label = at.reshape(-1, 2), np.arange(len(nodes))
    unite(label, at[:, 0], at[:, 1])
    later = label != np.arange(len(nodes))
    yield pd.DataFrame({"a": nodes[later], "b": nodes[label[later]]})


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root): the least node of its component for each node of `edges` (a, b) but the roots.

    Tasks first unite about `task_edges` edges each, which is all where there are no more. Else follow
    large-star and small-star rounds: each node hands its neighbours to the least one it knows. Neighbour
    lists are never gathered, and a node with very many is spread; each round is stored, and rounds end when
    the edges stay as they are. Each stage and each scan of a round costs the driver a broadcast.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    now = stored(ordered.distinct(), "simhash-edges")
    tasks = math.ceil(now.count() / task_edges)
    now = stored(now.repartition(max(1, tasks)).mapInPandas(stars, EDGES_SCHEMA), "simhash-edges")
    if tasks <= 1:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    while (check := now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()) != state and check[0]:
        state = check
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = spread_join(both.where("b > a"), low, "a", by="b").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = spread_join(large, low, "a", by="b").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stored(small.unionByName(low.withColumnRenamed("low", "b")).distinct(), "simhash-edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def fingerprinted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Of each row, stored: `ROW`, doc_id, fp."""
    numbered = docs.select("doc_id", "text").withColumn(ROW, F.monotonically_increasing_id())
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    return stored(numbered.select(ROW, doc_id, fingerprint(whole_text(), words).alias("fp")), "simhash-rows")


def near_groups(rows: DataFrame, most: int = MOST_BITS, full_rows: int = FULL_ROWS) -> DataFrame:
    """Each row (`ROW`, doc_id, fp; stored) with component_id, keep_row and kept.

    Rows are linked when their fingerprints differ in `most` bits or fewer; component_id is the smallest
    doc_id that a chain of links reaches (null only if none of them has one). keep_row is that document's
    first row. Equal fingerprints, those of empty texts among them, are one group; repeated rows are
    rows of their own of which one stays; an empty table gives no rows.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))
    salted = rows.groupBy("fp", salt_of().alias(SALT)).agg(first.alias("first"))
    distinct = stored(salted.groupBy("fp").agg(F.min("first").alias("first")), "simhash-distinct")
    rooted = components(near_edges(distinct, most, full_rows))
    linked = rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())
    heads = linked.join(distinct, linked.node == distinct.fp).groupBy("root").agg(F.min("first").alias("head"))
    heads = spread_join(linked, heads, "root", by="node").select(F.col("node").alias("fp"), "head")
    groups = distinct.join(heads, "fp", "left").select("fp", F.coalesce("head", "first").alias("head"))
    joined = spread_join(rows, groups, "fp")
    return joined.select(
        ROW,
        "doc_id",
        "fp",
        F.col("head.doc_id").alias("component_id"),
        F.col(f"head.{ROW}").alias("keep_row"),
        (F.col(f"head.{ROW}") == F.col(ROW)).alias("kept"),
    )


def goes(sets: list[np.ndarray], alike: float, heads: int) -> np.ndarray:
    """Whether each set is `alike` (Jaccard) to an earlier one that does not go itself; only the first `heads` are asked for."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    begin, stop = np.cumsum(count) - count, np.cumsum(size)
    gone = np.zeros(len(sets), dtype=bool)
    for i in range(heads):
        if gone[i]:
            continue
        own = code[stop[i] - size[i] : stop[i]]
        shared = np.zeros(len(sets), dtype=np.int64)
        for part in _pieces(count[own]):
            n = count[own[part]]
            at = np.repeat(begin[own[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared += np.bincount(holder[at], minlength=len(sets))
        like = shared >= (size[i] + size - shared) * alike
        gone[i + 1 :] |= like[i + 1 :]
    return gone


def _decided(alike: float):
    """Work of a task: members of one component, all that are open up to some place in its order."""

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["none", "id", ROW])
        return pd.DataFrame({ROW: rows[ROW], "goes": goes(rows["shingles"].tolist(), alike, len(rows))})

    return decide


def _asked(alike: float):
    """Work of a task: later members of one component, and those before them that stay."""

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("stays", ascending=False)
        n = int(rows["stays"].sum())
        return pd.DataFrame({ROW: rows[ROW], "goes": goes(rows["shingles"].tolist(), alike, n)})[n:]

    return ask


def _first_members(rest: DataFrame) -> DataFrame:
    """`ROW` of the first members of each group, whose costs `n` add up to about `FIRST_SHINGLES` at most.

    Running sums are taken in each salt of a group first, so that the sum over the group meets few rows.
    """
    first = rest.select(ROW, "group", "turn", "n").withColumn(SALT, salt_of())
    for keys in (["group", SALT], ["group"]):
        so_far = F.sum("n").over(Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
        first = first.withColumn("so_far", so_far).where(F.col("so_far") - F.col("n") < FIRST_SHINGLES)
    return first.select(ROW)


def keep_one_of_each(docs: DataFrame, words: int = STAGE_WORDS, most: int = STAGE_BITS, alike: float = ALIKE) -> DataFrame:
    """The documents with one of each group of near copies, all columns as they came, whatever their names.

    Components of SimHash links are the candidates; a document goes exactly if its set of `SHINGLE`-word
    shingles is `alike` (Jaccard) to that of an earlier document of its component (smaller doc_id, then
    row) that stays. First all are asked about the first of their component, which thins out large groups
    of copies; then the first of those left are decided together in a task and the later ones asked about
    those of them that stay, until none is left. No document goes without such a likeness. Texts of documents
    that are alone in their component are in no shuffle, but for few marked by chance (`marked`).
    """
    numbered = packed(docs).withColumn(ROW, F.monotonically_increasing_id())
    tagged = stored(numbered.withColumn(FP, fingerprint(whole_text("row.text"), words)), "simhash-docs")
    rows = tagged.select(ROW, F.col("row.doc_id").cast("long").alias("doc_id"), F.col(FP).alias("fp"))
    later = near_groups(rows, most).where("not kept").select(ROW, F.col("keep_row").alias("group"))
    later = stored(later, "simhash-groups")
    several = stored(later.unionByName(later.select(F.col("group").alias(ROW), "group").distinct()), "simhash-several")
    tagged = marked(tagged, several)
    own_id = F.col("row.doc_id").cast("long")
    turn = F.struct(own_id.isNull().alias("none"), own_id.alias("doc_id"), ROW).alias("turn")
    members = tagged.where(MARK).select(ROW, turn, whole_text("row.text").alias("text")).join(several, ROW)
    members = members.select(ROW, "group", "turn", F.array_distinct(shingle_hashes(F.col("text"), SHINGLE)).alias("shingles"))
    members = stored(members.withColumn("n", F.size("shingles") + MEMBER_COST), "simhash-members")

    stay = members.where(F.col(ROW) == F.col("group")).select("group", F.col("shingles").alias("like"))
    asked = spread_join(members.where(F.col(ROW) != F.col("group")), stay, "group")
    shared, all_ = F.size(F.array_intersect("shingles", "like")), F.size(F.array_union("shingles", "like"))
    asked = stored(asked.select(ROW, ((all_ == 0) | (shared >= all_ * alike)).alias("goes")), "simhash-asked")
    gone = asked.where("goes").select(ROW)
    while not (left := asked.where("not goes").select(ROW)).isEmpty():
        rest = members.join(left, ROW)
        first = stored(_first_members(rest), "simhash-first")
        now = members.join(first, ROW)
        now = now.select("group", ROW, "shingles", F.col("turn.none").alias("none"), F.coalesce("turn.doc_id", F.lit(0)).alias("id"))
        decided = stored(now.groupBy("group").applyInPandas(_decided(alike), GOES_SCHEMA), "simhash-decided")
        gone = gone.unionByName(decided.where("goes").select(ROW))
        later = stored(left.join(first, ROW, "left_anti"), "simhash-later")
        if later.isEmpty():
            break
        later = members.join(later, ROW).select("group", ROW, "shingles", "n")
        parts = later.groupBy("group").agg(F.ceil(F.sum("n") / ASKED_SHINGLES).alias("parts"))
        dealt = spread_join(later, parts, "group").withColumn("part", F.pmod(F.xxhash64(ROW), "parts")).drop("parts", "n").withColumn("stays", F.lit(False))
        stay = members.join(decided.where("not goes").select(ROW), ROW).join(parts, "group")
        stay = stay.select("group", ROW, "shingles", F.lit(True).alias("stays"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        both = dealt.unionByName(stay).groupBy("group", "part")
        asked = stored(both.applyInPandas(_asked(alike), GOES_SCHEMA), "simhash-asked")
        gone = gone.unionByName(asked.where("goes").select(ROW))
    still = tagged.where(MARK).join(gone, ROW, "left_anti")
    return unpacked(tagged.where(~F.col(MARK)).unionByName(still))

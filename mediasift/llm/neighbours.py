"""Embedding near-duplicates by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors are one node. First lists come from stretches of nodes in the order of random hyperplane
signs. In each round every node brings its neighbours, listed and listing, together in a task, which compares
those of which one is new; a pair enters a list that it improves. When no link is found any more, lists that
hold nothing but links are saturated and are enlarged, and the rounds go on around them. Then a sample of
nodes is compared with all nodes, in blocks: where the links found fall short of that, new first lists from
other hyperplanes are mixed in, and the rounds go on.

Nodes whose enlarged lists are saturated too lie in dense groups. Their links are counted, not listed: the
members of a group are binned by their angle to one of them. Two bins so near it that any two of their members
are linked are counted without a comparison, bins too far apart have no links, and the others are compared
block against block. So a group of any size loses no link, and a tight one takes no pairwise work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.llm.common import ROW, spread_join
from mediasift.llm.simhash import components
from mediasift.sources.shared import stored

THRESHOLD = 0.9
#: Length of a list, and of one that was saturated.
LIST, WIDE = 12, 48
#: Orders of hyperplane signs for first lists, signs in each, and nodes compared with each other there.
ORDERS, SIGNS, STRETCH = 4, 40, 256
TASK_ROWS, BLOCK_ROWS = 40_000, 1024
#: Neighbours that a node compares at once; those of a node with more meet in several draws.
TOGETHER = 192

#: Nodes that are compared with all others to measure recall, what they must reach, and rounds at most.
AUDIT, LEAST_RECALL, ROUNDS = 2000, 0.97, 40
#: Bins of angles over the angle of the threshold, and what rounding may move an angle.
BINS, SLACK = 32, 1e-6

EDGE = "a long, b long, sim double"
SEED = 17


def units(vectors) -> np.ndarray:
    """The vectors at length 1, in double precision."""
    v = np.stack(list(vectors)).astype(np.float64)
    v /= np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def usable(vector: Column) -> Column:
    """Whether the vector is there, has entries, all of them finite, and is not zero."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda c: c != 0), F.lit(False))


def best_of(a: np.ndarray, b: np.ndarray, sim: np.ndarray, most: int) -> pd.DataFrame:
    """Each pair (a, b) once, and of each `a` the `most` nearest."""
    order = np.lexsort([b, -sim, a])
    a, b, sim = a[order], b[order], sim[order]
    # The same pair has the same likeness up to rounding, so it is looked for by its numbers.
    pair = np.lexsort([b, a])
    again = np.zeros(len(a), dtype=bool)
    again[pair[1:]] = (a[pair[1:]] == a[pair[:-1]]) & (b[pair[1:]] == b[pair[:-1]])
    a, b, sim = a[~again], b[~again], sim[~again]
    begin = np.r_[0, np.flatnonzero(np.diff(a)) + 1] if len(a) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)]))
    near = place < most
    return pd.DataFrame({"a": a[near], "b": b[near], "sim": sim[near]})


def _signed(width: int, first: int):
    """Of each node, for each order: the number that its signs make."""
    planes = np.random.default_rng([SEED, first]).normal(size=(ORDERS * SIGNS, width))
    power = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            bits = (units(batch["v"]) @ planes.T > 0).reshape(len(batch), ORDERS, SIGNS)
            code = (bits * power).sum(axis=2)
            for k in range(ORDERS):
                yield pd.DataFrame({"turn": k, "code": code[:, k], "node": batch["node"], "v": batch["v"]})

    return sign


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nearest of each node among those in its stretch of the order."""
    for batch in batches:
        for at in range(0, len(batch), STRETCH):
            rows = batch.iloc[at : at + STRETCH]
            node, u = rows["node"].to_numpy(), units(rows["v"])
            sim = u @ u.T
            sim[node[:, None] == node[None, :]] = -2
            k = min(LIST, len(node) - 1)
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.zeros((len(node), 0), dtype=int)
            a, like = np.repeat(node, k), np.take_along_axis(sim, near, axis=1).ravel()
            real = like > -2
            yield best_of(a[real], node[near].ravel()[real], like[real], LIST)


def first_lists(nodes: DataFrame, width: int, turn: int) -> DataFrame:
    """(a, b, sim): neighbours of each node in `ORDERS` random orders, which differ from turn to turn."""
    kind = nodes.schema["v"].dataType.simpleString()
    coded = nodes.select("node", "v").mapInPandas(_signed(width, turn), f"turn int, code long, node long, v {kind}")
    keys = ["turn", "code", F.xxhash64("node")]  # the last deals out nodes that share all signs
    return coded.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(_stretches, EDGE)


def _meetings(rows: pd.DataFrame) -> pd.DataFrame:
    """Work of a task: pairs of neighbours of the same node, new to each other, that are better than what they have."""
    rows = rows.sort_values("w", kind="stable")
    w, member = rows["w"].to_numpy(), rows["member"].to_numpy()
    fresh, least, u = rows["fresh"].to_numpy(dtype=bool), rows["least"].to_numpy(), units(rows["v"])
    ends = np.r_[np.flatnonzero(np.diff(w)) + 1, len(w)]
    draw = np.random.default_rng(SEED)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    begin = 0
    for end in ends:
        all_ = np.arange(begin, end)
        if len(all_) > TOGETHER:
            draw.shuffle(all_)
        for at in range(0, len(all_), TOGETHER):
            own = all_[at : at + TOGETHER]
            sim = u[own] @ u[own].T
            better = (sim > least[own][:, None]) & (fresh[own][:, None] | fresh[own][None, :])
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better)
            found.append((member[own[i]], member[own[j]], sim[i, j]))
        begin = end
    a, b, sim = (np.concatenate(x) for x in zip(*found, strict=True))
    return best_of(a, b, sim, WIDE)


def met(lists: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """(a, b, sim): what neighbours of neighbours add to `lists` (stored, `rows` of them)."""
    listed = lists.select(F.col("a").alias("w"), F.col("b").alias("member"), "fresh")
    listing = lists.select(F.col("b").alias("w"), F.col("a").alias("member"), "fresh")
    around = listed.unionByName(listing).groupBy("w", "member").agg(F.max("fresh").alias("fresh"))
    active = listed.where("fresh").select("w").unionByName(listing.where("fresh").select("w")).distinct()
    least = lists.groupBy("a").agg(F.when(F.count(F.lit(1)) >= F.max("cap"), F.min("sim")).alias("least"))
    known = nodes.select(F.col("node").alias("member"), "v").join(least.withColumnRenamed("a", "member"), "member", "left")
    known = known.withColumn("least", F.coalesce("least", F.lit(-2.0)))
    tasks = max(1, -(-2 * rows // TASK_ROWS))
    dealt = around.join(active, "w", "left_semi").join(known, "member").withColumn("task", F.pmod(F.xxhash64("w"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(_meetings, EDGE)


def merged(lists: DataFrame, more: DataFrame) -> DataFrame:
    """The lists with the pairs of `more` that make it into one; these are fresh."""
    both = lists.withColumn("fresh", F.lit(False)).unionByName(more.withColumns({"fresh": F.lit(True), "cap": F.lit(LIST)}))
    once = both.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("cap").alias("cap"))
    mine = Window.partitionBy("a")
    place = F.row_number().over(mine.orderBy(F.desc("sim"), F.xxhash64("a", "b")))
    placed = once.withColumns({"cap": F.max("cap").over(mine), "place": place})
    return placed.where("place <= cap").drop("place")


def saturated(lists: DataFrame, cap: int, threshold: float) -> DataFrame:
    """The nodes (a) whose lists of length `cap` hold links only."""
    own = lists.where(F.col("cap") == cap).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least"))
    return own.where((F.col("n") >= cap) & (F.col("least") >= threshold)).select("a")


def refined(lists: DataFrame, nodes: DataFrame, threshold: float, label: str) -> DataFrame:
    """The lists after rounds that end when none finds a link any more; saturated lists are enlarged on the way."""
    links = -1
    for turn in range(ROUNDS):
        n, fresh, now = lists.agg(F.count(F.lit(1)), F.count_if("fresh"), F.count_if(F.col("sim") >= threshold)).first()
        if fresh == 0 or (now == links and turn > 1):
            full = stored(saturated(lists, LIST, threshold), f"{label}-saturated")
            if full.isEmpty():
                break
            wide = lists.join(full.withColumn("full", F.lit(True)), "a", "left")
            grown = F.when(F.col("full"), F.lit(WIDE)).otherwise(F.col("cap"))
            again = F.col("full").isNotNull()  # its neighbours meet anew, as there is room for more of them
            lists = stored(wide.withColumns({"cap": grown, "fresh": again}).drop("full"), f"{label}-lists")
            now = -1
        links = now
        lists = stored(merged(lists, met(lists, nodes, n)), f"{label}-lists")
    return lists


def _angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            cos = np.clip((units(batch["v"]) * units(batch["pivot"])).sum(axis=1), -1, 1)
            yield batch.drop(columns="pivot").assign(angle=np.arccos(cos))


def _compared(threshold: float):
    """Work of a task: links between two blocks of a group, or within one, counted for each member."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        alone = not len(right)
        a = units(left["v"])
        link = (a @ (a if alone else units(right["v"])).T >= threshold).astype(np.float64)
        if alone:
            np.fill_diagonal(link, 0)
        out = [pd.DataFrame({"node": left["node"], "n": link.sum(axis=1), "links": link @ (left if alone else right)["copies"].to_numpy()})]
        if not alone:
            out.append(pd.DataFrame({"node": right["node"], "n": link.sum(axis=0), "links": left["copies"].to_numpy() @ link}))
        return pd.concat(out)

    return compare


def dense_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, n, links): other members of its group that a node is linked with, and the rows they stand for.

    `members` (group, node, copies, v; stored) may hold a group of any size.
    """
    kind = members.schema["v"].dataType.simpleString()
    pivots = members.groupBy("group").agg(F.min_by("v", "node").alias("pivot"))
    far = spread_join(members, pivots, "group", by="node").select("group", "node", "copies", "v", "pivot")
    angle, step = math.acos(threshold), math.acos(threshold) / BINS
    placed = far.mapInPandas(_angles, f"group long, node long, copies long, v {kind}, angle double")
    bin_ = F.floor(F.col("angle") / step).cast("int")
    placed = stored(placed.withColumn("place", F.struct("group", bin_.alias("bin"))).drop("angle"), "neighbours-dense")
    sizes = placed.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"))
    sizes = sizes.select("place.*", "n", "copies", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = stored(sizes, "neighbours-bins")

    pairs = sizes.alias("one").join(sizes.alias("two"), F.col("one.group") == F.col("two.group"))  # pi / step bins a group at most
    surely = (F.col("one.bin") + F.col("two.bin") + 2) * step <= angle - SLACK
    near = pairs.where(surely).groupBy(F.struct("one.group", "one.bin").alias("place"))
    near = near.agg(F.sum("two.n").alias("near_n"), F.sum("two.copies").alias("near_copies"), F.max(F.col("one.bin") == F.col("two.bin")).alias("own"))
    bins = sizes.select(F.struct("group", "bin").alias("place"), "blocks").join(near, "place", "left")
    placed = stored(spread_join(placed, bins, "place", by="node"), "neighbours-dense")
    counted = placed.where("near_n is not null").select(
        "node",
        (F.col("near_n") - F.col("own").cast("int")).cast("double").alias("n"),
        (F.col("near_copies") - F.when(F.col("own"), F.col("copies")).otherwise(0)).cast("double").alias("links"),
    )

    apart = (F.col("two.bin") - F.col("one.bin") - 1) * step > angle + SLACK
    left_open = pairs.where((F.col("one.bin") <= F.col("two.bin")) & ~surely & ~apart).select(
        F.col("one.group").alias("group"),
        F.col("one.bin").alias("i"),
        F.col("two.bin").alias("j"),
        F.explode(F.sequence(F.lit(0), F.col("one.blocks") - 1)).alias("p"),
        F.sequence(F.lit(0), F.col("two.blocks") - 1).alias("q"),
    )
    open_ = left_open.withColumn("q", F.explode("q")).where("i < j or p <= q")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    dealt = placed.select("place.*", block, "node", "copies", "v")
    keys = ["group", "i", "j", "p", "q"]
    left = open_.withColumns({"bin": F.col("i"), "block": F.col("p"), "side": F.lit(0)})
    right = open_.where("i < j or p < q").withColumns({"bin": F.col("j"), "block": F.col("q"), "side": F.lit(1)})
    blocks = left.unionByName(right).join(dealt, ["group", "bin", "block"])
    compared = blocks.select(*keys, "side", "node", "copies", "v").groupBy(*keys)
    compared = compared.applyInPandas(_compared(threshold), "node long, n double, links double")
    total = counted.unionByName(compared).groupBy("node")
    return total.agg(F.sum("n").cast("long").alias("n"), F.sum("links").cast("long").alias("links"))


def _audited(vectors: np.ndarray, names: np.ndarray, threshold: float):
    """Work of a task: how many of the task's nodes are linked with each audited one."""

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                rows = batch.iloc[at : at + BLOCK_ROWS]
                n += (vectors @ units(rows["v"]).T >= threshold).sum(axis=1)
                n -= np.isin(names, rows["node"].to_numpy())  # itself
        yield pd.DataFrame({"node": names, "n": n})

    return audit


def recall(links: DataFrame, nodes: DataFrame, threshold: float, most: int = AUDIT) -> float:
    """Share of the links of the `most` nodes of least hash that `links` (node, n) has; 1 where there are none."""
    sample = nodes.orderBy(F.xxhash64(F.lit(SEED), "node")).limit(most).select("node", "v").collect()
    if not sample:
        return 1.0
    names = np.array([r["node"] for r in sample])
    audit = _audited(units([r["v"] for r in sample]), names, threshold)
    true = nodes.select("node", "v").mapInPandas(audit, "node long, n long").groupBy("node").agg(F.sum("n").alias("true"))
    both = true.join(links, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("n", F.lit(0))))).first()
    return both[1] / both[0] if both[0] else 1.0


def linked(lists: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of each node with links: (node, n, links), its links and the rows they stand for; and (node, root)."""
    links = stored(lists.where(F.col("sim") >= threshold).select("a", "b"), "neighbours-links")
    stars = components(links)
    stars = stored(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "neighbours-components")
    full = stored(saturated(lists, WIDE, threshold).withColumnRenamed("a", "node"), "neighbours-dense-nodes")
    size = nodes.select("node", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = both.join(size.withColumnRenamed("node", "b"), "b")
    if full.isEmpty():
        dense = None
    else:
        dense_a = full.select(F.col("node").alias("a"), F.lit(True).alias("dense_a"))
        dense_b = full.select(F.col("node").alias("b"), F.lit(True).alias("dense_b"))
        both = both.join(dense_a, "a", "left").join(dense_b, "b", "left").where("dense_a is null or dense_b is null")
        members = full.join(stars, "node").join(nodes.select("node", "copies", "v"), "node")
        members = stored(members.select(F.col("root").alias("group"), "node", "copies", "v"), "neighbours-members")
        dense = dense_links(members, threshold)
    listed = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("links"))
    if dense is not None:
        listed = listed.unionByName(dense).groupBy("node").agg(F.sum("n").alias("n"), F.sum("links").alias("links"))
    return stored(listed, "neighbours-counts"), stars


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, audit: int = AUDIT) -> DataFrame:
    """Each row of `vectors` (vec_id, embedding) with n_links, component_id, kept and the measured recall.

    Two rows are linked when the cosine of their vectors, in double precision, is `threshold` or more;
    n_links counts the other rows that a row is linked with, equal vectors among them. component_id is the
    smallest vec_id that a chain of links reaches (null only if none of them has one), and kept says that
    it is the row's own. Repeated rows are rows of their own, linked with each other, and those of the
    smallest vec_id all count as kept. Vectors that are null, empty, zero, hold null or non-finite entries,
    or are of another length than most (of equally many, the longer) link with nothing. An empty table gives
    no rows; other columns are not looked at. No link below the threshold is ever counted; links may be
    missed, and `recall` is the share found among those of `audit` nodes, each compared with all nodes.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = stored(rows.withColumn(ROW, F.monotonically_increasing_id()), "neighbours-rows")
    good = rows.where(usable(F.col("v")))
    widths = good.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("rows"))
    common = widths.orderBy(F.desc("rows"), F.desc("width")).first()
    out = ["vec_id", "n_links", "component_id", "kept", "recall"]
    if common is None:
        alone = rows.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id"), "kept": F.lit(True), "recall": F.lit(1.0)})
        return alone.select(*out)
    good = good.where(F.size("v") == common["width"])
    classes = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "neighbours-nodes")

    lists, found = None, 0.0
    for turn in range(ROUNDS):
        seeds = first_lists(nodes, common["width"], turn)
        if lists is None:
            lists = seeds.where("false").withColumns({"fresh": F.lit(True), "cap": F.lit(LIST)})
        lists = stored(merged(lists, seeds), "neighbours-lists")
        lists = refined(lists, nodes, threshold, "neighbours")
        counts, stars = linked(lists, nodes, threshold)
        found = recall(counts.select("node", "n"), nodes, threshold, audit)
        if found >= LEAST_RECALL:
            break
    least = stars.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    grouped = spread_join(stars, least, "root", by="node").select("node", "component")
    known = nodes.select("node", "v", "least", "copies").join(counts, "node", "left").join(grouped, "node", "left")
    known = known.select(
        "v",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "least").alias("component"),
    )
    joined = spread_join(good, known, "v").select(ROW, "n_links", "component")
    result = rows.drop("v").join(joined, ROW, "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    result = result.withColumn("component_id", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component")))
    return result.withColumns({"kept": F.col("vec_id").eqNullSafe(F.col("component_id")), "recall": F.lit(found)}).select(*out)

"""Hard negatives by vantage-point trees over norm-augmented vectors (operator 13).

A row's score is its whole-numbered inner product with the anchor. With M the greatest
norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and an anchor a becomes (a, 0):
their squared distance is |a|^2 + M^2 - 2 * score, so higher scores are nearer and a
window of scores is an annulus around the anchor.

One tree of vantage points, drawn from a bounded sample of the rows (``SAMPLE``, which
only decides how well it prunes), puts every row into one of at most ``LEAVES``
leaves; a leaf's rows are cut into blocks of about ``ROWS``, equal vectors too. For each
leaf the least and greatest distance to each of its vantage points is taken over all
rows. Anchors first search the block that they lie in, then every block of the leaves
that the triangle inequality leaves possible: those nearer than the last of what they
hold and, for negatives, not wholly outside the annulus. Anchors are dealt to
blocks in parts of ``ANCHORS``; nothing but the leaves' bounds reaches the driver.

In a block, the rows are the buckets of a vantage-point tree of the block's own. An
anchor takes the buckets in order of their least possible distance, that of the
annulus at least, and stops once the next one lies farther than the last of the rows
that it holds. Pruning by rounded distances leaves a margin; scores themselves are exact.

Scores are ordered downwards, ties by the smaller vec_id, then by label and vector.

Defined cases: rows with a null label, a null or empty vector, a null or non-finite
component take no part, nor do rows whose vector has another length than most, or
a component so great that an inner product may not fit in a long. A null vec_id takes part
behind the others of its score. Rows that repeat a vec_id are rows of their own: each
can be an anchor, a positive and a negative of the other. An anchor without another
row of its label gives no row. A table without anchors or rows gives no row. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.llm.embedding_dedup import _blocks
from siftmill.llm.shared import materialize, split_join

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's score.
LOW, HIGH = 30, 90
SAMPLE, LEAVES, ROWS, ANCHORS, BUCKET = 8192, 1024, 4096, 512, 64
#: Margin of pruning, relative to sqrt(M^2 + |a|^2): distances come from differences of squares.
_SLACK = 1e-6
_WANTS = "array<struct<want: int, top: long, bottom: long>>"
_FOUND = "asker long, want int, score long, node long, id string"


class Tree:
    """Vantage points and radii of a complete binary tree: node k's children are 2k + 1
    (within the radius) and 2k + 2. Points are augmented by one component."""

    def __init__(self, points: np.ndarray, depth: int):
        nodes = (1 << depth) - 1
        self.depth = depth
        self.points, self.radii = np.zeros((nodes, points.shape[1])), np.zeros(nodes)
        held = {0: np.arange(len(points))}
        for k in range(nodes):
            rows = held.pop(k, np.arange(0))
            if len(rows):
                # the row farthest from the first is a good vantage point
                first = _distances(points[rows], points[rows[:1]])[:, 0]
                self.points[k] = points[rows[int(np.argmax(first))]]
                away = _distances(points[rows], self.points[k : k + 1])[:, 0]
                self.radii[k] = np.median(away)
                near = away <= self.radii[k]
                held[2 * k + 1], held[2 * k + 2] = rows[near], rows[~near]

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's leaf, and its distances to the vantage points above it (row, level)."""
        node = np.zeros(len(points), np.int64)
        away = np.zeros((len(points), self.depth))
        for level in range(self.depth):
            apart = points - self.points[node]
            away[:, level] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            node = 2 * node + 1 + (away[:, level] > self.radii[node])
        return node - (1 << self.depth) + 1, away

    def above(self) -> np.ndarray:
        """The vantage points above each leaf (leaf, level)."""
        leaf = np.arange(1 << self.depth) + (1 << self.depth)
        return np.stack([(leaf >> (self.depth - level)) - 1 for level in range(self.depth)], axis=1) if self.depth else np.zeros((1, 0), np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _reach(tree: Tree, low: np.ndarray, high: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible distance of each anchor to the rows of each leaf;
    ``low`` and ``high`` (leaf, level) are the leaf's own to its vantage points."""
    shape = len(anchors), 1 << tree.depth
    least, most = np.zeros(shape), np.full(shape, np.inf)
    above = tree.above()
    away = _distances(anchors, tree.points) if tree.depth else None
    for level in range(tree.depth):
        d = away[:, above[:, level]]
        least = np.maximum(least, np.maximum(d - high[:, level], low[:, level] - d))
        most = np.minimum(most, d + high[:, level])
    return least, most


def _bounds(leaf: np.ndarray, away: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full((leaves, away.shape[1]), np.inf), np.full((leaves, away.shape[1]), -np.inf)
    np.minimum.at(low, leaf, away)
    np.maximum.at(high, leaf, away)
    return low, high


def _vectors(blobs: pd.Series, dim: int) -> np.ndarray:
    """Whole numbers, as floats where all inner products are exact in them."""
    x = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, dim)
    top = int(np.abs(x).max()) if x.size else 0
    return x.astype(float) if top * top * dim < 2**52 else x


def _augmented(x: np.ndarray, square: float | None = None) -> np.ndarray:
    """Points with their last component, sqrt(square - |x|^2); anchors have none: 0."""
    x = x.astype(float)
    rest = np.sqrt(np.maximum(square - (x * x).sum(1), 0)) if square is not None else np.zeros(len(x))
    return np.column_stack([x, rest])


class _Block:
    """The rows of a block with their own tree; ``search`` gives an anchor's best rows."""

    def __init__(self, rows: pd.DataFrame, dim: int, square: float):
        self.x, self.square = _vectors(rows["v"], dim), square
        self.label, self.node = rows["label"].to_numpy(), rows["node"].to_numpy()
        self.ids = rows["id"].to_numpy()
        points = _augmented(self.x, square)
        depth = max(0, ceil(log2(max(1, len(rows)) / BUCKET)))
        self.tree = Tree(points, depth)
        leaf, away = self.tree.place(points)
        self.low, self.high = _bounds(leaf, away, 1 << depth)
        order = np.argsort(leaf, kind="stable")
        self.buckets = np.split(order, np.cumsum(np.bincount(leaf, minlength=1 << depth))[:-1])

    def reach(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _reach(self.tree, self.low, self.high, _augmented(anchors))

    def search(self, anchor: np.ndarray, least: np.ndarray, most: np.ndarray, fits: np.ndarray, top: int, bottom: int, k: int) -> list[tuple[int, int]]:
        """At most k rows (score, row) that fit, with scores from ``bottom`` to ``top``: the
        nearest buckets inside the annulus first, twice as many at each step."""
        anchor_square = float((anchor.astype(float) ** 2).sum())
        whole = anchor_square + self.square

        def radius(score: int) -> float:
            return float(np.sqrt(max(whole - 2.0 * score, 0.0)))

        margin = _SLACK * np.sqrt(whole) + 1e-6
        inner, outer = radius(top) - margin, radius(bottom) + margin
        open_ = np.flatnonzero((most >= inner) & (least <= outer))
        open_ = open_[np.argsort(least[open_], kind="stable")]
        got: list[tuple[int, int, int]] = []
        at, step = 0, 4
        while at < len(open_) and least[open_[at]] <= outer:
            rows = np.concatenate([self.buckets[b] for b in open_[at : at + step]])
            at, step = at + step, 2 * step
            rows = rows[fits[rows]]
            score = (self.x[rows] @ anchor).astype(np.int64)
            ok = (score >= bottom) & (score <= top)
            rows, score = rows[ok], score[ok]
            if len(rows) > k:  # ties with the k-th stay
                near = score >= np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[near], score[near]
            got += zip((-score).tolist(), self.node[rows].tolist(), rows.tolist())
            if len(got) >= k:
                got = sorted(got)[:k]
                bottom = max(bottom, -got[-1][0])
                outer = radius(bottom) + margin
        return [(-s, r) for s, _, r in sorted(got)[:k]]


def _searched(frames: Iterator[pd.DataFrame], dim: int, square: float, k: int, positive: bool) -> Iterator[pd.DataFrame]:
    """Groups (leaf, block, part): the block's rows and the anchors that search it. An
    anchor wants rows in each of its windows; gives (asker, want, score, node, id)."""
    for pdf in _blocks(frames, ["leaf", "block", "part"]):
        rows, asking = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        if rows.empty or asking.empty:
            continue
        block, anchors = _Block(rows, dim, square), _vectors(asking["v"], dim)
        if anchors.dtype != block.x.dtype:
            anchors, block.x = anchors.astype(np.int64), block.x.astype(np.int64)
        least, most = block.reach(anchors)
        out = []
        for i, (node, label, wants) in enumerate(zip(asking["node"], asking["label"], asking["wants"])):

            fits = (block.node != node) & ((block.label == label) == positive)
            for want in wants:
                got = block.search(anchors[i], least[i], most[i], fits, want["top"], want["bottom"], k)
                out += [(node, want["want"], s, block.node[r], block.ids[r]) for s, r in got]
        yield pd.DataFrame(out, columns=["asker", "want", "score", "node", "id"])


def _search(blocks: DataFrame, asking: DataFrame, dim: int, square: float, k: int, positive: bool) -> DataFrame:
    """``asking`` (leaf, block, node, label, v, wants) against the rows of their blocks."""
    # anchors that search one block are dealt in parts, at most as many as the block's askers need
    sizes = asking.groupBy("leaf", "block").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("parts"))
    asking = split_join(asking.drop("id"), sizes, ["leaf", "block"], ["node"])
    asking = asking.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("asks", F.lit(True)).withColumn("id", F.lit(None).cast("string"))
    rows = split_join(blocks, sizes, ["leaf", "block"], ["node"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("asks", F.lit(False)).withColumn("wants", F.lit(None).cast(_WANTS))
    cols = ["leaf", "block", "part", "asks", "node", "label", "v", "id", "wants"]
    both = rows.select(cols).unionByName(asking.select(cols)).repartition("leaf", "block", "part").sortWithinPartitions("leaf", "block", "part")
    found = both.mapInPandas(lambda f: _searched(f, dim, square, k, positive), _FOUND)
    best = Window.partitionBy("asker", "want").orderBy(F.desc("score"), "node")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """One row per negative: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. ``vectors`` (vec_id, embedding of whole numbers, label); ``anchor``, a
    condition on vec_id, names the rows to mine for. A positive is one of the anchor's
    first rows of its label; its negatives are the first rows of other labels whose scores
    lie between ``low`` and ``high`` hundredths of the positive's score."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = vectors.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("label is not null and size(x) > 0").where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    dims = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return empty
    dim = dims["d"]
    most = isqrt((2**63 - 1) // dim)
    rows = rows.where((F.size("x") == dim) & ~F.exists("x", lambda c: F.abs(c) > float(most)))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = np.stack(pdf["x"]).astype("<i8") if len(pdf) else np.zeros((0, dim), "<i8")
            norm = (x.astype(float) ** 2).sum(1)
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "anchor": pdf["anchor"], "v": [r.tobytes() for r in x], "square": norm})

    # rows are numbered in the order that decides ties; ids may be null and are told as text
    ids = F.col("id").cast("long").asc_nulls_last()
    packed_rows = rows.mapInPandas(packed, "id string, label long, anchor boolean, v binary, square double").withColumn("turn", F.monotonically_increasing_id())
    ordered = packed_rows.repartitionByRange(ids, "label", "v", "turn").sortWithinPartitions(ids, "label", "v", "turn").drop("turn")
    numbered = materialize(ordered.withColumn("node", F.monotonically_increasing_id()), "vectors")
    told = numbered.agg(F.count("*").alias("n"), F.max("square").alias("square"), F.count_if("anchor").alias("anchors")).first()
    if not told["anchors"]:
        return empty
    square = float(told["square"]) * (1 + 1e-12)
    depth = min(int(log2(LEAVES)), max(0, ceil(log2(told["n"] / ROWS))))
    sample = numbered.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toPandas()
    tree = Tree(_augmented(_vectors(sample["v"], dim), square), depth)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            leaf, away = tree.place(_augmented(_vectors(pdf["v"], dim), square))
            yield pdf.assign(leaf=leaf, away=list(away))

    at = numbered.select("id", "label", "anchor", "v", "node").mapInPandas(placed, "id string, label long, anchor boolean, v binary, node long, leaf long, away array<double>")
    at = materialize(at, "placed")
    ends = [f(F.col("away")[k]).alias(f"{f.__name__}{k}") for k in range(depth) for f in (F.min, F.max)]
    leaves = at.groupBy("leaf").agg(F.count("*").alias("m"), *ends)
    bounds = leaves.collect()
    low_at, high_at = np.full((1 << depth, depth), np.inf), np.full((1 << depth, depth), -np.inf)
    blocks_of = np.zeros(1 << depth, np.int64)
    for r in bounds:
        blocks_of[r["leaf"]] = ceil(r["m"] / ROWS)
        for k in range(depth):
            low_at[r["leaf"], k], high_at[r["leaf"], k] = r[f"min{k}"], r[f"max{k}"]
    cut = F.element_at(F.array(*[F.lit(int(max(1, b))) for b in blocks_of]), (F.col("leaf") + 1).cast("int"))
    blocks = at.withColumn("block", F.pmod(F.xxhash64("node"), cut).cast("int")).select("leaf", "block", "node", "label", "v", "id", "anchor")
    mine_here = blocks.where("anchor").select("leaf", "block", "node", "label", "v", "id")

    def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All other blocks that may hold what an anchor still wants."""
        for pdf in frames:
            x = _vectors(pdf["v"], dim)
            points = _augmented(x)
            least, most_ = _reach(tree, low_at, high_at, points)
            whole = (points * points).sum(1) + square
            margin = _SLACK * np.sqrt(whole) + 1e-6
            out = []
            for i, row in enumerate(pdf.itertuples(index=False)):
                need = np.zeros(1 << depth, bool)
                for w in row.wants:
                    inner = np.sqrt(max(whole[i] - 2.0 * w["top"], 0.0)) - margin[i]
                    outer = np.sqrt(max(whole[i] - 2.0 * w["bottom"], 0.0)) + margin[i]
                    need |= (most_[i] >= inner) & (least[i] <= outer)
                for leaf in np.flatnonzero(need & (blocks_of > 0)).tolist():
                    out += [(leaf, b, row.node, row.label, row.v, row.wants) for b in range(blocks_of[leaf]) if (leaf, b) != (row.leaf, row.block)]
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=["leaf", "block", "node", "label", "v", "wants"])
                    out = []
            yield pd.DataFrame(out, columns=["leaf", "block", "node", "label", "v", "wants"])

    def rounds(asking: DataFrame, k: int, positive: bool, tag: str) -> DataFrame:
        """The best k rows of each want over all blocks: the own block first, then the others."""
        mine_first = materialize(_search(blocks, asking, dim, square, k, positive), f"{tag}-own")
        # what the own block gave is a bound for the others
        last = mine_first.where(F.col("rank") == k).select(F.col("asker").alias("node"), "want", F.col("score").alias("bound"))
        wants = asking.select("node", F.explode("wants").alias("w")).select("node", "w.*").join(last, ["node", "want"], "left")
        wants = wants.groupBy("node").agg(F.collect_list(F.struct("want", "top", F.greatest("bottom", "bound").alias("bottom"))).alias("wants"))
        others = asking.drop("wants").join(wants, "node").select("leaf", "block", "node", "label", "v", "wants")
        going = others.mapInPandas(visits, f"leaf long, block int, node long, label long, v binary, wants {_WANTS}")
        rest = _search(blocks, going, dim, square, k, positive)
        both = mine_first.drop("rank").unionByName(rest.drop("rank"))
        best = Window.partitionBy("asker", "want").orderBy(F.desc("score"), "node")
        return materialize(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), tag)

    ends_ = F.lit(2**63 - 1), F.lit(-(2**63))
    first = mine_here.withColumn("wants", F.array(F.struct(F.lit(0).alias("want"), ends_[0].alias("top"), ends_[1].alias("bottom"))))
    best = rounds(first, positives, True, "positives")
    # 100 * negative >= low * positive and 100 * negative <= high * positive, in whole numbers
    score = F.col("score").cast("decimal(20,0)")
    floor_ = F.floor(score * high / 100).cast("long")
    ceil_ = F.ceil(score * low / 100).cast("long")
    windows = best.select(F.col("asker").alias("node"), F.struct(F.col("rank").alias("want"), floor_.alias("top"), ceil_.alias("bottom")).alias("w"))
    windows = windows.where("w.top >= w.bottom").groupBy("node").agg(F.collect_list("w").alias("wants"))
    found = rounds(mine_here.join(windows, "node"), negatives, False, "negatives")
    anchors = mine_here.select(F.col("node").alias("asker"), F.col("id").cast("long").alias("anchor_id"))
    pairs = best.join(anchors, "asker").select("asker", "anchor_id", F.col("rank").alias("want"), F.col("id").cast("long").alias("positive_id"), F.col("score").alias("positive_score"))
    got = found.select("asker", "want", F.col("rank").cast("int").alias("rank"), F.col("id").cast("long").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(got, ["asker", "want"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

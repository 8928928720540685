"""Embedding near-duplicates by sorted projection passes (operator 6).

Each pass orders all vectors lexicographically by the signs of ``BITS`` random
projections and compares every vector with the ``WINDOW`` next ones. Vectors that
share the first ``depth(n)`` signs are a run. Verified pairs are joined across
passes into components. Where vectors lie densely a run is longer than a window;
its vectors outside the run's largest component are then compared with all of the
run, block by block, so that all pairs of a run are compared or joined already.
The passes needed follow: two vectors at the threshold share a projection's sign
with probability 1 - acos(t)/pi, hence a run with that to the power of its depth,
however dense the place.

Links are then made whole inside each component, without comparing the members
of dense groups pair by pair: angles are a metric, so two members whose angles
to the component's mean direction sum to acos(t) at most are linked for sure.
Members within half of that angle (the core) all link to each other; only the
others are compared, block by block, with the component's members.

Defined cases: vectors that are null, empty, zero, of another length than most,
or hold null or non-finite components link with nothing; equal vectors are
compared once and link with each other; a null vec_id takes part but represents
its component only if all ids in it are null; different vectors under one vec_id
are judged each; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.llm.ngram_join import _forest
from siftmill.llm.shared import components, materialize, split_join

THRESHOLD = 0.9
BITS, WINDOW = 62, 128
#: Share of pairs at the very threshold that the passes are to meet.
RECALL = 0.97
#: Rows of a block on each side.
OUTER, INNER = 1000, 2000
_SLACK = 1e-7


def depth(n: int) -> int:
    """Signs that the vectors of a run share; evenly spread, a run fits a window."""
    return max(0, ceil(log2(max(n, 1) / WINDOW)))


def passes(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    agree = 1 - acos(threshold) / pi
    met = agree ** depth(n)
    return 1 if met > recall else ceil(log(1 - recall) / log(1 - met))


def _unit(blobs: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f8") for b in blobs]) if len(blobs) else np.zeros((0, 1))


def _near(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows in order of (range, turn, key, node); the first rows of the next range
    follow a range's own as ``halo``. Gives a spanning forest of the links found."""
    held: pd.DataFrame | None = None
    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        x = _unit(pdf["unit"])
        where = pdf[["range", "turn"]].to_numpy()
        halo, node = pdf["halo"].to_numpy(), pdf["node"].to_numpy()
        first, second = [], []
        for at in range(0, len(x), 256):
            rows, cols = slice(at, min(at + 256, len(x))), slice(at, min(at + 256 + WINDOW, len(x)))
            i, j = np.nonzero(x[rows] @ x[cols].T >= threshold)
            ok = (j > i) & (j - i <= WINDOW)
            i, j = i[ok] + at, j[ok] + at
            ok = (where[i] == where[j]).all(1) & ~halo[i]
            i, j = i[ok], j[ok]
            # the products above may differ from the plain one in the last bits
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            first.append(i[exact])
            second.append(j[exact])
        made = _forest(len(x), np.concatenate(first), np.concatenate(second)) if first else []
        yield pd.DataFrame([(int(node[a]), int(node[b])) for a, b in made], columns=["a", "b"])
        held = pdf.tail(WINDOW)


def _blocks(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, of rows in order of ``keys``; a batch may end inside a key."""
    held: list[pd.DataFrame] = []
    key = None
    for pdf in frames:
        starts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
        for s, e in zip(starts, [*starts[1:], len(pdf)]):
            now = tuple(pdf[keys].iloc[s])
            if held and now != key:
                yield pd.concat(held, ignore_index=True)
                held = []
            key = now
            held.append(pdf.iloc[s:e])
    if held:
        yield pd.concat(held, ignore_index=True)


def _across(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows in order of (turn, run, low, high): outer rows against inner rows. Gives
    a spanning forest of the links between components."""
    for pdf in _blocks(frames, ["turn", "run", "low", "high"]):
        x = _unit(pdf["unit"])
        outer = np.flatnonzero(pdf["outer"].to_numpy())
        inner = np.flatnonzero(~pdf["outer"].to_numpy())
        names, component = np.unique(pdf["component"].to_numpy(), return_inverse=True)
        product = x[outer] @ x[inner].T
        near = product >= threshold
        # these products may differ from the plain one in the last bits
        i, j = np.nonzero(np.abs(product - threshold) < 1e-12)
        near[i, j] = np.einsum("ij,ij->i", x[outer[i]], x[inner[j]]) >= threshold
        near &= component[outer][:, None] != component[inner][None, :]
        i, j = np.nonzero(near)
        pairs = np.unique(component[outer[i]] * len(names) + component[inner[j]])
        made = _forest(len(names), pairs // len(names), pairs % len(names))
        yield pd.DataFrame([(int(names[a]), int(names[b])) for a, b in made], columns=["a", "b"])


def _links(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows in order of (component, low, high): outer rows against inner rows."""
    for pdf in _blocks(frames, ["component", "low", "high"]):
        x = _unit(pdf["unit"])
        outer = np.flatnonzero(pdf["outer"].to_numpy())
        inner = np.flatnonzero(~pdf["outer"].to_numpy())
        node, copies, core = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["core"].to_numpy()
        near = x[outer] @ x[inner].T >= threshold
        near &= node[outer][:, None] != node[inner][None, :]
        got = pd.DataFrame({"node": np.concatenate([node[outer], node[inner]]), "links": np.concatenate([near @ copies[inner], np.where(core[inner], copies[outer] @ near, 0)])})
        yield got[got["links"] > 0]


def _dealt(rows: DataFrame, outer: Column, keys: list[str], cols: list[str]) -> DataFrame:
    """Every pair of a block of outer rows and a block of all rows of a key, as rows
    in order of (keys, low, high); ``rows`` has the key's numbers of blocks, lows and highs."""
    mine_low, mine_high = F.pmod(F.xxhash64("node"), F.col("lows")).cast("int"), F.pmod(F.xxhash64("node"), F.col("highs")).cast("int")
    cols = [*keys, "low", "high", "outer", *cols]
    outside = rows.where(outer).withColumn("low", mine_low).withColumn("high", F.explode(F.sequence(F.lit(0), F.col("highs") - 1))).withColumn("outer", F.lit(True))
    inside = rows.withColumn("high", mine_high).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("lows") - 1))).withColumn("outer", F.lit(False))
    by = [*keys, "low", "high"]
    return outside.select(cols).unionByName(inside.select(cols)).repartition(*by).sortWithinPartitions(*by)


def _numbered(sizes: DataFrame) -> DataFrame:
    """Blocks of a key of m rows, ``out`` of them outer."""
    return sizes.withColumn("lows", F.ceil(F.col("out") / OUTER).cast("int")).withColumn("highs", F.ceil(F.col("m") / INNER).cast("int"))


def _whole_runs(ranged: DataFrame, groups: DataFrame, deep: int, threshold: float) -> DataFrame:
    """Links (a, b) between components that share a run longer than a window, or one
    that lies in more than two ranges."""
    rows = ranged.withColumn("run", F.shiftright("key", BITS - deep))
    # a range's rows are compared with those of the next range, but not beyond
    long = rows.groupBy("turn", "run").agg(F.count("*").alias("m"), (F.max("range") - F.min("range")).alias("over"))
    long = long.where((F.col("m") > WINDOW) | (F.col("over") > 1)).select("turn", "run")
    placed = rows.select("turn", "run", "node").join(long, ["turn", "run"]).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("turn", "run", "component").count()
    sizes = sizes.groupBy("turn", "run").agg(F.sum("count").cast("long").alias("m"), F.max(F.struct("count", "component")).alias("top"))
    sizes = _numbered(sizes.withColumn("out", F.col("m") - F.col("top.count")).where("out > 0"))
    sizes = sizes.select("turn", "run", F.col("top.component").alias("top"), "lows", "highs")
    loose = split_join(placed, sizes, ["turn", "run"], ["node"]).join(rows.select("turn", "node", "unit"), ["turn", "node"])
    dealt = _dealt(loose, F.col("component") != F.col("top"), ["turn", "run"], ["node", "component", "unit"])
    return materialize(dealt.mapInPandas(lambda f: _across(f, threshold), "a long, b long"), "across")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 5) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    dims = rows.where(finite).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    alone = F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    if dims is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), *alone)
    dim = dims["d"]
    good = F.coalesce(finite & (F.size("v") == dim), F.lit(False))
    # + 0.0 makes one zero of the two
    whole = rows.withColumn("v", F.when(good, F.transform("v", lambda c: c + F.lit(0.0))))
    classes = whole.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # numbers of their own, as ids may be null or repeated; fixed by the table
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = np.stack(pdf["v"]).astype(float) if len(pdf) else np.zeros((0, dim))
            x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"node": pdf["node"], "copies": pdf["copies"], "unit": [r.astype("<f8").tobytes() for r in x]})

    units = materialize(classes.select("v", "node", "copies").mapInPandas(keyed, "node long, copies long, unit binary"), "units")
    n = units.count()
    turns = passes(n, threshold)

    def projected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = _unit(pdf["unit"])
            for turn in range(turns):
                signs = x @ np.random.default_rng([seed, turn]).normal(size=(dim, BITS)) > 0 if len(x) else np.zeros((0, BITS), bool)
                key = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pd.DataFrame({"turn": turn, "key": key, "node": pdf["node"], "unit": pdf["unit"]})

    order = ["turn", "key", "node"]
    passed = units.mapInPandas(projected, "turn int, key long, node long, unit binary")
    ranged = materialize(passed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "passes")
    # the first rows of a range also end the range before it
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    edge = ranged.select("range", *order).withColumn("place", place).where(F.col("place") <= WINDOW)
    halo = edge.join(ranged, ["range", *order]).select((F.col("range") - 1).alias("range"), *order, "unit", F.lit(True).alias("halo"))
    stream = ranged.select("range", *order, "unit", F.lit(False).alias("halo")).unionByName(halo.where("range >= 0"))
    stream = stream.repartition("range").sortWithinPartitions("range", *order)
    edges = materialize(stream.mapInPandas(lambda f: _near(f, threshold), "a long, b long"), "near")
    groups = components(edges)
    across = _whole_runs(ranged, groups, depth(n), threshold)
    if not across.isEmpty():
        groups = components(across.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    members = groups.join(units, "node")

    # mean direction of each component, by partial sums
    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pd.DataFrame(_unit(pdf["unit"])).groupby(pdf["component"].to_numpy()).sum()
            yield pd.DataFrame({"component": out.index.to_numpy(), "total": list(out.to_numpy())})

    members = materialize(members, "members")
    sums = members.select("component", "unit").mapInPandas(parts, "component long, total array<double>")
    sums = sums.groupBy("component").agg(F.array(*[F.sum(F.col("total")[k]) for k in range(dim)]).alias("mean"))

    def angled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, mean = _unit(pdf["unit"]), np.stack(pdf["mean"]).astype(float) if len(pdf) else np.zeros((0, 1))
            size = np.maximum(np.linalg.norm(mean, axis=1), 1e-300)
            cos = np.einsum("ij,ij->i", x, mean) / size if len(x) else np.zeros(0)
            yield pdf[["component", "node", "copies", "unit"]].assign(core=np.arccos(np.clip(cos, -1, 1)) <= acos(threshold) / 2 - _SLACK)

    members = materialize(split_join(members, sums, ["component"], ["node"]).mapInPandas(angled, "component long, node long, copies long, unit binary, core boolean"), "angled")
    sizes = members.groupBy("component").agg(
        F.count("*").alias("m"), F.count_if(~F.col("core")).alias("out"), F.coalesce(F.sum(F.when(F.col("core"), F.col("copies"))), F.lit(0)).alias("core_copies")
    )
    loose = split_join(members, _numbered(sizes.where("out > 0")).select("component", "lows", "highs"), ["component"], ["node"])
    dealt = _dealt(loose, ~F.col("core"), ["component"], ["node", "copies", "core", "unit"])
    counted = dealt.mapInPandas(lambda f: _links(f, threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    linked = split_join(members, sizes.select("component", "core_copies"), ["component"], ["node"]).join(counted, "node", "left")
    sure = F.when(F.col("core"), F.col("core_copies") - F.col("copies")).otherwise(0)
    linked = linked.select("node", "component", (sure + F.coalesce("links", F.lit(0))).alias("links"))
    # a component goes by the smallest id of its vectors
    ids = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("lowest"))
    linked = split_join(linked, ids, ["component"], ["node"]).select("node", "lowest", "links")
    per_class = classes.join(linked, "node", "left").select("v", "copies", F.least("lowest", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = split_join(whole.where("v is not null").select("vec_id", "v"), per_class, ["v"], ["vec_id"])
    out = out.select("vec_id", (F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return out.unionByName(whole.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), *alone))

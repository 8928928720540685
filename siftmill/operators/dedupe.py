"""Exact and near-duplicate grouping of prompts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from siftmill.functions.text import base_hash, jaccard, shingles
from siftmill.operators.lineage import filed as cut

MODULUS = 2147483647
#: Nodes of a bucket whose pairs are all compared at once; beyond it, leaders chosen before
#: the pairs that are left, and nodes of a block of those.
SMALL, LEADERS, BLOCK = 64, 3, 1_000
#: Cells of a sketch, a power of two, and the count from which on one is only known to be large.
CELLS, FULL = 256, 65_535


def rank_in(value: Column, order: list[str]) -> Column:
    """1-based place of a value in a preference list, unlisted last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def exact_dedupe(df: DataFrame, preference: list[str], norm: str = "norm", key: str = "id") -> DataFrame:
    """Keep the first row of each normalised text by source preference, then id."""
    return keep_first(df.withColumn("_rank", rank_in(F.col("source"), preference)), [norm], ["_rank", key]).drop("_rank")


def exact_ids(df: DataFrame, preference: list[str], norm: str = "norm", key: str = "id") -> DataFrame:
    """(key) of the rows that ``exact_dedupe`` keeps, where ``key`` is unique: the texts stay where they
    are, and their hashes (SHA-256) are exchanged."""
    hashed = df.select(key, F.sha2(F.col(norm), 256).alias("_h"), rank_in(F.col("source"), preference).alias("_rank"))
    return hashed.groupBy("_h").agg(F.min(F.struct("_rank", key)).alias("_first")).select(f"_first.{key}")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, nulls first: a minimum that is combined before the exchange,
    so that a key of a third of all rows is one row a task there."""
    whole = F.struct(*df.columns)
    first = F.min_by(whole, F.struct(*order)).alias("_first")
    return df.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(first).select("_first.*")


def coefficients(perms: int = 32, seed: int = 42) -> tuple[list[int], list[int]]:
    rng = np.random.RandomState(seed)
    a = rng.randint(1, MODULUS - 1, size=perms)
    b = rng.randint(0, MODULUS - 1, size=perms)
    return [int(x) for x in a], [int(x) for x in b]


def bands(sig: Column, perms: int = 32, count: int = 8) -> Column:
    """Array of (band, key)."""
    rows = max(1, perms // count)
    return F.array(*[F.struct(F.lit(i).alias("band"), F.array_join(F.slice(sig, i * rows + 1, rows).cast("array<string>"), ",").alias("key")) for i in range(count)])


def with_signatures(df: DataFrame, k: int = 5, perms: int = 32, seed: int = 42, norm: str = "norm", key: str = "id") -> DataFrame:
    """(key, sh, sig): shingles and MinHash values min((a h + b) mod 2^31 - 1); the
    modulus for an empty set. ``key`` is unique.

    A shingle is hashed once, and the minima are plain aggregates that combine
    before the exchange."""
    return df.select(key, shingles(F.col(norm), k).alias("sh")).join(signatures(df, k, perms, seed, norm, key), key)


def signatures(df: DataFrame, k: int = 5, perms: int = 32, seed: int = 42, norm: str = "norm", key: str = "id") -> DataFrame:
    """(key, sig) alone: the shingles are not exchanged."""
    hashes = df.select(key, F.explode_outer(shingles(F.col(norm), k)).alias("g")).select(key, base_hash(F.col("g")).alias("h"))
    least = [F.coalesce(F.min((F.lit(a).cast("long") * F.col("h") + F.lit(b).cast("long")) % MODULUS), F.lit(MODULUS).cast("long")) for a, b in zip(*coefficients(perms, seed))]
    return hashes.groupBy(key).agg(*[m.alias(f"m{i}") for i, m in enumerate(least)]).select(key, F.array(*[f"m{i}" for i in range(perms)]).alias("sig"))


def buckets(signed: DataFrame, perms: int = 32, count: int = 8, key: str = "id") -> DataFrame:
    """(k, band, key): the buckets of each row."""
    return signed.select(F.col(key).alias("k"), F.explode(bands(F.col("sig"), perms, count)).alias("b")).select("k", "b.band", "b.key")


def candidates(signed: DataFrame, perms: int = 32, count: int = 8, key: str = "id") -> DataFrame:
    """Distinct (a, b), a < b, sharing a band: all of them, which is the square of a bucket.
    ``links`` finds what joins groups without it."""
    return _meeting(buckets(signed, perms, count, key))


def _meeting(each: DataFrame) -> DataFrame:
    left, right = (each.select(F.col("k").alias(name), "band", "key") for name in ("a", "b"))
    return left.join(right.hint("merge"), ["band", "key"]).where("a < b").select("a", "b").distinct()


def pairs_of_texts(texts: DataFrame, found: DataFrame, k: int = 5, threshold: float = 0.8, norm: str = "norm", key: str = "id") -> DataFrame:
    """``pairs`` of texts (key, norm), whose shingles are compared as 64-bit hashes, as in
    ``near_duplicate_groups``. Most candidates are not alike: those that cannot reach the threshold by their
    texts' ``sketches`` go first, and only the texts of the others are exchanged. ``found`` is read several times."""
    hashed = F.transform(shingles(F.col(norm), k), lambda g: F.xxhash64(g)).alias("sh")
    left = cut(possible(found, sketches(texts.select(F.col(key).alias("k"), hashed)), threshold))
    asked = left.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    sets = texts.join(asked.hint("merge"), key, "left_semi").select(key, hashed)
    return pairs(sets, left, threshold, key)


def sketches(sets: DataFrame) -> DataFrame:
    """(k, n, cells) of sets (k, sh) of hashes: their sizes, and how many hashes fall to each of ``CELLS``."""

    def counted(batches):
        for batch in batches:
            lists = batch.column("sh")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            cells = [np.minimum(np.bincount(values[e - n : e] & (CELLS - 1), minlength=CELLS), FULL).astype("<u2").tobytes() for n, e in zip(sizes, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(sizes, pa.int32()), pa.array(cells, pa.binary())], names=["k", "n", "cells"])

    schema = StructType([sets.schema["k"], StructField("n", IntegerType()), StructField("cells", BinaryType())])
    return sets.select("k", "sh").mapInArrow(counted, schema)


def possible(found: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ``found`` that may reach the threshold: two sets share no more of a cell's
    hashes than either has there."""

    def bounded(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, CELLS) for c in ("ca", "cb"))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            every = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy() - most
            keep = (most >= (threshold - 1e-9) * every) | (x == FULL).any(axis=1) | (y == FULL).any(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    sides = [sketched.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"c{c}")).hint("merge") for c in ("a", "b")]
    near = F.when(F.greatest("na", "nb") == 0, True).otherwise(F.least("na", "nb") / F.greatest("na", "nb") >= threshold)
    both = found.select("a", "b").join(sides[0], "a").join(sides[1], "b").where(near)
    return both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(bounded, found.select("a", "b").schema)


def pairs(signed: DataFrame, found: DataFrame, threshold: float = 0.8, key: str = "id") -> DataFrame:
    """Candidates verified by exact Jaccard: (a, b, jaccard)."""
    sets = signed.select(F.col(key).alias("k"), "sh")
    out = found.hint("merge").join(sets.select(F.col("k").alias("a"), F.col("sh").alias("sa")), "a").hint("merge").join(sets.select(F.col("k").alias("b"), F.col("sh").alias("sb")), "b")
    return out.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def components(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """(key, group): smallest key reachable, by label spreading with pointer jumping. Here and in what
    leads here sides are merged: labels and links grow with the rows, and a side that is
    broadcast goes through the driver whole, in every round."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = cut(nodes.select(F.col(key).alias("n"), F.col(key).alias("l")).distinct())
    both = cut(both)
    while True:
        near = both.join(labels.hint("merge"), F.col("b") == F.col("n")).groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near.hint("merge"), F.col("n") == F.col("a"), "left").select("n", "l", F.least("l", F.coalesce("m", "l")).alias("x"))
        jump = step.select(F.col("n").alias("n2"), F.col("x").alias("x2"))
        nxt = cut(step.join(jump.hint("merge"), F.col("x") == F.col("n2"), "left").select("n", F.least("x", F.coalesce("x2", "x")).alias("new"), "l"))
        changed = nxt.where("new <> l").limit(1).count()
        labels = nxt.select("n", F.col("new").alias("l"))
        if not changed:
            return labels.select(F.col("n").alias(key), F.col("l").alias("dup_group"))


def links(nodes: DataFrame, perms: int = 32, count: int = 8, threshold: float = 0.8, key: str = "n", small: int = SMALL) -> DataFrame:
    """Verified pairs (a, b) that give the same components as all verified pairs sharing a band.

    Buckets of at most ``small`` nodes are compared in all pairs. A larger one is compared
    with a few leaders, picked by hash, so that a large family mostly hangs together after
    the first; nodes of one component need no more comparing, and a bucket that lies in one
    component is done. What is left between components of a bucket is compared in full,
    a block of its nodes in a task."""
    each = buckets(nodes, perms, count, key)
    sizes = each.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    each = cut(each.join(sizes.hint("merge"), ["band", "key"]))
    close = pairs(nodes, _meeting(each.where(F.col("size") <= small)), threshold, key).select("a", "b")
    large = each.where(F.col("size") > small)
    if large.isEmpty():
        return close
    close = cut(close)
    for turn in range(LEADERS):
        large = _apart(large, close)
        if large.isEmpty():
            return close
        heads = large.groupBy("band", "key").agg(F.min_by(F.struct("k", "label"), F.xxhash64("k", F.lit(turn))).alias("head"))
        star = large.join(heads.hint("merge"), ["band", "key"]).where("label <> head.label").select(F.least("k", "head.k").alias("a"), F.greatest("k", "head.k").alias("b")).distinct()
        close = cut(close.unionByName(pairs(nodes, star, threshold, key).select("a", "b")))
    large = _apart(large, close)
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    one = large.select("band", "key", F.col("k").alias("b"), F.col("label").alias("lb"), F.pmod(F.xxhash64("k"), blocks).alias("at"))
    every = large.select("band", "key", F.col("k").alias("a"), F.col("label").alias("la"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("at"))
    rest = every.join(one.hint("merge"), ["band", "key", "at"]).where("a < b AND la <> lb").select("a", "b").distinct()
    return close.unionByName(pairs(nodes, rest, threshold, key).select("a", "b"))


def _apart(large: DataFrame, close: DataFrame) -> DataFrame:
    """Buckets whose nodes lie in several components of the links so far, with their labels."""
    linked = close.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    labels = components(close, linked, "k")
    told = large.select("k", "band", "key", "size").join(labels.hint("merge"), "k", "left").select("k", "band", "key", "size", F.coalesce("dup_group", "k").alias("label"))
    several = told.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return cut(told.join(several.select("band", "key").hint("merge"), ["band", "key"], "left_semi"))


def near_duplicate_groups(df: DataFrame, k: int = 5, perms: int = 32, count: int = 8, threshold: float = 0.8, seed: int = 42, norm: str = "norm", key: str = "id", small: int = SMALL) -> DataFrame:
    """``df`` plus dup_group: the smallest id of the component of verified pairs.
    Rows of equal shingles are one node, so a group of copies costs one row, and a family
    of near copies is compared with its leaders, not in all pairs (``links``). Shingles are kept
    and compared as 64-bit hashes: two texts of a thousand shingles each have two that share
    one by chance with a probability of 1e-13."""
    sets = df.select(key, F.transform(shingles(F.col(norm), k), lambda g: F.xxhash64(g)).alias("sh"))
    signed = sets.hint("merge").join(signatures(df, k, perms, seed, norm, key), key)
    signed = cut(signed.withColumn("same", F.sha1(F.array_join(F.array_sort("sh").cast("array<string>"), ","))))
    firsts = signed.groupBy("same").agg(F.min(key).alias("first"))
    nodes = cut(signed.join(firsts.hint("merge"), "same").where(F.col(key) == F.col("first")).select(F.col("first").alias("n"), "sh", "sig"))
    found = cut(links(nodes, perms, count, threshold, "n", small))
    # most nodes have no edge, and are their own groups
    linked = found.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    groups = components(found, linked, "n")
    members = signed.select(key, "same").join(firsts.hint("merge"), "same").join(groups.hint("merge"), F.col("first") == F.col("n"), "left").select(key, F.coalesce("dup_group", "first").alias("dup_group"))
    return df.join(members.hint("merge"), key)

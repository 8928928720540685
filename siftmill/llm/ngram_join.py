"""N-gram Jaccard self-join with Bayesian candidate pruning (operator 7).

Documents are sets of hashed five-word shingles (lower-cased words; a text of
fewer words is one shingle). Texts with equal sets form a class, counted once.
Classes that share a band of their MinHash signatures fall into one candidate
family; within a family, pairs are compared block by block as in BayesLSH
(Satuluri and Parthasarathy, 2012): MinHash values are compared a few at a time, and
a pair is dropped once the posterior probability that its similarity reaches
the threshold falls below ``TOLERANCE`` (uniform prior). Survivors are verified
exactly on the shingle sets. A block hands on, for each class, how many
documents it links to, and a spanning forest of the links; never the pairs.

Bands: 20 of 4 values find a pair at similarity 0.8 with probability
1 - (1 - 0.8**4)**20 > 0.99997, and surer above. A pair at 0.8 that shares a family
is dropped unverified with probability 8.1e-7 (3.1e-7 at 0.81).

Defined cases: null and empty texts, and texts without a letter or digit, have
no shingle and link with nothing; a null doc_id takes part but can represent a
class only if all ids are null; different texts under one doc_id are judged each;
repeated rows and equal texts are one class; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import components, hold, materialize, split_join

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
HASHES = 96
#: Values compared between two looks at the posterior, and its least probability.
STEP, TOLERANCE = 16, 1e-7
#: Members and shingles that a block aims at.
BLOCK_MEMBERS, BLOCK_SHINGLES = 400, 400_000
#: Distinct words whose hashes a worker remembers at most.
MEMORY = 200_000
_WORD = re.compile(r"\w+")
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64)


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Stable 64-bit hashes of words; ``known`` remembers them within a worker."""
    import xxhash

    new = {w for w in words if w not in known}
    if len(known) + len(new) > MEMORY:
        known.clear()
        new = set(words)
    for w in new:
        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, known: dict[str, int], size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words, known)
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = (out ^ h[j : len(h) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(sh: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a non-empty shingle set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(sh), 512):
            low = np.minimum(low, (sh[at : at + 512, None] * _A + _B).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; a band's number is part of its key."""
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(ROWS):
            key = (key ^ sig[j : BANDS * ROWS : ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
    return key


@lru_cache
def least_matches(threshold: float = THRESHOLD) -> np.ndarray:
    """For n compared values, the matches below which P(similarity >= threshold)
    is less than TOLERANCE under the beta posterior of a uniform prior."""
    grid = np.linspace(0, 1, 4001)[1:-1]
    out = np.zeros(HASHES + 1, int)
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log)
            if density[grid >= threshold].sum() / density.sum() >= TOLERANCE:
                out[n] = m
                break
    return out


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, set fingerprint (f1, f2), shingle count, signature and
    band keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("ngram_join")
        known: dict[str, int] = {}
        for pdf in frames:
            rows = []
            for text in pdf["text"]:
                sh = shingles(text, known)
                if not len(sh):
                    rows.append((0, 0, 0, None, None))
                    continue
                with np.errstate(over="ignore"):
                    f1 = (sh * np.uint64(0xBF58476D1CE4E5B9)).sum(dtype=np.uint64)
                    mixed = (sh ^ (sh >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                    f2 = (mixed ^ (mixed >> np.uint64(29))).sum(dtype=np.uint64)
                sig = signature(sh)
                rows.append((int(f1.view(np.int64)), int(f2.view(np.int64)), len(sh), sig.astype("<u4").tobytes(), band_keys(sig).view(np.int64).tolist()))
            out = pd.DataFrame(rows, columns=["f1", "f2", "n_shingles", "sig", "bands"])
            out.insert(0, "doc_id", pdf["doc_id"])
            out.insert(1, "hash", pdf["hash"])
            yield out
        known.clear()
        hold("ngram_join")

    # ids as strings: a null among them would make pandas round the others
    thin = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).withColumn("hash", F.xxhash64("text"))
    found = thin.mapInPandas(run, "doc_id string, hash long, f1 long, f2 long, n_shingles long, sig binary, bands array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _pairs(sig: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (i, j) between members ``rows`` and ``cols`` of a block."""
    i, j = np.meshgrid(rows, cols, indexing="ij")
    i, j = i.ravel(), j.ravel()
    if same:
        i, j = i[i < j], j[i < j]
    sizes = np.array([len(s) for s in sets])
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    ok = small >= threshold * large
    i, j = i[ok], j[ok]
    equal = np.zeros(len(i), int)
    floor = least_matches(threshold)
    for n in range(STEP, HASHES + 1, STEP):
        equal += (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(1)
        ok = equal >= floor[n]
        i, j, equal = i[ok], j[ok], equal[ok]
    if not len(i):
        return i, j
    # exact intersections: shared shingles are counted column by column of the members' incidence
    alive = np.unique(np.concatenate([i, j]))
    place = np.zeros(len(sets), int)
    place[alive] = np.arange(len(alive))
    flat = np.concatenate([sets[k] for k in alive])
    owner = np.repeat(np.arange(len(alive)), sizes[alive])
    values, column = np.unique(flat, return_inverse=True)
    shared = np.zeros((len(alive), len(alive)), np.int64)
    for at in range(0, len(values), 4096):
        here = (column >= at) & (column < at + 4096)
        dense = np.zeros((len(alive), min(4096, len(values) - at)), np.float32)
        dense[owner[here], column[here] - at] = 1
        shared += (dense @ dense.T).astype(np.int64)
    inter = shared[place[i], place[j]]
    ok = inter >= threshold * (sizes[i] + sizes[j] - inter) - 1e-9
    return i[ok], j[ok]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _compare(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by (family, low, high), the members of one block pair in
    sequence; gives per member its links, and the links of a spanning forest."""
    hold("ngram_join")
    known: dict[str, int] = {}
    held: list[pd.DataFrame] = []
    key = None

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.stack([np.frombuffer(s, "<u4") for s in pdf["sig"]])
        sets = [shingles(t, known) for t in pdf["text"]]
        side, (low, high) = pdf["block"].to_numpy(), key[1:]
        rows, cols = np.flatnonzero(side == low), np.flatnonzero(side == high)
        nodes, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        links = np.zeros(len(pdf), np.int64)
        edges = []
        for at in range(0, len(rows), 128):  # bounds the pairs looked at together
            i, j = _pairs(sig, sets, rows[at : at + 128], cols, low == high, threshold)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            edges += _forest(len(pdf), i, j)
        out = [(int(nodes[a]), int(nodes[b]), 0) for a, b in _forest(len(pdf), *map(np.array, zip(*edges)))] if edges else []
        out += [(int(nodes[k]), None, int(links[k])) for k in np.flatnonzero(links)]
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype({"b": "Int64"})

    for pdf in frames:
        # a batch may end inside a block pair
        starts = np.flatnonzero((pdf[["family", "low", "high"]] != pdf[["family", "low", "high"]].shift()).any(axis=1).to_numpy())
        for s, e in zip(starts, [*starts[1:], len(pdf)]):
            part = pdf.iloc[s:e]
            now = (part["family"].iloc[0], part["low"].iloc[0], part["high"].iloc[0])
            if held and now != key:
                yield block(pd.concat(held, ignore_index=True))
                held = []
            key = now
            held.append(part)
    if held:
        yield block(pd.concat(held, ignore_index=True))
        held = []
    known.clear()
    hold("ngram_join")


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, numbered: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, rep_id (smallest id of
    the documents with the same shingles), class_id (smallest id reachable by
    links), n_links (other documents at the threshold or above). ``numbered``: also
    _hash (xxhash64 of the text) and _group, a number of the documents joined by
    links, null without a shingle; ids may be null or repeated, groups are not.

    Only families of near-duplicates carry their texts through an exchange. A
    family larger than a block is compared as pairs of blocks, each its own
    task's work, so no task holds a family however large.
    """
    described = materialize(describe(docs), "described")
    some = described.where("n_shingles > 0")
    # a class goes by a number of its own, fixed by the table, and by one of its texts
    at = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash"))
    classes = some.groupBy("f1", "f2").agg(at.alias("at"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"))
    classes = classes.select("f1", "f2", F.col("at.doc_id").alias("rep"), F.col("at.hash").alias("rep_hash"), "copies", "n_shingles")
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    one = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("hash") == F.col("rep_hash"))
    addressed = classes.select("node", "rep", "rep_hash", F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    reps = some.join(addressed, one & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))).select("node", "sig", "bands")
    reps = reps.dropDuplicates(["node"])
    bands = reps.select("node", F.explode("bands").alias("band"))
    lowest = bands.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low")
    stars = bands.join(lowest, "band").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    families = components(stars).select("node", F.col("component").alias("family"))
    families = materialize(families.join(classes.select("node", "rep", "rep_hash", "copies", "n_shingles"), "node"), "families")
    blocks = families.groupBy("family").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("weight"))
    blocks = blocks.select("family", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = split_join(families, blocks, ["family"], ["node"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("hash", F.xxhash64("text"))
    # a merge join at every size: the families' ids grow with the documents, so they are not broadcast
    members = text.join(placed.hint("merge"), one).join(reps.select("node", "sig"), "node").dropDuplicates(["node"])
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high")))
    spread = members.withColumn("pair", F.explode(others)).select("family", "pair.low", "pair.high", "block", "node", "copies", "sig", "text")
    spread = spread.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "node")
    found = materialize(spread.mapInPandas(lambda frames: _compare(frames, threshold), "a long, b long, links long"), "links")
    graph = components(found.where("b is not null").select("a", "b"))
    # the documents joined by links go by their smallest id
    lowest = graph.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("lowest"))
    graph = split_join(graph, lowest, ["component"], ["node"])
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    per_class = classes.join(graph, "node", "left").join(links, "node", "left")
    per_class = per_class.select("f1", "f2", "rep", "copies", F.least("lowest", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("_group"))
    more = ["_hash", "_group"] if numbered else []
    out = split_join(some.select("doc_id", F.col("hash").alias("_hash"), "f1", "f2"), per_class, ["f1", "f2"], ["doc_id"])
    out = out.select("doc_id", F.col("rep").alias("rep_id"), "class_id", (F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"), *more)
    empty = described.where("n_shingles = 0").withColumn("_hash", F.col("hash")).withColumn("_group", F.lit(None).cast("long"))
    empty = empty.select("doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), *more)
    return out.unionByName(empty)

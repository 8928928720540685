"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 2).

Texts are sequences of lower-cased words. A benchmark item is found in a
document when some item-sized window lies within ``EDITS`` (a share of the item's
words) word edits of it. Windows and items are embedded by CGK random walks
(Chakraborty, Goldenberg and Koucky, 2016): a walk reads a word, emits it and
steps on or stays as a random bit of (step, word) says, so that few edits leave
most emitted positions equal. Each of ``repeats(n)`` rounds takes its own walk, in
turn from the front and from the back, and samples ``SAMPLED`` of its first n
positions; the sampled words are the key of a bucket. Windows meet all items of
their size in their buckets, and for each pair met the edit distance is computed
exactly, on the words around the window, by Sellers' algorithm.

A window is only embedded if it can match at all, by two tests that lose nothing:
k edits cut an item of n words into k + 1 runs, so a match shares a run of
(n - k) // (k + 1) words, at least ``anchor`` words, with an item of its size at
nearly the item's own offset; and it holds all but k of that item's words.
Documents are read once for each part of the benchmark of at most ``PART`` bytes,
with no exchange; what is broadcast is one part.

Defined cases: null and empty texts match nothing; items without an id or without
a word are never found; an item shorter than a window's anchor must occur in full;
repeated rows are judged each; equal items are reported each; an empty benchmark
finds nothing; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from siftmill.llm.shared import hold, materialize

#: Word edits allowed, as a share of an item's words.
EDITS = 0.2
#: Emitted positions that a round samples, and the share of matches with the most
#: edits that the rounds are to meet.
SAMPLED, RECALL = 2, 0.9999
#: Bytes of benchmark text that are broadcast at once.
PART = 32_000_000
#: Windows embedded together.
WINDOWS = 50_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def repeats(n: int, recall: float = RECALL) -> int:
    """Rounds for items of n words. One round meets a match with edits on every fifth
    word, the worst placement tried, with probability of about 2 / sqrt(n)."""
    met = min(0.5, 2 / n**0.5)
    return ceil(log(1 - recall) / log(1 - met))


def allowed(n: int, share: float = EDITS) -> int:
    return int(share * n + 1e-9)


def cgk(codes: np.ndarray, lengths: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Walks over rows of ``codes`` (padded): emitted words, 0 beyond a row's end."""
    n = len(codes)
    at = np.zeros(n, np.int64)
    out = np.zeros((n, steps), np.int64)
    rows = np.arange(n)
    for step in range(steps):
        inside = at < lengths
        got = np.where(inside, codes[rows, np.minimum(at, codes.shape[1] - 1)], 0)
        out[:, step] = got
        with np.errstate(over="ignore"):
            h = (got.astype(np.uint64) + np.uint64(step * 1_000_003 + seed * 7_919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at += ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> int:
    """Least edits between ``item`` and any stretch of ``text`` (Sellers, 1980)."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for k, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def _runs(codes: np.ndarray, run: int) -> np.ndarray:
    """One key per run of so many codes."""
    out = np.zeros(max(0, len(codes) - run + 1), np.int64)
    with np.errstate(over="ignore"):
        for j in range(run):
            out = out * np.int64(0x5851F42D4C957F2D) + codes[j : len(out) + j]
    return out


class Index:
    """The benchmark's items with their anchors and hashed walks."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = EDITS):
        self.share = share
        self.code: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            got = np.array([self.code.setdefault(w, len(self.code) + 1) for w in words(text)], np.int64)
            if len(got):
                self.items.append((item_id, got))
        self.size = np.array([len(g) for _, g in self.items], np.int64)
        self.edits = np.array([allowed(len(g), share) for _, g in self.items], np.int64)
        self.members = [np.unique(g) for _, g in self.items]
        # anchors: run length -> sorted keys, and the (item, offset) of each key
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, got) in enumerate(self.items):
            run = int(max(1, min((len(got) - self.edits[k]) // (self.edits[k] + 1), 4)))
            found.setdefault(run, []).extend((int(key), k, at) for at, key in enumerate(_runs(got, run)))
        self.anchors = {run: np.array(sorted(rows), np.int64).T for run, rows in found.items()}
        # buckets: per round, sorted keys of the items that it is for
        self.widest = int(self.size.max(initial=1))
        padded = np.zeros((len(self.items), self.widest), np.int64)
        for k, (_, got) in enumerate(self.items):
            padded[k, : len(got)] = got
        self.rounds = np.array([repeats(n) for n in range(1, self.widest + 1)])
        self.buckets = []
        for r in range(int(self.rounds[self.size - 1].max(initial=0))):
            mine = np.flatnonzero(self.rounds[self.size - 1] > r)
            keys = self.keys(padded[mine], self.size[mine], r)
            order = np.argsort(keys, kind="stable")
            self.buckets.append((keys[order], mine[order]))

    def keys(self, codes: np.ndarray, sizes: np.ndarray, r: int) -> np.ndarray:
        """Bucket keys of full windows (rows of ``codes``, padded) in a round: a hash of the
        sampled words, the window's size and the round."""
        if r % 2:
            back = np.maximum(sizes[:, None] - 1 - np.arange(codes.shape[1]), 0)
            codes = np.where(np.arange(codes.shape[1]) < sizes[:, None], np.take_along_axis(codes, back, 1), 0)
        sampled = np.zeros((len(codes), SAMPLED), np.int64)
        for n in np.unique(sizes):
            places = np.random.default_rng([11, r, int(n)]).choice(int(n), min(SAMPLED, int(n)), replace=False)
            sampled[sizes == n] = np.sort(np.resize(places, SAMPLED))
        walk = cgk(codes, sizes, int(sampled.max(initial=0)) + 1, r)
        out = sizes * np.int64(1_000_003) + r
        with np.errstate(over="ignore"):
            for j in range(SAMPLED):
                out = (out ^ walk[np.arange(len(codes)), sampled[:, j]]) * np.int64(0x5851F42D4C957F2D)
                out ^= out >> np.int64(31)
        return out

    def search_all(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """(item id, edits) of every item found, for each text."""
        get = self.code.get
        coded = [[get(w, 0) for w in words(t)] for t in texts]
        lens = np.array([len(c) for c in coded], np.int64)
        ends = np.cumsum(lens)
        codes = np.fromiter(chain.from_iterable(coded), np.int64, int(lens.sum()))
        del coded
        doc, start, size = self._windows(codes, ends, lens)
        best: list[dict[int, int]] = [{} for _ in texts]
        for d, k, low, high in self._met(codes, ends, lens, doc, start, size):
            text = codes[low:high]
            if np.isin(text, self.members[k]).sum() >= self.size[k] - self.edits[k] and best[d].get(k) != 0:
                edits = edit_distance(self.items[k][1], text)
                if edits <= self.edits[k]:
                    best[d][k] = min(edits, best[d].get(k, edits))
        return [sorted((self.items[k][0], e) for k, e in found.items()) for found in best]

    def _windows(self, codes: np.ndarray, ends: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that can match some item of their size: document, start, size."""
        known = np.concatenate([[0], np.cumsum(codes > 0)])
        seen: set[tuple[int, int, int]] = set()
        for run, (keys, item, offset) in self.anchors.items():
            if len(codes) < run:
                continue
            at = np.flatnonzero(known[run:] - known[:-run] == run)  # runs without a word outside the benchmark
            runs = _runs(codes, run)[at]
            low, high = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
            times = high - low
            at, low = np.repeat(at, times), np.repeat(low, times)
            pick = low + np.arange(len(low)) - np.repeat(np.cumsum(times) - times, times)
            k, start = item[pick], at - offset[pick]
            doc = np.searchsorted(ends, at, "right")
            begin, n, edits = ends[doc] - lens[doc], self.size[k], self.edits[k]
            # a match has all but `edits` of the item's words within reach of the window
            low, high = np.clip(start - edits, begin, ends[doc]), np.clip(start + n + edits, begin, ends[doc])
            # a window may begin ahead of the document, by as many words as the match may lack
            first, last = np.maximum(start, begin) - edits, np.maximum(start + edits, begin)
            ok = known[high] - known[low] >= n - edits
            for d, i, f, t, a, e in set(zip(doc[ok].tolist(), k[ok].tolist(), first[ok].tolist(), last[ok].tolist(), low[ok].tolist(), high[ok].tolist())):
                if np.isin(codes[a:e], self.members[i]).sum() >= self.size[i] - self.edits[i]:
                    seen.update((d, w, int(self.size[i])) for w in range(f, t + 1))
        got = np.array(sorted(seen), np.int64).reshape(-1, 3)
        return got[:, 0], got[:, 1], got[:, 2]

    def _met(self, codes: np.ndarray, ends: np.ndarray, lens: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Stretches (document, item, low, high) around the windows that share a bucket
        with an item, overlapping ones of a pair as one."""
        found: list[np.ndarray] = []
        for at in range(0, len(doc), WINDOWS):
            d, s, n = doc[at : at + WINDOWS], start[at : at + WINDOWS], size[at : at + WINDOWS]
            # words outside the document, and beyond a window's own size, are no words
            place = s[:, None] + np.arange(int(n.max()))
            inside = (place >= (ends - lens)[d][:, None]) & (place < ends[d][:, None]) & (np.arange(place.shape[1]) < n[:, None])
            windows = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], 0)
            for r, (keys, item) in enumerate(self.buckets):
                asked = np.flatnonzero(self.rounds[n - 1] > r)
                mine = self.keys(windows[asked], n[asked], r)
                low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                times = high - low
                pick = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                found.append(np.stack([np.repeat(at + asked, times), item[pick]]))
        pairs = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
        w, k = pairs
        pad = self.edits[k]
        low, high = np.maximum(start[w] - pad, (ends - lens)[doc[w]]), np.minimum(start[w] + size[w] + pad, ends[doc[w]])
        out: list[tuple[int, int, int, int]] = []
        for d, i, a, e in sorted(zip(doc[w].tolist(), k.tolist(), low.tolist(), high.tolist())):
            if out and out[-1][:2] == (d, i) and a <= out[-1][3]:
                out[-1] = (d, i, out[-1][2], max(e, out[-1][3]))
            else:
                out.append((d, i, a, e))
        return out

    def search(self, text: str | None) -> list[tuple[int, int]]:
        return self.search_all([text])[0]


_MADE: dict[str, Index] = {}


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, keep: bool = False, into: tuple[str, str] = ("items", "edits")) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, contaminated, and ``into``: items
    (ids found, ascending), edits (of each). ``keep``: instead all columns of ``docs``
    plus ``into``, whose names must be free there."""
    docs = docs if keep else docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = named.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, ceil(size / PART))
    named = named.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for part in range(parts):
        items = [(r["item_id"], r["text"]) for r in named.where(F.col("part") == part).orderBy("item_id", "text").collect()]
        docs = _searched(docs, items, share, into, part > 0)
        if part < parts - 1:  # a worker holds the index of one part
            docs = materialize(docs, "decontaminate")
    if keep:
        return docs
    return docs.select("doc_id", (F.size(into[0]) > 0).alias("contaminated"), *into)


def _searched(docs: DataFrame, items: list[tuple[int, str | None]], share: float, into: tuple[str, str], more: bool) -> DataFrame:
    """``docs`` plus the columns ``into``; ``more``: they are there and are added to."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    at, name = docs.columns.index("text"), uuid.uuid4().hex
    width = len(docs.columns) - 2 * more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("decontaminate", _MADE.clear)
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = Index(sent.value, share)
        for batch in batches:
            found = []
            for lo in range(0, batch.num_rows, 2000):
                found += _MADE[name].search_all(batch.column(at).slice(lo, 2000).to_pylist())
            if more:
                before = zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())
                found = [sorted([*zip(*old), *new]) for old, new in zip(before, found)]
            new = [pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64())), pa.array([[d for _, d in f] for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[*batch.schema.names[:width], *into])

    added = [StructField(into[0], ArrayType(LongType())), StructField(into[1], ArrayType(IntegerType()))]
    return docs.mapInArrow(run, StructType([*docs.schema.fields[:width], *added]))

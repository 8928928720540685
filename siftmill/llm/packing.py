"""Packing documents into fixed windows by non-negative least squares (operator 8).

Each task packs its own documents, block by block. Whole windows are cut off long
documents first. The lengths that remain form a histogram on a grid; every
combination of at most ``DEPTH`` grid lengths that fills the window is a column
of a matrix, and non-negative least squares gives how often to use each. The
counts are rounded down, combinations are filled with documents, and what they
do not use (with the few ids by which a combination overflows, cut off its last
piece) is packed greedily in one run. Only a block's last sequence is not full; those
of all blocks are run together at the end.

Defined cases: null or empty text is one end id; a null doc_id is kept as null;
repeated rows are packed each; an empty table gives no row; other columns are
ignored. Sequence ids are distinct over the table, not consecutive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import materialize
from siftmill.llm.tokenize import encoder

WINDOW = 2048
END_ID = 1
#: Grid of the histogram, and pieces of a combination at most.
GRID, DEPTH = 64, 4
#: A block ends at so many documents or ids.
BLOCK_DOCS, BLOCK_IDS = 8192, 8_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Lawson and Hanson's active-set method: x >= 0 that minimises |a x - b|."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        active[best] = True
        while True:
            cols = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if z.min() > 1e-12:
                x[:] = 0
                x[cols] = z
                break
            low = z <= 1e-12
            old = x[cols]
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            x[cols] = old + step * (z - old)
            drop = cols[x[cols] <= 1e-12]
            x[drop] = 0
            active[drop if len(drop) else cols[low]] = False
            if not active.any():
                break
    return x


@lru_cache
def combinations(cells: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``depth`` positive grid lengths that sum to ``cells``."""
    if depth == 1:
        return [(cells,)]
    out = [(cells,)]
    for first in range(cells - 1, 0, -1):
        out += [(first, *rest) for rest in combinations(cells - first, depth - 1) if rest[0] <= first]
    return out


def plan(lengths: np.ndarray, window: int, grid: int = GRID, depth: int = DEPTH) -> tuple[list[list[int]], list[int]]:
    """Groups of items whose lengths fill the window or a little more, by the
    rounded least-squares solution, and the items left over."""
    cells = window // grid
    cell = np.asarray(lengths) // grid
    bins = [np.flatnonzero(cell == k).tolist() for k in range(cells)]
    counts = np.array([len(x) for x in bins[1:]], float)
    combos = [c for c in combinations(cells, depth) if c[0] < cells]
    groups: list[list[int]] = []
    if counts.any():
        a = np.zeros((cells - 1, len(combos)))
        for j, c in enumerate(combos):
            for k in c:
                a[k - 1, j] += 1
        x = nnls(a, counts)
        for j in np.argsort(-x, kind="stable"):
            for _ in range(int(x[j] + 1e-6)):
                need = combos[j]
                if any(len(bins[k]) < need.count(k) for k in set(need)):
                    break
                groups.append([bins[k].pop() for k in need])
    return groups, [i for x in bins for i in x]


def pack(lengths: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items of the given lengths."""
    lengths = np.asarray(lengths, np.int64)
    sequence = 0
    rest, start = [], []
    for i, n in enumerate(lengths.tolist()):
        at = 0
        while n - at >= window:
            yield i, at, window, sequence, 0
            sequence += 1
            at += window
        if n > at:
            rest.append(i)
            start.append(at)
    left = [int(lengths[i]) - s for i, s in zip(rest, start)]
    groups, over = plan(np.array(left, np.int64), window)
    loose = [(rest[k], start[k], left[k]) for k in over]
    for group in groups:
        offset = 0
        for k in group:
            take = min(left[k], window - offset)
            if take:
                yield rest[k], start[k], take, sequence, offset
            offset += take
            if take < left[k]:
                loose.append((rest[k], start[k] + take, left[k] - take))
        sequence += 1
    loose.sort(key=lambda p: (-p[2], p[0], p[1]))
    offset = 0
    for item, at, n in loose:
        while n:
            take = min(n, window - offset)
            yield item, at, take, sequence, offset
            at, n, offset = at + take, n - take, offset + take
            if offset == window:
                sequence, offset = sequence + 1, 0


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    One pass over the documents with no exchange. Each block leaves one sequence
    that is not full; the pieces of those, with their ids, are then run together
    in groups of ``BLOCK_IDS``, so that padding does not grow with the number of
    tasks: it is one sequence a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, True)
        base = TaskContext.get().partitionId() << 36
        names, parts, sizes, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal base
            ids = np.concatenate(parts).astype("<u4", copy=False)
            lens = np.concatenate(sizes)
            begin = np.cumsum(lens) - lens
            pieces = np.array(sorted(pack(lens, window)), np.int64)
            item, start, length, sequence, offset = pieces.T
            spans = [(a, a + n) for a, n in zip((begin[item] + start).tolist(), length.tolist())]
            crc = [zlib.crc32(ids[a:e]) for a, e in spans]
            # what is not full goes on with its ids
            open_ = (np.bincount(sequence, length) < window)[sequence]
            rest = [ids[a:e].tobytes() if o else None for (a, e), o in zip(spans, open_.tolist())]
            doc_ids = pa.concat_arrays(names).take(pa.array(item))
            made = [doc_ids, start, length, np.array(crc, np.int64), lens[item], sequence + base, offset, pa.array(rest, pa.binary())]
            base += int(sequence.max()) + 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) if isinstance(x, np.ndarray) else x for x in made], names=[*NAMES, "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                ids, starts = enc.encode(part.column(1), END_ID)
                names.append(part.column(0))
                parts.append(ids)
                sizes.append(np.diff(starts))
                total += len(ids)
                if total >= BLOCK_IDS or sum(map(len, sizes)) >= BLOCK_DOCS:
                    yield block()
                    names, parts, sizes, total = [], [], [], 0
        if names:
            yield block()
        enc.rest()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # behind the sequences of every task of the pass before
        sequence, room = (1 << 62) + (TaskContext.get().partitionId() << 36), window
        for batch in batches:
            rows = []
            for doc_id, start, length, _, doc_tokens, _, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                while at < length:
                    take = min(length - at, room)
                    rows.append((doc_id, start + at, take, zlib.crc32(ids[4 * at : 4 * (at + take)]), doc_tokens, sequence, window - room))
                    at, room = at + take, room - take
                    if not room:
                        sequence, room = sequence + 1, window
            columns = [list(c) for c in zip(*rows)] or [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + ", ids binary")
    made = materialize(made, "pieces")
    left = made.where("ids is not null")
    groups = -(-(left.agg(F.sum("length").alias("n")).first()["n"] or 0) // BLOCK_IDS)
    again = left.repartition(max(1, groups)).sortWithinPartitions("sequence_id", "offset").mapInArrow(together, SCHEMA)
    return made.where("ids is null").drop("ids").unionByName(again)

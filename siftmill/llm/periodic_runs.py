"""Periodic runs of words by block matching (operator 11).

A run is a stretch of words with smallest period q, at least ``LEAST`` words and
``TIMES`` periods long, that no neighbouring word extends. Words are numbered, and the
text's aligned blocks of 8, 16, 32, ... numbers are searched in the whole text
with an Aho-Corasick automaton of integer sequences; a block beyond 8 is spelled as
the two blocks of the scale before, so that no pattern is long. The scale of B words
seeds the periods from B to 2B - 1 (1 to 15 at the first): the stretch in which each
word equals that q further on has 2q words at least, so it holds an aligned block
whose copy begins q words later. A block of the next scale is searched only if both
its halves come again far enough behind; most texts end at the first scale.

Seeds are extended to both sides. Their ends are found for all seeds at once by
halving, on prefix sums modulo two primes: such a comparison never takes equal
words for different ones, so no run is lost, and each run found is compared word by
word; if that fails, it is extended word by word. A stretch found with several periods
keeps the smallest, which divides the others. Time grows as n log(n) squared for any
text of n words; memory with n.

Defined cases: null or empty text, or text of white space only, has no word and no
run; its collapsed text is empty. A null doc_id is kept; repeated rows are judged
each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import hold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words and periods of a run at least; words of the smallest block. The first
#: scale needs LEAST > 3 * FIRST - 2 and TIMES >= 3.
LEAST, TIMES, FIRST = 24, 3, 8
#: Children of an automaton's node, which the library looks through one by one.
FAN = 1024
_PRIMES, _BASES = (2147483647, 2147483629), (1000003, 998244353)
#: Texts of a batch that is returned.
BATCH = 256

Rewrite = Callable[[int | None, list[str]], list[str]]


def _search(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of ``keys`` (numbers from 0) searched in a sequence of numbers (-1: fits
    none) with one automaton: ends of the places, their patterns, and each row's pattern."""
    import ahocorasick

    kinds, width = int(names.max()) + 1, 1
    while FAN**width < kinds:
        width += 1

    def spell(x: np.ndarray) -> np.ndarray:
        """A number is several symbols, of which the last alone is below FAN, so that
        nodes have few children."""
        digits = np.stack([x // FAN**k % FAN + (FAN if k else 0) for k in range(width - 1, -1, -1)], axis=-1)
        return np.where(x[..., None] < 0, 2 * FAN, digits)

    spelled = spell(keys).reshape(len(keys), -1)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    pattern: dict[tuple, int] = {}
    of_key = []
    for key in map(tuple, spelled.tolist()):
        got = pattern.get(key)
        if got is None:
            got = pattern[key] = len(pattern)
            automaton.add_word(key, got)
        of_key.append(got)
    automaton.make_automaton()
    hits = np.fromiter((x for hit in automaton.iter(tuple(spell(names).ravel().tolist())) for x in hit), np.int64).reshape(-1, 2)
    return hits[:, 0] // width, hits[:, 1], np.array(of_key, np.int64)


class _Prefixes:
    """Sums of a text's numbers, weighed by powers of two bases, modulo two primes."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for prime, base in zip(_PRIMES, _BASES):
            powers = np.ones(len(ids) + 1, np.uint64)
            made, step = 1, base % prime
            while made < len(powers):
                more = powers[: min(made, len(powers) - made)] * np.uint64(step) % np.uint64(prime)
                powers[made : made + len(more)] = more
                made, step = made + len(more), step * step % prime
            terms = (ids.astype(np.uint64) + np.uint64(1)) * powers[:-1] % np.uint64(prime)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(terms) % np.uint64(prime)]))
            self.powers.append(powers)

    def equal(self, start: np.ndarray, end: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether words from start to end equal those so many further on."""
        out = np.ones(len(start), bool)
        for prime, sums, powers in zip(_PRIMES, self.sums, self.powers):
            p = np.uint64(prime)
            here, there = (sums[end] + p - sums[start]) % p, (sums[end + shift] + p - sums[start + shift]) % p
            out &= here * powers[shift] % p == there
        return out


def _stretches(prefixes: _Prefixes, n: int, at: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last end of the words around ``at`` that equal those ``shift`` further on."""
    left, right = np.zeros_like(at), np.zeros_like(at)
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        far = left + step
        ok = far <= at
        ok[ok] = prefixes.equal((at - far)[ok], at[ok], shift[ok])
        left[ok] = far[ok]
        far = right + step
        ok = at + shift + far <= n
        ok[ok] = prefixes.equal(at[ok], (at + far)[ok], shift[ok])
        right[ok] = far[ok]
        step >>= 1
    return at - left, at + right


def _walked(ids: np.ndarray, at: int, shift: int) -> tuple[int, int]:
    """The same, word by word."""
    start = end = at
    while start and ids[start - 1] == ids[start - 1 + shift]:
        start -= 1
    while end + shift < len(ids) and ids[end] == ids[end + shift]:
        end += 1
    return start, end


def find_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start and period."""
    n = len(words)
    if n < LEAST:
        return []
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    block, alive = FIRST, np.ones(n // FIRST, bool)
    names = prefixes = None
    found: dict[tuple[int, int], int] = {}
    while alive.any() and TIMES * block <= n:
        js = np.flatnonzero(alive)
        if names is None:
            end, kind, of_key = _search(ids, ids[: n // block * block].reshape(-1, block)[js])
            place = end + 1 - block
        else:
            # a block is two blocks of the scale before, in the sequence of every half-th place
            half = block // 2
            rows = -(-n // half)
            steps = np.full((rows + 1) * half, -1, np.int64)
            steps[:n] = names
            steps = steps.reshape(rows + 1, half).T.ravel()
            end, kind, of_key = _search(steps, names[js[:, None] * block + np.array([0, half])])
            place = (end % (rows + 1) - 1) * half + end // (rows + 1)
        of_block = np.full(len(alive), -1, np.int64)
        of_block[js] = of_key
        names = np.full(n, -1, np.int64)
        names[place] = kind
        # blocks that begin so many words before an occurrence
        low = 1 if block == FIRST else block
        seeds = []
        for back in range(2 if block == FIRST else 1):
            j = (place - low) // block - back
            ok = (j >= 0) & (place - j * block < 2 * block)
            ok[ok] = of_block[j[ok]] == kind[ok]
            seeds.append(np.stack([place[ok] - j[ok] * block, j[ok] * block]))
        shift, at = np.concatenate(seeds, axis=1)
        order = np.lexsort((at, shift))
        shift, at = shift[order], at[order]
        # of blocks that follow each other with one shift, the first
        head = np.ones(len(at), bool)
        head[1:] = (np.diff(shift) != 0) | (np.diff(at) != block)
        shift, at = shift[head], at[head]
        if len(at):
            prefixes = prefixes or _Prefixes(ids)
            start, end = _stretches(prefixes, n, at, shift)
            length = end - start + shift
            for k in np.flatnonzero(length >= np.maximum(LEAST, TIMES * shift)).tolist():
                s, e, q = int(start[k]), int(end[k]), int(shift[k])
                if (s, e + q) in found:
                    continue
                if not np.array_equal(ids[s:e], ids[s + q : e + q]):
                    s, e = _walked(ids, int(at[k]), q)
                    if e - s + q < max(LEAST, TIMES * q):
                        continue
                found.setdefault((s, e + q), q)
        # a block of the next scale needs copies of both halves two blocks on, or further
        last = np.full(int(of_block.max()) + 2, -1, np.int64)
        np.maximum.at(last, kind, place)
        again = alive & (last[of_block] >= (np.arange(len(of_block)) + 2) * block)
        pairs = len(again) // 2
        alive = again[: 2 * pairs : 2] & again[1 : 2 * pairs : 2]
        block *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(edges[:-1]).tolist()) if not inside]


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_words, ``runs`` (array of start,
    length, period in words, by start and period) and ``collapsed``, the words that no run
    holds behind its first period, joined by spaces. ``rewrite`` may replace a
    document's words before they are searched."""
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", run), ("collapsed", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("periodic_runs")
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.slice(at, BATCH)
                counts, runs, texts = [], [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    words = WORD.findall(text.as_py() or "")
                    if rewrite:
                        words = rewrite(doc_id, words)
                    got = find_runs(words)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": k, "period": q} for s, k, q in got])
                    texts.append(" ".join(kept_words(words, got)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, run), pa.array(texts, pa.string())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(found, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")

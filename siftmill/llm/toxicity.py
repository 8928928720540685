"""Toxicity by subword-bag embeddings and a linear softmax (operator 1).

As in fastText's classifier (Joulin et al., 2016): a word is the mean of the
vectors of its character n-grams ("<word>" cut into 3 to 5 characters) and of
itself, all hashed to one table of vectors; a text is the mean of its words; a
linear softmax over the text's vector gives the classes. Vectors and softmax
are trained jointly by gradient descent in numpy, each bucket's step scaled by the
spread of its share over documents, so that frequent and rare n-grams learn at
one pace. A misspelling that was never seen shares
most n-grams, and so its vector, with the word it comes from.

Means and the softmax's margin are linear, so a trained model folds into one
number per hash bucket and a scoring worker needs only those.

Defined cases: null or empty texts, and texts without a letter or digit, get
the score of the empty bag (the bias alone); null labels are not learnt from;
without a label of each class every score is the share of toxic labels (0 if
there are none); repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siftmill.llm.shared import hold

BUCKETS = 1 << 17
DIM = 4
SIZES = (3, 4, 5)
STEPS, RATE, DECAY = 36, 0.5, 0.1
#: A bucket needs occurrences in this share of the documents to have a vector.
RARE = 0.004
#: Words whose n-grams, and entries of a sparse matrix that, are looked at together.
CHUNK, BLOCK = 40_000, 400_000
#: One document of so many in the sample is kept to place the threshold.
HOLD = 12
#: A missed toxic document costs as much as so many wrong alarms there.
MISS = 3
#: Labelled documents to fit on at most, chosen by a hash of their id.
SAMPLE = 12_000
#: Pairs of a document and a word of it to fit on at most.
ENTRIES = 10_000_000
#: Distinct pieces that a scoring worker remembers, and rows that it looks at together.
MEMORY, ROWS = 200_000, 1000
_WORD = re.compile(r"\w+")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of every word, and of the words themselves."""
    marked = ["<" + w + ">" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(points))  # characters from here to the word's end
    rows, cols = [np.arange(len(words))], [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words), np.int64, len(words))]
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) ^ points[j : len(points) - n + 1 + j]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            ok = left[: len(h)] >= n
            rows.append(of[: len(h)][ok])
            cols.append((h[ok] >> np.uint64(47)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(cols)


class Model:
    """One number per bucket and a bias: the margin of a text is the mean over
    its words of the mean of their buckets' numbers, plus the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        rows, cols = features(words)
        n = np.bincount(rows, minlength=len(words))
        return np.bincount(rows, self.weights[cols], len(words)) / n

    def margin(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for text in texts:
            got = _WORD.findall((text or "").lower())
            out.append(self.words(got).mean() + self.bias if got else self.bias)
        return np.array(out)


class _Sparse:
    """A sparse matrix by rows. Products are summed over at most ``BLOCK`` entries at a
    time, so that beside the entries only blocks and results take memory."""

    def __init__(self, ends: np.ndarray, cols: np.ndarray, values: np.ndarray, n_cols: int):
        """``ends``: where each row's entries end in ``cols``; ``values``: of each entry, or of each row."""
        self.start = np.concatenate([[0], ends]).astype(np.int64)
        self.cols, self.values, self.n_cols = cols, values, n_cols
        self.by_row = len(values) != len(cols) or len(values) == len(ends)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        n = len(self.start) - 1
        sides = np.ascontiguousarray(x.T, np.float32)
        out = np.zeros((len(sides), n), np.float32)
        row = 0
        while row < n:
            last = max(row + 1, int(np.searchsorted(self.start, self.start[row] + BLOCK, "right")) - 1)
            low, high = self.start[row], self.start[last]
            if high > low:
                some = row + np.flatnonzero(self.start[row:last] < self.start[row + 1 : last + 1])
                cols, first = self.cols[low:high], self.start[some] - low
                for k, side in enumerate(sides):
                    part = np.take(side, cols)
                    if not self.by_row:
                        part *= self.values[low:high]
                    out[k, some] = np.add.reduceat(part, first)
            row = last
        if self.by_row:
            out *= self.values
        return out.T

    def back(self, x: np.ndarray) -> np.ndarray:
        """The product of the transposed matrix."""
        out = np.zeros((x.shape[1], self.n_cols), np.float32)
        n, row = len(self.start) - 1, 0
        while row < n:
            last = max(row + 1, int(np.searchsorted(self.start, self.start[row] + BLOCK, "right")) - 1)
            low, high = self.start[row], self.start[last]
            times, cols = np.diff(self.start[row : last + 1]), self.cols[low:high]
            for k in range(x.shape[1]):
                side = x[row:last, k] * self.values[row:last] if self.by_row else x[row:last, k]
                part = np.repeat(side, times)
                if not self.by_row:
                    part = part * self.values[low:high]
                out[k] += np.bincount(cols, part, self.n_cols)
            row = last
        return out.T


class Bags:
    """Documents as counts of words, added one text at a time; a text is not kept."""

    def __init__(self) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.shares: list[np.ndarray] = []
        self.entries = 0

    def add(self, text: str | None) -> None:
        number = self.vocabulary
        got = Counter(_WORD.findall((text or "").lower()))
        total = got.total()
        self.ids.append(np.fromiter((number.setdefault(w, len(number)) for w in got), np.int32, len(got)))
        self.shares.append(np.fromiter(got.values(), np.float32, len(got)) / max(total, 1))
        self.entries += len(got)

    def words(self, docs: np.ndarray) -> _Sparse:
        """Documents by words, each entry the word's share of its document."""
        picked = [self.ids[k] for k in docs]
        none = [np.zeros(0, np.int32)]
        return _Sparse(np.cumsum([len(i) for i in picked]), np.concatenate(picked or none), np.concatenate([self.shares[k] for k in docs] or none).astype(np.float32), len(self.vocabulary))

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Buckets of all words in order, some at a time: (first word, entries per word, buckets)."""
        words = list(self.vocabulary)
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK]
            rows, cols = features(part)
            order = np.argsort(rows, kind="stable")
            yield at, np.bincount(rows, minlength=len(part)), cols[order].astype(np.int32)


def train(texts: list[str | None], labels: np.ndarray) -> Model:
    bags = Bags()
    for text in texts:
        bags.add(text)
    return fit_bags(bags, labels)


def fit_bags(bags: Bags, labels: np.ndarray) -> Model:
    """Fit on most of the documents, then move the bias so that a margin of 0 makes
    the least costly errors on the others (the middle of the best range)."""
    labels = np.asarray(labels, float)
    held = np.arange(len(labels)) % HOLD == 0
    rest, kept = labels[~held], labels[held]
    if len(labels) < 10 * HOLD or rest.min() == rest.max() or kept.min() == kept.max():
        return _train(bags, np.arange(len(labels)), labels)
    model = _train(bags, np.flatnonzero(~held), rest)
    per_word = np.zeros((len(bags.vocabulary), 1), np.float32)
    for at, n, cols in bags.grams():
        ends = np.cumsum(n)
        per_word[at : at + len(n), 0] = np.add.reduceat(model.weights[cols], ends - n) / n
    margin = (bags.words(np.flatnonzero(held)) @ per_word)[:, 0] + model.bias
    order = np.argsort(margin)
    # errors when everything from place i on counts as toxic
    wrong = MISS * np.concatenate([[0], np.cumsum(kept[order] == 1)]) + np.concatenate([np.cumsum((kept[order] == 0)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    ends = np.concatenate([[margin.min() - 1], margin[order], [margin.max() + 1]])
    cut = (ends[best[0]] + ends[best[-1] + 1]) / 2
    return Model(model.weights, float(model.bias - cut))


def _train(bags: Bags, docs: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Fit bucket vectors and softmax jointly; labels 0 or 1 of the given documents."""
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS), 30.0 * (2 * share - 1))
    alone = Model(np.zeros(BUCKETS), float(np.log(labels.mean() / (1 - labels.mean()))))
    if not bags.vocabulary:
        return alone
    by_doc = bags.words(docs)
    # a bucket seen in few documents tells them apart without telling what they are
    in_docs = np.bincount(by_doc.cols, minlength=len(bags.vocabulary)).astype(np.float32)
    seen = np.zeros(BUCKETS)
    for at, n, cols in bags.grams():
        seen += np.bincount(cols, np.repeat(in_docs[at : at + len(n)], n), BUCKETS)
    used = np.flatnonzero(seen >= max(3, RARE * len(docs)))
    if not len(used):
        return alone
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    ends, columns, parts = [], [], []
    for _, n, cols in bags.grams():
        got = place[cols]
        ok = got >= 0
        owner = np.repeat(np.arange(len(n)), n)[ok]
        ends.append(np.bincount(owner, minlength=len(n)))
        columns.append(got[ok])
        parts.append((1 / n).astype(np.float32))
    by_word = _Sparse(np.cumsum(np.concatenate(ends)), np.concatenate(columns), np.concatenate(parts), len(used))
    del columns, ends
    n_docs = len(docs)
    rng = np.random.default_rng(seed)

    def to_docs(x: np.ndarray) -> np.ndarray:
        """Bags of documents from numbers of buckets, around their mean."""
        out = by_doc @ (by_word @ x)
        return out - out.mean(0)

    def to_buckets(x: np.ndarray) -> np.ndarray:
        """The transpose of ``to_docs``."""
        return by_word.back(by_doc.back((x - x.mean(0)).astype(np.float32)))

    # spread of each bucket's share over documents, by random signs (Hutchinson's estimate of a diagonal)
    signs = rng.choice([-1.0, 1.0], (n_docs, 12)).astype(np.float32)
    sd = np.sqrt((to_buckets(signs) ** 2).mean(1) / n_docs)
    scale = (1 / np.maximum(sd, np.median(sd) * 0.1)).astype(np.float32)
    e = np.zeros((len(used), DIM), np.float32)
    u = (rng.normal(size=(DIM, 2)) * 0.5).astype(np.float32)
    u[:, 1] = -u[:, 0]
    u *= np.float32(np.sqrt(0.5) / np.linalg.norm(u[:, 0]))  # one speed at every width
    b = np.zeros(2, np.float32)
    target = np.stack([1 - labels, labels], 1)
    rate, best, last = RATE, np.inf, None
    speed = [np.zeros_like(e), np.zeros_like(u), np.zeros_like(b)]
    for _ in range(STEPS):
        bags_ = to_docs(e * scale[:, None])
        z = (bags_ @ u + b).astype(float)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        loss = -np.log(np.maximum((p * target).sum(1), 1e-300)).mean() + DECAY / 2 * float((e.astype(float) ** 2).sum())
        if loss > best and last is not None:  # a step too far: go back and take smaller ones
            rate /= 2
            e, u, b = (x.copy() for x in last)
            speed = [np.zeros_like(e), np.zeros_like(u), np.zeros_like(b)]
            best = np.inf
            continue
        best, last = loss, (e.copy(), u.copy(), b.copy())
        dz = ((p - target) / n_docs).astype(np.float32)
        grads = (to_buckets(dz @ u.T) * scale[:, None] + DECAY * e, bags_.T @ dz, dz.sum(0))
        for k, (x, g) in enumerate(zip((e, u, b), grads)):
            speed[k] = 0.8 * speed[k] + g
            x -= np.float32(rate) * speed[k]
        rate *= 1.1
    e, u, b = last
    weights = np.zeros(BUCKETS)
    weights[used] = (e * scale[:, None]) @ (u[:, 1] - u[:, 0])
    mean = float((by_doc @ (by_word @ weights[used][:, None].astype(np.float32))).mean())
    return Model(weights, float(b[1] - b[0]) - mean)


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Train on at most ``sample`` labelled documents. ``labelled``: doc_id, toxic.

    Only ids are ordered; the chosen documents alone meet in one task, which counts
    the words of one text after another, up to ``entries`` (document, word) pairs in
    all, trains, and hands the driver the model. Of rows that repeat a doc_id one is
    learnt from."""
    chosen = labelled.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        bags, labels, before = Bags(), [], None
        for batch in batches:
            ids, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (doc_id, label) in enumerate(zip(ids, toxic)):
                if (labels and doc_id == before) or bags.entries >= entries:
                    continue
                bags.add(batch.column(2)[k].as_py())
                labels.append(label)
                before = doc_id
        model = fit_bags(bags, np.array(labels, float))
        del bags
        hold("toxicity")
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    # not in order of ids, which would hold out and cut off neighbours
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    made = rows.mapInArrow(learn, "weights binary, bias double").collect()
    if not made:
        return train([], np.zeros(0))
    return Model(np.frombuffer(made[0]["weights"], "<f4").astype(float), made[0]["bias"])


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` plus the column ``into``, the model's probability of toxic; a
    column of that name is replaced."""
    docs = docs.drop(into)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        weights, bias = sent.value
        local, known = Model(weights, bias), _Known()
        for batch in batches:
            parts = []
            for lo in range(0, batch.num_rows, ROWS):
                parts.append(_scores(local, pc.fill_null(batch.column(at).slice(lo, ROWS), ""), known))
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, into])
        del known
        hold("toxicity")

    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    return docs.mapInArrow(run, schema)


class _Known:
    """Pieces of texts: the sum of their words' margins, and their number of words."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, 2))

    def look_up(self, model: Model, pieces: list[str]) -> np.ndarray:
        if len(self.number) > MEMORY:
            self.number, self.table = {}, np.zeros((0, 2))
        number = self.number
        new = [p for p in pieces if p not in number]
        if new:
            words = [_WORD.findall(p.lower()) for p in new]
            flat = model.words(list(chain.from_iterable(words)))
            counts = np.fromiter(map(len, words), np.int64, len(words))
            sums = np.bincount(np.repeat(np.arange(len(words)), counts), flat, len(words)) if len(flat) else np.zeros(len(words))
            number.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, np.stack([sums, counts], 1)])
        return self.table[np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))]


def _scores(model: Model, texts: pa.Array, known: _Known) -> np.ndarray:
    parts = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
    bounds = parts.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = parts.flatten().dictionary_encode()
    each = known.look_up(model, coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    total = np.concatenate([np.zeros((1, 2)), np.cumsum(each, 0)])
    got = total[bounds[1:]] - total[bounds[:-1]]
    return 1 / (1 + np.exp(-np.clip(model.bias + got[:, 0] / np.maximum(got[:, 1], 1), -500, 500)))

"""Quality by compression bands (operator 12).

zstandard's ratio (compressed over plain bytes) tells repetitive text, which packs too
well, and noise, which hardly packs; what is usual depends on the length. The ratio
of every whole text is taken, and that of each of its chunks of ``CHUNK`` bytes if it
has two or more. A band is learnt for each power of two of the length from texts
known to be good: their median there, less and more ``WIDTH`` times the spread of the
lower and the upper half. Between two lengths the limits are interpolated by the
length's logarithm. Lengths with fewer than ``LEAST`` good texts take a fixed band.
Ratios are counted in cells of 1/``CELLS`` over all good texts, so a band rests on all
of them and the driver gets counts alone, at most ``CELLS`` and a few a length.

A text is kept if its base rule holds, its own ratio lies within the band of its
length, and no more than ``SHARE`` of its chunks lie outside the band of theirs.

Defined cases: null text counts as empty; empty text, or text of white space only, has
no word and fails the base rule; a null doc_id is kept as null, and its text is never a
good one; repeated rows are judged each (a repeated good id counts each time); an empty
table gives no row; other columns are ignored. Bands without good texts are the fixed ones.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import hold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The characters counted as symbols, and white space.
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: The base rule.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Bytes of a chunk, zstandard's level, the share of chunks that may lie outside their band.
CHUNK, LEVEL, SHARE = 4096, 3, 0.2
#: Spreads on each side of the median, the least spread, good texts of a length's band at least.
WIDTH, THINNEST, LEAST = 6.0, 0.004, 30
CELLS = 2048
#: (log2 of the length in bytes, lowest ratio, highest ratio) where no good texts are known:
#: half and one and a half times what running text of that length takes.
FIXED = [(6, 0.50, 1.40), (8, 0.32, 1.00), (10, 0.26, 0.84), (12, 0.22, 0.75), (14, 0.19, 0.68), (17, 0.16, 0.62), (40, 0.14, 0.60)]

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, chunk_ratios array<double>"


@dataclass(frozen=True)
class Bands:
    """Points (log2 of the length, lowest, highest), rising; ends hold beyond them."""

    points: list[tuple[float, float, float]] = field(default_factory=lambda: list(FIXED))

    def limit(self, n_bytes: Column, side: int) -> Column:
        """The lowest (1) or highest (2) ratio of texts of that length."""
        at = F.log2(F.greatest(n_bytes, F.lit(1)).cast("double"))
        out = F.lit(float(self.points[-1][side]))
        for a, b in reversed(list(zip(self.points, self.points[1:]))):
            slope = (b[side] - a[side]) / (b[0] - a[0])
            out = F.when(at < F.lit(float(b[0])), F.lit(float(a[side])) + F.lit(slope) * F.greatest(at - F.lit(float(a[0])), F.lit(0.0))).otherwise(out)
        return out

    def outside(self, ratio: Column, n_bytes: Column) -> Column:
        return (ratio < self.limit(n_bytes, 1)) | (ratio > self.limit(n_bytes, 2))


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    out, covered = 0, 0
    for k, w in enumerate(windows):
        if counts[w] > 1:
            out += k + 3 - max(covered, k)
            covered = k + 3
    return out


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): the columns of ``MEASURES``. An
    empty text's ratio is null."""
    ratios = pa.list_(pa.float64())
    kinds = [pa.int64()] * 7 + [pa.float64(), ratios]
    schema = pa.schema(list(zip([c.split()[0] for c in MEASURES.split(", ")], kinds)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hold("compression_bands")
        pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                words, data = WORD.findall(text), text.encode("utf-8", "replace")
                whole = len(data) // chunk
                cut = [len(pack(data[k * chunk : (k + 1) * chunk])) / chunk for k in range(whole)] if whole > 1 else []
                chars = len(text) - sum(map(text.count, SPACE))
                rows.append((len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words), len(data), len(pack(data)) / len(data) if data else None, cut))
            columns = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds[1:])]], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measured, MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))


def fit(measures: DataFrame, good: DataFrame) -> Bands:
    """Bands from the measures of the documents in ``good`` (doc_id) that pass the base rule."""
    known = measures.where(~base_failed() & F.col("ratio").isNotNull()).select("doc_id", "n_bytes", "ratio").join(good.select(F.col("doc_id").cast("long")).distinct(), "doc_id")
    length = F.round(F.log2(F.col("n_bytes").cast("double"))).cast("int")
    # a text's ratio is moved to its band's length by the slope of running text
    drift = F.lit(0.035) * (F.log2(F.col("n_bytes").cast("double")) - length)
    cells = known.groupBy(length.alias("at"), F.floor((F.col("ratio") + drift) * CELLS).alias("cell")).agg(F.count("*").alias("n"))
    counts: dict[int, Counter] = defaultdict(Counter)
    for r in cells.collect():
        counts[r["at"]][r["cell"]] += r["n"]
    return learnt({at: c for at, c in counts.items() if sum(c.values()) >= LEAST})


def learnt(counts: dict[int, Counter]) -> Bands:
    """Bands from the cells of ratios counted at each length; elsewhere the fixed ones."""
    points = {}
    for at, cells in counts.items():
        total, run, quantiles = sum(cells.values()), 0, {}
        for cell in sorted(cells):
            run += cells[cell]
            for q in (0.1, 0.5, 0.9):
                if run >= q * total:
                    quantiles.setdefault(q, (cell + 0.5) / CELLS)
        low, mid, high = quantiles[0.1], quantiles[0.5], quantiles[0.9]
        # nine tenths of a normal half lie within 1.2816 of its spread
        below, above = (max((mid - low) / 1.2816, THINNEST), max((high - mid) / 1.2816, THINNEST))
        points[float(at)] = (mid - WIDTH * below, mid + WIDTH * above)
    if not points:
        return Bands()
    first, last = min(points), max(points)
    fixed = [p for p in FIXED if not first - 1 < p[0] < last + 1]
    return Bands(sorted([(a, *b) for a, b in points.items()] + fixed))


def judge(measures: DataFrame, bands: Bands | None = None, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``measures`` with base_failed, whole_failed, chunks_failed and kept."""
    bands = bands or Bands()
    whole = F.coalesce(bands.outside(F.col("ratio"), F.col("n_bytes")), F.lit(True))
    odd = F.size(F.filter("chunk_ratios", lambda r: bands.outside(r, F.lit(chunk))))
    cut = odd > F.lit(SHARE) * F.size("chunk_ratios")
    rows = measures.withColumn("base_failed", base_failed()).withColumn("whole_failed", whole).withColumn("chunks_failed", cut)
    return rows.withColumn("kept", ~(F.col("base_failed") | F.col("whole_failed") | F.col("chunks_failed")))

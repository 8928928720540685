"""Periodic runs, compression bands and hard negatives against brute force and odd inputs."""

import base64
import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from siftmill.llm import compression_bands, hard_negatives, periodic_runs, queries

ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "x"), (4, "a b c " * 40), (4, "a b c " * 40), (None, "é \x0b ü " * 30), (6, "word " * 30000), (7, "one word"), (-8, "no run here at all")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 0.5, "x") for i, t in ODD], SCHEMA + ", runs string, ratio double, kept string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def all_runs(words):
    """Every run by trying every period at every place."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, k, q) for (s, k), q in out.items())


def test_runs_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(400):
        words, size = [], rnd.choice([20, 60, 200, 500])
        while len(words) < size:
            p = rnd.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 47, 64])
            base = [str(rnd.randrange(rnd.choice([1, 2, 3, 60, 3000]))) for _ in range(p)]
            words += [base[i % p] for i in range(int(p * rnd.choice([0.5, 1, 2.9, 3, 3.1, 5])) + rnd.randint(0, 3))]
            words += [str(rnd.randrange(5000)) for _ in range(rnd.choice([0, 0, 1, 9]))]
        assert periodic_runs.find_runs(words) == all_runs(words)


def test_runs_of_very_regular_texts():
    a, b = "a", "ab"
    while len(b) < 2000:
        a, b = b, b + a
    assert periodic_runs.find_runs(list(b)) == all_runs(list(b))
    assert periodic_runs.find_runs(["a", "b", "c"] * 70000) == [(0, 210000, 3)]
    assert periodic_runs.find_runs(["a"] * 9000 + ["x"] + ["a"] * 20000) == [(0, 9000, 1), (9001, 20000, 1)]
    many = [str(i % 5000) for i in range(17000)]
    assert periodic_runs.find_runs(many) == [(0, 17000, 5000)]


def test_runs_survive_a_failed_comparison(monkeypatch):
    """Where prefix sums call unlike words equal, the words decide."""
    monkeypatch.setattr(periodic_runs._Prefixes, "equal", lambda self, start, end, shift: np.ones(len(start), bool))
    words = ["q", "r", *"abc" * 12, "z", *map(str, range(40))]
    assert periodic_runs.find_runs(words) == all_runs(words)


def test_runs_of_odd_rows(spark, odd, empty):
    rows = periodic_runs.periodic_runs(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in ODD)
    by = {r["doc_id"]: r for r in rows}
    for i in (0, 1, 2, 3):
        assert by[i]["runs"] == [] and by[i]["n_words"] == int(i == 3) and by[i]["collapsed"] == ("x" if i == 3 else "")
    assert [tuple(x) for x in by[4]["runs"]] == [(0, 120, 3)] and by[4]["collapsed"] == "a b c"
    assert [tuple(x) for x in by[None]["runs"]] == [(0, 60, 2)] and by[None]["collapsed"] == "é ü"
    assert [tuple(x) for x in by[6]["runs"]] == [(0, 30000, 1)] and by[7]["n_words"] == 1
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_run_digests_equal_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    checked = 0
    for r in queries.op11_periodic_runs(spark, SF).collect():
        words = [w for w in (texts[r["doc_id"]] or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if len(words) > 700:
            continue
        checked += 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = all_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
        told = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        milli = 1000 * best[1] // best[2] if runs else None
        want = (len(runs), *best, milli, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == want
    assert checked > 500


def slow_counts(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = text.split("\n")
    again = sum(1 for i, x in enumerate(lines) if x.strip(" \t\v\f\r") and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_base_counts_equal_brute_force(spark, odd):
    sf = SF.replace("sf0.01", "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id <> 6").select((F.col("doc_id") - 100).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = compression_bands.judge(compression_bands.measure(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = slow_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == got
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and not (r["base_failed"] and r["kept"])


def test_bands_reject_repetition_and_noise(spark, odd, empty):
    rnd = random.Random(2)
    syllables = ["ka", "lo", "mer", "ti", "sun", "ver", "ol", "na", "stra", "pe", "gi", "dor"]

    def prose(n):
        vocabulary = ["".join(rnd.choice(syllables) for _ in range(rnd.choice([1, 2, 3, 4]))) for _ in range(1500)]
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    noise = lambda n: " ".join(base64.b64encode(rnd.randbytes(9)).decode() for _ in range(n))
    # each line differs in one word, so that no three words need come again
    filled = " ".join(f"buy{i} now{i} at{i} shop{i}" for i in range(400))
    texts = {1: prose(400), 2: noise(400), 3: filled, 4: prose(3000), 5: prose(1500) + noise(1500), 6: prose(4000) + " " + prose(60) * 2, 7: prose(80)}
    good = spark.createDataFrame([(100 + i, prose(int(60 * 1.5 ** rnd.uniform(0, 10)))) for i in range(600)], SCHEMA)
    docs = spark.createDataFrame(list(texts.items()), SCHEMA).unionByName(good)
    measures = compression_bands.measure(docs).cache()
    bands = compression_bands.fit(measures, good.select("doc_id"))
    assert len(bands.points) > len(compression_bands.FIXED) and bands.points == sorted(bands.points)
    kept = {r["doc_id"]: r["kept"] for r in compression_bands.judge(measures, bands).collect()}
    assert {i for i in texts if kept[i]} == {1, 4, 6, 7}
    assert sum(kept[i] for i in kept if i >= 100) >= 0.995 * 600
    fixed = {r["doc_id"]: r["kept"] for r in compression_bands.judge(measures).collect()}
    assert fixed[1] and fixed[4] and not fixed[2]
    rows = compression_bands.judge(compression_bands.measure(odd)).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows)
    assert compression_bands.judge(compression_bands.measure(empty)).count() == 0
    assert compression_bands.fit(compression_bands.measure(empty), good.select("doc_id")) == compression_bands.Bands()


def test_bands_keep_what_is_labelled_good(spark):
    rows = queries.op12_quality_bands(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.85 * len(bad)


def plain_negatives(rows, positives=5, negatives=10):
    """Rows (id, whole numbers, label) in the order of ties."""
    at = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))
    rows = [rows[i] for i in at]
    out = []
    for a, (anchor, x, label) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        score = [sum(p * q for p, q in zip(x, y)) for _, y, _ in rows]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][2] == label][:positives]:
            fits = [i for i in order if rows[i][2] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(anchor, rows[p][0], k + 1, rows[i][0], score[p], score[i]) for k, i in enumerate(fits[:negatives])]
    return sorted(out, key=str)


def mined(spark, rows):
    made = spark.createDataFrame([(i, [float(c) for c in x], label, "clash") for i, x, label in rows], "vec_id long, embedding array<double>, label int, node string")
    return sorted((tuple(r) for r in hard_negatives.mine(made, F.col("vec_id") % 100 == 0).collect()), key=str)


def test_negatives_equal_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 60)
    monkeypatch.setattr(hard_negatives, "BUCKET", 8)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * 60
    rows = [(i, np.floor(centres[i % 6] + rng.normal(size=5) * 20).astype(int).tolist(), int(rng.integers(0, 3))) for i in range(600)]
    # a third of all rows are one vector; its ties go by id
    rows += [(1000 + i, [40, -3, 17, 0, 9], i % 2) for i in range(300)]
    assert mined(spark, rows) == plain_negatives(rows) != []


def test_negatives_of_odd_rows(spark):
    big = 3_000_000_000
    rows = [(0, [5, 1], 1), (1, [4, 1], 1), (2, [3, 1], 2), (3, [4, 0], 2), (None, [3, 1], 2), (100, [-5, 2], 1), (100, [4, 2], 1), (5, [0, 0], 2), (6, [3, 1], 3), (200, [1, 1], 9)]
    odd = [(7, None, 1), (8, [], 1), (9, [1.0, None], 1), (10, [float("nan"), 1.0], 1), (11, [float("inf"), 1.0], 2), (12, [1.0, 1.0], None), (13, [1.0, 2.0, 3.0], 1), (14, [big * 10.0, 1.0], 2)]
    schema = "vec_id long, embedding array<double>, label int"
    made = spark.createDataFrame([(i, [float(c) for c in x], lab) for i, x, lab in rows], schema).unionByName(spark.createDataFrame(odd, schema))
    got = sorted((tuple(r) for r in hard_negatives.mine(made, F.col("vec_id") % 100 == 0).collect()), key=str)
    assert got == plain_negatives(rows) != []
    large = [(i, [2_000_000_000 // (i + 1), i - 40], i % 3) for i in range(100)]
    assert mined(spark, large) == plain_negatives(large) != []
    none = spark.createDataFrame([], schema)
    assert hard_negatives.mine(none, F.lit(True)).count() == 0
    assert hard_negatives.mine(made, F.lit(False)).count() == 0

"""Groups of near copies where buckets are large: the components of all pairs, for less work."""

import random

import pytest
from pyspark.sql import functions as F

from siftmill.operators import dedupe


def _families(sizes, words=60, edits=2, seed=3):
    """Families of texts, each a few words away from its first, or from the one before (chains)."""
    rng, rows = random.Random(seed), []
    for f, size in enumerate(sizes):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for k in range(size):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.choice((0, 1, words - 2, words - 1))] = f"x{rng.randrange(5000)}"
            if f % 2:
                base = text if k % 3 == 0 else base
            rows.append((f"{f:02d}-{k:04d}", " ".join(text)))
    rng.shuffle(rows)
    return rows


def _signed(spark, rows):
    return dedupe.with_signatures(spark.createDataFrame(rows, "id string, norm string")).select(F.col("id").alias("n"), "sh", "sig")


def _brute(signed, threshold=0.8, perms=32, count=8):
    rows = [(r["n"], set(r["sh"]), [tuple(r["sig"][i * 4 : i * 4 + 4]) for i in range(count)]) for r in signed.collect()]
    root = {n: n for n, _, _ in rows}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, (a, sa, ba) in enumerate(rows):
        for b, sb, bb in rows[:i]:
            if any(x == y for x, y in zip(ba, bb)) and len(sa & sb) / len(sa | sb) >= threshold:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {n: find(n) for n in root}


@pytest.mark.parametrize("small, leaders, block", [(3, 3, 1000), (3, 0, 5), (3, 1, 7)])
def test_groups_equal_those_of_all_pairs(spark, monkeypatch, small, leaders, block):
    monkeypatch.setattr(dedupe, "LEADERS", leaders)
    monkeypatch.setattr(dedupe, "BLOCK", block)
    rows = _families([40, 30, 12, 9, 1, 1, 2])
    want = _brute(_signed(spark, rows))
    got = dedupe.near_duplicate_groups(spark.createDataFrame(rows, "id string, norm string"), small=small).collect()
    assert {r["id"]: r["dup_group"] for r in got} == want
    assert len(set(want.values())) < len(want)


def test_a_large_family_is_not_compared_in_all_pairs(spark):
    rows = sorted({t: i for i, t in _families([900], edits=1)}.items())
    nodes, n = _signed(spark, [(i, t) for t, i in rows]), len(rows)
    every = dedupe.candidates(nodes, key="n").count()
    found = dedupe.links(nodes).count()
    assert every > 50 * n and n - 1 <= found < 20 * n


def test_texts_without_links_and_empty_tables(spark):
    rows = [(str(k), f"only {k}") for k in range(5)] + [("e1", ""), ("e2", "")]
    got = {r["id"]: r["dup_group"] for r in dedupe.near_duplicate_groups(spark.createDataFrame(rows, "id string, norm string"), small=1).collect()}
    assert got == {**{str(k): str(k) for k in range(5)}, "e1": "e1", "e2": "e1"}
    assert dedupe.near_duplicate_groups(spark.createDataFrame([], "id string, norm string")).count() == 0

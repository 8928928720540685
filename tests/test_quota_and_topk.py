"""Quota fills in hash order and the pruned top-k join against brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from siftmill.operators import sample, suggest, topk


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def test_sums_ahead_in_hash_order_of_one_stratum(spark):
    rnd = random.Random(1)
    rows = [("all", f"g{i}", rnd.randrange(1, 9)) for i in range(3000)] + [("few", f"h{i}", 2) for i in range(5)]
    df = spark.createDataFrame(rows, "stratum string, dup_group string, n long").cache()
    borders = {"all": (700.0, 5000.5), "few": (0.0, 3.0)}
    limit = [F.when(F.col("stratum") == "all", borders["all"][k]).otherwise(borders["few"][k]) for k in (0, 1)]
    got = sample.before_in_hash_order(df, ["stratum"], sample.hash_order(3, F.col("dup_group")), "n", limit, "dup_group", cell_rows=40).collect()
    assert len(got) == len(rows)
    ahead = {}
    for s in borders:
        run = 0
        for _, g, n in sorted((r for r in rows if r[0] == s), key=lambda r: (digest(3, r[1]), r[1])):
            ahead[g] = run
            run += n
    exact = 0
    for r in got:
        assert [r["before"] < b for b in borders[r["stratum"]]] == [ahead[r["dup_group"]] < b for b in borders[r["stratum"]]]
        exact += r["before"] == ahead[r["dup_group"]]
    assert exact > 10


def test_split_fills_quotas_exactly_in_one_stratum(spark, monkeypatch):
    monkeypatch.setattr(sample.before_in_hash_order, "__defaults__", (30,))
    rows = [(f"g{i}", 1 + i % 3, "a" if i % 9 else "held", None, "c", "") for i in range(900)]
    df = spark.createDataFrame(rows, "dup_group string, n long, source string, source_label double, source_category string, tags string")
    got = {r["dup_group"]: r["split"] for r in sample.split_groups(df, ["held"], {"val": 200, "test": 100, "ood": 50}).collect()}
    want = {}
    for held in (True, False):
        run = 0
        for r in sorted((r for r in rows if (r[2] == "held") == held), key=lambda r: digest(42, r[0])):
            want[r[0]] = ("test_ood_pool" if run < 50 else None) if held else "val_pool" if run < 200 else "test_pool" if run < 300 else "train"
            run += r[1]
    assert got == want
    folds = {r["dup_group"]: r["is_dev"] for r in sample.dev_fold(df.select("dup_group", "n", F.lit("x").alias("cls"))).collect()}
    run, total = 0, sum(r[1] for r in rows)
    for r in sorted(rows, key=lambda r: digest(0, r[0])):
        assert folds[r[0]] == (run < 0.15 * total)
        run += r[1]
    counted = [r for r in sample.dev_fold(df.select("dup_group", "n", F.lit("x").alias("cls")), by_rows=False).collect() if r["is_dev"]]
    assert len(counted) == 135


def test_stratified_sample_of_one_stratum(spark, monkeypatch):
    monkeypatch.setattr(sample.before_in_hash_order, "__defaults__", (25,))
    df = spark.createDataFrame([(f"i{k}", "one") for k in range(1000)], "id string, stratum string")
    got = {r["id"] for r in sample.stratified_sample(df, 37).collect()}
    assert got == set(sorted((f"i{k}" for k in range(1000)), key=lambda i: digest(1337, i))[:37])


def vectors(rnd, n, common):
    """Sparse unit vectors; ``common`` terms are in every one."""
    out = []
    for _ in range(n):
        terms = {f"all{k}" for k in range(common)} | {f"t{int(rnd.paretovariate(0.6)) % 400}" for _ in range(rnd.randrange(1, 12))}
        w = {t: rnd.random() ** 3 + 0.01 for t in terms}
        size = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / size for t, x in w.items()})
    return out


@pytest.mark.parametrize(("common", "k", "champions"), [(1, 7, 7), (0, 3, 3), (2, 1, 20)])
def test_top_k_join_equals_brute_force(spark, common, k, champions):
    rnd = random.Random(9)
    index, queries = vectors(rnd, 800, common), vectors(rnd, 60, common)
    queries[0] = {"unknown": 1.0}
    long = lambda rows: spark.createDataFrame([(i, t, w) for i, v in enumerate(rows) for t, w in v.items()], "id long, term string, w double")
    got = {}
    for r in topk.top_k_join(long(queries), long(index), k, champions=champions, rows=50).collect():
        got.setdefault(r["q"], {})[r["place"]] = (r["n"], r["sim"])
    for q, v in enumerate(queries):
        sims = [(-round(sum(w * x.get(t, 0.0) for t, w in v.items()), 9), n) for n, x in enumerate(index) if set(v) & set(x)]
        want = {p + 1: (n, -s) for p, (s, n) in enumerate(sorted(sims)[:k])}
        mine = got.get(q, {})
        assert {p: s for p, (_, s) in mine.items()} == pytest.approx({p: s for p, (_, s) in want.items()}, abs=2e-9)
        assert [n for p, (n, _) in sorted(mine.items())] == [n for p, (n, _) in sorted(want.items())]


def test_a_common_term_is_not_joined_with_all(spark):
    """Rows that share only the term of every row are not scored one by one."""
    rnd = random.Random(3)
    index = [{"all": 0.1, f"own{i}": 0.995} if i else {"all": 0.9, "own0": 0.43} for i in range(2000)]
    queries = [{"all": 0.1, f"own{rnd.randrange(1, 2000)}": 0.995} for _ in range(200)]
    long = lambda rows: spark.createDataFrame([(i, t, w) for i, v in enumerate(rows) for t, w in v.items()], "id long, term string, w double")
    assert topk.candidates(long(queries), long(index), 1).count() <= 3 * len(queries)


def test_suggestions_vote_over_ties_and_no_neighbours(spark):
    blank = spark.createDataFrame([("b1", None), ("b2", 1.0)], "id string, source_label double")
    labelled = spark.createDataFrame([("n1", "dangerous", "cat:ddos"), ("n2", "benign", "hn:detection"), ("n3", "dangerous", "cat:ddos")], "id string, gold string, tags string")
    near = spark.createDataFrame([("b1", "n1", 0.5, 1), ("b1", "n2", 0.5, 2), ("b1", "n3", 0.4, 3)], "q string, n string, sim double, place int")
    got = {r["id"]: r for r in suggest.suggest(blank, labelled, near).collect()}
    assert (got["b1"]["rec_gold"], got["b1"]["rec_alt"], got["b1"]["rec_tags"]) == ("dangerous", "benign", "cat:ddos")
    assert (got["b2"]["rec_gold"], got["b2"]["rec_alt"], got["b2"]["rec_tags"]) == ("dangerous", "ambiguous", "")

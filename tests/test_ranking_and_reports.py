"""Order statistics, running totals, ranking and reports of many models at once."""

import csv
import json
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftmill.operators import evaluation, metrics, ordered, report


def test_running_sums_of_one_hot_key(spark):
    rnd = random.Random(5)
    # one key has nine tenths of the rows
    rows = [(f"k{0 if rnd.random() < 0.9 else rnd.randrange(1, 6)}", i, rnd.randrange(9) if i % 10 else None) for i in range(4000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, 7), (None, 2, 8)], "key string, at int, n int")
    got = {(r["key"], r["at"]): r["total"] for r in ordered.running_sums(df, ["key"], [F.desc("at")], {"total": "n"}).collect()}
    want, run = {}, {}
    for key, at, n in sorted([*rows, (None, 1, 7), (None, 2, 8)], key=lambda r: -r[1]):
        run[key] = run.get(key, 0) + (n or 0)
        want[key, at] = run[key]
    assert got == want
    plan = ordered.running_sums(df, [], [F.col("at"), F.col("key")], {"total": "n"})
    assert sorted(r["total"] for r in plan.collect())[-1] == sum(n or 0 for _, _, n in rows) + 15


def test_order_statistics_of_all_keys_at_once(spark):
    rnd = random.Random(6)
    values = {k: [rnd.choice([0.5, rnd.random(), 5e-324, -1e300]) for _ in range(n)] for k, n in (("a", 700), ("b", 1), ("c", 30))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None)], "key string, v double")
    counts = ordered.counted(df, ["key"], F.col("v"))
    ranks = spark.createDataFrame([(k, str(j), j) for k in values for j in (1, 2, 17, 350, 700)], "key string, name string, k long")
    got = {(r["key"], r["k"]): r["v"] for r in ordered.order_statistics(counts, ["key"], ranks).collect()}
    assert got == {(k, j): sorted(vs)[j - 1] for k, vs in values.items() for j in (1, 2, 17, 350, 700) if j <= len(vs)}
    shares = ordered.percentiles(df, ["key"], F.col("v"), {"p50": 0.5, "p99": 0.99}).collect()
    assert {r["key"]: r["n"] for r in shares} == {k: len(vs) for k, vs in values.items()}
    assert next(r["p50"] for r in shares if r["key"] == "b") == values["b"][0]
    with pytest.raises(PySparkException, match="NaN"):
        ordered.order_statistics(ordered.counted(spark.createDataFrame([("a", float("nan"))], "key string, v double"), ["key"], F.col("v")), ["key"], ranks).collect()


def test_ranking_by_key_equals_brute_force(spark):
    rnd = random.Random(7)
    rows = [(m, str(i), rnd.choice(["dangerous", "benign", "benign"]), round(rnd.random(), 2)) for m in ("x", "y") for i in range(500)]
    rows += [("only", str(i), "benign", 0.5) for i in range(5)]
    df = spark.createDataFrame(rows, "model string, id string, gold string, p_safe double")
    for r in metrics.ranking_by(df, ["model"]).collect():
        mine = [(g == "dangerous", 1 - p) for m, _, g, p in rows if m == r["model"]]
        pos, neg = [s for y, s in mine if y], [s for y, s in mine if not y]
        assert (r["n_pos"], r["n_neg"]) == (len(pos), len(neg))
        if not pos:
            assert r["roc_auc"] is None and r["average_precision"] is None
            continue
        wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert r["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))
        at = [sum(y for y, s in mine if s >= a) / sum(1 for _, s in mine if s >= a) for a in pos]
        assert r["average_precision"] == pytest.approx(sum(at) / len(pos))


@pytest.fixture(scope="module")
def preds(spark):
    rnd = random.Random(8)
    rows = []
    for model in ("keyword", "net"):
        for split, n in (("val", 60), ("test", 80)):
            for i in range(n):
                gold = rnd.choice(["dangerous", "benign", "benign", "ambiguous"])
                p = round(rnd.random(), 3)
                tags = {"dangerous": "cat:ddos;evasion:fiction" if i % 2 else "cat:ddos", "benign": "hard_negative;hn:detection" if i % 3 == 0 else ""}.get(gold, "")
                rows.append((model, split, f"{split}{i}", gold, "s", tags, p, round(1 - p, 3), i % 11 == 0, float(i)))
    return spark.createDataFrame(rows, "model string, split string, id string, gold string, source string, tags string, p_safe double, p_dangerous double, force_escalate boolean, latency_ms double")


def test_thresholds_of_all_models(spark, preds):
    got = {r["model"]: (r["threshold"], r["threshold_from"]) for r in evaluation.thresholds_of(preds).collect()}
    for model in ("keyword", "net"):
        one = metrics.select_threshold(preds.where((F.col("model") == model) & (F.col("split") == "val"))).first()
        assert got[model] == (math.nextafter(one["p_cut"], math.inf), "val")
    none = evaluation.thresholds_of(preds.where("split = 'test'")).collect()
    assert {r["threshold_from"] for r in none} == {"default"} and {r["threshold_from"] for r in evaluation.thresholds_of(preds, 0.3).collect()} == {"manual"}


def test_report_rows_equal_the_single_metrics(spark, preds):
    t = spark.createDataFrame([("keyword", 0.6), ("net", 0.4)], "model string, threshold double")
    rows = report.report_rows(preds, t).collect()
    by = {(r["model"], r["split"], r["section"], r["item"], r["metric"]): r for r in rows}
    assert len(by) == len(rows)
    mine = preds.where("model = 'net' and split = 'test'").cache()
    for r in metrics.rates_at(mine, 0.4).collect():
        got = by["net", "test", "at_threshold" if r["routed"] else "model_at_threshold", r["metric"], ""]
        assert (got["k"], got["n"], got["value"], got["ci_lo"]) == (r["k"], r["n"], r["rate"], r["ci_lo"])
    for r in metrics.sliced_rates(mine, 0.4).collect():
        assert by["net", "test", "slices", f"{r['slice_type']}/{r['slice']}", r["metric"]]["k"] == r["k"]
    rank, cal, cost, lat = metrics.ranking(mine).first(), metrics.ece_brier(mine).first(), metrics.economics(mine, 0.4).first(), metrics.latency(mine).first()
    assert by["net", "test", "ranking", "roc_auc", ""]["value"] == pytest.approx(rank["roc_auc"])
    assert by["net", "test", "calibration", "ece", ""]["value"] == pytest.approx(cal["ece"]) and by["net", "test", "calibration", "brier", ""]["value"] == pytest.approx(cal["brier"])
    assert by["net", "test", "economics", "cost", ""]["value"] == pytest.approx(cost["cost"])
    assert by["net", "test", "latency_ms", "p95", ""]["value"] == pytest.approx(lat["p95"])
    assert by["net", "test", "routing", "new_escalations", ""]["k"] == metrics.routing(mine, 0.4).first()["policy_only"]


def test_runner_writes_reports_and_removes_stale_ones(spark, preds, tmp_path):
    (tmp_path / "gone_test").mkdir()
    (tmp_path / "gone_test" / "metrics.json").write_text("{}")
    (tmp_path / "notes_test").mkdir()
    flags = spark.createDataFrame([("test3", True), ("test4", False)], "id string, precheck_flag boolean")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    made = evaluation.run(spark, preds, f"file://{tmp_path}", flags=flags)
    one_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before
    names = {r["model"] for r in made.collect()}
    assert names == {"keyword", "keyword_pc", "net", "net_pc"}
    folders = {p.name for p in tmp_path.iterdir() if p.is_dir()}
    assert folders == {f"{m}_{s}" for m in names for s in ("val", "test")} | {"notes_test"}
    at = tmp_path / "net_pc_test"
    figures = json.loads((at / "metrics.json").read_text())
    assert figures["threshold_from"] == "val" and {r["item"]: r["k"] for r in figures["routing"]}["policy_flags"] == 1
    assert len(list(csv.DictReader((at / "threshold_sweep.csv").open()))) == 201
    told = (at / "report.md").read_text()
    for title in ("Threshold", "Routed rates", "Base rates", "Policy", "Ranking", "Cost of a second tier", "Calibration", "Latency (ms)", "Slices", "Worst: missed dangerous"):
        assert f"## {title}" in told
    more = preds.unionByName(preds.withColumn("model", F.concat("model", F.lit("_two")))).unionByName(preds.withColumn("model", F.concat("model", F.lit("_three"))))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    evaluation.run(spark, more, f"file://{tmp_path}", flags=flags)
    # adaptive plans may differ by a few jobs, but not by some for each model
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before <= one_run + 8


def test_evasion_split_is_made_once(spark):
    rows = spark.createDataFrame([("a", "some text of it", "", "dangerous", "test"), ("b", "other text", "", "benign", "test"), ("c", "third", "", "dangerous", "val")], "id string, text string, tags string, gold string, split string")
    made = evaluation.with_evasion_split(rows)
    assert made.where("split = 'test_evasion'").count() == 8 and made.where("split = 'test_evasion' and tags not like 'evasion:%'").isEmpty()
    assert evaluation.with_evasion_split(made).count() == made.count()

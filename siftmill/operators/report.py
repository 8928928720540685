"""Reports of every (model, split): counts, rates, slices, ranking, calibration, cost and
worst errors, and the JSON, Markdown and CSV files made of them.

A prediction is turned into the cells that it counts in (a section, an item, a metric),
and one aggregate, combined before its exchange, counts all cells of all models and
splits. Only ranks need the order of the scores, which ``ordered`` takes in ranges.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.lineage import cut
from siftmill.operators.metrics import TRAFFIC, bin_of, by_score, cascade, escalated, latency, masks, operating_points_by, ranked, slice_array, slice_metric, threshold_sweep, with_interval, worst_errors
from siftmill.sources.files import children, delete, write_json, write_text

KEYS = ["model", "split"]
#: Points of the ranking section.
RECALLS, BENIGN_RATES = [0.9, 0.95, 0.99], [0.01, 0.05, 0.1]
COLUMNS = [*KEYS, "section", "item", "metric", "k", "n", "value", "ci_lo", "ci_hi"]


def _cell(section: str, item: Column | str, hit: Column, metric: Column | None = None) -> Column:
    item = F.lit(item) if isinstance(item, str) else item
    metric = F.lit("") if metric is None else metric
    return F.struct(F.lit(section).alias("section"), item.alias("item"), metric.alias("metric"), F.coalesce(hit, F.lit(False)).cast("long").alias("hit"))


def cells(t: Column) -> Column:
    """All cells that a prediction counts in at threshold ``t``."""
    routed, base, forced = escalated(t), escalated(t, False), F.coalesce(F.col("force_escalate"), F.lit(False))
    gold = F.col("gold")
    each = [_cell("counts", gold, F.lit(True))]
    for name, mask in masks().items():
        each += [F.when(mask, _cell("at_threshold", name, routed)), F.when(mask, _cell("model_at_threshold", name, base))]
    each += [_cell("routing", name, hit) for name, hit in (("policy_flags", forced), ("already_escalated", forced & base), ("new_escalations", forced & ~base))]
    each.append(F.when(gold.isin("dangerous", "benign"), _cell("calibration", bin_of(F.col("p_dangerous")).cast("string"), gold == "dangerous")))
    sliced = F.transform(slice_array(), lambda s: _cell("slices", F.concat_ws("/", s.slice_type, s.slice), routed, slice_metric()))
    return F.concat(F.array_compact(F.array(*each)), sliced)


def _stacked(rows: DataFrame, section: str, names: Sequence[str]) -> DataFrame:
    """Columns of one row per key as rows (item, value)."""
    each = [F.struct(F.lit(n).alias("item"), F.col(f"`{n}`").cast("double").alias("value")) for n in names]
    return rows.select(*KEYS, F.explode(F.array(*each)).alias("c")).select(*KEYS, F.lit(section).alias("section"), "c.item", "c.value")


def report_rows(preds: DataFrame, thresholds: DataFrame, traffic: dict | None = None) -> DataFrame:
    """The figures of every report as rows of ``COLUMNS``. ``preds`` has model, split and the
    columns of predictions (latency_ms too, if measured); ``thresholds`` model, threshold."""
    timed = ["latency_ms"] if "latency_ms" in preds.columns else []
    names = [*KEYS, "id", "gold", "source", "tags", "p_safe", "p_dangerous", "force_escalate", *timed]
    rows = cut(preds.select(names).join(F.broadcast(thresholds.select("model", "threshold")), "model"))
    p, y = F.col("p_dangerous"), (F.col("gold") == "dangerous").cast("int")
    counts = rows.select(*KEYS, p, y.alias("y"), F.explode(cells(F.col("threshold"))).alias("c")).groupBy(*KEYS, "c.section", "c.item", "c.metric")
    counts = cut(counts.agg(F.sum("c.hit").alias("k"), F.count("*").alias("n"), F.sum(p).alias("p"), F.sum((p - F.col("y")) * (p - F.col("y"))).alias("e")))
    out = with_interval(counts.where("section not in ('counts', 'calibration')")).withColumnRenamed("rate", "value").select(COLUMNS)
    bins = counts.where("section = 'calibration'")
    parts = [counts.where("section = 'counts'").select(*COLUMNS[:7]), bins.withColumn("value", F.col("p") / F.col("n")).select(*COLUMNS[:8])]
    whole = bins.groupBy(*KEYS).agg((F.sum(F.abs(F.col("p") - F.col("k"))) / F.sum("n")).alias("ece"), (F.sum("e") / F.sum("n")).alias("brier"))
    parts.append(_stacked(whole, "calibration", ["ece", "brier"]))
    scores = cut(by_score(rows, KEYS))
    parts.append(_stacked(ranked(scores, KEYS), "ranking", ["roc_auc", "average_precision"]))
    points = operating_points_by(scores, KEYS, RECALLS, BENIGN_RATES)
    parts.append(_stacked(points, "ranking", [c for c in points.columns if c not in KEYS]))
    rates = counts.where("section = 'at_threshold'").groupBy(*KEYS).agg(*[F.max(F.when(F.col("item") == m, F.col("k") / F.col("n"))).alias(m) for m in masks()])
    cost = cascade(rates, traffic, KEYS)
    parts.append(_stacked(cost, "economics", [c for c in cost.columns if c not in KEYS]))
    if timed:
        parts.append(_stacked(latency(rows, by=KEYS), "latency_ms", ["n", "mean", "p50", "p95", "p99"]))
    for part in parts:
        out = out.unionByName(part.withColumn("metric", F.lit("")) if "metric" not in part.columns else part, allowMissingColumns=True)
    return out.select(COLUMNS)


def markdown(table: DataFrame) -> str:
    """A small table as Markdown."""
    return _table(table.columns, [list(r) for r in table.collect()])


def _table(head: Sequence[str], rows: Sequence[Sequence]) -> str:
    def line(cells: Sequence) -> str:
        return "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"

    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)]) + "\n"


def _percent(x: float | None) -> str:
    return "n/a" if x is None or x != x else f"{100 * x:.2f}%"


def _told(r: dict) -> str:
    return f"{_percent(r['value'])} [{_percent(r['ci_lo'])}, {_percent(r['ci_hi'])}] ({r['k']}/{r['n']})"


def as_markdown(model: str, split: str, threshold: tuple[float, str], rows: list[dict], errors: list[dict], traffic: dict | None = None) -> str:
    """One report as text."""
    by: dict[str, list[dict]] = defaultdict(list)
    for r in rows:
        by[r["section"]].append(r)
    order = list(masks())
    say = lambda name: name.replace("_", " ")
    t, origin = threshold
    out = [f"# {model} on {split}", "Rows: " + ", ".join(f"{r['item']} {r['k']}" for r in by["counts"]) + ".", "## Threshold"]
    out.append(f"A row escalates below t = {t:.6g} ({origin}), or by policy. Ranking and calibration use base scores alone.")
    for section, title in (("at_threshold", "Routed rates"), ("model_at_threshold", "Base rates"), ("routing", "Policy")):
        found = sorted(by[section], key=lambda r: (order.index(r["item"]) if r["item"] in order else 0, r["item"]))
        out += [f"## {title}", _table(["Rate", "Value, 95 % interval (k/n)"], [(say(r["item"]), _told(r)) for r in found])]
    out += ["## Ranking", _table(["Figure", "Value"], [(say(r["item"]), "n/a" if r["value"] is None else f"{r['value']:.4f}") for r in by["ranking"]])]
    tr = TRAFFIC | (traffic or {})
    out += ["## Cost of a second tier", f"Of {tr['n']:,} prompts {tr['dangerous']:.2%} dangerous and {tr['ambiguous']:.2%} ambiguous, {tr['price']} a call."]
    out.append(_table(["Figure", "Value"], [(say(r["item"]), "n/a" if r["value"] is None else f"{r['value']:,.4g}") for r in by["economics"]]))
    bins = sorted((r for r in by["calibration"] if r["k"] is not None), key=lambda r: int(r["item"]))
    out += ["## Calibration", ", ".join(f"{r['item']} {r['value']:.4f}" for r in by["calibration"] if r["k"] is None and r["value"] is not None) or "n/a"]
    out.append(_table(["Bin", "n", "mean p", "share dangerous"], [(r["item"], r["n"], f"{r['value']:.4f}", f"{r['k'] / r['n']:.4f}") for r in bins]))
    if by["latency_ms"]:
        out += ["## Latency (ms)", ", ".join(f"{r['item']} {r['value']:.2f}" for r in by["latency_ms"])]
    out += ["## Slices", _table(["Slice", "Metric", "Value, 95 % interval (k/n)"], [(r["item"], r["metric"], _told(r)) for r in sorted(by["slices"], key=lambda r: (r["item"], r["metric"]))])]
    for kind in ("missed_dangerous", "escalated_hard_negative"):
        found = [(e["id"], f"{e['p_safe']:.4f}") for e in errors if e["kind"] == kind]
        out += [f"## Worst: {say(kind)}", _table(["id", "p_safe"], found) if found else "None."]
    return "\n\n".join(out) + "\n"


def _csv(head: Sequence[str], rows: Sequence[Sequence]) -> str:
    def cell(x) -> str:
        text = "" if x is None else str(x)
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text

    return "\n".join([",".join(head), *[",".join(map(cell, r)) for r in rows]]) + "\n"


def write_reports(spark: SparkSession, preds: DataFrame, thresholds: DataFrame, folder: str, splits: Sequence[str], traffic: dict | None = None) -> None:
    """Per (model, split) a folder ``model_split`` with metrics.json, report.md, slices.csv,
    threshold_sweep.csv and errors.csv; such folders of other models or splits are
    removed. The driver gathers the rows of the reports, a few hundred for each."""
    t = {r["model"]: (r["threshold"], r["threshold_from"]) for r in thresholds.collect()}
    figures, errors, sweep = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in report_rows(preds, thresholds, traffic).orderBy(*COLUMNS[:5]).collect():
        figures[r["model"], r["split"]].append(r.asDict())
    joined = preds.join(F.broadcast(thresholds.select("model", "threshold")), "model")
    for r in worst_errors(joined, F.col("threshold"), keys=KEYS).orderBy("kind", F.when(F.col("kind") == "missed_dangerous", -F.col("p_safe")).otherwise(F.col("p_safe")), "id").collect():
        errors[r["model"], r["split"]].append(r.asDict())
    swept = threshold_sweep(preds, keys=KEYS).orderBy("i")
    for r in swept.collect():
        sweep[r["model"], r["split"]].append(r.asDict())
    for (model, split), rows in figures.items():
        at = f"{folder}/{model}_{split}"
        sections: dict = defaultdict(list)
        for r in rows:
            sections[r["section"]].append({c: r[c] for c in COLUMNS[3:] if r[c] not in (None, "")})
        write_json(spark, f"{at}/metrics.json", {"model": model, "split": split, "threshold": t[model][0], "threshold_from": t[model][1], **sections, "errors": errors[model, split]})
        write_text(spark, f"{at}/report.md", as_markdown(model, split, t[model], rows, errors[model, split], traffic))
        write_text(spark, f"{at}/slices.csv", _csv(COLUMNS[3:], [[r[c] for c in COLUMNS[3:]] for r in rows if r["section"] == "slices"]))
        names = [c for c in swept.columns if c not in KEYS]
        write_text(spark, f"{at}/threshold_sweep.csv", _csv(names, [[r[c] for c in names] for r in sweep[model, split]]))
        write_text(spark, f"{at}/errors.csv", _csv(["kind", "id", "p_safe"], [[e["kind"], e["id"], e["p_safe"]] for e in errors[model, split]]))
    now = {f"{m}_{s}" for m, s in figures}
    for name in children(spark, folder):
        if name not in now and any(name.endswith(f"_{s}") for s in splits) and "metrics.json" in children(spark, f"{folder}/{name}"):
            delete(spark, f"{folder}/{name}")

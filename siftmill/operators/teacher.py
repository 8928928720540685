"""Teacher score tables: contracts, reconciliation, soft targets, predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.functions.scoring import nan_mean, soft_target, source_only_target, teacher_blend
from siftmill.operators.ordered import percentiles
from siftmill.schema import ContractError, require

REQUIRED = ["id", "p_unsafe_teacher", "teacher_model"]
SCORES = "id string, p_unsafe_teacher double, p_controversial double, teacher_category string, teacher_raw string, teacher_model string"


def score_problems(df: DataFrame) -> DataFrame:
    p, c = F.col("p_unsafe_teacher"), F.col("p_controversial") if "p_controversial" in df.columns else F.lit(None).cast("double")
    blank = F.coalesce(F.trim("id"), F.lit("")) == ""
    return df.agg(
        F.count_if(blank).alias("blank_id"),
        (F.count("*") - F.count_distinct("id") - F.count_if(F.col("id").isNull())).alias("duplicate_id"),
        F.greatest(F.count_distinct("teacher_model") - 1, F.lit(0)).alias("extra_models"),
        F.count_if(F.coalesce(F.trim("teacher_model"), F.lit("")) == "").alias("blank_model"),
        F.count_if(~F.coalesce(p.between(0, 1) & ~F.isnan(p), F.lit(False))).alias("bad_probability"),
        F.count_if(c.isNotNull() & ~F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(False))).alias("bad_controversial"),
    )


def validate_scores(df: DataFrame) -> DataFrame:
    require(df, REQUIRED, "teacher scores")
    bad = {k: v for k, v in score_problems(df).first().asDict().items() if v}
    if bad:
        raise ContractError(f"teacher scores: {bad}")
    return df


def check_inputs(df: DataFrame) -> DataFrame:
    """One row per id; blank ids or texts and ids with several texts are errors."""
    empty = (F.coalesce(F.trim("id"), F.lit("")) == "") | (F.coalesce(F.trim("text"), F.lit("")) == "")
    if df.where(empty).limit(1).count():
        raise ContractError("teacher inputs: blank id or text")
    if df.groupBy("id").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").limit(1).count():
        raise ContractError("teacher inputs: an id has several texts")
    return df.dropDuplicates(["id"])


def reconcile(parts: list[DataFrame], fields: list[str]) -> DataFrame:
    """Per id, the one non-null value of each field over all parts, with the number of fields in conflict."""
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    conflict = sum((F.coalesce(F.min(f) != F.max(f), F.lit(False)).cast("int") for f in fields[1:]), F.coalesce(F.min(fields[0]) != F.max(fields[0]), F.lit(False)).cast("int"))
    return rows.groupBy("id").agg(*[F.min(f).alias(f) for f in fields], conflict.alias("conflicts"))


def merge_scores(parts: list[DataFrame], fields: list[str] | None = None) -> DataFrame:
    merged = reconcile(parts, fields or ["p_unsafe_teacher", "p_controversial", "teacher_category", "teacher_raw", "teacher_model"])
    if merged.where("conflicts > 0").limit(1).count():
        raise ContractError("teacher scores: files disagree on an id")
    return merged.drop("conflicts")


def _pair(a: DataFrame, b: DataFrame) -> DataFrame:
    def named(df: DataFrame, k: int) -> DataFrame:
        c = F.col("p_controversial") if "p_controversial" in df.columns else F.lit(None).cast("double")
        return df.select("id", F.col("p_unsafe_teacher").alias(f"p{k}"), c.alias(f"c{k}"))

    return named(a, 1).join(named(b, 2), "id")


def soft_targets(pool: DataFrame, scores: list[DataFrame]) -> DataFrame:
    """Targets of one or two teachers joined to the pool's labels."""
    y = pool.select("id", F.col("source_label").alias("y"))
    if len(scores) == 1:
        one = scores[0]
        c = F.col("p_controversial") if "p_controversial" in one.columns else None
        rows, p, dis = y.join(one, "id"), F.col("p_unsafe_teacher"), None
    else:
        rows = y.join(_pair(*scores), "id")
        p, dis, c = (F.col("p1") + F.col("p2")) / F.lit(2.0), F.abs(F.col("p1") - F.col("p2")), nan_mean(F.col("c1"), F.col("c2"))
    t = soft_target(p, F.col("y"), dis, c)
    return rows.select("id", p.alias("p"), "y", *[v.alias(k) for k, v in t.items()], F.lit(len(scores)).alias("n_teachers"), (dis if dis is not None else F.lit(None).cast("double")).alias("teacher_disagreement"), F.lit("teacher").alias("target_source"))


def source_only_targets(pool: DataFrame) -> DataFrame:
    t = source_only_target(F.col("source_label"))
    return pool.select("id", F.col("source_label").alias("y"), *[v.alias(k) for k, v in t.items()], F.lit(0).alias("n_teachers"), F.lit("source_only").alias("target_source"))


def as_predictions(rows: DataFrame, scores: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Predictions of eval rows from teacher scores, and the eval rows without a score."""
    if len(scores) == 1:
        s = scores[0]
        c = F.col("p_controversial") if "p_controversial" in s.columns else None
        p = teacher_blend(F.col("p_unsafe_teacher"), None, c)
    else:
        s = _pair(*scores)
        p = teacher_blend(F.col("p1"), F.col("p2"), nan_mean(F.col("c1"), F.col("c2")))
    probs = s.select("id", *[x.alias(n) for x, n in zip(p, ("p_safe", "p_dangerous", "p_unsure"))])
    return rows.join(probs, "id"), rows.join(probs.select("id"), "id", "left_anti")


def teacher_summary(df: DataFrame) -> DataFrame:
    """n, mean and median of the teacher's score by source and label, the NULL label included."""
    got = percentiles(df, ["source", "source_label"], F.col("p_unsafe_teacher"), {"median_p": 0.5})
    return got.select("source", "source_label", "n", F.round("mean", 3).alias("mean_p"), F.round("median_p", 3).alias("median_p"))


def score_batches(df: DataFrame, score: Callable[[list[str]], list[dict]], model: str, batch: int = 8) -> DataFrame:
    """Run a scorer over (id, text) in batches with its contract checked on every batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                got = score(part["text"].tolist())
                if len(got) != len(part):
                    raise ContractError(f"the scorer gave {len(got)} results for {len(part)} texts")
                for g in got:
                    if not 0 <= g["p_unsafe_teacher"] <= 1:
                        raise ContractError(f"the scorer gave probability {g['p_unsafe_teacher']}")
                cols = ("p_unsafe_teacher", "p_controversial", "teacher_category", "teacher_raw")
                yield pd.DataFrame({"id": part["id"].tolist(), **{c: [g.get(c) for g in got] for c in cols}, "teacher_model": model})

    return df.select("id", "text").mapInPandas(run, SCORES)


def remaining(inputs: DataFrame, done: DataFrame) -> DataFrame:
    return inputs.join(done.select("id").distinct(), "id", "left_anti")

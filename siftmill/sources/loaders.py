"""Loaders of the raw sources into the pool contract."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.text import first_human_turn, make_id, normalize
from siftmill.operators.dedupe import keep_first
from siftmill.schema import POOL, require
from siftmill.sources.files import read_all, read_any


def split_of(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(None).cast("string")
    for name in ("test", "val", "validation", "train"):
        out = F.when(F.contains(low, F.lit(name)), name).otherwise(out)
    return out


def below(path: Column, root: str) -> Column:
    """The part of a path below its source's folder, so that folder names above do not count."""
    return F.substring_index(path, root.rstrip("/").rpartition("/")[2] + "/", -1)


def finalize(rows: DataFrame, source: str) -> DataFrame:
    """Trim and drop empty texts, fill optional columns, coerce types, keep the first
    row of each text and of each id."""
    cols = {f.name: f.dataType for f in POOL.fields}
    out = rows.withColumn("text", F.trim("text")).where(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("source", F.lit(source))
    for name, kind in cols.items():
        if name not in out.columns and name != "id":
            out = out.withColumn(name, F.lit(None).cast(kind))
    label = F.nanvl(F.col("source_label").try_cast("double"), F.lit(None))
    out = out.withColumns({"source_label": label, "is_adversarial": F.col("is_adversarial").try_cast("boolean"), "tags": F.coalesce(F.col("tags").cast("string"), F.lit(""))})
    out = out.withColumn("id", make_id(F.col("source"), normalize(F.col("text"))))
    order = ["_file", "text"] if "_file" in out.columns else ["text"]
    out = keep_first(out, ["text"], [*order, "source_label"])
    return keep_first(out, ["id"], order).select(*[F.col(c).cast(t) for c, t in cols.items()])


def _yes_no(c: Column, yes: str, no: str) -> Column:
    return F.when(F.lower(F.trim(c)) == yes, 1.0).when(F.lower(F.trim(c)) == no, 0.0)


def toxic_chat(spark: SparkSession, folder: str) -> DataFrame:
    df = read_all(spark, folder)
    require(df, ["user_input", "toxicity"], "toxic_chat")
    newer = df.where(F.contains("_file", F.lit("0124"))).limit(1).count() > 0
    if newer:
        df = df.where(~F.contains("_file", F.lit("1123")))
    adversarial = F.col("jailbreaking").try_cast("int").cast("boolean") if "jailbreaking" in df.columns else F.lit(None).cast("boolean")
    return finalize(df.select(F.col("user_input").alias("text"), F.col("toxicity").alias("source_label"), adversarial.alias("is_adversarial"), split_of(below(F.col("_file"), folder)).alias("origin_split"), "_file"), "toxic_chat")


def wildguardmix(spark: SparkSession, folder: str) -> DataFrame:
    df = read_all(spark, folder)
    require(df, ["prompt", "prompt_harm_label"], "wildguardmix")
    return finalize(
        df.select(F.col("prompt").alias("text"), _yes_no(F.col("prompt_harm_label"), "harmful", "unharmful").alias("source_label"), _or_null(df, "subcategory").alias("source_category"), _or_null(df, "adversarial").alias("is_adversarial"), split_of(below(F.col("_file"), folder)).alias("origin_split"), "_file"),
        "wildguardmix",
    )


def _or_null(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def flagged(df: DataFrame, category: str = "category") -> Column:
    """Names flagged true in a map, struct or JSON-like text."""
    kind = dict(df.dtypes)[category]
    c = F.col(category)
    if kind.startswith("struct"):
        names = df.schema[category].dataType.fieldNames()
        c = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"{category}.`{n}`") for n in names]))
    elif kind == "string":
        c = F.from_json(F.replace(F.replace(F.replace(c, F.lit("'"), F.lit('"')), F.lit("True"), F.lit("true")), F.lit("False"), F.lit("false")), "map<string,boolean>")
    return F.coalesce(F.map_keys(F.map_filter(c, lambda k, v: F.coalesce(v, F.lit(False)))), F.array().cast("array<string>"))


def category_rollup(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: unsafe if any row is, all flagged names, the first split.
    ``rows``: key, is_safe, names (array), split. Names are exploded and counted
    before they meet, so a key's rows are never gathered."""
    sides = rows.groupBy(key).agg(F.max((~F.col("is_safe")).cast("int")).cast("double").alias("source_label"), F.min("split").alias("origin_split"))
    names = rows.select(key, F.explode("names").alias("name")).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("source_category"))
    return sides.join(names, key, "left").withColumn("source_category", F.coalesce("source_category", F.lit("")))


def beavertails(spark: SparkSession, folder: str) -> DataFrame:
    df = read_all(spark, folder)
    require(df, ["prompt", "is_safe", "category"], "beavertails")
    rows = df.select(F.col("prompt").alias("text"), F.col("is_safe").cast("boolean").alias("is_safe"), flagged(df).alias("names"), split_of(below(F.col("_file"), folder)).alias("split"))
    return finalize(category_rollup(rows, "text"), "beavertails")


def aegis2(spark: SparkSession, folder: str) -> DataFrame:
    df = read_all(spark, folder)
    require(df, ["prompt", "prompt_label"], "aegis2")
    df = df.where(F.upper(F.trim("prompt")) != "REDACTED")
    return finalize(df.select(F.col("prompt").alias("text"), _yes_no(F.col("prompt_label"), "unsafe", "safe").alias("source_label"), _or_null(df, "violated_categories").alias("source_category"), split_of(below(F.col("_file"), folder)).alias("origin_split"), "_file"), "aegis2")


def hh_redteam(spark: SparkSession, folder: str) -> DataFrame:
    df = read_all(spark, folder)
    require(df, ["transcript"], "hh_redteam")
    return finalize(df.select(first_human_turn(F.col("transcript")).alias("text"), F.lit(True).alias("is_adversarial"), split_of(below(F.col("_file"), folder)).alias("origin_split"), "_file"), "hh_redteam")


def xstest(spark: SparkSession, folder: str) -> DataFrame:
    df = read_all(spark, folder)
    require(df, ["prompt", "label"], "xstest")
    return finalize(df.select(F.col("prompt").alias("text"), _yes_no(F.col("label"), "unsafe", "safe").alias("source_label"), _or_null(df, "type").alias("source_category"), "_file"), "xstest")


def or_bench(spark: SparkSession, folder: str) -> DataFrame:
    df = read_all(spark, folder)
    require(df, ["prompt"], "or_bench")
    label = F.contains(F.lower(below(F.col("_file"), folder)), F.lit("toxic")).cast("double")
    return finalize(df.select(F.col("prompt").alias("text"), label.alias("source_label"), _or_null(df, "category").alias("source_category"), "_file"), "or_bench")


def hn_seed(spark: SparkSession, path: str) -> DataFrame:
    df = read_any(spark, path)
    require(df, ["text", "tags"], "hn_seed")
    return finalize(df.select("text", F.lit(0.0).alias("source_label"), "tags"), "hn_seed")


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "toxic_chat": toxic_chat, "wildguardmix": wildguardmix, "beavertails": beavertails, "aegis2": aegis2, "hh_redteam": hh_redteam, "xstest": xstest, "or_bench": or_bench, "hn_seed": hn_seed,
}


def build_pool(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """All sources that can be read, one row per id; others are warned of and skipped."""
    out = None
    for name, folder in folders.items():
        try:
            part = LOADERS[name](spark, folder)
        except (FileNotFoundError, ValueError) as bad:
            warnings.warn(f"{name} skipped: {bad}", stacklevel=2)
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError("no source could be read")
    return keep_first(out, ["id"], ["source", "text"])

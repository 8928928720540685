"""Scoring that goes on after a failure, and appends with backup and new columns."""

import hashlib
import json
import os
from xml.etree import ElementTree

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftmill.sources import files
from siftmill.streaming import scorer


def test_a_killed_run_goes_on_without_repeats_or_holes(spark, tmp_path):
    path, poison = str(tmp_path / "scores"), str(tmp_path / "poison")
    df = spark.createDataFrame([(f"i{k}", f"text {k}") for k in range(60)], "id string, text string").repartition(3)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    def score(texts):
        if "text 41" in texts and os.path.exists(poison):
            raise RuntimeError("killed")
        return [{"p_unsafe_teacher": len(t) / 100} for t in texts]

    open(poison, "w").close()
    with pytest.raises(PySparkException):
        scorer.run_scorer(df, path, score, "m", batch=4, rows_per_flush=7)
    kept = [r["id"] for r in spark.read.parquet(path).collect()] if os.path.isdir(path) else []
    assert len(kept) == len(set(kept)) < 60 and "i41" not in kept
    os.remove(poison)
    assert scorer.run_scorer(df.withColumn("text", seen("text")), path, score, "m", batch=4, rows_per_flush=7) == 60 - len(kept)
    assert read.value == 60
    got = {r["id"]: r["p_unsafe_teacher"] for r in spark.read.parquet(path).collect()}
    assert got == {f"i{k}": len(f"text {k}") / 100 for k in range(60)} and spark.read.parquet(path).count() == 60
    assert scorer.run_scorer(df, path, score, "m") == 0 and not os.path.exists(f"{path}.work")


def test_append_keeps_one_backup_and_fills_columns(spark, tmp_path):
    path = str(tmp_path / "test")
    spark.createDataFrame([("a", "x", "kw")], "id string, text string, kw_hits string").write.parquet(path)
    new = spark.createDataFrame([("a", "again", True), ("b", "y", True)], "id string, text string, easy_benign boolean")
    fill = {"easy_benign": False, "kw_hits": ""}
    assert files.append_new(new, path, fill=fill) == 1
    rows = {r["id"]: r.asDict() for r in spark.read.parquet(path).collect()}
    assert rows == {"a": {"id": "a", "text": "x", "kw_hits": "kw", "easy_benign": False}, "b": {"id": "b", "text": "y", "kw_hits": "", "easy_benign": True}}
    assert spark.read.parquet(f"{path}.bak").collect()[0].asDict() == {"id": "a", "text": "x", "kw_hits": "kw"}
    assert files.append_new(new, path, fill=fill) == 0
    assert files.append_new(new.select(F.lit("c").alias("id"), "text").limit(1), path) == 1
    assert spark.read.parquet(f"{path}.bak").count() == 1 and spark.read.parquet(path).count() == 3
    # a swap that was cut short between its two renames
    os.rename(path, f"{path}.before")
    assert files.append_new(new, path, fill=fill) == 0 and spark.read.parquet(path).count() == 3
    assert json.loads(json.dumps(sorted(r["id"] for r in spark.read.parquet(path).collect()))) == ["a", "b", "c"]


def test_label_sheet_config_and_dictionary_digest(spark):
    sample = spark.createDataFrame([(f"i{k:02d}", "text", "val") for k in range(30)], "id string, text string, split string")
    rows = files.label_sheet(sample).orderBy("id").collect()
    assert [r["_ref_gold"] for r in rows][:5] == ["dangerous", "benign", "ambiguous", "out_of_scope", ""]
    assert [r["_ref_tags"] for r in rows][:2] == ["hard_negative", "cat:malware_dev"] and rows[-1]["_ref_tags"] == "" and {r["gold"] for r in rows} == {""}
    view = ElementTree.fromstring(files.label_config())
    assert {x.get("name"): len(x) for x in view.iter("Choices")} == {"gold": 4, "cat_tags": 7, "hn_tags": 7}
    words = files.dictionary_words(spark.createDataFrame([("b/S",), ("beta/XY",), ("alpha",), ("Alpha",)], "value string"), ["log"])
    assert files.words_digest(words) == hashlib.sha256(b"alpha\nbeta\nlog\n").hexdigest()

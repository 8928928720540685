"""The corpus pipeline: each stage against its operator's brute force, and odd input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from siftmill.llm import decontaminate, ngram_join, packing, toxicity
from siftmill.llm.shared import table

SMALL = "/root/testdata/sf0.001"
CLASH = ["toxicity", "toxicity_", "_toxicity", "kept_id", "kept_hash", "_hash", "_group", "_links", "_items", "found_items", "found_edits", "node", "rep", "copies", "ids"]


def similar(a, b):
    sets = []
    for text in (a, b):
        w = ngram_join._WORD.findall((text or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return bool(sets[0] and sets[1]) and len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) - 1e-9


def one_of_each(rows):
    """The first row of each group of similar texts, in order of ids (nulls last)."""
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similar(rows[i]["text"], rows[j]["text"]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return sorted((rows[g]["doc_id"], rows[g]["text"]) for g in set(group))


def test_stages_recomputed(spark):
    docs = table(spark, SMALL, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, SMALL)
    model = toxicity.fit(docs, table(spark, SMALL, "labels"))
    margin = dict(zip(rows, model.margin([r["text"] for r in rows.values()])))
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, m in margin.items() if m < 0}
    single = steps["ngram_join"](spark, clean, SMALL)
    assert sorted((r["doc_id"], r["text"]) for r in single.collect()) == one_of_each(clean.collect())
    bench = [(i, decontaminate.words(t)) for i, t in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    left = steps["decontaminate"](spark, single, SMALL)
    index = decontaminate.Index([(i, " ".join(w)) for i, w in bench])
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in single.collect() if not index.search(r["text"])}
    packed = steps["packing"](spark, left, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in left.collect()} and all(r["n"] == r["t"] for r in packed)


def test_odd_documents_and_clashing_columns(spark, tmp_path):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(3, near), (7, near + " more"), (7, "an unlike text of quite another kind, under an id that another text has"), (None, near), (None, None), (8, ""), (8, ""), (9, "word " * 30_000), (9, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASH:
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).write.parquet(f"{tmp_path}/{name}.parquet")
    here, read = f"file://{tmp_path}", table(spark, f"file://{tmp_path}", "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, read, here)
        assert got.columns == read.columns
        for r in got.collect():
            assert all(r[c] == c for c in CLASH)
        if name == "ngram_join":
            kept = sorted(((r["doc_id"], (r["text"] or "")[:10]) for r in got.collect()), key=str)
            assert kept == sorted([(3, near[:10]), (7, "an unlike "), (None, ""), (8, ""), (8, ""), (9, "word word ")], key=str)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, here).collect()} <= {3, 7, 8, 9, None}


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_documents(spark, stage):
    docs = table(spark, SMALL, "documents").where("false")
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, SMALL)
    assert got.count() == 0 and (stage == "packing" or got.columns == docs.columns)
    assert packing.WINDOW == 2048

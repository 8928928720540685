"""What near-duplicate pairs exchange."""

from siftmill.operators import dedupe


def test_pairs_cut_only_candidates_into_shingles(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k"), (3, "quite another text")], "id long, norm string")
    found = spark.createDataFrame([(1, 2)], "a long, b long")
    made = dedupe.pairs_of_texts(texts, found, threshold=0.5)
    assert [(r["a"], r["b"]) for r in made.collect()] == [(1, 2)]
    assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()


def test_exact_ids_exchange_hashes_alone(spark):
    rows = [("1", "b", "same"), ("2", "a", "same"), ("3", "b", "other")]
    df = spark.createDataFrame(rows, "id string, source string, norm string")
    got = dedupe.exact_ids(df, ["a", "b"])
    assert {r["id"] for r in got.collect()} == {"2", "3"} == {r["id"] for r in dedupe.exact_dedupe(df, ["a", "b"]).collect()}

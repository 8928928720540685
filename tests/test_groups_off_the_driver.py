"""What near-duplicate groups are made of does not go through the driver."""

from pyspark.sql import functions as F

from siftmill.operators import dedupe


def test_groups_broadcast_nothing_and_keep_no_shingles_as_text(spark, monkeypatch):
    """Labels, links and nodes are merged, however small a side of this table is."""
    seen = []

    def kept(df, f=dedupe.cut):
        out = f(df)
        seen.append((df.schema, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(dedupe, "cut", kept)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id") % 10 * 1000).cast("string"))), F.when(F.col("id") >= 10, F.col("id").cast("string")))
    rows = spark.range(300).select("id", text.alias("norm"))
    got = dedupe.near_duplicate_groups(rows, small=8)
    assert {(r["id"], r["dup_group"]) for r in got.select("id", "dup_group").collect()} == {(i, i % 10) for i in range(300)}
    seen.append((got.schema, got._jdf.queryExecution().executedPlan().toString()))
    assert len(seen) > 8
    assert not [plan for _, plan in seen if "Broadcast" in plan]
    assert not [schema for schema, _ in seen if "sh" in schema.names and schema["sh"].dataType.elementType.typeName() == "string"]

"""What the driver holds of a plan does not grow with the rounds that led to it."""

from siftmill.operators import dedupe


def test_components_of_a_long_chain_estimate_no_sizes_beyond_their_data(spark, monkeypatch):
    """Estimated sizes of joins were multiplied round by round: numbers of millions of digits."""
    bits = []

    def kept(df, f=dedupe.cut):
        out = f(df)
        bits.append(int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length())
        return out

    monkeypatch.setattr(dedupe, "cut", kept)
    # neighbours in the chain have far labels, so that it takes some rounds
    names = [i * 37 % 128 for i in range(128)]
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    got = dedupe.components(edges, spark.range(130), "id")
    assert {(r["id"], r["dup_group"]) for r in got.collect()} == {(i, 0) for i in range(128)} | {(128, 128), (129, 129)}
    assert len(bits) >= 6
    assert max(bits) < 64

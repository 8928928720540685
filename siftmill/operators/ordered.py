"""Running totals and order statistics over any number of rows.

A window over a whole order, or over a key that may hold most rows, sorts them in one
task. Here rows are dealt to ranges of the order, each range is summed, and the
totals of the ranges before a row's own are added to the running total inside it. A
range is a partition's worth of rows, however a key's rows are spread; what is
ordered across ranges is one row per range and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.operators.lineage import cut


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` plus, for each (new, column) of ``sums``, the column's total over the key's rows
    up to and with the row itself. ``order`` should leave no ties. Nulls count as 0."""
    if not sums:
        return rows
    # the ranges are read twice, and must be the same both times
    placed = cut(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    first = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range", *keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"_t_{new}") for new, c in sums.items()])
    before = totals.select(F.col("_range").alias("_at"), *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_t_{new}").over(first), F.lit(0)).alias(f"_b_{new}") for new in sums])
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumns({f"_i_{new}": F.sum(F.coalesce(c, F.lit(0))).over(inside) for new, c in sums.items()})
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    out = inner.join(before, same)
    return out.select(*rows.columns, *[(F.col(f"_i_{new}") + F.col(f"_b_{new}")).alias(new) for new in sums])


def counted(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, v, n): how often each value occurs; null values are left out, NaN is refused.

    Nulls are left out by their count of none: a test of the value itself would be pushed
    below the columns it is made of, and make them once for each of their uses."""
    v = value.cast("double")
    v = F.when(F.isnan(v), F.raise_error(F.lit("order statistics: a value is NaN")).cast("double")).otherwise(v)
    return rows.select(*keys, v.alias("v")).groupBy(*keys, "v").agg(F.count("v").alias("n")).where("n > 0")


def order_statistics(counts: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """(keys, name, k, v): of ``counts`` as ``counted`` gives them, the k-th smallest value of
    each row (keys, name, k) of ``ranks``, all keys at once; ties count each. Ranks
    beyond a key's rows give no row."""
    upto = running_sums(counts, keys, [F.col("v")], {"upto": "n"})
    got = _joined(upto, ranks.select(*keys, "name", "k"), keys).where((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("n")))
    return got.select(*keys, "name", "k", "v")


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys, null ones too; without keys there is one group."""
    named = b.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)}).withColumn("_one", F.lit(0))
    same = F.col("_mine") == F.col("_one")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return a.withColumn("_mine", F.lit(0)).join(named, same).drop("_one", "_mine", *[f"_k_{i}" for i in range(len(keys))])


def percentiles(rows: DataFrame, keys: list[str], value: Column, points: dict[str, float]) -> DataFrame:
    """(keys, n, mean, and a column per point): exact percentiles, between two values by
    straight line."""
    counts = cut(counted(rows, keys, value))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("size"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean")).where("size > 0")
    at = {name: F.lit(float(q)) * (F.col("size") - 1) for name, q in points.items()}
    wanted = [F.struct(F.lit(f"{name}_{side}").alias("name"), (f(p).cast("long") + 1).alias("k")) for name, p in at.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = order_statistics(counts, keys, sizes.select(*keys, F.explode(F.array(*wanted)).alias("r")).select(*keys, "r.*"))
    ends = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == f"{name}_{side}", F.col("v"))).alias(f"_{name}_{side}") for name in points for side in ("low", "high")])
    both = _joined(sizes, ends, keys)
    share = {name: p - F.floor(p) for name, p in at.items()}
    line = [(F.col(f"_{name}_low") + share[name] * (F.col(f"_{name}_high") - F.col(f"_{name}_low"))).alias(name) for name in points]
    return both.select(*keys, F.col("size").alias("n"), "mean", *line)

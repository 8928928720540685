"""Sharding by a Feistel permutation of global row numbers (operator 9, native).

Rows are numbered 0..N-1 in the order of (doc_id, size, text digest); a keyed
permutation of those numbers is the reproducible shuffle; a row's shard is its
permuted number modulo the shard count and its slot the quotient. Shard counts
are thus at most one apart (law ``rows``) whatever the keys, texts or sources
are, and anyone who knows N and the key can compute where a row number went.

The permutation is a generalised Feistel network (Black and Rogaway, 2002) on
pairs Z_a x Z_b with a*b >= N; numbers that leave 0..N-1 are walked along their
cycle. (a, b) is chosen so that a*b - N is smallest; a walk visits each of those
few outside numbers once at most, so a fixed number of steps is always enough.

Defined cases: null text has size 16 and the digest of no bytes; a null doc_id
sorts first; rows that are equal in doc_id, size and digest are interchangeable;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.llm.shared import materialize

ROUNDS = 6


def domain(n: int) -> tuple[int, int]:
    """(a, b) near the square root with the smallest a*b >= n."""
    n = max(n, 1)
    root = isqrt(n - 1) + 1
    return min(((a, -(-n // a)) for a in range(max(1, root - 2000), root + 1)), key=lambda p: (p[0] * p[1], -p[0]))


def _round(value: Column, k: int, key: int) -> Column:
    return F.xxhash64(value.cast("long"), F.lit(k), F.lit(key))


def _once(x: Column, a: int, b: int, key: int) -> Column:
    left, right = F.floor(x / F.lit(b)).cast("long"), F.pmod(x, F.lit(b)).cast("long")
    state = F.struct(left.alias("l"), right.alias("r"))

    def step(s: Column, k: Column) -> Column:
        even = F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, F.lit(key)), F.lit(a)), F.lit(a)).cast("long").alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], k, F.lit(key)), F.lit(b)), F.lit(b)).cast("long").alias("r"))
        return F.when(F.pmod(k, F.lit(2)) == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda s: s["l"] * F.lit(b) + s["r"])


def permute(x: Column, n: int, key: int) -> Column:
    """The place of row number ``x`` of 0..n-1."""
    a, b = domain(n)
    out = _once(x, a, b, key)
    if a * b > n:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), out, lambda v, _: F.when(v < F.lit(n), v).otherwise(_once(v, a, b, key)))
    return out


def shard_rows(docs: DataFrame, shards: int = 40, key: int = 2024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    Only doc_id, size and digest (20 bytes a row) are exchanged: once by range, then by range number to
    count within ranges. Ranges split on the digest too, so a repeated doc_id
    does not make one large.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    ranged = thin.repartitionByRange("doc_id", "size", "text_crc32").withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")  # spark_partition_id() is only stable once written
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = ranged.count()
    number = F.row_number().over(Window.partitionBy("range").orderBy("doc_id", "size", "text_crc32")) - 1
    rows = ranged.withColumn("in_range", number).join(before.select("range", "before"), "range")
    rows = rows.withColumn("row_number", (F.col("before") + F.col("in_range")).cast("long"))
    place = permute(F.col("row_number"), n, key)
    return rows.withColumn("place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )

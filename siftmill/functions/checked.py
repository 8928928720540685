"""Joins that check their own keys while they run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str], all_left: bool = True, all_right: bool = True) -> DataFrame:
    """Rows of ``left`` with the columns of ``right``, which have other names but for ``key``.

    A key that is null or comes twice on a side fails the job with its name, and so does one
    that only one side has: a left key without a right one if ``all_left``, a right key
    without a left one if ``all_right``. Otherwise left rows stay as in a left join.
    Both sides are grouped by the key, which is the exchange that the join needs anyway;
    neither is read a second time."""
    mine, theirs = names

    def grouped(df: DataFrame, into: str) -> DataFrame:
        rest = [c for c in df.columns if c != key] or [key]
        return df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(f"_n_{into}"), F.any_value(F.struct(*rest)).alias(f"_{into}"))

    # null keys do not meet, so they are told from rows that lack the other side
    both = grouped(left, "l").join(grouped(right, "r"), "_key", "full")
    n, m = F.coalesce("_n_l", F.lit(0)), F.coalesce("_n_r", F.lit(0))
    said = F.coalesce(F.col("_key").cast("string"), F.lit("null"))
    wrong = (
        F.when(F.col("_key").isNull(), F.concat(F.when(n > 0, mine).otherwise(theirs), F.lit(": null "), F.lit(key)))
        .when(n > 1, F.concat(F.lit(f"{mine}: {key} comes twice: "), said))
        .when(m > 1, F.concat(F.lit(f"{theirs}: {key} comes twice: "), said))
        .when(F.lit(all_left) & (m == 0), F.concat(F.lit(f"{theirs}: {key} missing: "), said))
        .when(F.lit(all_right) & (n == 0), F.concat(F.lit(f"{mine}: {key} unknown: "), said))
    )
    # the error is the key's own value, so that no optimisation drops it unseen
    checked = both.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(n > 0))
    columns = [F.col("_key").alias(key) if c == key else F.col(f"_l.{c}") for c in left.columns]
    return checked.select(*columns, *[F.col(f"_r.{c}") for c in right.columns if c != key])

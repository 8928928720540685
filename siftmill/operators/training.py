"""What training reads and reports: rows with soft targets, and losses over probability rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_frame(train: DataFrame, targets: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """``train`` with its soft targets by id, and one row of how many were matched and not."""
    joined = train.join(targets.select("id", *cols), "id", "left")
    found = F.col(cols[0]).isNotNull()
    counts = joined.agg(F.count_if(found).alias("matched"), F.count_if(~found).alias("unmatched"))
    return joined.where(found), counts


def renormalized(row: Column) -> Column:
    """Entries over their sum; a row of zeros stays."""
    total = F.aggregate(row, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.arrays_zip(row.alias("p"), F.array_repeat(total, F.size(row)).alias("t")), lambda z: z["p"] / F.when(z["t"] == 0, F.lit(1.0)).otherwise(z["t"]))


def full_classes(row: Column, classes: list[int], width: int = 3) -> Column:
    """Entries at the places of their classes; 0 for a class that was not trained."""
    return F.array(*[F.element_at(row, classes.index(c) + 1) if c in classes else F.lit(0.0) for c in range(width)])


def soft_cross_entropy(target: Column, p: Column, floor: float = 1e-15) -> Column:
    """Mean of -sum(target * ln p) over rows."""
    terms = F.zip_with(target, p, lambda t, q: -t * F.ln(F.greatest(q, F.lit(floor))))
    return F.avg(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def kl_divergence(target: Column, logits: Column) -> Column:
    """Mean over rows of KL(target || softmax(logits)); a zero target adds nothing."""
    top = F.array_max(logits)
    norm = top + F.ln(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    terms = F.zip_with(target, logits, lambda t, x: F.when(t > 0, t * (F.ln(t) - (x - norm))).otherwise(0.0))
    return F.avg(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))

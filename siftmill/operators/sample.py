"""Deterministic sampling, allocation and splitting by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.functions.text import english_looking
from siftmill.operators.lineage import cut


def hash_order(seed: int, key: Column) -> Column:
    """The same order in every engine: md5 of "seed:key"."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


#: Rows that one cell of a hash order holds, about.
CELL_ROWS = 100_000


def before_in_hash_order(df: DataFrame, keys: list[str], order: Column, n: str | Column, borders: list[Column], tie: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` plus ``before``: the sum of ``n`` over the key's rows ahead in the order of the hash
    ``order``, ties by ``tie``; exact as far as it is compared with ``borders`` by <.

    The first digits of the hash make cells of about ``cell_rows`` rows. Counts of cells give
    the sum ahead of each; only the rows of a cell that holds a border are put in order,
    so no task sees a key's rows together, even where one key has them all. ``df`` is
    read a few times and should be materialised."""
    total, digits = df.count(), 1
    while total > cell_rows * 16**digits:
        digits += 1
    size = F.col(n) if isinstance(n, str) else n
    placed = df.withColumns({"_hash": order, "_size": size}).withColumn("_cell", F.substring("_hash", 1, digits))
    ahead = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*keys, "_cell").agg(F.sum("_size").alias("_sum")).withColumn("_from", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    rows = placed.join(cells, [*keys, "_cell"])
    edge = F.lit(False)
    for b in borders:
        edge = edge | F.coalesce((F.col("_from") < b) & (b < F.col("_from") + F.col("_sum")), F.lit(False))
    inside = Window.partitionBy(*keys, "_cell").orderBy("_hash", tie).rowsBetween(Window.unboundedPreceding, -1)
    exact = rows.where(edge).withColumn("before", F.col("_from") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return exact.unionByName(rows.where(~edge).withColumn("before", F.col("_from"))).select(*df.columns, "before")


def label_bucket(label: Column) -> Column:
    return F.when(label.isNull(), "unk").when(label >= 0.5, "unsafe").otherwise("safe")


def allocate(sizes: DataFrame, n: int, key: str = "stratum", size: str = "size") -> DataFrame:
    """Largest-remainder allocation of n over strata; everything if n covers it."""
    total = sizes.agg(F.sum(size).alias("total"))
    quota = F.col(size) * F.lit(float(n)) / F.col("total")
    rows = sizes.withColumn("total", total.scalar()).withColumn("base", F.floor(quota).cast("long")).withColumn("frac", quota - F.floor(quota))
    spare = F.lit(n) - F.sum("base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("frac"), key))
    got = F.when(F.col("total") <= n, F.col(size)).otherwise(F.col("base") + F.when(place <= spare, 1).otherwise(0))
    return rows.select(key, size, got.cast("long").alias("take"))


def stratified_sample(df: DataFrame, n: int, seed: int = 1337, key: str = "id", stratum: str = "stratum") -> DataFrame:
    """n rows, shared out over strata in proportion, chosen and shuffled by hash."""
    df = cut(df)
    takes = allocate(df.groupBy(stratum).agg(F.count("*").alias("size")), n, stratum)
    rows = df.join(takes.select(stratum, F.col("take").alias("_take")), stratum)
    placed = before_in_hash_order(rows, [stratum], hash_order(seed, F.col(key)), F.lit(1), [F.col("_take")], key)
    return placed.where("before < _take").select(df.columns)


def uniform_sample(df: DataFrame, n: int, seed: int = 7, key: str = "id") -> DataFrame:
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def shuffle(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    return df.orderBy(hash_order(seed, F.col(key)), key)


def easy_benign(pool: DataFrame, scoped: DataFrame, split: DataFrame, source: str | list[str], n: int = 300, seed: int = 7, low: int = 20, high: int = 1500) -> DataFrame:
    """Ordinary benign prompts outside scope and splits, one per normalised text. ``pool`` has id, text, norm, source, source_label."""
    named = [source] if isinstance(source, str) else source
    rows = pool.where(F.col("source").isin(named) & (F.col("source_label") == 0) & F.col("text").isNotNull() & F.length("text").between(low, high) & english_looking(F.col("text")))
    for other, on in ((scoped, "id"), (split, "id"), (scoped, "norm"), (split, "norm")):
        if on in other.columns:
            rows = rows.join(other.select(on).distinct(), on, "left_anti")
    turn = F.row_number().over(Window.partitionBy("norm").orderBy("id"))
    return uniform_sample(rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn"), n, seed)


def group_table(df: DataFrame, group: str = "dup_group", norm: str = "norm") -> DataFrame:
    """One row per group: n, and the first non-null source, label, category and tags in text order."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(norm, "id"))).alias(c) for c in ("source", "source_label", "source_category", "tags")]
    return df.groupBy(group).agg(F.count("*").alias("n"), *firsts)


def stratum_key() -> Column:
    """Label bucket with the first hn tag, else the category."""
    hn = F.try_element_at(F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ";"), F.trim), lambda t: t.startswith("hn:")), F.lit(1))
    rest = F.coalesce(hn, F.nullif(F.col("source_category"), F.lit("")))
    return F.concat_ws("|", label_bucket(F.col("source_label")), rest)


def split_groups(groups: DataFrame, ood: list[str], sizes: dict[str, int], seed: int = 42, group: str = "dup_group", scarce: str = "hn_seed", scarce_share: float = 0.6) -> DataFrame:
    """(group, split): held-out sources by stratum, then validation and test by
    stratum in hash order, everything else train. Groups never straddle.

    Quotas are each stratum's share of the target. A stratum's groups are laid in hash order;
    the first rows go to val_pool, the next to test_pool. Held-out groups beyond
    the target get no split, as their sources must not be trained on. Groups of the
    ``scarce`` source go first: a share of their rows to val_pool and test_pool, in the
    ratio of the targets, which count against those of the other sources."""
    kind = F.when(F.col("source").isin(ood), "ood").when(F.col("source") == scarce, "scarce").otherwise("rest")
    g = cut(groups.withColumn("stratum", stratum_key()).withColumn("kind", kind))
    # totals by partial counts, one row a stratum; no task holds a kind
    strata = g.groupBy("kind", "stratum").agg(F.sum("n").alias("rows"))
    kinds = strata.groupBy("kind").agg(F.sum("rows").alias("all"))
    totals = {r["kind"]: r["all"] for r in kinds.collect()}
    shares = strata.join(F.broadcast(kinds), "kind").select("kind", "stratum", (F.col("rows") / F.col("all")).alias("share"))
    g = g.join(shares, ["kind", "stratum"])

    def laid(rows: DataFrame, first: Column, second: Column) -> DataFrame:
        """Groups that begin ahead of the first target, the second, or behind both."""
        ends = [first * F.col("share"), (first + second) * F.col("share")]
        placed = before_in_hash_order(rows, ["kind", "stratum"], hash_order(seed, F.col(group)), "n", ends, group)
        return placed.withColumn("turn", F.when(F.col("before") < ends[0], 0).when(F.col("before") < ends[0] + second * F.col("share"), 1).otherwise(2))

    pool = totals.get("scarce", 0) * scarce_share
    val_share = sizes["val"] / ((sizes["val"] + sizes["test"]) or 1)
    first, second = F.lit(float(pool * val_share)), F.lit(float(pool * (1 - val_share)))
    used = {}
    if pool:
        used = {r["turn"]: r["n"] for r in laid(g.where("kind = 'scarce'"), first, second).groupBy("turn").agg(F.sum("n").alias("n")).collect()}
    val, test = (F.lit(float(max(0, sizes[s] - used.get(k, 0)))) for k, s in enumerate(("val", "test")))

    def of_kind(ood: Column, scarce: Column, rest: Column) -> Column:
        return F.when(F.col("kind") == "ood", ood).when(F.col("kind") == "scarce", scarce).otherwise(rest)

    out = laid(g, of_kind(F.lit(float(sizes["ood"])), first, val), of_kind(F.lit(0.0), second, test))
    held = F.when(F.col("turn") == 0, "test_ood_pool")
    split = F.when(F.col("kind") == "ood", held).when(F.col("turn") == 0, "val_pool").when(F.col("turn") == 1, "test_pool").otherwise("train")
    return out.select(group, "n", "stratum", split.alias("split"))


def with_split(df: DataFrame, assigned: DataFrame, group: str = "dup_group") -> DataFrame:
    """Rows with the split of their group; rows of a group without one are dropped."""
    return df.join(assigned.where("split is not null").select(group, "split"), group)


def of_split(labels: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The labels whose id is among ``ids``."""
    return labels.join(ids.select(key), key, "left_semi")


def top_up(assigned: DataFrame, sizes: dict[str, int], seed: int = 42, group: str = "dup_group") -> DataFrame:
    """Move train groups, in hash order, to whichever of val and test lacks more rows
    until both reach their targets. A running deficit decides, so only as many
    group sizes as the deficits span reach the driver: no more than the targets, which
    are numbers of rows to be labelled or tested, whatever the corpus."""
    assigned = cut(assigned)
    have = {r["split"]: r["n"] for r in assigned.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    lack = {k: max(0, sizes[s] - have.get(k, 0)) for k, s in (("val_pool", "val"), ("test_pool", "test"))}
    need = sum(lack.values())
    if not need:
        return assigned
    spare = assigned.where("split = 'train'").orderBy(hash_order(seed, F.col(group)), group).limit(need).select(group, "n").collect()
    moved = []
    for row in spare:
        to = max(lack, key=lambda k: lack[k])
        if lack[to] <= 0:
            break
        moved.append((row[0], to))
        lack[to] -= row["n"]
    if not moved:
        return assigned
    moves = assigned.sparkSession.createDataFrame(moved, [group, "_to"])
    return assigned.join(F.broadcast(moves), group, "left").withColumn("split", F.coalesce("_to", "split")).drop("_to")


def dev_fold(groups: DataFrame, fraction: float = 0.15, seed: int = 0, by_rows: bool = True, group: str = "dup_group") -> DataFrame:
    """Adds is_dev per class: groups in hash order until a share of rows, or a share of groups."""
    groups = cut(groups)
    size = F.col("n") if by_rows else F.lit(1)
    total = F.sum(size).alias("_total")
    most = F.lit(fraction) * F.col("_total") if by_rows else F.greatest(F.lit(1.0), F.rint(F.col("_total") * F.lit(fraction)))
    rows = groups.join(groups.groupBy("cls").agg(total), "cls")
    placed = before_in_hash_order(rows, ["cls"], hash_order(seed, F.col(group)), size, [most], group)
    return placed.withColumn("is_dev", F.col("before") < most).select(*groups.columns, "is_dev")

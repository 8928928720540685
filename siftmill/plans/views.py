"""Views over the driver's tables that stand in for the prompt corpora.

``documents`` joined to ``labels`` is the pool (toxic is the source label); of the labelled
rows toxic ones are dangerous, clean ones of good quality benign, the rest
ambiguous. A small lexicon of words that occur replaces the corpus's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions.scoring import Rule, matched_weight, rule_logits, softmax
from siftmill.functions.text import make_id, normalize
from siftmill.operators.lexicon import Lexicon, prefilter

STRONG = ["idiot", "stupid", "worthless", "moron", "scum", "trash"]
WEAK = ["clown", "loser", "pathetic", "disgusting", "license"]
LEXICON = Lexicon(sorted(STRONG, key=lambda t: (-len(t), t)), sorted(WEAK, key=lambda t: (-len(t), t)))
RULES = [
    Rule("offensive", r"\bidiot\b", 1.8),
    Rule("offensive", r"\bmoron\b", 1.9),
    Rule("offensive", r"\bscum\b", 2.0),
    Rule("offensive", r"\bstupid\b.*\bworthless\b", 2.4),
    Rule("defensive", r"\blicense\b", 1.6),
    Rule("defensive", r"\bloser\b", 0.8),
    Rule("target", r"\btrash\b", 1.3),
]
PREFERENCE = [f"src{k}" for k in (3, 1, 4, 15, 9, 2, 6, 5)]
BYPASS = ["src0", "src1"]
OOD = ["src2", "src3"]

# the same views as DuckDB SQL
NORM = r"trim(regexp_replace(lower(coalesce(text,'')), '\s+', ' ', 'g'))"
SQL_HITS = {k: f"list_filter([{', '.join(repr(w) for w in sorted(ws))}], lambda x: regexp_matches(lower(text), '\\b' || x || '\\b'))" for k, ws in (("s", STRONG), ("w", WEAK))}
SQL = {
    "docs": f"docs AS (SELECT doc_id, text, lang, source, {NORM} AS norm, source || ':' || substr(sha1({NORM}),1,12) AS id FROM documents)",
    "pool": "pool AS (SELECT d.*, CAST(l.toxic AS DOUBLE) AS source_label, l.quality FROM docs d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    "scoped": f"scoped AS (SELECT *, CAST(len(s) AS INT) AS kw_strong, CAST(len(w) AS INT) AS kw_weak, list_sort(list_concat(s, w)) AS h, (len(s) >= 1 OR len(w) >= 2) AS in_scope FROM (SELECT *, {SQL_HITS['s']} AS s, {SQL_HITS['w']} AS w FROM docs))",
    "logits": "logits AS (SELECT *, o + t - d AS sc, o + t + d AS mt FROM (SELECT doc_id, source, lang, CASE WHEN source_label = 1 THEN 'dangerous' WHEN quality = 1 THEN 'benign' WHEN quality IS NOT NULL THEN 'ambiguous' END AS gold, "
    + ", ".join(
        "("
        + " + ".join(f"CASE WHEN regexp_matches(lower(text), '{r.pattern}') THEN CAST({r.weight} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for r in RULES if r.group == g)
        + f") AS {n}"
        for g, n in (("offensive", "o"), ("defensive", "d"), ("target", "t"))
    )
    + " FROM pool WHERE quality IS NOT NULL))",
    "probs": "probs AS (SELECT *, e0/(e0+e1+e2) AS r0, e1/(e0+e1+e2) AS r1, e2/(e0+e1+e2) AS r2 FROM (SELECT *, exp(l0-greatest(l0,l1,l2)) AS e0, exp(l1-greatest(l0,l1,l2)) AS e1, exp(l2-greatest(l0,l1,l2)) AS e2 FROM (SELECT *, -sc AS l0, sc AS l1, CAST(-1.5 AS DOUBLE) + CAST(0.6 AS DOUBLE)*mt - abs(sc) AS l2 FROM logits)))",
    "preds": "preds AS (SELECT doc_id AS id, source, gold, round(r0,9) AS p_safe, round(r1,9) AS p_dangerous, round(r2,9) AS p_unsure, doc_id % 17 = 0 AS force_escalate, "
    "CASE WHEN gold='dangerous' THEN CASE doc_id % 3 WHEN 0 THEN 'cat:ddos' WHEN 1 THEN 'cat:malware_dev' ELSE 'cat:phishing_se' END || CASE WHEN doc_id % 4 = 0 THEN ';evasion:fiction' ELSE '' END WHEN gold='benign' AND doc_id % 5 = 0 THEN 'hard_negative;hn:detection' ELSE '' END AS tags FROM probs)",
    "t1": "t1 AS (SELECT doc_id, source, source_label, CAST(CAST('0x' || substr(md5('1:' || doc_id),1,7) AS BIGINT) AS DOUBLE)/268435456 AS p, CAST(CAST('0x' || substr(md5('2:' || doc_id),1,7) AS BIGINT) AS DOUBLE)/268435456 AS p2, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(CAST('0x' || substr(md5('3:' || doc_id),1,7) AS BIGINT) AS DOUBLE)/268435456/2 END AS c FROM pool)",
    "passes": "passes AS (SELECT doc_id AS id, CASE WHEN toxic=1 THEN 'dangerous' WHEN quality=1 THEN 'benign' ELSE 'ambiguous' END AS gold_1, CASE WHEN substr(md5('9:'||doc_id),1,1) IN ('0','1','2') THEN CASE doc_id % 3 WHEN 0 THEN 'dangerous' WHEN 1 THEN 'benign' ELSE 'ambiguous' END WHEN toxic=1 THEN 'dangerous' WHEN quality=1 THEN 'benign' ELSE 'ambiguous' END AS gold_2 FROM labels)",
}


def with_views(names: list[str], body: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " " + body


def with_views_of_all(names: list[str], body: str) -> str:
    """As ``with_views``, documents without a label included."""
    return with_views(names, body).replace(" FROM pool WHERE quality IS NOT NULL", " FROM pool")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").withColumn("norm", normalize(F.col("text")))
    return d.select("doc_id", "text", "lang", "source", "norm", make_id(F.col("source"), F.col("norm")).alias("id"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("source_label"), "quality")
    return docs(spark, sf).join(labels, "doc_id", "left")


def scoped(spark: SparkSession, sf: str) -> DataFrame:
    return prefilter(docs(spark, sf), LEXICON)


def keyword_scores(rows: DataFrame) -> DataFrame:
    """Pool rows with the rules' probabilities and, where they are labelled, gold."""
    # each rule is tried once: the weights are columns before the logits use them
    groups = ("offensive", "target", "defensive")
    rows = rows.withColumns({f"_{g}": matched_weight(F.col("text"), RULES, g) for g in groups})
    p = [F.round(x, 9) for x in softmax(rule_logits(*[F.col(f"_{g}") for g in groups]))]
    gold = F.when(F.col("source_label") == 1, "dangerous").when(F.col("quality") == 1, "benign").when(F.col("quality").isNotNull(), "ambiguous")
    return rows.select("doc_id", "source", gold.alias("gold"), p[0].alias("p_safe"), p[1].alias("p_dangerous"), p[2].alias("p_unsure"))


def preds(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    tags = F.when(
        F.col("gold") == "dangerous",
        F.concat(F.when(i % 3 == 0, "cat:ddos").when(i % 3 == 1, "cat:malware_dev").otherwise("cat:phishing_se"), F.when(i % 4 == 0, ";evasion:fiction").otherwise("")),
    ).when((F.col("gold") == "benign") & (i % 5 == 0), "hard_negative;hn:detection").otherwise("")
    out = keyword_scores(pool(spark, sf).where("quality is not null")).withColumn("force_escalate", i % 17 == 0)
    return out.withColumn("tags", tags).withColumnRenamed("doc_id", "id")


def unit(seed: int):
    """A deterministic number in [0, 1) of a document's id."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("double") / F.lit(268435456.0)


def teachers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pool with string ids, scores of teacher one, scores of teacher two)."""
    p = pool(spark, sf)
    key = F.col("doc_id").cast("string").alias("id")
    c = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(unit(3) / F.lit(2.0))
    one = p.select(key, unit(1).alias("p_unsafe_teacher"), c.alias("p_controversial"), F.lit("t1").alias("teacher_model"))
    two = p.select(key, unit(2).alias("p_unsafe_teacher"), F.lit("t2").alias("teacher_model"))
    return p.select(key, "source", "source_label"), one, two


def passes(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "labels")
    first = F.when(F.col("toxic") == 1, "dangerous").when(F.col("quality") == 1, "benign").otherwise("ambiguous")
    i = F.col("doc_id")
    flip = F.substring(F.md5(F.concat(F.lit("9:"), i.cast("string"))), 1, 1).isin("0", "1", "2")
    other = F.when(i % 3 == 0, "dangerous").when(i % 3 == 1, "benign").otherwise("ambiguous")
    return labels.select(i.alias("id"), first.alias("gold_1"), F.when(flip, other).otherwise(first).alias("gold_2"))

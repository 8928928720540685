"""A training corpus from raw documents: reject toxic ones, keep one of each
group of near-duplicates, remove benchmark contamination, pack into windows.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of ``docs``. Null and empty texts, null
ids, repeated rows and empty tables are handled as the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmill.llm import decontaminate, ngram_join, packing, toxicity
from siftmill.llm.shared import free_name, materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose toxicity score is below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    into = free_name(docs, "toxicity")
    return toxicity.score(docs, model, into=into).where(F.col(into) < 0.5).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by similarity of 0.8 or more, keep that with the
    smallest doc_id; documents without a word are no one's duplicates."""
    classes = materialize(ngram_join.similarity_classes(docs, numbered=True), "similarity")
    # rows are found again by id and text: ids may be null or repeated
    key, text_hash, times, turn = (free_name(docs, n) for n in ("kept_id", "kept_hash", "kept_rows", "kept_turn"))
    rows = classes.groupBy("_group", F.col("doc_id").alias(key), F.col("_hash").alias(text_hash)).agg(F.count("*").alias(times))
    least = F.min(F.struct(F.col(key).isNull(), key, text_hash, times)).alias("at")
    kept = rows.where("_group is not null").groupBy("_group").agg(least).select(f"at.{key}", f"at.{text_hash}", f"at.{times}")
    kept = kept.unionByName(rows.where("_group is null").select(key, text_hash, F.lit(1).cast("long").alias(times)))
    # a merge join at every size: what is kept grows with the documents
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text_hash))
    out = docs.join(kept.hint("merge"), same)
    if not kept.where(F.col(times) > 1).isEmpty():
        one = F.row_number().over(Window.partitionBy(key, text_hash).orderBy("text"))
        out = out.withColumn(turn, one).where((F.col(times) == 1) | (F.col(turn) == 1))
    return out.select(docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which no benchmark item is found."""
    into = free_name(docs, "found_items"), free_name(docs, "found_edits")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=True, into=into)
    return found.where(F.size(into[0]) == 0).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("decontaminate", remove_contaminated),
    ("packing", pack),
]

#: SQL expresses neither the trained model, LSH nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

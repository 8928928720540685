"""Keys of the token index: told alike by Spark and Python, and one to one."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from siftmill.llm import token_output, tokenize
from siftmill.llm.shared import new_path

DOCS = "doc_id long, text string"


def test_keys_agree_and_do_not_collide(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), None, *range(1000, 3000)]
    rows = spark.createDataFrame([(i, c) for i in ids for c in (0, 1, 7)], "doc_id long, copy int")
    got = {(r["doc_id"], r["copy"]): r["key"] for r in token_output._keyed(rows, 16).collect()}
    assert {k: np.uint64(v % 2**64) for k, v in got.items()} == {k: token_output.key_of(*k) for k in got}
    assert len(set(got.values())) == len(got)
    many = spark.range(2_000_000).select((F.col("id") * 977).alias("doc_id"), F.lit(0).alias("copy"))
    assert token_output._keyed(many, 16).select("key").distinct().count() == 2_000_000


def test_rows_of_equal_keys_are_all_read_back(spark, monkeypatch):
    # every key is one of three, so that nearly all rows share theirs
    monkeypatch.setattr(token_output, "_keyed", lambda df, n: df.withColumns({"key": F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)), "bucket": F.lit(0)}))
    monkeypatch.setattr(token_output, "key_of", lambda i, copy: np.uint64((i or 0) % 3))
    path, folder = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "twins")
    rows = [(None, "none"), (None, "again none"), *((k, f"text number {k}") for k in range(40)), (5, "five again")]
    got = token_output.token_output(spark.createDataFrame(rows, DOCS).repartition(3), path, folder).collect()
    enc = tokenize.encoder(path, False).tokenizer
    crc = {zlib.crc32(np.array([*enc.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()): i for i, t in rows}
    assert len(got) == len(rows) and all(crc[r["ids_crc32"]] == r["doc_id"] for r in got)
    table = token_output.Table(folder)
    for r in got:
        assert zlib.crc32(table.ids(r["doc_id"], r["copy"]).astype("<u4").tobytes()) == r["ids_crc32"]


def test_wide_ids_keep_their_digits_beside_a_null(spark, monkeypatch):
    monkeypatch.setattr(token_output, "STRETCH", 5)
    rows = [(2**60 + k, f"wide {k}") for k in range(20)] + [(None, "none")]
    got = token_output.token_output(spark.createDataFrame(rows, DOCS), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows} and len(got) == len(rows)

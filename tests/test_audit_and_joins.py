"""Checked joins, decoded blobs, the dictionary detector and the pre-check audit."""

import base64

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftmill.functions import detect
from siftmill.functions.checked import one_to_one
from siftmill.operators import gold


def frame(spark, ids, name):
    return spark.createDataFrame([(i, f"{name}{k}") for k, i in enumerate(ids)], f"id string, {name} string")


def test_checked_join_keeps_left_rows(spark):
    a, b = frame(spark, ["x", "y", "z"], "l"), frame(spark, ["y", "z"], "r")
    got = {r["id"]: (r["l"], r["r"]) for r in one_to_one(a, b, "id", ("left", "right"), all_left=False).collect()}
    assert got == {"x": ("l0", None), "y": ("l1", "r0"), "z": ("l2", "r1")}
    only = one_to_one(b, a, "id", ("left", "right"), all_right=False)
    assert only.columns == ["id", "r", "l"] and only.count() == 2


@pytest.mark.parametrize(
    ("left", "right", "said"),
    [
        (["x", "x", "y"], ["x", "y"], "left: id comes twice: x"),
        (["x", "y"], ["x", "y", "y"], "right: id comes twice: y"),
        (["x", "y"], ["x"], "right: id missing: y"),
        (["x"], ["x", "w"], "left: id unknown: w"),
        (["x", None], ["x"], "left: null id"),
        (["x"], ["x", None], "right: null id"),
    ],
)
def test_checked_join_names_what_is_wrong(spark, left, right, said):
    joined = one_to_one(frame(spark, left, "l"), frame(spark, right, "r"), "id", ("left", "right"))
    with pytest.raises(PySparkException, match=said):
        joined.select("id").collect()
    with pytest.raises(PySparkException, match=said):
        joined.count()


def test_precheck_needs_the_same_ids(spark):
    preds = spark.createDataFrame([("a", 0.9), ("b", 0.8)], "id string, p_safe double")
    texts = spark.createDataFrame([("a", "run " + "41" * 21), ("b", "a plain text")], "id string, text string")
    got = {r["id"]: (r["p_safe"], r["force_escalate"]) for r in detect.apply_precheck(preds, texts).collect()}
    assert got == {"a": (0.9, True), "b": (0.8, False)}
    with pytest.raises(PySparkException, match="texts: id missing: b"):
        detect.apply_precheck(preds, texts.where("id = 'a'")).collect()


def test_draft_merge_fails_on_ids_the_sheet_does_not_know(spark):
    sheet = spark.createDataFrame([("a", "t", "val"), ("b", "u", "val")], "id string, text string, split string")
    one = spark.createDataFrame([("a", "benign", "", "", "high", "")], "id string, gold string, tags string, notes string, confidence string, alt_label string")
    pool = spark.createDataFrame([("a", "s", 0.0)], "id string, source string, source_label double")
    assert gold.draft_merge(sheet, one, one, pool).count() == 2
    stray = one.withColumn("id", F.lit("q"))
    with pytest.raises(PySparkException, match="sheet: id unknown: q"):
        gold.draft_merge(sheet, one, stray, pool).collect()
    with pytest.raises(PySparkException, match="pass A: id comes twice: a"):
        gold.draft_merge(sheet, one.unionByName(one), one, pool).collect()


def test_encoded_tokens_say_whether_they_decode(spark):
    plain = b"please read this whole sentence now"
    tokens = {"b64": base64.b64encode(plain).decode(), "b32": base64.b32encode(plain).decode(), "hex": plain.hex(), "bin": base64.b64encode(bytes(range(128, 200))).decode().replace("=", ""), "md5": "0123456789abcdef" * 2, "none": "nothing to see here"}
    df = spark.createDataFrame([(k, f"look: {v} end") for k, v in tokens.items()] + [("null", None)], "id string, text string")
    got = {r["id"]: r["reason"] for r in detect.with_decoded_blob(df, F.coalesce("text", F.lit(""))).collect()}
    assert got["b64"] == f"encoded blob: base64[{len(tokens['b64'].rstrip('='))}] (decodes to text)"
    assert got["b32"] == f"encoded blob: base32[{len(tokens['b32'].rstrip('='))}] (decodes to text)"
    assert got["hex"] == f"encoded blob: hex[{len(tokens['hex'])}] (decodes to text)"
    assert got["bin"].startswith("encoded blob: base64[") and "decodes" not in got["bin"]
    assert got["md5"] is None and got["none"] is None and got["null"] is None


def test_dictionary_by_broadcast_or_exchange(spark):
    words = spark.createDataFrame([("the",), ("cat",), ("sat",)], "word string")
    df = spark.createDataFrame([("a", "the cat sat the cat sat the cat sat"), ("b", "zxq qqw wwz zzx xqq qwz xwq wqx zwx"), ("c", "too short")], "id string, text string")
    for limit in (10**6, 0):
        low = detect.low_natural_language(df, words, limit=limit)
        got = {r["id"]: (r["known"], r["alpha"], r["reason"] is not None) for r in low.collect()}
        assert got == {"a": (9, 9, False), "b": (0, 9, True), "c": (0, 2, False)}
        plan = low._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (limit > 0)


def test_audit_counts_every_slice(spark):
    rows = [("1", "a calm text", "train", "benign", "", 0.0), ("2", "other calm text", "val", "benign", "hard_negative", 0.0), ("3", "words of harm and more of it", "val", "dangerous", "", 1.0), ("4", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0 now", "test", "benign", "", 0.0), ("5", "x", "test_evasion", "dangerous", "evasion:fiction;cat:ddos", None), ("6", None, "test_ood", "benign", "", None)]
    df = spark.createDataFrame(rows, "id string, text string, split string, gold string, tags string, source_label double")
    others = spark.createDataFrame([("9", "der die das und ist", "reported"), ("8", "plain", "tuning")], "id string, text string, kind string")
    got = {r["slice"]: (r["k"], r["n"]) for r in detect.audit(df, None, others).collect()}
    assert got["train_benign"] == (0, 1) and got["val_benign_hard_negative"] == (0, 1) and got["val_dangerous"] == (0, 1)
    assert got["test_benign_other"] == (1, 1) and got["test_ood_benign_other"] == (0, 1) and got["test_evasion_fiction"] == (0, 1)
    assert got["ordinary_tuning"] == (0, 1) and got["ordinary_reported"] == got["ordinary_reported_de"] == (0, 1)
    assert {s for s in got if s.startswith("encoding_")} == {f"encoding_{n}" for n in detect.ENCODINGS} and all(got[f"encoding_{n}"][1] == 2 for n in detect.ENCODINGS)
    assert got["encoding_base32"][0] >= 1 and got["encoding_char_spacing"] == (2, 2)


def test_two_passes_keep_what_both_have(spark):
    from siftmill.operators.gold import two_passes

    first = spark.createDataFrame([("a", "benign", "x"), ("b", "dangerous", "y"), ("c", "ambiguous", "z")], "id string, gold string, note string")
    second = spark.createDataFrame([("b", "benign"), ("c", "ambiguous"), ("d", "benign")], "id string, gold string")
    got = {tuple(r) for r in two_passes(first, second).select("id", "gold_1", "note", "gold_2").collect()}
    assert got == {("b", "dangerous", "y", "benign"), ("c", "ambiguous", "z", "ambiguous")}


def test_keyword_scores_cover_rows_without_labels(spark):
    from siftmill.plans import views

    rows = [(1, "s", "how to build a botnet", None, None), (2, "s", "hello", 0.0, 1), (3, "s", "", 0.0, 0), (4, "s", "attack", 1.0, 0)]
    got = {r["doc_id"]: r for r in views.keyword_scores(spark.createDataFrame(rows, "doc_id long, source string, text string, source_label double, quality int")).collect()}
    assert [got[k]["gold"] for k in (1, 2, 3, 4)] == [None, "benign", "ambiguous", "dangerous"]
    assert all(abs(r["p_safe"] + r["p_dangerous"] + r["p_unsure"] - 1) < 1e-6 for r in got.values())

"""The training-data operators against brute force, round trips and odd inputs."""

import random
import time
import zlib
from math import comb

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftmill.llm import decontaminate, embedding_dedup, html_extract, ngram_join, packing, queries, sharding, token_output, tokenize, toxicity, url_filter, warc
from siftmill.llm.shared import components, new_path

ODD = [(0, None), (1, ""), (2, "x"), (3, "one two three four five six seven eight nine ten"), (4, "one two three four five six seven eight nine ten"), (5, "a  b \n\n c\t"), (6, "word " * 4000), (None, "lost id")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in ODD], SCHEMA + ", score string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_piecewise_encoding_is_exact(docs, name, spaced):
    enc = tokenize.PieceEncoder(public_tokenizers.path(name), spaced, memory=2000)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    rnd = random.Random(6)
    mixed = ["".join(rnd.choice(["a", "Bc", " ", " ", ".", ",", "'s", "\n", "é", "<|endoftext|>", "1", "\t", "—", "ß", "(", "İ"]) for _ in range(rnd.randint(0, 25))) for _ in range(800)]
    texts = [*list(docs.values())[:150], "", None, " a  b", "a \n b", "\n\nx\n", "  ", "a\tb \t c", "\xa0 x", "don't 's", "x\n", "\ny", "<|endoftext|> z", "ΣΑΣ ΣΑΣ\n\n\nB", "x <|startoftext|>.", *mixed]
    assert enc.direct
    for at in range(0, len(texts), 60):  # several blocks, so that the memory fills up and is tidied
        ids, starts = enc.encode(pa.array(texts[at : at + 60], pa.string()), 1)
        for k, t in enumerate(texts[at : at + 60]):
            assert ids[starts[k] : starts[k + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 1]


def test_toxicity_learns_and_generalises_to_misspellings(spark, odd, empty):
    rnd = random.Random(1)
    good = ["".join(rnd.choice(["ba", "lo", "mi", "ter", "san"]) for _ in range(3)) for _ in range(150)]
    texts, labels = [], []
    for k in range(600):
        words = [rnd.choice(good) for _ in range(40)]
        if k % 4 == 0:
            for at in (3, 17, 30):
                words[at] = rnd.choice(["vileword", "grubbish", "hatecraft"])
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    model = toxicity.train(texts, np.array(labels))
    bad = " ".join(["vilewords" if k % 12 == 0 else rnd.choice(good) for k in range(40)])
    assert model.margin([bad])[0] > 0 > model.margin([" ".join(rnd.choice(good) for _ in range(40))])[0]
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(["a"], np.array([1])).margin([None])[0] > 0
    labelled = spark.createDataFrame([(0, 1), (3, 0), (4, None)], "doc_id long, toxic int")
    assert toxicity.fit(odd, labelled).weights.shape == (toxicity.BUCKETS,)
    mixed = [*texts[:80], None, "", "...", "ÄÖ  x\ty", bad]
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(mixed)), SCHEMA), model).collect()}
    assert np.allclose([rows[k] for k in range(len(mixed))], 1 / (1 + np.exp(-model.margin(mixed))), atol=1e-5)


def test_toxicity_sparse_products():
    rng = np.random.default_rng(3)
    dense = rng.random((40, 13)) * (rng.random((40, 13)) < 0.2)
    rows, cols = np.nonzero(dense)
    made = toxicity._Sparse(np.cumsum(np.bincount(rows, minlength=40)), cols.astype(np.int32), dense[rows, cols].astype(np.float32), 13)
    x, y = rng.normal(size=(13, 3)), rng.normal(size=(40, 3))
    assert np.allclose(made @ x, dense @ x, atol=1e-5) and np.allclose(made.back(y), dense.T @ y, atol=1e-5)
    shares = rng.random(40).astype(np.float32)
    per_row = toxicity._Sparse(made.start[1:], made.cols, shares, 13)
    plain = (dense > 0) * shares[:, None]
    assert np.allclose(per_row @ x, plain @ x, atol=1e-5) and np.allclose(per_row.back(y), plain.T @ y, atol=1e-5)


def test_toxicity_learns_one_row_of_a_repeated_id_and_stays_in_bounds(spark):
    rows = [(k % 40, ("vileword " if k % 40 < 20 else "kindly ") * 3) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    model, once = toxicity.fit(docs, labels), toxicity.fit(docs.dropDuplicates(["doc_id"]), labels)
    assert np.allclose(model.weights, once.weights) and model.margin(["vileword"])[0] > model.margin(["kindly"])[0]
    assert toxicity.fit(docs, labels, entries=1).weights.any() == np.False_


def test_toxicity_of_held_out_rows(spark):
    """Figures on rows that were not learnt from, of a table with few toxic ones."""
    scored = queries.op1_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    got = scored.join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r["toxic"]: r["p"] for r in got}
    assert share[1] > 0.6 and share[0] < 0.08, share


def test_decontamination_finds_edited_passages(spark, docs, odd, empty):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index(bench)
    found = dict(zip(docs, index.search_all(list(docs.values()))))
    norm = {i: " " + " ".join(decontaminate.words(t)) + " " for i, t in docs.items()}
    for item, text in bench:
        whole = " " + " ".join(decontaminate.words(text)) + " "
        for i, t in norm.items():
            if whole in t:
                assert (item, 0) in found[i]
    rnd = random.Random(2)
    hit = 0
    for _ in range(120):
        item, text = rnd.choice(bench)
        w = decontaminate.words(text)
        for _ in range(rnd.randint(1, max(1, decontaminate.allowed(len(w))))):
            w[rnd.randrange(len(w))] = f"zz{rnd.randrange(99)}"
        around = norm[rnd.randrange(500)].split()[:200]
        hit += item in [k for k, _ in index.search(" ".join([*around[:100], *w, *around[100:]]))]
    assert hit >= 114
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "x")], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.contamination(odd, b).collect()}
    assert got[3] == [1] and got[0] == [] and len(got) == len(ODD)
    assert decontaminate.contamination(empty, b).count() == 0
    assert decontaminate.contamination(odd, b.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("part", ["first", "last", "every second from the start"])
def test_decontamination_finds_every_placement_of_edits(part):
    rnd = random.Random(part)
    for n in (5, 20, 57, 120):
        item = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        index = decontaminate.Index([(1, " ".join(item))])
        k = decontaminate.allowed(n)
        for _ in range(20):
            w = list(item)
            half = range(0, n // 2) if part == "first" else range(n - n // 2, n) if part == "last" else range(0, 2 * k, 2)
            for at in sorted(rnd.sample(half, k), reverse=True):
                w[at : at + 1] = rnd.choice([[], ["zz"], ["zz", w[at]]])
            text = " ".join(["a"] * 30 + w + ["b"] * 30)
            coded = np.array([index.code.get(x, 0) for x in text.split()])
            assert index.search(text) == [(1, decontaminate.edit_distance(index.items[0][1], coded))]


@pytest.mark.parametrize("part", ["anywhere", "evenly", "first half"])
def test_decontamination_recall_against_a_full_scan(part):
    """Items with as many edits as are allowed, against Sellers' scan of the whole text."""
    rnd = random.Random(part)
    items = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([6, 12, 25, 40, 60, 110]))] for _ in range(60)]
    index = decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)])
    texts, hits, wanted = [], 0, 0
    for k, item in enumerate(items * 4):
        w, n = list(item), decontaminate.allowed(len(item))
        places = {"anywhere": rnd.sample(range(len(w)), n), "evenly": [len(w) * j // max(n, 1) for j in range(n)], "first half": rnd.sample(range(len(w) // 2 + 1), n)}[part]
        for at in sorted(places, reverse=True):
            w[at : at + 1] = rnd.choice([[], ["zz"], [f"w{rnd.randrange(3000)}"], ["zz", w[at]]])
        texts.append(" ".join([f"w{rnd.randrange(4000)}" for _ in range(40)] + w + [f"w{rnd.randrange(4000)}" for _ in range(40)]))
    for text, found in zip(texts, index.search_all(texts)):
        coded = np.array([index.code.get(x, 0) for x in text.split()])
        full = {(k, d) for k, item in index.items if (d := decontaminate.edit_distance(item, coded)) <= decontaminate.allowed(len(item))}
        assert {k for k, _ in found} <= {k for k, _ in full}
        hits, wanted = hits + len(full & set(found)), wanted + len(full)
    assert wanted >= 240 and hits >= 0.995 * wanted, (hits, wanted)


def test_decontamination_in_parts(spark, monkeypatch):
    docs, bench = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = docs.withColumn("_items", F.lit("mine")).withColumn("edits", F.lit(7))
    once = decontaminate.contamination(docs, bench, keep=True, into=("_found", "_of")).collect()
    monkeypatch.setattr(decontaminate, "PART", 10_000)
    again = decontaminate.contamination(docs, bench, keep=True, into=("_found", "_of")).collect()
    assert sorted(once, key=str) == sorted(again, key=str) and any(r["_found"] for r in once)
    assert {(r["_items"], r["edits"]) for r in once} == {("mine", 7)}


def test_edit_distance():
    a = np.array([1, 2, 3, 4])
    assert decontaminate.edit_distance(a, np.array([9, 1, 2, 3, 4, 9])) == 0
    assert decontaminate.edit_distance(a, np.array([9, 1, 3, 4, 9])) == 1
    assert decontaminate.edit_distance(a, np.array([1, 2, 8, 3, 4])) == 1


def test_warc_round_trip_and_audit(spark):
    rows = [(k, f"http://h/{k}", f"<p>{'é' * k}</p>") for k in range(300)] + [(None, None, None), (7, "http://h/7", "<p></p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = new_path(spark, "t")
    got = warc.audit(pages, lambda replica, i: replica == 1 and i in (5, 123, 299), folder)
    assert {r["page_id"] for r in got.where("corrupt").collect()} == {5, 123, 299} and got.count() == len(rows)
    files = [r["file"] for r in got.select("file").distinct().collect()]
    back = warc.read_archive(spark, f"{folder}/replica-0", files)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "")
    assert sorted(((r["page_id"], r["url"], r["html"]) for r in back.collect()), key=key) == sorted(((i, u or "", h or "") for i, u, h in rows), key=key)
    assert warc.audit(pages.limit(0)).count() == 0
    assert warc.audit(pages).where("corrupt").count() == 0


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    hashed = token_output.PerfectHash.build(keys)
    again, _ = token_output.PerfectHash.from_bytes(hashed.to_bytes())
    assert sorted(again.find(keys).tolist()) == list(range(len(keys)))
    assert (again.find(keys + np.uint64(1)) >= 0).mean() < 0.001


def _digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_output_reads_back_every_document(spark, docs, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = tokenize.encoder(path, False).tokenizer
    got = {r["doc_id"]: r for r in token_output.token_output(odd, path).collect()}
    start = 0
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0])):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), _digest(ids))
        start += len(ids)
    assert token_output.token_output(empty, path).count() == 0
    twice = token_output.token_output(odd.unionByName(odd), path)
    assert twice.count() == 2 * len(ODD) and twice.where("copy = 1").count() == len(ODD)


def test_single_keys_and_a_doc_id_of_many_rows(spark):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "one-id")
    rows = [(7, f"row {k} of many") for k in range(400)] + [(None, f"lost {k}") for k in range(50)] + [(9, "last")]
    got = token_output.token_output(spark.createDataFrame(rows, SCHEMA).repartition(5), path, folder).collect()
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(rows) == len(got)
    assert sorted(r["copy"] for r in got if r["doc_id"] == 7) == list(range(400))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    table = token_output.Table(folder)
    for r in got[::7]:
        assert _digest(table.ids(r["doc_id"], r["copy"])) == r["ids_crc32"]
    assert table.ids(8) is None and table.ids(7, 400) is None


def test_html_extraction(spark):
    pages = html_extract.labelled_pages(300, seed=9)
    tagger = html_extract.train(html_extract.labelled_pages(500))
    wrong = sum(tagger.decode(html_extract.blocks(p)) != y for p, y in pages)
    assert wrong <= 0.1 * len(pages)
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title &amp; more</h1><p><b>One  two<br><p>Three &eacute;</article><section class="comments"><h3>Comments</h3><p>Nice post.</p></section><footer>&copy; x</footer>'
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "plain words only."), (None, "z", "<p")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(rows, tagger).collect()}
    assert got[1]["text"] == "Title & more\nOne two\nThree é" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and len(got) == 5
    assert html_extract.extract(rows.limit(0), tagger).count() == 0


STORY = "<p>First long paragraph of the story here.</p><p>Second paragraph of the story, too.</p>"
TOLD = "First long paragraph of the story here.\nSecond paragraph of the story, too."
#: Pages written and labelled by hand: html and its main text.
BY_HAND = [
    (f"<html><head><title>x</title><meta charset=utf-8><body><article><h1>A title.</h1>{STORY}</article>", f"A title.\n{TOLD}"),
    (f"<html><head><title>x</title><article><h1>A title.</h1>{STORY}</article>", f"A title.\n{TOLD}"),
    (f"<body><div><svg><path d='x'></div><article>{STORY}</article>", TOLD),
    (f"<body><svg><g><article>{STORY}</article>", TOLD),
    (f"<body><svg><text>not this</text></svg><article>{STORY}</article>", TOLD),
    (f"<body><header><a href=/>Home</a></header><main><header><h1>Story title</h1></header>{STORY}</main><footer>&copy; some.site</footer>", f"Story title\n{TOLD}"),
    (f"<body><article>{STORY}<ol><li>Item one is this.</li><li>Item two is that.</li></ol></article>", f"{TOLD}\nItem one is this.\nItem two is that."),
    ("<article><p>Some text is here now.<ul><li>one thing of it<li>two things of it</ul></article>", "Some text is here now.\none thing of it\ntwo things of it"),
    (f"<nav><ul><li><a href=/a>Here</a><li><a href=/b>There</a></ul></nav><div class=content>{STORY}</div><div class=sidebar><p>Read this other thing.</p></div>", TOLD),
    (f"<main class=story><h1>Plain &amp; short.</h1>{STORY}</main><section id=comments><h3>Replies</h3><p>I do not agree at all.</p><p>Nor do I.</p></section>", f"Plain & short.\n{TOLD}"),
    (f"<div class=cookie-banner><p>We use cookies on this site.</p><button>Fine</button></div><article>{STORY}</article><form><label>Your mail</label><input></form>", TOLD),
    (f"<article>{STORY}<div class=ad>Buy this thing now.</div><p>Third paragraph, after the advert.</p></article>", f"{TOLD}\nThird paragraph, after the advert."),
]


def test_html_pages_labelled_by_hand():
    tagger = html_extract.train(html_extract.labelled_pages())
    right = made = wanted = 0
    for page, text in BY_HAND:
        got, want = tagger.extract(page).split("\n"), text.split("\n")
        right += len(set(got) & set(want))
        made, wanted = made + len(got), wanted + len(want)
    f1 = 2 * right / (made + wanted)
    assert f1 >= 0.95, f1
    for page, text in BY_HAND[:8]:
        assert tagger.extract(page) == text


@pytest.mark.parametrize("part", ['<a "', "<div>", "<a '\">", "<svg>", "<li><div>", "<b>", "<a x=\"", "</p>", "<p><b>x"])
def test_html_reading_is_linear(part):
    def seconds(n):
        began = time.process_time()
        html_extract.blocks(part * n + "text")
        return time.process_time() - began

    seconds(1000)
    assert seconds(64_000) < 0.05 + 8 * 1.7 * max(seconds(8_000), 0.005)
    assert seconds(1_000_000 // len(part)) < 6


def test_html_odd_rows(spark):
    rows = [(1, None, None, 1), (None, "u", "", 2), (2, "u", "plain text outside of any tag, as it is.", 3), (2, "u", "<article><p>" + "word " * 200_000 + "</p></article>", 4), (3, "u", "<!-- never closed", 5), (4, "u", "a <", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long").repartition(2)
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows) and html_extract.extract(pages.where("false")).count() == 0
    by = {(r["page_id"], r["n_chars"]) for r in got}
    assert (2, 999_999) in by and (1, 0) in by and (None, 0) in by and (3, 0) in by


def _brute_links(x, t=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= t
    np.fill_diagonal(near, False)
    return near


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 16))
    close = np.concatenate([base[:40] + rng.normal(size=(40, 16)) * s for s in (0.05, 0.2, 0.35)])
    x = np.concatenate([base, close, base[:5]])
    near = _brute_links(x)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    ours = sum(got[k]["n_links"] for k in range(len(x)))
    assert ours >= 0.97 * near.sum() and all(got[k]["n_links"] <= near[k].sum() for k in range(len(x)))
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 906))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_at_the_fringe_of_a_dense_group(spark):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=64))
    group = unit(centre + 0.29 * unit(rng.normal(size=(3000, 64))))
    other = unit(rng.normal(size=(6000, 64)))
    at = rng.choice(3000, 150, replace=False)
    away = rng.normal(size=(150, 64)) - 3 * centre
    away = unit(away - (away * group[at]).sum(1, keepdims=True) * group[at])
    fringe = 0.905 * group[at] + (1 - 0.905**2) ** 0.5 * away
    fringe = fringe[((fringe @ group.T >= 0.9).sum(1) == 1) & ((fringe @ fringe.T >= 0.9).sum(1) == 1)]
    assert len(fringe) >= 100
    x = np.concatenate([group, other, fringe])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    joined = [got[k]["n_links"] == 1 and got[k]["component_id"] == 0 and not got[k]["kept"] for k in range(9000, len(x))]
    print("joined", sum(joined), "of", len(joined))
    assert sum(joined) >= 0.97 * len(joined)


def test_embedding_links_of_null_and_repeated_ids(spark):
    e = np.eye(8)
    rows = [(5, e[0]), (None, e[0] + 0.1 * e[1]), (None, e[2]), (None, e[2] + 0.1 * e[3]), (7, e[4]), (7, e[5]), (8, e[5] + 0.1 * e[6]), (9, e[4] + 0.1 * e[7])]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in rows], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    want = [(5, 1, 5, True), (None, 1, 5, False), (None, 1, None, True), (None, 1, None, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False)]
    assert got == sorted(want, key=str)


def test_ngram_join_against_brute_force(spark, docs, odd, empty):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(40):
        w = [rnd.choice(words) for _ in range(rnd.randint(3, 150))]
        texts.append(" ".join(w))
        for _ in range(rnd.randint(0, 6)):
            v = list(w)
            for _ in range(rnd.randint(0, 4)):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            texts.append(" ".join(v))
    sets = [set(ngram_join.shingles(t, {}).tolist()) for t in texts]
    links = [sum(i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: r for r in ngram_join.similarity_classes(df).collect()}
    assert [got[k]["n_links"] for k in range(len(texts))] == links
    found = {r["doc_id"]: r for r in ngram_join.similarity_classes(odd).collect()}
    assert found[3]["class_id"] == found[4]["class_id"] == 3 and found[3]["n_links"] == 1
    assert found[0]["n_links"] == found[1]["n_links"] == 0 and len(found) == len(ODD)
    assert ngram_join.similarity_classes(empty).count() == 0


def test_ngram_join_of_null_and_repeated_ids(spark):
    from corpus_pipeline import keep_one_of_each_group

    near = lambda tag: (" ".join(f"{tag}{k}" for k in range(100)), " ".join(f"{tag}{k}" for k in range(99)))
    a, b, c = near("a"), near("b"), near("c")
    rows = [(1, a[0]), (None, a[1]), (None, b[0]), (None, b[1]), (3, c[0]), (7, "a text of its own"), (7, c[1]), (2**60 + 1, "d " + a[0]), (8, None), (8, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, ngram_join.similarity_classes(df).select("doc_id", "class_id", "n_links").collect()), key=str)
    want = [(1, 1, 2), (None, 1, 2), (None, None, 1), (None, None, 1), (3, 3, 1), (7, 7, 0), (7, 3, 1), (2**60 + 1, 1, 2), (8, 8, 0), (8, 8, 0)]
    assert got == sorted(want, key=str)
    kept = [tuple(r) for r in keep_one_of_each_group(spark, df, SF).collect()]
    assert len(kept) == 6 and {(1, a[0]), (3, c[0]), (7, "a text of its own"), (8, None)} < set(kept)


def test_pruning_drops_few_true_links():
    floor = ngram_join.least_matches()
    step = np.array([comb(ngram_join.STEP, k) * 0.8**k * 0.2 ** (ngram_join.STEP - k) for k in range(ngram_join.STEP + 1)])
    alive, lost = np.ones(1), 0.0
    for n in range(ngram_join.STEP, ngram_join.HASHES + 1, ngram_join.STEP):
        alive = np.convolve(alive, step)
        lost += alive[: floor[n]].sum()
        alive[: floor[n]] = 0
    assert lost <= 1e-6


def test_large_family_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 10)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(60)]
    got = ngram_join.similarity_classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert {r["n_links"] for r in got} == {59} and {r["class_id"] for r in got} == {0}


def test_nnls_and_packing(spark, docs, odd, empty):
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    x = packing.nnls(a, np.array([4.0, 3.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [4, 3])
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = tokenize.encoder(path, True).tokenizer
    rows = packing.pack_documents(odd, path).collect()
    for i, t in ODD:
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == _digest(ids[at : at + r["length"]]) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("parts", [4, 211])
def test_packing_pads_little_however_many_tasks(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(parts)
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    row = rows.agg(F.countDistinct("sequence_id").alias("s"), F.sum("length").alias("n")).first()
    assert row["n"] / (row["s"] * packing.WINDOW) > 0.98
    again = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t")
    assert again.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 997])
def test_permutation_is_one_to_one(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))


def test_sharding(spark, odd, empty):
    rows = sharding.shard_rows(odd.unionByName(odd), 3).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(2 * len(ODD)))
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values()) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert {r["size"] for r in rows if r["doc_id"] == 0} == {16}
    assert sharding.shard_rows(empty, 3).count() == 0


def test_url_rules_and_reputation(spark):
    urls = ["http://www.Example.com/en/1?q", "http://a.example.com/en/2", "http://x.net/es/3#t", "http://x.net/de/4", None, "nothing", "https://a.com", "http://b.com/"]
    rows = [(k, u, None) for k, u in enumerate(urls)] + [(100 + k, "http://bad.org/p", 1) for k in range(60)] + [(300 + k, "http://good.org/p", 0) for k in range(60)] + [(900, "http://bad.org/q", None)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, bad int")).collect()}
    assert [got[k]["rule"] for k in range(8)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, "com/"]
    assert got[0]["host"] == "www.example.com" and got[0]["path"] == "/en/1" and (got[4]["host"], got[5]["path"]) == ("", "")
    assert got[900]["verdict"] == "block" and got[300]["verdict"] == "allow" and len(got) == len(rows)


def test_registered_domains_and_clashing_names(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.example.com:80": ("example.com", "com"), "10.0.0.1:8080": ("10.0.0.1", ""), "[::1]": ("[::1]", ""), "com": ("com", "com"), "": ("", ""), "co.uk": ("co.uk", "co.uk")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_filter.domain_of(F.col("host")).alias("d"), url_filter.suffix_of(F.col("host")).alias("s"))
    assert {r["host"]: (r["d"], r["s"]) for r in rows.collect()} == hosts
    pages = spark.createDataFrame([("http://a.co.uk/x", 1, 0.5, "r", "h"), (None, None, 0.5, "r", "h"), ("http://b.co.uk/x", None, 0.5, "r", "h")], "url string, bad int, bad_rate double, rule string, _rule string")
    got = url_filter.judge(pages)
    assert sorted(got.columns) == sorted(["url", "bad", "_rule", "host", "path", "rule", "bad_rate", "bad_rate_low", "verdict"])
    assert got.count() == 3 and url_filter.judge(pages.where("false")).count() == 0


def test_url_verdicts_by_either_join(spark, monkeypatch):
    pages = spark.createDataFrame([(f"http://h{k % 7}.example.org/{k}", k % 3 % 2 if k % 5 else None) for k in range(400)], "url string, bad int")
    once = sorted(url_filter.judge(pages).collect(), key=str)
    monkeypatch.setattr(url_filter, "FEW", 0)
    monkeypatch.setattr(url_filter, "HOT", 7)
    assert sorted(url_filter.judge(pages).collect(), key=str) == once and len(once) == 400


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = dict(components(edges).distinct().collect())
    assert all(got[k] == 0 for k in range(31)) and got[102] == 100 and len(got) == 34


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_cover_their_tables(spark, name):
    pages = name.startswith(("op3", "op5", "op10"))
    source = "pages" if pages else "embeddings" if name.startswith("op6") else "documents"
    key = {"pages": "page_id", "embeddings": "vec_id", "documents": "doc_id"}[source]
    want = spark.read.parquet(f"{SF}/{source}.parquet").select(key)
    assert queries.QUERIES[name](spark, SF).select(key).distinct().join(want, key).count() == want.count()

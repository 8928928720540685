"""The registered queries of the operators in this subpackage, with their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import compression_bands, decontaminate, embedding_dedup, hard_negatives, html_extract, ngram_join, packing, periodic_runs, sharding, token_output, toxicity, url_filter, warc
from siftmill.llm.shared import materialize, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second replica is written with one bit flipped in some records, which
    the audit has to find: those whose page_id has a crc32 of 5 modulo 997."""
    return warc.audit(table(spark, sf_dir, "pages"), lambda replica, page_id: replica == 1 and zlib.crc32(str(page_id).encode()) % 997 == 5)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = token_output.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 40).drop("row_number")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id is the number in its path; a page is
    bad if that document's quality label is 0."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = F.regexp_extract(url_filter.url_path(F.col("url")), r"/(\d{1,18})(?:/|\.html)?$", 1)
    pages = pages.withColumn("doc_id", shown.try_cast("long"))
    judged = url_filter.judge(pages.join(labels, "doc_id", "left").select("page_id", "url", "bad"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def with_periodic_tail(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of some documents, chosen by their id, with the end made periodic."""
    if doc_id is None or not words:
        return words
    g, h = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if h:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every run and of the collapsed text; the longest run by length over period."""
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), with_periodic_tail)
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    # longer first, then the earlier start and the shorter period; runs come in that order
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r.length * a.period > a.length * r.period, r).otherwise(a))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def op12_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands are learnt from the documents whose quality label is 1."""
    measures = materialize(compression_bands.measure(table(spark, sf_dir, "documents")), "measures")
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    judged = compression_bands.judge(measures, compression_bands.fit(measures, good))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "n_bytes", "ratio", "whole_failed", "chunks_failed")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components become whole numbers of 1/256; every seventh row takes the next label."""
    label = F.col("label").cast("int")

    def whole(x: Column) -> Column:
        x = x.cast("double") * 256
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)

    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform("embedding", whole).alias("embedding"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
    )
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_token_output": op4_token_output,
    "op5_html_extract": op5_html_extract,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_bands": op12_quality_bands,
    "op13_hard_negatives": op13_hard_negatives,
}


def _weight_sql(rows: str, rate: str) -> str:
    """The prior weight of a level by moments, as ``url_filter`` estimates it."""
    return (
        "SELECT coalesce(least(greatest(pq / greatest(v - noise, 1e-9::DOUBLE) - 1, 1), 1000), 1)::DOUBLE AS w FROM ("
        f"SELECT sum(n*pow(bad/n - {rate}, 2))/sum(n) AS v, sum({rate}*(1-{rate}))/sum(n) AS noise, sum(n*{rate}*(1-{rate}))/sum(n) AS pq FROM {rows} WHERE n > 0)"
    )


_SUFFIXES = ", ".join(f"'{x}'" for x in url_filter.SUFFIXES)
_URL_RULES = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for v, h, p in _URL_RULES]

#: Queries that SQL can express; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op10_url_filter": "WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url,''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,"
    " regexp_extract(coalesce(url,''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),"
    " l AS (SELECT doc_id, 1 - min(quality) AS bad FROM labels GROUP BY doc_id),"
    " p AS (SELECT u.*, l.bad FROM u LEFT JOIN l ON l.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:/|\\.html)?$', 1), '') AS BIGINT)),"
    " b AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS labels FROM p),"
    " t AS (SELECT *, regexp_matches(bare, '^([0-9]+([.][0-9]+){3}|\\[.*\\])$') AS address, array_to_string(labels[-2:], '.') AS two FROM b),"
    f" h AS (SELECT host, CASE WHEN address THEN bare WHEN two IN ({_SUFFIXES}) THEN array_to_string(labels[-3:], '.') ELSE two END AS domain,"
    f" CASE WHEN address THEN '' WHEN two IN ({_SUFFIXES}) THEN two ELSE labels[-1] END AS suffix, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM t GROUP BY ALL),"
    " d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY domain, suffix), s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM d GROUP BY suffix),"
    " s0 AS (SELECT s.*, (SELECT (sum(bad)+1)/(sum(n)+2) FROM s) AS r FROM s),"
    f" sw AS ({_weight_sql('s0', 'r')}), s1 AS (SELECT suffix, (bad+w*r)/(n+w) AS sr FROM s0, sw), d0 AS (SELECT d.*, sr AS r FROM d JOIN s1 ON d.suffix = s1.suffix),"
    f" dw AS ({_weight_sql('d0', 'r')}), d1 AS (SELECT domain, suffix, (bad+w*r)/(n+w) AS dr FROM d0, dw), h0 AS (SELECT h.*, dr AS r FROM h JOIN d1 ON h.domain = d1.domain AND h.suffix = d1.suffix),"
    f" hw AS ({_weight_sql('h0', 'r')}), h1 AS (SELECT host, (bad+w*r)/(n+w) AS m, n+w AS t FROM h0, hw),"
    f" k AS (SELECT host, m - {url_filter.Z}::DOUBLE*sqrt(m*(1-m)/(t+1)) AS low FROM h1)"
    f" SELECT page_id, p.host, path, CASE {' '.join(f"WHEN {f} THEN '{r}'" for f, r, _ in _FITS).replace('host', 'p.host')} END AS rule,"
    f" CASE {' '.join(f"WHEN {f} THEN '{v}'" for f, _, v in _FITS).replace('host', 'p.host')} WHEN low >= {url_filter.LIMIT}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict FROM p LEFT JOIN k ON p.host = k.host",
    "op6_embedding_dedup": "WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),"
    " e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) >= 0.9::DOUBLE * sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x))),"
    " reach AS (SELECT vec_id AS n, vec_id AS r FROM v UNION SELECT e.b, reach.r FROM reach JOIN e ON reach.n = e.a WHERE e.b > reach.r),"
    " c AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n)"
    " SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON n = vec_id",
    "op13_hard_negatives": "WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings"
    " WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),"
    " s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),"
    " p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)"
    " SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score"
    " FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10",
    "op7_ngram_join": "WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text,'')), '[\\p{L}\\p{N}_]+') AS w FROM documents),"
    " g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM w),"
    " x AS (SELECT doc_id, unnest(g) AS s FROM g), n AS (SELECT doc_id, len(g) AS n FROM g),"
    " c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),"
    " e AS (SELECT a, b, k = p.n AND k = q.n AS same FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE k >= 0.8::DOUBLE * (p.n + q.n - k) - 1e-9::DOUBLE),"
    " reach AS (SELECT doc_id AS n, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON reach.n = e.a WHERE e.b > reach.r),"
    " m AS (SELECT n, min(r) AS class_id FROM reach GROUP BY n)"
    " SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM e WHERE e.a = d.doc_id AND same), d.doc_id)) AS rep_id, class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links FROM documents d JOIN m ON m.n = d.doc_id",
}

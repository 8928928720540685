"""Column expressions over text: normalisation, ids, shingles, tags, language."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalize(text: Column) -> Column:
    """Lower-cased, white space folded, trimmed; NULL becomes empty. Equal to full
    normalisation for texts that are in NFKC form; see ``normalize_frame``."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def normalize_frame(df: DataFrame, text: str = "text", into: str = "norm") -> DataFrame:
    """Full NFKC normalisation; only rows with non-ASCII text visit Python."""
    plain = F.coalesce(F.col(text), F.lit("")).rlike(r"^\p{ASCII}*$")
    ascii_rows = df.where(plain).withColumn(into, normalize(F.col(text)))
    other = df.where(~plain).withColumn(into, normalize(_nfkc(F.col(text))))
    return ascii_rows.unionByName(other)


def make_id(source: Column, norm: Column) -> Column:
    return F.concat(source, F.lit(":"), F.substring(F.sha1(norm), 1, 12))


def words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row: inside a lambda the optimizer would
    otherwise repeat the value's expression for every element."""
    return F.transform(F.array(value), body)[0]


def shingles(norm: Column, k: int = 5) -> Column:
    """Distinct k-word shingles; a shorter text is one shingle, an empty one none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(many))

    return let(words(norm), of)


def base_hash(s: Column) -> Column:
    """First 8 bytes of sha1, big-endian, modulo 2^31 - 1."""
    return (F.conv(F.substring(F.sha1(s), 1, 16), 16, 10).cast("decimal(20,0)") % 2147483647).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets are equal."""
    inter, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / union)


def ascii_letter_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    solid = F.length(F.regexp_replace(text, SPACE, ""))
    return F.when(solid > 0, letters / solid)


def english_looking(text: Column, least: float = 0.8) -> Column:
    return F.coalesce(ascii_letter_ratio(text) >= F.lit(least), F.lit(False))


def split_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ";"), F.trim), lambda t: t != "")


def join_tags(tags: Column) -> Column:
    return F.array_join(F.array_distinct(tags), ";")


def has_tag(tags: Column, tag: str) -> Column:
    return F.array_contains(split_tags(tags), tag)


def strip_code(text: Column) -> Column:
    """Fenced code, then inline code, made a space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`\n]+`", " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def strip_punctuation(token: Column) -> Column:
    return F.regexp_replace(token, r"^\p{Punct}+|\p{Punct}+$", "")


def first_human_turn(transcript: Column) -> Column:
    got = F.trim(F.regexp_extract(transcript, r"(?is)Human:\s*(.*?)(?:\n\n\s*(?:Human|Assistant):|\z)", 1))
    return F.when(got != "", got)


# Function words by which a text's language is guessed.
STOPWORDS = {
    "es_pt": "el la los las de que y en un una es por para no se con como pero sus le ya esta muy sin sobre tambien nao voce isso mais muito foi pelo pela esse essa sao uma".split(),
    "fr": "le la les de des et un une est que pour dans ne pas se ce qui sur avec comme mais plus tout nous vous ils elles tres cette leur".split(),
    "de": "der die das und ist nicht ich du er sie es ein eine zu mit auf fur von dem den im sich auch aber wie was sind werden nach".split(),
}


def language_bucket(text: Column, least: int = 2, most_foreign: float = 0.3) -> Column:
    """non_latin_script, es_pt, fr, de, en_or_other or unknown (no letters)."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    foreign = F.length(F.regexp_replace(text, r"[^\p{L}]|[\x{0}-\x{24F}]", ""))
    seen = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-zA-Z\x{C0}-\x{24F}]+)"), 1))
    # each regular expression runs once a text, and each intersection once
    counts = let(seen, lambda w: F.struct(*[F.size(F.array_intersect(w, F.array(*map(F.lit, words_)))).alias(lang) for lang, words_ in STOPWORDS.items()]))

    def named(hits: Column) -> Column:
        top = F.greatest(*[hits[lang] for lang in STOPWORDS])
        best = F.lit(None).cast("string")
        for lang in reversed(STOPWORDS):
            best = F.when(hits[lang] == top, F.lit(lang)).otherwise(best)
        return F.when(top >= least, best).otherwise("en_or_other")

    def bucket(n: Column) -> Column:
        return F.when(F.coalesce(n["all"], F.lit(0)) == 0, "unknown").when(n["foreign"] / n["all"] > most_foreign, "non_latin_script").otherwise(let(counts, named))

    return let(F.struct(letters.alias("all"), foreign.alias("foreign")), bucket)

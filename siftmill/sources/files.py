"""Reading mixed-format folders and writing tables."""

from __future__ import annotations

import hashlib
import json
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftmill.schema import CAT_TAGS, GOLD_WITH_SCOPE, HARD_NEGATIVE, HN_TAGS

FORMATS = {"parquet": ("*.parquet",), "csv": ("*.csv",), "json": ("*.json", "*.jsonl", "*.jsonl.gz", "*.json.gz")}
CSV = {"header": True, "multiLine": True, "escape": '"'}


def find_files(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Data files below a folder by format, sorted; listed by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, list[str]] = {k: [] for k in FORMATS}
    if not fs.exists(path):
        return out
    it = fs.listFiles(path, True)
    while it.hasNext():
        name = it.next().getPath().toString()
        for fmt, globs in FORMATS.items():
            if any(name.lower().endswith(g[1:]) for g in globs):
                out[fmt].append(name)
    return {k: sorted(v) for k, v in out.items()}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; else a whole document: a list is its rows, an object with one
    list of objects is that list, one without a list is a row, more are an error."""
    lines = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if "_corrupt" not in lines.columns:
        return lines
    whole = spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in whole.columns:
        raise ValueError(f"{path} is neither JSON lines nor a JSON document")
    lists = [f.name for f in whole.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if len(lists) > 1:
        raise ValueError(f"{path} has more than one list: {lists}")
    return whole.select(F.explode(lists[0]).alias("r")).select("r.*") if lists else whole


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, JSON or CSV by suffix. CSV columns are strings unless a schema says otherwise."""
    low = path.lower().rstrip("/")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".json", ".jsonl", ".gz")):
        return read_json(spark, path)
    reader = spark.read.options(**CSV)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder with the union of their columns, and ``_file``."""
    found = find_files(spark, folder)
    parts = []
    if found["parquet"]:
        parts.append(spark.read.option("mergeSchema", True).parquet(*found["parquet"]).withColumn("_file", F.col("_metadata.file_path")))
    for path in found["csv"]:
        parts.append(spark.read.options(**CSV).csv(path).withColumn("_file", F.lit(path)))
    for path in found["json"]:
        parts.append(read_json(spark, path).withColumn("_file", F.lit(path)))
    if not parts:
        raise FileNotFoundError(f"no data files below {folder}")
    out = parts[0]
    for p in parts[1:]:
        out = union(out, p)
    return out


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """By name, missing columns NULL, columns of different types as strings."""
    kinds = dict(b.dtypes)
    clash = [c for c, t in a.dtypes if c in kinds and kinds[c] != t]
    if clash:
        a, b = (x.withColumns({c: F.col(c).cast("string") for c in clash}) for x in (a, b))
    return a.unionByName(b, allowMissingColumns=True)


def write_any(df: DataFrame, path: str, single: bool = False) -> None:
    """Parquet or CSV by suffix; ``single`` for sheets that people open."""
    out = df.coalesce(1) if single else df
    if path.lower().endswith(".csv"):
        out.write.mode("overwrite").options(header=True, escape='"').csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


def append_new(new: DataFrame, path: str, key: str = "id", fill: dict | None = None) -> int:
    """Append the rows whose key the table at ``path`` lacks; how many they were. Running it
    again adds nothing.

    Before its first rows the table is copied to ``path.bak``, once. Columns that only one
    side has are filled, old rows and new ones, with the value in ``fill`` or null; where the
    old rows gain a column, the table is written anew beside itself and swapped in, and
    a swap that was cut short is finished by the next call."""
    spark, fill = new.sparkSession, fill or {}
    old_at, next_at = f"{path}.before", f"{path}.next"
    if not exists(spark, path) and exists(spark, old_at):
        move(spark, next_at if exists(spark, f"{next_at}/_SUCCESS") else old_at, path)
    old = spark.read.parquet(path)

    def filled(df: DataFrame, like: DataFrame) -> DataFrame:
        kinds = dict(like.dtypes)
        return df.withColumns({c: F.lit(fill.get(c)).cast(kinds[c]) for c in like.columns if c not in df.columns})

    fresh = filled(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), old)
    added = [c for c in new.columns if c not in old.columns]
    fresh = fresh.select(*old.columns, *added).persist()
    n = fresh.count()
    if n:
        if not exists(spark, f"{path}.bak"):
            copy(spark, path, f"{path}.bak")
        if added:
            filled(old, fresh).unionByName(fresh).write.mode("overwrite").parquet(next_at)
            delete(spark, old_at)
            move(spark, path, old_at)
            move(spark, next_at, path)
            delete(spark, old_at)
        else:
            fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Hadoop's file system, over one that is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, path: str, figures: dict) -> None:
    """Figures as one JSON document; NaN as null."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return None if isinstance(x, float) and x != x else x

    write_text(spark, path, json.dumps(plain(figures), indent=2, sort_keys=True) + "\n")


def load_processed(spark: SparkSession, folder: str, names: list[str], schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """The tables ``<name>.parquet`` of a folder that are there, by name of columns, and the
    names that are not; an empty frame of ``schema`` if none is."""
    jvm = spark.sparkContext._jvm
    out, missing = None, []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            missing.append(name)
            continue
        part = spark.read.parquet(path.toString())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return (spark.createDataFrame([], schema) if out is None else out), missing


def read_labels(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """All label sheets that match a glob, as strings: trimmed, blanks and missing columns as "".
    No match is an empty frame of that shape."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    out = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    for name in sorted(f.getPath().toString() for f in found or []):
        part = spark.read.options(**CSV).csv(name)
        out = out.unionByName(part.select(*[c for c in columns if c in part.columns]), allowMissingColumns=True)
    return out.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in columns])


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row, NaN as null and nulls kept."""
    cols = [F.nanvl(F.col(c), F.lit(None)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def label_tasks(sample: DataFrame) -> DataFrame:
    """Annotation-tool tasks: {"data": {id, text, split}} per row."""
    return sample.select(F.to_json(F.struct(F.struct(*[F.col(c) for c in ("id", "text", "split") if c in sample.columns]).alias("data"))).alias("value"))


def label_sheet(sample: DataFrame, key: str = "id") -> DataFrame:
    """A sheet to label by hand: id, text, split, what is known of the source, blank gold, tags and
    notes, and the allowed labels and tags down the first rows, for the validation of cells.
    Rows go by ``key``; only as many as there are allowed values are put in order."""
    lists = {"_ref_gold": GOLD_WITH_SCOPE, "_ref_tags": [HARD_NEGATIVE, *CAT_TAGS, *HN_TAGS]}
    first = sample.select(key).orderBy(key).limit(max(map(len, lists.values())))
    places = first.withColumn("_place", F.row_number().over(Window.orderBy(key)))
    known = [c for c in ("source", "source_label") if c in sample.columns]
    rows = sample.join(F.broadcast(places), key, "left")
    padded = [F.coalesce(F.get(F.array(*map(F.lit, values)), F.col("_place") - 1), F.lit("")).alias(name) for name, values in lists.items()]
    return rows.select(key, "text", "split", *known, *[F.lit("").alias(c) for c in ("gold", "tags", "notes", "labeler_pass", "labeled_at")], *padded)


def label_config() -> str:
    """The annotation tool's interface for the tasks of ``label_tasks``: a label, the tags that it
    may carry, notes. Its names are those that ``read_label_export`` reads."""
    view = ElementTree.Element("View")
    ElementTree.SubElement(view, "Text", name="text", value="$text")

    def choices(name: str, title: str, values: list[str], only: str | None = None, **more: str) -> None:
        shown = {"visibleWhen": "choice-selected", "whenTagName": "gold", "whenChoiceValue": only} if only else {}
        ElementTree.SubElement(view, "Header", value=title, **shown)
        group = ElementTree.SubElement(view, "Choices", name=name, toName="text", showInline="true", **more, **shown)
        for value in values:
            ElementTree.SubElement(group, "Choice", value=value)

    choices("gold", "Label", GOLD_WITH_SCOPE, choice="single", required="true")
    choices("cat_tags", "Kind of danger", CAT_TAGS, "dangerous", choice="multiple")
    choices("hn_tags", "Kind of hard negative", HN_TAGS, "benign", choice="multiple")
    ElementTree.SubElement(view, "Header", value="Notes")
    ElementTree.SubElement(view, "TextArea", name="notes", toName="text", rows="3", maxSubmissions="1", editable="true")
    ElementTree.indent(view)
    return ElementTree.tostring(view, encoding="unicode") + "\n"


def read_label_export(spark: SparkSession, path: str, default_pass: int, default_date: str) -> DataFrame:
    """Annotation-tool export: the last annotation of each task wins."""
    item = "struct<from_name:string,value:struct<choices:array<string>,text:array<string>>>"
    notes = f"array<struct<result:array<{item}>>>"
    schema = f"data struct<id:string,text:string>, annotations {notes}, completions {notes}"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    last = F.try_element_at(F.coalesce("annotations", "completions"), F.lit(-1))["result"]

    def named(name: str):
        return F.try_element_at(F.filter(last, lambda r: r["from_name"] == name), F.lit(1))["value"]

    gold = F.try_element_at(named("gold")["choices"], F.lit(1))
    return rows.select(
        F.col("data.id").alias("id"), F.coalesce(gold, F.lit("")).alias("gold"), F.coalesce(F.array_join(named("tags")["choices"], ";"), F.lit("")).alias("tags"),
        F.coalesce(F.try_element_at(named("notes")["text"], F.lit(1)), F.lit("")).alias("notes"), F.lit(default_pass).alias("labeler_pass"), F.lit(default_date).alias("labeled_at"),
    )


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.options(**CSV).csv(path)
    return df.drop(*[c for c in df.columns if c.startswith("_ref_")])


def dictionary_words(lines: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Words of a Hunspell dictionary (column ``value``): two or more a-z letters before the flags."""
    words = lines.select(F.split("value", "/")[0].alias("word")).where(F.col("word").rlike("^[a-z]{2,}$"))
    if extra:
        words = words.unionByName(lines.sparkSession.createDataFrame([(w,) for w in extra], "word string"))
    return words.distinct()


def words_digest(words: DataFrame) -> str:
    """SHA-256 of the words in order, a line each, as their file would have it. A dictionary is small."""
    told = "".join(r["word"] + "\n" for r in words.select("word").orderBy("word").toLocalIterator())
    return hashlib.sha256(told.encode()).hexdigest()


def write_sidecar(spark: SparkSession, path: str, figures: dict) -> None:
    write_json(spark, path, figures)


def cached_vectors(df: DataFrame, path: str, model: str, embed) -> DataFrame:
    """(id, embedding) through a Parquet cache keyed by (model, id): only ids it lacks are embedded.
    ``embed(df)`` gives (id, embedding)."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).where(F.col("model") == model)
        fresh = df.join(have.select("id"), "id", "left_anti")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        fresh = df
    embed(fresh).withColumn("model", F.lit(model)).write.mode("append").parquet(path)
    return df.select("id").join(spark.read.parquet(path).where(F.col("model") == model).select("id", "embedding"), "id")


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there or is a file."""
    fs, at = _hadoop(spark, folder)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(at))


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, at = _hadoop(spark, path)
    if not fs.rename(at, _hadoop(spark, to)[1]):
        raise OSError(f"{path} cannot be renamed to {to}")


def copy(spark: SparkSession, path: str, to: str) -> None:
    (fs, at), (other, there) = _hadoop(spark, path), _hadoop(spark, to)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, other, there, False, True, conf)

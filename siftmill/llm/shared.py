"""Shared storage, materialisation and graph helpers of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session that names none gets a temporary one, which only a local master
    can share with its executors; any other master is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="siftmill-")
    sc.setCheckpointDir(own)
    return own


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, drop: Callable[[], None] = lambda: None) -> None:
    """Called as a task begins and ends in a Python worker: caches that another operator
    left there are dropped and freed memory, Arrow's too, goes back to the system."""
    import pyarrow as pa

    for other in [k for k in _HELD if k != owner]:
        _HELD.pop(other)()
    _HELD[owner] = drop
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/siftmill/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared folder once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at that table."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores put to its end, such that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """pyarrow's filesystem and the path in it, for binary files of the shared folder."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str) -> Iterator:
    """A stream into a file that bears a private name until the block ends, and is then
    renamed: readers see all or nothing, and a block that fails leaves no file. A file that
    is there already, written by a repeated or speculative task, has equal bytes; stores
    that do not rename over it leave it in place."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(private, compression=None) as out:
            yield out
    except BaseException:
        if fs.get_file_info(private).type.name == "File":
            fs.delete_file(private)
        raise
    try:
        fs.move(private, path)
    except OSError:
        if fs.get_file_info(path).type.name != "File":
            raise
        fs.delete_file(private)


def write_file(uri: str, data: bytes) -> None:
    with writing(uri) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def reading(uri: str):
    """A stream over a file's bytes, closed at the end of a ``with`` block."""
    fs, path = filesystem(uri)
    return fs.open_input_stream(path, compression=None)


def read_range(uri: str, start: int, length: int) -> bytes:
    """So many bytes of a file from a place in it; fewer where it ends."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


#: Parts that a key's rows are split into where many rows may have one key.
SALTS = 32


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row per key: rows of one key go to
    ``SALTS`` tasks by a hash of ``by``. Facts are repeated only for the parts that a key has."""
    salt = free_name(rows, "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    return salted.join(salted.select(*keys, salt).distinct().join(facts, keys), [*keys, salt]).drop(salt)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component
    being the smallest node reachable. Only nodes that have an edge are returned.

    Alternating large-star and small-star steps (Kiveris et al., 2014). A step
    is one aggregate and one equi-join split by neighbours, so no neighbourhood is
    ever gathered in one task, and it links every node straight to a smaller one; the number of
    rounds grows with the logarithm of the graph's size. Each round ends in a
    table in the shared folder; the table before is removed.
    """
    spark = edges.sparkSession
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur, path = materialize_at(cur, "edges")
    seen = _signature(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both, low, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            split_join(large, least, ["u"], ["v"])
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt, nxt_path = materialize_at(small, "edges")
        now = _signature(nxt)
        remove(spark, path)
        cur, path = nxt, nxt_path
        if now == seen:
            break
        seen = now
    pairs = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]

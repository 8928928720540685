"""WARC output with a Merkle fixity audit of replicas (operator 3).

Archives are WARC 1.0 files of one gzip member per record, cut at ``FILE_BYTES`` and
written with an index of the records' offset ranges. Files are written, hashed and read
as streams: a task holds one record and its index, however long the file. For every replica each file
gets a Merkle tree: a leaf digests one record's bytes, an inner node its
children's digests together with the offset range they span, ``FAN`` children a
node, up to the file's root; one digest over all file roots stands for the replica. The
audit compares those, then the roots, and goes down only where digests differ,
level by level, to the records that are damaged.

Defined cases: null url or html are written empty and a null page_id as "-";
repeated rows are records each; an empty table has no file and the audit no row;
a missing or cut-off file counts as damage to the records it lacks; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.shared import materialize, new_path, reading, writing

FAN = 16
#: Compressed bytes after which a task begins its next file, and index rows told at once.
FILE_BYTES, INDEX_ROWS = 256 << 20, 20_000
#: Bytes read at once.
CHUNK = 1 << 20
DATE = "2020-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One gzip member holding a WARC resource record; equal input, equal bytes."""
    body = (html or "").encode("utf-8", "surrogatepass")
    name = "-" if page_id is None else str(page_id)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    told = uuid.UUID(bytes=hashlib.sha256(f"{name} {target}".encode("utf-8", "surrogatepass") + body).digest()[:16])
    head = (
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {target}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:uuid:{told}>\r\n"
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nPage-ID: {name}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return gzip.compress(head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 6, mtime=0)


def parse(source: BinaryIO) -> Iterator[dict]:
    """The records of a stream of WARC bytes: header fields, body and digest check."""
    data = source.read(CHUNK)
    while data:
        member, raw = zlib.decompressobj(31), []
        while data and not member.eof:
            raw.append(member.decompress(data))
            data = member.unused_data if member.eof else source.read(CHUNK)
        data = data or source.read(CHUNK)
        head, _, rest = b"".join([*raw, member.flush()]).partition(b"\r\n\r\n")
        fields = dict(line.partition(": ")[::2] for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        body = rest[: int(fields["Content-Length"])]
        yield fields | {"body": body, "intact": "sha256:" + hashlib.sha256(body).hexdigest() == fields["WARC-Block-Digest"]}


def write_archive(pages: DataFrame, folders: list[str], damage: Callable[[int, int | None], bool] | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to each folder. Returns the index
    (file, ordinal, page_id, offset, length). ``damage(replica, page_id)``, for trials
    of the audit, flips a bit in the middle of the chosen records of a replica."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in frames:
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                yield None if pd.isna(page_id) else int(page_id), url, html

    def told(name: str, ids: list[int | None], lens: list[int], ordinal: int, offset: int) -> pd.DataFrame:
        length = np.array(lens, np.int64)
        return pd.DataFrame({"file": name, "ordinal": ordinal + np.arange(len(ids)), "page_id": pd.array(ids, "Int64"), "offset": offset + np.cumsum(length) - length, "length": length})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = rows(frames)
        first = next(left, None)
        part = 0
        while first is not None:
            name = f"pages-{TaskContext.get().partitionId():06d}-{part:04d}.warc.gz"
            part += 1
            ids: list[int | None] = []
            lens: list[int] = []
            ordinal = offset = at = 0
            with ExitStack() as files:
                outs = [files.enter_context(writing(f"{folder}/{name}")) for folder in folders]
                while first is not None and at < file_bytes:
                    data = record(*first)
                    for k, out in enumerate(outs):
                        out.write(_flip(data) if damage and damage(k, first[0]) else data)
                    ids.append(first[0])
                    lens.append(len(data))
                    at += len(data)
                    first = next(left, None)
                    if len(ids) == INDEX_ROWS:
                        yield told(name, ids, lens, ordinal, offset)
                        ordinal, offset, ids, lens = ordinal + len(ids), at, [], []
            if ids:
                yield told(name, ids, lens, ordinal, offset)

    thin = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return materialize(thin.mapInPandas(run, "file string, ordinal long, page_id long, offset long, length long"), "warc-index")


def _flip(data: bytes) -> bytes:
    at = len(data) // 2
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]


def read_archive(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """Pages back from an archive: page_id, url, html, intact."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name in pdf["file"]:
                with reading(f"{folder}/{name}") as source:
                    got, held = [], 0
                    for r in parse(source):
                        got.append((None if r["Page-ID"] == "-" else int(r["Page-ID"]), r["WARC-Target-URI"], r["body"].decode("utf-8", "surrogatepass"), r["intact"]))
                        held += len(r["body"])
                        if held > CHUNK or len(got) == INDEX_ROWS:
                            yield _pages(got)
                            got, held = [], 0
                if got:
                    yield _pages(got)

    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    return names.mapInPandas(run, "page_id long, url string, html string, intact boolean")


def _pages(got: list[tuple]) -> pd.DataFrame:
    ids, url, html, intact = zip(*got)
    return pd.DataFrame({"page_id": pd.array(ids, "Int64"), "url": url, "html": html, "intact": intact})


def leaves(source: BinaryIO, lengths: np.ndarray) -> list[bytes]:
    """Digests of consecutive records of a stream; what a cut-off file lacks is empty."""
    return [hashlib.sha256(b"\0" + source.read(n)).digest() for n in lengths.tolist()]


def tree(leaves: list[bytes], offsets: np.ndarray, lengths: np.ndarray) -> list[list[bytes]]:
    """Levels of a file's Merkle tree, leaves first, root last."""
    levels = [leaves]
    ends = offsets + lengths
    span = 1
    while len(levels[-1]) > 1:
        span *= FAN
        below = levels[-1]
        level = []
        for k in range(0, len(below), FAN):
            first, last = k * span // FAN, min(len(offsets), (k + FAN) * span // FAN) - 1
            level.append(hashlib.sha256(b"\1" + struct.pack("<qq", offsets[first], ends[last]) + b"".join(below[k : k + FAN])).digest())
        levels.append(level)
    return levels


def trees(index: DataFrame, folder: str) -> DataFrame:
    """All nodes of all files of a replica: file, level (0: records), node, top, digest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        name, offsets, lengths = pdf["file"].iloc[0], pdf["offset"].to_numpy(), pdf["length"].to_numpy()
        try:
            with reading(f"{folder}/{name}") as source:
                digests = leaves(source, lengths)
        except FileNotFoundError:
            digests = leaves(io.BytesIO(), lengths)
        levels = tree(digests, offsets, lengths)
        rows = [(name, k, i, len(levels) - 1, d) for k, level in enumerate(levels) for i, d in enumerate(level)]
        return pd.DataFrame(rows, columns=["file", "level", "node", "top", "digest"])

    made = index.select("file", "ordinal", "offset", "length").groupBy("file").applyInPandas(run, "file string, level int, node long, top int, digest binary")
    return materialize(made, "merkle")


def root(nodes: DataFrame) -> str:
    """The digest of a replica: over its files' roots in order of their names."""
    tops = nodes.where("level = top").select("file", "digest").orderBy("file").collect()
    return hashlib.sha256(b"".join(r["file"].encode() + r["digest"] for r in tops)).hexdigest()


def damaged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records (file, ordinal) whose leaves differ between two replicas' trees."""
    spark = a.sparkSession
    none = spark.createDataFrame([], "file string, ordinal long")
    if root(a) == root(b):
        return none
    theirs = b.select("file", "level", "node", F.col("digest").alias("other"))
    open_nodes = spark.createDataFrame([], "file string, node long")
    for level in range(a.agg(F.max("top")).first()[0], -1, -1):
        here = a.where(F.col("level") == level)
        parents = open_nodes.select("file", F.col("node").alias("parent"))
        under = here.where("level < top").withColumn("parent", F.floor(F.col("node") / FAN)).join(parents, ["file", "parent"], "left_semi")
        # roots of files, and children of nodes that differ
        asked = here.where("level = top").select("file", "level", "node", "digest").unionByName(under.select("file", "level", "node", "digest"))
        differ = asked.join(theirs.where(F.col("level") == level), ["file", "level", "node"]).where("digest <> other")
        open_nodes = materialize(differ.select("file", "node"), "open")
    return open_nodes.select("file", F.col("node").alias("ordinal"))


def audit(pages: DataFrame, damage: Callable[[int, int | None], bool] | None = None, folder: str | None = None) -> DataFrame:
    """Archive ``pages`` in two replicas and audit them: one row per record with
    page_id, file, offset, length, digest (of the first replica's leaf) and corrupt."""
    base = folder or new_path(pages.sparkSession, "warc")
    folders = [f"{base}/replica-{k}" for k in (0, 1)]
    index = write_archive(pages, folders, damage)
    first, second = (trees(index, f) for f in folders)
    bad = damaged(first, second).withColumn("corrupt", F.lit(True))
    leaves = first.where("level = 0").select("file", F.col("node").alias("ordinal"), F.lower(F.hex("digest")).alias("digest"))
    out = index.join(leaves, ["file", "ordinal"]).join(bad, ["file", "ordinal"], "left")
    return out.select("page_id", "file", "offset", "length", "digest", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))

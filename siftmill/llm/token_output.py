"""Token-id files with a minimal perfect hash index (operator 4).

File format. A shard ``shard-NNNNNN.ids`` is the 8 bytes ``SMIDS`` + width + two
zero bytes, then raw little-endian ids of that width (2 bytes when the
vocabulary fits, else 4), document after document in ascending doc_id order;
shards follow each other in that order too. ``index-NNNNNN.mph`` maps the keys of
one hash bucket to (shard, offset, length). It holds a minimal perfect hash of
levels of bit arrays (Limasset et al., 2017): a key's slot is the rank of the
first bit it owns alone, found in a constant expected number of probes. A stored
32-bit fingerprint per slot turns away keys that were never indexed. Keys are 64-bit hashes:
a row whose key an earlier row has stands at the file's end, under its doc_id and copy
number in full. ``table.json``
has the folder's totals and the number of hash buckets.

Defined cases: null text is an empty document (its end id alone); a null doc_id
is a key of its own and sorts first; rows that repeat a doc_id are all kept,
ordered by a hash of their text, and keyed by (doc_id, copy number); an empty table gives
no file and no row; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import materialize, new_path, read_file, read_range, write_file, writing
from siftmill.llm.tokenize import encoder

END_ID = 1
#: Keys of an index file, about.
BUCKET = 50_000
#: Ids read at once from a shard, about.
STRETCH = 4_000_000
_HEAD = 8
_TABLE = "table.json"
_ENTRY = np.dtype([("shard", "<u4"), ("length", "<u4"), ("offset", "<u8")])
_TWIN = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("copy", "<i4"), *_ENTRY.descr])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys that are hashes already."""
    with np.errstate(over="ignore"):
        x = keys + _MIX * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys with fingerprints."""

    GAMMA, SEED_OF_PRINT = 2.0, 10_007
    #: Bits of a block of a level, and its bytes with the rank of its first bit.
    BLOCK, STRIDE = 512, 68

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray):
        self.levels, self.prints = levels, prints
        self.ranks = []
        before = 0
        for bits in levels:
            self.ranks.append(before + np.concatenate([[0], np.cumsum(bits)]))
            before += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        keys = keys.astype(np.uint64)
        left, levels = keys, []
        while len(left):
            size = int(max(64, cls.GAMMA * len(left)))
            at = _mix(left, len(levels)) % np.uint64(size)
            hits = np.bincount(at.astype(np.int64), minlength=size)
            levels.append(hits == 1)
            left = left[hits[at.astype(np.int64)] > 1]
            if len(levels) > 64:
                raise ValueError("keys are not distinct")
        made = cls(levels, np.zeros(len(keys), np.uint32))
        if len(keys):
            made.prints[made._slot(keys)] = cls._print(keys)
        return made

    @classmethod
    def _print(cls, keys: np.ndarray) -> np.ndarray:
        return (_mix(keys, cls.SEED_OF_PRINT) >> np.uint64(32)).astype(np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        slot = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            slot[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where the key is not in the index."""
        keys = keys.astype(np.uint64)
        slot = self._slot(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == self._print(keys[ok])
        return np.where(ok, slot, -1)

    def to_bytes(self) -> bytes:
        """Level and key counts, the levels' sizes, per level blocks of a rank and ``BLOCK``
        bits, then the fingerprints: every part of a probe lies at a computable place."""
        parts = [struct.pack("<II", len(self.levels), len(self.prints)), np.array([len(b) for b in self.levels], "<u4").tobytes()]
        for bits, ranks in zip(self.levels, self.ranks):
            blocks = -(-len(bits) // self.BLOCK)
            packed = np.packbits(np.pad(bits, (0, blocks * self.BLOCK - len(bits))), bitorder="little").reshape(blocks, -1)
            before = ranks[: -1 : self.BLOCK].astype("<u4").view(np.uint8).reshape(blocks, 4)
            parts.append(np.hstack([before, packed]).tobytes())
        return b"".join([*parts, self.prints.astype("<u4").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple["PerfectHash", int]:
        n_levels, n = struct.unpack_from("<II", data)
        at, levels = 8 + 4 * n_levels, []
        for size in np.frombuffer(data, "<u4", n_levels, 8).tolist():
            blocks = -(-size // cls.BLOCK)
            packed = np.frombuffer(data, np.uint8, blocks * cls.STRIDE, at).reshape(blocks, cls.STRIDE)[:, 4:]
            levels.append(np.unpackbits(packed, bitorder="little")[:size].astype(bool))
            at += blocks * cls.STRIDE
        return cls(levels, np.frombuffer(data, "<u4", n, at)), at + 4 * n


class Table:
    """Keyed access to a folder of ids from any one process. A key costs a few reads of
    fixed size: the bits it probes (a constant number expected), its fingerprint, its
    entry, and its ids; only the folder's totals, index heads and rows of shared keys are kept."""

    def __init__(self, folder: str):
        self.folder = folder
        self.buckets = json.loads(read_file(f"{folder}/{_TABLE}"))["buckets"]
        self.heads: dict[int, tuple[int, list[int], dict]] = {}

    def entry(self, doc_id: int | None, copy: int = 0) -> tuple[int, int, int] | None:
        """(shard, offset, length) of a key; None where it is not in the index."""
        key = key_of(doc_id, copy)
        bucket = key.view(np.int64).item() % self.buckets
        path = f"{self.folder}/index-{bucket:06d}.mph"
        if bucket not in self.heads:
            try:
                n_levels, n = struct.unpack("<II", read_range(path, 0, 8))
            except FileNotFoundError:  # no key fell into this bucket
                return None
            sizes = np.frombuffer(read_range(path, 8, 4 * n_levels), "<u4").tolist()
            end = 8 + 4 * n_levels + sum(-(-z // PerfectHash.BLOCK) for z in sizes) * PerfectHash.STRIDE + (4 + _ENTRY.itemsize) * n
            count = struct.unpack("<I", read_range(path, end, 4))[0]
            self.heads[bucket] = n, sizes, _twins(read_range(path, end + 4, count * _TWIN.itemsize))
        n, sizes, twins = self.heads[bucket]
        if (doc_id, copy) in twins:
            return twins[doc_id, copy]
        at, slot = 8 + 4 * len(sizes), -1
        asked = np.array([key])
        for level, size in enumerate(sizes):
            if slot < 0:
                bit = int(_mix(asked, level)[0] % np.uint64(size))
                block, within = divmod(bit, PerfectHash.BLOCK)
                got = read_range(path, at + block * PerfectHash.STRIDE, PerfectHash.STRIDE)
                bits = np.unpackbits(np.frombuffer(got, np.uint8, offset=4), bitorder="little")
                if bits[within]:
                    slot = struct.unpack_from("<I", got)[0] + int(bits[:within].sum())
            at += -(-size // PerfectHash.BLOCK) * PerfectHash.STRIDE
        if slot < 0 or struct.unpack("<I", read_range(path, at + 4 * slot, 4))[0] != int(PerfectHash._print(asked)[0]):
            return None
        shard, length, offset = struct.unpack("<IIQ", read_range(path, at + 4 * n + _ENTRY.itemsize * slot, _ENTRY.itemsize))
        return shard, offset, length

    def ids(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        found = self.entry(doc_id, copy)
        if found is None:
            return None
        shard, offset, length = found
        path = f"{self.folder}/shard-{shard:06d}.ids"
        width = read_range(path, 0, _HEAD)[5]
        return np.frombuffer(read_range(path, _HEAD + width * offset, width * length), f"<u{width}")


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, keeps_space: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the shards. Returns the manifest
    (doc_id, copy, shard, offset, n_tokens), offsets in ids within the shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, keeps_space)
        width = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
        shard, out, at, last, copy = TaskContext.get().partitionId(), None, 0, (), 0
        with ExitStack() as files:
            for batch in batches:
                ids, starts = enc.encode(batch.column(1), END_ID)
                if out is None:
                    out = files.enter_context(writing(f"{folder}/shard-{shard:06d}.ids"))
                    out.write(b"SMIDS" + bytes([int(width[2]), 0, 0]))
                out.write(ids.astype(width))
                copies = []
                for doc_id in batch.column(0).to_pylist():
                    copy = copy + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    copies.append(copy)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(copies, pa.int32()), pa.array(np.full(len(copies), shard), pa.int32()), pa.array(starts[:-1] + at, pa.int64()), pa.array(np.diff(starts), pa.int64())],
                    names=["doc_id", "copy", "shard", "offset", "n_tokens"],
                )
                at += len(ids)
            enc.rest()

    # ranges split on the text too, so that a repeated doc_id does not make one large
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    made = materialize(ordered.mapInArrow(write, "doc_id long, copy int, shard int, offset long, n_tokens long"), "manifest")
    return _joined(made, folder)


def _joined(made: DataFrame, folder: str) -> DataFrame:
    """The manifest with ``start``, and copies numbered on where a doc_id goes on in the
    next shard. What the driver gathers is one row per shard."""
    ends = made.groupBy("shard").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("rows"), F.min_by("doc_id", "offset").alias("first"), F.max_by(F.struct("doc_id", "copy"), "offset").alias("last")
    )
    known, base, rows, carry = [], 0, 0, None
    for r in ends.orderBy("shard").collect():
        more = carry[1] if carry and carry[0] == r["first"] else 0
        known.append((r["shard"], base, r["first"], more))
        carry = r["last"]["doc_id"], r["last"]["copy"] + 1 + (more if r["first"] == r["last"]["doc_id"] else 0)
        base, rows = base + r["n"], rows + r["rows"]
    write_file(f"{folder}/{_TABLE}", json.dumps({"rows": rows, "ids": base, "buckets": max(1, -(-rows // BUCKET))}).encode())
    shards = made.sparkSession.createDataFrame(known, "shard int, base long, first long, more int")
    out = made.join(F.broadcast(shards), "shard")
    copy = F.col("copy") + F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.col("more")).otherwise(0)
    return out.select("doc_id", copy.cast("int").alias("copy"), "shard", "offset", (F.col("base") + F.col("offset")).alias("start"), "n_tokens")


def key_of(doc_id: int | None, copy: int) -> np.uint64:
    """The key of a document, as ``_keyed`` gives it."""
    import xxhash

    named = xxhash.xxh64_intdigest("null" if doc_id is None else struct.pack("<q", doc_id), 42)
    return np.uint64(xxhash.xxh64_intdigest(struct.pack("<i", copy), named))


def _keyed(df: DataFrame, buckets: int) -> DataFrame:
    """The hash of one whole number is one to one, and so is that of a copy number over it:
    rows of different doc_ids and one copy number never share a key."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("null"), F.col("copy"))).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.col("copy")))
    return df.withColumn("key", key).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))


def _twins(data: bytes) -> dict[tuple[int | None, int], tuple[int, int, int]]:
    """Rows that share a key with another: (doc_id, copy) -> (shard, offset, length)."""
    rows = np.frombuffer(data, _TWIN)
    return {(r["doc_id"].item() if r["known"] else None, r["copy"].item()): (r["shard"].item(), r["offset"].item(), r["length"].item()) for r in rows}


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


def write_index(manifest: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Build one perfect hash file per bucket of keys: (bucket, n_keys)."""

    def build(table: pa.Table) -> pa.Table:
        all_keys = table["key"].to_numpy().view(np.uint64)
        first = np.zeros(len(all_keys), bool)
        first[np.unique(all_keys, return_index=True)[1]] = True
        keys, own, twins = all_keys[first], table.filter(pa.array(first)), table.filter(pa.array(~first))
        hashed = PerfectHash.build(keys)
        slot = hashed.find(keys)
        rows = np.zeros(len(keys), _ENTRY)
        rows["shard"][slot], rows["length"][slot], rows["offset"][slot] = _columns(own, "shard", "n_tokens", "offset")
        more = np.zeros(len(twins), _TWIN)
        more["known"], more["doc_id"] = twins["doc_id"].is_valid().to_numpy(), twins["doc_id"].fill_null(0).to_numpy()
        more["copy"], more["shard"], more["length"], more["offset"] = _columns(twins, "copy", "shard", "n_tokens", "offset")
        bucket = table["bucket"][0].as_py()
        write_file(f"{folder}/index-{bucket:06d}.mph", hashed.to_bytes() + rows.tobytes() + struct.pack("<I", len(more)) + more.tobytes())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n_keys": pa.array([len(all_keys)], pa.int64())})

    # equal keys of one bucket in one order, so that a repeated task writes equal bytes
    made = _keyed(manifest, buckets).select("doc_id", "copy", "key", "bucket", "shard", "offset", "n_tokens")
    return materialize(made.groupBy("bucket").applyInArrow(lambda t: build(t.sort_by([("shard", "ascending"), ("offset", "ascending")])), "bucket int, n_keys long"), "index")


def find(keys: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Look keys (doc_id, copy; ``start`` goes along) up in the index: shard, offset and
    length. Keys that were never indexed give no row."""

    def look(table: pa.Table) -> pa.Table:
        data = read_file(f"{folder}/index-{table['bucket'][0].as_py():06d}.mph")
        hashed, at = PerfectHash.from_bytes(data)
        end = at + _ENTRY.itemsize * len(hashed.prints)
        rows, twins = np.frombuffer(data[at:end], _ENTRY), _twins(data[end + 4 :])
        slot = hashed.find(table["key"].to_numpy().view(np.uint64))
        shard, offset, length = (np.where(slot >= 0, rows[n][slot].astype(np.int64), -1) for n in ("shard", "offset", "length"))
        if twins:
            for i, named in enumerate(zip(table["doc_id"].to_pylist(), table["copy"].to_pylist())):
                if named in twins:
                    shard[i], offset[i], length[i] = twins[named]
        out = table.select(["doc_id", "copy", "start"])
        for name, column in (("shard", shard), ("offset", offset), ("length", length)):
            out = out.append_column(name, pa.array(column))
        return out.filter(pa.array(shard >= 0))

    keyed = _keyed(keys, buckets).select("doc_id", "copy", "start", "key", "bucket")
    return keyed.groupBy("bucket").applyInArrow(look, "doc_id long, copy int, start long, shard long, offset long, length long")


def read_back(found: DataFrame, folder: str) -> DataFrame:
    """Read the ids of found keys (with ``start``) from the shards and digest them, a
    bounded stretch of a shard at a time."""

    def read(table: pa.Table) -> pa.Table:
        path = f"{folder}/shard-{table['shard'][0].as_py():06d}.ids"
        width = read_range(path, 0, _HEAD)[5]
        offset, length = _columns(table, "offset", "length")
        low, high = offset.min(), (offset + length).max()
        ids = np.frombuffer(read_range(path, _HEAD + width * low, width * (high - low)), f"<u{width}")
        crc = [zlib.crc32(ids[o : o + n].astype("<u4")) for o, n in zip(offset - low, length)]
        return table.select(["doc_id", "copy", "start"]).append_column("n_tokens", pa.array(length)).append_column("ids_crc32", pa.array(crc, pa.int64()))

    placed = found.withColumn("stretch", F.expr(f"offset div {STRETCH}"))
    return placed.groupBy("shard", "stretch").applyInArrow(read, "doc_id long, copy int, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None, keeps_space: bool = False) -> DataFrame:
    """Write ``docs`` as id files with their index and read every document back by
    its key: (doc_id, copy, start, n_tokens, ids_crc32). ``Table`` reads single keys
    of the folder."""
    folder = folder or new_path(docs.sparkSession, "ids")
    manifest = write_shards(docs, tokenizer_path, folder, keeps_space)
    buckets = json.loads(read_file(f"{folder}/{_TABLE}"))["buckets"]
    write_index(manifest, folder, buckets)
    return read_back(find(manifest.select("doc_id", "copy", "start"), folder, buckets), folder)

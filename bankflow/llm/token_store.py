"""Token ids in binary shards, with keyed access by a minimal perfect hash index.

Format: a Parquet table with one row a shard (written and committed by Spark, so it works on any store and
survives lost executors). ``ids`` is the raw little-endian payload of all documents of the shard in
ascending key order, ``width`` bytes an id. ``keys`` and ``lengths`` list the documents in that order. The
index maps a key to its slot in constant time: ``mph_bits`` holds one bit array a level (sizes in
``mph_sizes``); a key owns the first level on which no other key shares its bit, and the number of set bits
before it is its slot. ``fingerprints`` has 32 bits a slot, which tell absent keys apart, and ``first``
and ``count`` the documents of that key in the shard.
"""

from __future__ import annotations

import json
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankflow.llm.common import MASK, chunks, mix, stored_bytes, whole_text
from bankflow.llm.word_memory import LowerWordMemory, WordMemory, check_lower_words, memory_of

SHARDS = (
    "shard long, n_docs long, n_tokens long, width int, min_key long, max_key long, ids binary, "
    "keys array<long>, lengths array<int>, mph_sizes array<int>, mph_bits binary, fingerprints binary, "
    "first binary, count binary"
)
GAMMA = 1.5
FINGERPRINT = np.uint64(0x9E3779B97F4A7C15)


def level_positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(level * int(FINGERPRINT) & MASK)) % np.uint64(size)).astype(np.int64)


def fingerprints_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ FINGERPRINT) >> np.uint64(32)).astype(np.uint32)


def build_index(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits for distinct unsigned 64-bit keys. Mixing is bijective, so levels run out."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(64, int(np.ceil(len(left) * GAMMA)))
        at = level_positions(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


class Index:
    """Constant-time lookups in one shard: a probe a level, a rank and a fingerprint."""

    def __init__(self, sizes: list[int], bits: np.ndarray, fingerprints: np.ndarray):
        self.sizes, self.bits, self.fingerprints = sizes, bits, fingerprints
        self.ranks = np.concatenate([[0], np.cumsum(bits)])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the key is not stored."""
        slot = np.full(len(keys), -1, np.int64)
        base, open_rows = 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = base + level_positions(keys[open_rows], level, size)
            found = self.bits[at]
            slot[open_rows[found]] = self.ranks[at[found]]
            open_rows = open_rows[~found]
            base += size
        stored = slot >= 0
        stored[stored] = self.fingerprints[slot[stored]] == fingerprints_of(keys[stored])
        return np.where(stored, slot, -1)


def shard_row(shard: int, keys: list, payloads: list[bytes], width: int) -> pa.RecordBatch:
    lengths = [len(p) // width for p in payloads]
    order = np.array([k is not None for k in keys], bool)
    nulls = int((~order).sum())  # null keys come first
    numbers = np.array(keys[nulls:], np.int64).view(np.uint64)
    distinct, first, count = np.unique(numbers, return_index=True, return_counts=True)
    sizes, bits = build_index(distinct)
    index = Index(sizes, bits, fingerprints_of(np.zeros(0, np.uint64)))
    slot = np.zeros(len(distinct), np.int64)
    base, open_rows = 0, np.arange(len(distinct))
    for level, size in enumerate(sizes):
        at = base + level_positions(distinct[open_rows], level, size)
        slot[open_rows[bits[at]]] = index.ranks[at[bits[at]]]
        open_rows = open_rows[~bits[at]]
        base += size
    by_slot = np.argsort(slot)
    present = keys[nulls:]
    row = {
        "shard": shard,
        "n_docs": len(keys),
        "n_tokens": sum(lengths),
        "width": width,
        "min_key": present[0] if present else None,
        "max_key": present[-1] if present else None,
        "ids": b"".join(payloads),
        "keys": keys,
        "lengths": lengths,
        "mph_sizes": sizes,
        "mph_bits": np.packbits(bits).tobytes(),
        "fingerprints": fingerprints_of(distinct[by_slot]).astype("<u4").tobytes(),
        "first": (first[by_slot] + nulls).astype("<u4").tobytes(),
        "count": count[by_slot].astype("<u4").tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], schema=SHARD_SCHEMA)


SHARD_SCHEMA = pa.schema(
    [
        ("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()),
        ("min_key", pa.int64()), ("max_key", pa.int64()), ("ids", pa.binary()),
        ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
        ("mph_sizes", pa.list_(pa.int32())), ("mph_bits", pa.binary()), ("fingerprints", pa.binary()),
        ("first", pa.binary()), ("count", pa.binary()),
    ]
)


def write_token_store(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    by_word: bool = False,
    shard_tokens: int = 1_000_000,
    part_bytes: int = 16 << 20,
) -> None:
    """Encode every text, append ``end_id`` and write the store in ascending key order (nulls first).

    Keys are integers; other types are refused. Null texts are empty and give the end id alone. Rows of one
    key follow each other, ordered by a hash of the text; a key of very many rows spreads over shards. A
    text longer than ``shard_tokens`` is a shard of its own. An empty table gives a store without shards.
    ``by_word`` remembers ids by word, for a tokenizer that lower-cases, drops white space and takes runs of
    letters and other signs one by one; others are refused. The file is read here and sent to the executors,
    about 2 MB.
    """
    if docs.schema[doc_id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("keys must be integers")
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as file:
        tokenizer_json = file.read()
    if by_word:
        check_lower_words(json.loads(tokenizer_json))
    largest = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1)
    width = 2 if largest <= 1 << 16 else 4
    kind = "<u2" if width == 2 else "<u4"
    job = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), whole_text(F.col(text)).alias("text"))
    parts = max(1, -(-stored_bytes(docs, text) // part_bytes))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc()]

    def pack(batches):
        memory = memory_of(job, lambda: (LowerWordMemory if by_word else WordMemory)(sent.value, kind))
        end = np.array([end_id], kind).tobytes()
        shard = TaskContext.get().partitionId() << 32
        keys, held, size = [], [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in chunks(pc.utf8_length(texts).to_numpy(), 6_000_000):
                some = texts.slice(a, b - a)
                found = memory.payloads(some) if by_word else memory.plain(some.to_pylist())
                for key, payload in zip(ids[a:b], (p + end for p in found)):
                    if held and size + len(payload) // width > shard_tokens:
                        yield shard_row(shard, keys, held, width)
                        shard, keys, held, size = shard + 1, [], [], 0
                    keys.append(key)
                    held.append(payload)
                    size += len(payload) // width
        if held:
            yield shard_row(shard, keys, held, width)

    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(pack, SHARDS).write.option("compression", "zstd").parquet(path)


def open_index(row: dict) -> Index:
    total = sum(row["mph_sizes"])
    bits = np.unpackbits(np.frombuffer(row["mph_bits"], np.uint8), count=total).astype(bool)
    return Index(row["mph_sizes"], bits, np.frombuffer(row["fingerprints"], "<u4"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: ``doc_id, shard, start, n_tokens, ids_crc32``, found through the index.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the checksum of its ids as
    unsigned 32-bit little-endian integers. Documents without a key are read in order.
    """
    shards = spark.read.schema(SHARDS).parquet(path)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                kind = "<u2" if row["width"] == 2 else "<u4"
                ids = np.frombuffer(row["ids"], kind)
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                nulls = sum(k is None for k in row["keys"])
                keys = np.unique(np.array(row["keys"][nulls:], np.int64)).view(np.uint64)
                slot = open_index(row).slots(keys)
                if (slot < 0).any():
                    raise ValueError("the index misses a stored key")
                first = np.frombuffer(row["first"], "<u4")[slot].astype(np.int64)
                count = np.frombuffer(row["count"], "<u4")[slot]
                found = [None] * nulls + list(np.repeat(keys.view(np.int64), count).tolist())
                place = list(range(nulls)) + list(
                    chain.from_iterable(range(f, f + c) for f, c in zip(first.tolist(), count.tolist()))
                )
                out = []
                for key, i in zip(found, place):
                    start = int(ends[i]) - row["lengths"][i]
                    out.append((key, row["shard"], start, row["lengths"][i],
                                zlib.crc32(ids[start : int(ends[i])].astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)],
                    names=["doc_id", "shard", "offset", "n_tokens", "ids_crc32"],
                )

    inside = shards.mapInArrow(
        read, "doc_id long, shard long, offset long, n_tokens long, ids_crc32 long"
    )
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one small row a shard
    starts = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    return inside.join(starts, "shard").select(
        "doc_id", "shard", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """Ids of the documents with the given keys: ``doc_id, ids array<int>``; absent keys give no row.

    Only shards whose key range holds a key are read. Meant for a bounded list of keys.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    inside = F.lit(False)
    for key in keys:
        inside = inside | ((F.col("min_key") <= key) & (F.col("max_key") >= key))
    wanted = np.unique(np.array(keys, np.int64)).view(np.uint64)

    def fetch(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 2 else "<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                first, count = np.frombuffer(row["first"], "<u4"), np.frombuffer(row["count"], "<u4")
                found = [
                    (int(np.uint64(key).view(np.int64)), ids[int(ends[i]) - row["lengths"][i] : int(ends[i])].tolist())
                    for key, slot in zip(wanted, open_index(row).slots(wanted))
                    if slot >= 0
                    for i in range(int(first[slot]), int(first[slot]) + int(count[slot]))
                ]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[0] for f in found], pa.int64()),
                         pa.array([f[1] for f in found], pa.list_(pa.int32()))],
                        names=["doc_id", "ids"],
                    )

    return shards.where(inside).mapInArrow(fetch, "doc_id long, ids array<int>")

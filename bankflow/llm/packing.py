"""Packing of token ids into sequences of bounded length: best-fit decreasing over a segment tree.

Every document is encoded and cut into full windows and a rest. A full window is a sequence of its own;
rests are packed best-fit decreasing: the longest first, each into the open window whose remaining
capacity is the tightest that still holds it. Open windows are indexed by remaining capacity in a segment
tree, so a place is found in as many steps as the tree is high.

A task packs its own rows, block by block, so nothing is shuffled, memory is bounded by a block, and a lost
executor's task gives the same sequences again. A block leaves a few windows that are not full.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankflow.llm.common import chunks, whole_text
from bankflow.llm.word_memory import WordMemory, check_byte_level, memory_of

PIECE = "struct<doc_id:bigint,start:bigint,length:int,doc_tokens:bigint,offset:int>"
SEQUENCES = f"sequence_id long, n_tokens int, padded_to int, ids binary, pieces array<{PIECE}>"
WIDTH = 4  # bytes an id


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose inner nodes count the windows below."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, window: int, capacity: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove the window with the least remaining capacity of ``length`` or more; with that capacity."""
        node = self.leaves + length
        while not self.counts[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not self.counts[node]:
                node += 1
        capacity = node - self.leaves
        while node:
            self.counts[node] -= 1
            node >>= 1
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each item, all of 1 to ``capacity``; of equal items the earlier is placed first."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_windows, used = OpenWindows(capacity), 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        found = open_windows.take(length)
        if found is None:
            found, used = (used, capacity), used + 1
        window[item], offset[item] = found[0], capacity - found[1]
        if found[1] > length:
            open_windows.add(found[0], found[1] - length)
    return window, offset


def padded_length(n_tokens: int, capacity: int) -> int:
    """Length after padding: the capacity, but for a sequence whose length is a power of two."""
    return n_tokens if n_tokens & (n_tokens - 1) == 0 else capacity


def pack_block(keys: list, payloads: list[bytes], capacity: int, first_id: int) -> Iterator[tuple]:
    """Sequences of one block: full windows in the order of the documents, then the packed rests."""
    window = capacity * WIDTH
    sequence, rests = first_id, []
    for key, payload in zip(keys, payloads):
        tokens, full = len(payload) // WIDTH, len(payload) // window
        for i in range(full):
            piece = {"doc_id": key, "start": i * capacity, "length": capacity, "doc_tokens": tokens, "offset": 0}
            yield sequence, capacity, capacity, payload[i * window : (i + 1) * window], [piece]
            sequence += 1
        if len(payload) > full * window:
            rests.append((key, full * capacity, payload[full * window :], tokens))
    where, offsets = best_fit_decreasing(np.array([len(r[2]) // WIDTH for r in rests], np.int64), capacity)
    order = np.lexsort((offsets, where))
    for some in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else ():
        pieces, data = [], []
        for i in some.tolist():
            key, start, payload, tokens = rests[i]
            length = len(payload) // WIDTH
            pieces.append({"doc_id": key, "start": start, "length": length, "doc_tokens": tokens, "offset": int(offsets[i])})
            data.append(payload)
        total = pieces[-1]["offset"] + pieces[-1]["length"]
        yield sequence, total, padded_length(total, capacity), b"".join(data), pieces
        sequence += 1


ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("padded_to", pa.int32()), ("ids", pa.binary()),
        ("pieces", pa.list_(pa.struct([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()),
            ("offset", pa.int32()),
        ]))),
    ]
)


def packed_sequences(
    docs: DataFrame,
    tokenizer_file: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    capacity: int = 1024,
    block_tokens: int = 6_000_000,
) -> DataFrame:
    """Sequences of at most ``capacity`` ids: ``sequence_id, n_tokens, padded_to, ids, pieces``.

    Every document's ids and ``end_id`` behind them lie in exactly one piece each. ``ids`` holds little-endian
    unsigned 32-bit integers without padding; ``padded_to`` is the length to pad to. ``pieces`` names, in
    order of ``offset``, the document, the first id there (``start``), the length and the document's ids.
    ``sequence_id`` is unique and not gapless.

    Null and empty texts give the end id alone; a very long text gives full windows and one rest; repeated
    rows and ids are packed each by itself; rows without an id keep a null id; an empty table has no
    sequences. Only the two named columns are read, so others may have any name. The tokenizer must be plain
    byte-level (others are refused); its file, about 2 MB, is sent to the executors.
    """
    if docs.schema[doc_id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("document ids must be integers")
    with open(tokenizer_file, encoding="utf-8") as file:
        tokenizer_json = file.read()
    check_byte_level(json.loads(tokenizer_json))
    job = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches):
        memory = memory_of(job, lambda: WordMemory(sent.value, "<u4"))
        keys, held, size = [], [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in chunks(pc.utf8_length(texts).to_numpy(), 6_000_000):
                for key, payload in zip(ids[a:b], memory.payloads(texts.slice(a, b - a))):
                    keys.append(key)
                    held.append(payload + end)
                    size += len(payload) // WIDTH + 1
                if size >= block_tokens:
                    yield keys, held
                    keys, held, size = [], [], 0
        if keys:
            yield keys, held

    def pack(batches):
        next_id = TaskContext.get().partitionId() << 40
        for keys, held in blocks(batches):
            rows = []
            for row in pack_block(keys, held, capacity, next_id):
                rows.append(row)
                next_id = row[0] + 1
                if len(rows) == 2000:
                    yield record_batch(rows)
                    rows = []
            if rows:
                yield record_batch(rows)

    chosen = docs.select(F.col(doc_id).cast("long").alias("key"), whole_text(F.col(text)).alias("text"))
    return chosen.mapInArrow(pack, SEQUENCES)


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def write_sequences(docs: DataFrame, path: str, tokenizer_file: str, **options) -> None:
    """Write :func:`packed_sequences` as Parquet."""
    packed_sequences(docs, tokenizer_file, **options).write.option("compression", "zstd").parquet(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every piece of written sequences, with the checksum of its ids as they lie in the file."""
    pieces = spark.read.schema(SEQUENCES).parquet(path).select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.substring("ids", F.col("p.offset") * WIDTH + 1, F.col("p.length") * WIDTH)
    return pieces.select(
        "p.doc_id",
        "p.start",
        F.col("p.length").cast("long").alias("length"),
        F.crc32(ids).alias("ids_crc32"),
        "p.doc_tokens",
        "sequence_id",
        F.col("p.offset").cast("long").alias("offset"),
    )

"""Helpers shared by the operators: staged tables, words, hashes and row structs."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bankflow.session import remove_path, scratch_path

MASK = (1 << 64) - 1


def ensure_folder(spark: SparkSession) -> None:
    """Give a local session a checkpoint folder when it has none; a cluster must name its own."""
    context = spark.sparkContext
    unset = not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir()
    if unset and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="bankflow-checkpoint-"))


def new_path(spark: SparkSession, name: str) -> str:
    ensure_folder(spark)
    return scratch_path(spark, f"llm-{name}")


class Staged:
    """A table written below the shared folder and read back, which cuts the lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Only once nothing will read it again."""
        remove_path(self.spark, self.path)


def stage(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


def packed_struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def packed(df: DataFrame) -> DataFrame:
    """All input columns in one struct ``doc``, so that no result column can clash with them."""
    return df.select(packed_struct(df).alias("doc"))


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def text_bytes(df: DataFrame, text: str) -> int:
    total = df.select(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()["n"]
    return int(total or 0)


def stored_bytes(df: DataFrame, text: str, row_bytes: int = 64) -> int:
    """Bytes of the texts and a constant for each row, so that tasks are cut by rows too where texts are empty."""
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + row_bytes
    return int(df.select(F.sum(size.cast("long")).alias("n")).first()["n"] or 0)


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased A-Z, split at the six ASCII white space characters; null has no words."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered until ``clear_at`` words are held."""

    def __init__(self, clear_at: int = 400_000):
        super().__init__()
        self.clear_at = clear_at

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.clear_at:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: Iterable[str | None], limit: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``limit`` characters each; a longer text is a run of its own."""
    start = size = at = 0
    for at, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= limit:
            yield start, at
            start, size = at, 0
    if at > start:
        yield start, at


def chunks(sizes: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of entries whose sizes add up to about ``step``."""
    if len(sizes):
        part = np.cumsum(sizes) // step
        edges = np.flatnonzero(np.diff(part)) + 1
        yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)])


def with_fields(schema: T.StructType, fields: str) -> T.StructType:
    return T.StructType(list(schema) + list(T.StructType.fromDDL(fields)))

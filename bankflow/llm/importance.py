"""Importance resampling towards a target distribution, by hashed n-gram features.

The features of a text are its runs of 1 to 2 consecutive words, hashed into buckets. A bucket's gain is the
logarithm of its frequency in the target over that in the documents, a document's weight the mean gain of
its features. Documents are drawn without replacement by weight plus Gumbel noise from a hash of their id,
so a draw can be repeated and does not depend on partitions.

Features are made by Arrow kernels on whole batches: lower-casing, splitting, flattening and dictionary
encoding; bigrams are pairs of shifted dictionary indices, of which only distinct ones are hashed.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankflow.llm.common import chunks, stage, whole_text
from bankflow.operators.ranking import with_row_number

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MILLI = 1000


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text (their number), all words as indices, and the distinct words."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    filled = pc.not_equal(flat, "")
    encoded = pc.dictionary_encode(flat.filter(filled))
    counts = np.bincount(owner.filter(filled).to_numpy(zero_copy_only=False), minlength=len(texts))
    distinct = encoded.dictionary.cast(pa.binary()).to_pylist()
    return counts, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), distinct


def feature_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, buckets of all single words, and of all pairs; both in the order of the texts."""
    counts, words, distinct = word_table(texts)
    single = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = pc.dictionary_encode(pa.array(words[inside] * max(1, len(distinct)) + words[inside + 1]))
    keys = pairs.dictionary.to_numpy(zero_copy_only=False)
    first, second = keys // max(1, len(distinct)), keys % max(1, len(distinct))
    tails = np.empty(len(distinct), object)
    tails[:] = [b" " + word for word in distinct]
    double = np.fromiter(map(zlib.crc32, tails[second], single[first].tolist()), np.uint32, len(keys))
    at = pairs.indices.to_numpy(zero_copy_only=False)
    return counts, (single % buckets).astype(np.int64)[words], (double % buckets).astype(np.int64)[at]


def bucket_counts(rows: DataFrame, text: str, buckets: int) -> DataFrame:
    """Features a bucket over all rows: ``bucket, n``; a task sends one row a bucket at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for a, b in chunks(pc.utf8_length(texts).to_numpy(), 2_000_000):
                _, single, double = feature_buckets(texts.slice(a, b - a), buckets)
                total += np.bincount(single, minlength=buckets) + np.bincount(double, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    texts = rows.select(whole_text(F.col(text)).alias("text"))
    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the smoothed log ratio, in doubles."""
    buckets = len(source)
    of_target, of_source = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [
            math.floor(MILLI * math.log((float(t + 1) * of_target) / (float(s + 1) * of_source)))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def noise(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of Gumbel noise from the first 32 bits of sha256(``seed:id``); a null id is empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-MILLI * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_weights(
    docs: DataFrame, target: DataFrame, doc_id: str, text: str, target_text: str, buckets: int
) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document; two passes over the texts, no shuffle of them."""
    both = []
    for rows, column in ((docs, text), (target, target_text)):
        total = np.zeros(buckets, np.int64)
        for row in bucket_counts(rows, column, buckets).collect():  # one row a bucket
            total[row["bucket"]] = row["n"]
        both.append(total)
    gains = pa.array(bucket_gains(*both))

    def weigh(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b in chunks(pc.utf8_length(texts).to_numpy(), 2_000_000):
                words, single, double = feature_buckets(texts.slice(a, b - a), buckets)
                pairs = np.maximum(words - 1, 0)
                total = np.zeros(b - a, np.int64)
                for features, sizes in ((single, words), (double, pairs)):
                    some = sizes > 0
                    if some.any():
                        starts = np.cumsum(sizes) - sizes
                        total[some] += np.add.reduceat(pc.take(gains, pa.array(features)).to_numpy(), starts[some])
                n = words + pairs
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(F.col(text)).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 25,
    min_words: int = 20,
    buckets: int = 10_000,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null if undrawn.

    Of the documents with ``min_words`` words or more, ``percent`` in a hundred (rounded down) are drawn: those
    of highest score, ties to the smaller id. The ids tell which documents to keep; their texts are not moved.
    The buckets' counts, ``buckets`` rows for each side, are the only thing gathered.

    Null and empty texts have no features, weight 0 and are never drawn (unless ``min_words`` is 0). A null id
    takes its noise from the empty id and comes first among equal scores; rows of one id have the same noise.
    Repeated rows count each. An empty table gives no rows; an empty target gives every bucket its smoothed
    gain. Only the named columns are read, so others may have any name.
    """
    weighed = importance_weights(docs, target, doc_id, text, target_text, buckets)
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance")
    can = F.col("n_words") >= min_words
    drawn = F.floor(scored.where(can).agg((F.count("*") * percent).alias("n")).scalar() / 100)
    ranked = with_row_number(
        scored, [F.when(can, 0).otherwise(1), F.desc("score"), F.asc_nulls_first("doc_id")], "place"
    )
    rank = F.when(can & (F.col("place") <= drawn), F.col("place")).alias("rank")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank)

"""Removal of repeated lines within one word edit, by a deletion-neighbourhood join.

Lines are sequences of words. Deleting one word at every place gives a line's variants; two lines are
within one edit exactly if they are equal, if variants of both are equal with the gap at the same place (a
word is replaced), or if a variant of one is the other (a word is added). Variants are joined as hashed
keys; a second hash of the remaining words verifies the match. The earliest line stays.

Only lines that can have a partner are expanded: one edit leaves the first or the last half of both lines
untouched, so a line without a half in common with another needs no variants. Short lines may be joined as
exact copies only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankflow.llm.common import WordHashes, mix, slices, stage

LINES = "doc_id long, line_no int, h1 long, h2 long, n int, halves array<long>"
VARIANTS = "key long, verify long, gap int, h1 long, h2 long"
MIN_WORDS = 3
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def halves(words: list[bytes]) -> list[int]:
    """Signed hashes of the first and last q words for both q a partner within one edit may use.

    The lowest bit tells first (0) from last (1) words.
    """
    n = len(words)
    out = []
    for q in {n // 2, (n - 1) // 2}:
        for last, part in ((0, words[:q]), (1, words[n - q :])):
            value = xxhash.xxh3_64_intdigest(b" ".join(part), seed=q)
            out.append((value & ~1 | last) - (1 << 63))
    return out


def line_rows(doc_id, text: str | None, min_words: int, min_copy_words: int) -> list[tuple]:
    out = []
    for number, line in enumerate((text or "").split("\n")):
        words = line.encode().split()
        if len(words) >= min_copy_words:
            digest = xxhash.xxh3_128_intdigest(b" ".join(words))
            out.append(
                (doc_id, number, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63),
                 len(words), halves(words) if len(words) >= min_words else [])
            )
    return out


class Deletions:
    """Keys of all one-word deletions of a line from prefix sums of two polynomial hashes."""

    def __init__(self):
        self.hashes = WordHashes()
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.inverse = [np.uint64(pow(f, -1, 1 << 64)) for f in FACTORS]

    def keys(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Key and check for the gap at 0 .. n-1, then for the whole line."""
        n, h = len(words), self.hashes.of(words)
        out = []
        for k, factor in enumerate(FACTORS):
            while len(self.powers[k]) < n:
                step = np.uint64(pow(factor, len(self.powers[k]), 1 << 64))
                self.powers[k] = np.concatenate([self.powers[k], self.powers[k] * step])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(k)) * self.powers[k][:n])])
            rest = sums[:-1] + (sums[-1] - sums[1:]) * self.inverse[k]
            lengths = np.append(np.full(n, n - 1), n).astype(np.uint64)
            out.append(mix(np.append(rest, sums[-1]) + lengths * np.uint64(0xA24BAED4963EE407)).view(np.int64))
        return out[0], out[1]


def removed_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    min_copy_words: int | None = None,
) -> DataFrame:
    """Lines to remove: ``doc_id, line_no, kept_doc_id, kept_line_no, distance``.

    Lines are the parts of a text between line feeds, numbered from 0; order is by document id (null first)
    and line number. A line goes if an earlier line has the same words (distance 0) or is within one word
    edit (distance 1); the earliest such line is named, equal ones first. Lines under ``min_words`` words
    have no edits, and those under ``min_copy_words`` (``min_words`` by default; 1 joins copies of every line that
    is not blank, whatever its length) always stay, blank ones too. Null and empty texts have no lines to remove.
    Equal lines at the same place of repeated ids do not remove each other. An empty table gives an empty result. Ids are integers; other
    columns do not matter.
    """
    least = max(1, min_words if min_copy_words is None else min(min_words, min_copy_words))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def split(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 4_000_000):
                found = [r for d, t in zip(ids[a:b], texts[a:b]) for r in line_rows(d, t, min_words, least)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
                names = ("doc_id", "line_no", "h1", "h2", "n", "halves")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=list(names)
                )

    lines = stage(rows.mapInArrow(split, LINES), "lines")
    place = F.struct("doc_id", "line_no")
    classes = stage(
        lines.groupBy("h1", "h2").agg(
            F.min(place).alias("first"), F.min("n").alias("n"), F.first("halves").alias("halves")
        ),
        "line-classes",
    )
    half = classes.select("h1", "h2", F.explode(F.array_distinct("halves")).alias("half"))
    shared = half.groupBy("half").agg(F.count("*").alias("lines")).where(F.col("lines") > 1)
    partners = (
        half.join(shared, "half", "left_semi")
        .groupBy("h1", "h2")
        .agg(F.max(F.col("half").bitwiseAND(1)).alias("last"), F.min(F.col("half").bitwiseAND(1)).alias("not_first"))
        .join(classes, ["h1", "h2"])
    )
    wanted = partners.groupBy(F.col("first.doc_id").alias("wanted_id")).agg(
        F.collect_list(F.struct(F.col("first.line_no").alias("line"), "h1", "h2", "last", "not_first")).alias("wanted")
    )
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("text", "wanted")

    def expand(batches):
        deletions = Deletions()
        for batch in batches:
            out = []
            for body, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = (body or "").split("\n")
                for w in asked:
                    words = own[w["line"]].encode().split() if w["line"] < len(own) else []
                    n = len(words)
                    digest = xxhash.xxh3_128_intdigest(b" ".join(words)) if n else 0
                    if not n or (digest >> 64) - (1 << 63) != w["h1"]:
                        continue  # another text under a repeated id
                    key, verify = deletions.keys(words)
                    # first half shared: the edit is behind it; last half shared: before it
                    low = 0 if w["last"] else (n - 1) // 2
                    high = n if not w["not_first"] else n - (n - 1) // 2
                    gaps = np.append(np.arange(low, high), n)
                    out.append((key[gaps], verify[gaps], np.where(gaps == n, -1, gaps), w["h1"], w["h2"]))
            if out:
                sizes = [len(o[0]) for o in out]
                columns = [np.concatenate([o[i] for o in out]) for i in range(3)]
                columns += [np.repeat(np.array([o[i] for o in out], np.int64), sizes) for i in (3, 4)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["key", "verify", "gap", "h1", "h2"],
                )

    variants = texts.mapInArrow(expand, VARIANTS)
    places = classes.select("h1", "h2", "first")
    keyed = stage(variants.join(places, ["h1", "h2"]), "line-variants")
    gaps, fulls = keyed.where("gap >= 0"), keyed.where("gap < 0")
    earliest = F.min("first").alias("other")
    same_gap = gaps.join(
        gaps.groupBy("key", "verify", "gap").agg(earliest, F.count("*").alias("c")).where("c > 1"),
        ["key", "verify", "gap"],
    )
    longer = gaps.join(fulls.groupBy("key", "verify").agg(earliest), ["key", "verify"])
    variants_of_fulls = gaps.join(fulls.select("key", "verify"), ["key", "verify"], "left_semi")
    shorter = fulls.join(variants_of_fulls.groupBy("key", "verify").agg(earliest), ["key", "verify"])
    near = None
    for found in (same_gap, longer, shorter):
        found = found.where(F.col("other") < F.col("first")).select("h1", "h2", "other")
        near = found if near is None else near.unionByName(found)
    near = near.groupBy("h1", "h2").agg(F.min("other").alias("other"))
    judged = classes.select("h1", "h2", "first").join(near, ["h1", "h2"], "left")
    decided = lines.select("doc_id", "line_no", "h1", "h2").join(judged, ["h1", "h2"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    kept = F.when(is_first, F.col("other")).otherwise(F.col("first"))
    return decided.where(~is_first | F.col("other").isNotNull()).select(
        "doc_id",
        "line_no",
        kept["doc_id"].alias("kept_doc_id"),
        kept["line_no"].alias("kept_line_no"),
        F.when(is_first, 1).otherwise(0).alias("distance"),
    )


def without_lines(docs: DataFrame, removed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of the texts; null texts stay null."""
    gone = removed.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("line_no").alias("gone"))
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("gone_id")), "left")
    numbered = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    left = F.filter(numbered, lambda x: ~F.array_contains("gone", x["i"]))
    cut = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(left["line"], "\n"))
    return joined.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])

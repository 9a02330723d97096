"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed samples six words of a benchmark passage by a fixed mask and ignores the words between. The two
masks together meet every window of 13 words with at most two substitutions (tests check all of them), so
seeds lose no such overlap. A document is hashed only where a seed's rarest sampled word stands; equal
hashes are verified by comparing the aligned words around the hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankflow.llm.common import stage

WINDOW = 13
SUBSTITUTIONS = 2
MASKS = ((0, 2, 5, 6, 7, 9), (0, 1, 2, 4, 7, 8))
MIN_WORDS = 4
MAX_BROADCAST = 50_000  # seeds a pass sends to every executor; more seeds take more passes
REACH = 2 * WINDOW  # words on either side of a hit that hashing and verification may look at
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BREAKS), "")


def sampled(words: Column, start: Column, offsets: Column) -> Column:
    return F.xxhash64(F.transform(offsets, lambda o: F.get(words, start + o)), offsets)


def at_mask(mask: tuple[int, ...]):
    offsets = F.array(*[F.lit(o) for o in mask])
    return lambda start: F.struct(start.alias("start"), offsets.alias("offsets"))


def benchmark_seeds(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Every seed: ``item, item_words, start, offsets``; passages under 13 words give one seed of all words."""
    items = benchmark.select(
        F.col(item).alias("item"), word_array(F.col(text)).alias("item_words")
    ).where(F.size("item_words") >= MIN_WORDS)
    n = F.size("item_words")
    spaced = F.flatten(
        F.array(
            *[
                F.transform(
                    F.sequence(F.lit(0), n - 1 - mask[-1]),
                    at_mask(mask),
                )
                for mask in MASKS
            ]
        )
    )
    whole = F.array(F.struct(F.lit(0).alias("start"), F.sequence(F.lit(0), n - 1).alias("offsets")))
    seeds = F.when(n >= WINDOW, spaced).otherwise(whole)
    return items.dropDuplicates(["item", "item_words"]).select(
        "item", "item_words", F.inline(seeds)
    )


def anchored_seeds(docs: DataFrame, seeds: DataFrame, text: str) -> DataFrame:
    """Seeds with their hash and the sampled word that is rarest in the documents."""
    words = seeds.select(F.explode("item_words").alias("word")).distinct()
    tokens = docs.select(F.explode(word_array(F.col(text))).alias("word"))
    small = words.count() <= MAX_BROADCAST
    counts = (
        tokens.join(F.broadcast(words) if small else words, "word")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    keyed = seeds.withColumn("hash", sampled(F.col("item_words"), F.col("start"), F.col("offsets")))
    choices = keyed.select(
        "*", F.explode("offsets").alias("anchor_offset")
    ).withColumn("word", F.get("item_words", F.col("start") + F.col("anchor_offset")))
    rarest = F.min_by(
        F.struct("word", "anchor_offset"),
        F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "anchor_offset"),
    )
    return (
        choices.join(counts, "word", "left")
        .groupBy("item", "item_words", "start", "offsets", "hash")
        .agg(rarest.alias("anchor"))
        .select("item", "item_words", "start", "offsets", "hash", "anchor.*")
    )


def matched_words(words: Column, item_words: Column, shift: Column, first: Column, width: Column) -> Column:
    """Equal words of a passage window and the text aligned by ``shift``."""
    return F.size(
        F.filter(
            F.sequence(first, first + width - 1),
            lambda j: F.coalesce(F.get(words, j + shift) == F.get(item_words, j), F.lit(False)),
        )
    )


def one_pass(docs: DataFrame, seeds: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Verified overlaps with seeds few enough to broadcast."""
    anchors = seeds.select("word", "anchor_offset", "offsets").distinct()
    anchor_words = [r["word"] for r in seeds.select("word").distinct().collect()]
    hashed = seeds.select("hash", "item", "item_words", F.col("start").alias("item_start"), F.col("offsets").alias("seed"))
    rows = docs.select(F.col(doc_id).alias("doc"), word_array(F.col(text)).alias("words"))
    places = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))),
        lambda x: x.word.isin(anchor_words),
    )
    # only the words around a hit leave the row, so no long text is repeated for its hits
    base = lambda x: F.greatest(x.pos - REACH, F.lit(0))
    around = F.transform(
        places,
        lambda x: F.struct(
            x.word.alias("word"),
            (x.pos - base(x)).alias("pos"),
            base(x).alias("base"),
            F.slice("words", base(x) + 1, F.lit(2 * REACH + 1)).alias("words"),
        ),
    )
    tokens = rows.select("doc", F.inline(around))
    starts = tokens.join(F.broadcast(anchors), "word").select(
        "doc", "words", "base", "offsets", (F.col("pos") - F.col("anchor_offset")).alias("at")
    )
    hits = (
        starts.where(F.col("at") >= 0)
        .withColumn("hash", sampled(F.col("words"), F.col("at"), F.col("offsets")))
        .join(F.broadcast(hashed), "hash")
        .where(F.col("offsets") == F.col("seed"))
        .withColumn("shift", F.col("at") - F.col("item_start"))
    )
    n = F.size("item_words")
    width = F.least(n, F.lit(WINDOW))
    span = F.element_at("offsets", -1)
    first = F.greatest(F.col("item_start") + span + 1 - width, F.lit(0))
    last = F.least(F.col("item_start"), n - width)
    windows = F.transform(
        F.sequence(first, last),
        lambda k: F.struct(
            matched_words(F.col("words"), F.col("item_words"), F.col("shift"), k, width).alias("matched"),
            (-k).alias("before"),
        ),
    )
    best = hits.select("doc", "item", (F.col("base") + F.col("shift")).alias("offset"), width.alias("width"), F.array_max(windows).alias("best"))
    allowed = F.when(F.col("width") < WINDOW, 0).otherwise(SUBSTITUTIONS)
    return best.where(F.col("best.matched") >= F.col("width") - allowed).select(
        "doc",
        "item",
        F.struct(
            F.col("best.matched").alias("matched"),
            (F.col("offset") - F.col("best.before")).alias("doc_start"),
            (-F.col("best.before")).alias("item_start"),
            "width",
        ).alias("found"),
    )


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row for each document and passage that overlap: ``doc_id, item_id, matched, doc_start, item_start, width``.

    An overlap is a window of 13 words with at most two substituted words, or a whole passage of 4 to 12
    words without any. A word cut off at the text's edge counts as substituted. Shorter passages match
    nothing. Positions count words from 0 and give the best
    window (most equal words, then the earliest in the passage, then the latest in the text). Null texts have
    no words; rows of one id give one result; a null id stays null. Other columns are left out.
    """
    seeds = stage(anchored_seeds(docs, benchmark_seeds(benchmark, item, item_text), text), "seeds")
    passes = -(-seeds.count() // MAX_BROADCAST) or 1
    found = []
    for k in range(passes):
        part = F.pmod(F.xxhash64("item", "item_words"), F.lit(passes)) == k
        found.append(one_pass(docs, seeds.where(part) if passes > 1 else seeds, doc_id, text))
    overlaps = reduce(DataFrame.unionByName, found)
    best = F.max(
        F.struct(
            F.col("found.matched").alias("matched"),
            (-F.col("found.item_start")).alias("item_before"),
            F.col("found.doc_start").alias("doc_start"),
            F.col("found.width").alias("width"),
        )
    )
    return overlaps.groupBy("doc", "item").agg(best.alias("best")).select(
        F.col("doc").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("best.matched").cast("long").alias("matched"),
        F.col("best.doc_start").cast("long").alias("doc_start"),
        (-F.col("best.item_before")).cast("long").alias("item_start"),
        F.col("best.width").cast("long").alias("width"),
    )

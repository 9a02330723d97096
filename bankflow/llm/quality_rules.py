"""Quality rules by distribution divergence.

A document's histograms of character classes and of its language's common words are compared with
those of the language by Jensen-Shannon distance (base 2, 0 to 1). Documents under a minimum length are
not judged by a histogram, as short texts scatter widely.

The reference of a language is learnt from all its documents: every document counts the same, whatever
its length, so a few long ones cannot shape it. Its size is fixed: nine classes and ``n_common`` words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankflow.llm.common import ascii_words, packed, stage, with_fields

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
SCALE = 1_000_000  # integer weights: sums do not depend on their order
MAX_BROADCAST_LANGUAGES = 1_000

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. The distances are far above those of ordinary documents, see the README."""

    min_words: int = 20
    max_repeat_percent: int = 30
    min_class_chars: int = 300
    min_histogram_words: int = 50
    max_class_distance: float = 0.32
    max_word_distance: float = 0.45
    n_common: int = 50
    min_reference_documents: int = 100


def class_counts(text: str, raw: bytes) -> list[int]:
    """Code points by class: lower, upper, digit, white space, comma and stop, quote, symbol, other ASCII, rest."""
    table = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digit = table[97:123].sum(), table[65:91].sum(), table[48:58].sum()
    space = table[9:14].sum() + table[32]
    stops = table[44] + table[46] + table[58] + table[59]
    quotes = table[34] + table[39] + table[40] + table[41] + table[45]
    symbols = sum(table[ord(c)] for c in SYMBOLS)
    other = table[:128].sum() - lower - upper - digit - space - stops - quotes - symbols
    return [int(x) for x in (lower, upper, digit, space, stops, quotes, symbols, other, len(text) - table[:128].sum())]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of eight words that stand twice or more in the text, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) > len(words) - width:
        return 0  # a repeated window, overlapping or not, holds at least eight repeated words
    step = 1
    while step < width:  # ranks of windows twice as long, exact
        pairs = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    marks[:n] += twice
    marks[width:] -= twice
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base_counts(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    spaces = sum(text.count(c) for c in SPACES)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - spaces,
        sum(raw.count(c.encode()) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance with base 2 of a histogram and a reference."""
    p = counts / counts.sum()
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum()
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


def language_references(docs: DataFrame, text: str, lang: str, rules: Rules = Rules()) -> DataFrame:
    """One row a language: ``lang, ref_docs, ref_classes, ref_words, ref_weights`` over all documents.

    Documents with fewer than ``min_histogram_words`` words do not count. Counting is summed within a task
    before the shuffle; of the words only the ``n_common`` heaviest a language leave a task's last step.
    """
    least = rules.min_histogram_words

    def partial(batches):
        weights: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            for body, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = ascii_words(body)
                if len(words) < least:
                    continue
                counts = np.array(class_counts(body, body.encode()))
                for i, value in enumerate((counts * SCALE // counts.sum()).tolist()):
                    weights[language, i, b""] += value
                weights[language, -1, b""] += 1
                for word, n in Counter(words).items():
                    weights[language, -2, word] += n * SCALE // len(words)
            if len(weights) > 500_000:
                yield as_batch(weights)
                weights.clear()
        yield as_batch(weights)

    def as_batch(weights):
        keys = list(weights)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2].decode() for k in keys], pa.string()),
                pa.array(list(weights.values()), pa.int64()),
            ],
            names=["lang", "kind", "word", "weight"],
        )

    parts = docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(
        partial, "lang string, kind int, word string, weight long"
    )
    totals = parts.groupBy("lang", "kind", "word").agg(F.sum("weight").alias("weight"))
    rank = W.partitionBy("lang", "kind").orderBy(F.desc("weight"), "word")
    top = totals.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= rules.n_common)
    item = F.struct("rank", "kind", "word", "weight")
    rows = top.groupBy("lang").agg(
        F.max(F.when(F.col("kind") == -1, F.col("weight"))).alias("ref_docs"),
        F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, F.struct("kind", "weight")))).alias("classes"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == -2, item))).alias("common"),
    )
    return rows.select(
        F.col("lang").alias("ref_lang"),
        "ref_docs",
        F.col("classes.weight").alias("ref_classes"),
        F.col("common.word").alias("ref_words"),
        F.col("common.weight").alias("ref_weights"),
    )


def quality_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()
) -> DataFrame:
    """Struct ``doc`` with the input columns, and the measures and the verdict of every row.

    Null and empty texts have no words and fail the base rule. Distances are null under the minimum
    lengths, for a null language, and for languages with fewer than ``min_reference_documents`` judged
    documents; a null distance rejects nothing. Repeated rows get the same verdict. An empty table gives an
    empty result. The text is scanned twice and never shuffled.
    """
    references = language_references(docs, text, lang, rules)
    references = stage(references.where(F.col("ref_docs") >= rules.min_reference_documents), "references")
    rows = packed(docs)
    few = references.count() <= MAX_BROADCAST_LANGUAGES
    joined = rows.join(
        F.broadcast(references) if few else references,
        F.col(f"doc.`{lang}`").cast("string") == F.col("ref_lang"),
        "left",
    )
    inputs = joined.select(
        "doc",
        F.col(f"doc.`{text}`").cast("string").alias("body"),
        "ref_lang",
        "ref_docs",
        "ref_classes",
        "ref_words",
        "ref_weights",
    )

    def measure(batches):
        known: dict[str, tuple] = {}
        for batch in batches:
            columns = [batch.column(i) for i in range(1, 7)]
            texts = columns[0].to_pylist()
            languages = columns[1].to_pylist()
            out = []
            for i, (body, language) in enumerate(zip(texts, languages)):
                if language is not None and language not in known:
                    total = columns[2][i].as_py() * SCALE
                    classes = np.array(columns[3][i].as_py(), float)
                    weights = np.array(columns[5][i].as_py(), float)
                    common = {w.encode(): k for k, w in enumerate(columns[4][i].as_py())}
                    rest = max(0.0, total - weights.sum())
                    known[language] = (classes / classes.sum(), common, np.append(weights, rest) / total)
                out.append(judge(body or "", known.get(language), rules))
            results = [pa.array(values, kind) for values, kind in zip(zip(*out), KINDS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *results], names=["doc", *NAMES]
            )

    return inputs.mapInArrow(measure, with_fields(rows.schema, MEASURES))


NAMES = [part.split()[0] for part in MEASURES.split(", ")]
KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]


def judge(body: str, reference: tuple | None, rules: Rules) -> tuple:
    """Measures, distances and verdict of one text."""
    raw = body.encode()
    words = raw.split()
    counts = base_counts(body, raw, words)
    n_words, repeated = counts[0], counts[4]
    failed = n_words < rules.min_words or 100 * repeated > rules.max_repeat_percent * n_words
    by_class = by_word = None
    if reference is not None and len(body) >= rules.min_class_chars:
        by_class = distance(np.array(class_counts(body, raw), float), reference[0])
    if reference is not None and n_words >= rules.min_histogram_words:
        common = reference[1]
        histogram = np.zeros(len(common) + 1)
        for word in raw.lower().split():
            histogram[common.get(word, -1)] += 1
        by_word = distance(histogram, reference[2])
    kept = not failed
    kept = kept and not (by_class is not None and by_class > rules.max_class_distance)
    kept = kept and not (by_word is not None and by_word > rules.max_word_distance)
    return (*counts, failed, by_class, by_word, kept)

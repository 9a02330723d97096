"""Licence scan with a positional index of rare licence words, in DataFrame functions only.

Every template is posted under one word of its mandatory key phrase: the one with the highest IDF in the
scanned corpus. Where a file has that word, the posting gives the place at which the template would start;
the other words are compared at their relative positions, weighted by IDF, and the key phrase must stand
there whole. As the posted word belongs to the key phrase, no place is missed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankflow.llm.common import packed, whole_text

# Fixed values of the contract: places of these phrases are counted.
BASE_PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# label, key phrase, wording around it
TEMPLATES = [
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "gnu general public license version 3", "under the gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "under the gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "under the gnu affero general public license"),
    ("mit", "mit license", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted",
    ),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("creative-commons", "creative commons attribution", "under a creative commons attribution license"),
    ("unlicense", "unencumbered software released into the public domain",
     "this is free and unencumbered software released into the public domain"),
]
# Words that may be posted; every key phrase has at least one.
LICENCE_WORDS = (
    "license", "reserved", "cc", "gnu", "apache", "mozilla", "affero", "lesser", "creative", "commons",
    "redistribution", "hereby", "unencumbered",
)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def all_templates() -> list[tuple[str, bool, list[str], int, int]]:
    """Label, whether it is a base phrase, words, and start and length of the key phrase."""
    out = [(label, True, phrase.split(), 0, len(phrase.split())) for label, phrase in BASE_PHRASES.items()]
    for label, key, wording in TEMPLATES:
        words, keys = wording.split(), key.split()
        start = next(i for i in range(len(words)) if words[i : i + len(keys)] == keys)
        out.append((label, False, words, start, len(keys)))
    return out


def with_words(docs: DataFrame, text: str) -> DataFrame:
    """``doc``, the word count, and the words of texts that contain a licence word (else no words).

    The test for a licence word is on the lower-cased text as a whole, which finds at least all of them.
    """
    rows = packed(docs).withColumn("body", whole_text(F.col(f"doc.`{text}`")))
    rows = rows.withColumn("low", F.lower("body"))
    found = F.lit(False)
    for word in LICENCE_WORDS:
        found = found | F.contains("low", F.lit(word))
    split = F.split(F.translate("body", UPPER, LOWER), BREAKS)
    return rows.select(
        "doc",
        F.regexp_count("body", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(found, F.array_remove(split, "")).alias("words"),
    )


def word_weights(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """IDF of each licence word over all documents; one row a licence word comes back, none by document."""
    rows = with_words(docs, text)
    listed = F.array(*[F.lit(w) for w in LICENCE_WORDS])
    present = F.array_intersect(listed, F.coalesce("words", F.array().cast("array<string>")))
    counts = rows.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("word"))
    found = {r["word"]: r["n"] for r in counts.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = found.pop("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1e-6 for w in LICENCE_WORDS}


def postings(weights: dict[str, float]) -> list[dict]:
    """The index: each template under the rarest licence word of its key phrase."""
    out = []
    for label, base, words, start, length in all_templates():
        places = [i for i in range(start, start + length) if words[i] in weights]
        anchor = max(places, key=lambda i: (weights[words[i]], words[i]))
        scores = [weights.get(w, 1.0) for w in words]
        out.append(
            {"label": label, "base": base, "anchor": words[anchor], "at": anchor, "words": words,
             "weights": [s / sum(scores) for s in scores], "start": start, "length": length}
        )
    return out


def posting_column(index: list[dict]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(p["anchor"]).alias("anchor"),
                F.lit(p["at"]).alias("at"),
                F.array(*[F.lit(w) for w in p["words"]]).alias("words"),
                F.array(*[F.lit(float(w)) for w in p["weights"]]).alias("weights"),
                F.lit(p["start"]).alias("start"),
                F.lit(p["length"]).alias("length"),
                F.lit(p["label"]).alias("label"),
                F.lit(p["base"]).alias("base"),
            )
            for p in index
        ]
    )


def license_scan(docs: DataFrame, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """Struct ``doc`` with the input columns, and the findings of every row.

    Columns: ``n_words, n_base, first_word, last_word, base_labels, labels, score``. ``n_base`` counts the
    places of base phrases and ``score`` is the best IDF-weighted share of a verified template's words,
    0 without one. A verified key phrase gives its label, however common licence words are in the corpus;
    with ``min_score`` a caller may ask for more of the wording. Base phrases count always. Null and empty texts have no words and no labels. No row is dropped, merged or shuffled.
    """
    index = postings(word_weights(docs, text))
    anchors = F.array(*[F.lit(w) for w in sorted({p["anchor"] for p in index})])
    rows = with_words(docs, text)
    words = F.col("words")
    hits = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda h: F.array_contains(anchors, h.w),
    )
    places = F.flatten(
        F.transform(
            hits,
            lambda h: F.transform(
                F.filter(posting_column(index), lambda p: p.anchor == h.w),
                lambda p: F.struct((h.i - p.at).alias("at"), p.alias("p")),
            ),
        )
    )

    def key_stands(c: Column) -> Column:
        first = c.at + c.p.start
        whole = F.slice(words, F.greatest(first + 1, F.lit(1)), c.p.length)
        return (first >= 0) & (whole == F.slice(c.p.words, c.p.start + 1, c.p.length))

    def share(c: Column) -> Column:
        # get() gives null outside the text, which matches nothing
        return F.aggregate(
            F.transform(
                c.p.words,
                lambda w, j: F.when(F.get(words, c.at + j) == w, F.get(c.p.weights, j)).otherwise(0.0),
            ),
            F.lit(0.0),
            lambda total, x: total + x,
        )

    scanned = rows.select("doc", "n_words", "words", F.filter(places, key_stands).alias("places"))
    scored = scanned.select(
        "doc",
        "n_words",
        F.coalesce(
            F.transform(
                "places",
                lambda c: F.struct(
                    (c.at + c.p.start).alias("start"),
                    c.p.label.alias("label"),
                    c.p.base.alias("base"),
                    F.least(F.round(share(c), 9), F.lit(1.0)).alias("score"),
                ),
            ),
            F.array().cast("array<struct<start:int,label:string,base:boolean,score:double>>"),
        ).alias("places"),
    )
    verified = scored.select(
        "doc", "n_words", F.filter("places", lambda c: c.base | (c.score >= min_score)).alias("places")
    ).withColumn("base", F.filter("places", lambda c: c.base))
    return verified.select(
        "doc",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("labels"),
        F.coalesce(F.array_max("places.score"), F.lit(0.0)).alias("score"),
    )

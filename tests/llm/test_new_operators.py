"""Resampling, runs and packing against brute force, and on awkward rows."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bankflow.llm import importance, jaccard_join, mixing, packing, queries
from bankflow.llm.common import new_path
from bankflow.llm.html_dom import parse
from bankflow.llm.periodic_runs import find_runs, periodic_runs
from bankflow.llm.word_memory import LowerWordMemory, WordMemory, check_byte_level, check_lower_words
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, doc string, rank string, words string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long, periodic and repeated rows; other columns named like results."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "É ß ab    cd"), (6, "a b c " * 10), (6, "a b c " * 10),
        (None, "a " * 24), (None, None), (7, long), (8, ("p q r s t " * 20_000) + long[:5000]), (9, "a " * 23),
        (10, "x y\n" * 8 + "x"), (11, "1 2 3 4 " * 200 + "5 6 7 " * 8),
    ]
    return spark.createDataFrame([(d, t, "r", "d", "k", "w") for d, t in rows], SCHEMA), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- resampling -----------------------------------------------------------------------------


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    both = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in both]


def resampled(docs, target, percent=25, least=20):
    source, aim = np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)
    found = [(d, *features(t)) for d, t in docs]
    for _, _, f in found:
        np.add.at(source, f, 1)
    for t in target:
        np.add.at(aim, features(t)[1], 1)
    s_all, t_all = int(source.sum()), int(aim.sum())
    gains = [
        math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000))))
        for s, t in zip(source.tolist(), aim.tolist())
    ]
    rows = []
    for d, n, f in found:
        weight = sum(gains[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return rows, drawn


def test_resampling_equals_brute_force(spark, texts):
    target = [r["text"] for r in queries.table(spark, SF, "benchmark").collect()]
    rows, drawn = resampled(texts, target)
    ranks = {r[0]: i for i, r in enumerate(drawn, 1)}
    got = queries.op11_importance_resample(spark, SF).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(
        (d, f, w, s, ranks.get(d)) for d, _, f, w, s in rows
    )
    assert len(drawn) == 25 * sum(r[1] >= 20 for r in rows) // 100


def test_resampling_of_odd_rows(spark, odd, empty):
    df, rows = odd
    target = spark.createDataFrame([("a b c d e",), (None,)], "text string")
    got = importance.importance_resample(df, target, percent=50)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want, drawn = resampled(rows, ["a b c d e", None], percent=50)
    key = repr
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == sorted(want, key=key)
    ranked = sorted((r["rank"], r["score"]) for r in got.collect() if r["rank"])
    assert ranked == [(i, r[4]) for i, r in enumerate(drawn, 1)]
    # A draw does not depend on partitions; an empty target or table is no error.
    again = importance.importance_resample(df.repartition(7), target, percent=50)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))
    assert importance.importance_resample(df, target.limit(0)).count() == len(rows)
    assert importance.importance_resample(empty, target).count() == 0


# -- runs -----------------------------------------------------------------------------------


def plain_runs(words, least=24, exponent=3):
    found, n = set(), len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                part = words[i : j + q]
                if not any(part[: len(part) - p] == part[p:] for p in range(1, q)):
                    found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_text(rnd):
    n, letters = rnd.randint(0, 200), rnd.choice([1, 2, 2, 3, 5, 40])
    words = [rnd.randrange(letters) for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if n > 30:
            start, stop = rnd.randrange(n - 10), rnd.randint(1, n)
            period = rnd.randint(1, max(1, (n - start) // 3))
            for x in range(start + period, min(n, start + stop)):
                words[x] = words[x - period]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    docs = [random_text(rnd) for _ in range(60)]
    sizes = [len(d) for d in docs]
    first = np.concatenate([[0], np.cumsum(sizes)])
    start, length, period = find_runs(
        np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), sizes)
    )
    owner = np.searchsorted(first, start, side="right") - 1
    got = [[] for _ in docs]
    for d, *run in zip(owner.tolist(), (start - first[owner]).tolist(), length.tolist(), period.tolist()):
        got[d].append(tuple(run))
    assert got == [plain_runs(d) for d in docs]


def test_long_runs():
    n = 200_000
    assert [c.tolist() for c in find_runs(np.zeros(n, np.int64), np.zeros(n, np.int64))] == [[0], [n], [1]]
    words = np.concatenate([np.arange(n // 2), np.arange(n // 2) % 997])
    start, length, period = find_runs(words, np.zeros(n, np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([n // 2], [n // 2], [997])


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def test_run_query_equals_brute_force(spark, texts):
    short = {d: t for d, t in texts if len(t or "") < 15_000}
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()]
    assert len(got) == len(texts)
    want = [expected_row(d, t) for d, t in short.items()]
    assert sorted(r for r in got if r[0] in short) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 5


def test_runs_of_odd_rows(odd, empty):
    df, rows = odd
    found = periodic_runs(df)
    assert found.columns == ["doc", "n_words", "runs", "collapsed"] and found.select("doc.*").columns == df.columns
    got = {(r["doc"]["doc_id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()}
    assert found.count() == len(rows)
    assert got[1, 0] == got[2, 0] == got[3, 0] == got[None, 0] == ([], "")
    assert got[6, 30] == ([(0, 30, 3)], "a b c") and got[None, 24] == ([(0, 24, 1)], "a")
    assert got[9, 23] == ([], " ".join("a" * 23)) and got[10, 17] == ([], " ".join("x y".split() * 8 + ["x"]))
    assert got[11, 824] == ([(0, 800, 4), (800, 24, 3)], "1 2 3 4 5 6 7")
    assert got[8, 100_000 + len(dict(rows)[8].split()) - 100_000][0] == [(0, 100_000, 5)]
    assert periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, min_length=20)


# -- packing --------------------------------------------------------------------------------


def test_best_fit_takes_the_tightest_window():
    rnd = random.Random(3)
    for _ in range(200):
        capacity = rnd.choice([5, 8, 16, 33])
        lengths = np.array([rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60))], np.int64)
        window, offset = packing.best_fit_decreasing(lengths, capacity)
        free = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [f for f in free if f >= lengths[i]]
            if not fits:
                free.append(capacity)
                assert window[i] == len(free) - 1
            else:
                assert free[window[i]] == min(fits)
            assert offset[i] == capacity - free[window[i]]
            free[window[i]] -= lengths[i]


def checked_pieces(pieces, docs, capacity=1024):
    """Each id in one piece, sequences gapless; returns the share of padding. ``docs`` has no repeated keys."""
    tokenizer = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    used = padding = 0
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        used, padding = used + at, padding + packing.padded_length(at, capacity) - at
    return padding / (used + padding)


def test_packing_round_trip(spark, texts):
    assert checked_pieces(queries.op13_packing(spark, SF).collect(), texts) < 0.02


def test_packing_of_odd_rows(spark, odd, empty):
    df, rows = odd
    path = new_path(spark, "test")
    file = queries.tokenizer_file("byte_bpe_50k.json")
    packing.write_sequences(df.where("doc_id is not null and doc_id <> 6"), path, file, block_tokens=10_000)
    checked_pieces(packing.read_pieces(spark, path).collect(), [r for r in rows if r[0] not in (None, 6)])
    all_rows = packing.packed_sequences(df, file, capacity=16)
    assert all_rows.agg(F.max("n_tokens")).first()[0] == 16
    starts = all_rows.select(F.explode("pieces").alias("p")).where("p.start = 0")
    assert starts.count() == len(rows) and starts.where("p.doc_id is null").count() == 2
    assert packing.packed_sequences(empty, file).count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        packing.packed_sequences(df, queries.tokenizer_file("word_bpe_49k.json"))
    with pytest.raises(TypeError):
        packing.packed_sequences(df, file, doc_id="runs")


def test_padding_rule():
    assert [packing.padded_length(n, 1024) for n in (1, 2, 3, 512, 700, 1024)] == [1, 2, 1024, 512, 1024, 1024]


SIGNS = [
    "a", "B", "é", "É", "ɐ", "İ", "Σ", "ŉ", "ǅ", "1", "٣", "'", "s", "re", ".", ",", "!", "?", ";", " ", " ", " ", "  ", "\n",
    "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "<|endoftext|>", "<|ENDOFTEXT|>", "-", "漢", "e\u0301",
    "😀", "\x00", "'s", "’",
]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(
    "name, kind", [("byte_bpe_50k.json", WordMemory), ("word_bpe_49k.json", LowerWordMemory)]
)
def test_remembered_ids_are_the_tokenizers(seed, name, kind, monkeypatch):
    monkeypatch.setattr("bankflow.llm.word_memory.MAX_WORDS", 500)  # so that it is emptied now and then
    rnd = random.Random(seed)
    with open(queries.tokenizer_file(name), encoding="utf-8") as file:
        memory = kind(file.read(), "<u4")
    for _ in range(12):
        some = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
        assert memory.payloads(pa.array(some, pa.string())) == memory.plain(some)


def test_other_tokenizers_are_refused():
    descriptions = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        with open(queries.tokenizer_file(name), encoding="utf-8") as file:
            descriptions[name] = json.load(file)
    check_byte_level(descriptions["byte_bpe_50k.json"])
    check_lower_words(descriptions["word_bpe_49k.json"])
    with pytest.raises(ValueError):
        check_byte_level(descriptions["word_bpe_49k.json"])
    with pytest.raises(ValueError):
        check_lower_words(descriptions["byte_bpe_50k.json"])


# -- pages ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page",
    ["<font>" * 25_000 + "<p>x</p>" * 25_000, "<a b='x\" " * 100_000, "<b " * 300_000, "<i>" * 100_000 + "</u>" * 100_000,
     "<b>" + "<div>" * 50_000 + "</b>" * 50_000, "<div><td></td>" * 30_000, "<a b='x\" >" * 100_000],
)
def test_broken_pages_take_time_in_proportion(page):
    start = time.process_time()
    parse(page)
    assert time.process_time() - start < 10


def test_quotes_that_never_close():
    root, texts = parse("<p>one</p><a title=\"x><p>two > three</p>")
    assert texts == ["one", "two > three"]


# -- earlier operators, mended ------------------------------------------------------------------


@pytest.mark.parametrize("percent", [40, 50, 60])
def test_low_bounds_lose_no_link(spark, percent):
    rnd = random.Random(percent)
    rows = []
    for k in range(60):
        own = [f"d{k}w{i}" for i in range(rnd.randint(30, 100))]
        rows.append((k, " ".join(own)))
        # A part of it, around the bound: a much smaller set.
        part = max(4, int(len(own) * (percent + rnd.randint(-6, 10)) / 100))
        rows.append((1000 + k, " ".join(own[:part])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicates(df, width=3, percent=percent).collect()
    want = brute.components(rows, 3, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({root for _, root in want.values()}) < len(rows)


def test_targets_that_contradict_each_other_are_an_error(spark):
    cells = spark.createDataFrame([("a", "x", 90), ("b", "y", 10)], "s string, l string, tokens long")
    targets = {"s": {"a": 0.5, "b": 0.5}, "l": {"x": 0.9, "y": 0.1}}
    with pytest.raises(ValueError, match="off by 0.4"):
        mixing.rake(cells, ["s", "l"], mixing.Mix(targets=targets, max_rounds=4))

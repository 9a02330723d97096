"""Every operator against brute force on the smallest tables, and on awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bankflow.llm import (
    backoff_lm, decontaminate, html_extract, jaccard_join, license_scan, line_dedup, mixing, quality_rules,
    queries, sharding, token_store,
)
from bankflow.llm.common import new_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, kept string, shard string"


@pytest.fixture(scope="module")
def texts(spark):
    rows = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long and repeated rows; other columns named like results."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Same words here now"), (6, "same WORDS here now"),
        (6, "same WORDS here now"), (None, "no id at all here"), (None, None), (7, long), (8, long + " end"),
        (9, "It is under CC BY-NC 4.0.\nAll rights reserved. CC BY"), (10, "é ß   x"), (11, "a b c d\na b c d"),
    ]
    return spark.createDataFrame([(d, t, None, None, None, "d", "k", "s") for d, t in rows], SCHEMA), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lm_scores_equal_brute_force(spark, texts, odd, empty):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    held = F.col("doc_id") % 7 == 2
    got = {r["doc_id"]: r for r in backoff_lm.lm_scores(df, held, mu=5.0, block_bytes=60_000).collect()}
    want = brute.bigram_scores([(t, d % 7 == 2) for d, t in texts], 5.0)
    for (d, _), (n, known, total, base, score) in zip(texts, want):
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (n, known, total)
        assert got[d]["base_score"] == pytest.approx(base) and got[d]["score"] == pytest.approx(score)
    assert backoff_lm.lm_scores(odd[0], F.col("doc_id") == 4, order=3).count() == len(odd[1])
    assert backoff_lm.lm_scores(empty, F.lit(False)).count() == 0


def test_lm_model_beats_unigrams_on_held_out_texts(spark):
    rows = queries.op1_backoff_lm(spark, "/root/testdata/sf0.01").where("held_out")
    sums = rows.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums["s"] > sums["b"]


def test_quality_counts_equal_brute_force(spark, texts, odd, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for d, t in texts + odd[1]:
        got = quality_rules.judge(t or "", None, quality_rules.Rules())
        assert got[:6] == brute.base_quality(t), d
    for n in range(40):
        own = [random.Random(n).choice("ab") for _ in range(n)]
        assert quality_rules.repeated_words([w.encode() for w in own]) == brute.repeat_words(own)
    got = quality_rules.quality_rules(odd[0])
    assert got.count() == len(odd[1]) and set(names) < set(got.columns)
    assert got.where("kept and base_failed").count() == 0
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_keeps_good_documents_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.1"
    judged = queries.op2_quality_rules(spark, sf).where("not base_failed")
    rows = judged.join(queries.table(spark, sf, "labels"), "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")
    )
    kept = {r["quality"]: r["kept"] for r in rows.collect()}
    assert kept[1] > 0.995 and kept[0] < 0.4


def test_lines_equal_brute_force(spark, texts, odd, empty):
    rng = random.Random(5)
    docs = [(i, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(3))) for i in range(60)]
    for rows in (docs, [r for r in odd[1] if r[0] not in (None, 6)], texts[:60]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        removed = line_dedup.removed_lines(df)
        got = {(r[0], r[1]): tuple(r)[2:] for r in removed.collect()}
        assert got == brute.near_lines(rows)
    assert line_dedup.removed_lines(odd[0]).count() >= 1
    assert line_dedup.removed_lines(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c\nx"), (2, None), (3, "a b d\n\ny z")], "doc_id long, text string")
    cut = line_dedup.without_lines(df, line_dedup.removed_lines(df)).orderBy("doc_id").collect()
    assert [r["text"] for r in cut] == ["a b c\nx", None, "\ny z"]


def test_token_store_round_trip(spark, texts, odd, empty):
    from tokenizers import Tokenizer

    file = queries.tokenizer_file()
    tokenizer = Tokenizer.from_file(file)
    strange = "Hello <|endoftext|>x don't IT'S ΑΣ. é. İx \x1ca \x85b a.b, 12.5, x1. '' ... ."
    rows = texts + [(10_000_000, strange), (-5, None), (None, "x"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = new_path(spark, "test-tokens")
    token_store.write_token_store(df, path, file, by_word=True, shard_tokens=20_000, part_bytes=100_000)
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    want = {}
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append((len(ids), brute.crc(np.array(ids, "<u4").tobytes())))
    found, start, keys = {}, 0, []
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        keys.append(r["doc_id"])
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    picked = token_store.lookup(spark, path, [3, 10_000_000, 999_999]).collect()
    assert sorted(len(r["ids"]) for r in picked) == sorted(n for k in (3, 10_000_000) for n, _ in want[k])
    for df in (odd[0], empty):
        path = new_path(spark, "test-tokens")
        token_store.write_token_store(df, path, file, by_word=True)
        assert token_store.read_documents(spark, path).count() == df.count()
    with pytest.raises(TypeError):
        token_store.write_token_store(odd[0].withColumn("doc_id", F.lit("a")), path, file)


def test_hash_index_is_minimal_and_finds_strangers_out():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    sizes, bits = token_store.build_index(keys)
    index = token_store.Index(sizes, bits, np.zeros(len(keys), np.uint32))
    index.fingerprints = np.zeros(len(keys), np.uint32)
    assert bits.sum() == len(keys) and index.ranks[-1] == len(keys)


def test_license_places(spark, odd, empty):
    rows = [
        (1, "Licensed under CC BY-NC 4.0. All rights reserved; ALL RIGHTS RESERVED"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "General public licenses and cc-by? cc\x00by"), (4, None), (5, "mit in der Lizenz"),
        (6, "Released under the MIT License."), (7, "cc"), (8, "reserved rights all"), (9, "X cc by"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc"]["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    line = lambda d: (got[d]["n_words"], got[d]["n_base"], got[d]["first_word"], got[d]["last_word"], got[d]["base_labels"], got[d]["labels"])
    assert line(1) == (13, 3, 2, 10, "cc-by,reserved", "cc-by,cc-by-nc,reserved")
    assert line(2) == (12, 1, 7, 7, "gpl", "gpl,gpl-3.0")
    assert line(3) == (8, 2, 4, 6, "cc-by", "cc-by")
    assert line(4) == (0, 0, None, None, "", "") and got[4]["score"] == 0
    assert line(6) == (5, 0, None, None, "", "mit") and line(7)[1] == line(8)[1] == 0
    assert line(9)[1:4] == (1, 1, 1) and got[9]["score"] == 1
    assert license_scan.license_scan(odd[0]).count() == len(odd[1])
    assert license_scan.license_scan(empty).count() == 0


@pytest.mark.parametrize("width,percent,block", [(4, 85, 1500), (5, 80, 40)])
def test_components_equal_brute_force(spark, texts, width, percent, block):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    rows = list(texts)
    for k in range(150):  # near copies of one text around the bound, more than a block holds
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10_000)}"
        rows.append((100_000 + k, " ".join(own)))
    rows += [(200_000 + k, " ".join(rng.choice("pqr") for _ in range(rng.randint(1, 9)))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.near_duplicates(df, width=width, percent=percent, block_docs=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(rows, width, percent)


def test_components_of_odd_rows(odd, empty):
    got = jaccard_join.near_duplicates(odd[0]).collect()
    assert len(got) == len(odd[1])
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert [component[d] for d in (1, 2, 3, 4, 5, 6, 7, 8, 11, None)] == [1, 2, 3, 4, 5, 5, 7, 7, 11, None]
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_seeds_meet_all_substitutions(spark, odd, empty):
    base = [f"b{i}" for i in range(13)]
    rows = []
    for i in range(13):
        for j in range(i, 13):
            own = [f"x{k}" if k in (i, j) else w for k, w in enumerate(base)]
            rows.append((i * 13 + j, "Some words " + " ".join(own).upper() + ", behind"))
    rows += [(900, " ".join(f"x{k}" if k in (1, 5, 9) else w for k, w in enumerate(base))), (901, "k1 k2 k3 k4 k5"),
             (902, "k1 k2 zz k4 k5"), (903, None), (904, " ".join(base[:10])),
             (905, "x y " + " ".join(base[:11]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(
        [(1, " ".join(base)), (2, "k1 k2, k3 k4. K5"), (3, "k1 k2"), (4, None), (5, "")], "item_id long, text string"
    )
    got = decontaminate.benchmark_overlaps(df, bench)
    assert {(r[0], r[1]) for r in got.select("doc_id", "item_id").collect()} == {
        (d, 1) for d, _ in rows if d < 900
    } | {(901, 2), (905, 1)}
    assert {r["doc_start"] for r in got.where("doc_id < 900").collect()} == {2}
    assert decontaminate.benchmark_overlaps(odd[0], bench).count() == 0
    assert decontaminate.benchmark_overlaps(empty, bench).count() == 0
    assert decontaminate.benchmark_overlaps(df, bench.limit(0)).count() == 0


def test_planted_passages_are_found(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    bench = [r["text"] for r in queries.table(spark, SF, "benchmark").collect()]
    planted = {r["doc_id"] for r in docs if any(b in r["text"] for b in bench)}
    found = {r["doc_id"] for r in queries.op7_benchmark_overlap(spark, SF).collect()}
    assert planted <= found


def test_extraction(spark):
    page = (
        "<html><head><title>T</title></head><body><header class=top><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a>"
        "<li><a href=/b>B</a></ul></nav><div class='cookie notice'><p>We use cookies.</p></div><article><h1>A &amp; B</h1>"
        "<p>First  part,\n with <b>bold</b> words. More of it here.<p>Second part&nbsp;ends here, as it should."
        "<div class=ad>Buy now.</div></article><section class=comments><h3>Comments</h3><p>Nice post.</p></section>"
        "<footer>&copy; me</footer><script>var x = '<p>no</p>';</script></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain &lt; text"), (5, "u", "<div><p>"), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, text string, html string")
    got = html_extract.extract_main_text(df).select("doc.page_id", F.col("text").alias("main"), "n_chars").collect()
    by_id = {r["page_id"]: r["main"] for r in got}
    assert len(got) == 6 and by_id[2] == by_id[3] == by_id[5] == "" and by_id[4] == "plain < text"
    assert by_id[1] == "A & B\nFirst part, with bold words. More of it here.\nSecond part ends here, as it should."
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_extraction_on_pages_it_was_not_trained_on(spark):
    from bankflow.llm.html_dom import parse
    from bankflow.llm.html_pages import Maker, labels, render

    trees = html_extract.train(spark)
    wrong = total = 0
    for seed in range(50_000, 50_200):
        page = Maker(seed).page()
        root, _ = parse(render(page))
        nodes, x = html_extract.features(root)
        kept = html_extract.decode(root, nodes, html_extract.margins(trees, x))
        for node, label in zip(nodes, labels(page)):
            wrong += sum((r in kept) != (label == 1) for r in node.runs)
            total += len(node.runs)
    assert wrong < 0.02 * total


def test_jump_hash_and_slots(spark, odd, empty):
    keys = np.random.default_rng(2).integers(0, 1 << 63, 2000).astype(np.uint64)
    for shards in (1, 2, 40, 41):
        assert sharding.jump(keys, shards).tolist() == [brute.jump(int(k), shards) for k in keys]
    got = queries.op9_jump_hash(spark, "/root/testdata/sf0.01").collect()
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)
    placed = sharding.shard_documents(odd[0], 7).collect()
    assert len(placed) == len(odd[1]) and {r["size"] for r in placed if r["doc_id"] in (1, 2)} == {16}
    assert sharding.shard_documents(empty, 7).count() == 0


def test_raking_fits_marginals(spark, odd, empty):
    cells = [("a", "x", 90), ("a", "y", 10), ("b", "x", 20), ("b", "y", 80), (None, "x", 5)]
    df = spark.createDataFrame(cells, "s string, l string, tokens long")
    mix = mixing.Mix(targets={"s": {"a": 0.5, "b": 0.5}, "l": {"x": 0.3, "y": 0.7}})
    got = {(r["s"], r["l"]): r["weight"] for r in mixing.rake(df, ["s", "l"], mix).collect()}
    w = np.array([[90.0, 10.0], [20.0, 80.0]])
    for _ in range(200):
        w *= (np.array([0.5, 0.5]) / w.sum(1))[:, None]
        w *= np.array([0.3, 0.7]) / w.sum(0)
    assert [got["a", "x"], got["a", "y"], got["b", "x"], got["b", "y"]] == pytest.approx(w.ravel().tolist(), abs=1e-5)
    assert got[None, "x"] == 0
    dims = queries.document_dimensions()
    assert mixing.mixed(odd[0], dims).count() == len(odd[1])
    assert mixing.mixed(empty, dims).count() == 0
    rows = queries.op10_raked_mix(spark, "/root/testdata/sf0.1")
    sums = rows.groupBy("source").agg(
        F.sum(F.col("probability") * F.col("n_tokens")).alias("expected"),
        F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("drawn"),
    ).collect()
    total = sum(r["expected"] for r in sums)
    target = {r["source"]: r["t"] ** 0.9 for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    for r in sums:
        assert r["expected"] / total == pytest.approx(target[r["source"]] / sum(target.values()), rel=1e-3)
        assert r["drawn"] == pytest.approx(r["expected"], rel=0.3)

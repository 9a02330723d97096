"""The pipeline's stages, each against a brute-force version of its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from bankflow.llm import queries
from bankflow.llm.common import stage
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    for name, function in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = function(spark, docs, SF)
        if name == "tokens":
            assert {r["doc_id"] for r in after.collect()} == set(before)
            break
        assert sorted(after.columns) == sorted(COLUMNS)
        after = stage(after, "test")
        left = {r["doc_id"] for r in after.collect()}
        if name == "quality":
            assert not [d for d in left if brute.base_quality(before[d])[5]]
            assert len(left) > 0.8 * sum(not brute.base_quality(t)[5] for t in before.values())
        elif name == "near_duplicates":
            groups = brute.components(list(before.items()), 5, 80)
            assert left == {root for _, root in groups.values()}
        elif name == "decontamination":
            bench = [r["text"] for r in queries.table(spark, SF, "benchmark").collect()]
            assert not [d for d in left if any(b in before[d] for b in bench)]
            assert len(left) > 0.9 * len(before)
        elif name == "mixing":
            assert 0.2 * len(before) < len(left) <= len(before)
        docs = after
    assert len(before) == corpus_pipeline.run(spark, SF).select(F.col("doc_id")).count()


def test_rows_without_ids_are_judged_one_by_one(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    clean, copied, other = (" ".join(words[a : a + 60]) for a in (0, 100, 200))
    passage = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [
        (None, clean), (None, copied), (None, copied), (None, f"{other} {passage}"), (None, None), (None, ""),
        (7, copied + " end"), (8, None),
    ]
    columns = "doc_id long, text string, first string, shared_id long, own_id long, doc string, print string"
    docs = spark.createDataFrame([(*r, "f", 1, 2, "d", "p") for r in rows], columns)

    one = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    # The copy with an id has the smallest one of its group.
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in one.collect()))) == sorted(
        map(repr, [rows[0], rows[3], rows[4], rows[5], rows[6], rows[7]])
    )
    left = corpus_pipeline.keep_uncontaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(repr((r["doc_id"], r["text"])) for r in left.collect()) == sorted(
        repr(r) for i, r in enumerate(rows) if i != 3
    )
    nothing = docs.limit(0)
    for keep in (corpus_pipeline.keep_one_of_each, corpus_pipeline.keep_uncontaminated):
        assert keep(spark, nothing, str(tmp_path)).count() == 0

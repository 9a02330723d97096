"""Registered queries of the operators: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankflow.llm import backoff_lm, decontaminate, html_extract, importance, jaccard_join, license_scan
from bankflow.llm import line_dedup, mixing, packing, periodic_runs, quality_rules, sharding, token_store
from bankflow.llm.common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2
    return backoff_lm.lm_scores(docs, held_out)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc.doc_id", *[c for c in judged.columns if c != "doc"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"), min_copy_words=1)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_store.write_token_store(docs, path, tokenizer_file(), by_word=True)
    return token_store.read_documents(spark, path)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", *[c for c in found.columns if c != "doc"])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_join.near_duplicates(docs, width=4, percent=85)


def op7_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.benchmark_overlaps(docs, benchmark)


def op8_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extract_main_text(pages)
    return found.select("doc.page_id", "doc.url", "text", "n_chars")


def op9_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.withColumn("law", F.lit("key"))


def op10_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.mixed(docs, document_dimensions())
    return mix.select("doc.doc_id", *[c for c in mix.columns if c != "doc"])


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    drawn = importance.importance_resample(docs, benchmark)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """Every tenth document by checksum of its id becomes periodic from some word on."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10).cast("int")
    # The same words as everywhere; a split leaves empty strings at the ends.
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
    periodic = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", a + (i - a) % p)))
    due = (h % 10 == 0) & F.col("text").isNotNull()
    split = docs.select("doc_id", "text", F.when(due, words).alias("words"))
    text = F.when(n > 0, F.array_join(periodic, " ")).otherwise(F.col("text"))
    return split.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))
    # Runs come by start and period, so of equals the first stays.
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda best, run: F.when(run.length * best.period > best.length * run.period, run).otherwise(best),
    )
    listed = F.array_join(
        F.transform("runs", lambda run: F.concat_ws(",", run.start, run.length, run.period)), "\n"
    )
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc.doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines")
    ).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode("lines", "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sequences")
    docs = table(spark, sf_dir, "documents")
    packing.write_sequences(docs, path, tokenizer_file("byte_bpe_50k.json"))
    return packing.read_pieces(spark, path)


def document_dimensions() -> dict:
    return {
        "source": F.col("source"),
        "lang": F.col("lang"),
        "topic": mixing.topic_of(F.col("text")),
    }


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_backoff_lm, op2_quality_rules, op3_line_dedup, op4_token_store, op5_license_scan,
        op6_jaccard_join, op7_benchmark_overlap, op8_html_trees, op9_jump_hash, op10_raked_mix,
        op11_importance_resample, op12_periodic_runs, op13_packing,
    )
}

ORACLE_SQL: dict[str, str] = {}

"""Corpus pipeline: documents in, token shards out. Every stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankflow.llm.common import new_path, packed_struct, stage
from bankflow.llm.decontaminate import benchmark_overlaps
from bankflow.llm.jaccard_join import near_duplicates
from bankflow.llm.mixing import mixed
from bankflow.llm.quality_rules import quality_rules
from bankflow.llm.queries import document_dimensions, table, tokenizer_file
from bankflow.llm.token_store import read_documents, write_token_store


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where("kept").select("doc.*")


def with_own_ids(docs: DataFrame) -> DataFrame:
    """``own_id``, one for each id and text, beside all columns in a struct ``doc``, where no name can clash.

    It is ``doc_id`` but for rows without an id and for further texts under one id (as from merged sources),
    which get a hash of id and text, set above 2 ** 62 so that it is no smaller than usual ids.
    """
    boxed = docs.select(packed_struct(docs).alias("doc"))
    rows = boxed.select("doc", F.col("doc.doc_id").cast("long").alias("id"), F.xxhash64("doc.text").alias("print"))
    named = rows.where(F.col("id").isNotNull())
    ends = named.groupBy("id").agg(F.min("print").alias("first"), F.max("print").alias("last"))
    shared = stage(
        ends.where(F.col("first") < F.col("last")).select(F.col("id").alias("shared_id"), "first"), "shared-ids"
    )
    joined = rows.join(shared, F.col("id") == F.col("shared_id"), "left")
    other = F.xxhash64("id", "print").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    own = F.when(F.col("id").isNull() | (F.col("first") != F.col("print")), other).otherwise(F.col("id"))
    return joined.select("doc", own.alias("own_id"))


def texts_of(keyed: DataFrame) -> DataFrame:
    return keyed.select("own_id", F.col("doc.text").alias("text"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest id.

    Repeated rows of one id and text are one document, and so are rows without an id that have equal texts;
    different texts under one id, or under none, are different documents.
    """
    keyed = with_own_ids(docs)
    found = near_duplicates(texts_of(keyed), doc_id="own_id")
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("own_id")).distinct()
    left = keyed.join(gone.hint("merge"), "own_id", "left_anti")
    return left.dropDuplicates(["own_id"]).select("doc.*")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, each judged by its own text."""
    keyed = with_own_ids(docs)
    overlaps = benchmark_overlaps(texts_of(keyed), table(spark, sf_dir, "benchmark"), doc_id="own_id")
    hits = overlaps.select(F.col("doc_id").alias("own_id")).distinct()
    return keyed.join(hits, "own_id", "left_anti").select("doc.*")


def keep_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the raked mix of sources, languages and topics, one row a copy."""
    drawn = mixed(docs, document_dimensions()).where("sampled")
    return drawn.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of what is left, every copy of a document included; returns what they hold by document.

    ``copies`` counts a document's copies in the files, and ``shard`` and ``start`` are those of its first.
    Documents without an id are listed one by one.
    """
    path = new_path(spark, "corpus-tokens")
    write_token_store(docs, path, tokenizer_file(), by_word=True)
    held = read_documents(spark, path).withColumn("unnamed", F.when(F.col("doc_id").isNull(), F.col("start")))
    listed = held.groupBy("doc_id", "n_tokens", "ids_crc32", "unnamed").agg(
        F.min(F.struct("start", "shard")).alias("place"), F.count("*").alias("copies")
    )
    return listed.select("doc_id", "place.shard", "place.start", "n_tokens", "ids_crc32", "copies")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("mixing", keep_mixed),
    ("tokens", write_tokens),
]

# Distances, set joins, raking and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus from raw documents to packed sequences: the stages run in this order, each on all its predecessor kept.

Each stage takes and, but for the last, returns the columns of documents. The quality, near-copy and decontamination
stages decide on each row by its own text; line dedup counts a null doc_id as no document and keeps its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import cut, drop_cut, table
from veilframe.llm.decontaminate import clean_documents
from veilframe.llm.jaccard import jaccard_components
from veilframe.llm.linededup import drop_repeated_lines
from veilframe.llm.packing import pack_documents
from veilframe.llm.quality import classify
from veilframe.llm.queries import tokenizer_json


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classify(docs).where("quality_keep").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them; n_chars follows the text."""
    out = drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8) stays, one row of it.

    Rows are told apart by a hash of id and text, so a null or repeated id decides nothing; of a group the
    document with the least hash stays. Rows of different contents under one hash all stay."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    groups = cut(jaccard_components(keyed.select("_key", "text"), n=5, num=80, den=100, id_col="_key").groupBy("doc_id").agg(F.max("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "groups")
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_key"))
    repeated = groups.where("n > 1").select(F.col("doc_id").alias("_key"))
    again_seen = not repeated.isEmpty()
    if again_seen:
        own = keyed.join(repeated, "_key", "left_semi").select("_key", F.xxhash64(F.lit(1), "doc_id", "text").alias("_other"))
        met = own.groupBy("_key").agg(F.count_distinct("_other").alias("n")).where("n > 1").select("_key")
        gone = gone.join(met, "_key", "left_anti")
    kept = keyed.join(gone, "_key", "left_anti")
    if again_seen:  # equal rows: one of them stays
        kept = kept.join(repeated, "_key", "left_anti").unionByName(kept.join(repeated, "_key", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their id."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 4096 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, tokenizer_json())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: the stages fit a model, link near copies, search an index and tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; a stage's stored input is deleted once its output stands."""
    docs, stored = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage{k}")
            if stored is not None:
                drop_cut(stored)
            stored = docs
    return docs

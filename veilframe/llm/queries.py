"""The queries op1_ to op13_ over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licenses import report_sql


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; the driver alone reads it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_json())


#: The key of the registered query; a real run passes its own.
PII_KEY = "registered-query-key"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    return pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vptree import nearest

    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op5_recurrent_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality_score", "quality_keep")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .linededup import drop_repeated_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .warc import derive, responses_from_pages

    records = derive(responses_from_pages(table(spark, sf_dir, "pages")), keep=("page_id",))
    return records.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "refers_to_block_digest", "refers_to_payload_digest", F.octet_length("block").cast("long").alias("block_length"), F.sha2("record", 256).alias("record_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_report

    return license_report(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"), every=20, heads=4)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, coalesce(k.doc_id <> g.keeper, false) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_vantage_point_neighbours": op4_vantage_point_neighbours,
    "op5_recurrent_lm_scores": op5_recurrent_lm_scores,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_license_scan": op10_license_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_toxicity": op13_toxicity,
}
ORACLES: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op10_license_scan": report_sql()}

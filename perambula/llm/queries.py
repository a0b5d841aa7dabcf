"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perambula.llm import html_text, lexicon, oracles, packing, phrases, quality, simhash, suffixes, token_files, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file; only queries and tests name one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", phrases.removed().alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def sequences(docs: DataFrame) -> DataFrame:
    """Packed with the public byte-pair vocabulary; the id after its last one is the end mark."""
    import public_tokenizers

    return packing.pack_texts(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("bin_id", "bin_capacity", "n_tokens", "doc_ids", "pieces", "offsets", "lengths", F.crc32("ids").alias("ids_crc32"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", suffixes.removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op8_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.quality_rules(docs, quality.trusted_documents(table(spark, sf_dir, "labels")), carry=["doc_id"])
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 9 counts before its method's verdict, which SQL cannot express."""
    found = quality.base(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_rans_token_files,
        op3_substring_dedup,
        op4_best_fit_packing,
        op5_warc,
        op6_suffix_array_dedup,
        op7_embedding_near_dedup,
        op8_transducer_bpe,
        op9_quality_rules,
        op10_simhash,
        quality_base_counts,
    )
}
ORACLES = {
    "op3_substring_dedup": oracles.OP3,
    "op5_warc": oracles.OP5,
    "op6_suffix_array_dedup": oracles.OP6,
    "op7_embedding_near_dedup": oracles.OP7,
    "quality_base_counts": oracles.QUALITY_BASE,
}

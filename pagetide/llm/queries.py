"""The registered queries of this subpackage, with the parameters of their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashforest, htmltext, langid, lexical, mixing, phrases, pieces, quality, simhash, substring, suffixes, topk, warc
from .common import shared_folder, table, word_count


# The public vocabulary that operator 10's query encodes with.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document (operator 1).

    The graded rating: 0 for toxic, 1 for low quality, 2 for good.
    """
    docs = table(spark, sf_dir, "documents")
    rating = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = quality.train(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", rating)
    return quality.score(docs, "text", model, {"doc_id": F.col("doc_id")})


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix (operator 2)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mix = mixing.with_copies(docs, "doc_id", "text", "source", word_count(F.col("text")))
    size = F.col("__mix.size")
    return mix.select("doc_id", size.alias("size"), F.col("__mix.source_size").alias("source_size"),
                      F.col("__mix.target").alias("target"), (size * F.col("__mix.copies")).alias("taken"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest integer inner products for every hundredth vector (operator 3)."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, with its layout (operator 4)."""
    return htmltext.extract(table(spark, sf_dir, "pages"), "html", {"page_id": F.col("page_id")})


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document (operator 5)."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document (operator 6)."""
    docs = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    model = langid.train(docs, "text", "lang", langid.learnable(doc_id), langid.by_checksum(doc_id))
    return langid.classify(docs, model, "text", {"doc_id": doc_id, "held_out": langid.held_out(doc_id)})


def op7_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty near neighbours for every twentieth vector (operator 7)."""
    vectors = table(spark, sf_dir, "embeddings")
    forest = hashforest.build_forest(vectors, "vec_id", "embedding")
    return hashforest.search_forest(forest, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 20)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives with revisit records and read back (operator 8)."""
    pages = table(spark, sf_dir, "pages")
    folder = warc.write_archives(warc.resolve(pages), shared_folder(spark, "warc"), warc.records_per_archive(pages))
    return warc.resolved_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without repeated windows of 35 words (operator 9)."""
    found = substring.without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", length=35)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("sha256").alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back (operator 10)."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = pieces.Vocabulary.load(VOCABULARY)
    encoded = pieces.encode(docs, "text", vocabulary, {"doc_id": F.col("doc_id"), "was": F.xxhash64("text")})
    decoded = pieces.decode_ids(encoded, "ids", vocabulary, {"doc_id": F.col("doc_id"), "ids": F.col("ids"), "was": F.col("was")})
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          (F.xxhash64("text") == F.col("was")).alias("round_trip"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language (operator 11)."""
    return phrases.collocations(table(spark, sf_dir, "documents"), "text", "lang", top=2000)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for every benchmark item (operator 12)."""
    return lexical.ranked_search(table(spark, sf_dir, "documents"), "doc_id", "text",
                                 table(spark, sf_dir, "benchmark"), "item_id", "text", 10)


def op13_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document without repeated strings of 400 bytes (operator 13)."""
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", length=400, with_text=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("sha256").alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_ordinal_quality, op2_source_mixing, op3_exact_top_k, op4_page_text, op5_simhash_groups, op6_language,
    op7_hash_forest, op8_warc_revisits, op9_repeated_passages, op10_sentencepiece, op11_collocations, op12_ranked_search,
    op13_repeated_bytes)}

"""A corpus pipeline of five stages, each calling one operator of ``pagetide.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it back as the next stage's documents.  All stages but the last return the
columns of ``documents``; the last returns piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import langid, mixing, pieces, simhash, substring
from pagetide.llm.common import shared_folder, table, word_count
from pagetide.llm.queries import VOCABULARY
from pagetide.session import prepare

# A document stays when its family's probability and its margin inside the family both reach this score.
# Measured on held-out labelled documents (README).
LEAST_SCORE = 0.4


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; ``lang`` stays as it was.  Texts without letters go.  Where no
    document can be learned from (no language, no text, or held-out ids alone), there is nothing to
    recognise by, and all texts with a letter stay."""
    prepare(spark)
    doc_id = F.col("doc_id")
    model = langid.train(docs, "text", "lang", langid.learnable(doc_id), langid.by_checksum(doc_id))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Extra columns may be called like the operator's own: all travel in one struct.
    rows = langid.classify(docs, model, "text", {"__row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}, parts=True)
    kept = rows.where((F.col("lang_pred") != langid.UNKNOWN) & (F.least("family", "margin") >= LEAST_SCORE))
    return kept.select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    prepare(spark)
    return simhash.one_per_group(docs, "doc_id", "text", shingle=4, max_bits=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that repeat; texts without any keep their white space,
    and documents of which nothing is left go."""
    prepare(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    cleaned = substring.without_repeats(docs, "doc_id", "text", length=35, carry={"row": row}, keep_untouched=True)
    out = cleaned.where("n_removed = 0 OR n_removed < n_words").withColumn("text", F.col("kept").cast("string"))
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if length is not None:
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources share all words by weight."""
    prepare(spark)
    return _like(mixing.mixed(docs, "doc_id", "text", "source", word_count(F.col("text"))), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the piece ids of every document of the mix."""
    prepare(spark)
    encoded = pieces.encode(docs, "text", pieces.Vocabulary.load(VOCABULARY),
                            {"doc_id": F.col("doc_id"), "source": F.col("source")})
    return encoded.select("doc_id", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mixing_to_weights", mixing_to_weights), ("encoding", encoding)]

# Trained models and SentencePiece are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs

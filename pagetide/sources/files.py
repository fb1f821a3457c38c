"""File-based inputs of the original study: spreadsheet exports, positional
training-pair CSVs, part-file directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURE_NAMES = ["email_links", "external_outlinks", "images", "internal_outlinks", "meta", "text", "scripts",
                 "tables", "html_tags"]


def read_excel_csv(spark: SparkSession, path: str) -> DataFrame:
    """';'-separated export with a byte-order mark; NUL characters removed from
    every value, the mark removed from the first header name."""
    return read_plain_csv(spark, path, sep=";")


def read_plain_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with a header, all columns strings; NUL characters removed from every value and header name, a byte-order
    mark from the first name."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
    renamed = df.toDF(*[c.lstrip("﻿").replace("\x00", "") for c in df.columns])
    return renamed.select(*[F.translate(F.col(f"`{c}`"), "\u0000", "").alias(c) for c in renamed.columns])


def read_training_pairs(spark: SparkSession, path: str, features: list[str] = FEATURE_NAMES,
                        targets=("text_changed", "internal_outlinks_changed", "external_outlinks_changed")) -> DataFrame:
    """Headerless ``page_id, <features>, <targets>`` rows with a typed schema."""
    schema = T.StructType([T.StructField("page_id", T.StringType())]
                          + [T.StructField(f, T.IntegerType()) for f in features]
                          + [T.StructField(t, T.IntegerType()) for t in targets])
    return spark.read.schema(schema).csv(path)


def combine_part_files(spark: SparkSession, root: str, fmt: str = "csv", schema: T.StructType | None = None,
                       header: bool = False) -> DataFrame:
    """All ``part-*`` files of all sub-directories of ``root`` as one data set."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", header)
    return reader.load(f"{root.rstrip('/')}/*/part-*")


def shorten_change_rows(bits: DataFrame, key: str = "file_name") -> DataFrame:
    """``page_id`` = part of the key after the last ``_``; day1 dropped."""
    rest = [c for c in bits.columns if c not in (key, "day1")]
    return bits.select(F.substring_index(F.col(key), "_", -1).alias("page_id"), *rest)

"""Crawl clean-up: logs, page blobs, validity, crawl order, false duplicates.

One plan for all crawl days: scan logs -> status filter -> join page blobs
-> text -> previous page in crawl order -> duplicate predicate.  The
previous page is found in range partitions with one carried row per border
(``ordering.with_previous``); digests and line hashes travel, texts do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.functions import dates as D
from pagetide.functions import html as H
from pagetide.functions.udfs import matched_elements
from pagetide.operators.ordering import with_previous
from pagetide.session import stored

# Fixed values of the crawler's log format.
SUCCESS_STATUS = "RequestStatus.HEADLESS_SUCCESS"
FILE_PRESENT = "True"
LOG_COLUMNS = ["Stage file", "URL index", "Status code", "Timestamp", "File present", "URL"]
MAX_OVERLAP = 0.75
START_LINES = 3

RAW_LOG_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LOG_COLUMNS])


def crawl_log_lines(spark, path: str, day: str | None = None) -> DataFrame:
    """Every line of the crawler thread logs (CSV with header), parsed, with what is wrong with it.

    ``defects`` holds ``columns`` (more or fewer than six), ``index`` (no whole URL index), ``stage`` (no stage number), ``time``
    and ``day`` (unreadable; the folder has no ``yyyymmdd`` prefix); it is empty for a sound line.  ``line`` is the source of a line
    with a wrong number of columns.  NUL characters are removed from every column.

    ``path`` may be a glob over day directories (``root/*/*.csv``).  The log
    index comes from the file name (``log-thread-K.csv``), the day from the
    ``yyyymmdd`` prefix of the parent directory unless given.
    """
    schema = T.StructType([*RAW_LOG_SCHEMA.fields, T.StructField("_line", T.StringType())])
    # All columns are parsed whatever a query selects: a pruned reader does not notice missing ones.
    raw = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_line").option("columnPruning", False).csv(path)
    clean = raw.select(*[F.translate(F.col(c), "\u0000", "").alias(c) for c in LOG_COLUMNS], "_line", F.col("_metadata.file_path").alias("_path"))
    day_str = F.lit(day) if day else F.regexp_extract("_path", r"/(\d{8})[^/]*/[^/]+$", 1)
    stage_file = F.col("Stage file")
    rows = clean.select(
        D.crawl_day(day_str).alias("day"),
        F.regexp_extract("_path", r"-(\d+)\.[^/.]*$", 1).try_cast("int").alias("log_index"),
        stage_file.alias("stage_file"),
        F.regexp_extract(stage_file, r"_s(\d+)$", 1).try_cast("int").alias("stage_index"),
        F.col("URL index").try_cast("int").alias("url_index"),
        F.col("Status code").alias("status"),
        D.crawl_timestamp("Timestamp").alias("ts"),
        (F.col("File present") == FILE_PRESENT).alias("file_present"),
        F.col("URL").alias("url"),
        F.concat(stage_file, F.lit("-"), F.col("URL index")).alias("page_key"),
        F.col("_line").alias("line"), F.col("_path").alias("path"))
    found = [F.when(bad, F.lit(name)) for name, bad in (
        ("columns", F.col("line").isNotNull()), ("index", F.col("url_index").isNull()), ("stage", F.col("stage_index").isNull()),
        ("time", F.col("ts").isNull()), ("day", F.col("day").isNull()))]
    return rows.withColumn("defects", F.array_compact(F.array(*found)))


DEFECTS = ("columns", "index", "stage", "time", "day")
# A line with one of these defects has no place in the crawl order; the others leave a column null.
REJECTING = ("columns", "index", "stage")


def _rejected() -> Column:
    return F.arrays_overlap("defects", F.array(*[F.lit(d) for d in REJECTING]))


def read_crawl_logs(spark, path: str, day: str | None = None) -> DataFrame:
    """Crawler thread logs of one or many crawl days, without the lines that ``rejected_log_lines`` returns."""
    return crawl_log_lines(spark, path, day).where(~_rejected()).drop("line", "path", "defects")


def log_line_counts(spark, path: str, day: str | None = None) -> DataFrame:
    """(path, lines, rejected, and a count per defect) of every log file: what a read leaves out or leaves empty."""
    tallies = [F.count_if(F.array_contains("defects", d)).alias(d) for d in DEFECTS]
    return crawl_log_lines(spark, path, day).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(_rejected()).alias("rejected"), *tallies)


def rejected_log_lines(spark, path: str, day: str | None = None) -> DataFrame:
    """(path, stage_file, page_key, line, defects) of the lines that cannot be used."""
    return crawl_log_lines(spark, path, day).where(_rejected()).select("path", "stage_file", "page_key", "line", "defects")


def read_page_blobs(spark, path: str, day: str | None = None) -> DataFrame:
    """Page files (one per crawled page, named ``<stage file>-<url index>``).

    ``html`` is the UTF-8 text, or an empty string when the bytes are not
    valid UTF-8 (checked natively, no Python).
    """
    raw = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    day_str = F.lit(day) if day else F.regexp_extract("path", r"/(\d{8})[^/]*/pages/[^/]+$", 1)
    return raw.select(
        D.crawl_day(day_str).alias("day"),
        F.element_at(F.split(F.col("path"), "/"), -1).alias("page_key"),
        F.col("length").alias("size"),
        F.when(valid, text).otherwise(F.lit("")).alias("html"))


def pack_page_files(spark, folders: list[str], target: str, day: str | None = None) -> DataFrame:
    """Page files (one per page) packed into one Parquet data set by day, sorted by page key inside each file.

    One folder at a time: what the driver lists at once is one crawl day, and a run that breaks off goes on with the
    folders that are left (a folder's day is replaced as a whole).  Later reads list a few large files.
    """
    for folder in folders:
        pages = read_page_blobs(spark, folder, day)
        n = max(1, int(pages.agg(F.sum("size")).first()[0] or 0) // PACKED_FILE_BYTES)
        (pages.repartitionByRange(n, "day", "page_key").sortWithinPartitions("day", "page_key")
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(target))
    return read_packed_pages(spark, target)


PACKED_FILE_BYTES = 256 << 20


def read_packed_pages(spark, target: str) -> DataFrame:
    """The pages of ``pack_page_files``, as ``read_page_blobs`` gives them."""
    return spark.read.parquet(target).select("day", "page_key", "size", "html")


def valid_log_entries(logs: DataFrame) -> DataFrame:
    """Successful headless fetches whose page file is present."""
    return logs.filter(F.col("file_present") & (F.col("status") == SUCCESS_STATUS))


def with_order_index(df: DataFrame, log: str = "log_index", stage: str = "stage_index",
                     url_index: str = "url_index") -> DataFrame:
    """order_index = log * 1e9 + stage * 1e6 + url (thread, then stage, then URL)."""
    return df.withColumn("order_index", F.col(log).cast("bigint") * 1_000_000_000
                         + F.col(stage).cast("bigint") * 1_000_000 + F.col(url_index).cast("bigint"))


def sample_crawl(df: DataFrame, url_index: str = "url_index", modulus: int = 100, residue: int = 42) -> DataFrame:
    """Deterministic 1 % sample: url_index mod 100 = 42."""
    return df.filter(F.pmod(F.col(url_index), F.lit(modulus)) == residue)


def join_logs_pages(logs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Valid log rows with their page text; logs without a file drop out (inner join).

    A day that could not be read from the folder name is null on both sides and matches as such."""
    pages = blobs.select(F.col("day").alias("_day"), F.col("page_key").alias("_key"), "html")
    entries = valid_log_entries(logs)
    same = entries["day"].eqNullSafe(pages["_day"]) & (entries["page_key"] == pages["_key"])
    return entries.join(pages, same, "inner").drop("_day", "_key")


def previous_in_order(df: DataFrame, thread_cols: list[str], order_cols: list[str], carry: list[str]) -> DataFrame:
    """Attach ``prev_<col>`` of the previous page in crawl order within ``thread_cols``.

    ``thread_cols = [day, log_index]`` compares pages of one crawler thread;
    ``[day]`` compares across thread borders in (log, stage, url) order.  All of ``df`` goes through the
    exchange: for whole texts use ``page_signatures`` and ``against_previous``.
    """
    return with_previous(df, thread_cols, order_cols, carry, {f"prev_{c}": F.col(f"prev_{c}") for c in carry}, df.columns)


SIGNATURE = ["start_digest", "text_digest", "line_hashes"]


def page_signatures(df: DataFrame, text: str = "text_lines") -> DataFrame:
    """Adds what the duplicate rules need of a page's lines, so that no line leaves its task: a digest of the first
    three lines, one of all, and a 64-bit hash per line (aligning those gives the sizes that aligning the lines gives)."""
    lines = F.col(text)
    return df.withColumns({"start_digest": F.md5(F.to_json(F.slice(lines, 1, START_LINES))), "text_digest": F.md5(F.to_json(lines)),
                           "line_hashes": F.transform(lines, lambda x: F.xxhash64(x))})


def against_previous(df: DataFrame, thread_cols: list[str], order_cols: list[str], result: dict[str, Column], keep: list[str],
                     extra: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, ``result``) of every page of ``page_signatures`` against the previous one in crawl order; ``extra``
    columns are carried along with the signature."""
    return with_previous(df, thread_cols, order_cols, [*SIGNATURE, *extra], result, keep)


def same_start() -> Column:
    """The first three lines equal those of the previous page."""
    return F.coalesce(F.col("prev_start_digest") == F.col("start_digest"), F.lit(False))


def cheap_valid() -> Column:
    """First page of a sequence, or a page with text and another start than the previous one."""
    return F.col("prev_line_hashes").isNull() | ((F.size("line_hashes") > 0) & ~same_start())


def not_false_duplicate(max_overlap: float = MAX_OVERLAP, use_ratio: bool = True) -> Column:
    """The whole rule on signatures: ``cheap_valid``, and an overlap ratio of at most ``max_overlap``."""
    return _valid(F.col("line_hashes"), F.col("prev_line_hashes"), same_start(), max_overlap, use_ratio)


def other_text(counts: str | None = None) -> Column:
    """The hash check on signatures: another text than the previous page; a page without text compares ``counts``."""
    return _other(F.size("line_hashes") == 0, F.col("prev_line_hashes").isNull(), F.col("text_digest") == F.col("prev_text_digest"),
                  F.col(counts).eqNullSafe(F.col(f"prev_{counts}")) if counts else None)


def start_overlap(prev: Column, cur: Column, n: int = START_LINES) -> Column:
    """First n elements equal (shorter lists compare as they are)."""
    return F.slice(prev, 1, n) == F.slice(cur, 1, n)


def ratio_upper_bound(a: Column, b: Column) -> Column:
    """Native upper bound of the overlap ratio 2M/(|a|+|b|).

    The matched elements M never exceed the multiset intersection, which is
    at most |distinct common elements| + min(repeats in a, repeats in b).
    """
    la, lb = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    repeats = F.least(la - F.size(F.array_distinct(a)), lb - F.size(F.array_distinct(b)))
    matched = F.least(common + repeats, la, lb)
    return F.try_divide((2 * matched).cast("double"), (la + lb).cast("double"))


def _valid(c: Column, p: Column, starts_alike: Column, max_overlap: float, use_ratio: bool) -> Column:
    first = p.isNull()
    cheap_ok = (F.size(c) > 0) & ~starts_alike
    if not use_ratio:
        return first | cheap_ok
    needs = F.coalesce(~first & cheap_ok & (ratio_upper_bound(c, p) > max_overlap), F.lit(False))
    # Python UDFs run on every row, so undecided rows alone carry their lists.
    texts = [F.transform(F.when(needs, x), lambda line: line.cast("string")) for x in (c, p)]
    ratio = F.try_divide(F.lit(2.0) * matched_elements(*texts), F.size(c) + F.size(p))
    return first | (cheap_ok & (~needs | (ratio <= max_overlap)))


def flag_false_duplicates(with_prev: DataFrame, text: str = "text_lines", prev: str = "prev_text_lines",
                          max_overlap: float = MAX_OVERLAP, use_ratio: bool = True) -> DataFrame:
    """Adds ``valid``: the first page of a sequence is valid; later pages need
    non-empty text, a different start than the previous page and an overlap
    ratio with it of at most ``max_overlap``.  The alignment UDF only runs on
    pairs that pass the native checks and whose ratio bound exceeds the limit.
    """
    p, c = F.col(prev), F.col(text)
    return with_prev.withColumn("valid", _valid(c, p, start_overlap(p, c), max_overlap, use_ratio))


def _other(textless: Column, first: Column, same_text: Column, same_counts: Column | None) -> Column:
    by_text = first | ~same_text
    return by_text if same_counts is None else F.when(textless, ~same_counts).otherwise(by_text)


def hash_duplicates(with_prev: DataFrame, text: str = "text_lines", prev: str = "prev_text_lines",
                    counts: str | None = None, prev_counts: str | None = None) -> DataFrame:
    """Adds ``valid`` for the hash check: a page with text is valid when its text
    digest differs from the previous page's; a textless page compares its HTML
    count features (``counts``) instead, when given."""
    same_text = F.md5(F.to_json(F.col(text))) == F.md5(F.to_json(F.col(prev)))
    same_counts = F.col(counts).eqNullSafe(F.col(prev_counts)) if counts else None
    return with_prev.withColumn("valid", _other(F.size(F.col(text)) == 0, F.col(prev).isNull(), same_text, same_counts))


def clean_crawl(logs: DataFrame, blobs: DataFrame, cross_thread: bool = False,
                max_overlap: float = MAX_OVERLAP, use_ratio: bool = True) -> DataFrame:
    """Whole clean-up: valid, present, non-duplicate pages of every crawl day.

    The order of the crawl is settled on signatures; page texts move in the join of logs and pages and in the
    semi-join back to the valid keys, which both go by (day, page key).  In between the pages and their text are kept in
    the shared folder, so that each is joined and read once.  ``use_ratio=False`` leaves the overlap ratio out.
    """
    pages = stored(join_logs_pages(logs, blobs).withColumn("text_lines", H.text_lines("html")), "pages")
    threads = ["day"] if cross_thread else ["day", "log_index"]
    order = ["log_index", "stage_index", "url_index"] if cross_thread else ["stage_index", "url_index"]
    flagged = against_previous(page_signatures(pages), threads, order, {"valid": not_false_duplicate(max_overlap, use_ratio)}, ["day", "page_key"])
    valid = flagged.where("valid").select(F.col("day").alias("_day"), F.col("page_key").alias("_key"))
    same = pages["day"].eqNullSafe(valid["_day"]) & (pages["page_key"] == valid["_key"])
    return pages.join(valid, same, "left_semi").drop("status", "file_present")


def log_entry_pairs(log1: DataFrame, log2: DataFrame, keys=("stage_file", "url_index")) -> DataFrame:
    """Inner join of two logs on (stage file, URL index); other columns get the
    suffixes ``-1`` / ``-2``."""
    ks = list(keys)
    a = log1.select(*ks, *[F.col(c).alias(c + "-1") for c in log1.columns if c not in ks])
    b = log2.select(*ks, *[F.col(c).alias(c + "-2") for c in log2.columns if c not in ks])
    return a.join(b, ks, "inner")

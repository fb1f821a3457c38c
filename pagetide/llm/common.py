"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.session import ensure_checkpoint_dir

# A word is a run of characters other than the six ASCII white-space characters.
# ``bytes.split()`` without arguments cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder path under the shared checkpoint folder named by the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: ends the lineage with files in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.  A join with it shuffles both sides afresh, so
    that adaptive execution can split a hot key; it can't where an aggregate feeds the join directly."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null.  Words become one letter each, white space goes,
    the length is left: no array of words is built, however long the text."""
    letters = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(letters, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5 (52 bits, exact in a double)."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string or binary column, row by row."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.to_pylist()


# --- vectors -----------------------------------------------------------------

def finite_vectors(df: DataFrame, id_col: str, vec_col: str, allow_zero: bool = True) -> DataFrame:
    """(id long, vec array<double>) of the rows that take part: id and vector not null, every
    component present and finite, and not all zero unless ``allow_zero``."""
    vec = F.col(vec_col)
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not allow_zero:
        ok = ok & F.exists(vec, lambda x: x != 0)
    return (df.where(F.col(id_col).isNotNull() & vec.isNotNull() & ok)
              .select(F.col(id_col).cast("long").alias("id"), vec.cast("array<double>").alias("vec")))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) == 0:
        return np.zeros((0, 0))
    width = int(sizes.max())
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    out[rows, np.arange(len(values)) - np.repeat(starts, sizes)] = values
    return out


def fit_width(m: np.ndarray, width: int) -> np.ndarray:
    """Cut or zero-fill columns; components without a counterpart add nothing to an inner product."""
    if m.shape[1] >= width:
        return m[:, :width]
    return np.hstack([m, np.zeros((len(m), width - m.shape[1]))])


def vector_blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) in blocks of at most ``rows`` from batches with columns id, vec."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(part.column(1))


def query_chunks(queries: DataFrame, max_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query vectors, streamed to the driver in chunks of at most ``max_bytes`` of matrix
    (one vector at least), so that what is broadcast at once has a fixed bound."""
    ids, rows, width = [], [], 0

    def pack():
        m = np.zeros((len(rows), width))
        for i, v in enumerate(rows):
            m[i, :len(v)] = v
        return np.array(ids, dtype=np.int64), m

    for row in queries.toLocalIterator():
        wider = max(width, len(row["vec"]))
        if rows and 8 * wider * (len(rows) + 1) > max_bytes:
            yield pack()
            ids, rows, wider = [], [], len(row["vec"])
        width = wider
        ids.append(row["id"])
        rows.append(row["vec"])
    if rows:
        yield pack()


def best_per_query(qi: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` largest scores, ties to the smaller id."""
    # The least long has no negative: the complement turns the order of whole numbers round.
    order = np.lexsort((ids, ~score if score.dtype.kind == "i" else -score, qi))
    q = qi[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return order[np.arange(len(q)) - start < k]


# --- words -------------------------------------------------------------------

_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, kept for the next call."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 1 << 20:
            _POWERS[base] = known
    return known[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of them (a bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def range_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, unbase: int = _UNBASE) -> np.ndarray:
    """Hashes of the ranges [begin, end) from the sums that ``prefix_sums`` made; equal for equal content."""
    return (prefix[end] - prefix[begin]) * powers(unbase, int(begin.max(initial=0)) + 1)[begin]


def prefix_sums(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, a slice at a time (cut at white space)."""
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + _SLICE)
        if stop < len(data):
            tail = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8, stop - at, at)])
            if len(tail):
                stop = at + int(tail[-1]) + 1
            else:  # one word longer than a slice
                while stop < len(data) and not _BLANK[data[stop]]:
                    stop += 1
        codes = np.frombuffer(data, np.uint8, stop - at, at)
        inside = np.r_[False, ~_BLANK[codes], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        hashes = range_hashes(prefix_sums(_BYTE[codes]), begin, end)
        parts.append(mix64(hashes + (end - begin).astype(np.uint64)))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

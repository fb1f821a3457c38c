"""Operator 11: phrase collocation mining by top-order marginalisation.

Only windows of the longest order are counted: at every word its piece's next words stand in lead columns
w1 ... w5, padded with empty strings where the piece ends.  One ROLLUP over (lang, w1, ..., w5) then sums
successively shorter prefixes, so phrases of every shorter length, single words and the language's total come out of the same
table.  A phrase's occurrences are exactly the windows that begin with it.

Windows are also padded where no candidate can go on.  A first pass adds the hashes of all prefixes, by
order, into buckets; a prefix whose bucket stays below the least frequency is rare, and so is every phrase that
begins with it.  Other prefixes in a bucket can only make it fuller, so no frequent phrase is ever padded away.
The number of buckets grows with the text (``BUCKETS`` at least), so that the rare ones don't fill them; a task
holds the places of ``HELD`` words at a time, each block's counters lie with one task, and the tasks that make
windows get some bits for each full bucket.

Both passes shuffle what a task has added up as compressed blocks, not as rows: gaps between places, and sorted
windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, mix64, prefix_sums, range_hashes, stored, text_bytes

LONGEST = 5
LEAST = 100
BUCKETS = 1 << 22
MOST_BUCKETS = 1 << 31
BLOCK = 1 << 14  # of BUCKETS; of more buckets as many times more
SPARSE = 32
PARTS = 64
SLICE = 1 << 20
HELD = 1 << 20
HELD_BYTES = 1 << 26
ROWS = 1 << 14

_BREAK = re.compile(rb"[.,;:!?\n-\r]")
_KIND = np.zeros(256, dtype=np.uint8)  # 0 a word, 1 a blank, 2 the end of a piece
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(texts: Iterable[bytes | None], size: int = SLICE, breaks: re.Pattern = _BREAK) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, parts) of about ``size`` bytes together; a longer text is cut after a match of ``breaks``."""
    numbers, parts, held = [], [], 0
    for i, text in enumerate(texts):
        text, at = text or b"", 0
        while at < len(text):
            end = breaks.search(text, at + size) if len(text) - at > size else None
            stop = end.end() if end else len(text)
            numbers.append(i)
            parts.append(text[at:stop])
            held += stop - at
            at = stop
            if held >= size:
                yield numbers, parts
                numbers, parts, held = [], [], 0
    if parts:
        yield numbers, parts


class Words:
    """The words of some texts: ``room`` words from each to the end of its piece (at most ``longest``)."""

    def __init__(self, parts: list[bytes], longest: int):
        codes = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
        starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        kind = _KIND[codes]
        word = kind == 0
        inside = np.r_[False, word, False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edges[::2], edges[1::2]
        self.text = np.searchsorted(starts, self.begin, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), self.begin)
        n = len(self.begin)
        last = np.r_[piece[1:] != piece[:-1], True] if n else np.zeros(0, bool)
        ends = np.flatnonzero(last) + 1
        self.room = np.minimum(ends[np.searchsorted(ends, np.arange(n), "right")] - np.arange(n), longest) if n else np.zeros(0, int)
        lower = _LOWER[codes]
        self.hash = mix64(range_hashes(prefix_sums(_BYTE[lower]), self.begin, self.end) + (self.end - self.begin).astype(np.uint64))
        self.letters = lower[word]

    def strings(self) -> pa.Array:
        offsets = np.r_[0, np.cumsum(self.end - self.begin)].astype(np.int32)
        return pa.StringArray.from_buffers(len(self.begin), pa.py_buffer(offsets), pa.py_buffer(self.letters))

    def prefixes(self, salt: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By order 1, 2, ...: the words that begin a phrase so long, and those phrases' hashes with ``salt``."""
        at = np.arange(len(self.begin))
        value = mix64(self.hash ^ salt)
        for k in range(1, longest + 1):
            if k > 1:
                more = self.room[at] >= k
                at = at[more]
                value = mix64(value[more] * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + k - 1])
            yield at, value


def _salts(langs: pa.Array) -> np.ndarray:
    """A 64-bit hash of every row's language."""
    coded = langs.dictionary_encode()
    own = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(own, dtype=np.uint64)[coded.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def _counters(shape: int | tuple[int, int], least: int) -> np.ndarray:
    """Zeros that can count to ``least``: one byte each where that is enough, as each task holds all buckets of all orders."""
    return np.zeros(shape, dtype="u1" if least <= 255 else "<u4")


def _add_up_to(counts: np.ndarray, place: np.ndarray, more: np.ndarray, least: int) -> None:
    """Adds ``more`` at the different places ``place``; sums stop at ``least``, whatever the order of adding."""
    counts[place] = np.minimum(counts[place] + more.astype(np.int64), least)


def _buckets(size: int, least: int) -> int:
    """Buckets for ``size`` bytes of text, a power of two: of words of six bytes one gets a quarter of ``least`` at most, on average."""
    return min(max(BUCKETS, 1 << (4 * size // (6 * max(1, least))).bit_length()), max(BUCKETS, MOST_BUCKETS))


def _block(buckets: int) -> tuple[int, str]:
    """Buckets of a block, and the type of a place in it."""
    block = BLOCK * (buckets // BUCKETS)
    return block, "<u2" if block <= 1 << 16 else "<u4"


def _sketch(longest: int, least: int, buckets: int | None = None):
    """The bucket counts of all prefixes, cut off at ``least``, as blocks with (place, count) pairs, for each ``HELD`` words of a task."""
    buckets = buckets or BUCKETS
    block, kind = _block(buckets)

    def run(batches):
        held, n = [[] for _ in range(longest)], 0
        shift = np.uint64(64 - buckets.bit_length() + 1)
        for batch in batches:
            salts = _salts(batch.column("lang"))
            for numbers, parts in slices(text_bytes(batch.column("text"))):
                words = Words(parts, longest)
                for k, (_, value) in enumerate(words.prefixes(salts[numbers][words.text], longest)):
                    held[k].append((value >> shift).astype(np.uint32))
                n += len(words.begin)
                if n >= HELD:
                    yield _counted(held, least, buckets, block, kind)
                    n = 0
        yield _counted(held, least, buckets, block, kind)
    return run


def _counted(held: list[list[np.ndarray]], least: int, buckets: int, block: int, kind: str) -> pa.RecordBatch:
    """Blocks of the places in ``held``, by order, which is emptied."""
    found, places, numbers = [], [], []
    for k, parts in enumerate(held):
        place = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        parts.clear()
        place.sort()
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][:len(place)])
        counts = np.minimum(np.diff(np.r_[first, len(place)]), least).astype(_counters(0, least).dtype)
        place = place[first]
        edges = np.searchsorted(place, np.arange(0, buckets + 1, block))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            some = slice(edges[b], edges[b + 1])
            found.append(k * (buckets // block) + b)
            places.append((place[some] & np.uint32(block - 1)).astype(kind).tobytes())
            numbers.append(counts[some].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())],
                                      names=["block", "places", "counts"])


def _planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: small numbers leave runs of zeros."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(sketch, kind: str):
    """The blocks of ``sketch`` with the gaps between places, compressed."""
    def run(batches):
        for batch in sketch(batches):
            sizes, data = [], []
            for places, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                place = np.frombuffer(places, kind)
                both = _planes(np.diff(place, prepend=place.dtype.type(0))) + _planes(np.frombuffer(counts, f"V{len(counts) // len(place)}"))
                sizes.append(len(place))
                data.append(pa.compress(both, codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["block", "n", "data"])
    return run


def _full_blocks(least: int, block: int, kind: str):
    """Places of the buckets that reach ``least``, by block; rows are added as they come."""
    wide, count = np.dtype(kind).itemsize, _counters(0, least).dtype

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number not in sums:
                    sums[number] = _counters(block, least)
                both = pa.decompress(data, n * (wide + count.itemsize), codec="zstd", asbytes=True)
                _add_up_to(sums[number], np.cumsum(_from_planes(both[:n * wide], kind), dtype=np.int64), _from_planes(both[n * wide:], count.str), least)
        full = [np.flatnonzero(v >= least).astype(kind).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(full, pa.binary())], names=["block", "places"])
    return run


def _windows(longest: int, bits):
    """(lang, w1 ... , n): the padded longest windows, added up within a slice of text."""
    names = [f"w{j + 1}" for j in range(longest)]

    def run(batches):
        full = bits.value
        shifts = [np.uint64(65 - (8 * len(x)).bit_length()) for x in full]
        for batch in batches:
            langs = batch.column("lang")
            salts = _salts(langs)
            for numbers, parts in slices(text_bytes(batch.column("text"))):
                words = Words(parts, longest)
                n = len(words.begin)
                if not n:
                    continue
                rows = np.asarray(numbers)[words.text]
                reach = np.zeros(n, dtype=np.int64)
                key = salts[rows]
                for k, (at, value) in enumerate(words.prefixes(salts[rows], longest)):
                    place = (value >> shifts[k]).astype(np.int64)
                    on = (full[k][place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool) & (reach[at] == k)
                    reach[at[on]] = k + 1
                    key[at[on]] = value[on]
                strings = words.strings()
                coded = strings.dictionary_encode()
                ids = coded.indices.to_numpy()
                lang = langs.dictionary_encode().indices.to_numpy()[rows]
                lead = np.stack([np.where(reach > j, ids[np.minimum(np.arange(n) + j, n - 1)], -1) for j in range(longest)] + [lang])
                _, first, group, count = np.unique(mix64(key + reach.astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
                if (lead != lead[:, first[group]]).any():  # two windows share a hash: tell them apart by their words
                    _, first, count = np.unique(lead, axis=1, return_index=True, return_counts=True)
                columns = [coded.dictionary.take(pa.array(lead[j, first], mask=lead[j, first] < 0)).fill_null("") for j in range(longest)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(rows[first])), *columns, pa.array(count, pa.int64())],
                                                 names=["lang", *names, "n"])
    return run


def _merged(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"])


def _parcels(windows, parts: int):
    """What ``windows`` makes in a task, added up and sorted: (part, lang, n, size, data) with n windows and their counts in data."""
    keys = ["part", "lang", "words"]

    def run(batches):
        held = []
        for batch in windows(batches):
            words = pc.binary_join_element_wise(*batch.columns[1:-1], " ")
            ends = np.frombuffer(words.buffers()[1], np.int32)[:len(words) + 1].astype(np.int64)
            codes = np.frombuffer(words.buffers()[2], np.uint8)[:ends[-1]]
            part = mix64(range_hashes(prefix_sums(_BYTE[codes]), ends[:-1], ends[1:])) % np.uint64(parts)
            held.append(pa.Table.from_arrays([pa.array(part.astype(np.int32)), batch.column(0), words, batch.column(batch.num_columns - 1)], names=[*keys, "n"]))
            if sum(t.num_rows for t in held) >= HELD or sum(t.nbytes for t in held) >= HELD_BYTES:
                held = [_merged(held, keys)]
                pa.default_memory_pool().release_unused()
                if 2 * held[0].num_rows >= HELD or 2 * held[0].nbytes >= HELD_BYTES:
                    yield _parcelled(held.pop())
        if held:
            yield _parcelled(_merged(held, keys))
        pa.default_memory_pool().release_unused()
    return run


def _parcelled(table: pa.Table) -> pa.RecordBatch:
    table = table.sort_by([(c, "ascending") for c in ("part", "lang", "words")]).combine_chunks()
    part, lang, words, counts = (table.column(i).combine_chunks() for i in range(4))
    lines = pc.binary_join_element_wise(words, "", "\n")
    ends, letters, counts = np.frombuffer(lines.buffers()[1], np.int32), lines.buffers()[2], counts.to_numpy()
    at, tongue = part.to_numpy(), lang.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (tongue[1:] != tongue[:-1])][:len(at)])
    sizes, data = [], []
    for a, b in zip(first, [*first[1:], len(at)], strict=True):
        both = letters[ends[a]:ends[b]].to_pybytes() + _planes(counts[a:b])
        sizes.append(len(both))
        data.append(pa.compress(both, codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays(
        [part.take(pa.array(first)), lang.take(pa.array(first)), pa.array(np.diff(np.r_[first, len(at)]), pa.int32()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())],
        names=["part", "lang", "n", "size", "data"])


def _unparcelled(longest: int):
    """The windows of parcels, added up; a window comes again when its task has held too many others meanwhile."""
    keys = ["lang", "words"]

    def rows(table):
        for batch in table.to_batches(max_chunksize=ROWS):
            words = pc.split_pattern(batch.column("words"), " ").flatten()
            at = np.arange(batch.num_rows) * longest
            columns = [words.take(pa.array(at + j)) for j in range(longest)]
            columns[-1] = pc.ascii_rtrim(columns[-1], "\n")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *columns, batch.column("n")], names=["lang", *(f"w{j + 1}" for j in range(longest)), "n"])

    def opened(parcels):
        langs, sizes, lines, counts = zip(*parcels, strict=True)
        letters = b"".join(lines)
        ends = np.r_[0, np.flatnonzero(np.frombuffer(letters, np.uint8) == 10) + 1].astype(np.int32)
        words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(letters))
        lang = pa.array(langs, pa.string()).take(pa.array(np.repeat(np.arange(len(langs)), sizes)))
        return pa.Table.from_arrays([lang, words, pa.array(np.concatenate(counts))], names=[*keys, "n"])

    def run(batches):
        table, parcels, n, held = None, [], 0, 0
        for batch in batches:
            for lang, many, size, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                both = pa.decompress(data, size, codec="zstd", asbytes=True)
                parcels.append((lang, many, both[:size - 8 * many], _from_planes(both[size - 8 * many:], "<i8")))
                n, held = n + many, held + size
                if n >= HELD or held >= HELD_BYTES:
                    table = _merged([opened(parcels), *([table] if table else [])], keys)
                    parcels, n, held = [], 0, 0
                    pa.default_memory_pool().release_unused()
                    if table.num_rows >= HELD or table.nbytes >= HELD_BYTES:
                        yield from rows(table)
                        table = None
        if parcels:
            table = _merged([opened(parcels), *([table] if table else [])], keys)
        if table:
            yield from rows(table)
    return run


#: Of a byte, in the upper half: which pairs of neighbouring bits have one set.
_PAIRS = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 4, 2).any(axis=2), axis=1)[:, 0]


def folded(bits: np.ndarray) -> np.ndarray:
    """One order's bits for half as many buckets again and again, while not one in ``SPARSE`` would be set."""
    while 8 * len(bits) > BUCKETS and 2 * SPARSE * int(np.bitwise_count(bits).sum()) <= 8 * len(bits):
        bits = _PAIRS[bits[::2]] | _PAIRS[bits[1::2]] >> 4
    return bits


def frequent_bits(spark, texts: DataFrame, longest: int, least: int) -> np.ndarray:
    """One bit per order and bucket: set where the bucket's count reaches ``least``.  Buckets are joined two by two as in ``folded``,
    alike for all orders."""
    buckets = _buckets(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, least)
    block, kind = _block(buckets)
    blocks = texts.mapInArrow(_packed(_sketch(longest, least, buckets), kind), "block int, n int, data binary")
    rows = blocks.repartition("block").mapInArrow(_full_blocks(least, block, kind), "block int, places binary").collect()
    full = [[] for _ in range(longest)]
    for r in rows:  # places of full buckets alone
        k, b = divmod(r["block"], buckets // block)
        full[k].append(np.frombuffer(r["places"], kind).astype(np.int64) + b * block)
    most, fold = max((sum(map(len, x)) for x in full), default=0), 0
    while buckets >> fold > BUCKETS and 2 * SPARSE * most <= buckets >> fold:
        fold += 1
    bits = np.zeros((longest, (buckets >> fold) // 8), dtype=np.uint8)
    for k, places in enumerate(full):
        for place in places:
            np.bitwise_or.at(bits[k], place >> fold + 3, np.uint8(128) >> (place >> fold & 7).astype(np.uint8))
    return bits


def phrase_counts(docs: DataFrame, text: str, lang: str, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f): every phrase of up to ``longest`` words that occurs ``least`` times or more in its
    language, and with ``words`` 0 each language's number of words.  A null language is ``und``; null and
    empty texts hold no words; a repeated row counts again; an empty table gives no rows."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    texts = texts.where(F.col("text").isNotNull())
    w = [f"w{j + 1}" for j in range(longest)]
    full = [folded(b) for b in frequent_bits(spark, texts, longest, least)]
    bits = spark.sparkContext.broadcast(full)
    parts = max(PARTS, max(8 * len(b) for b in full) >> 18)
    parcels = texts.mapInArrow(_parcels(_windows(longest, bits), parts), "part int, lang string, n int, size long, data binary")
    windows = parcels.repartition("part").mapInArrow(_unparcelled(longest), f"lang string, {', '.join(f'{c} string' for c in w)}, n long")
    tops = windows.groupBy("lang", *w).agg(F.sum("n").alias("n"))
    # The rolled-up columns are null; a prefix that ends in padding is no phrase.
    rolled = tops.rollup("lang", *w).agg(F.sum("n").alias("f")).where(F.col("lang").isNotNull())
    kept = F.array_compact(F.array(*w))
    sums = rolled.select("lang", F.size(kept).alias("words"), kept.alias("kept"), "f")
    real = (F.col("words") == 0) | ((F.col("f") >= least) & (F.try_element_at("kept", F.col("words")) != ""))
    return stored(sums.where(real).select("lang", "words", F.array_join("kept", " ").alias("phrase"), "f"), "phrases")


def collocations(docs: DataFrame, text: str, lang: str, top: int = 2000, longest: int = LONGEST, least: int = LEAST,
                 factor: int = 1000, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    n is the language's number of words, a the phrase's frequency (``least`` at least), l and r those of its two
    parts at the cut with the lowest ``floor(factor * a * n / (l * r))`` (the first of equal ones).  A phrase inside a longer
    candidate that has ``share`` percent of its frequency or more is left out.  Products are decimals of 38 digits.  Nulls, empty texts, repeated
    rows and empty tables as in ``phrase_counts``.
    """
    counts = phrase_counts(docs, text, lang, longest, least)
    parts = F.split("phrase", " ")
    phrases = counts.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", parts.alias("parts"))
    # A phrase inside a longer candidate: every contiguous part of that, with the longer one's frequency.
    size = F.col("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(
        F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("parts", i, k), " "))))
    around = (phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
                     .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    free = phrases.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = stored(free.select("lang", "phrase", "a", "words", "parts", cut).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("parts", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("parts", F.col("k") + 1, size), " ").alias("right")), "cuts")
    single = counts.where("words > 0")
    left = single.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = single.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    # One row for each language: stored by itself, so that Spark sees its size.
    totals = stored(counts.where("words = 0").select("lang", F.col("f").alias("n")), "totals")
    product = F.lit(factor).cast("decimal(9,0)") * _decimal("a") * _decimal("n")
    score = F.call_function("div", product, _decimal("l") * _decimal("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang").select(
        "lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
                .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def _decimal(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")

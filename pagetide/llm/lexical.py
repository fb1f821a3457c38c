"""Operator 12: ranked lexical search by NRA (top-k with no random access).

Every task turns its documents into shards of impact-sorted lists, one per query term: what the term adds to
a document's score, largest first.  For each item all its lists are read in step, some entries further each round.
A document's score lies between the sum of what was read for it and that plus the next impact of every
list where it was not yet met.  Reading goes on until no other document can reach the k-th place, ties are
settled and the k documents' own intervals have closed.  Shards hold different documents, so the best k of all
shards' best k are the answer.

Two passes over the documents: the first counts N, L and the document frequencies of the query terms, the
second builds and reads the lists.  Items go out in blocks of at most ``BLOCK_BYTES`` of terms; tables
of items beyond that take the two passes for each block.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import _BYTE, mix64, prefix_sums, range_hashes, shared_folder, text_bytes
from .phrases import slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_BYTES = 4 << 20
SHARD_POSTINGS = 1 << 20
SHARD_DOCS = 1 << 16
STEP = 64

_OTHER = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_IN_TERM = np.ones(256, dtype=bool)
_IN_TERM[[c for c in range(128) if not chr(c).isalnum()]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER_CASE, _LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(part number, 64-bit hash) of every term of some texts, in order."""
    codes = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    inside = np.r_[False, _IN_TERM[codes], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    value = range_hashes(prefix_sums(_BYTE[_LOWER[codes]]), begin, end)
    return np.searchsorted(starts, begin, "right") - 1, mix64(value + (end - begin).astype(np.uint64))


class Block:
    """Some items: ids, each item's terms as places in ``terms`` (sorted hashes), then the terms' statistics."""

    def __init__(self, ids: list, terms: list[list[bytes]]):
        hashes = [np.unique(term_hashes(t)[1]) if t else np.zeros(0, np.uint64) for t in terms]
        self.ids = ids
        self.terms = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.items = [np.searchsorted(self.terms, h) for h in hashes]
        self.weights = np.zeros(len(self.terms), dtype=np.int64)
        self.documents = self.words = 0

    def weigh(self, documents: int, words: int, frequencies: dict[int, int]) -> None:
        self.documents, self.words = documents, words
        for i in range(len(self.terms)):
            self.weights[i] = math.floor(1000 * math.log((2 * documents + 2) / (2 * frequencies.get(i, 0) + 1)))

    def postings(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """(n of every text; then text number, term, tf of every query term in a text), by text."""
        n = np.zeros(len(texts), dtype=np.int64)
        pairs = [np.zeros(0, np.int64)]
        for numbers, parts in slices(texts, breaks=_OTHER):
            text, value = term_hashes(parts)
            text = np.asarray(numbers)[text]
            n += np.bincount(text, minlength=len(texts))
            if len(self.terms):
                at = np.minimum(np.searchsorted(self.terms, value), len(self.terms) - 1)
                known = self.terms[at] == value
                pairs.append(text[known] * len(self.terms) + at[known])
        pair, tf = np.unique(np.concatenate(pairs), return_counts=True)
        return n, pair // max(1, len(self.terms)), pair % max(1, len(self.terms)), tf


def blocks(items: DataFrame, max_bytes: int) -> Iterator[Block]:
    """The items in blocks of at most ``max_bytes`` of terms (one item at least)."""
    ids, terms, held = [], [], 0
    for row in items.toLocalIterator():
        own = [t.encode() for t in row["terms"]]
        size = sum(map(len, own)) + 16 * len(own)
        if ids and held + size > max_bytes:
            yield Block(ids, terms)
            ids, terms, held = [], [], 0
        ids.append(row["item_id"])
        terms.append(own)
        held += size
    if ids:
        yield Block(ids, terms)


def _statistics(block):
    """Per task: document frequencies by term, N as term -1 and L as term -2."""
    def run(batches):
        known = block.value
        found = np.zeros(len(known.terms) + 2, dtype=np.int64)
        for batch in batches:
            n, _, term, _ = known.postings(text_bytes(batch.column("text")))
            found[:-2] += np.bincount(term, minlength=len(known.terms))
            found[-1] += int((n > 0).sum())
            found[-2] += int(n.sum())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at < len(known.terms), at, at - len(found)), pa.int64()), pa.array(found[at], pa.int64())],
                                         names=["term", "n"])
    return run


def nra(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` highest sums over impact-sorted ``lists`` of (document, impact > 0), ties to the
    smaller number.  Lists are only ever read on from where they were left."""
    lower = np.zeros(documents, dtype=np.int64)
    met = np.zeros((len(lists), documents), dtype=bool)
    at = 0
    while True:
        heads = np.zeros(len(lists), dtype=np.int64)  # the most that a list still holds
        for i, (doc, impact) in enumerate(lists):
            lower[doc[at:at + step]] += impact[at:at + step]
            met[i, doc[at:at + step]] = True
            if at + step < len(doc):
                heads[i] = impact[at + step]
        at += step
        step *= 2
        found = np.flatnonzero(lower)
        order = found[np.argsort(-lower[found], kind="stable")]
        best, others = order[:k], order[k:]
        if not heads.any():
            return best, lower[best]
        if len(best) < k:
            continue
        missing = heads.sum() - heads @ met[:, order]  # what each may still gain
        last, least = best[-1], lower[best[-1]]
        upper = lower[others] + missing[k:]
        if (not missing[:k].any() and heads.sum() < least
                and not ((upper > least) | ((upper == least) & (others < last))).any()):
            return best, lower[best]


class _Shard:
    """Documents of a task until their lists are read."""

    def __init__(self):
        self.ids, self.n, self.doc, self.term, self.tf, self.size = [], [], [], [], [], 0

    def add(self, ids, n, doc, term, tf):
        base = sum(map(len, self.n))
        for held, new in zip((self.ids, self.n, self.doc, self.term, self.tf), (ids, n, doc + base, term, tf), strict=True):
            held.append(new)
        self.size += len(doc)

    def full(self) -> bool:
        return self.size >= SHARD_POSTINGS or sum(map(len, self.n)) >= SHARD_DOCS

    def search(self, block: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places of documents, scores) for every item with results; ``self.ids`` is one array afterwards."""
        self.ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(self.ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))  # numbers in ascending order of the ids
        n, doc, term, tf = (np.concatenate(x) for x in (self.n, self.doc, self.term, self.tf))
        longness = np.array([10 + 90 * int(x) * block.documents // max(1, block.words) for x in n], dtype=np.int64)
        impact = block.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * longness[doc]))
        some = np.flatnonzero(impact > 0)
        doc, term, impact = place[doc[some]], term[some], impact[some]
        by = np.lexsort((doc, -impact, term))
        doc, term, impact = doc[by], term[by], impact[by]
        begin, end = (np.searchsorted(term, np.arange(len(block.terms)), side) for side in ("left", "right"))
        for i, terms in enumerate(block.items):
            lists = [(doc[begin[t]:end[t]], impact[begin[t]:end[t]]) for t in terms if end[t] > begin[t]]
            if lists:
                best, score = nra(lists, len(order), k)
                yield i, order[best], score


def _search(block, k, id_type):
    def run(batches):
        known, shard = block.value, _Shard()

        def results():
            for item, places, score in shard.search(known, k):
                yield pa.RecordBatch.from_arrays([pa.array([known.ids[item]] * len(score), id_type), shard.ids.take(pa.array(places)), pa.array(score, pa.int64())],
                                                 names=["item_id", "doc_id", "score"])

        for batch in batches:
            shard.add(batch.column("doc_id"), *known.postings(text_bytes(batch.column("text"))))
            if shard.full():
                yield from results()
                shard = _Shard()
        if shard.n:
            yield from results()
    return run


def ranked_search(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, k: int = 10,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents, equal scores by ascending id.

    Only scores above 0 count.  A null text has no terms and is no document of N; an item without terms, or
    whose terms occur nowhere, has no rows.  Rows that share an item id are one item with all their terms.  A repeated
    document row is a document of its own; null document ids come last among equal scores.  An empty
    table of either kind gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    lower = F.translate(F.coalesce(F.col(item_text), F.lit("")), _UPPER_CASE, _LOWER_CASE)
    wanted = (items.select(F.col(item_id).alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), 0)).alias("term"))
                   .groupBy("item_id").agg(F.collect_set("term").alias("terms")))
    item_type, id_type = wanted.schema["item_id"].dataType, source.schema["doc_id"].dataType.simpleString()
    schema = f"item_id {item_type.simpleString()}, doc_id {id_type}, score long"
    folder = shared_folder(spark, "ranked")
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in blocks(wanted, block_bytes):
        sent = spark.sparkContext.broadcast(block)
        counted = source.mapInArrow(_statistics(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        sums = {r["term"]: r["n"] for r in counted.collect()}  # no more rows than the block has terms
        block.weigh(sums.pop(-1, 0), sums.pop(-2, 0), sums)
        weighed = spark.sparkContext.broadcast(block)
        source.mapInArrow(_search(weighed, k, to_arrow_type(item_type)), schema).write.mode("append").parquet(folder)
        sent.destroy()
        weighed.destroy()
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = spark.read.schema(schema).parquet(folder)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

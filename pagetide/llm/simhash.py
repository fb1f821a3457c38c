"""Operator 5: SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into RING segments on a ring.  If two fingerprints differ in at most d bits, some
segment starts a chain in which the first l segments together differ in at most l * d / RING bits, for
every l.  With d < RING the chain's first segment agrees fully and, where 2d / RING < 2, the second
differs in one bit at most: both become one join key, on one side with each set bit of the second
segment cleared in turn.  What meets under a key must keep the budgets of the whole chain before the
full Hamming check.

Only distinct fingerprints meet, so copies cost nothing.  A key's fingerprints are compared in blocks
of bounded size, and a block pair sends a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, text_bytes

HASH_SEED = 42
RING = 5
BLOCK = 1024
FEW = 1 << 14


def _segments(ring: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment of 64 bits."""
    edges = [round(64 * i / ring) for i in range(ring + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


# --- fingerprints ---------------------------------------------------------------

def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n], ends[len(words) - n:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, FEW):
        hashes = np.array([digest(view[a:b], HASH_SEED)
                           for a, b in zip(first[at:at + FEW].tolist(), last[at:at + FEW].tolist())], dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _fingerprints(shingle):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(batch.num_columns - 1))],
                              dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())],
                                             names=[*batch.schema.names[:-1], "fp"])
    return run


def fingerprints(docs: DataFrame, text: Column, shingle: int, keep: dict[str, Column]) -> DataFrame:
    """The ``keep`` columns and ``fp`` (the 64 bits as a signed long), one row per document."""
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], text.cast("binary").alias("fp"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_fingerprints(shingle), f"{schema}, fp long")


# --- links ----------------------------------------------------------------------

def _keys(fp: Column, ring: int) -> Column:
    """Array of (key, own): the key of each chain start as it is, and with one set bit of the second
    segment cleared (the partner that lacks this bit has it as its own key)."""
    parts = _segments(ring)
    values = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in parts]
    keys = []
    for i in range(ring):
        nxt, width = values[(i + 1) % ring], parts[(i + 1) % ring][1]
        head = F.shiftleft(F.lit(i).cast("long"), 56).bitwiseOR(F.shiftleft(values[i], 16))
        keys.append(F.array(F.struct(head.bitwiseOR(nxt).alias("key"), F.lit(True).alias("own"))))
        for b in range(width):
            bit = F.lit(1 << b).cast("long")
            has = nxt.bitwiseAND(bit) != 0
            keys.append(F.when(has, F.array(F.struct(head.bitwiseOR(nxt.bitwiseXOR(bit)).alias("key"), F.lit(False).alias("own")))))
    return F.flatten(F.array_compact(F.array(*keys)))


def _forest(max_bits, ring):
    """Task function: per block pair, a spanning forest of the links found in it."""
    parts = _segments(ring)
    # Cumulative budgets of a chain: floor(l * max_bits / ring) bits in its first l segments.
    budgets = [max_bits * (i + 1) // ring for i in range(ring)]

    def linked(key, a, b):
        x = a[:, None] ^ b[None, :]
        start, spent, ok = int(key) >> 56, np.zeros(x.shape, np.int64), np.ones(x.shape, bool)
        for step in range(ring):
            at, n = parts[(start + step) % ring]
            spent += np.bitwise_count((x >> np.uint64(at)) & np.uint64((1 << n) - 1))
            ok &= spent <= budgets[step]
        return ok & (np.bitwise_count(x) <= max_bits)

    def run(batches):
        for batch in batches:
            left, right = [], []
            for key, own, other in zip(batch.column("key").to_pylist(), batch.column("own").to_pylist(),
                                       batch.column("other").to_pylist(), strict=True):
                prints = np.unique(np.array(own, dtype=np.int64).view(np.uint64))
                probes = np.unique(np.array(other, dtype=np.int64).view(np.uint64))
                nodes = np.unique(np.r_[prints, probes])
                label = np.arange(len(nodes))
                into, rows, cols = np.searchsorted(nodes, prints), [], []
                for at in range(0, len(nodes), BLOCK):
                    r, c = np.nonzero(linked(key, nodes[at:at + BLOCK], prints))
                    rows.append(r + at)
                    cols.append(into[c])
                r, c = np.concatenate(rows), np.concatenate(cols)
                while True:  # smallest label among neighbours, then of the label
                    new = label.copy()
                    np.minimum.at(new, r, label[c])
                    np.minimum.at(new, c, label[r])
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                at = np.flatnonzero(label != np.arange(len(nodes)))
                left.append(nodes[label[at]])
                right.append(nodes[at])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])
    return run


def links(prints: DataFrame, max_bits: int, ring: int = RING, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between distinct ``fp`` values that connect exactly those within ``max_bits``
    differing bits of each other, directly or through others."""
    if not 0 <= max_bits < ring:
        raise ValueError("the ring needs more segments than differing bits")
    # Spread again: the distinct fingerprints may have been merged into few partitions.
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"), ring)).alias("k")).select("k.key", "k.own", "fp")
    # Stored, like every aggregate below that is joined: the join's sides are then dealt out afresh, and a hot key can be split.
    sizes = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("long")).alias("owners"))
                        .where("n > 1 AND owners > 0"), "key-sizes")
    met = keyed.join(sizes, "key")
    # Blocks of about ``block`` rows; a row goes to every pair of blocks that its own block is in.
    blocks = F.ceil(F.col("n") / block).cast("long")
    mine = F.pmod(F.xxhash64("fp"), blocks)
    met = (met.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
              .select("key", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "own", "fp"))
    pairs = met.groupBy("key", "i", "j").agg(
        F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("own"),
        F.collect_list(F.when(~F.col("own"), F.col("fp"))).alias("other"))
    pairs = pairs.where((F.size("own") > 1) | ((F.size("own") > 0) & (F.size("other") > 0)))
    return pairs.select("key", "own", "other").mapInArrow(_forest(max_bits, ring), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node with an edge.

    Large-star / small-star rounds: each node points its larger neighbours, then itself and its smaller
    neighbours, at the smallest one known.  Minima are pre-aggregated, so a node with very many
    neighbours is split over tasks; minima are stored before they are joined, so the join of such a
    node can be split as well; every round ends in a reliable checkpoint.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())

    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = state(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = stored(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), "least")
        large = stored(both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct(), "large")
        least = stored(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        joined = large.join(least, "v")
        small = (joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                       .unionByName(least.select("v", F.col("m").alias("u")))).distinct()
        edges = cut(small)
        now = state(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str, text: str, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, text_key, fp, component, component_id), one row per row of ``docs``.

    ``component`` is the same for exactly those documents whose fingerprints are linked, directly or
    through others; ``component_id`` is the smallest doc_id among them (null if all are null).
    ``text_key`` is a hash of the text (null for a null text, which counts as one without words).
    Repeated rows are documents of their own.  An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, F.col(text), shingle, {
        "doc_id": F.col(doc_id), "text_key": F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text)))}))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = cut(components(links(distinct.select("fp"), max_bits)))
    rooted = stored(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("component")), "rooted")
    smallest = stored(rooted.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    known = rooted.drop("least").join(smallest, "component")
    return prints.join(known, "fp").select("doc_id", "text_key", "fp", "component", "component_id")


def one_per_group(docs: DataFrame, doc_id: str, text: str, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, one per component: that of the smallest doc_id (null last), of
    several rows with this id the one with the smallest text key, then the smallest remaining columns."""
    found = near_duplicates(docs, doc_id, text, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", F.col("text_key").isNull().alias("b"), "text_key")
    chosen = found.groupBy("component").agg(F.min(order).alias("c")).select(
        F.col("c.doc_id").alias("__id"), F.col("c.text_key").alias("__text")).distinct()
    key = F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text)))
    kept = docs.join(chosen, F.col(doc_id).eqNullSafe(F.col("__id")) & key.eqNullSafe(F.col("__text")))
    rest = [c for c in docs.columns if c not in (doc_id, text)]
    w = Window.partitionBy("__id", "__text").orderBy(*[F.col(f"`{c}`").cast("string") for c in rest] or [F.lit(0)])
    return kept.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])

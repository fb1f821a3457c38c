"""Operator 13: repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

The suffix array is a sparse one.  Every window of ``length`` bytes chooses one block of ``BLOCK`` bytes in it, that with the
smallest hash, so equal windows choose at the same place; about one byte in 185 starts a chosen block.  A window can only be
repeated where its block is, so the suffixes that start at blocks found at least twice are sorted, each with the windows
that chose it and the bytes before it that those windows reach back to.

1. Tasks sort the suffixes of their documents into runs, cut each run into parts (by the block's hash, so a part's size does
   not hang on the text) and send each part front-coded: how many bytes a suffix shares with the one before, and the rest.
2. A part's runs are merged by a loser tree that keeps for every stream the common prefix with the last winner: streams are
   told apart by that length alone, and where it is equal bytes are compared from there on, never again from the start.
3. In the merged order, suffixes that share a prefix stand together; the bytes before the blocks are ordered likewise.  For
   each distance of a window's start before its block, two windows are equal if and only if they are in one
   class of the first order (the bytes from the block on) and in one class of the second (the bytes before it).

A block that occurs more than ``CROWDED`` times would make a part that grows with the input.  Its windows are told apart by
128-bit hashes instead: equal ones within a run are merged, and what is left of all runs meets by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, mix64, prefix_sums, range_hashes, stored, text_bytes

LENGTH = 400
BLOCK = 32
CROWDED = 4096
SLICE = 1 << 20
RUN_BYTES = 24 << 20
RUN_WINDOWS = 2 << 20
PART_SUFFIXES = 20_000
PART_WINDOWS = 2 << 20
_BASE2 = 0xC2B2AE3D27D4EB4F
_UNBASE2 = pow(_BASE2, -1, 1 << 64)
_BYTE2 = np.random.default_rng(128).integers(0, 1 << 64, 256, dtype=np.uint64)


# --- choosing blocks ------------------------------------------------------------

def slices(texts: Iterable[bytes | None], length: int, size: int = SLICE) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text numbers, offsets, parts) of about ``size`` bytes together.  Longer texts are cut into parts that overlap by
    ``length`` - 1 bytes, so that each window is in one part; texts without a window are left out."""
    numbers, offsets, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text or b"") - length + 1), size):
            numbers.append(i)
            offsets.append(at)
            parts.append(text[at:at + size + length - 1])
            held += len(parts[-1])
            if held >= size:
                yield numbers, offsets, parts
                numbers, offsets, parts, held = [], [], [], 0
    if parts:
        yield numbers, offsets, parts


def sliding_minimum(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of every ``reach`` neighbouring values, from running minima inside blocks of that many."""
    n = len(values) - reach + 1
    rows = -(-len(values) // reach)
    padded = np.full(rows * reach, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:len(values)] = values
    grid = padded.reshape(rows, reach)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[reach - 1:reach - 1 + n])


def chosen_blocks(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(part, block hash, first window, windows, block start) of every run of windows that choose one block."""
    block = min(BLOCK, length)
    codes = np.frombuffer(b"".join(parts), dtype=np.uint8)
    starts = np.cumsum([0, *(len(p) for p in parts)])
    at = np.arange(len(codes) - block + 1)
    value = mix64(range_hashes(prefix_sums(_BYTE[codes]), at, at + block))
    low = np.uint64(0xFFFFFFFF)  # the place breaks ties: the leftmost of equal blocks
    chosen = (sliding_minimum(value & ~low | at.astype(np.uint64), length - block + 1) & low).astype(np.int64)
    n = len(chosen)
    part = np.searchsorted(starts, np.arange(n), "right") - 1
    inside = np.arange(n) + length <= starts[part + 1]
    edge = np.r_[True, (chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1]) | (inside[1:] != inside[:-1])]
    first = np.flatnonzero(edge)
    count = np.diff(np.r_[first, n])
    keep = inside[first]
    first, count = first[keep], count[keep]
    base = starts[part[first]]
    return part[first], value[chosen[first]], first - base, count, chosen[first] - base


def _counted(length):
    def run(batches):
        for batch in batches:
            for _, _, parts in slices(text_bytes(batch.column("text")), length):
                value, n = np.unique(chosen_blocks(parts, length)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["block", "n"])
    return run


def _spans(length):
    def run(batches):
        for batch in batches:
            for numbers, offsets, parts in slices(text_bytes(batch.column("text")), length):
                part, value, first, count, at = chosen_blocks(parts, length)
                rows, base = pa.array(np.asarray(numbers)[part]), np.asarray(offsets)[part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("key").take(rows), pa.array(value.view(np.int64)),
                     pa.array(base + first, pa.int64()), pa.array(count, pa.int32()), pa.array(at - first, pa.int32())],
                    names=["id", "key", "block", "first", "count", "back"])
    return run


# --- runs -----------------------------------------------------------------------

def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Number of bytes that two strings share at their start, of which ``known`` are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class Run:
    """Suffixes in sorted order, front-coded, with the bytes before each."""

    def __init__(self, shared: np.ndarray, rest: list[bytes]):
        self.shared, self.rest = shared.tolist(), rest

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        last = b""
        for n, rest in zip(self.shared, self.rest, strict=True):
            last = last[:n] + rest
            yield n, last


def merged(runs: list[Iterable[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """(stream, bytes shared with the suffix before) in the sorted order of all runs, by a loser tree.

    ``shared[s]`` is the common prefix of stream s with the last winner on its path.  A longer one means smaller; only
    equal ones are compared, from that place on, and the loser keeps the common prefix with the one that beat it.
    """
    streams = [iter(r) for r in runs]
    size = 1
    while size < len(streams):
        size *= 2
    current: list[bytes | None] = [None] * size
    shared = [-1] * size

    def advance(s):
        shared[s], current[s] = next(streams[s], (-1, None))

    def beats(a, b):
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        if shared[a] < 0:
            return True
        x, y, known = current[a], current[b], shared[a]
        both = common_prefix(x, y, known)
        if x[both:both + 1] <= y[both:both + 1]:
            shared[b] = both
            return True
        shared[a] = both
        return False

    for s in range(len(streams)):
        advance(s)
    losers = [0] * size
    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        winners = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            win, lose = (a, b) if beats(a, b) else (b, a)
            losers[node + i // 2] = lose
            winners.append(win)
        level = winners
    top = level[0]
    while shared[top] >= 0:
        yield top, shared[top]
        leaf = top
        advance(leaf)
        node = (size + leaf) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def window_hashes(codes: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    one = range_hashes(prefix_sums(_BYTE[codes]), begin, begin + length)
    two = range_hashes(prefix_sums(_BYTE2[codes], _BASE2), begin, begin + length, _UNBASE2)
    return mix64(one), mix64(two)


_COLUMNS = ("part", "ids", "keys", "firsts", "counts", "shared", "sizes", "rests", "backs", "befores", "hashes")


def _run_schema(id_type: str) -> str:
    return (f"part int, ids array<{id_type}>, keys array<long>, firsts array<long>, counts array<int>, shared binary, sizes binary, "
            "rests binary, backs binary, befores binary, hashes binary")


def _lists(values: pa.Array, picks: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, picks)])
    flat = values.take(pa.array(np.concatenate(picks).astype(np.int64))) if picks else values.slice(0, 0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


class _Gathered:
    """Suffixes and crowded windows of a task until they make a run."""

    def __init__(self):
        self.ids, self.keys = [], []  # arrays with an entry per suffix, then per crowded window
        self.first, self.count, self.back, self.suffix, self.before = [], [], [], [], []
        self.window_ids, self.window_keys, self.window_doc, self.window_first, self.one, self.two = [], [], [], [], [], []
        self.bytes = self.windows = self.docs = 0

    def add(self, batch, length):
        texts = text_bytes(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        rows, window_rows = [], []
        for i, (text, own) in enumerate(zip(texts, spans, strict=True)):
            crowded = [s for s in own if s["crowded"]]
            for s in own:
                if s["crowded"]:
                    continue
                first, count, at = s["first"], s["count"], s["first"] + s["back"]
                rows.append(i)
                self.first.append(first)
                self.count.append(count)
                self.back.append(s["back"])
                self.suffix.append(text[at:first + count - 1 + length])
                self.before.append(text[first:at])
                self.bytes += count - 1 + length
            for j in range(0, len(crowded), 1 << 10):
                some = crowded[j:j + (1 << 10)]
                cut = [text[s["first"]:s["first"] + s["count"] - 1 + length] for s in some]
                starts = np.cumsum([0, *map(len, cut)])[:-1]
                counts = np.array([s["count"] for s in some])
                inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                one, two = window_hashes(np.frombuffer(b"".join(cut), np.uint8), np.repeat(starts, counts) + inner, length)
                self.one.append(one)
                self.two.append(two)
                self.window_first.append(np.repeat([s["first"] for s in some], counts) + inner)
                window_rows.append(np.full(len(one), i))
                self.windows += len(one)
        for held, name in ((self.ids, "id"), (self.keys, "key")):
            held.append(batch.column(name).take(pa.array(rows, pa.int64())))
        picked = np.concatenate(window_rows) if window_rows else np.zeros(0, np.int64)
        self.window_doc.append(picked + self.docs)
        self.docs += len(texts)
        picked = pa.array(picked)
        for held, name in ((self.window_ids, "id"), (self.window_keys, "key")):
            held.append(batch.column(name).take(picked))

    def rows(self, parts: int, window_parts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.suffix:
            yield from self._suffix_rows(parts, schema)
        if self.windows:
            yield from self._window_rows(parts, window_parts, schema)

    def _suffix_rows(self, parts, schema):
        ids, keys = pa.concat_arrays(self.ids), pa.concat_arrays(self.keys)
        suffix = self.suffix
        dealt: dict[int, list[int]] = {}
        for i in sorted(range(len(suffix)), key=suffix.__getitem__):
            part = int.from_bytes(hashlib.blake2b(suffix[i][:BLOCK], digest_size=8).digest(), "little") % parts
            dealt.setdefault(part, []).append(i)
        out = {name: [] for name in _COLUMNS}
        picks = []
        for part, order in dealt.items():
            shared, rest, last = [], [], b""
            for i in order:
                n = common_prefix(last, suffix[i])
                shared.append(n)
                rest.append(suffix[i][n:])
                last = suffix[i]
            out["part"].append(part)
            picks.append(np.array(order))
            out["shared"].append(np.array(shared, "<u4").tobytes())
            out["sizes"].append(np.array([len(r) for r in rest], "<u4").tobytes())
            out["rests"].append(b"".join(rest))
            out["backs"].append(np.array([self.back[i] for i in order], "<u4").tobytes())
            out["befores"].append(b"".join(self.before[i] for i in order))
        n = len(picks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["part"], pa.int32()), _lists(ids, picks), _lists(keys, picks), _lists(pa.array(self.first, pa.int64()), picks),
             _lists(pa.array(self.count, pa.int32()), picks), *[pa.array(out[c], pa.binary()) for c in _COLUMNS[5:10]], pa.nulls(n, pa.binary())], schema=schema)

    def _window_rows(self, parts, window_parts, schema):
        ids, keys = pa.concat_arrays(self.window_ids), pa.concat_arrays(self.window_keys)
        doc, first, one, two = (np.concatenate(x) for x in (self.window_doc, self.window_first, self.one, self.two))
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        size = np.diff(np.r_[np.flatnonzero(new), len(order)])
        group = np.cumsum(new) - 1
        # Repeated within the run: marked here and now; one of each still goes out, to meet its like from other runs.
        known = np.zeros(len(order), dtype=bool)
        known[order] = size[group] > 1
        part = parts + (one % np.uint64(window_parts)).astype(np.int64)
        sent = order[new]
        sent = sent[np.argsort(part[sent], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, part[sent][1:] != part[sent][:-1]])
        picks = np.split(sent, cuts[1:])
        counts = pa.array(np.where(known, 0, 1), pa.int32())
        n = len(picks)
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(part[p[0]]) for p in picks], pa.int32()), _lists(ids, picks), _lists(keys, picks), _lists(pa.array(first, pa.int64()), picks),
             _lists(counts, picks), *[pa.nulls(n, pa.binary())] * 5, pa.array([one[p].tobytes() + two[p].tobytes() for p in picks], pa.binary())], schema=schema)
        # Marks of windows that follow each other are one entry.
        marks = np.flatnonzero(known)
        marks = marks[np.lexsort((first[marks], doc[marks]))]
        begin = np.flatnonzero(np.r_[True, (doc[marks][1:] != doc[marks][:-1]) | (first[marks][1:] != first[marks][:-1] + 1)]) if len(marks) else marks
        length = np.diff(np.r_[begin, len(marks)])
        marks = marks[begin]
        for i in range(0, len(marks), 1 << 14):
            pick = [marks[i:i + (1 << 14)]]
            target = parts + window_parts + int(one[pick[0][0]] % np.uint64(parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([target], pa.int32()), _lists(ids, pick), _lists(keys, pick), _lists(pa.array(first, pa.int64()), pick),
                 pa.array([length[i:i + (1 << 14)].tolist()], pa.list_(pa.int32())), *[pa.nulls(1, pa.binary())] * 6], schema=schema)


def _runs(length, parts, window_parts, id_type):
    def run(batches):
        held = schema = None
        for batch in batches:
            own = batch.schema.field("id").type
            schema = schema or pa.schema([("part", pa.int32()), ("ids", pa.list_(own)), ("keys", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64())),
                                          ("counts", pa.list_(pa.int32())), *[(c, pa.binary()) for c in _COLUMNS[5:]]])
            held = held or _Gathered()
            held.add(batch, length)
            if held.bytes >= RUN_BYTES or held.windows >= RUN_WINDOWS:
                yield from held.rows(parts, window_parts, schema)
                held = None
        if held:
            yield from held.rows(parts, window_parts, schema)
    return run


# --- merging --------------------------------------------------------------------

def _pieces(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def repeated_windows(shared: np.ndarray, befores: list[bytes], count: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in sorted order: [i, j] is true if the window that starts j bytes before suffix i is repeated.

    ``shared`` is the common prefix with the suffix before, ``befores`` the bytes before the suffix; suffix i has
    windows at the ``count[i]`` distances up to the number of those bytes.
    """
    n = len(befores)
    most = np.array([len(b) for b in befores], dtype=np.int64)
    least = most - count + 1
    back = [b[::-1] for b in befores]
    order = np.array(sorted(range(n), key=back.__getitem__), dtype=np.int64)
    alike = np.array([0, *(common_prefix(back[a], back[b]) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))])
    out = np.zeros((n, int(most.max()) + 1), dtype=bool)
    for j in range(int(least.min()), out.shape[1]):
        ahead = np.cumsum(shared < length - j)
        behind = np.empty(n, dtype=np.int64)
        behind[order] = np.cumsum(alike < j)
        own = np.flatnonzero((least <= j) & (j <= most))
        pair = ahead[own] * (n + 1) + behind[own]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        out[own[by], j] = np.r_[same, False] | np.r_[False, same]
    return out


def _merge_suffixes(table: pa.Table, length: int):
    runs, backs, befores, ends = [], [], [], [0]
    for row in table.select(["shared", "sizes", "rests", "backs", "befores"]).to_pylist():
        runs.append(Run(np.frombuffer(row["shared"], "<u4"), _pieces(row["rests"], np.frombuffer(row["sizes"], "<u4"))))
        back = np.frombuffer(row["backs"], "<u4")
        backs.append(back)
        befores += _pieces(row["befores"], back)
        ends.append(ends[-1] + len(back))
    at = ends[:-1].copy()
    places, shared = [], []
    for stream, n in merged(runs):
        places.append(at[stream])
        shared.append(n)
        at[stream] += 1
    places = np.array(places)
    count = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)[places]
    first = table.column("firsts").combine_chunks().flatten().to_numpy()[places]
    found = repeated_windows(np.array(shared), [befores[i] for i in places.tolist()], count, length)
    # Windows that follow each other: from distance ``far`` down to distance ``near`` before the suffix.
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, near = np.nonzero(edges == 1)
    far = np.nonzero(edges == -1)[1] - 1
    start = first[row] + np.concatenate(backs)[places][row].astype(np.int64) - far
    return places[row], start, far - near + 1


def _merge_windows(table: pa.Table):
    one, two = [], []
    for data in table.column("hashes").to_pylist():
        both = np.frombuffer(data, np.uint64)
        one.append(both[:len(both) // 2])
        two.append(both[len(both) // 2:])
    one, two = np.concatenate(one), np.concatenate(two)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    hit = np.zeros(len(order), dtype=bool)
    hit[order] = np.r_[same, False] | np.r_[False, same]
    open_ = table.column("counts").combine_chunks().flatten().to_numpy() == 1
    rows = np.flatnonzero(hit & open_)
    return rows, table.column("firsts").combine_chunks().flatten().to_numpy()[rows], np.ones(len(rows), dtype=np.int64)


def _merge(length):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, keys = (table.column(c).combine_chunks().flatten() for c in ("ids", "keys"))
        if table.column("rests").null_count == 0:
            rows, start, count = _merge_suffixes(table, length)
        elif table.column("hashes").null_count == 0:
            rows, start, count = _merge_windows(table)
        else:  # known before
            rows = np.arange(len(ids))
            start, count = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("firsts", "counts"))
        rows = pa.array(rows, pa.int64())
        return pa.table([ids.take(rows), keys.take(rows), pa.array(start, pa.int64()), pa.array(count, pa.int64())], names=["id", "key", "first", "count"])
    return run


# --- cutting --------------------------------------------------------------------

def _cut_texts(length, with_text):
    def run(batches):
        for batch in batches:
            total, removed, runs, kept, digests = [], [], [], [], []
            for text, marks in zip(text_bytes(batch.column("text")), batch.column("marks").to_pylist(), strict=True):
                text = text or b""
                pieces, end, spans = [], 0, 0
                for first, stop in sorted((m["first"], m["first"] + m["count"] - 1 + length) for m in marks or ()):
                    if first > end or not spans:
                        pieces.append(text[end:first])
                        spans += 1
                    end = max(end, stop)
                pieces.append(text[end:])
                left = b"".join(pieces)
                total.append(len(text))
                removed.append(len(text) - len(left))
                runs.append(spans)
                kept.append(left if with_text else None)
                digests.append(hashlib.sha256(left).hexdigest())
            rest = [n for n in batch.schema.names if n not in ("text", "marks")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in rest], *[pa.array(x, pa.int64()) for x in (total, removed, runs)], pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
                names=[*rest, "n_bytes", "n_removed", "n_spans", "kept", "sha256"])
    return run


def without_repeats(docs: DataFrame, doc_id: str, text: str, length: int = LENGTH, carry: dict | None = None,
                    with_text: bool = True, crowded: int = CROWDED) -> DataFrame:
    """(id, the ``carry`` columns, n_bytes, n_removed, n_spans, kept binary, sha256), one row per row of ``docs``.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, the same document
    included, is left out of ``kept`` (null unless ``with_text``); ``n_spans`` counts the maximal runs removed.  Strings are judged on the
    input.  A null text is empty.  A repeated row is a further document.  An empty table gives an empty result.
    """
    carry = carry or {}
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).cast("binary").alias("text"),
                         *[c.alias(f"c_{n}") for n, c in carry.items()])
    id_type = source.schema["id"].dataType.simpleString()

    def on_same(left, right):
        return left["id"].eqNullSafe(right["r_id"]) & (left["key"] == right["r_key"])

    texts = source.select("id", "key", "text").where(F.octet_length("text") >= length)
    counts = texts.select("text").mapInArrow(_counted(length), "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    blocks = stored(counts.where("n > 1").select("block", "n", (F.col("n") > crowded).alias("crowded")), "blocks")
    sums = {r["crowded"]: r["n"] for r in blocks.groupBy("crowded").agg(F.sum("n").alias("n")).collect()}
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(least, sums.get(False, 0) // PART_SUFFIXES)
    window_parts = max(least, sums.get(True, 0) * (length - BLOCK) // 2 // PART_WINDOWS)
    spans = texts.mapInArrow(_spans(length), f"id {id_type}, key long, block long, first long, count int, back int")
    wanted = stored(spans.join(blocks.select("block", "crowded"), "block").groupBy("id", "key").agg(
        F.collect_set(F.struct("first", "count", "back", "crowded")).alias("spans")).select(
            F.col("id").alias("r_id"), F.col("key").alias("r_key"), "spans"), "spans")
    runs = texts.join(wanted, on_same(texts, wanted)).select("id", "key", "text", "spans").mapInArrow(
        _runs(length, parts, window_parts, id_type), _run_schema(id_type))
    marks = runs.groupBy("part").applyInArrow(_merge(length), f"id {id_type}, key long, first long, count long")
    marked = stored(marks.groupBy("id", "key").agg(F.collect_set(F.struct("first", "count")).alias("marks")).select(
        F.col("id").alias("r_id"), F.col("key").alias("r_key"), "marks"), "marks")
    joined = source.join(marked, on_same(source, marked), "left").drop("r_id", "r_key", "key")
    rest = [f for f in joined.schema.fields if f.name not in ("text", "marks")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    out = joined.mapInArrow(_cut_texts(length, with_text), f"{schema}, n_bytes long, n_removed long, n_spans long, kept binary, sha256 string")
    return out.select("id", *[F.col(f"`c_{n}`").alias(n) for n in carry], "n_bytes", "n_removed", "n_spans", "kept", "sha256")

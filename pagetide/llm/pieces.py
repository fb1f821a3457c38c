"""Operator 10: SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct word units are concatenated and indexed by a suffix array (suffixes up to the
longest piece).  Every piece of the vocabulary is found by binary search; the ranges give all its
occurrences, the edges of the units' segmentation graphs.  Edges are sorted by position and relaxed:

* unigram models: best score so far per position, from left to right;
* BPE models (a shortest path is not what they define): an edge is usable while it spans two
  neighbouring symbols; round by round every unit takes its best one, by score, then position.

Characters that no piece covers become byte pieces where the model has them, else the unknown piece.
A unit ends between two characters that are neighbours in no piece: no edge can reach over that place,
so units are segmented apart, and a unit seen before is looked up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, range_hashes

MARK = "▁"
CACHE = 250_000
# Units indexed together, in characters.
INDEX_CHARS = 1 << 18


@dataclass
class Vocabulary:
    """A model's pieces as the encoder needs them; small and sent to every worker."""
    pieces: list[str]
    scores: np.ndarray
    plain: np.ndarray  # ids of pieces that text can match
    bytes_: dict[int, int]  # byte -> id
    control: set[int]
    unknown: int
    bpe: bool

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a SentencePiece model file with the identity normaliser and a dummy prefix."""
        import sentencepiece

        with open(path, "rb") as f:
            p = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        n = p.vocab_size()
        pieces, scores = [p.id_to_piece(i) for i in range(n)], np.array([p.get_score(i) for i in range(n)])
        bytes_ = {int(pieces[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        control = {i for i in range(n) if p.is_control(i)}
        plain = np.array([i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))])
        # BPE scores are minus the merge order; unigram scores are log probabilities.
        bpe = bool(len(plain)) and bool((scores[plain] == np.round(scores[plain])).all())
        return Vocabulary(pieces, scores, plain, bytes_, control, p.unk_id(), bpe)

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        if len(self.bytes_) == 256:
            return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown]


class Encoder:
    """Encodes texts of a batch; remembers a bounded number of units."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        strings = [v.pieces[i] for i in v.plain]
        letters = sorted({ord(c) for s in strings for c in s})
        # Dense codes 1, 2, ... of the characters that pieces hold; 0 for all others.
        self.dense = np.zeros(0x110000, dtype=np.uint16)
        self.dense[letters] = np.arange(1, len(letters) + 1)
        # Neighbours that some piece holds: between any others no edge can pass, so a unit ends there.
        self.adjacent = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        coded = [self.dense[[ord(c) for c in s]] for s in strings]
        for c in coded:
            self.adjacent[c[:-1], c[1:]] = True
        self.spread = np.random.default_rng(10).integers(0, 1 << 64, 0x110000, dtype=np.uint64)
        self.sizes = np.array([len(c) for c in coded], dtype=np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.wide = -(-self.longest // 4)
        low = np.zeros((len(coded), 4 * self.wide), dtype=np.uint16)
        high = np.full((len(coded), 4 * self.wide), 0xFFFF, dtype=np.uint16)
        for i, c in enumerate(coded):
            low[i, :len(c)] = high[i, :len(c)] = c
        self.low, self.high = self._packed(low), self._packed(high)
        # Pieces by score, best first; equal scores share a place.
        values = np.unique(-v.scores[v.plain]) if len(strings) else np.zeros(0)
        self.place = np.searchsorted(values, -v.scores[v.plain])
        self._forget()

    def _forget(self):
        self.index: dict[str, int] = {}
        self.table = (np.zeros(0, np.int32), np.zeros(1, np.int64))

    @staticmethod
    def _packed(codes: np.ndarray) -> list[np.ndarray]:
        """Four 16-bit codes to a 64-bit number that sorts as they do; one array per four columns."""
        wide = codes.astype(np.uint64)
        return [(wide[:, i] << np.uint64(48)) | (wide[:, i + 1] << np.uint64(32)) | (wide[:, i + 2] << np.uint64(16)) | wide[:, i + 3]
                for i in range(0, codes.shape[1], 4)]

    def _suffix_array(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions in the order of their suffixes (as far as the longest piece reaches), and those
        suffixes packed, in that order."""
        padded = np.r_[codes, np.zeros(4 * self.wide, np.uint16)].astype(np.uint64)
        n = len(codes)
        quad = ((padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:])
        words = [quad[4 * i:4 * i + n] for i in range(self.wide)]
        array = np.lexsort(words[::-1])
        return array, [w[array] for w in words]

    def _bound(self, ordered: list[np.ndarray], keys: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all keys at once: the first suffix not below (``after``: above) each key."""
        low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(ordered[0]), np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = np.where(open_, (low + high) // 2, 0)
            below, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
            for o, k in zip(ordered, keys, strict=True):
                x = o[mid]
                below |= equal & (x < k)
                equal &= x == k
            if after:
                below |= equal
            low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)

    def _edges(self, codes: np.ndarray) -> np.ndarray:
        """Every occurrence of every piece: the piece that begins at a position and has a size, else
        -1.  Units in ``codes`` end with code 0, which no piece holds."""
        array, ordered = self._suffix_array(codes)
        low, up = self._bound(ordered, self.low, False), self._bound(ordered, self.high, True)
        count = up - low
        at = array[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        piece = np.repeat(np.arange(len(count)), count)
        # Sorted by writing each edge to its place: there is one piece at most of a size at a position.
        table = np.full((len(codes), self.longest + 1), -1, dtype=np.int32)
        table[at, self.sizes[piece]] = piece
        return table

    def _learn(self, units: list[str]) -> None:
        """Segment new units together, a bounded number of characters at a time."""
        at = 0
        while at < len(units):
            total, stop = 0, at
            while stop < len(units) and (stop == at or total + len(units[stop]) < INDEX_CHARS):
                total += len(units[stop]) + 1
                stop += 1
            part = units[at:stop]
            codes = self.dense[np.frombuffer(("\0".join(part) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(sizes + 1) - 1
            edge = self._edges(codes)
            symbol, ids = self._merge(ends, edge) if self.v.bpe else self._best_paths(ends - sizes, ends, edge)
            # Symbols that are no piece are single characters: bytes, or the unknown piece.
            lone = np.flatnonzero(ids < 0)
            count, flat = np.ones(len(ids), np.int64), ids
            if len(lone):
                text = "\0".join(part)
                spelled = [self.v.fallback(text[i]) for i in symbol[lone].tolist()]
                count[lone] = [len(s) for s in spelled]
                flat = np.repeat(ids, count)
                flat[flat < 0] = np.concatenate(spelled)
            owner = np.searchsorted(ends, symbol, "right")
            per_unit = np.bincount(owner, weights=count, minlength=len(part)).astype(np.int64)
            old_ids, old_ends = self.table
            self.table = (np.concatenate([old_ids, flat.astype(np.int32)]), np.concatenate([old_ends, old_ends[-1] + np.cumsum(per_unit)]))
            for k, unit in enumerate(part, len(self.index)):
                self.index[unit] = k
            at = stop

    def _merge(self, ends, edge):
        """BPE.  In each round every unit takes its best usable edge, one over two neighbouring symbols:
        by score, then from the left.  Returns the symbols' positions and ids (-1: no piece)."""
        n = len(edge)
        unit = np.searchsorted(ends, np.arange(n), "right")
        ending = np.arange(1, n + 1)  # of the symbol that starts here
        live = np.ones(n, dtype=bool)
        live[ends] = False
        symbols = np.flatnonzero(live)
        most = np.iinfo(np.int64).max
        while len(symbols):
            second = ending[symbols]
            inside = second < ends[unit[symbols]]
            symbols, second = symbols[inside], second[inside]
            if not len(symbols):
                break
            third = ending[second]
            width = third - symbols
            p = np.where(width <= self.longest, edge[symbols, np.minimum(width, self.longest)], -1)
            key = np.where(p >= 0, (self.place[p].astype(np.int64) << 32) | symbols, most)
            first = np.flatnonzero(np.r_[True, unit[symbols][1:] != unit[symbols][:-1]])
            best = np.minimum.reduceat(key, first)
            taken = best[best != most] & 0xFFFFFFFF
            if not len(taken):
                break
            gone = ending[taken]
            ending[taken] = ending[gone]
            live[gone] = False
            # Units without a usable edge are done.
            busy = np.zeros(len(ends), dtype=bool)
            busy[unit[taken]] = True
            symbols = symbols[live[symbols] & busy[unit[symbols]]]
        at = np.flatnonzero(live)
        p = edge[at, np.minimum(ending[at] - at, self.longest)]
        return at, np.where(p >= 0, self.v.plain[p], -1)

    def _best_paths(self, starts, ends, edge):
        """Unigram: relax edges in order of position; a character that no edge covers alone costs the
        worst score less 10."""
        scores, worst = self.v.scores[self.v.plain], float(self.v.scores[self.v.plain].min(initial=0.0)) - 10
        begin, size = np.nonzero(edge >= 0)
        piece = edge[begin, size]
        cuts = np.searchsorted(begin, np.r_[starts, ends[-1]])
        symbols, ids = [], []
        for s, e, a, b in zip(starts.tolist(), ends.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            n = e - s
            best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
            edges = list(zip((begin[a:b] - s).tolist(), size[a:b].tolist(), piece[a:b].tolist()))
            k = 0
            for i in range(n):
                single = False
                while k < len(edges) and edges[k][0] == i:
                    _, z, p = edges[k]
                    if best[i] + scores[p] > best[i + z]:
                        best[i + z], back[i + z] = best[i] + scores[p], (i, p)
                    single |= z == 1
                    k += 1
                if not single and best[i] + worst > best[i + 1]:
                    best[i + 1], back[i + 1] = best[i] + worst, (i, -1)
            path, i = [], n
            while i:
                path.append(back[i])
                i = back[i][0]
            for i, p in reversed(path):
                symbols.append(s + i)
                ids.append(int(self.v.plain[p]) if p >= 0 else -1)
        return np.array(symbols, dtype=np.int64), np.array(ids, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """ids of each text: null for null, none for an empty text."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.dense[points]
        bounds = np.r_[0, np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))]
        apart = np.r_[True, ~self.adjacent[codes[:-1], codes[1:]]] if len(codes) else np.zeros(0, bool)
        apart[bounds[bounds < len(codes)]] = True
        cuts = np.r_[np.flatnonzero(apart), len(codes)]
        edges = cuts.tolist()
        # One string for each distinct unit, told apart by a 64-bit hash of its code points.
        sums = prefix_sums(self.spread[points])
        _, first, inverse = np.unique(range_hashes(sums, cuts[:-1], cuts[1:]), return_index=True, return_inverse=True)
        units = [whole[edges[i]:edges[i + 1]] for i in first.tolist()]
        new = [u for u in units if u not in self.index]
        if len(self.index) + len(new) > CACHE:
            self._forget()
            new = units
        self._learn(new)
        flat, ends = self.table
        which = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))[inverse]
        count = ends[which + 1] - ends[which]
        upto = np.r_[0, np.cumsum(count)]
        ids = flat[np.repeat(ends[which] - upto[:-1], count) + np.arange(upto[-1])]
        offsets = upto[np.searchsorted(cuts, bounds)]
        nulls = np.array([t is None for t in texts], dtype=bool)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(nulls) if nulls.any() else None)


class Decoder:
    """Ids to text: byte pieces are joined and read as UTF-8, marks become blanks, the dummy prefix
    goes; control pieces vanish."""

    def __init__(self, vocabulary: Vocabulary):
        v, value = vocabulary, {i: bytes([b]) for b, i in vocabulary.bytes_.items()}
        spelled = [value.get(i, b"" if i in v.control else p.replace(MARK, " ").encode("utf-8", "surrogatepass"))
                   for i, p in enumerate(v.pieces)]
        self.sizes = np.array([len(x) for x in spelled], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        parts = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at:at + (1 << 18)]
            size = self.sizes[part]
            place = np.repeat(self.starts[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            parts.append(self.spelled[place].tobytes())
        data = b"".join(parts)
        return (data[1:] if data.startswith(b" ") else data).decode("utf-8", "replace")


def _encode_rows(shared, column, slice_chars=1 << 19):
    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(column).to_pylist()
            rest = [n for n in batch.schema.names if n != column]
            at = 0
            while at < len(texts):  # half a million characters at a time
                stop, total = at, 0
                while stop < len(texts) and (stop == at or total + len(texts[stop] or "") < slice_chars):
                    total += len(texts[stop] or "")
                    stop += 1
                ids = encoder.encode(texts[at:stop])
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(at, stop - at) for n in rest], ids], names=[*rest, "ids"])
                at = stop
    return run


def encode(docs: DataFrame, text: str, vocabulary: Vocabulary, keep: dict[str, Column]) -> DataFrame:
    """The ``keep`` columns and ids array<int> of every row; null for a null text, empty for an empty
    one.  Whole texts, one pass, no shuffle; rows are independent, so repeated rows encode alike."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_encode_rows(shared, "__text"), ", ".join(x for x in (schema, "ids array<int>") if x))


def _decode_rows(shared, column):
    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            rest = [n for n in batch.schema.names if n != column]
            ids = batch.column(column)
            values, cuts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().tolist()
            texts = [decoder.decode(values[a:b]) if ok else None
                     for a, b, ok in zip(cuts, cuts[1:], ids.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(texts, pa.string())], names=[*rest, "text"])
    return run


def decode_ids(encoded: DataFrame, ids: str, vocabulary: Vocabulary, keep: dict[str, Column]) -> DataFrame:
    """The ``keep`` columns and text of every row of ids; null for null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rows = encoded.select(*[c.alias(n) for n, c in keep.items()], F.col(ids).alias("__ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_decode_rows(shared, "__ids"), ", ".join(x for x in (schema, "text string") if x))

"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut into units wherever two adjacent characters occur side by side in no
piece, which no segmentation can cross; units that were not seen before are concatenated and
indexed by a suffix array (prefix doubling up to the longest piece). Every piece is
binary-searched, all at once, for its range of occurrences; the ranges become edges, are
sorted by position, and each unit is relaxed over its edges: along the best path for unigram
models, and by merges in order of score for BPE models, as their definition asks. Characters
of no piece fall back to byte pieces, or to the unknown piece where the model has none.

The model is the public protobuf format, read on the driver and shipped as bytes. Only the
identity normaliser is supported (others raise ValueError).

Defined results: null and empty texts have no ids and decode to the empty string; a literal
U+2581 decodes as a blank, as the format has it; ids out of range raise IndexError;
texts that repeat have equal ids; very long texts are encoded whole, and a unit without any cut
that is longer than ARRAY_CHARS is indexed in overlapping windows, so the index stays bounded;
an empty table gives no rows; extra columns stay as they are, but columns named like the added
ones are replaced.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Characters of texts taken at a time, of a suffix array, and units remembered by a worker.
TEXT_CHARS, ARRAY_CHARS, KEPT_UNITS = 2 << 20, 1 << 19, 1 << 18
#: Units up to this length are merged side by side, longer ones by a heap each.
SCAN = 48


def _fields(data: bytes):
    """(number, value) of a protobuf message; varints as int, everything else as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces and flags of a model, and the cuts between units."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.algorithm, self.prefix, squeeze = UNIGRAM, True, True
        normaliser = "identity"
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.algorithm = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                normaliser, self.prefix, squeeze = spec.get(1, b"").decode(), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if normaliser != "identity" or squeeze or self.algorithm not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with the identity normaliser and kept blanks are supported")
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER) and self.pieces[i]]
        self.single = {self.pieces[i]: i for i in usable if len(self.pieces[i]) == 1}
        self.multi = [i for i in usable if len(self.pieces[i]) > 1]
        self.longest = max((len(self.pieces[i]) for i in self.multi), default=1)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.worst = min((self.scores[i] for i in usable), default=0.0) - 10.0
        chars = sorted({c for i in self.multi for c in self.pieces[i]})
        self.char_id = np.zeros(0x110000, np.int32)
        self.char_id[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for i in self.multi:
            p = self.char_id[[ord(c) for c in self.pieces[i]]]
            self.joined[p[:-1], p[1:]] = True
        self.lengths = np.array([len(self.pieces[i]) for i in self.multi], np.int32)
        self.matrix = np.zeros((len(self.multi), self.longest), np.int32)
        for k, i in enumerate(self.multi):
            self.matrix[k, : self.lengths[k]] = self.char_id[[ord(c) for c in self.pieces[i]]]
        self.multi_ids = np.array(self.multi, np.int32)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == 3 else p.encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        #: Ids of units as 32-bit little-endian bytes, so that a text's are joined without an object an id.
        self.known: dict[str, bytes] = {}

    # -- matching ---------------------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        """The text, blanks escaped, cut where no piece can cross."""
        if not text:
            return []
        s = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        ids = self.char_id[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = [0, *(np.nonzero(~self.joined[ids[:-1], ids[1:]])[0] + 1).tolist(), len(s)]
        return [s[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def suffix_array(self, text: np.ndarray) -> np.ndarray:
        """Positions of text in the order of their suffixes, compared up to the longest piece."""
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        order, width, n = np.argsort(rank, kind="stable"), 1, len(text)
        while width < self.longest:
            after = np.zeros(n, np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            width *= 2
        return order

    def ranges(self, text: np.ndarray, array: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) in the suffix array for each of the pieces in rows, by simultaneous binary search."""
        pattern, size = self.matrix[rows], self.lengths[rows]
        padded = np.concatenate([text, np.zeros(self.longest, text.dtype)])
        inside = np.arange(self.longest) < size[:, None]

        def bound(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                suffix = padded[array[np.minimum(mid, len(array) - 1)][:, None] + np.arange(self.longest)]
                differ = (suffix != pattern) & inside
                first = differ.argmax(1)
                at = np.arange(len(rows))
                equal = ~differ[at, first]
                less = np.where(equal, after, suffix[at, first] < pattern[at, first])
                lo = np.where(open_ & less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)
            return lo

        return bound(False), bound(True)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every occurrence of a piece of two or more characters, by position."""
        if len(text) > 2 * ARRAY_CHARS:  # windows that overlap by the longest piece
            found = []
            for at in range(0, len(text), ARRAY_CHARS):
                start, length, piece = self.edges(text[at : at + ARRAY_CHARS + self.longest - 1])
                own = start < ARRAY_CHARS
                found.append((start[own] + at, length[own], piece[own]))
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))
        array = self.suffix_array(text)
        there = np.zeros(len(self.joined), bool)
        there[text] = True
        there[0] = True
        rows = np.nonzero(there[self.matrix].all(1))[0]
        if not len(rows):
            return (np.zeros(0, np.int64),) * 3
        lo, hi = self.ranges(text, array, rows)
        n = hi - lo
        rows, lo, n = rows[n > 0], lo[n > 0], n[n > 0]
        begin = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        start, piece = array[begin], np.repeat(rows, n)
        order = np.lexsort((self.lengths[piece], start))
        start, piece = start[order], piece[order]
        return start, self.lengths[piece].astype(np.int64), self.multi_ids[piece].astype(np.int64)

    # -- relaxing ---------------------------------------------------------------------------

    def _fallback(self, char: str) -> list[int]:
        if char in self.single:
            return [self.single[char]]
        if self.bytes:
            return [self.bytes[b] for b in char.encode("utf-8", "replace")]
        return [self.unknown]

    def _merge(self, unit: str, spans: dict[int, int]) -> tuple[int, ...]:
        """BPE: join the adjacent pair whose piece has the best score, leftmost first, until none is left."""
        wide, score = self.longest + 1, self.scores
        ahead, back = list(range(1, len(unit) + 2)), list(range(-1, len(unit)))
        heap = [(-score[i], a, a + 1, a + 2) for a in range(len(unit) - 1) if (i := spans.get(a * wide + 2)) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if ahead[a] != b or b >= len(unit) or ahead[b] != c:
                continue
            ahead[a], ahead[b] = c, -1
            if c < len(unit):
                back[c] = a
                d = ahead[c]
                if d - a <= self.longest and (i := spans.get(a * wide + d - a)) is not None:
                    heapq.heappush(heap, (-score[i], a, c, d))
            if a > 0 and c - back[a] <= self.longest and (i := spans.get(back[a] * wide + c - back[a])) is not None:
                heapq.heappush(heap, (-score[i], back[a], a, c))
        cuts = [0]
        while cuts[-1] < len(unit):
            cuts.append(ahead[cuts[-1]])
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a == 1:
                out += self._fallback(unit[a])
            else:
                out.append(spans[a * wide + b - a])
        return tuple(out)

    def _best_path(self, unit: str, spans: dict[int, int]) -> tuple[int, ...]:
        """Unigram: relax the edges in order of position."""
        wide = self.longest + 1
        best, back = [0.0] + [-np.inf] * len(unit), [(0, [0])] * (len(unit) + 1)
        for a, char in enumerate(unit):
            known = self.single.get(char)
            found = best[a] + (self.scores[known] if known is not None else self.worst)
            if found > best[a + 1]:
                best[a + 1], back[a + 1] = found, (a, self._fallback(char))
            for size in range(2, min(self.longest, len(unit) - a) + 1):
                i = spans.get(a * wide + size)
                if i is not None and best[a] + self.scores[i] > best[a + size]:
                    best[a + size], back[a + size] = best[a] + self.scores[i], (a, [i])
        out, at = [], len(unit)
        while at:
            at, ids = back[at]
            out[:0] = ids
        return tuple(out)

    def _learn(self, units: list[str]) -> None:
        points = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = self.char_id[points]  # the separators are in no piece
        sizes = np.array([len(u) for u in units], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        start, length, ids = self.edges(text)
        if self.algorithm == BPE:
            short = sizes <= SCAN
            if short.any():
                self._merge_all([u for u, ok in zip(units, short.tolist(), strict=True) if ok], starts[short], sizes[short], points, (start, length, ids))
            rest = np.nonzero(~short)[0].tolist()
        else:
            rest = range(len(units))
        relax = self._merge if self.algorithm == BPE else self._best_path
        for k in rest:
            a, b = np.searchsorted(start, [starts[k], starts[k] + sizes[k]])
            keys = ((start[a:b] - starts[k]) * (self.longest + 1) + length[a:b]).tolist()
            self.known[units[k]] = np.array(relax(units[k], dict(zip(keys, ids[a:b].tolist(), strict=True))), "<i4").tobytes()

    def _merge_all(self, units: list[str], starts: np.ndarray, sizes: np.ndarray, points: np.ndarray, edges: tuple) -> None:
        """BPE of many units side by side: in each round every unit joins its best pair, leftmost first."""
        wide = self.longest + 1
        start, length, ids = edges
        # Piece by position and length, over these units alone: long ones, with theirs, lie elsewhere.
        place = np.full(len(points), -1, np.int64)
        inside = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        place[inside] = np.arange(len(inside))
        held = place[start] >= 0
        table = np.full(len(inside) * wide, -1, np.int32)
        table[place[start[held]] * wide + length[held]] = ids[held]
        if not hasattr(self, "order"):
            self.order = np.unique(-np.array(self.scores), return_inverse=True)[1].astype(np.int64)
            self.single_id = np.full(0x110000, -1, np.int32)
            self.single_id[[ord(c) for c in self.single]] = list(self.single.values())
        none = len(self.order)
        unit = np.repeat(np.arange(len(units)), sizes)
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        span = np.ones(len(at), np.int64)
        done = []
        while len(at):
            joint = np.minimum(span[:-1] + span[1:], wide)
            ok = (unit[:-1] == unit[1:]) & (joint < wide)
            piece = np.where(ok, table[place[at[:-1]] * wide + np.where(ok, joint, 0)], -1)
            rank = np.append(np.where(piece >= 0, self.order[piece], none), none)
            first = np.concatenate([[0], np.nonzero(unit[1:] != unit[:-1])[0] + 1])
            key = np.minimum.reduceat(rank << 24 | np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)])), first)
            going = (key >> 24) < none
            merge = first[going] + (key[going] & (1 << 24) - 1)
            span[merge] += span[merge + 1]
            keep = np.ones(len(at), bool)
            keep[merge + 1] = False
            live = np.repeat(going, np.diff([*first, len(at)]))
            done.append((unit[~live], at[~live], span[~live]))
            keep &= live
            unit, at, span = unit[keep], at[keep], span[keep]
        unit, at, span = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(at, kind="stable")
        unit, at, span = unit[order], at[order], span[order]
        found = np.where(span > 1, table[place[at] * wide + span], self.single_id[points[at]])
        ends = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        raw = found.astype("<i4").tobytes()
        for k, u in enumerate(units):
            self.known[u] = raw[4 * ends[k] : 4 * ends[k + 1]]
        for k in np.unique(unit[found < 0]).tolist():  # characters of no piece
            a, b = ends[k], ends[k + 1]
            out: list[int] = []
            for i, p in zip(found[a:b].tolist(), at[a:b].tolist(), strict=True):
                out += [i] if i >= 0 else self._fallback(chr(points[p]))
            self.known[units[k]] = np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian bytes."""
        cut = [self.units(t or "") for t in texts]
        if len(self.known) > KEPT_UNITS:
            self.known.clear()
        new, size = [], 0
        for u in dict.fromkeys(u for units in cut for u in units if u not in self.known):
            if size + len(u) > ARRAY_CHARS and new:
                self._learn(new)
                new, size = [], 0
            new.append(u)
            size += len(u) + 1
        if new:
            self._learn(new)
        known = self.known
        return [b"".join([known[u] for u in units]) for units in cut]

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


_MODELS: dict[int, Model] = {}


def _model(data: bytes) -> Model:
    key = hash(data)
    if key not in _MODELS:
        _MODELS[key] = Model(data)
    return _MODELS[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _pieces_of(batch: pa.RecordBatch, column: str):
    """Row ranges of a batch whose texts hold about TEXT_CHARS."""
    texts = batch.column(column)
    at, size = 0, 0
    for i in range(batch.num_rows):
        size += len(texts[i].as_py() or "")
        if size > TEXT_CHARS:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def encode(df: DataFrame, text_col: str = "text", into: str = "ids", model: bytes | None = None) -> DataFrame:
    """df with the ids of its texts."""
    data = df.sparkSession.sparkContext.broadcast(model or read_model())

    def run(batches):
        m = _model(data.value)
        for batch in batches:
            for part in _pieces_of(batch, text_col):
                ids = m.encode_bytes(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids)], names=[*part.schema.names, into])

    df = df.drop(into)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return spread(df).mapInArrow(tidy(run), f"{fields}, `{into}` array<int>")


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))


def decode(df: DataFrame, ids_col: str = "ids", into: str = "decoded", model: bytes | None = None) -> DataFrame:
    """df with the texts of its ids."""
    data = df.sparkSession.sparkContext.broadcast(model or read_model())

    def run(batches):
        m = _model(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [m.decode(x or []) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    df = df.drop(into)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(tidy(run), f"{fields}, `{into}` string")


def tokenise(df: DataFrame, text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """df with ids, n_tokens, and round_trip: whether the ids decode to the text; one pass for both directions."""
    data = df.sparkSession.sparkContext.broadcast(model or read_model())

    def run(batches):
        m = _model(data.value)
        for batch in batches:
            for part in _pieces_of(batch, text_col):
                texts = part.column(text_col).to_pylist()
                ids = m.encode_bytes(texts)
                same = [m.decode(np.frombuffer(x, "<i4").tolist()) == (t or "").replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(same, pa.bool_())], names=[*part.schema.names, "ids", "n_tokens", "round_trip"])

    df = df.drop("ids", "n_tokens", "round_trip")
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return spread(df).mapInArrow(tidy(run), f"{fields}, ids array<int>, n_tokens long, round_trip boolean")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """(id, n_tokens, tokens_crc32, round_trip): ids are encoded, hashed as 32-bit little-endian, and decoded again."""
    data = df.sparkSession.sparkContext.broadcast(model or read_model())
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        m = _model(data.value)
        for batch in batches:
            for part in _pieces_of(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = m.encode_bytes(texts)
                made = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([m.decode(np.frombuffer(x, "<i4").tolist()) == (t or "").replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([part.column("id"), *made], names=["id", "n_tokens", "tokens_crc32", "round_trip"])

    return spread(rows).mapInArrow(tidy(run), "id long, n_tokens long, tokens_crc32 long, round_trip boolean")


def op3_query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens_crc32 and round_trip of all documents under the public 32k model."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")

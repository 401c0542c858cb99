"""Byte-level BPE by ranks: token boundaries from a scan of transition functions, merges of whole batches of pieces, decoding by kept offsets.

1. A batch's texts become one array of code points, and each code point a symbol: letter, number, other sign, space, other white
   space, or an apostrophe that one or two given letters follow; a text's first code point resets the automaton.
2. A symbol is a function from states to states. The closure of these functions under composition is small, so a function is
   a byte and composition a table; an inclusive scan by halves composes all prefixes. The state before a code point and its symbol
   tell whether a piece begins there. No pattern is run.
3. Pieces are looked up in a memo of the worker; new ones are merged together in vector steps, least rank first.
4. Each id keeps the byte offset of its end in the text, so decoding copies bytes to known places, and a span of bytes is a span of ids.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are encoded at a time, unless one text is longer; pieces that a worker remembers; bytes of a piece that is merged in a matrix, at most.
SLICE_BYTES, MEMO_SIZE, MATRIX_BYTES, MATRIX_ROWS = 1_000_000, 300_000, 48, 8192
#: Unicode's white space; what may follow an apostrophe as one piece.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]

LETTER, NUMBER, OTHER, SPACE, WHITE, SHORT, LONG = range(7)
#: States: what the code point before was; LEFT_k: k letters of an apostrophe's suffix are still to come.
AFTER_LETTER, AFTER_NUMBER, AFTER_OTHER, AFTER_SPACE, AFTER_WHITE, LEFT_2, LEFT_1, LEFT_0 = range(8)
N_SYMBOLS, N_STATES = 7, 8


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE or WHITE of every code point."""
    general = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((general.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    return out


def _step(state: int, symbol: int) -> int:
    if symbol == LETTER:
        return {LEFT_2: LEFT_1, LEFT_1: LEFT_0}.get(state, AFTER_LETTER)
    if symbol in (SHORT, LONG):  # a sign or a space before it takes the apostrophe into its own piece
        return AFTER_OTHER if state in (AFTER_OTHER, AFTER_SPACE) else LEFT_1 if symbol == SHORT else LEFT_2
    return {NUMBER: AFTER_NUMBER, OTHER: AFTER_OTHER, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE}[symbol]


def _begins(state: int, symbol: int) -> bool:
    """Whether a piece begins at a symbol, but for the last of a run of white space."""
    joins = {LETTER: (AFTER_LETTER, AFTER_SPACE, LEFT_2, LEFT_1), NUMBER: (AFTER_NUMBER, AFTER_SPACE), SPACE: (AFTER_SPACE, AFTER_WHITE), WHITE: (AFTER_SPACE, AFTER_WHITE)}
    return state not in joins.get(symbol, (AFTER_OTHER, AFTER_SPACE))


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composition of two functions (the first's number times their count plus the second's), the state that each function leads to from a text's start, and where pieces begin.

    Functions 0 to 6 are the symbols', 7 to 13 those of a text's first code point, the rest are what composition adds.
    """
    symbols = [tuple(_step(q, s) for q in range(N_STATES)) for s in range(N_SYMBOLS)]
    symbols += [(f[AFTER_WHITE],) * N_STATES for f in symbols]
    functions, number = list(symbols), {}
    for i, f in enumerate(functions):
        number.setdefault(f, i)
    for f in functions:  # grows until the set is closed
        for g in symbols:
            both = tuple(g[q] for q in f)
            if both not in number:
                number[both] = len(functions)
                functions.append(both)
    table = np.array([[number[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint8).ravel()
    begins = np.array([[_begins(q, s) for s in range(N_SYMBOLS)] for q in range(N_STATES)]).ravel()
    return table, np.array([f[AFTER_WHITE] for f in functions], np.uint8), begins


def scan(functions: np.ndarray) -> np.ndarray:
    """All prefixes' compositions, in order: pairs are composed, scanned as one, and parted again."""
    table, lead, _ = automaton()
    n = len(functions)
    if n < 2:
        return functions.copy()
    pairs = scan(table[functions[: n - n % 2 : 2].astype(np.uint16) * len(lead) + functions[1::2]])
    out = np.empty_like(functions)
    out[0], out[1::2] = functions[0], pairs
    rest = functions[2::2]
    out[2::2] = table[pairs[: len(rest)].astype(np.uint16) * len(lead) + rest]
    return out


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point; `first` are the texts' first code points, ascending."""
    n = len(points)
    symbols = code_point_classes()[points]
    starts = np.zeros(n + 3, bool)
    starts[first] = True
    starts[n:] = True
    for at in [np.flatnonzero(points == ord("'"))]:
        follow = np.append(points, np.zeros(2, points.dtype))
        one, two = follow[at + 1], follow[at + 2]
        for suffix in SUFFIXES:
            hit = (one == ord(suffix[0])) & ~starts[at + 1]
            if len(suffix) == 2:
                hit &= (two == ord(suffix[1])) & ~starts[at + 2]
            symbols[at[hit]] = SHORT if len(suffix) == 1 else LONG
    functions = symbols.copy()
    functions[first] += N_SYMBOLS
    _, lead, begins = automaton()
    before = np.empty(n, np.uint8)
    before[1:] = lead[scan(functions)[:-1]]
    before[first] = AFTER_WHITE
    out = begins[before * N_SYMBOLS + symbols]
    # The last of a run of white space that something follows begins a piece too.
    white = (symbols == SPACE) | (symbols == WHITE)
    out |= white & ~np.append(white[1:], True) & ~starts[1 : n + 1]
    out[first] = True
    return out


class _Memo(dict):
    """Numbers of pieces in order of arrival; new ones are listed in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


class Tokens:
    """Tokens' bytes by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * self.size
        for t, i in ranks.items():
            tokens[i] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)


class Vocabulary(Tokens):
    """Which pairs of ids merge into which, besides: every cut of a token into two tokens is such a pair."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.ranks, size = ranks, self.size
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("a byte-level vocabulary has every single byte")
        pairs = sorted((ranks[t[:k]] * size + ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pair_keys, self.pair_ids = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((-1,), (size,))))
        self.pair_of = dict(pairs)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two neighbours merge into, which is its rank too; the vocabulary's size where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ids[at], self.size)

    def merge_alike(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of some bytes: a row a piece, and in each step the leftmost least pair of every row merges."""
        n, width = len(pieces), max(map(len, pieces))
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((n, width + 1), -1, np.int64)
        row, col = np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids[row, col] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.merged(ids[:, :-1], ids[:, 1:])
        live, out = np.arange(n), ids
        ids, places = ids.copy(), np.arange(width + 1)
        while len(live):
            at = rank.argmin(1)
            best = rank[np.arange(len(live)), at]
            on = best < self.size
            if not on.all():
                out[live[~on]] = ids[~on]
                live, ids, rank, at, best = live[on], ids[on], rank[on], at[on], best[on]
                if not len(live):
                    break
            rows = np.arange(len(live))
            ids[rows, at] = best
            shift = np.minimum(places + (places > at[:, None]), width)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, shift[:, :-1].clip(max=width - 1), 1)
            rank[:, -1] = self.size
            for k in (at - 1, at):
                good = k >= 0
                k = np.where(good, k, 0)
                new = self.merged(ids[rows, k], ids[rows, np.minimum(k + 1, width)])
                rank[rows[good], np.minimum(k[good], width - 1)] = new[good]
        return [r[: np.searchsorted(-(r >= 0).astype(np.int8), 0)] for r in out]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one piece of any length: a heap of pairs over a linked list, n log n."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, size, get = len(ids), self.size, self.pair_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if ids[i] < 0 or after[i] != j or ids[j] < 0 or get(ids[i] * size + ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get(r * size + ids[k])) is not None:
                    heapq.heappush(heap, (x, i, k))
            if (h := before[i]) >= 0 and (x := get(ids[h] * size + r)) is not None:
                heapq.heappush(heap, (x, h, i))
        return np.array([x for x in ids if x >= 0], np.int64)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        several = []
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r], np.int64)
            elif len(p) > MATRIX_BYTES:
                out[i] = self.merge_long(p)
            else:
                several.append(i)
        several.sort(key=lambda i: len(pieces[i]))
        for k in range(0, len(several), MATRIX_ROWS):
            some = several[k : k + MATRIX_ROWS]
            for i, ids in zip(some, self.merge_alike([pieces[i] for i in some]), strict=True):
                out[i] = ids
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


@lru_cache(2)
def tokens_of(path: str) -> Tokens:
    """One a worker process."""
    return Tokens(read_ranks(path))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One a worker process."""
    return Vocabulary(read_ranks(path))


class Encoder:
    def __init__(self, words: Vocabulary, memo_size: int = MEMO_SIZE):
        self.words, self.memo_size = words, memo_size
        self._forget()

    def _forget(self) -> None:
        self.memo, self.flat, self.start, self.count = _Memo(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts that end at these bytes; each id's end in its text; where each text's ids end."""
        raw = np.frombuffer(data, np.uint8)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        at_byte = np.flatnonzero((raw & 0xC0) != 0x80)
        begin = np.append(0, ends[:-1])
        first = np.searchsorted(at_byte, begin[ends > begin])
        cuts = at_byte[piece_starts(points, first)] if len(points) else at_byte
        if len(self.memo) > self.memo_size:
            self._forget()
        bounds = np.append(cuts, len(data)).tolist()
        self.memo.fresh = []
        seen = np.fromiter(map(self.memo.__getitem__, [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]), np.int64, len(cuts))
        if self.memo.fresh:
            new = self.words.merge(self.memo.fresh)
            size = np.array([len(x) for x in new], np.int64)
            self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
            self.count = np.append(self.count, size)
            self.flat = np.concatenate([self.flat, *new]).astype(np.int32)
        count = self.count[seen]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[seen] - upto + count, count)]
        stop = np.cumsum(self.words.lengths[ids])
        token_ends = np.append(0, upto)[np.searchsorted(cuts, ends)]
        return ids, stop - np.repeat(begin, np.diff(token_ends, prepend=0)), token_ends


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One a worker process, so that its memo outlives a task."""
    return Encoder(vocabulary(path))


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Unsigned 32-bit little-endian values, packed by row."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int32).tobytes()), pa.py_buffer(values.astype("<u4").tobytes())])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            texts, i = pc.fill_null(batch.column(1), b""), 0
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            while i < len(texts):
                seen = int(upto[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(upto, seen + SLICE_BYTES, "right")))
                data = b"".join(texts.slice(i, j - i).to_pylist())
                ids, stop, ends = encoder.encode(data, upto[i:j] - seen)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _binary(ids, ends), _binary(stop, ends)], ["doc_id", "ids", "ends"])
                i = j

    return run


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and ends: a document's token ids and the byte offsets at which they end, both as unsigned 32-bit little-endian integers in a binary.

    A row for each row, whatever repeats. A null text is as an empty one: no ids. Texts of any length are encoded whole; a piece of any length
    is merged in n log n. Special tokens' strings are plain text. Columns besides id and text aren't read, so none can clash; an empty table gives one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_encode(ranks_path), "doc_id long, ids binary, ends binary")


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and where each row's end."""
    rows = pc.fill_null(column, b"")
    ends = np.cumsum(pc.binary_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)) // 4
    return np.frombuffer(b"".join(rows.to_pylist()), "<u4").astype(np.int64), ends


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens_of(path)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(pc.fill_null(batch.column("ends"), b"")).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE_BYTES, "right")))
                some = batch.slice(i, j - i)
                i = j
                (ids, upto), (stop, _) = _packed(some.column("ids")), _packed(some.column("ends"))
                if len(ids) and ids.max() >= words.size:
                    raise ValueError(f"{int(ids.max())} is no id of the vocabulary")
                # A text's bytes begin where the text before it ends: at its last id's end.
                held = np.where(np.diff(upto, prepend=0) > 0, np.append(0, stop)[upto], 0)
                base = np.cumsum(held) - held
                size = words.lengths[ids]
                place = stop - size + np.repeat(base, np.diff(upto, prepend=0))
                out = np.empty(int(held.sum()), np.uint8)
                within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                out[np.repeat(place, size) + within] = words.flat[np.repeat(words.starts[ids], size) + within]
                offsets = np.append(0, np.cumsum(held)).astype(np.int32)
                text = pa.Array.from_buffers(pa.binary(), some.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in ("doc_id", "ids")), text], ["doc_id", "ids", "bytes"])

    return run


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and bytes: the text's bytes back from what `encode` gives, each id's at its kept offset. A null row of ids has no bytes; an id outside the vocabulary is an error."""
    return tokens.select("doc_id", "ids", "ends").mapInArrow(_decode(ranks_path), "doc_id long, ids binary, bytes binary")

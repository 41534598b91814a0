"""Byte-level BPE without a regex engine.

Texts of a batch lie behind one another as code points. Each code point gets a
class (letter, number, white space that ends a run, apostrophe that opens a
contraction, ...), and a class is a function from the tokenizer's state before
the code point to the state after it. Those functions compose associatively, so
a two-level prefix scan over their composition table yields every state, and
from state and class every piece boundary, with array operations alone. A piece
is looked up by its hash in a cache of merged pieces; only pieces that are not
there are merged, by the pair of lowest rank first.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The code points that \s matches, as inclusive ranges.
SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
          (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

# Classes of code points, what follows taken into account.
LETTER, NUMBER, OTHER, SPACE, JOINING, LAST, SHORT, LONG = range(8)
#: Added to the class of a text's first code point.
FIRST = 8
# States: the kind of piece that is open. JOINED: a blank waits for its word; CLOSED: none; ONE, TWO: so many letters of a contraction to come.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, JOINED, CLOSED, ONE, TWO = range(8)
#: Code points of a block of the scan.
BLOCK = 128
#: Bytes of text that are worked on at once.
CHUNK = 1 << 18


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point, and whether a piece starts at it."""
    if kind >= FIRST:
        state, kind = CLOSED, kind - FIRST
    if kind == LETTER and state in (ONE, TWO):
        return (CLOSED if state == ONE else ONE), False
    if kind in (SHORT, LONG) and state not in (IN_OTHER, JOINED):
        return (ONE if kind == SHORT else TWO), True
    if kind in (JOINING, LAST):
        return (JOINED if kind == JOINING else CLOSED), True
    into = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, SPACE: IN_SPACE}.get(kind, IN_OTHER)
    return into, state not in (into, JOINED)


@lru_cache(maxsize=1)
def _scan_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each class, composition table, state that each function leads to from CLOSED, and boundaries."""
    generators = [tuple(_step(s, k)[0] for s in range(8)) for k in range(2 * FIRST)]
    number = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    for f in queue:
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                queue.append(h)
    n = len(queue)
    compose = np.zeros((n, n), np.int16)
    for i, f in enumerate(queue):
        for j, g in enumerate(queue):
            compose[i, j] = number[tuple(g[x] for x in f)]
    starts = np.array([[_step(s, k)[1] for k in range(2 * FIRST)] for s in range(8)], bool)
    return np.array([number[g] for g in generators], np.int16), compose, np.array([f[CLOSED] for f in queue], np.int16), starts


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of each code point."""
    every = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    for a, b in SPACES:
        table[a : b + 1] = SPACE
    return table


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Indices at which pieces start. points: code points of all texts; firsts: index of each non-empty text's first."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _class_table()[points]
    space = kind == SPACE
    ends = np.zeros(n, bool)
    ends[firsts[1:] - 1] = True
    ends[-1] = True
    more = np.append(~space[1:], False) & ~ends  # a code point that is no white space follows in the same text
    blank = points == 0x20
    kind[space & more] = LAST
    kind[space & more & blank] = JOINING
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        room1 = quote + 1 < n
        room1[room1] = ~ends[quote[room1]]
        room2 = room1 & (quote + 2 < n)
        room2[room2] &= ~ends[quote[room2] + 1]
        one = points[np.minimum(quote + 1, n - 1)]
        two = points[np.minimum(quote + 2, n - 1)]
        kind[quote[room1 & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kind[quote[room2 & pair]] = LONG
    kind[firsts] += FIRST
    of_class, compose, state_of, starts = _scan_tables()
    k = len(compose)
    flat = compose.ravel()
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = kind
    columns = np.ascontiguousarray(of_class[padded].reshape(blocks, BLOCK).T).astype(np.int32)
    prefix = np.empty((BLOCK, blocks), np.int32)
    prefix[0] = columns[0]
    for j in range(1, BLOCK):  # within blocks, all blocks at once
        prefix[j] = flat[prefix[j - 1] * k + columns[j]]
    total = prefix[-1].copy()
    span = 1
    while span < blocks:  # over blocks, by doubling
        total[span:] = flat[total[:-span] * k + total[span:]]
        span *= 2
    before = np.concatenate(([0], total[:-1])).astype(np.int32)
    after = state_of[flat[before[None, :] * k + prefix]].T.reshape(-1)[: n]
    state = np.concatenate(([CLOSED], after[:-1]))
    return np.flatnonzero(starts.ravel()[state * (2 * FIRST) + kind])


class Vocabulary:
    """Token bytes and the pairs that merge: pairs[(a, b)] = (rank, id).

    shortcut: a piece that is a token is that token, whatever its merges would make of it.
    """

    #: Rank of a pair that does not merge.
    NEVER = np.int32(2**31 - 1)

    def __init__(self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], tuple[int, int]], shortcut: bool):
        self.pairs, self.shortcut = pairs, shortcut
        self.whole = {t: i for i, t in tokens.items()}
        self.bytes_of = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)
        self._pair_table()
        size = max(tokens) + 1
        self.length = np.zeros(size, np.int64)
        for i, t in tokens.items():
            self.length[i] = len(t)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A rank file: base64 of a token's bytes and its rank, which is its id; any two tokens whose bytes make a third merge."""
        with open(path, "rb") as f:
            tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
        whole = {t: i for i, t in tokens.items()}
        pairs = {}
        for t, i in whole.items():
            for cut in range(1, len(t)):
                a, b = whole.get(t[:cut]), whole.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (i, i)
        return cls(tokens, pairs, True)

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A tokenizer file with a vocabulary and a list of merges over printable stand-ins of bytes."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = model["vocab"]
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        merged = {vocab[c] for c in byte_of if c in vocab} | {i for _, i in pairs.values()}
        return cls({i: t for i, t in tokens.items() if i in merged}, pairs, False)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def _pair_table(self) -> None:
        """The pairs in an open-addressing table of arrays, for lookups of many pairs at once."""
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.uint64)
        values = np.array(list(self.pairs.values()), np.int32).reshape(-1, 2)
        self._mask = (1 << 21) - 1
        self._keys = np.full(self._mask + 1, 2**64 - 1, np.uint64)
        self._rank, self._id = np.full(self._mask + 1, self.NEVER, np.int32), np.zeros(self._mask + 1, np.int32)
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = self._keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self._keys[slot[put]] = keys[todo[put]]
            self._rank[slot[put]], self._id[slot[put]] = values[todo[put]].T
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) & self._mask

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair; the slot of a pair that does not merge has the rank NEVER."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slots(keys)
        found = self._keys[slot]
        odd = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & self._mask
            found = self._keys[slot[odd]]
            odd = odd[(found != keys[odd]) & (found != np.uint64(2**64 - 1))]
        return slot

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: the adjacent pair of lowest rank, the leftmost of equals, merges until none is left."""
        out: list = [None] * len(pieces)
        todo = []
        for k, piece in enumerate(pieces):
            whole = self.whole.get(piece) if self.shortcut else None
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            elif len(piece) > 64:
                out[k] = np.array(self._merge_long(self.bytes_of[np.frombuffer(piece, np.uint8)].tolist()), np.int32)
            else:
                todo.append(k)
        if todo:
            ids = self.bytes_of[np.frombuffer(b"".join([pieces[k] for k in todo]), np.uint8)]
            self._merge_many(ids, np.array([len(pieces[k]) for k in todo]), todo, out)
        return out

    def _merge_many(self, ids: np.ndarray, sizes: np.ndarray, names: list[int], out: list) -> None:
        """Merge many short pieces at once, one pair of each piece in a round."""
        names = np.array(names)
        at = None  # the slot of each id's pair with the next, a slot without pair at a piece's end
        while True:
            ends = np.cumsum(sizes)
            starts = ends - sizes
            if at is None:
                at = self._lookup(ids, np.append(ids[1:], 0))
                at[ends - 1] = -1
            rank = np.where(at >= 0, self._rank[at], self.NEVER)
            best = np.minimum.reduceat(rank, starts)
            over = best == self.NEVER
            for k in np.flatnonzero(over).tolist():
                out[names[k]] = ids[starts[k] : ends[k]]
            if over.all():
                return
            keep = np.repeat(~over, sizes)
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = np.repeat(np.arange(len(sizes)), sizes)[hit]
            hit = hit[np.append(True, owner[1:] != owner[:-1]) & ~over[owner]]  # the leftmost of each piece that goes on
            ids[hit] = self._id[at[hit]]
            keep[hit + 1] = False
            last = at[hit + 1] < 0
            at[hit] = np.where(last, -1, self._lookup(ids[hit], ids[np.minimum(hit + 2, len(ids) - 1)]))
            inner = hit[hit > starts[~over]]
            at[inner - 1] = self._lookup(ids[inner - 1], ids[inner])
            ids, at = ids[keep], at[keep]
            sizes, names = sizes[~over] - 1, names[~over]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, in n log n."""
        n, pairs = len(ids), self.pairs
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = merged, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := pairs.get((merged, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (p[0], i, merged, ids[after[i]], p[1]))
            if (h := before[i]) >= 0 and (p := pairs.get((ids[h], merged))) is not None:
                heapq.heappush(heap, (p[0], h, ids[h], merged, p[1]))
        return [t for t, a in zip(ids, alive, strict=True) if a]


class Encoder:
    """Encodes batches of texts; holds the cache of merged pieces, which is emptied when it has `most` pieces."""

    SLOTS = 1 << 20
    _P = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, vocabulary: Vocabulary, most: int = 500_000):
        self.vocabulary, self.most = vocabulary, most
        self._powers = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self._known: dict[int, int] = {}
        self._flat, self._used = np.zeros(1 << 16, np.int32), 0
        # The pieces themselves, behind one another, where each starts and how long it is.
        self._bytes, self._filled, self._from, self._own = np.zeros(1 << 16, np.uint8), 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._start, self._length, self._n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self._slot_hash, self._slot_piece = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """64-bit hash of each piece: a polynomial in its bytes from its own start, mixed with its length."""
        if len(self._powers) < len(data) + 1:
            with np.errstate(over="ignore"):
                self._powers = np.multiply.accumulate(np.full(2 * len(data) + 2, self._P, np.uint64))
                inverse = pow(int(self._P), -1, 1 << 64)
                self._inverses = np.multiply.accumulate(np.full(2 * len(data) + 2, inverse, np.uint64))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], starts)
            h = sums * self._inverses[starts] + lengths.astype(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            return h ^ (h >> np.uint64(32))

    def _add(self, pieces: list[bytes]) -> range:
        """Put fresh pieces into the cache; their indices."""
        merged = self.vocabulary.merge(pieces)
        sizes = np.array([len(x) for x in merged], np.int64)
        used, n = self._used + int(sizes.sum()), self._n + len(merged)
        if used > len(self._flat):
            self._flat = np.resize(self._flat, 2 * used)
        if n > len(self._start):
            self._start, self._length, self._from, self._own = (np.resize(x, 2 * n) for x in (self._start, self._length, self._from, self._own))
        self._flat[self._used : used] = np.concatenate(merged)
        self._start[self._n : n] = self._used + np.cumsum(sizes) - sizes
        self._length[self._n : n] = sizes
        whole = np.frombuffer(b"".join(pieces), np.uint8)
        own = np.array([len(p) for p in pieces], np.int64)
        filled = self._filled + len(whole)
        if filled > len(self._bytes):
            self._bytes = np.resize(self._bytes, 2 * filled)
        self._bytes[self._filled : filled] = whole
        self._from[self._n : n], self._own[self._n : n] = self._filled + np.cumsum(own) - own, own
        self._filled = filled
        added = range(self._n, n)
        self._used, self._n = used, n
        return added

    def _pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Index into the cache of each piece."""
        if self._n > self.most:
            self._clear()
        h = self._hashes(data, starts, lengths)
        slot = (h >> np.uint64(40)).astype(np.int64) & (self.SLOTS - 1)
        out = self._slot_piece[slot]
        miss = np.flatnonzero((self._slot_hash[slot] != h) | (out < 0))
        if len(miss):
            fresh, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            keys = fresh.tolist()
            known = self._known
            new = [k for k, key in enumerate(keys) if key not in known]
            if new:
                raw = data.tobytes()
                where = miss[first[new]]
                spans = zip(starts[where].tolist(), lengths[where].tolist(), strict=True)
                for k, piece in zip(new, self._add([raw[s : s + n] for s, n in spans]), strict=True):
                    known[keys[k]] = piece
            at = np.array([known[key] for key in keys], np.int64)
            out[miss] = at[back]
            s = (fresh >> np.uint64(40)).astype(np.int64) & (self.SLOTS - 1)
            self._slot_hash[s], self._slot_piece[s] = fresh, at
            # Of two fresh hashes for one slot the last written stays in both arrays: they are written in the same order.
        return self._checked(data, starts, lengths, out)

    def _checked(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, found: np.ndarray) -> np.ndarray:
        """found, with pieces that share only their hash with the cached one merged by themselves."""
        place = np.repeat(self._from[found] - starts, lengths) + np.arange(len(data))
        other = np.flatnonzero(self._bytes[np.minimum(place, len(self._bytes) - 1)] != data)
        wrong = np.union1d(np.flatnonzero(self._own[found] != lengths), np.searchsorted(starts, other, "right") - 1)
        if len(wrong):
            raw = data.tobytes()
            found = found.copy()
            found[wrong] = list(self._add([raw[s : s + n] for s, n in zip(starts[wrong].tolist(), lengths[wrong].tolist(), strict=True)]))
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offset of each text's ids. data: UTF-8 of all texts; offsets: where each starts, and the end."""
        counts = np.zeros(len(offsets), np.int64)
        if not len(data):
            return np.zeros(0, np.int32), counts
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        begins = offsets[:-1][offsets[1:] > offsets[:-1]]
        starts = leads[piece_starts(points, np.searchsorted(leads, begins))]
        lengths = np.diff(starts, append=len(data))
        pieces = self._pieces(data, starts, lengths)
        sizes = self._length[pieces]
        ends = np.cumsum(sizes)
        where = np.repeat(self._start[pieces] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        upto = np.concatenate(([0], ends))
        return self._flat[where], upto[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the ids, the offset of each text's bytes, and the offset at which each id's bytes end."""
        v = self.vocabulary
        sizes = v.length[ids]
        ends = np.cumsum(sizes)
        upto = np.concatenate(([0], ends))
        where = np.repeat(v.start[ids] - (ends - sizes), sizes) + np.arange(int(upto[-1]))
        return v.flat[where], upto[offsets], ends


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a worker process for a vocabulary file; .json or a rank file."""
    return Encoder(Vocabulary.from_json(path) if path.endswith(".json") else Vocabulary.from_ranks(path))


def chunks_of(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of rows with about `most` bytes or one row; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary rows that lie behind one another in data."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids, ends and, if asked for, decoded.

    ids: binary, little-endian unsigned 32-bit; ends: the same, where each id's bytes end in the text, so that any
    run of ids maps back to its span; decoded: the bytes that the ids stand for, made from the ids alone. A null or
    empty text has no ids. A text is encoded whole, whatever its length; a row's work depends on its text alone.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for i, j, data, offsets in chunks_of(batch.column(1)):
                ids, upto = enc.encode(data, offsets)
                back, back_upto, ends = enc.decode(ids, upto)
                ends = ends - np.repeat(back_upto[:-1], np.diff(upto))
                columns = [
                    batch.column(0).slice(i, j - i), pa.array(np.diff(upto)),
                    binary_array(ids.astype("<u4").view(np.uint8), 4 * upto), binary_array(ends.astype("<u4").view(np.uint8), 4 * upto),
                ]
                names = [id_col, "n_tokens", "ids", "ends"]
                if decoded:
                    columns, names = [*columns, binary_array(back, back_upto)], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays([c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in columns], names)

    schema = f"`{id_col}` {id_type}, n_tokens long, ids binary, ends binary" + ", decoded binary" * decoded
    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(rows, schema)

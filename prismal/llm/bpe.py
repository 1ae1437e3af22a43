"""Byte-level BPE encoding and decoding without regular expressions.

A batch of texts is one flat array of code points. Each code point becomes a symbol (letter,
number, white space before a word, ...); a symbol is a function from automaton state to automaton
state. These functions form a small monoid, so the states at all positions come from a scan over a
composition table, in which a text of any length takes no longer per character than a short one. A
text begins with a constant function, which forgets what stood before it. Where the state says so, a
slice begins. Slices go through a bounded cache to pair merging: short ones together, in rounds
over a matrix of all new slices; long ones through a heap.

Defined results: a null text counts as empty; an empty text has no ids; rows are independent, so ties and
repeated rows give equal results; an empty table gives an empty table; columns named like the outputs
are replaced, all others are kept.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from prismal.llm.common import append, flat_text, slices, with_fields, worker_cache

# Code point classes.
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# Symbols: what a position means for the automaton, given its next neighbours.
(S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_INNER, S_LAST, S_JOIN, S_RESET) = range(9)
# States: what the token that holds the last position is.
(AT_END, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_SPACES, ONE_LEFT, TWO_LEFT) = range(8)

# Fixed values of the pattern: the letters that may follow an apostrophe, alone or in pairs.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
#: Slices up to this many bytes are merged together in a matrix and kept in the cache.
SHORT_SLICE = 32


def code_point_classes() -> np.ndarray:
    """Class of every code point, by the Unicode tables of the tokenizer library itself.

    A probe encoding of single bytes keeps just what its pattern matches, so the text of all code points
    returns the members of a class.
    """
    import tiktoken

    points = np.array([i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF], dtype="<u4")
    text = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        members = bytes(probe.encode_ordinary(text)).decode("utf-8").encode("utf-32-le")
        table[np.frombuffer(members, "<u4")] = kind
    return table


class Transitions:
    """The monoid of the symbols' state functions, closed under composition."""

    def __init__(self) -> None:
        def step(symbol: int, state: int) -> tuple[int, bool]:
            """The next state, and whether a token begins."""
            if symbol == S_RESET:
                return AT_END, False
            if symbol == S_LETTER:
                if state == TWO_LEFT:
                    return ONE_LEFT, False
                if state == ONE_LEFT:
                    return AT_END, False
                return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
            if symbol == S_NUMBER:
                return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
            if symbol in (S_OTHER, S_QUOTE1, S_QUOTE2):
                if symbol == S_OTHER or state in (IN_OTHERS, AFTER_SPACE):
                    return IN_OTHERS, state not in (IN_OTHERS, AFTER_SPACE)
                return (ONE_LEFT if symbol == S_QUOTE1 else TWO_LEFT), True
            if symbol == S_INNER:
                return IN_SPACES, state != IN_SPACES
            return (AT_END if symbol == S_LAST else AFTER_SPACE), True

        self.starts = np.array([[step(a, s)[1] for s in range(8)] for a in range(9)], np.bool_)
        generators = [tuple(step(a, s)[0] for s in range(8)) for a in range(9)]
        known = {f: i for i, f in enumerate(dict.fromkeys(generators))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in generators:
                h = tuple(g[s] for s in f)  # f first, then g
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        functions = list(known)
        size = len(functions)
        self.shift = max(1, (size - 1).bit_length())
        self.of_symbol = np.array([known[g] for g in generators], np.uint8)
        self.compose = np.zeros((size, 1 << self.shift), np.uint8)
        for i, f in enumerate(functions):
            for j, g in enumerate(functions):
                self.compose[i, j] = known.get(tuple(g[s] for s in f), 0)
        self.compose = self.compose.ravel()
        self.from_end = np.array([f[AT_END] for f in functions], np.uint8)

    def scan(self, functions: np.ndarray, width: int = 64) -> np.ndarray:
        """Inclusive scan of composition: entry i is the function of the first i + 1 symbols."""
        n = len(functions)
        if n <= width:
            out = functions.copy()
            for i in range(1, n):
                out[i] = self.compose[(int(out[i - 1]) << self.shift) | int(out[i])]
            return out
        identity_free = -n % width  # fill up with resets: what follows them is not read
        table = np.concatenate([functions, np.full(identity_free, self.of_symbol[S_RESET], np.uint8)]).reshape(-1, width).T.copy()
        index = np.empty(table.shape[1], np.intp)
        for j in range(1, width):
            np.left_shift(table[j - 1], self.shift, out=index, dtype=np.intp, casting="unsafe")
            index |= table[j]
            np.take(self.compose, index, out=table[j])
        before = self.scan(table[-1].copy(), width)  # function of all rows up to and with each
        for j in range(width):
            np.left_shift(before[:-1], self.shift, out=index[1:], dtype=np.intp, casting="unsafe")
            index[1:] |= table[j, 1:]
            table[j, 1:] = self.compose[index[1:]]
        return table.T.reshape(-1)[:n]


class Pretokenizer:
    """Finds where slices begin."""

    def __init__(self) -> None:
        self.classes = code_point_classes()
        self.transitions = Transitions()

    def starts(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Byte offsets at which slices begin, in order. ``ends``: 0 and the end of each text in ``data``."""
        if not data:
            return np.zeros(0, np.int64)
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # byte offset of each code point
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
        kind = self.classes[points]
        n = len(points)
        first = np.zeros(n + 1, np.bool_)  # begins a text
        first[np.searchsorted(at, ends[:-1][ends[:-1] < len(data)])] = True
        first[n] = True
        space = kind == SPACE
        symbol = np.array([S_LETTER, S_NUMBER, S_INNER, S_OTHER], np.uint8)[kind]
        symbol[kind == OTHER] = S_OTHER
        # White space before a word: its last character stands alone, or joins the word if it is a plain blank.
        ends_run = np.zeros(n, np.bool_)
        ends_run[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        symbol[ends_run] = S_LAST
        symbol[ends_run & (points == 0x20)] = S_JOIN
        quotes = np.flatnonzero(points == 0x27)
        if len(quotes):
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            one, two = padded[quotes + 1], padded[quotes + 2]
            same1 = ~first[quotes + 1]
            same2 = same1 & ~first[np.minimum(quotes + 2, n)]
            short = same1 & np.isin(one, [ord(c) for c in SHORT_ENDINGS])
            long = np.zeros(len(quotes), np.bool_)
            for a, b in LONG_ENDINGS:
                long |= same2 & (one == ord(a)) & (two == ord(b))
            symbol[quotes[short]] = S_QUOTE1
            symbol[quotes[long]] = S_QUOTE2
        t = self.transitions
        functions = t.of_symbol[symbol]
        resets = np.flatnonzero(first[:n])
        # A text's first symbol acts on the start state whatever stood before: reset, then symbol, as one function.
        functions[resets] = t.compose[(int(t.of_symbol[S_RESET]) << t.shift) | functions[resets].astype(np.intp)]
        state = t.from_end[t.scan(functions)]
        before = np.empty(n, np.uint8)
        before[0] = AT_END
        before[1:] = state[:-1]
        before[resets] = AT_END
        return at[t.starts[symbol, before]]


class PairMerger:
    """Ranks of byte strings, and the ids of a slice by merging the pair of lowest rank first."""

    NONE = np.int32(1 << 30)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    pairs[(left << 24) | right] = rank
        self.pairs = pairs
        self.levels = []  # hash tables; what finds its place taken goes to the next one
        keys, values, bits = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32), 20
        while len(keys):
            at = self._slot(keys, bits)
            table, rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
            table[at], rank[at] = keys, values
            placed = table[at] == keys
            self.levels.append((bits, table, rank))
            keys, values, bits = keys[~placed], values[~placed], max(8, bits - 1)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)
        return (mixed >> np.uint64(64 - bits)).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 24) | right  # beyond a slice's end stands -1, and so no pair
        shape, key = key.shape, key.ravel()
        all_keys, out, todo = key, np.zeros(0), None
        for bits, table, rank in self.levels:
            at = self._slot(key, bits)
            found = table[at]
            hit = found == key
            if todo is None:
                out = np.where(hit, rank[at], self.NONE)
                todo = np.flatnonzero(~hit & (found >= 0))  # an empty place: no such pair
            else:
                out[todo[hit]] = rank[at[hit]]
                todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
            key = all_keys[todo]
        return out.reshape(shape)

    def short(self, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slices of at most SHORT_SLICE bytes, all together, and how many each has.

        ``data`` has at least SHORT_SLICE bytes behind the last slice's start. Slices of like lengths share a matrix.
        """
        out = np.full((len(lengths), SHORT_SLICE), -1, np.int32)
        counts = np.ones(len(lengths), np.int64)
        low = 0
        for high in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 26, SHORT_SLICE):
            where = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            if not len(where):
                continue
            columns = np.arange(high)
            ids = self.of_byte[data[begin[where, None] + columns]]
            ids[columns >= lengths[where, None]] = -1
            if high > 1:
                self._merge(ids, lengths[where].copy(), where, out, counts)
            else:
                out[where, 0] = ids[:, 0]
        kept = np.arange(SHORT_SLICE) < counts[:, None]
        return out[kept], counts

    def _merge(self, ids: np.ndarray, used: np.ndarray, where: np.ndarray, out: np.ndarray, counts: np.ndarray) -> None:
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        while True:
            width = ids.shape[1]
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(ids)), at]
            done = best == self.NONE
            if done.any():
                out[where[done], :width] = ids[done]
                counts[where[done]] = used[done]
                more = ~done
                ids, rank, used, where, at, best = ids[more], rank[more], used[more], where[more], at[more], best[more]
                if not len(ids):
                    return
            rows = np.arange(len(ids))
            # Put the merged id at its place and move what follows one place to the left.
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            ids[rows, at] = best
            used = used - 1
            if width == 2:
                out[where, 0] = ids[:, 0]
                counts[where] = 1
                return
            columns = np.arange(width - 2)
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), axis=1)
            fix = np.flatnonzero(at > 0)
            rank[fix, at[fix] - 1] = self._rank(ids[fix, at[fix] - 1], ids[fix, at[fix]])
            fix = np.flatnonzero(at < width - 2)
            rank[fix, at[fix]] = self._rank(ids[fix, at[fix]], ids[fix, at[fix] + 1])

    def long(self, word: bytes) -> np.ndarray:
        """Ids of one slice of any length: a heap of pairs over a linked list."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 24) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get((rank << 24) | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if before[i] >= 0 and (r := get((ids[before[i]] << 24) | rank)) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return np.array([x for x in ids if x >= 0], np.int64)


class SliceCache:
    """Ids of short slices seen before; a cache of more than ``limit`` starts anew with the next batch.

    Within a batch the table grows as needed, so a text of any number of distinct slices is encoded.

    Slices of up to 15 bytes are keys of a hash table as they are: two 64-bit words that hold the bytes and the
    length. All slices of a batch are looked up together. Longer ones are keys of a dict, and those over
    SHORT_SLICE bytes are not kept. ``merge`` and ``merge_long`` are as in PairMerger.
    """

    def __init__(self, merge, merge_long, limit: int = 600_000):
        self.merge, self.merge_long, self.limit = merge, merge_long, limit
        self._clear()

    def _clear(self) -> None:
        self.bits = (3 * self.limit).bit_length()
        self.keys = 0
        self.key = np.zeros((1 << self.bits, 2), np.uint64)  # a slice has a length, so no key is (0, 0)
        self.place = np.zeros(1 << self.bits, np.int32)
        self.longer: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.end = np.zeros(1 << 16, np.int64)  # end[i + 1]: where entry i ends in flat
        self.count = 0

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Appends entries; their numbers."""
        n, used = self.count, int(self.end[self.count])
        while n + len(counts) + 1 > len(self.end):
            self.end = np.concatenate([self.end, np.zeros_like(self.end)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.end[n + 1 : n + 1 + len(counts)] = used + np.cumsum(counts)
        self.flat[used : used + len(ids)] = ids
        self.count = n + len(counts)
        return np.arange(n, self.count)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = (key[:, 0] ^ (key[:, 0] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + key[:, 1]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        out = np.full(len(key), -1, np.int64)
        slot, todo, mask = self._slot(key), np.arange(len(key)), (1 << self.bits) - 1
        while len(todo):
            there = self.key[slot]
            hit = (there[:, 0] == key[:, 0]) & (there[:, 1] == key[:, 1])
            out[todo[hit]] = self.place[slot[hit]]
            more = ~hit & (there[:, 1] != 0)
            todo, key, slot = todo[more], key[more], (slot[more] + 1) & mask
        return out

    def _put(self, key: np.ndarray, place: np.ndarray) -> None:
        """Keys that are distinct and not yet there. At least half of the table stays free, so a search ends."""
        self.keys += len(key)
        if 2 * self.keys > 1 << self.bits:
            held = self.key[:, 1] != 0
            key, place = np.concatenate([self.key[held], key]), np.concatenate([self.place[held], place])
            self.bits = (2 * self.keys).bit_length() + 1
            self.key, self.place = np.zeros((1 << self.bits, 2), np.uint64), np.zeros(1 << self.bits, np.int32)
        slot, mask = self._slot(key), (1 << self.bits) - 1
        while len(key):
            free = self.key[slot, 1] == 0
            self.place[slot[free]] = place[free]
            self.key[slot[free]] = key[free]
            there = self.key[slot]
            own = (there[:, 0] == key[:, 0]) & (there[:, 1] == key[:, 1])  # of several for one place, the last is there
            key, place, slot = key[~own], place[~own], (slot[~own] + 1) & mask

    def encode(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices of ``data`` behind each other, and how many ids each slice has."""
        if self.count > self.limit:
            self._clear()
        size = len(data)
        padded = np.frombuffer(data + bytes(SHORT_SLICE + 8), np.uint8)
        ends = np.append(starts[1:], size)
        lengths = ends - starts
        index = np.full(len(starts), -1, np.int64)
        small = np.flatnonzero(lengths <= 15)
        if len(small):
            words = np.ndarray((size + SHORT_SLICE,), "<u8", padded, strides=(1,))
            at, n = starts[small], lengths[small]
            key = np.empty((len(small), 2), np.uint64)
            key[:, 0] = words[at] & self.MASKS[np.minimum(n, 8)]
            key[:, 1] = (words[at + 8] & self.MASKS[np.maximum(n - 8, 0)]) | (n.astype(np.uint64) << np.uint64(56))
            found = self._find(key)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                order = missing[np.lexsort((key[missing, 0], key[missing, 1]))]
                ordered = key[order]
                new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
                first = order[new]
                entries = self._add(*self.merge(padded, at[first], n[first]))
                self._put(ordered[new], entries)
                found[order] = entries[np.cumsum(new) - 1]
            index[small] = found
        large = np.flatnonzero(lengths > 15)
        if len(large):
            pieces = [data[a:b] for a, b in zip(starts[large].tolist(), ends[large].tolist())]
            fresh = {p: i for p, i in zip(pieces, large.tolist()) if p not in self.longer}
            medium = [(p, i) for p, i in fresh.items() if len(p) <= SHORT_SLICE]
            if medium:
                rows = np.array([i for _, i in medium])
                self.longer.update(zip([p for p, _ in medium], self._add(*self.merge(padded, starts[rows], lengths[rows])).tolist()))
            passing = {}
            for piece in fresh:
                if len(piece) > SHORT_SLICE:
                    ids = self.merge_long(piece)
                    passing[piece] = int(self._add(ids, np.array([len(ids)]))[0])
            index[large] = [passing[p] if p in passing else self.longer[p] for p in pieces]
        begin, lengths = self.end[index], self.end[index + 1] - self.end[index]
        ids = self.flat[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
        return ids, lengths

    #: The lowest n bytes of a word, for n from 0 to 8.
    MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """Bytes of all ids as one flat array."""

    def __init__(self, ranks: dict[bytes, int]):
        of_id = {i: b for b, i in ranks.items()}
        size = max(of_id, default=-1) + 1
        pieces = [of_id.get(i, b"") for i in range(size)]
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
        """The bytes of the ids, each put at its offset in ``starts``."""
        lengths = self.length[ids]
        out = np.empty(total, np.uint8)
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(starts, lengths) + step] = self.flat[np.repeat(self.begin[ids], lengths) + step]
        return out


def encode_flat(texts: pa.Array, splitter: Pretokenizer, cache: SliceCache) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Ids of all texts behind each other, where each text's ids begin and the last end, the bytes and their ends."""
    data, ends = flat_text(texts)
    starts = splitter.starts(data, ends)
    ids, lengths = cache.encode(data, starts) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    before = np.concatenate([[0], np.cumsum(lengths)])
    return ids, before[np.searchsorted(starts, ends)], data, ends


def own_encoder(path: str) -> tuple[Pretokenizer, SliceCache]:
    """Splitter and cache over our own pair merging by the ranks at ``path``."""

    def make():
        merger = PairMerger(read_ranks(path))
        return worker_cache(("splitter",), Pretokenizer), SliceCache(merger.short, merger.long)

    return worker_cache(("own", path), make)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", starts: str = "starts", ranks: str | None = None) -> DataFrame:
    """Adds ``ids`` (the text's ids) and ``starts`` (byte offset of each id's first byte in the text).

    ``ranks`` is the rank file, readable on every worker. No special tokens.
    """
    fields = [StructField(ids, ArrayType(IntegerType())), StructField(starts, ArrayType(IntegerType()))]
    return df.mapInArrow(_encoding(text, ids, starts, ranks or default_ranks()), with_fields(df, fields))


def decode(df: DataFrame, ids: str = "ids", starts: str = "starts", decoded: str = "decoded", ranks: str | None = None) -> DataFrame:
    """Adds ``decoded``: the bytes of the ids, each at its retained offset. Null ids give no bytes."""
    fields = [StructField(decoded, BinaryType())]
    return df.mapInArrow(_decoding(ids, starts, decoded, ranks or default_ranks()), with_fields(df, fields))


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", ranks: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass: replaces the text by ``ids`` and ``decoded``."""
    path = ranks or default_ranks()
    encoding, decoding = _encoding(text, ids, "starts", path, drop=True), _decoding(ids, "starts", decoded, path, drop=True)
    rest = df.drop(text, "starts")
    fields = [StructField(ids, ArrayType(IntegerType())), StructField(decoded, BinaryType())]
    # An extra column named like the offsets would be replaced by them, so it is not kept.
    return df.drop("starts").mapInArrow(lambda batches: decoding(encoding(batches)), with_fields(rest, fields))


def _encoding(text: str, ids: str, starts: str, path: str, drop: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, cache = own_encoder(path)
        vocabulary = worker_cache(("vocabulary", path), lambda: Vocabulary(read_ranks(path)))
        for whole in batches:
            for batch in slices(whole, text):
                found, begin, _, ends = encode_flat(batch.column(batch.schema.get_field_index(text)), splitter, cache)
                lengths = vocabulary.length[found]
                at = np.cumsum(lengths) - lengths
                at -= np.repeat(ends[:-1], np.diff(begin))  # offsets count from the text's own start
                offsets = pa.array(begin, pa.int32())
                yield append(batch.drop_columns([text]) if drop else batch, {
                    ids: pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                    starts: pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32()))})

    return run


def _decoding(ids: str, starts: str, decoded: str, path: str, drop: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_cache(("vocabulary", path), lambda: Vocabulary(read_ranks(path)))
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                lists, places = (batch.column(batch.schema.get_field_index(c)) for c in (ids, starts))
                found = lists.flatten().to_numpy(zero_copy_only=False)
                at = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(counts)])
                ends = np.concatenate([[0], np.cumsum(vocabulary.length[found])])[begin]
                total = vocabulary.decode(found, at + np.repeat(ends[:-1], counts), int(ends[-1]))
                yield append(batch.drop_columns([starts]) if drop else batch, {decoded: pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(total)]).cast(pa.binary())})

    return run

"""Language-model scoring by logistic context mixing over the bits of words.

A text is its words in lower case (A-Z), each closed by a byte 255, and the end, an empty word. Every bit of a word is
predicted by several hashed-context predictors (the last one to four bytes, which reach over the word's start into the words before, and the
whole word so far).
Their log-odds are combined by weights that gates choose (place in the word and bit; the byte before), learned online, and the
result is refined by an adaptive map from (byte before, first bits, quantised log-odds) to what came true. The score of a text is
the log10 of the product over its bits; bits per byte follow from it.

All statistics come from every training word of the corpus, and no table has a fixed size. The whole-word contexts, of which there are
more than words, stay distributed: the words are sorted in ranges, so that all that share a first part stand side by side, and cut
into blocks; a block counts its own contexts, and those that reach over its edges are completed from what the neighbours
count at theirs; blocks begin at words that a hash chooses. The bytes before a byte are counted as keyed rows, of which there are few, and the cells of those predictors are
sized from the number of distinct contexts found. The gated weights are learned online in lanes of blocks, in the
order of their hashes, and averaged by the bits seen, and then the adaptive map is summed over all words with the
final weights; in both the whole-word counts leave out one
occurrence of the word itself, as it would be in a text not yet seen. After that the model is fixed. From its fourth byte on a word has one score
whatever stands before it, and words are scored once each from there. Its first HEAD bytes depend on the words before: their different contexts, which are few, are counted in
all rows with the bytes before them (Heads), learned from in the same lanes, priced once each, and added up along each text. Words over 1/HEAVY of all tokens, hence at most HEAVY, go to each worker; the others are joined by word,
and none of them is frequent enough to make a hot key.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import CHUNK_BYTES, chunks, collected, crc_mod, cut, drop, lower_ascii

HEAVY = 400_000
#: Cells of the bit counts of one predictor, where nothing is known of the contexts; learn() gives SPARE cells to each distinct one.
CELL_BITS = 17
CELLS = 1 << CELL_BITS
SPARE = 4
WINDOWS, WINDOW_KEYS = 16, 1 << 16
ORDERS = (1, 2, 3, 4, 0)  # 0: the whole word so far
#: Words of a block of sorted words on average; bytes over which a word begins one; blocks that one learner of the weights has, on average.
BLOCK_WORDS, LONG_WORD, LANE_BLOCKS = 4_000, 1_000, 16
PLACES, END_BYTE = 16, 255
HEADS = 100_000  # different first bytes that are learned from at once, at most about so many
RATE = 0.02  # of the mean gradient of a gate
#: Bytes of text whose words a task counts before it passes them on, and bytes of words that are worked on at once.
COUNTED, BYTES = 8_000_000, 1_500
STEPS = 33
#: Bytes of a word whose contexts reach over its start: at a later place the longest, of four bytes, holds the word's bytes and the end before it, which is always the same.
HEAD = 3


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case; bytes.split() splits at the six white-space characters that end a word."""
    return lower_ascii((text or "").encode()).split()


def _before(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Row k: the byte k places back, 0 before the word. Of words in texts this serves from place HEAD on, where no context reaches over the word's end before; see Heads."""
    before = np.zeros((5, len(raw)), np.uint32)
    for k in range(1, 5):
        before[k, k:] = np.where(place[k:] >= k, raw[:-k], 0) if k < len(raw) else 0
    return before


def _flat(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """All bytes of closed words, the word of each, its place in the word, and where each word starts."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(data)), sizes)
    return raw, word, np.arange(len(raw)) - first[word], first


def _hashed(order: int, before: np.ndarray) -> np.ndarray:
    h = np.full(before.shape[1], 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
    for k in range(order, 0, -1):
        h = (h ^ before[k]) * np.uint32(16777619)
    return h ^ (h >> np.uint32(15))


def _nodes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of each byte and the bits before each as a node, in one row of eight for each byte, so that nothing is gathered twice."""
    step = np.arange(8, dtype=np.uint32)
    return (raw[:, None] >> (7 - step)) & 1, (np.uint32(1) << step) | (raw[:, None] >> (8 - step))


def _cells(h: np.ndarray, node: np.ndarray, width: int) -> np.ndarray:
    return (((h[:, None] + node * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - width)).ravel()


@dataclass
class Read:
    """All bytes of closed words in one row, with the hashed contexts of the first predictors, and what is new in each word."""

    raw: np.ndarray
    word: np.ndarray
    place: np.ndarray
    before: np.ndarray
    hashes: list[np.ndarray]
    fresh: np.ndarray
    source: np.ndarray
    start: int = 0

    @classmethod
    def of(cls, data: list[bytes], predictors: int, shared: np.ndarray | None = None, start: int = 0) -> Read:
        """shared: how many first bits each word has in common with the one before it, see shared_bits(); else nothing is held to be.
        start: the first place in a word that is predicted; those before are left to Heads.

        fresh are the places of bytes that the word before does not begin with; source has for each byte its own place, or else
        that of the fresh byte which it repeats. What is predicted of a bit follows from the bits before it in its word, so it is the same at both.
        """
        raw, word, place, first = _flat(data)
        before, hashes = _before(raw, place), []
        for order in ORDERS[:predictors]:
            if order:
                hashes.append(_hashed(order, before))
            else:
                mixed = (raw.astype(np.uint64) + np.uint64(1)) * _powers(place)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
                h = ((total[:-1] - total[first[word]]) * np.uint64(11400714819323198485) >> np.uint64(32)).astype(np.uint32)
                hashes.append(h ^ (h >> np.uint32(15)))
        at = np.arange(len(raw))
        if shared is None or not len(shared):
            return cls(raw, word, place, before[1], hashes, at[place >= start], at, start)
        new = place >= np.concatenate([[0], shared // 8])[word]
        order = np.argsort(place, kind="stable")  # all first bytes, all second bytes, ...: the last new one is the one repeated
        source = np.empty(len(raw), np.int64)
        source[order] = order[np.maximum.accumulate(np.where(new[order], at, 0))]
        return cls(raw, word, place, before[1], hashes, np.flatnonzero(new & (place >= start)), source, start)

    def bits(self, some: np.ndarray | slice, widths: list[int], level: np.ndarray | int = 0) -> tuple[np.ndarray, ...]:
        """For each bit of some bytes: its word, the cells of each predictor, the two gates, the map's row, and the bit."""
        raw, place, before = self.raw[some], np.minimum(self.place[some], PLACES - 1), self.before[some]
        bit, node = _nodes(raw)
        cells = np.empty((len(widths), 8 * len(raw)), np.uint32)
        for k, width in enumerate(widths):
            cells[k] = _cells(self.hashes[k][some], node, width)
        one = (place[:, None] * 8 + np.arange(8)).ravel() + level * (PLACES * 8)
        row = ((before >> 2)[:, None] * 16 + np.minimum(node, 15)).astype(np.int64).ravel()
        return np.repeat(self.word[some], 8), cells, one, np.repeat(before.astype(np.int64), 8), row, bit.astype(np.float64).ravel()

    def whole(self, some: np.ndarray, totals: np.ndarray, own: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The log-odds of the whole-word predictor at each bit of some bytes, and how often (a level) the context was seen, own of each word left out.

        totals: see context_counts(). A word has one count more than bits.
        """
        counts = totals[(8 * some + self.word[some])[:, None] + np.arange(9)] - own
        seen, taken = counts[:, :-1], counts[:, 1:]
        bit = _nodes(self.raw[some])[0] > 0
        return _log_odds(np.where(bit, taken, seen - taken), np.where(bit, seen - taken, taken)).ravel(), ((seen > 0).astype(np.int64) + (seen >= OFTEN)).ravel()


def _bits(words: list[bytes], widths: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """See Read.bits(), of all bytes.

    widths: the bits of a cell's number, of the first predictors; those that widths leaves out get no cells.
    """
    widths = widths or [CELL_BITS] * len(ORDERS)
    return Read.of([w + b"\xff" for w in words], len(widths)).bits(slice(None), widths)


def _powers(place: np.ndarray) -> np.ndarray:
    top = int(place.max()) + 1 if len(place) else 1
    steps = np.cumprod(np.concatenate([[1], np.full(top - 1, 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64), dtype=np.uint64)
    return steps[place]


#: The first gate also tells whether the whole word so far was never, seldom or often seen.
LEVELS, OFTEN = 3, 4
GATES = PLACES * 8 * LEVELS, 256
ROWS = 64 * 16


@dataclass
class Mixer:
    """stretch: log-odds of each predictor's cells; weights: of each gate; refined: the adaptive map's probabilities.

    widths: the bits of a cell's number in each table of stretch. The log-odds of a predictor without a table come with the words.
    """

    stretch: list[np.ndarray]
    weights: list[np.ndarray]
    refined: np.ndarray | None = None

    @classmethod
    def new(cls, ones: np.ndarray | list[np.ndarray], zeros: np.ndarray | list[np.ndarray]) -> Mixer:
        return cls([_log_odds(a, b) for a, b in zip(ones, zeros)], [np.full((g, len(ORDERS)), 0.35) for g in GATES])

    def __getstate__(self) -> tuple:
        """Of each table the cells that are not 0, and a bit for each cell that tells them: most stand for no context."""
        return [(len(s), np.packbits(s != 0), s[s != 0]) for s in self.stretch], self.weights, self.refined

    def __setstate__(self, state: tuple) -> None:
        packed, self.weights, self.refined = state
        self.stretch = []
        for size, taken, odds in packed:
            self.stretch.append(np.zeros(size, odds.dtype))
            self.stretch[-1][np.unpackbits(taken, count=size).view(bool)] = odds

    @property
    def widths(self) -> list[int]:
        return [len(s).bit_length() - 1 for s in self.stretch]

    def odds(self, bits, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        _, cells, one, two, _, _ = bits
        x = np.empty((len(one), len(self.stretch) + (whole is not None)), np.float32)
        for k, (s, c) in enumerate(zip(self.stretch, cells)):
            x[:, k] = s[c]
        if whole is not None:
            x[:, -1] = whole
        first, second = (w.astype(np.float32) for w in self.weights)
        return x, np.einsum("ij,ij->i", x, first[one] + second[two]).astype(np.float64) / 2

    def learn(self, bits, weight: np.ndarray, whole: np.ndarray | None = None) -> None:
        """One online step for these bits, each with the square root of its word's count."""
        x, z = self.odds(bits, whole)
        _, _, one, two, _, bit = bits
        error = (bit - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * weight
        slopes = x.T * error
        for table, gate in zip(self.weights, (one, two)):
            total = np.bincount(gate, weight, len(table)) + 30
            for k, slope in enumerate(slopes):
                table[:, k] += RATE * np.bincount(gate, slope, len(table)) / total

    def place(self, bits, z: np.ndarray) -> np.ndarray:
        step = np.clip(np.rint((np.clip(z, -8, 8) + 8) * 2), 0, STEPS - 1).astype(np.int64)
        return bits[4].astype(np.int64) * STEPS + step

    def log10(self, words: list[bytes], totals: np.ndarray | None = None, start: int = 0) -> np.ndarray:
        """log10 of each word's probability from place start on, its closing byte included. totals: see context_counts(), of all these words, which differ.

        What a word has in common with the one before it is worked out once, so sorted words cost least.
        """
        data = [w + b"\xff" for w in words]
        return self.prices(Read.of(data, len(self.stretch), shared_bits(data), start), totals, len(words))

    def prices(self, read: Read, totals: np.ndarray | None, words: int) -> np.ndarray:
        price = np.zeros(len(read.raw))
        for some in np.split(read.fresh, range(BYTES, len(read.fresh), BYTES)):
            whole, level = (None, 0) if totals is None else read.whole(some, totals)
            bits = read.bits(some, self.widths, level)
            _, z = self.odds(bits, whole)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            p = np.clip((p + self.refined[self.place(bits, z)]) / 2, 1e-9, 1 - 1e-9)
            price[some] = np.log(np.where(bits[5] > 0, p, 1 - p)).reshape(-1, 8).sum(axis=1)
        return np.bincount(read.word, price[read.source], words) / np.log(10)


def _log_odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log(((ones + 0.4) / (zeros + 0.4)).astype(np.float32))


def stream(words: list[bytes]) -> bytes:
    """A text as its closed words and end, after four bytes that stand for an end before it."""
    return b"".join((b"\0\0\0\xff", b"\xff".join(words), b"\xff\xff" if words else b"\xff"))


def closed_words(streams: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All closed words and ends of streams, and the number of each one's stream; what stands before a stream's first word is an item too, of number -1."""
    data = b"".join(streams)
    last = np.flatnonzero(np.frombuffer(data, np.uint8) == END_BYTE) + 1
    ends = np.cumsum(np.fromiter(map(len, streams), np.int64, len(streams)))
    of = np.searchsorted(ends, last)
    of[np.diff(of, prepend=-1) > 0] = -1
    return pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(np.append(0, last).astype(np.int32)), pa.py_buffer(data)]), of


def head_keys(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of the first HEAD bytes of all closed words and ends of streams: each with the four bytes before it as a key (see grams()), and its stream's number.

    The bytes before reach over the word's start: its end byte before it, then the words before, as far as they go.
    """
    data = b"".join([*streams, b"\0" * 8])
    raw = np.frombuffer(data, np.uint8)[:-8]
    ends = np.cumsum(np.fromiter(map(len, streams), np.int64, len(streams)))
    closed = raw == END_BYTE
    after = closed.copy()
    after[ends - 1] = False  # nothing follows the end of a text
    at, found, of = np.flatnonzero(after) + 1, [], []
    for _ in range(HEAD):
        found.append(at)
        of.append(np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(at, ends), prepend=0)))
        at = at[~closed[at]] + 1
    eight = np.ndarray(len(raw), ">u8", data, strides=(1,))  # the bytes from each place on
    return (eight[np.concatenate(found) - 4].astype(np.uint64) >> np.uint64(24)).astype(np.int64), np.concatenate(of)


def _merged(kept: list[tuple]) -> list[tuple]:
    keys, at = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
    return [(keys, np.bincount(at, np.concatenate([n for _, n in kept]), len(keys)).astype(np.int64))]


def head_counts(counts: DataFrame) -> DataFrame:
    """key (see head_keys()), n (in training rows; 0 of those in others only) of what word_counts() found."""
    return counts.where(IS_HEAD).select(F.conv(F.hex(F.substring("word", 2, 8)), 16, 10).cast("long").alias("key"), "n")


def _mixed(key: np.ndarray, turn: int = 0) -> np.ndarray:
    h = (key.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Heads:
    """The different first HEAD bytes of words with the bytes before them over words: all that predicts them is in the key, so each is learned and priced once.

    n: how often in training rows; counts: of a place's bytes in the word so far, what the first 0..8 bits of the last were seen (whole-word contexts); at: a key's row there.
    """

    key: np.ndarray
    n: np.ndarray
    counts: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, n: np.ndarray) -> Heads:
        order = np.argsort(_mixed(key), kind="stable")
        key, n = key[order], n[order].astype(float)
        place = cls.places(key)
        part, at = np.unique((place << 24) | key & ((1 << 8 * (place + 1)) - 1), return_inverse=True)  # the word so far, its first byte highest
        weight = np.bincount(at, n, len(part))
        counts = np.empty((len(part), 9))
        for s in range(9):
            _, of = np.unique(part >> (8 - s), return_inverse=True)
            counts[:, s] = np.bincount(of, weight)[of]
        return cls(key, n, counts, at.astype(np.int32))

    @staticmethod
    def places(key: np.ndarray) -> np.ndarray:
        return np.where(key >> 8 & 255 == END_BYTE, 0, np.where(key >> 16 & 255 == END_BYTE, 1, 2)).astype(np.int64)

    def block(self, some: np.ndarray) -> tuple[Read, np.ndarray, np.ndarray]:
        """As _seen() gives words: each byte as one item."""
        key, at = self.key[some], np.arange(len(some))
        before = np.stack([(key >> 8 * k & 255).astype(np.uint32) for k in range(max(ORDERS) + 1)])
        read = Read(before[0], at, self.places(key), before[1], [_hashed(o, before) for o in ORDERS if o], at, at)
        return read, self.n[some], self.counts[self.at[some]].ravel()

    def lane(self, lane: int, lanes: int) -> np.ndarray:
        """Training keys of a lane, by their hash."""
        return np.flatnonzero((_mixed(self.key, 7) >> np.uint64(20)) % np.uint64(lanes) == lane) if lanes > 1 else np.arange(len(self.key))


@dataclass
class Priced:
    """The price of each key, found by hash: keys whose slot another one has are in the next table."""

    key: np.ndarray
    price: np.ndarray
    slots: list[np.ndarray]

    @classmethod
    def of(cls, key: np.ndarray, price: np.ndarray) -> Priced:
        slots, left = [], np.arange(len(key), dtype=np.int32)
        while len(left):
            table = np.full(1 << max(4, int(np.ceil(np.log2(len(left) * 4)))), -1, np.int32)
            s = cls.slot(key[left], len(slots), len(table))
            table[s] = left
            slots.append(table)
            left = left[table[s] != left]
        return cls(key, price, slots)

    @staticmethod
    def slot(key: np.ndarray, turn: int, size: int) -> np.ndarray:
        return (_mixed(key, turn) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out, left = np.full(len(key), -1, np.int32), np.arange(len(key))
        for turn, table in enumerate(self.slots):
            some = key[left]
            got = table[self.slot(some, turn, len(table))]
            out[left] = got
            left = left[self.key[got] != some]
        if len(left):
            raise ValueError("a key that was not counted")
        return self.price[out]


#: Rows of word_counts() that are heads: a space, which no word has, and the key.
IS_HEAD = "startswith(word, X'20')"


def word_counts(rows: DataFrame) -> DataFrame:
    """word, n (in training rows), every (in all rows) of rows (text, held_out); the empty word is the end of a text. Heads are counted with them, see IS_HEAD."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("more", pa.int64())])
        streams, kept, found = ([], []), ([], []), []
        size = waiting = 0

        def take() -> None:
            for held, (some, counted) in enumerate(zip(streams, kept)):
                if some:
                    counted.append(np.unique(head_keys(some)[0], return_counts=True))
                    every, of = closed_words(some)
                    found.append((every, np.where(of < 0, 2, held).astype(np.int8)))
                    some.clear()
                    counted[:] = _merged(counted) if len(counted) >= 8 else counted

        def pack() -> pa.RecordBatch:
            every = pa.concat_arrays([words for words, _ in found]).dictionary_encode()
            times = np.bincount(every.indices.to_numpy() * np.int64(3) + np.concatenate([kind for _, kind in found]), minlength=3 * len(every.dictionary)).reshape(-1, 3)
            found.clear()
            some = np.flatnonzero(times[:, :2].any(axis=1))
            words = pc.binary_slice(every.dictionary.take(pa.array(some)), 0, -1)
            return pa.RecordBatch.from_arrays([words, pa.array(times[some, 0]), pa.array(times[some, 1])], schema=shape)

        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out")):
                streams[held.as_py()].append(made := stream(tokens(text.as_py())))
                size += len(made)
                if size > CHUNK_BYTES:
                    take()
                    size, waiting = 0, waiting + size
                if waiting > COUNTED:
                    yield pack()
                    waiting = 0
        take()
        if found:
            yield pack()
        for at, counted in enumerate(kept):
            if counted:
                keys, n = _merged(counted)[0]
                both = (n, np.zeros_like(n))
                yield pa.RecordBatch.from_arrays([pa.array([b" " + k.to_bytes(8, "big") for k in keys.tolist()], pa.binary()), pa.array(both[at]), pa.array(both[1 - at])], schema=shape)

    made = rows.select("text", "held_out").mapInArrow(count, "word binary, n long, more long")
    return made.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") + F.col("more")).alias("every"))


def shared_bits(data: list[bytes]) -> np.ndarray:
    """How many first bits each closed word has in common with the one before it; the first is left out. No closed word begins another."""
    raw, word, place, first = _flat(data)
    sizes = np.diff(np.append(first, len(raw)))
    if len(data) < 2:
        return np.zeros(0, np.int64)
    last = np.maximum(word - 1, 0)
    both = place < sizes[last]
    other = raw[np.where(both, first[last] + place, 0)]
    at = np.minimum.reduceat(np.where(both & (raw != other), place, len(raw)), first)[1:]
    differ = raw[first[1:] + at] ^ raw[first[:-1] + at]
    return 8 * at + 8 - np.ceil(np.log2(differ + 1.0)).astype(np.int64)


def edge(shared: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along the first word: numbers of bits, falling, and how much more is counted by contexts of that many bits or fewer."""
    reach, at = np.unique(-np.minimum.accumulate(shared), return_inverse=True)
    return -reach, np.bincount(at, n[1:], len(reach))


def along(own: float, reach: list[int], more: list[float], bits: int) -> np.ndarray:
    """What a block counts of the first 0..bits bits of the word at its edge."""
    total = np.zeros(bits + 2)
    np.add.at(total, np.minimum(np.asarray(reach, np.int64), bits), np.asarray(more, float))
    return own + np.cumsum(total[::-1])[::-1][: bits + 1]


def context_counts(data: list[bytes], n: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """For each closed word of a sorted block the counts of its first 0, 1, ... bits as contexts, one word after the other.

    before, after: the counts over all blocks of the contexts of 0, 1, ... bits that the neighbouring block shares.
    """
    depths = np.fromiter((8 * len(d) + 1 for d in data), np.int64, len(data))
    base, shared = np.cumsum(depths) - depths, shared_bits(data)
    left = np.concatenate([[-1 if before is None else len(before) - 1], shared])
    right = np.concatenate([shared, [-1 if after is None else len(after) - 1]])
    top, out, some = np.maximum(left, right), np.repeat(n, depths), np.arange(len(data))
    for s in range(int(top.max()) + 1):
        some = some[top[some] >= s]
        new = left[some] < s
        new[0] = True
        heads = np.flatnonzero(new)
        sums = np.add.reduceat(n[some], heads)
        if s <= left[0]:
            sums[0] = before[s]
        if s <= right[-1]:
            sums[-1] = after[s]
        out[base[some] + s] = np.repeat(sums, np.diff(np.append(heads, len(some))))
    return out


BLOCK = "id long, words array<binary>, n array<long>, every array<long>, least binary, most binary, n_least long, n_most long, reach_least array<long>, more_least array<double>, reach_most array<long>, more_most array<double>, inner long"


def _leads(word: bytes) -> bool:
    """Whether a block begins at this word: by its hash, or because it is long."""
    return len(word) > LONG_WORD or xxhash.xxh64_intdigest(word) % BLOCK_WORDS == 0


def blocks(counts: DataFrame) -> DataFrame:
    """The words in blocks of neighbours, sorted with their closing byte, and what is counted along the first and last word of each.

    A block reaches from one leading word to the next. Which words lead follows from the words alone, so the blocks are the same however the
    rows are stored and dealt; one word in BLOCK_WORDS leads, and their list goes to every task.
    """

    def leading(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w + b"\xff" for w in batch.column("word").to_pylist() if _leads(w)], pa.binary())], names=["lead"])

    leads = sorted(r.lead for r in counts.select("word").mapInArrow(leading, "lead binary").toLocalIterator())
    shared = counts.sparkSession.sparkContext.broadcast(leads)

    def number(batches):
        for batch in batches:
            ids = [bisect.bisect_right(shared.value, w + b"\xff") for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(batch.column(c) for c in ("word", "n", "every"))], names=["id", "word", "n", "every"])

    def gather(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("word", "n", "every"))), key=lambda r: r[0] + b"\xff")
        words, n, every = (list(c) for c in zip(*rows))
        data, count = [w + b"\xff" for w in words], np.asarray(n, float)
        near = shared_bits(data)
        ends = [edge(near, count), edge(near[::-1], count[::-1])] if len(near) else [([], [])] * 2
        inner = int(near.min()) if len(near) else 8 * len(data[0])
        row = [key[0].as_py(), words, n, every, data[0], data[-1], n[0], n[-1], *ends[0], *ends[1], inner]
        return pa.table([pa.array([list(v) if isinstance(v, np.ndarray) else v], k) for v, k in zip(row, kinds)], names=names)

    types = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    names, kinds = zip(*((f.split(" ")[0], types[f.split(" ")[1]]) for f in BLOCK.split(", ")))
    numbered = counts.select("word", "n", "every").mapInArrow(number, "id long, word binary, n long, every long")
    return cut(numbered.groupBy("id").applyInArrow(gather, BLOCK))


def edges(rows: list[dict]) -> dict[int, tuple]:
    """For each block's id the counts over all blocks of the contexts that it shares with the block before and the one after."""
    rows = sorted(rows, key=lambda r: r["least"])
    shared = [int(shared_bits([a["most"], b["least"]])[0]) for a, b in zip(rows, rows[1:])]

    def reached(order, side: str, gaps: list[int]) -> list[np.ndarray]:
        """For each gap what the blocks on one side of it count of the contexts that it shares."""
        out: list[np.ndarray] = []
        for i, (r, bits) in enumerate(zip(order, gaps)):
            total = along(r["n_" + side], r["reach_" + side], r["more_" + side], bits)
            if i:
                through = min(bits, r["inner"], gaps[i - 1]) + 1
                total[:through] += out[-1][:through]
            out.append(total)
        return out

    left = reached(rows[:-1], "most", shared)
    right = reached(rows[:0:-1], "least", shared[::-1])[::-1]
    whole = [a + b for a, b in zip(left, right)]
    return {r["id"]: (a, b) for r, a, b in zip(rows, [None, *whole], [*whole, None])}


def _seen(rows: list[dict], known: dict[int, tuple], predictors: int, start: int = 0) -> Iterator[tuple[Read, np.ndarray, np.ndarray]]:
    """Of each block, in an order by hash: its training words, how often they occur, and their context counts."""
    for row in sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(str(r["id"])), r["id"])):
        data, n = [w + b"\xff" for w in row["words"]], np.array(row["n"], float)
        totals, seen = context_counts(data, n, *known[row["id"]]), n > 0
        if seen.any():
            few = [d for d, s in zip(data, seen) if s]
            yield Read.of(few, predictors, shared_bits(few), start), n[seen], totals[np.repeat(seen, [8 * len(d) + 1 for d in data])]


def _summed(made: DataFrame, size: int, known, add, lanes: int, heads) -> np.ndarray:
    """A vector of size sums that add(block, vector, state) fills, over all training words: in each lane of blocks first, then by place. state is the lane's own.

    Lanes are dealt by the hash of a block's id, so neither they nor the order in them depend on partitions. Every lane has its heads too, a part
    of them before each block.
    """

    def fill(key, table):
        total, state = np.zeros(size), {}
        rows = [r for r in table.to_pylist() if r["words"] is not None]
        mine = heads.value.lane(key[0].as_py(), lanes)
        mine = mine[heads.value.n[mine] > 0]
        parts = iter(np.array_split(mine, max(1, len(rows), len(mine) // HEADS)))
        for block in _seen(rows, known.value, len(ORDERS) - 1, HEAD):
            if len(part := next(parts)):
                add(heads.value.block(part), total, state)
            add(block, total, state)
        for part in parts:
            if len(part):
                add(heads.value.block(part), total, state)
        at = np.nonzero(total)[0]
        return pa.table({"at": pa.array(at.astype(np.int32)), "v": pa.array(total[at])})

    # rounded in each lane, so that the order of the sums does not matter
    lane = F.pmod(F.xxhash64("id"), F.lit(lanes)).alias("lane")
    every = made.sparkSession.range(lanes).select("id", (-1 - F.col("id")).alias("block"), F.lit(None).cast("array<binary>"), F.lit(None).cast("array<long>"))
    rows = made.select(lane.cast("long"), "id", "words", "n").union(every).groupBy("lane").applyInArrow(fill, "at int, v double").groupBy("at").agg(F.sum(F.round(F.col("v") * 1024).cast("long")).alias("v"))
    out = np.zeros(size)
    table = collected(rows)  # size rows at most
    out[table["at"].to_numpy()] = table["v"].to_numpy() / 1024
    return out


def grams(made: DataFrame, start: int = 0) -> DataFrame:
    """key, n of all training words from place start on: a byte (lowest) and those before it in its word, as many as any predictor looks back, 0 before the word."""

    def count(batches):
        kept: list[tuple] = []

        def merged():
            keys, at = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in kept]), len(keys))

        for batch in batches:
            for words, n in zip(batch.column("words"), batch.column("n")):
                raw, word, place, _ = _flat([w + b"\xff" for w in words.as_py()])
                before, key = _before(raw, place), raw.astype(np.int64)
                for k in range(1, max(ORDERS) + 1):
                    key += before[k].astype(np.int64) << 8 * k
                late = place >= start
                kept.append((key[late], np.array(n.as_py(), float)[word][late]))
                kept = [merged()] if len(kept) >= 16 else kept
        if kept:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["key", "n"])

    return made.select("words", "n").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def tables(key: np.ndarray, n: np.ndarray) -> Mixer:
    """A mixer whose tables have SPARE cells or more for each distinct context of the keys, and their counts."""
    stretch = []
    for order in ORDERS:
        if order:
            part, at = np.unique(key & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            weight = np.bincount(at, n, len(part))
            distinct = sum(int(np.count_nonzero(np.diff(part >> k))) + 1 for k in range(1, 9)) if len(part) else 0
            stretch.append(_table(order, part, weight, max(8, int(np.ceil(np.log2(max(1, distinct) * SPARE))))))
    return Mixer(stretch, [np.full((g, len(ORDERS)), 0.35) for g in GATES])


def _table(order: int, part: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """The log-odds of a predictor's cells. Ones and zeros are counted for one of WINDOWS parts of the cells after the other, as they take four times the memory of the log-odds."""
    cells, size = np.empty(8 * len(part), np.uint32), (1 << width) // WINDOWS
    for i in range(0, len(part), WINDOW_KEYS):
        some = part[i : i + WINDOW_KEYS]
        before = np.stack([(some >> 8 * k & 255).astype(np.uint32) for k in range(order + 1)])
        cells[8 * i : 8 * (i + len(some))] = _cells(_hashed(order, before), _nodes(before[0])[1], width)
    out = np.zeros(1 << width, np.float32)
    for start in range(0, 1 << width, size):
        here = np.flatnonzero((cells >= start) & (cells < start + size))
        bit = part[here >> 3] >> (7 - (here & 7)) & 1
        both = np.bincount((cells[here].astype(np.int64) - start) * 2 + bit, weight[here >> 3], 2 * size)
        out[start : start + size] = _log_odds(both[1::2], both[::2])
    return out


@dataclass
class Learned:
    """Broadcast: the tables, and the weights and map that were learned over them. The tables are large, so they are sent once, before learning."""

    tables: Broadcast
    rest: Broadcast

    @property
    def value(self) -> Mixer:
        return Mixer(self.tables.value.stretch, *self.rest.value)

    def destroy(self) -> None:
        self.tables.destroy()
        self.rest.destroy()


def learn(made: DataFrame, known, lanes: int, heads) -> Learned:
    """The model, from all words of blocks with n over 0 and the heads; known: the broadcast edges of the blocks; heads: the broadcast Heads."""
    context = made.sparkSession.sparkContext
    found, seen = collected(grams(made, HEAD)), heads.value.n > 0
    start = tables(np.concatenate([found["key"].to_numpy(), heads.value.key[seen]]), np.concatenate([found["n"].to_numpy().astype(float), heads.value.n[seen]]))
    shared = context.broadcast(start)
    sizes = [g * len(ORDERS) for g in GATES]

    def add_weights(block, total, state):
        read, n, totals = block
        mixer = state.setdefault("mixer", Mixer(shared.value.stretch, [w.copy() for w in shared.value.weights]))
        parts = max(1, -(-len(read.raw) // BYTES))
        order = np.argsort(read.word % parts, kind="stable")
        for some in np.split(order, np.cumsum(np.bincount(read.word % parts, minlength=parts))[:-1]):  # words spread over the block
            some = some[read.place[some] >= read.start]
            if len(some):
                whole, level = read.whole(some, totals, 1)
                bits = read.bits(some, mixer.widths, level)
                weight = np.sqrt(n)[bits[0]]
                mixer.learn(bits, weight, whole)
                total[-1] += float(weight.sum())
        total[:-1] = np.concatenate([w.ravel() for w in mixer.weights]) * total[-1]

    mean = _summed(made, sum(sizes) + 1, known, add_weights, lanes, heads)
    final = start.weights
    if mean[-1]:
        final = [w.reshape(-1, len(ORDERS)) for w in np.split(mean[:-1] / mean[-1], [sizes[0]])]
    weights = context.broadcast(final)

    def add_map(block, total, state):
        read, n, totals = block
        mixer = Mixer(shared.value.stretch, weights.value)
        times, found = np.bincount(read.source, n[read.word], len(read.raw)), []  # of all words that share the byte
        for some in np.split(read.fresh, range(BYTES, len(read.fresh), BYTES)):
            whole, level = read.whole(some, totals, 1)
            bits = read.bits(some, mixer.widths, level)
            found.append(mixer.place(bits, mixer.odds(bits, whole)[1]) + (bits[5] * (ROWS * STEPS)).astype(np.int64))
        total += np.bincount(np.concatenate(found), np.repeat(times[read.fresh], 8), len(total))

    hits = _summed(made, 2 * ROWS * STEPS, known, add_map, lanes, heads)
    centre = 1 / (1 + np.exp(-(np.arange(STEPS) / 2 - 8)))
    prior = np.tile(centre, ROWS)
    refined = (hits[ROWS * STEPS :] + 4 * prior) / (hits[ROWS * STEPS :] + hits[: ROWS * STEPS] + 4)
    return Learned(shared, context.broadcast((final, refined)))


def price_heads(spark, model, heads) -> Priced:
    """log10 of the probability of each head, all of them; model, heads: broadcast."""
    size = len(heads.value.key)
    parts = -(-size // HEADS)

    def price(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                some = np.arange(i * HEADS, min(size, (i + 1) * HEADS))
                read, _, totals = heads.value.block(some)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(model.value.prices(read, totals, len(some)))], names=["at", "price"])

    if not size:
        return Priced.of(heads.value.key, np.zeros(0))
    got = spark.range(0, parts, 1, parts).mapInArrow(price, "at long, price double").toArrow()
    out = np.empty(size)
    out[got["at"].to_numpy()] = got["price"].to_numpy()
    return Priced.of(heads.value.key, out)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of each row.

    Learns from rows whose crc32(doc_id) mod 5 is not 1. A null text is empty: its end alone. Rows that repeat an id and a text
    have the same values each; the values depend on the rows alone and not on how they are stored. A null id is learned from. Texts of any length are
    scored whole. bits_per_byte is over the bytes of the words and their ends. Other columns are not read, so their names do not matter. Empty tables give no rows.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(crc_mod(id_col, 5) == 1, F.lit(False)).alias("held_out"))
    counted = cut(word_counts(rows))
    counts = counted.where(f"not {IS_HEAD}")
    sums = counts.agg(F.sum("n").alias("n"), F.sum("every").alias("every"), F.sum((F.col("n") > 0).cast("long")).alias("v")).first()
    total, distinct, every = sums.n or 0, sums.v or 0, sums.every or 0
    made = blocks(counts)
    sides = edges(made.drop("words", "n", "every").toArrow().to_pylist())  # a row for BLOCK_WORDS words
    known = context.broadcast(sides)
    found = head_counts(counted).toArrow()
    heads = context.broadcast(Heads.of(found["key"].to_numpy(), found["n"].to_numpy()))
    drop(counted)
    model = learn(made, known, max(1, len(sides) // LANE_BLOCKS), heads)
    first = context.broadcast(price_heads(docs.sparkSession, model, heads))

    def priced(batches):
        mixer = model.value
        for batch in batches:
            for i in range(batch.num_rows):
                words, n = batch.column("words")[i].as_py(), np.array(batch.column("n")[i].as_py(), float)
                totals = context_counts([w + b"\xff" for w in words], n, *known.value[batch.column("id")[i].as_py()])
                base = np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
                price = mixer.log10(words, totals, HEAD)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), batch.column("every")[i].values, pa.array(n > 0), pa.array(base), pa.array(price)], names=["word", "every", "known", "base", "model"])

    prices = cut(made.select("id", "words", "n", "every").mapInArrow(priced, "word binary, every long, known boolean, base double, model double"))
    drop(made)
    for sent in (known, heads, model):  # all that follows is in prices and first
        sent.destroy()
    often = prices.where(F.col("every") * heavy >= every).toArrow()  # heavy rows at most
    table = context.broadcast((often["word"].combine_chunks(), *(often[c].to_numpy().astype(float) for c in ("known", "base", "model"))))
    schema = "doc_id long, copy long, held_out boolean, word binary, heads int, n_tokens long, n_known long, base double, model double, n_bytes long"
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def split(batches):
        (numbered, *often), starts = table.value, first.value
        for batch in batches:
            ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out")
            texts = batch.column("text").to_pylist()
            for part in chunks([len(t or "") for t in texts]):
                size = part.stop - part.start
                copies = [xxhash.xxh64_intdigest((t or "").encode()) - (1 << 63) for t in texts[part]]
                streams = [stream(tokens(t)) for t in texts[part]]
                every, of = closed_words(streams)
                every, own = every.dictionary_encode(), of >= 0
                words = pc.binary_slice(every.dictionary, 0, -1)
                number = pc.fill_null(pc.index_in(words, numbered), -1).to_numpy()
                pairs, seen, times = np.unique(of[own] * len(words) + every.indices.to_numpy()[own], return_index=True, return_counts=True)
                order = np.argsort(seen)  # a text's different words as they first stand in it, so that sums have one order however the rows are stored
                (row, word), times = np.divmod(pairs[order], len(words)), times[order]
                number = number[word]
                rare = number < 0  # words that are joined
                known, base, model = (np.bincount(row[~rare], times[~rare] * price[number[~rare]], size) for price in often)
                keys, head_of = head_keys(streams)
                model = model + np.bincount(head_of, starts(keys), size)  # what the first bytes of a text's words cost
                left = np.bincount(row[~rare], times[~rare], size)
                names_of = [b" %d %d" % (doc_id or 0, copy) for doc_id, copy in zip(ids[part], copies)]  # no word has a space
                columns = [ids[part], copies, held.slice(part.start, size), names_of, np.ones(size), left, known, base, model, [len(s) - 4 for s in streams]]
                whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) if isinstance(c, list) else pa.array(c).cast(k) for c, k in zip(columns, kinds)], names=names)
                yield whole
                at, zero = pa.array(row[rare]), np.zeros(int(rare.sum()))
                rest = [whole.column(i).take(at) for i in range(3)] + [words.take(pa.array(word[rare])), pa.array(zero.astype(np.int32)), pa.array(times[rare].astype(np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero), pa.array(zero.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(rest, names=names)

    # the only key is one long, so that rows are sorted without comparing words; bounds in place of equality, which would be a second key
    hashed = F.xxhash64("word").alias("hash")
    rare = prices.where(F.col("every") * heavy < every).select(hashed, F.col("word").alias("w"), F.col("known").alias("k"), F.col("base").alias("b"), F.col("model").alias("m"))
    found = rows.mapInArrow(split, schema).withColumn("hash", F.xxhash64("word"))
    joined = found.join(rare, (found["hash"] == rare["hash"]) & (F.col("word") >= F.col("w")) & (F.col("word") <= F.col("w")), "left").drop("w", "hash")
    n, is_word = F.col("n_tokens"), F.col("m").isNotNull()
    done = joined.groupBy("doc_id", "copy", "held_out").agg(
        F.sum("heads").alias("heads"), F.sum(n).alias("n_tokens"), F.sum(F.when(is_word, n * F.col("k").cast("long")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(is_word, n * F.col("b")).otherwise(F.col("base"))).alias("base"), F.sum(F.when(is_word, n * F.col("m")).otherwise(F.col("model"))).alias("model"), F.sum("n_bytes").alias("n_bytes"),
    )
    each = done.withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("heads").cast("int"))))
    h = F.col("heads")
    return each.select(
        "doc_id", "held_out", (F.col("n_tokens") / h).cast("long").alias("n_tokens"), (F.col("n_known") / h).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        F.round(F.col("base") / h, 6).alias("base_score"), F.round(F.col("model") / h, 6).alias("score"), (F.col("n_bytes") / h).cast("long").alias("n_bytes"),
        F.round(-F.col("model") / F.lit(0.30102999566398120) / F.col("n_bytes"), 6).alias("bits_per_byte"),
    )

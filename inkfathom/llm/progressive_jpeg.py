"""Media columns: progressive JPEG, written and read in numpy.

The reader accumulates the scans of spectral selection and successive approximation into arrays of coefficients,
inverse-transforms them with one matrix product, repeats chroma samples up to full resolution and gives RGB tensors. It reads
many images at once: restart intervals are lanes that are decoded in step, one Huffman symbol of every lane at a time.
An image without restart markers is one lane.

The format's unit here is the quantised coefficient: a payload's bytes, less 128, are the coefficients of three
components sampled 3x2, 1x1 and 1x2, nine blocks of 64 or 576 bytes to each 24x16 pixels, in columns of one such unit and at most
MOST_UNITS high; a longer payload goes to several images, one after the other. The restart interval is one unit.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import map_texts

UNIT = 576
MOST_UNITS = 4000
#: Payload bytes that a worker turns at once.
BATCH = 600_000

#: Fixed values of the format: the order of coefficients in a scan.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

_k = np.arange(8)
_C = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k == 0, np.sqrt(0.125), 0.5)[:, None]
#: From the 64 coefficients of a block (rows of frequencies) to its 64 samples.
INVERSE = np.einsum("ux,vy->uvxy", _C, _C).reshape(64, 64).astype(np.float32)


@dataclass(frozen=True)
class Component:
    ident: int
    h: int
    v: int


@dataclass(frozen=True)
class Scan:
    """components by index; ss, se: band; ah, al: bit planes before and after."""

    components: tuple[int, ...]
    ss: int
    se: int
    ah: int
    al: int


COMPONENTS = (Component(1, 3, 2), Component(2, 1, 1), Component(3, 1, 2))
#: DC less its last bit, the low band of luma likewise, the rest in full, then the last bits.
SCRIPT = (
    Scan((0, 1, 2), 0, 0, 0, 1), Scan((0,), 1, 5, 0, 1), Scan((0,), 6, 63, 0, 0), Scan((1,), 1, 63, 0, 0), Scan((2,), 1, 63, 0, 0),
    Scan((0,), 1, 5, 1, 0), Scan((0, 1, 2), 0, 0, 1, 0),
)


def code_table(symbols: list[int], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes and their lengths by symbol."""
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, last = 0, lengths[0]
    for s, n in zip(symbols, lengths):
        code <<= n - last
        codes[s], sizes[s], last = code, n, n
        code += 1
    return codes, sizes


#: Symbols by likelihood in text, in lengths that leave the code of ones free: bits of a difference of DC, and runs and bits of AC.
DC_SYMBOLS = [5, 6, 4, 3, 0, 1, 2, 7, 8, 9, 10, 11]
DC_LENGTHS = [2, 2, 3, 3, 4, 5, 5, 5, 7, 7, 7, 7]
_FIRST = [0x05, 0x04, 0x07, 0x06, 0x03, 0x00, 0x01, 0x02, 0x08]
_REST = [s for s in range(256) if s not in _FIRST and (s & 15 <= 10)]
SYMBOLS = _FIRST + _REST
LENGTHS = [2, 2, 3, 3, 4, 5, 6, 6, 6] + [14] * len(_REST)
DC_CODES, DC_SIZES = code_table(DC_SYMBOLS, DC_LENGTHS)
CODES, SIZES = code_table(SYMBOLS, LENGTHS)
assert sum(2.0**-n for n in LENGTHS) < 1 and sum(2.0**-n for n in DC_LENGTHS) < 1


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of a magnitude."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _packed(lane: np.ndarray, lanes: int, value: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """The bits of each lane in order, as bytes filled up with ones and with a zero after each 255. At most 32 bits an item."""
    keep = bits > 0
    lane, value, bits = lane[keep], value[keep], bits[keep]
    total = np.bincount(lane, bits, lanes).astype(np.int64)
    size = (total + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(size)])
    ends = np.cumsum(bits)
    within = ends - bits - (np.cumsum(total) - total)[lane]
    at = begin[lane] * 8 + within
    word = value.astype(np.uint64) << (np.uint64(40) - (at & 7).astype(np.uint64) - bits.astype(np.uint64))
    out = np.zeros(int(begin[-1]) + 5, np.int64)
    byte, reach = at >> 3, (at & 7) + bits
    for k in range(5):
        if k:
            some = np.flatnonzero(reach > 8 * k)
            word, byte, reach = word[some], byte[some], reach[some]
        out += np.bincount(byte + k, (word >> np.uint64(32 - 8 * k)) & np.uint64(255), len(out)).astype(np.int64)
    pad = size * 8 - total
    full = size > 0
    out[begin[1:][full] - 1] += (1 << pad[full]) - 1
    data = out[:-5].astype(np.uint8).tobytes()
    edges = begin.tolist()
    return [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(edges, edges[1:])]


def _scan_bits(coefficients: np.ndarray, order: np.ndarray, scan: Scan, per_lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lane, value and bits of each item of a scan over coefficients[order], per_lane blocks to a lane and component."""
    c = coefficients[order]
    n = len(c)
    lane = np.arange(n) // per_lane
    if scan.ss == 0:
        dc = c[:, 0] >> scan.al
        if scan.ah:
            return lane, dc & 1, np.ones(n, np.int64)
        kind = _dc_kinds(scan, per_lane)[np.arange(n) % per_lane]
        diff = dc.copy()
        for k in np.unique(kind):
            own = np.nonzero(kind == k)[0]
            same = lane[own][1:] == lane[own][:-1]
            diff[own[1:]] -= np.where(same, dc[own[:-1]], 0)
        s = _size(diff)
        extra = np.where(diff < 0, diff + (1 << s) - 1, diff)
        return lane, (DC_CODES[s] << s) | extra, DC_SIZES[s] + s
    band = c[:, scan.ss : scan.se + 1]
    width = band.shape[1]
    seen = np.abs(band) >> scan.al
    new = (seen == 1) if scan.ah else seen > 0  # coded with a symbol
    old = (seen > 1) if scan.ah else np.zeros_like(new)  # with a correction bit
    block, place = np.nonzero(new)
    zeros = np.cumsum(~new & ~old, axis=1, dtype=np.int16)
    before = zeros[block, place].astype(np.int64)
    first = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
    run = before - np.where(first, 0, np.concatenate([[0], before[:-1]]) if len(block) else 0)
    value = band[block, place]
    s = _size(seen[block, place])
    extra = np.where(value < 0, (1 << s) - 1 - seen[block, place], seen[block, place])
    if scan.ah:
        extra = (value > 0).astype(np.int64)
    last = np.full(n, -1)
    last[block] = place  # the last one of each block stays
    ends = np.nonzero(last < width - 1)[0]  # blocks that close with an end symbol
    # items: (block, key, order) so that corrections follow the symbol that passes them
    long = run >> 4
    if long.any() and scan.ah:
        raise ValueError("runs over 15 are not written in a refining scan")
    z = np.repeat(np.arange(len(block)), long)
    items = [
        (np.repeat(block, long), place[z] * 4, np.full(len(z), CODES[0xF0]), np.full(len(z), SIZES[0xF0])),
        (block, place * 4 + 1, (CODES[((run & 15) << 4) | s] << s) | extra, SIZES[((run & 15) << 4) | s] + s),
        (ends, (last[ends] + 1) * 4 - 1, np.full(len(ends), CODES[0]), np.full(len(ends), SIZES[0])),
    ]
    if scan.ah:
        cb, cp = np.nonzero(old)
        # after the symbol that leads past it: the next new coefficient of its block, or the end symbol
        ahead = np.where(new, np.arange(width), width + 9)
        ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1][cb, cp]
        key = np.where(ahead < width, ahead * 4 + 2, (last[cb] + 1) * 4 - 1)
        items.append((cb, key, seen[cb, cp] & 1, np.ones(len(cb), np.int64)))
    b, key, v, bits = (np.concatenate(x) for x in zip(*items))
    if len(scan.components) == 1 and not scan.ah and not len(z) and not len(ends):
        at = np.arange(len(b))
    else:
        at = np.argsort(b * (width * 4 + 8) + key, kind="stable")
    return lane[b[at]], v[at], bits[at]


def _dc_kinds(scan: Scan, per_lane: int) -> np.ndarray:
    kinds = np.concatenate([np.full(COMPONENTS[i].h * COMPONENTS[i].v, i) for i in scan.components])
    return np.tile(kinds, per_lane // len(kinds))


def _segment(marker: int, body: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(units: int) -> bytes:
    frame = b"\x08" + (16 * units).to_bytes(2, "big") + (24).to_bytes(2, "big") + bytes([3]) + b"".join(bytes([c.ident, c.h * 16 + c.v, 0]) for c in COMPONENTS)
    return b"\xff\xd8" + _segment(0xDB, b"\x00" + bytes([1] * 64)) + _segment(0xC2, frame) + _segment(0xC4, _TABLES)


_TABLES = b"".join(bytes([k]) + bytes(lengths.count(n) for n in range(1, 17)) + bytes(symbols) for k, symbols, lengths in ((0x00, DC_SYMBOLS, DC_LENGTHS), (0x10, SYMBOLS, LENGTHS)))


#: Blocks of a unit: component and number of each in the order of the payload.
_OWN = [np.arange(6), np.array([6]), np.array([7, 8])]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload, a positive multiple of UNIT bytes: one or more progressive JPEGs."""
    parts = [(i, p[a : a + UNIT * MOST_UNITS]) for i, p in enumerate(payloads) for a in range(0, len(p), UNIT * MOST_UNITS)]
    units = [len(p) // UNIT for _, p in parts]
    lanes = sum(units)
    c = np.frombuffer(b"".join(p for _, p in parts), np.uint8).astype(np.int16).reshape(lanes * 9, 64) - np.int16(128)
    edges = np.concatenate([[0], np.cumsum(units)]).tolist()
    images = [[_head(u)] for u in units]
    for scan in SCRIPT:
        own = np.concatenate([_OWN[k] for k in scan.components])
        order = (np.arange(lanes)[:, None] * 9 + own).ravel()
        lane, value, bits = _scan_bits(c, order, scan, len(own))
        data = _packed(lane, lanes, value, bits)
        dri = _segment(0xDD, (len(own) if len(scan.components) == 1 else 1).to_bytes(2, "big"))
        head = dri + _segment(0xDA, bytes([len(scan.components)]) + b"".join(bytes([COMPONENTS[k].ident, 0]) for k in scan.components) + bytes([scan.ss, scan.se, scan.ah * 16 + scan.al]))
        for image, a, b in zip(images, edges, edges[1:]):
            image.append(head)
            for k in range(a, b):
                image.append(data[k])
                if k + 1 < b:
                    image.append(_RESTART[(k - a) & 7])
    done: list[list[bytes]] = [[] for _ in payloads]
    for (i, _), image in zip(parts, images):
        done[i] += [*image, b"\xff\xd9"]
    return [b"".join(d) for d in done]


_RESTART = [bytes([255, 0xD0 + k]) for k in range(8)]
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


@dataclass
class Image:
    """What the markers say; lanes: of each scan its Scan, restart interval, Huffman tables and intervals."""

    width: int = 0
    height: int = 0
    components: tuple[Component, ...] = ()
    quant: dict = field(default_factory=dict)
    quant_of: list = field(default_factory=list)
    scans: list = field(default_factory=list)

    def grid(self, k: int) -> tuple[int, int, int, int]:
        """Of a component: rows and columns of blocks as stored, and as a scan of it alone has."""
        c = self.components[k]
        h, v = max(x.h for x in self.components), max(x.v for x in self.components)
        down, across = -(-self.height // (8 * v)), -(-self.width // (8 * h))
        return down * c.v, across * c.h, -(-(-(-self.height * c.v // v)) // 8), -(-(-(-self.width * c.h // h)) // 8)


def _lookup(table: bytes) -> np.ndarray:
    """From the next 16 bits to 32 * symbol + length; 0 where no code fits."""
    out = np.zeros(65536, np.int32)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = table[at] * 32 + n
            code, at = code + 1, at + 1
        code <<= 1
    return out


_lookups: dict[bytes, np.ndarray] = {}


@lru_cache(256)
def _quantisers(body: bytes) -> dict[int, np.ndarray]:
    out, k = {}, 0
    while k < len(body):
        size = 64 * (1 + (body[k] >> 4))
        out[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + size], ">u2" if size > 64 else "u1").astype(np.float32)
        k += 1 + size
    return out


@lru_cache(256)
def _code_tables(body: bytes) -> dict[int, bytes]:
    out, k = {}, 0
    while k < len(body):
        size = 17 + sum(body[k + 1 : k + 17])
        out[body[k]] = body[k + 1 : k + size]
        k += size
    return out


def parse(data: bytes) -> list[Image]:
    """The progressive JPEGs that stand one after the other in data."""
    images, at, tables, interval = [], 0, {}, 0
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD8:
            images.append(Image())
            tables, interval, at = {}, 0, at + 2
            continue
        if marker == 0xD9:
            at += 2
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at, image = data[at + 4 : at + 2 + n], at + 2 + n, images[-1]
        if marker == 0xDB:
            image.quant.update(_quantisers(body))
        elif marker == 0xC4:
            tables.update(_code_tables(body))
        elif marker in (0xC0, 0xC1, 0xC2):
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = tuple(Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5]))
            image.quant_of = [body[8 + 3 * i] for i in range(body[5])]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            idents = [c.ident for c in image.components]
            own = tuple(idents.index(body[1 + 2 * i]) for i in range(body[0]))
            ids = [body[2 + 2 * i] for i in range(body[0])]
            ss, se, a = body[-3:]
            end = _MARKER.search(data, at)
            stop = end.start() if end else len(data)
            lanes = [x.replace(b"\xff\x00", b"\xff") for x in _RESTARTS.split(data[at:stop])]
            names = tuple(tables.get(i >> 4 if ss == 0 else 0x10 | i & 15, b"") for i in ids)
            image.scans.append((Scan(own, ss, se, a >> 4, a & 15), interval, names, lanes))
            at = stop
    return images


def _blocks_of(image: Image, scan: Scan) -> tuple[np.ndarray, np.ndarray, int]:
    """Component and index of each block of a scan in its order, with blocks of all components numbered through; blocks of a unit."""
    return _blocks(image.width, image.height, image.components, scan.components)


@lru_cache(2048)
def _blocks(width: int, height: int, components: tuple[Component, ...], own_components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    image, scan = Image(width, height, components), Scan(own_components, 0, 0, 0, 0)
    grids = [image.grid(k) for k in range(len(image.components))]
    starts = np.concatenate([[0], np.cumsum([g[0] * g[1] for g in grids])])
    if len(scan.components) == 1:
        k = scan.components[0]
        rows, across, own_rows, own = grids[k]
        at = np.arange(own_rows)[:, None] * across + np.arange(own)
        return np.full(at.size, k), starts[k] + at.ravel(), 1
    kinds, places = [], []
    c0 = image.components[scan.components[0]]
    down, over = grids[scan.components[0]][0] // c0.v, grids[scan.components[0]][1] // c0.h
    y, x = (a.ravel() for a in np.mgrid[:down, :over])
    for k in scan.components:
        c = image.components[k]
        for v in range(c.v):
            for h in range(c.h):
                kinds.append(np.full(len(y), k))
                places.append(starts[k] + (y * c.v + v) * grids[k][1] + x * c.h + h)
    return np.stack(kinds, 1).ravel(), np.stack(places, 1).ravel(), len(kinds)


class _Reader:
    """Bits of all lanes, one after the other; a window of 57 bits or more from any place."""

    def __init__(self, lanes: list[bytes]):
        sizes = np.fromiter(map(len, lanes), np.int64, len(lanes))
        data = np.frombuffer(b"\xff\xff\xff\xff\xff\xff\xff\xff".join([*lanes, b""]), np.uint8)
        self.begin = (np.cumsum(sizes + 8) - sizes - 8) * 8
        w = np.zeros(len(data), np.uint64)
        for k in range(8):
            w[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.words = w

    def top(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] << (at & 7).astype(np.uint64)


def decode_scan(coefficients: np.ndarray, scan: Scan, kinds: np.ndarray, places: np.ndarray, first: np.ndarray, count: np.ndarray, tables: list[np.ndarray], lanes: list[bytes]) -> None:
    """Adds a scan to coefficients (blocks, 64 in zigzag order).

    places: the block of each position of the scan; kinds: which of its components; first and count: of each lane.
    """
    reader = _Reader(lanes)
    at = reader.begin.copy()
    one = np.uint64(1)
    if scan.ss == 0:
        before = np.zeros((len(lanes), len(tables)), np.int64)
        for step in range(int(count.max()) if len(count) else 0):
            on = np.nonzero(count > step)[0]
            block, kind = places[first[on] + step], kinds[first[on] + step]
            w = reader.top(at[on])
            if scan.ah:
                coefficients[block, 0] |= (w >> np.uint64(63)).astype(np.int64) << scan.al
                at[on] += 1
                continue
            peek = (w >> np.uint64(48)).astype(np.int64)
            code = tables[0][peek] if len(tables) == 1 else np.stack([t[peek] for t in tables])[kind, np.arange(len(on))]
            n, s = code & 31, code >> 5
            value = _extended(w << n.astype(np.uint64), s)
            before[on, kind] += value
            coefficients[block, 0] = before[on, kind] << scan.al
            at[on] += n + s
        return
    table = tables[0]
    b = np.zeros(len(lanes), np.int64)
    k = np.full(len(lanes), scan.ss)
    fixes = []  # blocks, from and to (exclusive), where the correction bits stand
    zero_rank = None
    if scan.ah:
        band = coefficients[places][:, scan.ss : scan.se + 1]
        width = band.shape[1]
        rank = np.concatenate([np.zeros((len(places), 1), np.int64), np.cumsum(band == 0, axis=1)], axis=1)
        where = np.argsort(band != 0, axis=1, kind="stable")  # zeros first, in order
        zero_rank = rank, where
    on = np.nonzero(count > 0)[0]
    while len(on):
        w = reader.top(at[on])
        code = table[(w >> np.uint64(48)).astype(np.int64)]
        if not code.all():
            raise ValueError("a code that no table has")
        n, symbol = code & 31, code >> 5
        r, s = symbol >> 4, symbol & 15
        w = w << n.astype(np.uint64)
        pos = first[on] + b[on]
        ends = (s == 0) & (r < 15)
        more = np.where(ends & (r > 0), (w >> np.uint64(1) >> (63 - r).astype(np.uint64)).astype(np.int64), 0)
        skip = np.where(ends, (1 << np.where(ends, r, 0)) + more, 0)
        start = k[on]
        if scan.ah:
            rank, where = zero_rank
            sign = (w >> np.uint64(63)).astype(np.int64)
            used = n + np.where(ends, r, s)
            target = rank[pos, start - scan.ss] + r
            inside = ~ends & (target < rank[pos, width])
            stop = np.where(inside, where[pos, np.minimum(target, width - 1)], width) + scan.ss
            hit = inside & (s > 0)
            coefficients[places[pos[hit]], stop[hit]] = np.where(sign[hit] > 0, 1, -1) << scan.al
            passed = (stop - start) - (rank[pos, stop - scan.ss] - rank[pos, start - scan.ss])
            fixes.append((pos, start, stop, at[on] + used, passed))
            at[on] += used + passed
            later = np.nonzero(skip > 1)[0]  # further blocks of a run of ends have their corrections here
            for i in later:
                for extra in range(1, int(skip[i])):
                    p = pos[i] + extra
                    full = width - rank[p, width]
                    fixes.append((np.array([p]), np.array([scan.ss]), np.array([scan.se + 1]), np.array([at[on[i]]]), np.array([full])))
                    at[on[i]] += full
            k[on] = np.where(ends, scan.se + 1, stop + 1)
        else:
            stop = start + r
            hit = s > 0
            value = _extended(w, s)
            coefficients[places[pos[hit]], stop[hit]] = value[hit] * (1 << scan.al)
            at[on] += n + np.where(ends, r, s)
            k[on] = np.where(ends, scan.se + 1, stop + 1)
        full = k[on] > scan.se
        b[on] += np.where(full, np.maximum(skip, 1), 0)
        k[on] = np.where(full, scan.ss, k[on])
        on = on[b[on] < count[on]]
    for pos, start, stop, where_bits, passed in fixes:
        some = passed > 0
        if not some.any():
            continue
        pos, start, stop, where_bits, passed = (x[some] for x in (pos, start, stop, where_bits, passed))
        which = np.repeat(np.arange(len(pos)), stop - start)
        place = np.arange(len(which)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start) + start[which]
        old = band[pos[which], place - scan.ss] != 0
        which, place = which[old], place[old]
        number = np.arange(len(which)) - (np.cumsum(passed) - passed)[which]
        bit = (reader.top(where_bits[which] + number) >> np.uint64(63)).astype(np.int64)
        block = places[pos[which]]
        coefficients[block, place] += np.sign(coefficients[block, place]) * (bit << scan.al)


def _extended(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The signed value that the first s bits of a window stand for."""
    v = (w >> np.uint64(1) >> (63 - s).astype(np.uint64)).astype(np.int64)
    return np.where((s > 0) & (v < (1 << np.maximum(s - 1, 0))), v - (1 << s) + 1, v)


def coefficients_of(images: list[Image]) -> list[np.ndarray]:
    """Of each image its coefficients, blocks of all components one after the other, 64 in zigzag order.

    Images with the same scans and tables are read together.
    """
    sizes = [sum(g[0] * g[1] for g in (im.grid(k) for k in range(len(im.components)))) for im in images]
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    every = np.zeros((int(edges[-1]), 64), np.int16)
    groups: dict = {}
    for i, im in enumerate(images):
        groups.setdefault((im.components, tuple((s, t) for s, _, t, _ in im.scans)), []).append(i)
    for (_, scans), own in groups.items():
        for n, (scan, tables) in enumerate(scans):
            kinds, places, first, count, lanes, done = [], [], [], [], [], 0
            for i in own:
                kind, place, unit = _blocks_of(images[i], scan)
                _, interval, _, data = images[i].scans[n]
                per = interval * unit or len(place)
                begins = np.arange(0, len(place), per)
                kinds.append(kind)
                places.append(place + edges[i])
                first.append(begins + done)
                count.append(np.minimum(per, len(place) - begins))
                lanes += data[: len(begins)] + [b""] * (len(begins) - len(data))
                done += len(place)
            looks = []
            for t in tables:
                if t and t not in _lookups:
                    _lookups[t] = _lookup(t)
                looks.append(_lookups.get(t))
            names = {k: j for j, k in enumerate(scan.components)}
            kind = np.concatenate(kinds)
            kind = np.array([names.get(k, 0) for k in range(int(kind.max()) + 1)])[kind]
            decode_scan(every, scan, kind, np.concatenate(places), np.concatenate(first), np.concatenate(count), looks, lanes)
    return [every[a:b] for a, b in zip(edges, edges[1:])]


def rgb(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The tensor (height, width, 3) of bytes: inverse transform, chroma repeated to full resolution, colours turned."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes, at = [], 0
    for k, c in enumerate(image.components):
        rows, across, *_ = image.grid(k)
        own = coefficients[at : at + rows * across]
        at += rows * across
        flat = np.zeros((len(own), 64), np.float32)
        flat[:, ZIGZAG] = own * image.quant.get(image.quant_of[k], np.ones(64, np.float32))
        plane = (flat @ INVERSE).reshape(rows, across, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, across * 8)
        plane = np.clip(np.rint(plane), -128, 127)  # samples have eight bits
        planes.append(np.repeat(np.repeat(plane, v // c.v, axis=0), h // c.h, axis=1)[: image.height, : image.width])
    if len(planes) == 1:
        planes = [planes[0], *[np.zeros_like(planes[0])] * 2]
    y, cb, cr = planes[0] + 128, planes[1], planes[2]
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def tensors_of(images: list[Image], coefficients: list[np.ndarray]) -> list[np.ndarray]:
    """The tensor of each image; those of one width and layout that end with a whole unit are turned together, one above the other."""
    groups: dict = {}
    for i, im in enumerate(images):
        high = 8 * max(c.v for c in im.components)
        alone = i if im.height % high or len(im.components) == 1 else None
        groups.setdefault((alone, im.width, im.components, tuple(im.quant.get(q, _ONES).tobytes() for q in im.quant_of)), []).append(i)
    out: list = [None] * len(images)
    for own in groups.values():
        first = images[own[0]]
        tall = Image(first.width, sum(images[i].height for i in own), first.components, first.quant, first.quant_of)
        ends = [np.cumsum([0, *(images[i].grid(k)[0] * images[i].grid(k)[1] for k in range(len(first.components)))]) for i in own]
        stacked = np.concatenate([coefficients[i][e[k] : e[k + 1]] for k in range(len(first.components)) for i, e in zip(own, ends)])
        at, pixels = 0, rgb(tall, stacked)
        for i in own:
            out[i] = pixels[at : at + images[i].height]
            at += images[i].height
    return out


_ONES = np.ones(64, np.float32)


def payload_of(coefficients: np.ndarray) -> bytes:
    """The bytes back from an image of encode_many."""
    units = len(coefficients) // 9
    parts = [coefficients[: 6 * units].reshape(units, 6, 64), coefficients[6 * units : 7 * units].reshape(units, 1, 64), coefficients[7 * units :].reshape(units, 2, 64)]
    return (np.concatenate(parts, axis=1) + 128).astype(np.uint8).tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def _media(columns: dict[str, list], tensors: bool) -> dict[str, list]:
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(("media", "rgb") if tensors else ()))
    out: dict[str, list] = {"doc_id": columns["doc_id"], **{n: [] for n in names}}
    made = [padded(t) for t in columns["text"]]
    start = 0
    while start < len(made):
        stop, size = start, 0
        while stop < len(made) and (stop == start or size + len(made[stop][1]) <= BATCH):
            size += len(made[stop][1])
            stop += 1
        stored = encode_many([p for _, p in made[start:stop]])
        parsed = [parse(m) for m in stored]
        flat = [im for images in parsed for im in images]
        coefficients = coefficients_of(flat)
        found = zip(coefficients, tensors_of(flat, coefficients))
        for (n, _), media, images in zip(made[start:stop], stored, parsed):
            own, tensor = zip(*(next(found) for _ in images))
            payload = b"".join(map(payload_of, own))
            pixels = b"".join(t.tobytes() for t in tensor)
            mean = np.frombuffer(pixels, np.uint8).reshape(-1, 3).mean(axis=0)
            feature = f"{24}x{sum(t.shape[0] for t in tensor)}:" + ",".join(f"{x:.3f}" for x in mean) + f":{zlib.crc32(pixels):08x}"
            values = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, *((media, pixels) if tensors else ()))
            for name, value in zip(names, values):
                out[name].append(value)
        start = stop
    return out


def store(docs: DataFrame, tensors: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of each row, media and rgb.

    media are the stored bytes, one or more JPEGs that any reader takes, and rgb the tensor's, rows of 24 pixels, three bytes each; without tensors they are left out.
    The payload is read back from the stored bytes. feature: size, mean colours and crc32 of the RGB tensor. A null text is empty:
    one unit of 255. Equal texts and repeated rows give equal values, a row each; a text over UNIT * MOST_UNITS bytes goes to several images,
    and none is cut short. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(rows, _media, schema + (", media binary, rgb binary" if tensors else ""), (tensors,))

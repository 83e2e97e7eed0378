"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

The encoding of every prefix of a text ends in one token only, whichever text follows, because a later merge never opens
an earlier one within it. So a table holds each prefix's last token: an automaton lists the pieces that end at a position,
and of those the right one is the one whose pair with the last token of the prefix before it stays two tokens when
merged alone. The ids are then read backwards from the end of the table.

No piece goes over two characters that stand side by side in none, a word's last and the next word mark among them, so a text is
cut there and encoded part by part. The texts of a batch are cut and their parts made different in numpy and Arrow, only different parts
are looked up or encoded in Python, and Arrow lays their ids out along the texts. Parts recur, so each worker keeps those it has seen, up to a bound.
"""

from __future__ import annotations

import hashlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import map_texts

MARK = "▁"
#: Parts kept by a worker, and the longest that is kept (bytes).
KEPT, KEPT_BYTES = 300_000, 64
#: Characters whose neighbours are looked up at once.
SLICE = 1 << 18


class PieceModel:
    """The pieces, scores and flags of a model file, and the merging by prefix table."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sp.serialized_model_proto()
        if b"identity" not in proto[-400:]:
            raise ValueError("only models that leave the text as it is are handled")
        self.unk, self.eos = sp.unk_id(), sp.eos_id()
        self.score, self.ids, self.texts, self.bytes_of, self.byte_id = {}, {}, {}, {}, {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece goes over a word mark")
                self.score[piece], self.ids[piece] = sp.get_score(i), i
                self.texts[i] = piece.replace(MARK, " ")
        self.halves = {p: self._last_merge(p) for p in self.ids if len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self.halves[piece]:
                self.automaton.add_word(piece, (len(piece), piece, self.ids[piece] + 1))
        self.automaton.make_automaton()
        #: Of each piece its id in decimal, with a space behind it, and the bytes it decodes to.
        self.out = {p: (b"%d " % i, 1, p.replace(MARK, " ").encode()) for p, i in self.ids.items()}
        joints = {p[i : i + 2].replace(MARK, " ") for p in self.ids for i in range(len(p) - 1)}
        chars = sorted({c for j in joints for c in j})
        #: A number for each character of pieces of two or more, zero for all others, and whether two of them stand side by side in a piece.
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in joints:
            self.joined[self.number[ord(a)], self.number[ord(b)]] = True
        self.stays: dict[int, bool] = {}
        self.kept: dict[bytes, tuple[bytes, int, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, int, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by the definition: the pair of the best score, leftmost first, is merged until none is left. For short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((score[p], -i) for i, p in enumerate(a + b for a, b in zip(parts, parts[1:])) if p in score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that were merged last to make a piece; none if merging does not end in it."""
        parts, score = list(piece), self.score
        while len(parts) > 2:
            best = max(((score[p], -i) for i, p in enumerate(a + b for a, b in zip(parts, parts[1:])) if p in score), default=None)
            if best is None:
                return None
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def compatible(self, left: str, right: str) -> bool:
        """Whether left then right stay two tokens when their text is merged alone.

        The merges of both are taken back, the latest first; the pair does not stay if two parts that face each other
        would have merged before what is still open. On equal scores the left merge comes first.
        """
        if MARK * 2 in left + right:  # the only pieces of equal score
            return self.merged(left + right) == [left, right]
        score, halves, ids = self.score, self.halves, self.ids
        floor, tie = float("-inf"), True  # tie: an equal score merges first, being further left
        while True:
            joined = score.get(left + right)
            if joined is not None and (joined > floor or tie and joined == floor):
                return False
            one, two = halves.get(left), halves.get(right)
            if one is None and two is None:
                return True
            if two is None or one is not None and score[left] < score[right]:
                floor, tie, left = score[left], False, one[1]
            else:
                floor, tie, right = score[right], True, two[0]

    def last_tokens(self, text: str) -> list[str]:
        """The table: at i the last token of the prefix of i + 1 characters."""
        table = list(text)  # a character without a piece never merges
        ids = [0] * len(text)
        stays, done = self.stays, -1
        for end, (size, piece, number) in self.automaton.iter(text):
            if end == done:
                continue
            if end >= size:
                before = ids[end - size]
                if before:
                    pair = before << 20 | number
                    if (fits := stays.get(pair)) is None:
                        if len(stays) >= 4 * KEPT:
                            stays.clear()
                        fits = stays[pair] = self.compatible(table[end - size], piece)
                    if not fits:
                        continue
            table[end], ids[end], done = piece, number, end
        return table

    def tokens(self, text: str) -> list[str]:
        table, out, i = self.last_tokens(text), [], len(text) - 1
        while i >= 0:
            out.append(table[i])
            i -= len(table[i])
        return out[::-1]

    def part(self, part: bytes) -> tuple[bytes, int, bytes]:
        """Of a part, with spaces for marks: its ids in decimal with a space behind each, their number, and the bytes they decode to."""
        if (made := self.older.get(part)) is None:
            out = self.out
            made = [out.get(t) or self.spelled(t) for t in self.tokens(part.decode().replace(" ", MARK))]
            made = made[0] if len(made) == 1 else (b"".join([m[0] for m in made]), sum([m[1] for m in made]), b"".join([m[2] for m in made]))
        if len(part) <= KEPT_BYTES:
            if len(self.kept) >= KEPT // 2:  # parts that recur move to the new table
                self.kept, self.older = {}, self.kept
            self.kept[part] = made
        return made

    def spelled(self, char: str) -> tuple[bytes, int, bytes]:
        """As part(), for a character without a piece: its bytes, or the unknown id of a model without bytes."""
        if not self.byte_id:
            return b"%d " % self.unk, 1, " \u2047 ".encode()
        data = char.encode()
        return b"".join([b"%d " % self.byte_id[b] for b in data]), len(data), data

    def parts(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts in their order, with spaces for marks, and the number of parts before each text and after the last.

        A mark stands for a space and one goes before each text that is not empty.
        """
        whole = "".join([" " + t for t in texts if t]).replace(MARK, " ")
        edges = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        begins = np.ones(len(whole) + 1, bool)
        for i in range(0, len(whole) - 1, SLICE):  # a long text takes little more than itself
            number = self.number[np.frombuffer(whole[i : i + SLICE + 1].encode("utf-32-le"), np.uint32)]
            begins[i + 1 : i + len(number)] = ~self.joined[number[:-1], number[1:]]
        begins[edges] = True
        at = np.flatnonzero(begins)
        data = np.frombuffer(whole.encode(), np.uint8)
        places = at if len(data) == len(whole) else np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))[at]
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)]), np.searchsorted(at, edges)

    def laid_out(self, texts: list[str | None]) -> tuple[list[int], list[memoryview], list[memoryview]]:
        """Of each text the number of its ids, the ids in decimal with a space behind each, and the bytes they decode to; without the end id."""
        parts, edges = self.parts(texts)
        coded = parts.dictionary_encode()
        different = coded.dictionary.to_pylist()
        made = [known or self.part(p) for p, known in zip(different, map(self.kept.get, different))]
        sums = np.append(0, np.cumsum(np.array([m[1] for m in made], np.int64)[coded.indices.to_numpy()]))[edges]
        out = []
        for column in (0, 2):
            laid = pa.array([m[column] for m in made], pa.large_binary()).take(coded.indices)
            _, places, data = laid.buffers()
            ends = (np.frombuffer(places, np.int64)[laid.offset + edges] if len(laid) else np.zeros(len(edges), np.int64)).tolist()
            view = memoryview(data or b"")
            out.append([view[i:j] for i, j in zip(ends, ends[1:])])
        return np.diff(sums).tolist(), out[0], [v[v[:1] == b" " :] for v in out[1]]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text with the end id."""
        return [[*map(int, bytes(ids).split()), self.eos] for ids in self.laid_out(texts)[1]]

    def encode(self, text: str | None) -> list[int]:
        """Ids with the end id."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined with marks as spaces, bytes joined to UTF-8, and the space that goes before a text taken away."""
        out = b"".join(self.bytes_of.get(i) or (self.texts[i].encode() if i in self.texts else b" \xe2\x81\x87 " if i == self.unk else b"") for i in ids)
        return out.removeprefix(b" ").decode("utf-8", "replace")


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _digests(columns: dict[str, list], path: str) -> dict[str, list]:
    m = model(path)
    numbers, ids, back = m.laid_out(columns["text"])
    end = str(m.eos).encode()
    ids_sha256 = []
    for own in ids:
        digest = hashlib.sha256(own)
        digest.update(end)
        ids_sha256.append(digest.hexdigest())
    return {"doc_id": columns["doc_id"], "n_tokens": [n + 1 for n in numbers], "ids_sha256": ids_sha256, "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back]}


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int, end id last) and decoded text. A null text is empty: the end id alone, and an empty text."""

    def turn(columns: dict[str, list], path: str) -> dict[str, list]:
        m = model(path)
        ids = m.encode_all(columns["text"])
        return {"doc_id": columns["doc_id"], "ids": ids, "decoded": [m.decode(i) for i in ids]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, turn, "doc_id long, ids array<int>, decoded string", (path,))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's encoding and of what it decodes to.

    One row for each row; a null text is empty; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", (path,))

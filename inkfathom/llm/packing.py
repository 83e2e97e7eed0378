"""Bulk-synchronous best-fit packing of token sequences.

The pieces of documents are placed in rounds, one band of lengths a round, from the longest down. In a round the pieces of the
band and all gaps that can hold one are range-sorted together, largest first and gaps before pieces. Each range is swept once:
a gap puts its slots on a stack, a piece takes its successor, the smallest gap still open that holds it, which is the top
of the stack. Several pieces with one successor are a conflict that rank settles: the first has it, the next has the next gap.
Pieces that find the stack of their range empty and slots that stay open in theirs are numbered there; the numbers of both,
a row a range, are all that the driver sees. It carries open slots on to later ranges, which gives runs of piece ranks over runs of slots,
and the two are joined on range and slot. Pieces that no gap holds open new sequences, as many to each as surely fit. Then the
gaps are updated by what was placed in them, and the next round begins. At the end the places in each sequence, of at most size pieces, are
running sums.

A gap has one slot for each time that the band's longest piece goes into it, at least one, so a round never overfills. The
ranges are cut by size, kind and a hash of the row, so a length that a third of all rows share spreads over many of them.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkfathom.llm.common import cut, drop, map_texts

SIZE = 1024
END = 2
#: A band reaches from one of these parts of a sequence's size down to the next.
PARTS = (1, 2, 3, 4, 6, 9, 13, 20, 30, 45, 68, 102, 153, 230, 345, 518, 1024)
#: Runs of white space that tiktoken's matcher is not given; it fails at about a million characters.
LONG_SPACE = re.compile(r"\s{50000}")


class Encoder:
    """Ids as tokenizers gives them for a byte-level BPE file: tiktoken over the same vocabulary, and tokenizers for texts with special tokens or very long white space."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        plain = path.removesuffix(".json") + ".tiktoken"
        from public_tokenizers import PATTERN

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(plain, "rb"))}
        self.parts = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without the end id."""
        if any(s in text for s in self.special) or len(text) >= 50000 and LONG_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.parts.encode_ordinary(text), "<u4").tobytes()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(columns: dict[str, list], path: str, size: int, end: int) -> dict[str, list]:
    e, last = encoder(path), np.array([end], "<u4").tobytes()
    out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
    for doc_id, text in zip(columns["doc_id"], columns["text"]):
        data = e.ids(text or "") + last
        n = len(data) // 4
        cuts = [0, *range(n % size or size, n + 1, size)]  # the first piece is the shorter one
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for name, value in (("doc_id", doc_id), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(data[4 * a : 4 * b]))):
                out[name].append(value)
    return out


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, _pieces, "doc_id long, piece int, start long, length long, ids_crc32 long", (path, size, end))



PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
SWEPT = f"part int, state int, seq long, place long, slots long, row long, {PIECE}"
#: What a swept row is: a piece with its sequence, one without, and slots left open.
PLACED, LEFT, OPEN = 0, 1, 2


def _sweep(batches):
    """Sorted gaps (kind 0) and pieces (kind 1) of one range, each piece with the gap on top of the stack."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    kinds = {"part": pa.int32(), "state": pa.int32(), "seq": pa.int64(), "place": pa.int64(), "slots": pa.int64(), "row": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    seqs, slots, left = [], [], 0  # of the open gaps, the smallest last
    for batch in batches:
        state, seq, place = [], [], []
        kind, gap, n = (batch.column(c).to_pylist() for c in ("kind", "seq", "slots"))
        for k, g, m in zip(kind, gap, n):
            if k == 0:
                seqs.append(g)
                slots.append(m)
            elif seqs:
                state.append(PLACED)
                seq.append(seqs[-1])
                place.append(0)
                if slots[-1] == 1:
                    seqs.pop()
                    slots.pop()
                else:
                    slots[-1] -= 1
            else:
                state.append(LEFT)
                seq.append(None)
                place.append(left)
                left += 1
        if state:
            own = batch.filter(pa.array(np.array(kind) == 1))
            made = {"part": [part] * len(state), "state": state, "seq": seq, "place": place, "slots": [0] * len(state)}
            yield pa.RecordBatch.from_arrays([pa.array(made[c], t) if c in made else own.column(c) for c, t in kinds.items()], names=list(kinds))
    if seqs:
        size = np.array(slots, np.int64)
        made = {"part": np.full(len(size), part), "state": np.full(len(size), OPEN), "seq": np.array(seqs), "place": np.cumsum(size) - size, "slots": size}
        yield pa.RecordBatch.from_arrays([pa.array(made[c], t) if c in made else pa.nulls(len(size), t) for c, t in kinds.items()], names=list(kinds))


def carried(parts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Open slots carried on to later ranges, from (range, pieces left, slots open) in order.

    The first list has runs (range, from, to, range of the slots, slot of the first): ranks from to to (exclusive) take the
    slots from there downwards. The second has (range, pieces that got a slot, slots that stay).
    """
    runs, got, stack, rest = [], {}, [], {}
    for part, pieces, slots in parts:
        at = 0
        while at < pieces and stack:
            other, n = stack.pop()
            take = min(n, pieces - at)
            runs.append((part, at, at + take, other, n - 1))
            at += take
            rest[other] = n - take
            if n > take:
                stack.append((other, n - take))
        got[part], rest[part] = at, slots
        if slots:
            stack.append((part, slots))
    return runs, [(p, got[p], rest[p]) for p, *_ in parts]


def _round(band: int, pieces: DataFrame, gaps: DataFrame, low: int, high: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of one band with their sequences (a cut table), and the gaps after that."""
    spark = pieces.sparkSession
    own = pieces.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(1).cast("long").alias("slots"), "row", "doc_id", "piece", "start", "length", "ids_crc32")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (f.split(" ") for f in f"row long, {PIECE}".split(", "))]
    able = gaps.where(F.col("gap") > low).select(F.least("gap", F.lit(high)).alias("size"), F.lit(0).alias("kind"), "seq", F.greatest(F.floor(F.col("gap") / high), F.lit(1)).alias("slots"), *empty)
    order = [F.desc("size"), "kind", F.xxhash64("seq", "row"), "seq", "row"]
    swept = cut(own.union(able).repartitionByRange(*order).sortWithinPartitions(*order).drop("size").mapInArrow(_sweep, SWEPT))
    sums = swept.where(F.col("state") != PLACED).groupBy("part").agg(F.count_if(F.col("state") == LEFT).alias("left"), F.sum("slots").alias("open")).collect()  # a row a range
    runs, parts = carried(sorted((r.part, r.left, r.open) for r in sums))
    names = [f.split(" ")[0] for f in PIECE.split(", ")]
    out = [F.lit(band).alias("band"), "seq", "row", *names]
    placed = swept.where(F.col("state") == PLACED).select(*out)
    left = swept.where(F.col("state") == LEFT).drop("seq", "slots")
    if runs:
        run = F.broadcast(spark.createDataFrame(runs, "part int, first long, stop long, other int, top long"))  # two rows a range at most
        asked = left.join(run, "part").where("place >= first and place < stop").withColumn("slot", F.col("top") - F.col("place") + F.col("first"))
        kept = F.broadcast(spark.createDataFrame([(p, r) for p, _, r in parts], "part int, kept long"))  # a row a range
        taken = swept.where(F.col("state") == OPEN).select("part", "seq", "place", "slots").join(kept, "part").where("place + slots > kept")
        slots = taken.select(F.col("part").alias("other"), "seq", F.explode(F.sequence(F.greatest("place", "kept"), F.col("place") + F.col("slots") - 1)).alias("slot"))
        placed = placed.union(asked.join(slots, ["other", "slot"]).select(*out))
    if any(n > g for (_, n, _), (_, g, _) in zip(sorted((r.part, r.left, r.open) for r in sums), parts)):
        got = F.broadcast(spark.createDataFrame([(p, g) for p, g, _ in parts], "part int, got long"))  # a row a range
        fresh = left.join(got, "part").where("place >= got")
        number = F.lit(band << 52) + F.shiftleft(F.col("part").cast("long"), 32) + F.floor((F.col("place") - F.col("got")) / (size // high))
        placed = placed.union(fresh.withColumn("seq", number.cast("long")).select(*out))
    placed = cut(placed)
    drop(swept)
    return placed, updated(gaps, placed, size)


def updated(gaps: DataFrame | None, placed: DataFrame, size: int) -> DataFrame:
    """The gaps, less what was placed in them; those of new sequences as well."""
    used = placed.select("seq", F.lit(None).cast("long").alias("gap"), "length")
    rows = used if gaps is None else used.union(gaps.select("seq", "gap", F.lit(0).cast("long")))
    return cut(rows.groupBy("seq").agg((F.coalesce(F.sum("gap"), F.lit(size)) - F.sum("length")).alias("gap")).where("gap > 0"))


def bands(size: int) -> list[tuple[int, int]]:
    """(low, high): lengths over low up to high."""
    ends = sorted({size // k for k in PARTS if k <= size} | {1}, reverse=True)
    return list(zip([*ends[1:], 0], ends))


def placed(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows (pieces of at most size, each with a number of its own in row) with sequence_id and offset. rows must not change when read again."""
    level = F.coalesce(*(F.when(F.col("length") > low, i) for i, (low, _) in enumerate(bands(size))))
    full = {r.band for r in rows.groupBy(level.alias("band")).agg(F.count("*")).collect()}  # a row a band
    done, gaps = [], None
    for band, (low, high) in enumerate(bands(size)):
        if band not in full:
            continue
        own = rows.where(f"length > {low} and length <= {high}")
        if gaps is None and size // high == 1:  # no gap, and no two go together
            made = own.select(F.lit(band).alias("band"), F.col("row").alias("seq"), "row", *(f.split(" ")[0] for f in PIECE.split(", ")))
            gaps = updated(None, made, size)
        else:
            before = gaps if gaps is not None else rows.sparkSession.createDataFrame([], "seq long, gap long")
            made, gaps = _round(band, own, before, low, high, size)
            drop(before)
        done.append(made)
    drop(gaps)
    if not done:
        return rows.drop("row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    so_far = Window.partitionBy("seq").orderBy("band", F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)  # size rows at most
    return every.select(*(f.split(" ")[0] for f in PIECE.split(", ")), F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(so_far), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece.

    A null or empty text is the end id alone. Rows that repeat an id, or an id and a text, are packed each. Of pieces of one length any may go first.
    Only documents of over size tokens are cut, whatever their length; whole texts are encoded. Other columns are not read, so their
    names do not matter; an empty table gives no rows.
    """
    return placed(cut(pieces(docs, path, size, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id())), size)

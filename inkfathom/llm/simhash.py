"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits have a common point within half that distance of each:
at most one bit from one of them and at most two from the other. Every fingerprint emits the ball of radius 1 round
itself, and those with an even number of bits also the sphere of radius 2 (at distance 3 the two parities differ, so
one of the pair is even). The variants are shuffled; what meets on a variant is linked without listing pairs:

* two that reach a variant with one flip or none differ in two bits at most,
* one that reaches it with two flips differs in three bits at most from each of those.

So all that meet with at least one near member join a star round that member, whose edges are verified by bit count.
No variant is met by more than the 2,081 points of a ball, however many documents are copies, since fingerprints are made
distinct first.

All fingerprints emit all their variants, 1,073 each on average. They are packed: a row of the shuffle holds those of
one bucket of variants, ten bytes each (the variant, and which flips lead back to the fingerprint), and a bucket is sorted by
variant in numpy. So that the shuffle needs little disk the variants are dealt to PASSES passes by their hash, one after the other, about
2.7 kB a distinct text in each; a pass's shuffle files go before the next begins.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import cut, drop, few_files, files_for, lower_ascii, map_texts
from inkfathom.llm.components import smallest_reachable

RADIUS = 3
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the shingles of size words; 0 for a text without words.

    A bit is 1 if it is set in over half of the shingles' XXH64, repeats included. A text of fewer words is one shingle.
    """
    w = lower_ascii((text or "").encode()).split()  # at the six white-space characters of ASCII
    if not w:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    hashes = [h(join(t), SEED) for t in zip(*(w[i:] for i in range(size)))] or [h(join(w), SEED)]
    bits = np.zeros(64, np.int64)
    raw = np.array(hashes, "<u8")
    for i in range(0, len(raw), 65536):
        bits += np.unpackbits(raw[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(raw), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (long) of each row. A null text has no words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, lambda c: {"doc_id": c["doc_id"], "fingerprint": [fingerprint(t) for t in c["text"]]}, "doc_id long, fingerprint long")


def _flips(*bits: int) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >= 1 << 63 else v


NEAR = [0, *(_flips(a) for a in range(64))]
FAR = [_flips(a, b) for a, b in combinations(range(64), 2)]


FLIPS = np.array([f & (1 << 64) - 1 for f in NEAR + FAR], np.uint64)
#: Passes over the variants, bytes of a packed variant, of a bucket that one call sorts, and of what a task packs at once.
PASSES, PACKED, BUCKET_BYTES, FLUSH_BYTES = 4, 10, 8_000_000, 8_000_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The variants that distinct fingerprints emit, and the number in FLIPS of each."""
    n, near = len(fps), len(NEAR)
    even = fps[np.bitwise_count(fps) % 2 == 0]
    made = np.concatenate([(fps[:, None] ^ FLIPS[:near]).ravel(), (even[:, None] ^ FLIPS[near:]).ravel()])
    return made, np.concatenate([np.tile(np.arange(near, dtype=np.uint16), n), np.tile(np.arange(near, len(FLIPS), dtype=np.uint16), len(even))])


def emitted(fps: DataFrame, turn: int, buckets: int) -> DataFrame:
    """bucket and packed variants of one pass, from distinct fingerprints (column fp)."""

    def emit(batches):
        kept: list[tuple[np.ndarray, ...]] = []

        def packed():
            v, code, bucket = (np.concatenate(x) for x in zip(*kept))
            order = np.argsort(bucket, kind="stable")
            v, code, bucket = v[order], code[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
            parts = list(zip(edges, edges[1:]))
            columns = [pa.array([int(bucket[a]) for a, _ in parts], pa.int64()), pa.array([v[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([code[a:b].tobytes() for a, b in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "variants", "flips"])

        size = 0
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(every), 256):
                v, code = variants(every[i : i + 256])
                mixed = (v * _SPREAD) >> np.uint64(30)
                own = np.flatnonzero(mixed & np.uint64(PASSES - 1) == turn)
                v, code, mixed = v[own], code[own], mixed[own] >> np.uint64(2)
                kept.append((v, code, (mixed * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)))
                size += len(v) * PACKED
                if size > FLUSH_BYTES:
                    yield packed()
                    size = 0
                    kept.clear()
        if size:
            yield packed()

    return fps.select("fp").mapInArrow(emit, "bucket long, variants binary, flips binary")


def _meet(table: pa.Table) -> pa.Table:
    """Edges of one bucket: what meets on a variant, to the least of those with a flip at most."""
    v = np.frombuffer(b"".join(table.column("variants").to_pylist()), np.uint64)
    code = np.frombuffer(b"".join(table.column("flips").to_pylist()), np.uint16)
    order = np.argsort(v)
    v, code = v[order], code[order]
    same = v[1:] == v[:-1]
    some = np.flatnonzero(np.append(same, False) | np.append(False, same))
    edges = np.zeros((0, 2), np.int64)
    if len(some):
        v, code = v[some], code[some]
        fp, near = (v ^ FLIPS[code]).view(np.int64), code < len(NEAR)
        begin = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        centre = np.minimum.reduceat(np.where(near, fp, np.iinfo(np.int64).max), begin)
        size = np.diff(np.append(begin, len(v)))
        keep = np.repeat(np.logical_or.reduceat(near, begin), size)
        a, b = fp[keep], np.repeat(centre, size)[keep]
        right = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS)
        edges = np.unique(np.stack([a[right], b[right]], axis=1), axis=0)
    return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})


def links(fps: DataFrame) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp), all within RADIUS bits, whose components are those of all such pairs. Edges may repeat."""
    spark = fps.sparkSession
    rows = fps.count()
    dealt = cut(fps.repartition(files_for(spark, rows)))  # each row grows a thousandfold
    average = len(NEAR) + len(FAR) / 2
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), round(rows * average * PACKED / PASSES / BUCKET_BYTES))
    found = [cut(few_files(emitted(dealt, turn, buckets).groupBy("bucket").applyInArrow(_meet, "a long, b long").distinct(), rows)) for turn in range(PASSES)]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    drop(dealt)
    return every


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links of RADIUS bits or fewer reach.

    One row for each row of docs; rows with equal texts have equal fingerprints. Texts that are null, empty or only
    white space have fingerprint zero and are linked like any other; a long text is read whole. A null id is no component's id unless
    all of its rows lack one. An empty table gives no rows; other columns are not read, so their names do not matter.
    """
    made = cut(fingerprints(docs, id_col, text_col))
    rows = made.count()
    firsts = cut(few_files(made.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), rows))
    edges = links(firsts.select("fp"))
    reached = smallest_reachable(edges, firsts.withColumnRenamed("fp", "node").withColumnRenamed("first", "rank"))
    found = made.join(reached.select(F.col("node").alias("fingerprint"), F.col("smallest").alias("component_id")), "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )
    return few_files(found, rows)

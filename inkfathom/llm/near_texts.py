"""Near-duplicate texts, of five-word shingles with a similarity of 0.8 or more, by ball hashing of several SimHash fingerprints.

Two texts of that similarity differ in about 0.15 of the bits of a SimHash, more than a ball round one fingerprint of 64 bits
can span. So a text has TABLES fingerprints of WIDTH bits, from the set of its shingles. In each table every fingerprint emits
all variants within one bit, half the radius of two; the variants are shuffled, and what meets on one differs in two bits at most. At
a similarity of exactly 0.8 a table brings a pair together with a chance of 0.12, one of 32 tables with 0.98; at 0.85 and over it is 0.99.

A further fingerprint of 64 bits names the text and goes with its variants. Those that meet and differ in over CHECK of its bits are apart.
Of the rest the least by a hash of name and table leads and the others link to it; what is apart from the leader gets a leader of its
own, and so on. This happens first in each task's part of the variants, and only leaders are shuffled, so that a group of near copies
of any size is spread over all tasks. Different tables have different leaders, so a pair that one leader hides meets under others.

Links are verified over all bits of all tables: with d of n bits different the cosine of the two sets is about cos(pi d / n), which with
the sets' sizes gives their similarity, to about 0.03 of standard error at 0.8. Texts with the same name are linked without a look at the rest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import cut, drop, lower_ascii, map_texts, unused
from inkfathom.llm.components import smallest_reachable

SHINGLE, SIMILARITY = 5, 0.8
TABLES, WIDTH, CHECK = 32, 32, 18
LONGS = TABLES * WIDTH // 64
SEED = 42
#: Passes over the tables, bytes of a packed variant, of a bucket that one call sorts, and of what a task packs at once.
PASSES, PACKED, BUCKET_BYTES, FLUSH_BYTES = 4, 12, 8_000_000, 8_000_000
#: Leaders with more than this part of all links are joined by broadcast: fewer than so many.
HOT = 10_000

FLIPS = np.array([0, *(1 << i for i in range(WIDTH))], np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, LONGS + 2, dtype=np.uint64) * _ODD


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the runs of SHINGLE lower-case words; fewer words are one shingle, none give none."""
    words = lower_ascii((text or "").encode()).split()  # at the six white-space characters of ASCII
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    k = min(SHINGLE, len(h))
    made = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        made = mixed(made + h[i : len(h) - k + 1 + i])
    return np.unique(made)


def sketch(text: str | None) -> tuple[int, int, list[int]]:
    """A text's name (signed, 64 bits), the size of its set of shingles, and the bits of all tables as signed longs.

    A bit is 1 if it is set in over half of the shingles' hashes. Without words all are zero.
    """
    made = shingles(text)
    bits = np.zeros((LONGS + 1) * 64, np.int64)
    for i in range(0, len(made), 255):  # as many as a byte can count
        raw = mixed(made[i : i + 255, None] + _STEPS)
        bits += np.add.reduce(np.unpackbits(raw.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    longs = np.packbits(2 * bits > len(made), bitorder="little").view("<i8")
    return int(longs[-1]), len(made), longs[:-1].tolist()


def stars(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys and names of the leaders, sorted by key, and links (member, leader), of names that meet on keys (table, variant)."""
    order = np.argsort(keys, kind="stable")
    keys, names = keys[order], names[order]
    same = keys[1:] == keys[:-1]
    some = np.append(same, False) | np.append(False, same)
    led, links = [(keys[~some], names[~some])], [np.zeros((0, 2), np.uint64)]
    keys, names = keys[some], names[some]
    rank = mixed(names + (keys >> np.uint64(WIDTH)) * _ODD)
    order = np.lexsort((rank, keys))
    keys, names = keys[order], names[order]
    while len(keys):
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        leader = np.repeat(names[begin], np.diff(np.append(begin, len(keys))))
        led.append((keys[begin], names[begin]))
        apart = np.bitwise_count(names ^ leader) > CHECK
        member = ~apart & (names != leader)
        links.append(np.stack([names[member], leader[member]], axis=1))
        keys, names = keys[apart], names[apart]
    keys, names = (np.concatenate(x) for x in zip(*led))
    order = np.argsort(keys, kind="stable")
    return keys[order], names[order], np.unique(np.concatenate(links), axis=0)


def emitted(nodes: DataFrame, turn: int, parts: int) -> DataFrame:
    """Packed variants and names by bucket, of one pass, from nodes (name, sketch); links found on the way in buckets below zero."""
    tables = np.arange(turn * TABLES // PASSES, (turn + 1) * TABLES // PASSES, dtype=np.uint64)

    def emit(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def packed():
            keys, names, found = stars(*(np.concatenate(x) for x in zip(*kept)))
            variant = keys & np.uint64((1 << WIDTH) - 1)
            bucket = ((keys >> np.uint64(WIDTH)) * np.uint64(parts) + (variant * np.uint64(parts) >> np.uint64(WIDTH))).astype(np.int64)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
            spans = list(zip(edges, edges[1:]))
            rows = [(int(bucket[a]), variant[a:b].astype(np.uint32).tobytes(), names[a:b].tobytes()) for a, b in spans]
            rows += [(-1 - int(names[0] % np.uint64(1 << 20)), found[:, 0].tobytes(), found[:, 1].tobytes())] if len(found) else []
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "variants", "names"])

        size = 0
        for batch in batches:
            names = batch.column("name").to_numpy().view(np.uint64)
            bits = batch.column("sketch").flatten().to_numpy().astype("<i8", copy=False).view("<u4").reshape(-1, TABLES)
            for i in range(0, len(names), 256):
                few = bits[i : i + 256, tables.astype(np.int64)]
                keys = (few[:, :, None] ^ FLIPS).astype(np.uint64) | (tables << np.uint64(WIDTH))[:, None]
                kept.append((keys.ravel(), np.repeat(names[i : i + 256], keys[0].size)))
                size += keys.size * PACKED
                if size > FLUSH_BYTES:
                    yield packed()
                    size = 0
                    kept.clear()
        if size:
            yield packed()

    return nodes.select("name", "sketch").mapInArrow(emit, "bucket long, variants binary, names binary")


def _meet(parts: int):
    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        first, names = b"".join(table.column("variants").to_pylist()), np.frombuffer(b"".join(table.column("names").to_pylist()), np.uint64)
        if bucket < 0:
            found = np.stack([np.frombuffer(first, np.uint64), names], axis=1)
        else:
            _, _, found = stars(np.frombuffer(first, np.uint32).astype(np.uint64) | np.uint64(bucket // parts << WIDTH), names)
        found = np.unique(found, axis=0).view(np.int64)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return meet


def similarity(d, size, other):
    """Of two sets of these sizes, d of whose bits differ."""
    shared = F.cos(d * (math.pi / (TABLES * WIDTH))) * F.sqrt(size.cast("double") * other)
    return shared / (size + other - shared)


def verified(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links a, b of which both texts (nodes: name, size, sketch) are estimated to have SIMILARITY or more."""
    def side(name: str, some: DataFrame = nodes) -> DataFrame:
        return some.select(F.col("name").alias(name), F.col("size").alias(f"{name}_size"), F.col("sketch").alias(f"{name}_sketch"))

    every = cut(links.distinct())
    counts = every.groupBy("b").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > every.count() / HOT).select(F.col("b").alias("name"))
    often = F.broadcast(cut(side("b", nodes.join(hot, "name", "left_semi"))))
    marked = every.join(often, "b", "left")
    rest = marked.where("b_size is null").select("a", "b").join(side("b"), "b")
    both = marked.where("b_size is not null").select(rest.columns).union(rest).join(side("a"), "a")
    apart = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    found = cut(both.where(similarity(apart, F.col("a_size"), F.col("b_size")) >= SIMILARITY).select("a", "b"))
    drop(every)
    return found


def links(nodes: DataFrame) -> DataFrame:
    """Verified links a, b between nodes (name, size, sketch)."""
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(nodes.repartition(tasks, F.xxhash64("name")))  # each row grows a hundredfold
    parts = max(math.ceil(tasks * PASSES / TABLES), math.ceil(dealt.count() * len(FLIPS) * PACKED / BUCKET_BYTES))
    found = [cut(emitted(dealt, turn, parts).groupBy("bucket").applyInArrow(_meet(parts), "a long, b long")) for turn in range(PASSES)]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    good = verified(every, dealt)
    drop(dealt, *found)
    return good


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of linked texts, with all its columns: that of the smallest id, then of the least hash of the text.

    A null id comes after all others, so a document without an id stays if no other of its group has one. Of rows that
    repeat an id and a text one stays. Null, empty and blank texts are one group. Long texts are read whole, columns may have any
    names, and an empty table stays empty.
    """
    ident, same, kept_ident, kept_same, times = unused(docs, "_id", "_hash", "_kept", "_same", "_times")
    key = {ident: F.col(id_col).cast("long"), same: F.xxhash64(F.col(text_col))}
    rows = docs.select(key[ident].alias("id"), key[same].alias("hash"), F.col(text_col).alias("text"))

    def sketches(c: dict[str, list]) -> dict[str, list]:
        name, size, bits = zip(*(sketch(t) for t in c["text"]))
        return {"id": c["id"], "hash": c["hash"], "name": name, "size": size, "sketch": bits}

    made = cut(map_texts(rows, sketches, "id long, hash long, name long, size long, sketch array<long>"))
    keys = made.groupBy("name", "id", "hash").agg(F.count("*").alias("n"), F.min(F.struct("size", "sketch")).alias("bits"))
    firsts = cut(keys.groupBy("name").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "hash", "n", "bits")).alias("first")))
    found = links(firsts.select("name", "first.bits.size", "first.bits.sketch"))
    ranks = firsts.select(F.col("name").alias("node"), F.struct("first.none", "first.id", "first.hash", "first.n").alias("rank"))
    reached = smallest_reachable(found, ranks)
    kept = cut(reached.select("smallest.*").distinct().select(F.col("id").alias(kept_ident), F.col("hash").alias(kept_same), F.col("n").alias(times)))
    drop(made, firsts, found)
    named = docs.withColumns(key)

    def of(some: DataFrame) -> DataFrame:
        return named.join(some, F.col(ident).eqNullSafe(F.col(kept_ident)) & (F.col(same) == F.col(kept_same)), "left_semi")

    repeated = kept.where(F.col(times) > 1)
    if repeated.isEmpty():
        return of(kept).select(docs.columns)
    return of(kept.where(F.col(times) == 1)).unionByName(of(repeated).dropDuplicates([ident, same])).select(docs.columns)

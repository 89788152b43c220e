"""SimHash near-duplicates by tables of distances to reference fingerprints.

The 64 bits are seen through five blocks.  A row of the table holds, for each
block, the Hamming distances to the reference fingerprints within that block;
their sums are the distances over all bits.  Two fingerprints with at most two
different bits agree in three blocks at least, hence in all coordinates of these
blocks: that is the join key (ten choices of three blocks).  In a bucket, pairs
with a coordinate that differs by more than two are discarded, and the rest are
verified bit by bit.  A bucket that is too large is cut again in the same way
through the bits outside its three blocks, so no bucket is compared whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import partitions, small_enough, store, table
from .components import components

SHINGLE, RADIUS = 3, 2
#: Reference fingerprints: REFERENCES in the join keys, TABLE in the table that discards pairs.
REFERENCES, TABLE = 5, 16
#: Distinct fingerprints in a bucket that are compared as they are.
BUCKET = 512
_M64 = (1 << 64) - 1


def _reference(n: int) -> int:
    """The n-th reference fingerprint (a fixed mixing of n)."""
    x = (n + 1) * 0x9E3779B97F4A7C15 & _M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M64
    return x ^ x >> 31


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, as an unsigned number; 0 for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    k = min(shingle, len(w))
    flat = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed = xxhash.xxh64_intdigest
    n = len(w) - k + 1
    bits = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.fromiter((hashed(flat[a:b], 42) for a, b in zip(starts[lo:hi].tolist(), ends[lo + k - 1:hi + k - 1].tolist())), "<u8", hi - lo)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, shingle)) for t in s], dtype="int64")
    return run(text.cast("string"))


def _masks(bits: list[int], n: int) -> list[int]:
    """The given bit places cut into n blocks."""
    cut = np.array_split(np.array(bits), n)
    return [sum(1 << int(b) for b in c) for c in cut]


BLOCKS = _masks(list(range(64)), 5)
TRIPLES = list(combinations(range(5), 3))


def _coordinates(fp: Column, masks: list[int]) -> Column:
    """Distances to the reference fingerprints within each of the blocks, as the digits of one number."""
    out = F.lit(0).cast("long")
    for m in masks:
        for j in range(REFERENCES):
            out = out * 14 + F.bit_count(fp.bitwiseXOR(F.lit(_signed(_reference(j))).cast("long")).bitwiseAND(F.lit(_signed(m)).cast("long")))
    return out


def _keys(fps: DataFrame) -> DataFrame:
    """``combo, key, fp``: ten rows for each fingerprint."""
    each = [F.struct(F.lit(c).alias("combo"), _coordinates(F.col("fp"), [BLOCKS[b] for b in t]).alias("key")) for c, t in enumerate(TRIPLES)]
    return fps.select("fp", F.explode(F.array(*each)).alias("k")).select("k.combo", "k.key", "fp")


def _finer(rows: DataFrame) -> DataFrame:
    """``combo, key, fp`` of rows in large buckets: the bits outside the three blocks, cut into five blocks again."""
    choices = []
    for c, t in enumerate(TRIPLES):
        free = _masks([b for b in range(64) if not any(BLOCKS[x] >> b & 1 for x in t)], 5)
        choices.append(F.array(*[F.struct(F.lit(100 + c * 10 + d).alias("combo"), F.xxhash64("key", _coordinates(F.col("fp"), [free[x] for x in s])).alias("key"))
                                 for d, s in enumerate(TRIPLES)]))
    pick = choices[0]
    for c in range(1, 10):
        pick = F.when(F.col("combo") == c, choices[c]).otherwise(pick)
    return rows.select("fp", F.explode(pick).alias("k")).select("k.combo", "k.key", "fp")


def _links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (member, smallest member) of the groups within a bucket of distinct fingerprints."""
    u = fps.view(np.uint64)
    refs = np.array([_reference(j) for j in range(TABLE)], np.uint64)
    far = np.bitwise_count(u[:, None] ^ refs).astype(np.int8)
    root = np.arange(len(u))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(u) - 1):
        near = i + 1 + np.flatnonzero((np.abs(far[i + 1:] - far[i]) <= radius).all(1))
        for j in near[np.bitwise_count(u[near] ^ u[i]) <= radius]:
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    group = [find(i) for i in range(len(u))]
    return [(int(fps[i]), int(fps[g])) for i, g in enumerate(group) if g != i]


def _bucket_edges(batches, radius: int):
    """Rows arrive sorted by combo and key; a bucket can go on in the next batch."""
    held: list[np.ndarray] = []
    last = None

    def close(parts):
        fps = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        return _links(fps, radius) if len(fps) > 1 else []

    def out(edges):
        a = np.array(edges, np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])

    for batch in batches:
        combo, key, fp = (batch.column(i).to_numpy() for i in range(3))
        if not len(fp):
            continue
        edges = []
        cut = np.flatnonzero((np.diff(combo) != 0) | (np.diff(key) != 0)) + 1
        for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])):
            mine = (combo[a], key[a])
            if mine != last:
                edges += close(held)
                held, last = [], mine
            held.append(fp[a:b])
        if edges:
            yield out(edges)
    edges = close(held)
    if edges:
        yield out(edges)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: edges that connect all distinct fingerprints with at most ``radius`` (2 or less) different bits."""
    if radius > 2:
        raise ValueError("three of five blocks agree only up to two different bits")
    rows = store(_keys(fps), "simhash-keys")
    hot = store(rows.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("combo", "key"), "simhash-hot")
    if hot.limit(1).count():
        side = F.broadcast(hot) if small_enough(hot, 100_000) else hot
        rows = rows.join(side, ["combo", "key"], "left_anti").unionByName(_finer(rows.join(side, ["combo", "key"], "left_semi")))
    placed = rows.repartition(partitions(fps.sparkSession), "combo", "key").sortWithinPartitions("combo", "key")
    return placed.mapInArrow(lambda b: _bucket_edges(b, radius), "u long, v long")


def _rooted(marked: DataFrame, doc_id: Column, radius: int) -> DataFrame:
    """``fp, first, root``: the smallest id of each distinct fingerprint and the root of its group."""
    fps = store(marked.groupBy("fp").agg(F.min(doc_id).alias("first")), "simhash-fps")
    roots = components(fingerprint_links(fps.select("fp"), radius))
    return store(fps.join(roots, fps["fp"] == roots["u"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def fingerprint_groups(marked: DataFrame, doc_id: Column, radius: int = RADIUS) -> DataFrame:
    """``fp, root, component_id`` for every distinct ``fp`` of ``marked``; the id is the smallest of the group's rows."""
    rooted = _rooted(marked, doc_id, radius)
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fp", "root").join(ids, "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Null and empty texts have fingerprint zero and link like any other.  Repeated
    rows come out repeated.  A group whose ids are all null has a null id.
    """
    marked = store(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint_column(F.col(f"`{text}`"), shingle).alias("fp")), "simhash")
    groups = fingerprint_groups(marked, F.col("doc_id"), radius)
    return marked.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group: that with the smallest id; of rows that share it, one.  A group without ids keeps one row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), fingerprint_column(F.col(f"`{text}`"), shingle).alias("fp"))
    rows = store(rows, "simhash-rows")
    rooted = _rooted(rows, F.col("row")[doc_id], radius)
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("b"))
    kept = best.select(F.col("b.fp").alias("fp"), F.struct(F.col("b.first").alias("id")).alias("id"))
    # a struct of a null equals another, and the rows are shuffled once: by what joins and groups them
    mine = rows.withColumn("id", F.struct(F.col("row")[doc_id].alias("id"))).join(kept, ["fp", "id"])
    return mine.groupBy("fp", "id").agg(F.first("row").alias("row")).select("row.*")


def op5_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

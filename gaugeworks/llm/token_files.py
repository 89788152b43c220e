"""Token-id files: documents in order, as segments of independently coded blocks.

A file is one partition's Parquet file; a row is a segment of consecutive whole
documents: their ids, their token counts, and the blocks that hold their tokens
end to end (format of ``lanes``: each block is reset and carries a checksum).
Spark's writers commit the files, so a lost executor leaves no half file.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import lanes
from .common import partitions, shared_dir, table
from .vocab import encoder, slices, vocabulary

END = 2
#: A segment ends with the document that fills this many blocks.
SEGMENT_BLOCKS = 32
SEGMENT_SCHEMA = "part int, segment int, first long, doc_ids array<long>, counts array<long>, blocks array<binary>"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class _Segments:
    """Collects documents and codes the blocks of many segments at once."""

    def __init__(self):
        self.part, self.made, self.first = TaskContext.get().partitionId(), 0, 0
        self.docs, self.tokens, self.done, self.blocks = [], 0, [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.tokens += len(ids)
        if self.tokens >= SEGMENT_BLOCKS * lanes.BLOCK:
            self.close()

    def close(self) -> None:
        if self.docs:
            ids = np.concatenate([x for _, x in self.docs])
            cut = [ids[i:i + lanes.BLOCK] for i in range(0, len(ids), lanes.BLOCK)]
            self.done.append(([d for d, _ in self.docs], [len(x) for _, x in self.docs], cut))
            self.blocks += len(cut)
            self.docs, self.tokens = [], 0

    def coded(self) -> pa.RecordBatch:
        codes = iter(lanes.encode_blocks([b for *_, cut in self.done for b in cut]))
        rows = []
        for doc_ids, counts, cut in self.done:
            rows.append((self.part, self.made, self.first, doc_ids, counts, [next(codes) for _ in cut]))
            self.made, self.first = self.made + 1, self.first + sum(counts)
        self.done, self.blocks = [], 0
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        names = [f.split()[0] for f in SEGMENT_SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _encode(batches, path: str, spaced: bool, folded: bool, end: int):
    enc, out = encoder(path, spaced, folded), _Segments()
    for batch in batches:
        for part in slices(batch, "text"):
            ids, count = enc.with_end(part.column(part.schema.get_field_index("text")), end)
            at = 0
            for doc_id, n in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), count.tolist()):
                out.add(doc_id, ids[at:at + n])
                at += n
            if out.blocks >= lanes.LANES:
                yield out.coded()
    out.close()
    if out.done:
        yield out.coded()


def write_ids(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, spaced: bool = False,
              folded: bool = True, end: int = END) -> None:
    """Write the ids of all documents to ``folder``, in ascending order of document.

    Null ids come first, null text is empty, rows of one id are ordered by their
    text's hash, so that a repeated task writes the same file and rows of one id
    can lie in several partitions.
    """
    path = path or vocabulary("word_bpe_49k.json")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    tie = F.xxhash64("text")
    placed = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    placed.mapInArrow(lambda b: _encode(b, path, spaced, folded, end), SEGMENT_SCHEMA).write.option("compression", "none").parquet(folder)


def _decode(batches, starts: dict[int, int]):
    waiting, blocks = [], 0

    def flush():
        nonlocal blocks
        ids = iter(lanes.decode_blocks([b for *_, codes in waiting for b in codes]))
        rows = []
        for part, first, doc_ids, counts, codes in waiting:
            flat = np.concatenate([next(ids) for _ in codes])
            at = 0
            for d, n in zip(doc_ids, counts):
                rows.append((d, starts[part] + first + at, n, zlib.crc32(flat[at:at + n].tobytes())))
                at += n
        waiting.clear()
        blocks = 0
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=[f.split()[0] for f in DOC_SCHEMA.split(", ")])

    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            codes = cols["blocks"][i].as_py()
            waiting.append((cols["part"][i].as_py(), cols["first"][i].as_py(), cols["doc_ids"][i].as_py(), cols["counts"][i].as_py(), codes))
            blocks += len(codes)
            if blocks >= lanes.LANES:
                yield flush()
    if waiting:
        yield flush()


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Decode every block and return one row per document (see DOC_SCHEMA).

    ``start`` counts the ids of all documents before it: the totals of the files
    (one number for each) go to every task.
    """
    rows = spark.read.schema(SEGMENT_SCHEMA).parquet(folder)
    totals = rows.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    starts, at = {}, 0
    for r in sorted(totals):
        starts[r["part"]] = at
        at += r["n"]
    return rows.select("part", "first", "doc_ids", "counts", "blocks").mapInArrow(lambda b: _decode(b, starts), DOC_SCHEMA)


def op1_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), folder)
    return read_ids(spark, folder)

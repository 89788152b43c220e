"""Token counts of documents in flat, unindexed token files, by a search for the end-of-document id.

A file is nothing but ids, 16 or 32 bits each, every document closed by the end
id.  Files are searched in blocks; a running maximum over the blocks of a file
tells each block where the document began that is open at its start.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_dir, store, table
from .vocab import encoder, slices, vocabulary

END, WIDTH = 50256, 2
#: Ids in a block.
BLOCK = 1 << 20
ORDER_SCHEMA = "file int, ordinal long, doc_id long"
BLOCK_SCHEMA = "file int, block int, n_ids long, ends array<long>"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _name(file: int) -> str:
    return f"tokens-{file:06d}.bin"


def _write(batches, folder: str, path: str, spaced: bool, folded: bool, end: int, width: int):
    files, root = _open(folder)
    enc, file, ordinal = encoder(path, spaced, folded, special=False), TaskContext.get().partitionId(), 0
    files.create_dir(root, recursive=True)
    own = f"{root}/_{uuid.uuid4().hex}"  # renamed once whole, so a repeated task replaces the file by the same one
    with files.open_output_stream(own) as sink:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, count = enc.with_end(part.column(part.schema.get_field_index("text")), end)
                if width == 2 and len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("ids beyond 16 bits need width=4")
                sink.write(ids.astype(f"<u{width}").tobytes())
                n = len(count)
                yield pa.record_batch([pa.array(np.full(n, file, np.int32)), pa.array(np.arange(ordinal, ordinal + n)),
                                       part.column(part.schema.get_field_index("doc_id"))], names=["file", "ordinal", "doc_id"])
                ordinal += n
    files.move(own, f"{root}/{_name(file)}")


def write_flat(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, spaced: bool = True,
               folded: bool = False, end: int = END, width: int = WIDTH) -> DataFrame:
    """Write one flat file of ids for each partition; returns which document is the n-th of which file.

    ``folder`` must be one that all executors share and pyarrow can open.  Null
    text is an empty document (the end id alone).
    """
    path = path or vocabulary("byte_bpe_50k.json")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return store(rows.mapInArrow(lambda b: _write(b, folder, path, spaced, folded, end, width), ORDER_SCHEMA), "token-order")


def _search(batches, folder: str, end: int, width: int, size: int):
    files, root = _open(folder)
    for batch in batches:
        for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with files.open_input_file(f"{root}/{_name(file)}") as f:
                f.seek(block * size * width)
                ids = np.frombuffer(f.read(size * width), f"<u{width}")
            ends = np.flatnonzero(ids == end) + 1 + block * size
            yield pa.record_batch([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)]),
                                   pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "n_ids", "ends"])


def count_tokens(spark: SparkSession, folder: str, end: int = END, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """``file, ordinal, start, n_tokens, closed`` of every document in the files of a folder.

    ``start`` counts the ids of all files before it; the count includes the end
    id.  Ids behind the last end of a file form a document that is not closed.
    """
    files, root = _open(folder)
    sizes = []
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith("tokens-"):
            if info.size % width:
                raise ValueError(f"{info.base_name} is not a whole number of ids")
            sizes.append((int(info.base_name[7:-4]), info.size // width))
    listed = spark.createDataFrame(sizes, "file int, n_ids long")
    blocks = listed.where("n_ids > 0").select("file", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_ids - 1) div {block} as int)"))).alias("block"))
    found = blocks.repartition(max(1, min(len(sizes) * 4, 4096)), "file", "block").mapInArrow(lambda b: _search(b, folder, end, width, block), BLOCK_SCHEMA)
    found = store(found, "token-ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (found.withColumn("open", F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(0).cast("long")))
                .withColumn("first", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0).cast("long"))))
    docs = stitched.select("file", "open", "first", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.get("ends", F.col("i") - 1)).alias("begin"), "end", F.lit(True).alias("closed"))
    last = found.groupBy("file").agg(F.coalesce(F.max(F.array_max("ends")), F.lit(0).cast("long")).alias("begin"), F.sum(F.size("ends")).alias("ordinal"), F.sum("n_ids").alias("end"))
    tail = last.where("begin < end").select("file", "ordinal", "begin", "end", F.lit(False).alias("closed"))
    totals = listed.select(F.col("file").alias("_file"), (F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")).alias("base"))
    return docs.unionByName(tail).join(totals, F.col("file") == F.col("_file")).select(
        "file", "ordinal", (F.col("base") + F.col("begin")).alias("start"), (F.col("end") - F.col("begin")).alias("n_tokens"), "closed")


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "flat-tokens")
    order = write_flat(table(spark, sf_dir, "documents"), folder)
    counts = count_tokens(spark, folder)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")

"""Packing by vector bin packing: the dot product of what an example asks and what a sequence has left decides."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vocab import encoder, slices, vocabulary

LENGTH, SEGMENTS = 2048, 256
#: Examples that wait for a place; sequences are closed while more than half of them wait.
POOL = 4096
END = 1
#: Bytes of text that are encoded at a time; an executor's workers hold the indices of all its tokens.
PART = 2 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ITEM_SCHEMA = "item_id string, n_tokens long, n_loss long, sequence_id long, offset long"


class Pool:
    """Waiting examples as vectors (tokens, segments = 1, loss-bearing tokens) and the sequences made of them.

    A sequence takes, of the examples that fit into all that it has left, the one
    with the largest dot product of its vector and the rest (each dimension in
    shares of its limit, weighted by its mean demand); of equals the one that came
    first.  If none fits and ``cut`` allows it, the best one is cut to the tokens
    that are left.  Examples of one vector wait together, so a choice looks at the different vectors only.
    """

    def __init__(self, length: int, segments: int, loss: int, cut: bool, pool: int = POOL):
        self.limit, self.cut, self.pool = np.array([length, segments, loss], np.int64), cut, pool
        self.need, self.count = np.zeros((64, 3)), np.zeros(64, np.int64)
        self.wait: list[list] = []
        self.slot: dict[tuple[int, int], int] = {}
        self.came = self.waiting = 0

    def _put(self, tokens: int, loss: int, entry) -> None:
        i = self.slot.get((tokens, loss))
        if i is None:
            if len(self.wait) == len(self.need):
                self._drop()
            i = self.slot[tokens, loss] = len(self.wait)
            self.need[i], self.count[i] = (tokens, 1, loss), 0
            self.wait.append([])
        heapq.heappush(self.wait[i], entry)
        self.count[i] += 1

    def _drop(self) -> None:
        """Room for more vectors: those that nothing bears any more go, and if half are borne there is twice the room."""
        keep = np.flatnonzero(self.count[:len(self.wait)])
        size = len(self.need) * (2 if 2 * len(keep) > len(self.need) else 1)
        need, count = np.zeros((size, 3)), np.zeros(size, np.int64)
        need[:len(keep)], count[:len(keep)] = self.need[keep], self.count[keep]
        self.need, self.count, self.wait = need, count, [self.wait[i] for i in keep]
        self.slot = {(int(t), int(l)): i for i, (t, _, l) in enumerate(need[:len(keep)].tolist())}

    def add(self, tokens: int, loss: int, what) -> None:
        self._put(tokens, loss, (self.came, what))
        self.came, self.waiting = self.came + 1, self.waiting + 1

    def _best(self, among: np.ndarray, worth: np.ndarray) -> int:
        """The vector of the largest dot product; of equals the one whose first example came first."""
        score = self.need[among] @ worth
        top = among[score == score.max()]
        return int(top[0]) if len(top) == 1 else min(top.tolist(), key=lambda i: self.wait[i][0][0])

    def sequence(self):
        """The next sequence: a list of (what, tokens taken, whether a rest waits on)."""
        left, out = self.limit.copy(), []
        n = len(self.wait)
        weight = self.count[:n] @ self.need[:n] / max(self.waiting, 1) / self.limit ** 2.0
        while left.min() > 0 and self.waiting:
            n = len(self.wait)
            live = self.count[:n] > 0
            fits = np.flatnonzero(live & (self.need[:n, 0] <= left[0]) & (self.need[:n, 2] <= left[2]))
            if not len(fits) and not self.cut:
                break
            i = self._best(fits if len(fits) else np.flatnonzero(live), weight * left)
            came, what = heapq.heappop(self.wait[i])
            self.count[i] -= 1
            tokens, _, loss = (int(v) for v in self.need[i])
            if len(fits):
                self.waiting -= 1
                out.append((what, tokens, False))
                left -= (tokens, 1, loss)
            else:
                take = int(min(left[0], left[2]))
                out.append((what, take, True))
                self._put(tokens - take, loss - take, (came, what))
                left -= (take, 1, take)
        return out


def _powers(n: int):
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack_texts(batches, path: str, spaced: bool, folded: bool, end: int, length: int, segments: int):
    pool, enc = Pool(length, segments, length, cut=True), encoder(path, spaced, folded)
    made, rows = TaskContext.get().partitionId() << 36, []

    def place(pieces):
        """pieces: (doc, taken) in order; one sequence."""
        nonlocal made
        at = 0
        for doc, take in pieces:
            part = doc["ids"][doc["at"]:doc["at"] + take]
            rows.append((doc["id"], doc["at"], take, zlib.crc32(part.tobytes()), len(doc["ids"]), made, at))
            doc["at"] += take
            at += take
        made += 1

    def flush():
        cols = list(zip(*rows))
        rows.clear()
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

    for batch in batches:
        for part in slices(batch, "text", PART):
            ids, count = enc.with_end(part.column(part.schema.get_field_index("text")), end)
            ids, at = ids.astype("<u4"), 0
            for doc_id, n in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), count.tolist()):
                doc = {"id": doc_id, "ids": ids[at:at + n].copy(), "at": 0}
                at += n
                for _ in range(n // length):
                    place([(doc, length)])
                if n % length:
                    pool.add(n % length, n % length, doc)
                    if pool.waiting >= pool.pool:
                        while pool.waiting > pool.pool // 2:
                            place([(d, t) for d, t, _ in pool.sequence()])
            if rows:
                yield flush()
    while pool.waiting:
        got = [(d, t) for d, t, _ in pool.sequence()]
        total = sum(t for _, t in got)
        if pool.waiting or total == length:
            place(got)
            continue
        for size in _powers(total):  # the last one: sequences that need no padding
            part = []
            while size:
                d, t = got[0]
                take = min(t, size)
                part.append((d, take))
                got[0] = (d, t - take)
                size -= take
                if t == take:
                    got.pop(0)
            place(part)
    if rows:
        yield flush()


def pack_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, spaced: bool = True,
               folded: bool = False, end: int = END, length: int = LENGTH, segments: int = SEGMENTS) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens; one row per piece (see SCHEMA).

    Every token of a document bears loss.  Each input partition packs its own
    documents without a shuffle: whole sequences of a long document stand alone,
    rests wait in a bounded pool, the last sequence is cut into powers of two.
    Null text is empty (the end id alone); repeated rows are packed each.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    rows = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return rows.mapInArrow(lambda b: _pack_texts(b, path, spaced, folded, end, length, segments), SCHEMA)


def _pack_items(batches, length: int, segments: int, loss: int):
    pool, made, rows = Pool(length, segments, loss, cut=False), TaskContext.get().partitionId() << 36, []

    def place():
        nonlocal made
        at = 0
        for (key, n, n_loss), _, _ in pool.sequence():
            rows.append((key, n, n_loss, made, at))
            at += n
        made += 1

    def flush():
        cols = list(zip(*rows))
        rows.clear()
        return pa.record_batch([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[f.split()[0] for f in ITEM_SCHEMA.split(", ")])

    for batch in batches:
        for key, n, n_loss in zip(*[c.to_pylist() for c in batch.columns]):
            n, n_loss = n or 0, n_loss or 0
            if n > length or n_loss > loss:  # fits nowhere: a sequence of its own
                rows.append((key, n, n_loss, made, 0))
                made += 1
                continue
            pool.add(n, n_loss, (key, n, n_loss))
            if pool.waiting >= pool.pool:
                while pool.waiting > pool.pool // 2:
                    place()
        if rows:
            yield flush()
    while pool.waiting:
        place()
    if rows:
        yield flush()


def pack_items(items: DataFrame, item_id: str, tokens: str, loss: str, length: int = LENGTH, segments: int = SEGMENTS,
               max_loss: int = LENGTH) -> DataFrame:
    """Whole examples (instruction data) under three limits: tokens, segments and loss-bearing tokens.

    An example beyond a limit gets a sequence of its own; null counts are 0.
    """
    rows = items.selectExpr(f"cast(`{item_id}` as string) as item_id", f"cast(`{tokens}` as long) as n_tokens", f"cast(`{loss}` as long) as n_loss")
    return rows.mapInArrow(lambda b: _pack_items(b, length, segments, max_loss), ITEM_SCHEMA)


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))

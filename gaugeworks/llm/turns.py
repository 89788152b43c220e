"""Turns of conversations in a total order, and Arrow batches read as one sorted stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of one turn number are ordered by role, by this many first characters of the text, then by its digest:
#: texts themselves need not travel to be put in order.
HEAD = 32
ORDER = ["turn", "role", "_head", "_digest"]


def placed(df: DataFrame, conv: str, turn: str, role: str, text: str, absent: str, more: dict[str, Column] | None = None) -> DataFrame:
    """``conv_id, turn, role, text`` with null role and text replaced by ``absent``, and the columns of ``ORDER``."""
    q = lambda c: F.col(f"`{c}`")
    rows = df.select(q(conv).alias("conv_id"), q(turn).alias("turn"), F.coalesce(q(role).cast("string"), F.lit(absent)).alias("role"),
                     F.coalesce(q(text).cast("string"), F.lit(absent)).alias("text"), *[c.alias(n) for n, c in (more or {}).items()])
    return keyed(rows)


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_head": F.left("text", F.lit(HEAD)), "_digest": F.sha2("text", 256)})


def sorted_rows(batches) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, one after another."""
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def batched(rows, schema, size: int = 4096, most_chars: int = 1 << 24):
    """Row tuples as Arrow batches of bounded size."""
    import pyarrow as pa

    out, chars = [], 0
    for r in rows:
        out.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(out) >= size or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

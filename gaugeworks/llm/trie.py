"""Prefix trie of conversations by adaptive radix trees.

A turn is the first 16 bytes of a digest of its role and text, a conversation the
bytes of its turns one after another.  Spark sorts these keys (with the conversation
id, so that a conversation which many repeat is split too) into ranges; each task
builds the radix tree of a range and emits a row for every turn-aligned depth.
A depth can reach over a range only if it begins the last key of the range before
or the first key of the range after.  Those few nodes are emitted as parts, built so
that each number is a sum over ranges, and put together by their digest; all other
nodes are whole.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import partitions, small_enough, store, table
from .radix import Tree
from .turns import ORDER, batched, placed, sorted_rows

WIDTH = 16
#: Broadcast the nodes that several ranges share up to this many; beyond, join them.
BROADCAST_NODES = 20_000


def turn_lists(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: per conversation its turns in order, each an id (``WIDTH`` bytes in hex) and the text's length.

    Null role and text are empty; rows without a conversation id are in no
    conversation.  Rows of one turn number come by role and text.  Texts stay behind.
    """
    rows = placed(df, conv, turn, role, text, "").where(F.col("conv_id").isNotNull())
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    item = F.struct(*ORDER, F.left(name, F.lit(2 * WIDTH)).alias("id"), F.length("text").alias("size"))
    lists = rows.select("conv_id", item.alias("item")).groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return lists.select("conv_id", F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("turns"))


def with_shared_heads(lists: DataFrame, block: int = 100, ways: int = 6) -> DataFrame:
    """Each conversation c with the first crc32(c) % ``ways`` turns of conversation c - c % ``block`` in place of its own."""
    c = F.col("conv_id")
    heads = lists.where(F.pmod(c, F.lit(block)) == 0).select(c.alias("_base"), F.slice("turns", 1, ways - 1).alias("_head"))
    rows = lists.withColumns({"_base": c - F.pmod(c, F.lit(block)), "_h": (F.crc32(c.cast("string")) % ways).cast("int")})
    none = F.array().cast(lists.schema["turns"].dataType)
    first = F.coalesce(F.when(F.col("_h") > 0, F.slice("_head", 1, F.col("_h"))), none)
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return rows.join(heads, "_base", "left").select("conv_id", F.concat(first, own).alias("turns"))


def _ranges(lists: DataFrame) -> DataFrame:
    """The conversations dealt into ranges of (key, id): ``bucket, conv_id, key, sizes``, a table in the shared folder."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = lists.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    return store(rows.repartitionByRange(4 * partitions(lists.sparkSession), "key", "conv_id").withColumn("bucket", F.spark_partition_id()), "trie-ranges")


NODE = ("conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "node binary, parent binary, bucket int, ends string")


def name_of(prefix: bytes) -> bytes:
    return sha256(prefix).digest()[:WIDTH]


class _End:
    """Conversations that end at a key: how many, the smallest, and their ids as text or running digest."""

    __slots__ = ("count", "least", "ids", "digest")

    def __init__(self, shared: bool):
        self.count, self.least, self.ids, self.digest = 0, None, [] if shared else None, None if shared else sha256()

    def add(self, conv: int):
        if self.digest is None:
            self.ids.append(str(conv))
        else:
            self.digest.update(f"{',' if self.count else ''}{conv}".encode())
        self.count += 1
        self.least = conv if self.least is None else min(self.least, conv)


_NO_END = sha256().hexdigest()


def _nodes(tree: Tree, sizes: dict, before: bytes, after: bytes, bucket: int):
    """Rows of ``NODE`` for one range.

    ``before`` is the last key of the ranges below, ``after`` the first of those
    above.  A node that begins ``before`` was counted there as a distinct node; one
    that begins ``after`` gets its childlessness there.  A node's row is written when
    its parent is known, i.e. the walk keeps the children of open nodes.
    """
    key = bytearray()
    open_nodes = [[]]            # per radix node on the way down: what its children returned

    def shared(k: bytes) -> bool:
        return before.startswith(k) or after.startswith(k)

    def emit(k: bytes, n, least, below, end):
        """A trie node over the trie nodes ``below``: its row, whether it counts as distinct here, leaves and saving of its subtree."""
        counted = not before.startswith(k)
        children, leaves, saved = (sum(x[i] for x in below) for i in (2, 3, 4))
        if not below and not after.startswith(k):
            leaves += 1
        size = sizes[k[-WIDTH:]] if k else 0
        saved += n * size - (size if counted else 0)
        part = shared(k)
        row = [least, len(k) // WIDTH, None, n, children, leaves, saved,
               None if part else end.digest.hexdigest() if end else _NO_END, name_of(k) if part else None, None,
               bucket if part else None, ",".join(end.ids) if part and end else None]
        return row, int(counted), leaves, saved

    for node, start, down in tree.walk():
        if down:
            key += node.path
            open_nodes.append([])
            continue
        below = open_nodes.pop()          # (n, least, distinct, leaves, saved, row) of each child that begins here
        end = node.value
        n = sum(x[0] for x in below) + (end.count if end else 0)
        least = min([x[1] for x in below] + ([end.least] if end else []), default=None)
        stop = start + len(node.path)
        for depth in range(stop // WIDTH, -1, -1):   # the turn-aligned depths on this node's path, deepest first
            at = depth * WIDTH
            if at <= start and not (at == 0 and start == 0 and stop == 0):
                break
            k = bytes(key[:at])
            row, distinct, leaves, saved = emit(k, n, least, below, end if at == stop else None)
            for x in below:
                if row[8] is not None:
                    x[5][9] = row[8]
                else:
                    x[5][2] = least
                yield x[5]
            below = [(n, least, distinct, leaves, saved, row)]
        open_nodes[-1] += below
        del key[start:]
    for x in open_nodes[0]:
        yield x[5]


def _tries(rows):
    """One radix tree per bucket from rows (bucket, kind, conv_id, key, sizes): neighbours' keys first (kind 0 below, 1 above)."""
    at, tree, sizes, edge = None, None, {}, [b"", b""]

    for bucket, kind, conv, key, lengths in rows:
        if bucket != at:
            if at is not None:
                yield from _nodes(tree, sizes, *edge, at)
            at, tree, sizes, edge = bucket, Tree(), {}, [b"", b""]
        if kind < 2:
            edge[kind] = key
            continue
        node = tree.at(key)
        if node.value is None:
            node.value = _End(edge[0].startswith(key) or edge[1].startswith(key))
        node.value.add(conv)
        for i, n in enumerate(lengths):
            sizes[key[i * WIDTH:(i + 1) * WIDTH]] = n
    if at is not None:
        yield from _nodes(tree, sizes, *edge, at)


def _whole(rows):
    """Sums of the parts of one node, which come together and by bucket; the ids that end there are hashed as they come."""
    at, out, digest, any_end = None, None, None, False

    def done():
        if not out[1] and not out[4]:   # no turns in any range: the root is the only leaf
            out[5] = 1
        return *out[:7], digest.hexdigest(), at, out[7]

    for conv, depth, n, children, leaves, saved, node, parent, ends in rows:
        if node != at:
            if at is not None:
                yield done()
            at, out, digest, any_end = node, [conv, depth, None, 0, 0, 0, 0, parent], sha256(), False
        out[0] = min(out[0], conv)
        for i, x in ((3, n), (4, children), (5, leaves), (6, saved)):
            out[i] += x
        if ends:
            digest.update(f"{',' if any_end else ''}{ends}".encode())
            any_end = True
    if at is not None:
        yield done()


def prefix_trie(lists: DataFrame) -> DataFrame:
    """One row per distinct beginning of the conversations ``conv_id, turns`` (see ``turn_lists``), the empty one included.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.  No conversations,
    no rows.  A conversation without turns is a member of the root alone.
    """
    dealt = _ranges(lists)
    edges = dealt.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = W.orderBy("bucket")                                    # one row a range
    edges = edges.select("bucket", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    no_sizes = F.array().cast("array<int>")
    heads = edges.select("bucket", F.posexplode(F.array("before", "after")).alias("kind", "key")).where(F.col("key").isNotNull()).select(
        "bucket", "kind", F.lit(None).cast("long").alias("conv_id"), "key", no_sizes.alias("sizes"))
    rows = heads.unionByName(dealt.select("bucket", F.lit(2).alias("kind"), F.col("conv_id").cast("long").alias("conv_id"), "key", "sizes"))
    schema = T._parse_datatype_string(NODE)
    arrow = to_arrow_schema(schema)
    n = partitions(lists.sparkSession)
    together = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "key", "conv_id")
    found = store(together.mapInArrow(lambda b: batched(_tries(sorted_rows(b)), arrow), schema), "trie-nodes")

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    sums = T.StructType([*schema.fields[:8], schema["node"], schema["parent"]])
    sums_arrow = to_arrow_schema(sums)
    parts = found.where(F.col("node").isNotNull()).repartition("node").sortWithinPartitions("node", "bucket").select(
        "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "node", "parent", "ends")
    shared = store(parts.mapInArrow(lambda b: batched(_whole(sorted_rows(b)), sums_arrow), sums), "trie-shared")

    parents = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("_least"))
    if small_enough(parents, BROADCAST_NODES):
        parents = F.broadcast(parents)
    whole = found.where(F.col("node").isNull())
    under = whole.where(F.col("parent").isNotNull()).select(*names, "parent").unionByName(shared.select(*names, "parent"))
    under = under.join(parents, "parent", "left").withColumn("parent_conv_id", F.col("_least"))
    out = whole.where(F.col("parent").isNull()).select(*names).unionByName(under.select(*names))
    return out.withColumn("depth", F.col("depth").cast("long"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(turn_lists(table(spark, sf_dir, "conversations"))))

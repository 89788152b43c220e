"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A conversation of n rows is a lattice of n + 1 columns with four states (nothing
yet, after system, after user, after assistant).  Keeping, re-roling or deleting
a row leads to the next column, inserting an empty turn stays in the column.  A
forward search from the empty start and a reverse search from the legal ends meet;
they go on until no crossing of the least cost can be missing, and the least audit
string among the crossings wins.

Spark brings each conversation's rows together in order, twice: the first time
without texts (one code a row, from which the lattice is solved), the second time
with them, behind the audit.  Both are streams: a task holds one byte of each row of
the conversation it is at, never its texts.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table, trimmed
from .turns import ORDER, batched, placed, sorted_rows

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5   # costs
START, SYSTEM, USER, ASSISTANT = range(4)                 # states, and classes of role initials with 0 for any other
STEP = {START: {SYSTEM: SYSTEM, USER: USER}, SYSTEM: {USER: USER}, USER: {ASSISTANT: ASSISTANT}, ASSISTANT: {USER: USER}}
#: The role that re-roling and inserting give, by the state before.
GIVEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
FINE, BLANK, DUPLICATE, CUT = range(4)                    # faults; a row's code is 4 * class + fault
GONE = 255                                                # a row that only keeps its conversation in the result


def _edges(codes: bytes, i: int, q: int):
    """``(column, state, cost, letter)`` of each edge out of a node."""
    g = GIVEN[q]
    yield i, g, INSERT, "I"
    if i < len(codes):
        yield i + 1, q, DELETE, "D"
        role, fault = divmod(codes[i], 4)
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            if role in STEP[q]:
                yield i + 1, role, KEEP + more, "K"
            yield i + 1, g, REROLE + more, "R"


def _edges_into(codes: bytes, j: int, q: int):
    """``(column, state, cost, letter)`` of each node with an edge to this one."""
    for p in range(4):
        if GIVEN[p] == q:
            yield j, p, INSERT, "I"
    if j:
        yield j - 1, q, DELETE, "D"
        role, fault = divmod(codes[j - 1], 4)
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            for p in range(4):
                if STEP[p].get(role) == q:
                    yield j - 1, p, KEEP + more, "K"
                if GIVEN[p] == q:
                    yield j - 1, p, REROLE + more, "R"


def _before(a, b) -> bool:
    """Whether path ``a`` spells less than path ``b``; a path is (path before, letter, length)."""
    x, y = [], []
    while a is not b:
        step_a, step_b = a[2] >= b[2], b[2] >= a[2]
        if step_a:
            x.append(a[1])
            a = a[0]
        if step_b:
            y.append(b[1])
            b = b[0]
    return x[::-1] < y[::-1]


def _forward_letters(path) -> str:
    out = []
    while path[0] is not None:
        out.append(path[1])
        path = path[0]
    return "".join(reversed(out))


@lru_cache(maxsize=2048)
def cheapest(codes: bytes) -> tuple[int, str]:
    """Least cost of a legal conversation and the least audit of that cost.

    At one node and cost no path is a beginning of another (inserts cost), so the
    least path to a node stays least whatever follows; and two ways on from a node
    differ in their first letter.  Edges without cost lead to the next column, so at
    one cost the forward heap goes by rising, the reverse heap by falling column.
    """
    n = len(codes)
    goals = ((n, START), (n, ASSISTANT))
    ahead = {(0, START): (0, (None, "", 0))}                # node -> cost, path
    back = {g: (0, "", None) for g in goals}                # node -> cost, letter, next node
    done_ahead, done_back = set(), set()
    heap_ahead, heap_back = [(0, 0, START)], [(0, -n, q) for _, q in goals]
    best = min((ahead[g][0] for g in goals if g in ahead), default=float("inf"))
    while heap_ahead or heap_back:
        top_ahead = heap_ahead[0][0] if heap_ahead else float("inf")
        top_back = heap_back[0][0] if heap_back else float("inf")
        if top_ahead + top_back > best:
            break
        if top_back <= top_ahead:
            cost, i, q = heappop(heap_back)
            node = (-i, q)
            if node in done_back:
                continue
            done_back.add(node)
            for j, p, c, letter in _edges_into(codes, -i, q):
                old = back.get((j, p))
                if old is None or (cost + c, letter) < old[:2]:
                    back[j, p] = (cost + c, letter, node)
                    if old is None or cost + c < old[0]:
                        heappush(heap_back, (cost + c, -j, p))
                if (j, p) in ahead:
                    best = min(best, ahead[j, p][0] + cost + c)
        else:
            cost, i, q = heappop(heap_ahead)
            node = (i, q)
            if node in done_ahead:
                continue
            done_ahead.add(node)
            path = ahead[node][1]
            for j, p, c, letter in _edges(codes, i, q):
                old, new = ahead.get((j, p)), (path, letter, path[2] + 1)
                if old is None or cost + c < old[0] or (cost + c == old[0] and _before(new, old[1])):
                    ahead[j, p] = (cost + c, new)
                    if old is None or cost + c < old[0]:
                        heappush(heap_ahead, (cost + c, j, p))
                if (j, p) in back:
                    best = min(best, cost + c + back[j, p][0])

    def rest(node) -> str:
        out = []
        while back[node][2] is not None:
            out.append(back[node][1])
            node = back[node][2]
        return "".join(out)

    if (0, START) in done_back:
        return int(best), rest((0, START))
    crossings = [(v, letter, (j, p)) for v in done_ahead - done_back for j, p, c, letter in _edges(codes, *v)
                 if (j, p) in done_back and ahead[v][0] + c + back[j, p][0] == best]
    return int(best), min(_forward_letters(ahead[v][1]) + letter + rest(w) for v, letter, w in crossings)


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _summary(codes: bytes, span: int, distinct: int) -> tuple:
    roles = [c >> 2 for c in codes]
    faults = [c & 3 for c in codes]
    illegal = sum((a, b) not in LEGAL for a, b in zip(roles, roles[1:]))
    return (span - distinct, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, *cheapest(codes))


def _audited(rows):
    at, first = None, True
    codes, low, high, distinct = bytearray(), None, None, 0
    for conv, turn, code in rows:
        if first or conv != at:
            if not first:
                yield at, *_summary(bytes(codes), 0 if low is None else high - low + 1, distinct)
            at, first, codes, low, high, distinct = conv, False, bytearray(), None, None, 0
        if code == GONE:
            continue
        codes.append(code)
        if turn is not None:
            low = turn if low is None else low
            distinct += turn != high
            high = turn
    if not first:
        yield at, *_summary(bytes(codes), 0 if low is None else high - low + 1, distinct)


def _coded(rows: DataFrame) -> DataFrame:
    """Adds ``code`` and ``_nth`` (which copy of its role and text a row is)."""
    same = W.partitionBy("conv_id", "gone", "role", "_digest").orderBy("turn")
    last = F.right(trimmed(F.col("text")), F.lit(1))
    rows = rows.withColumn("_blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("_last", last).drop("text")
    rows = rows.withColumn("_nth", F.row_number().over(same))
    fault = F.when(F.col("_blank"), BLANK).when(F.col("_nth") > 1, DUPLICATE).when(~F.col("_last").isin(".", "!", "?"), CUT).otherwise(FINE)
    first = F.left("role", F.lit(1))
    role = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)
    return rows.withColumn("code", F.when(F.col("gone"), GONE).otherwise(role * 4 + fault).cast("int"))


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    flag = F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)
    return placed(df, conv, turn, role, text, " ", {"gone": flag})


def audits(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, least cost and audit.

    Null role or text counts as one space; rows come by turn, nulls first, then by
    role and text (see ``turns.HEAD``).  Rows whose ``gone`` column is true are left
    out, their conversation stays.  A null conversation id is a conversation.
    """
    rows = _coded(_rows(df, conv, turn, role, text, gone)).withColumn("turn", F.col("turn").cast("long"))
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(AUDIT).fields])
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "_nth").select("conv_id", "turn", "code")
    arrow = to_arrow_schema(schema)
    return dealt.mapInArrow(lambda batches: batched(_audited(sorted_rows(batches)), arrow), schema)


def _edited(rows):
    """From rows behind their conversation's audit: ("open", audit row), ("turn", role, text) ..., ("close",)."""
    state, audit, at, opened = START, "", 0, False

    def step(letter: str, role: str, text: str):
        nonlocal state
        if letter == "D":
            return None
        if letter == "K":
            state = STEP[state][INITIALS.index(role[:1]) + 1]
            return "turn", role, text
        state = GIVEN[state]
        return "turn", NAMES[state], text

    for conv, is_row, role, text, *found in rows:
        if not is_row:
            if opened:
                while at < len(audit):
                    yield step(audit[at], "", "")
                    at += 1
                yield ("close",)
            state, audit, at, opened = START, found[-1], 0, True
            yield "open", conv, found
            continue
        while audit[at] == "I":
            yield step("I", "", "")
            at += 1
        got = step(audit[at], role, text)
        at += 1
        if got:
            yield got
    if opened:
        while at < len(audit):
            yield step(audit[at], "", "")
            at += 1
        yield ("close",)


def _behind_audits(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """Audit rows and turns of each conversation together, the audit first, turns in order."""
    found = audits(df, conv, turn, role, text, gone)
    names = [c for c in found.columns if c != "conv_id"]
    rows = _rows(df, conv, turn, role, text, gone).where("not gone")
    nothing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ["role", "text", "turn", "_head", "_digest"]}
    both = found.withColumn("_row", F.lit(0)).withColumns(nothing).unionByName(
        rows.drop("gone").withColumn("_row", F.lit(1)).withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in names}))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_row", *ORDER).select("conv_id", "_row", "role", "text", *names)


def repaired_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The turns of each repaired conversation: ``conv_id, place`` (from 0)``, role, text``."""
    both = _behind_audits(df, conv, turn, role, text, gone)
    schema = T.StructType([both.schema["conv_id"], *T._parse_datatype_string("place long, role string, text string").fields])
    arrow = to_arrow_schema(schema)

    def turns(batches):
        at, place = None, 0
        for what, *x in filter(None, _edited(sorted_rows(batches))):
            if what == "open":
                at, place = x[0], 0
            elif what == "turn":
                yield at, place, *x
                place += 1

    return both.mapInArrow(lambda batches: batched(turns(batches), arrow), schema)


def repair_digests(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The columns of ``audits`` and ``repaired_sha256``, the digest of the repaired ``role:text`` lines."""
    both = _behind_audits(df, conv, turn, role, text, gone)
    schema = T.StructType([both.schema["conv_id"], *T._parse_datatype_string(AUDIT + ", repaired_sha256 string").fields])
    arrow = to_arrow_schema(schema)

    def digests(batches):
        from hashlib import sha256

        head, digest, first = None, None, True
        for what, *x in filter(None, _edited(sorted_rows(batches))):
            if what == "open":
                head, digest, first = (x[0], *x[1]), sha256(), True
            elif what == "turn":
                digest.update(f"{'' if first else chr(10)}{x[0]}:{x[1]}".encode("utf-8", "surrogatepass"))
                first = False
            else:
                yield *head, digest.hexdigest()

    return both.mapInArrow(lambda batches: batched(digests(batches), arrow), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Planted damage by crc32 of ``conv_id:turn``: dropped (``gone``), emptied, unpunctuated, repeated or re-roled rows."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
                                (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("_way"))
    text = F.when(F.col("_way") == 1, F.lit("")).when(F.col("_way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.withColumn("text", text).withColumn("role", F.when(F.col("_way") == 4, F.lit("user")).otherwise(F.col("role")))
    out = out.withColumn("gone", F.col("_way") == 0).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(F.col("_way") == 3, 1).otherwise(0))))
    return out.drop("_way", "_copy")


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(table(spark, sf_dir, "conversations")), gone="gone")

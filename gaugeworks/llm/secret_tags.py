"""Secrets by strict patterns and a linear-chain conditional random field.

Tokens are runs of letters and digits; the field tags each as the beginning of a
secret, inside one or outside, from its shape, the tokens and separators around it
and features of the whole file, and is decoded by Viterbi.  It is trained here: the
strict patterns label windows of the corpus, and copies of these windows with other
random values and other words in front teach it secrets which the patterns miss.
Spans of the patterns always stay; the field adds those that touch none of them.

Two passes over the texts, both without a shuffle of texts: one keeps a bounded
number of windows a task, of which the driver fits ``WINDOWS`` at most; one tags every
whole text, in NumPy over slices of a batch.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import store, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")
#: What any match of ASSIGN holds in lower case.
WORDS = ("passw", "secret", "token", "api_key", "apikey")

#: Most labelled windows (with a pattern's span, without) that the field is fitted on, and characters kept on each side.
WINDOWS, SIDE = (400, 600), 100
#: Characters of a value in such a window (all longer tokens have the same features).
LONGEST = 256
#: Rounds of fitting, step and weight decay.
ROUNDS, STEP, DECAY = 100, 0.2, 2e-6
#: Characters of the shortest span that the field may add.
SHORTEST = 8
#: Bytes tagged at a time (a longer text is one slice).
SLICE = 1 << 21

# Words that announce a secret, strongly or weakly (fixed values).
STRONG = "password passwd secret token key apikey pwd credential credentials bearer passphrase passcode".split()
WEAK = "api auth authorization private access client login pass pin code signature license".split()


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """``(start, kind, end, value start, value end)`` of the strict patterns, by start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if LONG_HEX.search(text):
        out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out)


# ------------------------------------------------------------------ tokens and features

def _table(groups) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for value, chars in groups:
        out[[ord(c) for c in chars]] = value
    return out


CLASS = _table(((1, string.ascii_lowercase), (2, string.ascii_uppercase), (3, string.digits)))
CLASS[128:] = 4
GAP = _table(((1, " "), (2, "\n\t\r\x0b\x0c"), (3, "="), (4, ":"), (5, "\"'`"), (6, "-"), (7, "_"), (8, "."), (9, "/"), (10, "+"), (11, "@"), (12, "([{<"), (13, ",;"))) 
GAP[(GAP == 0) & (CLASS == 0)] = 14
LENGTHS = np.array([2, 3, 4, 5, 7, 10, 13, 17, 25, 40, 64])
SIZES = (192, 40, 24, 60, 15, 18, 16, 16, 16, 60, 1)     # values of each feature
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])


def _packed(words) -> np.ndarray:
    return np.array([sum(b << 8 * i for i, b in enumerate(w.encode()[:7])) | min(len(w), 15) << 56 for w in words], np.uint64)


STRONG_CODES, WEAK_CODES = np.sort(_packed(STRONG)), np.sort(_packed(WEAK))


def _cues(buf, starts, length) -> np.ndarray:
    """0, 1 (strong) or 2 (weak) by a token's letters, in either case."""
    out = np.zeros(len(starts), np.int64)
    some = np.flatnonzero((length >= 3) & (length <= 15))
    code = length[some].astype(np.uint64) << np.uint64(56)
    for k in range(7):
        at = np.minimum(starts[some] + k, len(buf) - 1)
        code |= np.where(length[some] > k, buf[at] | 0x20, 0).astype(np.uint64) << np.uint64(8 * k)
    out[some[np.isin(code, WEAK_CODES)]] = 2
    out[some[np.isin(code, STRONG_CODES)]] = 1
    return out


def file_features(cls: np.ndarray, gap: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number below 16 for each text: its shares of symbols and of digits."""
    n = np.maximum(np.diff(bounds), 1)

    def share(flag):
        c = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return np.searchsorted([0.02, 0.08, 0.2], (c[bounds[1:]] - c[bounds[:-1]]) / n)
    return share(gap > 2) * 4 + share(cls == 3)


def features(buf: np.ndarray, bounds: np.ndarray, whole: np.ndarray | None = None):
    """Tokens of the texts ``buf[bounds[i]:bounds[i + 1]]``: first byte, end, text number and a row of feature numbers.

    ``whole`` gives the features of the files if the texts are parts of them.
    """
    cls = CLASS[buf]
    word = cls > 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    open_ = word.copy()
    open_[1:] &= ~word[:-1] | edge[1:len(buf)]
    starts = np.flatnonzero(open_)
    shut = word.copy()
    shut[:-1] &= ~word[1:] | edge[1:len(buf)]
    ends = np.flatnonzero(shut) + 1
    if not len(starts):
        return starts, ends, starts, np.zeros((0, len(SIZES)), np.int64)
    doc = np.searchsorted(bounds, starts, "right") - 1
    length = ends - starts
    per = lambda flag: np.add.reduceat(flag.astype(np.int32), starts)
    lower, upper, digit, high = (per(cls == k) for k in (1, 2, 3, 4))
    turn = np.zeros(len(buf), bool)
    turn[1:] = (cls[1:] != cls[:-1]) & word[1:] & word[:-1] & ~edge[1:len(buf)]
    changes = np.minimum(per(turn), 7)
    small = buf | 0x20
    letters = (cls == 1) | (cls == 2)
    beyond_hex = per(letters & (small > ord("f")))
    vowels = per(letters & np.isin(small, np.frombuffer(b"aeiou", np.uint8)))
    gap = GAP[buf]
    if whole is None:
        whole = file_features(cls, gap, bounds)

    n = len(starts)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    last = np.concatenate([first[1:], [True]])
    long_ = np.searchsorted(LENGTHS, length, "right")
    makeup = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (high > 0)
    share = lambda a: np.minimum(5 * a // length, 4)
    before = np.where(first, 0, gap[np.maximum(starts - 1, 0)])
    after = np.where(last, 0, gap[np.minimum(ends, len(buf) - 1)])
    space = np.where(first, 0, np.searchsorted([2, 3, 5], starts - np.concatenate([[0], ends[:-1]]), "right"))
    assigned = per((buf == ord("=")) | (buf == ord(":"))) > 0          # in the gap behind each token
    assigned = np.concatenate([[False], assigned[:-1]]) & ~first
    cue = _cues(buf, starts, length)
    shifted = lambda a, cut, by: np.where(cut, 0, np.roll(a, by))
    cue1 = shifted(cue, first, 1)
    second = first | np.concatenate([[True], first[:-1]])
    cue2 = shifted(cue, second, 2)
    cols = [makeup * 12 + long_, changes * 5 + share(digit), ((beyond_hex == 0) & (digit > 0) & (high == 0)) * 12 + long_, before * 4 + space, after,
            (assigned * 3 + cue1) * 3 + cue2, shifted(makeup, first, 1), shifted(makeup, last, -1), whole[doc], share(vowels) * 12 + long_, np.zeros(n, np.int64)]
    return starts, ends, doc, np.stack([c + o for c, o in zip(cols, OFFSETS)], axis=1).astype(np.int64)


# ------------------------------------------------------------------ the field

class Field:
    """Weights of the features for the tags outside, begin and inside, and of neighbouring tags."""

    def __init__(self):
        self.w = np.zeros((sum(SIZES), 3))
        self.t = np.zeros((3, 3))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = self.w[rows[:, 0]].copy()
        for j in range(1, rows.shape[1]):
            out += self.w[rows[:, j]]
        return out

    def fit(self, sequences) -> "Field":
        """Maximum likelihood with weight decay by Adam steps on (feature rows, tags) of windows; windows with and without a secret weigh the same in total."""
        size, m = max(len(y) for _, y in sequences), len(sequences)
        rows = np.zeros((m, size, len(SIZES)), np.int64)
        tags, here = np.zeros((m, size), int), np.zeros((m, size), bool)
        for i, (x, y) in enumerate(sequences):
            rows[i, :len(y)], tags[i, :len(y)], here[i, :len(y)] = x, y, True
        some = tags.any(axis=1)
        weight = np.where(some, 0.5 / max(1, some.sum()), 0.5 / max(1, (~some).sum()))
        flat, share = rows[here], np.repeat(weight, here.sum(axis=1))[:, None]
        gold = np.eye(3)[tags[here]]
        gold_t = np.zeros((m, 3, 3))
        before = np.concatenate([np.zeros((m, 1), int), tags[:, :-1]], axis=1)
        np.add.at(gold_t, (np.nonzero(here)[0], before[here], tags[here]), 1)
        mean = {k: np.zeros_like(v) for k, v in (("w", self.w), ("t", self.t))}
        square = {k: np.zeros_like(v) for k, v in mean.items()}
        for step in range(1, ROUNDS + 1):
            e = np.zeros((m, size, 3))
            e[here] = self.scores(flat)
            p, pt = _marginals(e, self.t, here)
            off = (p[here] - gold) * share
            grad_w = np.stack([np.bincount(flat.ravel(), np.repeat(off[:, k], flat.shape[1]), len(self.w)) for k in range(3)], axis=1)
            for name, v, g in (("w", self.w, grad_w), ("t", self.t, ((pt - gold_t) * weight[:, None, None]).sum(axis=0))):
                g = g + DECAY * v
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                v -= STEP * (mean[name] / (1 - 0.9 ** step)) / (np.sqrt(square[name] / (1 - 0.999 ** step)) + 1e-9)
        return self

    def possible(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Tokens that a best path may tag other than outside.

        Putting "outside" at a token costs at most the scores of its own tags plus
        what its two transitions could gain; what falls short of that is outside in
        every best path, and its neighbours' transitions are then known.
        """
        maybe = np.ones(len(e), bool)
        left = np.concatenate([[True], doc[1:] != doc[:-1]])      # the tag before is outside for certain
        right = np.concatenate([left[1:], [True]])
        ends = right
        for _ in range(4):
            now = np.zeros(len(e), bool)
            for y in (1, 2):
                into = np.where(left, self.t[0, y] - self.t[0, 0], (self.t[:, y] - self.t[:, 0]).max())
                out = np.where(right, self.t[y, 0] - self.t[0, 0], (self.t[y] - self.t[0]).max())
                out = np.where(ends, np.maximum(out, 0.0), out)   # no transition behind a text's last token
                now |= e[:, y] - e[:, 0] + into + out >= 0
            if (now == maybe).all():
                break
            maybe = now
            left = np.concatenate([[True], ~maybe[:-1] | (doc[1:] != doc[:-1])])
            right = np.concatenate([~maybe[1:] | (doc[1:] != doc[:-1]), [True]])
        return maybe

    def viterbi(self, e: np.ndarray, closed: bool) -> list[int]:
        """Best tags of a stretch behind an outside token, and in front of one if ``closed``."""
        best, back = self.t[0] + e[0], []
        for row in e[1:]:
            all_ = best[:, None] + self.t
            back.append(all_.argmax(0))
            best = all_.max(0) + row
        if closed:
            best = best + self.t[:, 0]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def spans(self, buf: np.ndarray, bounds: np.ndarray):
        """``(text number, first byte, end)`` of the tagged spans, in order."""
        starts, ends, doc, rows = features(buf, bounds)
        if not len(starts):
            return
        e = self.scores(rows)
        at = np.flatnonzero(self.possible(e, doc))
        if not len(at):
            return
        cut = np.flatnonzero((np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])) + 1
        for stretch in np.split(at, cut):
            a, b = stretch[0], stretch[-1] + 1
            tags = self.viterbi(e[a:b], b < len(doc) and doc[b] == doc[a])
            open_at = None
            for i, tag in enumerate([*tags, 0]):
                if open_at is not None and tag != 2:
                    yield int(doc[a]), int(starts[a + open_at]), int(ends[a + i - 1])
                    open_at = None
                if tag == 1 or (tag == 2 and open_at is None):
                    open_at = i


def _marginals(e: np.ndarray, t: np.ndarray, here: np.ndarray):
    """Probability of each tag at each place, and expected transitions of each window, by scaled forward and backward sums side by side."""
    m, size, _ = e.shape
    x, step = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(t)
    ahead, back = np.empty_like(e), np.ones_like(e)
    now = step[0] * x[:, 0]
    ahead[:, 0] = now / now.sum(1, keepdims=True)
    for i in range(1, size):
        now = (ahead[:, i - 1] @ step) * x[:, i]
        ahead[:, i] = np.where(here[:, i, None], now / now.sum(1, keepdims=True), ahead[:, i - 1])
    for i in range(size - 2, -1, -1):
        now = (x[:, i + 1] * back[:, i + 1]) @ step.T
        back[:, i] = np.where(here[:, i + 1, None], now / now.sum(1, keepdims=True), back[:, i + 1])
    p = ahead * back
    p /= p.sum(axis=2, keepdims=True)
    pt = np.zeros((m, 3, 3))
    for i in range(1, size):
        both = ahead[:, i - 1, :, None] * step * (x[:, i] * back[:, i])[:, None, :]
        pt += both / both.sum(axis=(1, 2), keepdims=True) * here[:, i, None, None]
    pt[:, 0] += p[:, 0]
    return p, pt


# ------------------------------------------------------------------ training windows

WINDOW = "labelled boolean, mark long, text string, cue_start int, value_start int, value_end int, file int"


def _file_number(text: str) -> int:
    buf = np.frombuffer(text.encode(), np.uint8)
    return int(file_features(CLASS[buf], GAP[buf], np.array([0, len(buf)]))[0])


def _windows(batches, schema):
    """At most twice ``WINDOWS`` rows a task: those of least mark, a checksum of the window, so copies count once."""
    import pyarrow as pa

    best: tuple[dict, dict] = {}, {}

    def offer(labelled: int, window: str, more):
        mark = zlib.crc32(window.encode())
        kept = best[labelled]
        kept.setdefault(mark, (window, *more()))
        if len(kept) > 2 * WINDOWS[1 - labelled]:
            for k in sorted(kept)[WINDOWS[1 - labelled]:]:
                del kept[k]

    for b in batches:
        for text in b.column(0).to_pylist():
            if not text:
                continue
            found = base_spans(text)
            for start, _, _, a, e in found:
                lo, stop = max(0, start - SIDE), min(e, a + LONGEST)
                offer(1, text[lo:stop] + text[e:e + SIDE], lambda: (start - lo, a - lo, stop - lo, _file_number(text)))
            if not found:
                lo = zlib.crc32(text[:64].encode()) % max(1, len(text) - SIDE)
                offer(0, text[lo:lo + 2 * SIDE], lambda: (0, 0, 0, _file_number(text)))
    rows = [(bool(k), mark, *r) for k in (0, 1) for mark, r in sorted(best[k].items())[:WINDOWS[1 - k]]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789ABCDEF", "0123456789abcdef", string.ascii_lowercase + string.digits)
ANNOUNCED = ("Authorization: Bearer ", "credential ", "pwd is ", "auth key: ", "client_secret ", "private key ", "pass = ", "")


HARMLESS = ("", "id: ", "key ", "see ", "https://www.host.org/", "name = ", "the ", "file: ", "(")


def _random_value(r: random.Random) -> str:
    value = "".join(r.choices(r.choice(ALPHABETS), k=r.randint(20, 48)))
    way = r.random()
    if way < 0.3:
        return "".join(r.choices(string.ascii_lowercase, k=r.randint(2, 4))) + r.choice("_-") + value
    if way < 0.4:
        return value[:len(value) // 2] + r.choice("._-") + value[len(value) // 2:]
    return value + "=" * (way > 0.9)


def _decoy(r: random.Random) -> str:
    """Something long that is no secret: a name of code, a path, a number, a date, an identifier with dashes."""
    words = ["".join(r.choices(string.ascii_lowercase, k=r.randint(3, 9))) for _ in range(r.randint(2, 5))]
    h = "".join(r.choices("0123456789abcdef", k=32))
    return r.choice(["".join(w.title() for w in words), "_".join(words), "/".join(words), ".".join(words), "-".join(words), str(r.randint(10**9, 10**18)),
                     f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T1{r.randint(0, 9)}:{r.randint(10, 59)}:{r.randint(10, 59)}Z",
                     f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}", "".join(words)])


def _sequence(text: str, values, number: int):
    """Feature rows and tags of one window; tokens inside a value are begin or inside."""
    buf = np.frombuffer(text.encode() or b" ", np.uint8)
    starts, _, _, rows = features(buf, np.array([0, len(buf)]), np.array([number]))
    tags = np.zeros(len(starts), int)
    for a, b in values:
        a, b = len(text[:a].encode()), len(text[:b].encode())
        inside = np.flatnonzero((starts >= a) & (starts < b))
        tags[inside] = 2
        tags[inside[:1]] = 1
    return rows, tags


def train(docs: DataFrame, text: str = "text") -> Field | None:
    """A field fitted on labelled windows of ``docs``; None if the patterns find nothing to learn from."""
    schema = T._parse_datatype_string(WINDOW)
    arrow = to_arrow_schema(schema)
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    found = store(texts.mapInArrow(lambda b: _windows(b, arrow), schema), "secret-windows").dropDuplicates(["labelled", "mark"])
    take = lambda labelled, n: found.where(F.col("labelled") == labelled).orderBy("mark").limit(n).collect()
    marked, plain = take(True, WINDOWS[0]), take(False, WINDOWS[1])
    if not marked:
        return None
    r, out = random.Random(11), []
    for w in sorted(marked, key=lambda w: (w["mark"], w["text"])):
        t, c, a, b = w["text"], w["cue_start"], w["value_start"], w["value_end"]
        out.append(_sequence(t, [(s[3], s[4]) for s in base_spans(t)] + [(a, b)], w["file"]))
        for _ in range(max(1, WINDOWS[0] // len(marked))):      # few windows give many copies
            for cue, behind in ((t[c:a], t[b:]), (r.choice(ANNOUNCED), r.choice([" ", "\n", ". ", ", "]) + t[b:].lstrip("\"' "))):
                v = _random_value(r)
                out.append(_sequence(t[:c] + cue + v + behind, [(c + len(cue), c + len(cue) + len(v))], w["file"]))
            out.append(_sequence(t[:c] + r.choice(HARMLESS) + _decoy(r) + t[b:], [], w["file"]))
    for w in sorted(plain, key=lambda w: (w["mark"], w["text"])):
        t, half = w["text"], len(w["text"]) // 2
        out.append(_sequence(t, [], w["file"]))
        out.append(_sequence(f"{t[:half]} {r.choice(HARMLESS)}{_decoy(r)} {t[half:]}", [], w["file"]))
        before, v = f"{t[:half]} {r.choice(ANNOUNCED)}", _random_value(r)
        out.append(_sequence(f"{before}{v} {t[half:]}", [(len(before), len(before) + len(v))], w["file"]))
    return Field().fit([s for s in out if len(s[1])])


# ------------------------------------------------------------------ all texts

def _added(field: Field, texts: list[str]):
    """For each text its field spans ``(start, kind, end)`` in code points."""
    out: list[list] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        raw, size, begin = [], 0, at
        while at < len(texts) and (not raw or size + len(texts[at]) <= SLICE):
            raw.append(texts[at].encode())
            size += len(raw[-1])
            at += 1
        if not size:
            continue
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        for doc, a, b in field.spans(np.frombuffer(b"".join(raw), np.uint8), bounds):
            own, low = raw[doc], int(bounds[doc])
            value = own[a - low:b - low].decode()
            if len(value) < SHORTEST:
                continue
            start = len(own[:a - low].decode())
            kind = 1 if value.startswith("AKIA") else 2 if HEX.fullmatch(value) else 0
            out[begin + doc].append((start, kind, start + len(value)))
    return out


def _spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Counts of the strict patterns, their digest and all spans of each row, every row once.

    Null text is empty and has no spans.  Spans of the field take the kind they look
    like: hex digits, an access key, else an assignment's value.  With no span of the
    patterns in all of ``docs`` there is nothing to learn from, and none is added.
    """
    field = field or train(docs, text)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(FOUND).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            more = _added(field, texts) if field else [[] for _ in texts]
            cols = [[], [], [], [], []]
            for t, added in zip(texts, more):
                base = [s[:3] for s in base_spans(t)]
                free = [s for s in added if not any(s[0] < e and a < s[2] for a, _, e in base)]
                for k in range(3):
                    cols[k].append(sum(s[1] == k for s in base))
                cols[3].append(sha256(_spelled(base).encode()).hexdigest())
                cols[4].append(_spelled(base + free))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.types[0]), *[pa.array(c, t) for c, t in zip(cols, arrow.types[1:])]], schema=arrow)

    return rows.mapInArrow(run, schema)


def op11_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))

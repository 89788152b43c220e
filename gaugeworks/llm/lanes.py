"""Adaptive context-mixing range coder for blocks of token ids, many blocks at a time.

Each block is a lane of NumPy vectors and starts from nothing, so blocks decode
alone.  For every token three contexts predict its id: the two ids before it
(order 2), the id before it (order 1) and the ids so far (order 0, brought up to
date whenever the history has doubled).  What comes true - order-2 id, order-1
id, an id of the history, a new id - is coded with a mixture of three adaptive
distributions whose weights follow how well each has done; an id of the history
is then coded by its count, a new one as it is.

Only integer and elementwise IEEE operations are used, so decoding repeats the
encoder's steps exactly on any machine.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Tokens in a block, lanes coded together.
BLOCK, LANES = 2048, 2048
#: The order-0 counts are taken anew at these positions.
EPOCHS = tuple(1 << k for k in range(6, 16))
_SLOTS = 1 << 10
_LOW, _MASK = 1 << 32, (1 << 32) - 1
_SCALE = 12
_RATE, _SHARE = 1 / 16, 0.02
_HEAD = np.dtype([("tokens", "<u4"), ("digits", "<u4"), ("crc", "<u4"), ("wide", "<u4")])


class _Model:
    """What encoder and decoder know of the tokens before position t, for all lanes.

    A slot of the order-1 and order-2 tables holds id * 8 + confidence (0: empty).
    """

    def __init__(self, lanes: int, wide: bool):
        self.lane = np.arange(lanes)
        kind = np.int64 if wide else np.int32
        self.order1, self.order2 = np.zeros(lanes * _SLOTS, kind), np.zeros(lanes * _SLOTS, kind)
        # rows of four float32 shares, moved as one 16-byte item
        self.p = [np.full((lanes * n, 4), 0.25, np.float32).view(np.complex128).ravel() for n in (16, 32, 16)]
        self.weight = np.full((3, lanes), 1 / 3, np.float32)
        self.prev, self.prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.epoch, self.bits = 0, 0
        self.sorted = self.first = self.count = None
        self.base = [self.lane * n for n in (_SLOTS, 16, 32, 4)]

    def renew(self, seen: np.ndarray) -> None:
        """Order-0 counts of the tokens so far (a power of two of them), as one sorted row for each lane."""
        n, size = seen.shape
        s = np.sort(seen, axis=1)
        new = np.ones((n, size), bool)
        new[:, 1:] = s[:, 1:] != s[:, :-1]
        place = np.broadcast_to(np.arange(size), (n, size))
        first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
        end = np.full((n, size), size)
        end[:, :-1] = np.where(new[:, 1:], place[:, 1:], size)
        end = np.minimum.accumulate(end[:, ::-1], axis=1)[:, ::-1]
        self.sorted, self.first, self.count = s, first, end - first
        self.bits = size.bit_length() - 1
        self.epoch += 1

    def predict(self, n: int) -> None:
        a, b = self.prev[:n], self.prev2[:n]
        mixed = a * 2654435761
        self.s1 = self.base[0][:n] + (mixed >> 15 & (_SLOTS - 1))
        self.s2 = self.base[0][:n] + (mixed + b * 3928791 >> 13 & (_SLOTS - 1))
        x1, x2 = self.order1[self.s1], self.order2[self.s2]
        self.c1, self.n1, self.c2, self.n2 = x1 >> 3, x1 & 7, x2 >> 3, x2 & 7
        same = self.c1 == self.c2
        self.at = (self.base[1][:n] + self.n2 * 2 + same, self.base[2][:n] + self.n1 * 4 + self.last[:n], self.base[1][:n] + min(self.epoch, 15))
        self.q = [p[at].view(np.float32).reshape(n, 4) for p, at in zip(self.p, self.at)]
        w = self.weight[:, :n]
        p = w[0] * np.ascontiguousarray(self.q[0].T)
        p += w[1] * np.ascontiguousarray(self.q[1].T)
        p += w[2] * np.ascontiguousarray(self.q[2].T)
        p *= np.float32((1 << _SCALE) - 4)
        f = p.astype(np.int64)
        f += 1
        f[2] = (1 << _SCALE) - f[0] - f[1] - f[3]
        self.f, self.cum = f, np.zeros_like(f)
        self.cum[1] = f[0]
        np.add(f[0], f[1], out=self.cum[2])
        np.add(self.cum[2], f[2], out=self.cum[3])

    def update(self, n: int, o: np.ndarray, ids: np.ndarray) -> None:
        flat = self.base[3][:n] + o
        w = self.weight[:, :n]
        for k in range(3):
            w[k] *= self.q[k].ravel()[flat]
        total = w[0] + w[1]
        total += w[2]
        np.divide(np.float32(1 - _SHARE), total, out=total)
        w *= total
        w += np.float32(_SHARE / 3)
        for p, at, q in zip(self.p, self.at, self.q):
            q *= np.float32(1 - _RATE)
            q.ravel()[flat] += np.float32(_RATE)
            p[at] = q.view(np.complex128).ravel()
        for table, slot, c, k in ((self.order1, self.s1, self.c1, self.n1), (self.order2, self.s2, self.c2, self.n2)):
            right = c == ids
            # right: one more, up to 7; wrong: two less, or the new id once little is left
            kept = (c << 3) + np.where(right, np.minimum(k + 1, 7), k - 2)
            table[slot] = np.where(right | (k > 2), kept, (ids << 3) + 1)
        self.prev2[:n], self.prev[:n], self.last[:n] = self.prev[:n].copy(), ids, o


def _order(lengths: np.ndarray) -> np.ndarray:
    return np.argsort(-lengths, kind="stable")


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """One checksummed byte string for each block of ids (below 2^32)."""
    out: list[bytes] = [b""] * len(blocks)
    for lo in range(0, len(blocks), LANES):
        part = blocks[lo:lo + LANES]
        lengths = np.array([len(b) for b in part], np.int64)
        order = _order(lengths)
        for i, code in zip(order, _encode([part[i] for i in order], lengths[order])):
            out[lo + i] = code
    return out


def _encode(blocks: list[np.ndarray], lengths: np.ndarray) -> list[bytes]:
    lanes, steps = len(blocks), int(lengths[0]) if len(lengths) else 0
    rows = np.zeros((lanes, steps), np.int64)
    for row, b in zip(rows, blocks):
        row[:len(b)] = b
    wide = int(rows.max(initial=0)) >> 16 > 0
    model, ids = _Model(lanes, wide), np.ascontiguousarray(rows.T)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
    digits = np.zeros(((3 if wide else 2) * steps + 4, lanes), np.int64)
    n_digits = np.zeros(lanes, np.int64)

    def code(n, cum, freq, bits):
        r = rng[:n] >> bits
        low[:n] += r * cum
        rng[:n] = r * freq
        small = np.flatnonzero(rng[:n] < _LOW)
        x = low[small]
        digits[n_digits[small], small] = x >> 32
        low[small] = (x & _MASK) << 16
        rng[small] <<= 16
        n_digits[small] += 1

    place = known = None
    begin = 0
    for t in range(steps):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        if t in EPOCHS:
            model.renew(rows[:n, :t])
            key = (np.arange(n)[:, None] << 32 | model.sorted).ravel()
            ask = np.arange(n)[:, None] << 32 | rows[:n, t:2 * t if 2 * t in EPOCHS else steps]
            place = np.searchsorted(key, ask)
            known = np.ascontiguousarray((key[np.minimum(place, len(key) - 1)] == ask).T)
            place = np.ascontiguousarray((place - np.arange(n)[:, None] * t).T)
            begin = t
        now = ids[t, :n]
        model.predict(n)
        old = known[t - begin, :n] if known is not None else np.zeros(n, bool)
        o = 3 - old
        o[(model.c1 == now) & (model.n1 > 0)] = 1
        o[(model.c2 == now) & (model.n2 > 0)] = 0
        flat = o * n + model.lane[:n]
        code(n, model.cum.ravel()[flat], model.f.ravel()[flat], _SCALE)
        listed, new = o == 2, o == 3
        cum, freq, bits = np.where(new, now & 0xFFFF, 0), np.ones(n, np.int64), np.where(new, 16, 0)
        if known is not None:
            at = np.where(listed, place[t - begin, :n], 0)
            lane = model.lane[:n]
            cum = np.where(listed, at, cum)
            freq = np.where(listed, model.count[lane, at], freq)
            bits = np.where(listed, model.bits, bits)
        code(n, cum, freq, bits)
        if wide:
            code(n, np.where(new, now >> 16, 0), np.ones(n, np.int64), np.where(new, 16, 0))
        model.update(n, o, now)
    for shift in (32, 16, 0):
        digits[n_digits, np.arange(lanes)] = (low >> shift) & (_MASK if shift == 32 else 0xFFFF)
        n_digits += 1
    for j in range(len(digits) - 1, 0, -1):
        digits[j - 1] += digits[j] >> 16
        digits[j] &= 0xFFFF
    out = []
    for i, b in enumerate(blocks):
        head = np.array([(len(b), n_digits[i], zlib.crc32(np.asarray(b, "<u4").tobytes()), wide)], _HEAD)
        out.append(head.tobytes() + digits[:n_digits[i], i].astype("<u2").tobytes())
    return out


def decode_blocks(codes: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that does not match its checksum raises ValueError."""
    out: list = [None] * len(codes)
    heads = np.array([np.frombuffer(c, _HEAD, 1)[0] for c in codes], _HEAD)
    for wide in (0, 1):
        mine = np.flatnonzero(heads["wide"] == wide)
        for lo in range(0, len(mine), LANES):
            part = mine[lo:lo + LANES]
            part = part[_order(heads["tokens"][part].astype(np.int64))]
            for i, ids in zip(part, _decode([codes[i] for i in part], heads[part], bool(wide))):
                if zlib.crc32(ids.tobytes()) != heads["crc"][i]:
                    raise ValueError("a token block does not match its checksum")
                out[i] = ids
    return out


def _decode(codes: list[bytes], heads: np.ndarray, wide: bool) -> list[np.ndarray]:
    lanes, lengths = len(codes), heads["tokens"].astype(np.int64)
    steps = int(lengths[0]) if lanes else 0
    digits = np.zeros((int(heads["digits"].max(initial=0)) + 4, lanes), np.int64)
    for i, c in enumerate(codes):
        d = np.frombuffer(c, "<u2", offset=_HEAD.itemsize)
        if len(d) != heads["digits"][i]:
            raise ValueError("a token block is cut short")
        digits[:len(d), i] = d
    model = _Model(lanes, wide)
    x = digits[0] << 32 | digits[1] << 16 | digits[2]
    rng, read = np.full(lanes, (1 << 48) - 1, np.int64), np.full(lanes, 3, np.int64)
    ids = np.zeros((steps, lanes), np.int64)

    def value(n, bits):
        """Where the code points, in shares of 2^bits."""
        r = rng[:n] >> bits
        return r, np.minimum(x[:n] // r, (1 << np.asarray(bits, np.int64)) - 1)

    def drop(n, r, cum, freq):
        x[:n] -= r * cum
        rng[:n] = r * freq
        small = np.flatnonzero(rng[:n] < _LOW)
        x[small] = x[small] << 16 | digits[np.minimum(read[small], len(digits) - 1), small]
        rng[small] <<= 16
        read[small] += 1

    for t in range(steps):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        if t in EPOCHS:
            model.renew(np.ascontiguousarray(ids[:t, :n].T))
        model.predict(n)
        r, v = value(n, _SCALE)
        o = (v >= model.cum[1]).astype(np.int64) + (v >= model.cum[2]) + (v >= model.cum[3])
        flat = o * n + model.lane[:n]
        drop(n, r, model.cum.ravel()[flat], model.f.ravel()[flat])
        listed, new = o == 2, o == 3
        r, v = value(n, np.where(listed, model.bits, np.where(new, 16, 0)))
        cum, freq, now = np.where(new, v, 0), np.ones(n, np.int64), v
        if model.sorted is not None:
            at, lane = np.where(listed, v, 0), model.lane[:n]
            cum = np.where(listed, model.first[lane, at], cum)
            freq = np.where(listed, model.count[lane, at], freq)
            now = np.where(listed, model.sorted[lane, at], now)
        drop(n, r, cum, freq)
        if wide:
            r, high = value(n, np.where(new, 16, 0))
            high = np.where(new, high, 0)
            drop(n, r, high, np.ones(n, np.int64))
            now = now | high << 16
        now = np.where(o == 0, model.c2, np.where(o == 1, model.c1, now))
        ids[t, :n] = now
        model.update(n, o, now)
    return [row[:m].astype("<u4") for row, m in zip(ids.T, lengths)]

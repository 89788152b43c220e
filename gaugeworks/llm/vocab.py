"""Token ids of whole texts, by the tokenizers library, through a dictionary of the words met so far.

A text is cut where that cannot change its ids, each distinct piece is encoded
once, and the ids of a text are gathered from the table of pieces.  The table is
bounded and starts anew when full.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Cutting before a space is exact unless white space meets white space or stands at an end.
UNEVEN = f"[{WHITE}][{WHITE}]|^[{WHITE}]|[{WHITE}]$"
MAX_PIECES = 400_000
#: Pieces that are encoded as one text.
TOGETHER = 64


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """``encode`` gives the ids of a batch of texts and how many each text has.

    ``spaced``: the vocabulary keeps a space with the word after it (byte-level);
    otherwise white space only separates words and ``folded`` says that A-Z are
    taken as a-z.  ``special``: the string of a special token in a text becomes its id, as
    the library does by itself; else it is spelled out in ordinary pieces.
    """

    def __init__(self, path: str, spaced: bool, folded: bool, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tok.encode_special_tokens, self.whole.encode_special_tokens = True, not special
        added = self.tok.get_added_tokens_decoder().items()
        strings = [t.content for _, t in added if t.special]
        # a special token that stands by itself parts the pieces of one text
        marks = [(t.content, i) for i, t in added if t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word)]
        self.mark, self.mark_id = marks[0] if marks else ("", -1)
        self.others = [t for t in strings if t != self.mark]
        self.special = "|".join(map(re.escape, strings)) if special else ""
        self.spaced, self.folded = spaced, folded
        self._clear()

    def _clear(self):
        self.rows: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self._add(["", ",", "."])

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, end to end, and how many each has."""
        parts = [pieces[i:i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        joined = [self.mark.join([*p, ""]) for p in parts]
        self.tok.encode_special_tokens = False
        found = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)]
        self.tok.encode_special_tokens = True
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part, text, got in zip(parts, joined, found):
            at = np.flatnonzero(got == self.mark_id)
            if self.mark and len(at) == text.count(self.mark) == len(part) and not any(t in text for t in self.others):
                ids.append(got[got != self.mark_id])
                sizes.append(np.diff(at, prepend=-1) - 1)
            else:  # a piece holds the string of a special token
                one = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
                ids.append(np.array([i for x in one for i in x], np.uint32))
                sizes.append(np.array([len(x) for x in one], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _add(self, pieces: list[str]):
        ids, n = self._ids(pieces)
        need, at = self.used + len(ids), len(self.rows)
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(n) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used:need] = ids
        self.start[at:at + len(n)] = self.used + np.cumsum(n) - n
        self.size[at:at + len(n)] = n
        self.used = need
        self.rows.update(zip(pieces, range(at, at + len(n))))

    def _rows_of(self, distinct: pa.Array, lead: str) -> np.ndarray:
        keys = [lead + x for x in distinct.to_pylist()] if lead else distinct.to_pylist()
        missing = [x for x in keys if x not in self.rows]
        if missing:
            self._add(missing)
        return np.fromiter((self.rows[x] for x in keys), np.int32, len(keys))

    def _table(self, pieces: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the stem and of the closing comma or full stop of each piece."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        if self.folded:
            distinct = pc.if_else(pc.string_is_ascii(distinct), pc.ascii_lower(distinct), distinct)
        stop = pc.match_substring_regex(distinct, r"[A-Za-z][.,]$")
        stem = pc.if_else(stop, pc.utf8_slice_codeunits(distinct, 0, -1), distinct)
        close = pc.if_else(stop, pc.utf8_slice_codeunits(distinct, -1), "")
        stems = stem.dictionary_encode()
        row = self._rows_of(stems.dictionary, lead)[stems.indices.to_numpy()] if len(stems) else np.zeros(0, np.int32)
        code = coded.indices.to_numpy()
        ends = close.dictionary_encode()
        end = np.array([self.rows[x] for x in ends.dictionary.to_pylist()] or [0], np.int32)[ends.indices.to_numpy()] if len(ends) else row
        return row[code], end[code]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.rows) > MAX_PIECES:
            self._clear()
        uneven = np.zeros(len(texts), bool)
        for pattern in filter(None, (UNEVEN if self.spaced else "", self.special)):
            uneven = uneven | pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(uneven), "", texts) if uneven.any() else texts
        parts = pc.split_pattern(plain, " ")
        pieces, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        rows = np.zeros((len(pieces), 2), np.int32)
        if self.spaced:
            first = np.zeros(len(pieces), bool)
            first[offsets[:-1]] = True
            for mask, lead in ((first, ""), (~first, " ")):
                rows[mask, 0], rows[mask, 1] = self._table(pieces.filter(pa.array(mask)), lead)
        else:
            rows[:, 0], rows[:, 1] = self._table(pieces, "")
        rows = rows.ravel()
        size = self.size[rows]
        upto = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ends = upto[offsets * 2]
        count = np.diff(ends)
        at = np.repeat((self.start[rows] - upto[:-1]).astype(np.int32), size)   # a part has fewer ids than bytes, below 2^31
        at += np.arange(len(at), dtype=np.int32)
        ids = self.flat[at]
        del rows, size, upto, at, pieces, parts, plain
        if uneven.any():
            where = np.flatnonzero(uneven)
            whole = [e.ids for e in self.whole.encode_batch_fast([texts[int(i)].as_py() for i in where], add_special_tokens=False)]
            cut = np.split(ids, ends[1:-1])
            for i, x in zip(where, whole):
                cut[i] = np.asarray(x, np.uint32)
            ids, count = np.concatenate(cut), np.fromiter(map(len, cut), np.int64, len(cut))
        return ids, count

    def with_end(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the end id after each text."""
        ids, count = self.encode(texts)
        out = np.full(len(ids) + len(count), end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
        return out, count + 1


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, spaced: bool, folded: bool, special: bool = True) -> Encoder:
    """One encoder per worker and vocabulary; workers are reused between tasks."""
    key = (path, spaced, folded, special)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def slices(batch: pa.RecordBatch, text: str, size: int = 6 << 20):
    """Cut a batch so that each part has about ``size`` bytes of text (a longer text stands alone)."""
    n = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n.astype(np.int64)) // size
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]]) if batch.num_rows else [0, 0]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))

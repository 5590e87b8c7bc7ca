"""Vectorised text measurements on Arrow string batches (numpy inside tasks).

A batch's texts stay one UTF-8 byte buffer; words and lines are byte ranges in
it, and their 64-bit hashes come from prefix sums of a polynomial, so nothing
loops over words in Python.  Buffers are worked through in pieces, so the extra
memory does not depend on the length of a text beyond its words and lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _IPOW = _powers(_BASE), _powers(_INV)
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def byte_table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


def text_buffer(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def slices(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes (a longer one stands alone)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _prefix_at(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Prefix hash of ``buf`` at the sorted positions ``at``."""
    out = np.empty(len(at), np.uint64)
    carry, scale, n = 0, 1, len(buf)
    for lo in range(0, n + 1, PIECE):
        i, j = np.searchsorted(at, [lo, lo + PIECE])
        part = buf[lo:lo + PIECE]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * _POW[:len(part)], out=sums[1:])
        out[i:j] = np.uint64(carry) + np.uint64(scale) * sums[at[i:j] - lo]
        carry = (carry + scale * int(sums[-1])) & _MASK
        scale = scale * int(_POW[PIECE]) & _MASK
    return out


def _shift_back(start: np.ndarray) -> np.ndarray:
    """_BASE ** -start for each start."""
    piece = start // PIECE
    scale = np.array([pow(_INV, int(p) * PIECE, 1 << 64) for p in range(int(piece.max(initial=0)) + 1)],
                     np.uint64)
    return scale[piece] * _IPOW[start - piece * PIECE]


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges (both bounds sorted)."""
    h = (_prefix_at(buf, end) - _prefix_at(buf, start)) * _shift_back(start)
    return mix(h + (end - start).astype(np.uint64))


class Slice:
    """Documents i..j of a batch: bytes, document bounds, words and lines."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, i: int, j: int):
        self.buf = buf[offs[i]:offs[j]]
        self.offs = offs[i:j + 1] - offs[i]
        self.n = j - i
        inside = ~WHITE[self.buf]
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.offs] = True
        before = np.empty(len(self.buf), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(self.buf), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.inside = inside
        self.word_offs = np.searchsorted(self.start, self.offs)
        self.n_words = np.diff(self.word_offs)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask holds."""
        sums = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.offs])

    @property
    def code_points(self) -> np.ndarray:
        """True at the first byte of each code point."""
        return (self.buf & 0xC0) != 0x80

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def word_hashes(self) -> np.ndarray:
        return range_hashes(self.buf, self.start, self.end)

    def shingles(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of ``k`` words inside one document."""
        if len(hashes) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        m = len(hashes) - k + 1
        out = np.zeros(m, np.uint64)
        for t in range(k):
            out = out * np.uint64(_BASE) + hashes[t:t + m]
        doc = self.word_doc()
        at = np.flatnonzero(doc[:m] == doc[k - 1:])
        return at, mix(out[at])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of every \\n-separated line; an empty text has one."""
        nl = np.flatnonzero(self.buf == 10)
        start = np.concatenate([self.offs[:-1], nl + 1])
        end = np.concatenate([nl, self.offs[1:]])
        doc_of_nl = np.searchsorted(self.offs, nl, "right") - 1
        order = np.lexsort((start, np.concatenate([np.arange(self.n), doc_of_nl])))
        doc = np.concatenate([np.arange(self.n), doc_of_nl])[order]
        end_order = np.lexsort((end, np.concatenate([doc_of_nl, np.arange(self.n)])))
        return start[order], end[end_order], doc


def repeated(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which (doc, key) pairs occur two or more times."""
    both = mix(key + mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both)
    s = both[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(both), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later_copies(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which (doc, key) pairs equal an earlier one."""
    both = mix(key + mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    s = both[order]
    out = np.zeros(len(both), bool)
    out[order[1:][s[1:] == s[:-1]]] = True
    return out

"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

A text is encoded by A (byte-level BPE, with a space in front) and by B (SentencePiece
BPE, which adds that space itself).  The byte offsets at which A's and B's tokens end
are two ascending lists; an offset in both ends a group, and links its last A and last B
token.  The lists of a slice of documents are laid end to end and merged as one problem:
every ``PIECE``-th diagonal of the merge path is found by a binary search (all of them
at once), which cuts the merge into pieces of equal work whatever the lengths of texts
and tokens.  Each piece merges its own run of A and B ends and emits the ends that meet;
an A end that is the last of a piece and a B end that is the first of the next are
stitched together.

Jobs: (1) encode, merge and store the ids with a mark on every token that ends a group;
(2) count linked id pairs, one row per pair and task before the shuffle; (3) look each
link's count up and write each document's row.  Two linked tokens end at one byte, so the
shorter is a suffix of the longer: a vocabulary of V tokens of mean length l allows at
most about V * l pairs whatever the corpus (1.1 million slots for the public files), and
the counts are broadcast as one array of that proven size.

Defined results: a null or empty text, or one whose joined token bytes differ from space
+ text (a literal U+2581), has no tokens: zero counts and empty groups; special tokens'
strings are plain text; repeated rows count each; extra columns are ignored; no rows, no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .packing import Encoder
from .sentencepiece_bpe import PieceModel
from .textnum import slices, text_buffer

PIECE = 256             # ends merged by a piece
BLOCK = 2048            # pieces worked on at once
BATCH = 2 << 20         # bytes of text of a slice


class ByteTokens(Encoder):
    """A byte-level BPE file: ids of a text as plain text, and the bytes of every id."""

    def __init__(self, path: str, ranks: str | None):
        super().__init__(path, ranks)
        self.exact.encode_special_tokens = True
        # byte-level alphabet: visible Latin-1 stands for itself, the rest from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = self.exact.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and self._PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


class Spelling:
    """Token bytes of a vocabulary as flat arrays."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)
        seen: dict[bytes, int] = {}
        self.twin = np.zeros(len(tokens), np.int64)       # number among tokens of equal bytes
        for i, t in enumerate(tokens):
            if t:
                self.twin[i] = seen.get(t, 0)
                seen[t] = seen.get(t, 0) + 1
        self.twins = max(seen.values(), default=1)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        at = np.arange(size.sum()) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.data[at]


class PairSlots:
    """A number for every pair of an A and a B token of which one is a suffix of the other."""

    def __init__(self, a: Spelling, b: Spelling):
        self.a, self.b = a, b
        width_a = a.length * b.twins
        width_b = np.maximum(b.length - 1, 0) * a.twins
        self.base_a = np.cumsum(width_a) - width_a
        self.base_b = np.cumsum(width_b) - width_b + width_a.sum()
        self.size = int(width_a.sum() + width_b.sum())

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        la, lb = self.a.length[a], self.b.length[b]
        return np.where(la >= lb, self.base_a[a] + (lb - 1) * self.b.twins + self.b.twin[b],
                        self.base_b[b] + (la - 1) * self.a.twins + self.a.twin[a])


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every ``piece``-th diagonal of the merge of two ascending lists without
    common values: the first i of ``a`` and j of ``b`` are the i + j smallest."""
    total = len(a) + len(b)
    d = np.r_[np.arange(0, total, piece), total]
    lo, hi = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        less = a[mid] < b[d[open_] - mid - 1]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    return lo, d - lo


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, piece: int = PIECE,
                block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Marks on the A and the B tokens whose ends meet (two ascending lists of ends)."""
    a, b = ends_a * 2, ends_b * 2 + 1                     # equal ends: A directly before B
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if not len(a) or not len(b):
        return last_a, last_b
    i, j = diagonals(a, b, piece)
    column = np.arange(piece)
    carried = None                                        # (key, place in a) before this block
    for lo in range(0, len(i) - 1, block):
        hi = min(lo + block, len(i) - 1)
        from_a = np.diff(i[lo:hi + 1])[:, None]
        size = (np.diff(i[lo:hi + 1]) + np.diff(j[lo:hi + 1]))[:, None]
        at_a = np.minimum(i[lo:hi, None] + column, len(a) - 1)
        at_b = np.clip(j[lo:hi, None] + column - from_a, 0, len(b) - 1)
        keys = np.where(column < from_a, a[at_a], b[at_b])
        keys[column >= size] = np.iinfo(np.int64).max - 1  # past the end of the last piece
        keys.sort(axis=1, kind="stable")                  # two ascending runs: one merge
        is_b = keys & 1
        place_b = np.cumsum(is_b, axis=1) - 1 + j[lo:hi, None]
        place_a = np.cumsum(1 - is_b, axis=1) - 1 + i[lo:hi, None]
        meet = (keys[:, 1:] == keys[:, :-1] + 1) & (is_b[:, :-1] == 0)
        last_a[place_a[:, :-1][meet]] = True
        last_b[place_b[:, 1:][meet]] = True
        # stitch: the last end of a piece and the first of the next
        if carried is not None and keys[0, 0] == carried[0] + 1 and is_b[0, 0]:
            last_a[carried[1]] = True
            last_b[place_b[0, 0]] = True
        meet = (keys[1:, 0] == keys[:-1, -1] + 1) & (is_b[1:, 0] == 1)
        last_a[place_a[:-1, -1][meet]] = True
        last_b[place_b[1:, 0][meet]] = True
        carried = (keys[-1, -1], place_a[-1, -1]) if not is_b[-1, -1] else None
    return last_a, last_b


class Aligner:
    """Both tokenizers and what follows from their vocabularies."""

    def __init__(self, tokenizer: str, ranks: str | None, model: str):
        self.tok_a, self.tok_b = ByteTokens(tokenizer, ranks), PieceModel(model)
        self.a, self.b = Spelling(self.tok_a.bytes), Spelling(self.tok_b.bytes)
        self.slots = PairSlots(self.a, self.b)
        self.kind = "<u2" if max(len(self.a.length), len(self.b.length)) <= 1 << 16 else "<u4"
        n = max(len(self.a.length), len(self.b.length))
        shown = np.arange(n)
        self.width = np.ones(n, np.int64)
        while (shown := shown // 10).any():
            self.width += shown > 0
        self.digits = np.zeros((n, int(self.width.max()) + 1), np.uint8)
        for k in range(int(self.width.max())):
            has = self.width > k
            self.digits[has, k] = 48 + np.arange(n)[has] // 10 ** (self.width[has] - 1 - k) % 10

    def align(self, texts: pa.Array) -> tuple[list, ...]:
        """Rows of ids of A and of B and their marks, as bytes."""
        n = len(texts)
        rows = [self.tok_a(" " + t) if t else np.zeros(0, np.int64) for t in texts.to_pylist()]
        ids_b, at_b = self.tok_b.encode(texts)
        sizes_a, sizes_b = np.array([len(r) for r in rows], np.int64), np.diff(at_b)
        ids_a = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        buf, offs = text_buffer(texts)
        same = np.zeros(n, bool)
        bytes_a, bytes_b = self.a.joined(ids_a).tobytes(), self.b.joined(ids_b).tobytes()
        row_a, row_b = np.repeat(np.arange(n), sizes_a), np.repeat(np.arange(n), sizes_b)
        len_a = np.bincount(row_a, self.a.length[ids_a], n).astype(np.int64)
        len_b = np.bincount(row_b, self.b.length[ids_b], n).astype(np.int64)
        raw = buf.tobytes()
        p = q = 0
        for k, (x, y, lo, hi) in enumerate(zip(len_a.tolist(), len_b.tolist(), offs[:-1].tolist(), offs[1:].tolist())):
            want = b" " + raw[lo:hi]
            same[k] = hi > lo and bytes_a[p:p + x] == want and bytes_b[q:q + y] == want
            p, q = p + x, q + y
        ids_a, ids_b = ids_a[same[row_a]], ids_b[same[row_b]]
        sizes_a, sizes_b = np.where(same, sizes_a, 0), np.where(same, sizes_b, 0)
        last_a, last_b = common_ends(np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b]))
        out = []
        for ids, last, size in ((ids_a, last_a, sizes_a), (ids_b, last_b, sizes_b)):
            raw, ends = ids.astype(self.kind).tobytes(), np.cumsum(size).tolist()
            step = np.dtype(self.kind).itemsize
            out.append([raw[step * (e - s):step * e] for e, s in zip(ends, size.tolist())])
            out.append([np.packbits(last[e - s:e]).tobytes() for e, s in zip(ends, size.tolist())])
        return tuple(out)

    def unpack(self, ids: pa.Array, marks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, marks, ids per row) of stored rows."""
        raw = ids.to_pylist()
        got = np.frombuffer(b"".join(raw), self.kind).astype(np.int64)
        size = np.array([len(r) for r in raw], np.int64) // np.dtype(self.kind).itemsize
        packed = marks.to_pylist()
        bits = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8)).astype(bool)
        width = 8 * np.array([len(m) for m in packed], np.int64)
        row = np.repeat(np.arange(len(size)), width)
        within = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
        return got, bits[within < size[row]], size

    def groups_text(self, a: np.ndarray, last_a: np.ndarray, size_a: np.ndarray, b: np.ndarray,
                    last_b: np.ndarray, size_b: np.ndarray) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of every row."""
        ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        at_a = np.arange(len(a)) + np.r_[0, ends_b][group_a]
        at_b = np.arange(len(b)) + ends_a[group_b]
        token = np.empty(len(a) + len(b), np.int64)
        sep = np.empty(len(token), np.uint8)
        token[at_a], token[at_b] = a, b
        sep[at_a] = np.where(last_a, ord("|"), ord(","))
        sep[at_b] = np.where(last_b, ord(";"), ord(","))
        ends = np.cumsum(size_a + size_b)
        width = self.width[token]
        full = width + 1
        full[ends[(size_a + size_b) > 0] - 1] -= 1        # nothing after a row's last id
        grid = self.digits[token]
        grid[np.arange(len(token)), width] = sep
        data = grid[np.arange(grid.shape[1]) < full[:, None]]
        offs = np.r_[0, np.cumsum(full)][np.r_[0, ends]]
        return pa.LargeStringArray.from_buffers(len(size_a), pa.py_buffer(offs.astype(np.int64)),
                                                pa.py_buffer(np.ascontiguousarray(data)))


_aligners: dict[tuple, Aligner] = {}


def aligner(*files: str | None) -> Aligner:
    """One aligner a Python worker and set of files."""
    if files not in _aligners:
        _aligners[files] = Aligner(*files)
    return _aligners[files]


def align(docs: DataFrame, tokenizer: str, model: str, ranks: str | None = None) -> DataFrame:
    """(doc_id, a_ids, a_last, b_ids, b_last): little-endian ids and packed bits that mark
    the tokens at which a group ends."""
    schema = docs.select("doc_id").schema
    for c in ("a_ids", "a_last", "b_ids", "b_last"):
        schema = schema.add(c, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = aligner(tokenizer, ranks, model)
        for whole in batches:
            for lo, hi in slices(text_buffer(whole.column("text"))[1], BATCH):
                b = whole.slice(lo, hi - lo)
                cols = [pa.array(c, pa.binary()) for c in m.align(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def link_counts(aligned: DataFrame, tokenizer: str, model: str, ranks: str | None = None) -> DataFrame:
    """(a_id, b_id, n): how many links hold each id pair; one row a pair and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = aligner(tokenizer, ranks, model)
        n = np.zeros(m.slots.size, np.int64)
        pair = np.zeros((m.slots.size, 2), np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids_a, last_a, _ = m.unpack(b.column("a_ids"), b.column("a_last"))
                ids_b, last_b, _ = m.unpack(b.column("b_ids"), b.column("b_last"))
                x, y = ids_a[last_a], ids_b[last_b]
                slot = m.slots(x, y)
                pair[slot, 0], pair[slot, 1] = x, y
                n += np.bincount(slot, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(pair[used, 0]), pa.array(pair[used, 1]), pa.array(n[used])],
                                         ["a_id", "b_id", "n"])

    rows = aligned.select("a_ids", "a_last", "b_ids", "b_last").mapInArrow(run, "a_id int, b_id int, n long")
    return rows.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def scored(aligned: DataFrame, counts: DataFrame, tokenizer: str, model: str,
           ranks: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the
    groups as text.  ``counts`` is bounded by the vocabularies (see above)."""
    slots = aligner(tokenizer, ranks, model).slots
    found = counts.select("a_id", "b_id", "n").toArrow()
    x, y, n = (found.column(c).to_numpy() for c in ("a_id", "b_id", "n"))
    count = np.zeros(slots.size, np.int64)
    count[slots(x, y)] = n
    best = np.zeros(len(slots.b.length), np.int64)
    np.maximum.at(best, y, n)
    tables = aligned.sparkSession.sparkContext.broadcast((count, best))
    schema = aligned.select("doc_id").schema
    for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        schema = schema.add(c, "long")
    schema = schema.add("groups", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = aligner(tokenizer, ranks, model)
        count, best = tables.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids_a, last_a, size_a = m.unpack(b.column("a_ids"), b.column("a_last"))
                ids_b, last_b, size_b = m.unpack(b.column("b_ids"), b.column("b_last"))
                y = ids_b[last_b]
                n = count[m.slots(ids_a[last_a], y)]
                ends = np.r_[0, np.cumsum(last_b)][np.cumsum(size_b)]
                starts = np.r_[0, ends[:-1]]
                sums, tops = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n == best[y])]
                links = ends - starts
                text = m.groups_text(ids_a, last_a, size_a, ids_b, last_b, size_b).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(size_a), pa.array(size_b), pa.array(links), pa.array(links),
                     pa.array(tops[ends] - tops[starts]), pa.array(sums[ends] - sums[starts]), text], schema.names)

    return aligned.mapInArrow(run, schema)


def token_links(docs: DataFrame, tokenizer: str, model: str, ranks: str | None = None) -> DataFrame:
    """The three jobs: ``scored`` rows of all documents, with corpus-wide link counts."""
    files = {"tokenizer": tokenizer, "model": model, "ranks": ranks}
    rows = stored(align(docs, **files), "token-align", compression="zstd")
    return scored(rows, link_counts(rows, **files), **files)

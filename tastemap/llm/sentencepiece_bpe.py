"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text (with the dummy space in front) is cut wherever no piece of the vocabulary
holds the two bytes at the cut side by side: no merge can cross such a place, so the
parts ("words") are encoded apart, and equal words of a slice once.  The characters
of all distinct words lie in one flat symbol array.  Every round looks up the piece
that each adjacent pair forms, takes the best rank per word by a segmented minimum,
merges the places with that rank from the left, and closes the gaps; words in which
no pair forms a piece leave the array.  Characters outside the vocabulary become
byte pieces at the end.

Rounds are exact.  A serial encoder merges one pair at a time, best score first and
leftmost among equals.  Merging all places of a rank at once is the same unless the
new symbol can at once form a piece of the same or a better rank with a neighbour;
pieces with such a continuation are merged at the leftmost place of a word only.
Words still unfinished after ``max_rounds`` rounds (long runs without any place to
cut, such as thousands of spaces) finish on a heap, in the serial order itself.

Defined results: null is an empty text; an empty text has no pieces (only the end id,
if asked for) and decodes to an empty text; a literal U+2581 is a space; repeated rows
and null doc_ids are encoded each; extra columns are dropped unless named in ``keep``.
Models with a normaliser table, without byte fallback, or with user-defined or unused
pieces are refused.  A slice holds about ``SLICE`` bytes whatever the length of a text.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textnum import text_buffer

SLICE = 4 << 20
MAX_ROUNDS = 256
NONE = np.int32(2**31 - 1)
SPACE = "▁"

codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


class PairTable:
    """(left, right) -> value for many pairs at once: open addressing in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(4 * len(left) + 1).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        key, todo = self._key(left, right), np.arange(len(left))
        slot = self._slot(key)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            put = todo[free]
            _, first = np.unique(slot[put], return_index=True)
            put = put[first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            done = np.zeros(len(left), bool)
            done[put] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = (key ^ (key >> 29)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Values of the pairs, -1 where there is none."""
        key = self._key(left, right)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], np.int32(-1))
        at = np.flatnonzero((found != key) & (found != -1))
        while len(at):
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[at]]
            hit = found == key[at]
            out[at[hit]] = self.values[slot[at[hit]]]
            at = at[~hit & (found != -1)]
        return out


class PieceModel:
    """The tables of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = np.array([p.type for p in proto.pieces])
        if (trainer.model_type != 2 or not trainer.byte_fallback or norm.precompiled_charsmap
                or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
                or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix
                or not set(kinds) <= {1, 2, 3, 6}):
            raise ValueError(f"{path}: not a plain BPE model with byte fallback")
        self.size = len(kinds)
        self.control, self.is_byte, self.unknown = kinds == 3, kinds == 6, kinds == 2
        text = [p.piece.replace(SPACE, " ") for p in proto.pieces]
        normal = {t: i for i, t in enumerate(text) if kinds[i] == 1}
        self.byte_id = np.zeros(256, np.int32)
        self.bytes = []
        for i, t in enumerate(text):
            if self.is_byte[i]:
                value = int(t[3:-1], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            elif self.unknown[i]:
                self.bytes.append((trainer.unk_surface or " ⁇ ").encode())
            else:
                self.bytes.append(b"" if self.control[i] else t.encode())
        self.end_id = next((i for i, p in enumerate(proto.pieces) if p.piece == trainer.eos_piece), -1)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)
        score = np.array([p.score for p in proto.pieces])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        self.char_id = np.full(0x110000, -1, np.int32)
        # places where a text may be cut: byte pairs that no piece holds
        self.joined = np.zeros(65536, bool)
        left, right, whole = [], [], []
        self.risky = np.zeros(self.size, bool)
        for t, i in normal.items():
            if len(t) == 1:
                self.char_id[ord(t)] = i
            b = np.frombuffer(t.encode(), np.uint8).astype(np.int64)
            self.joined[b[:-1] << 8 | b[1:]] = True
            for cut in range(1, len(t)):
                x, y = normal.get(t[:cut]), normal.get(t[cut:])
                if x is not None and y is not None:
                    left.append(x), right.append(y), whole.append(i)
                    for part in (x, y):
                        self.risky[part] |= self.rank[i] <= self.rank[part]
        self.pairs = PairTable(*(np.array(a, np.int32) for a in (left, right, whole)))

    def words(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Ascending places where a word begins: every text, and every place to cut."""
        first = np.zeros(len(buf) + 1, bool)
        if len(buf) > 1:
            pair = buf[:-1].astype(np.uint16) << np.uint16(8) | buf[1:]
            first[1:-1] = ~self.joined[pair] & ((buf[1:] & 0xC0) != 0x80)
        first[starts] = True
        return np.flatnonzero(first[:-1])

    def _characters(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece or -1) of every character."""
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        code = buf[at].astype(np.int32)
        wide = np.flatnonzero(code >= 0x80)
        if len(wide):
            lead, p = code[wide], at[wide]
            size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
            value = lead & (0x7F >> size)
            for k in range(1, 4):
                more = size > k
                value[more] = value[more] << 6 | (buf[p[more] + k] & 0x3F)
            code[wide] = value
        return at, self.char_id[code]

    def encode_words(self, buf: np.ndarray, offs: np.ndarray,
                     max_rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row starts) of distinct words lying end to end in ``buf``."""
        at, sym = self._characters(buf)
        n_words = len(offs) - 1
        sizes = np.diff(np.searchsorted(at, offs))
        word = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
        at = at.astype(np.int32)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        merged = self._pairs_of(sym, word)
        rounds = 0
        while len(sym):
            rank = np.where(merged >= 0, self.rank[merged], NONE)
            first = np.empty(len(word), bool)
            first[0] = True
            np.not_equal(word[1:], word[:-1], out=first[1:])
            heads = np.flatnonzero(first)
            best = np.minimum.reduceat(rank, heads)
            alive = best != NONE
            row = np.cumsum(first) - 1
            if not alive.all():
                keep = alive[row]
                done.append((word[~keep], sym[~keep], at[~keep]))
                word, sym, at, merged, rank = (a[keep] for a in (word, sym, at, merged, rank))
                row = (np.cumsum(alive) - 1)[row[keep]]
                best = best[alive]
                if not len(sym):
                    break
            if rounds == max_rounds:
                done += self._serial(word, sym, at)
                break
            rounds += 1
            place = np.flatnonzero(rank == best[row])
            of = row[place]
            # alternate places of a run of adjacent ones, from the left
            new_run = np.empty(len(place), bool)
            new_run[0] = True
            new_run[1:] = (place[1:] != place[:-1] + 1) | (of[1:] != of[:-1])
            number = np.arange(len(place))
            odd = (number - np.maximum.accumulate(np.where(new_run, number, 0))) & 1
            lone = np.empty(len(place), bool)           # the leftmost place of its word
            lone[0] = True
            np.not_equal(of[1:], of[:-1], out=lone[1:])
            place = place[np.where(self.risky[merged[place]], lone, odd == 0)]
            sym[place] = merged[place]
            gone = np.zeros(len(sym), bool)
            gone[place + 1] = True
            keep = ~gone
            moved = place - np.arange(len(place))       # their index after the gaps close
            word, sym, at, merged = word[keep], sym[keep], at[keep], merged[keep]
            again = np.unique(np.concatenate([moved, np.maximum(moved - 1, 0)]))
            merged[again] = self._pairs_of(sym, word, again)
        if not done:
            return np.zeros(0, np.int32), np.zeros(n_words + 1, np.int64)
        word, sym, at = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(word, kind="stable")
        word, sym, at = word[order], sym[order], at[order]
        return self._with_bytes(buf, word, sym, at, n_words)

    def _pairs_of(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The piece formed with the next symbol of the word, -1 if none (at all or given places)."""
        if at is None:
            at = np.arange(len(sym))
        out = np.full(len(at), -1, np.int32)
        nxt = np.minimum(at + 1, len(sym) - 1)
        ok = np.flatnonzero((at + 1 < len(sym)) & (word[at] == word[nxt]) & (sym[at] >= 0) & (sym[nxt] >= 0))
        out[ok] = self.pairs(sym[at[ok]], sym[nxt[ok]])
        return out

    def _serial(self, word: np.ndarray, sym: np.ndarray, at: np.ndarray) -> list[tuple]:
        """The rest of unfinished words: best rank first, leftmost among equals."""
        out = []
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        for lo, hi in zip(heads, np.r_[heads[1:], len(word)]):
            s = sym[lo:hi].tolist()
            left, right = list(range(-1, hi - lo - 1)), list(range(1, hi - lo + 1))
            right[-1] = -1
            pair = self._pairs_of(sym[lo:hi], word[lo:hi])
            heap = [(int(self.rank[p]), i, s[i], s[i + 1], int(p)) for i, p in enumerate(pair.tolist()) if p >= 0]
            heapq.heapify(heap)
            known: dict[tuple[int, int], int] = {}
            while heap:
                _, i, x, y, p = heapq.heappop(heap)
                j = right[i]
                if s[i] != x or j < 0 or s[j] != y:
                    continue
                s[i], s[j] = p, None
                right[i] = right[j]
                if right[i] >= 0:
                    left[right[i]] = i
                for a, b in ((left[i], i), (i, right[i])):
                    if a >= 0 and b >= 0 and s[a] >= 0 and s[b] >= 0:
                        key = (s[a], s[b])
                        if key not in known:
                            known[key] = int(self.pairs(np.array(key[:1]), np.array(key[1:]))[0])
                        if known[key] >= 0:
                            heapq.heappush(heap, (int(self.rank[known[key]]), a, *key, known[key]))
            kept = np.array([i for i, v in enumerate(s) if v is not None])
            out.append((word[lo + kept], np.array([s[i] for i in kept], np.int32), at[lo + kept]))
        return out

    def _with_bytes(self, buf: np.ndarray, word: np.ndarray, sym: np.ndarray, at: np.ndarray,
                    n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as byte pieces; then the row starts."""
        odd = np.flatnonzero(sym < 0)
        if len(odd):
            lead = buf[at[odd]]
            count = np.ones(len(sym), np.int64)
            count[odd] = 1 + (lead >= 0xC0) + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
            src = np.repeat(np.arange(len(sym)), count)
            step = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
            out = sym[src]
            raw = out < 0
            out[raw] = self.byte_id[buf[at[src[raw]] + step[raw]]]
            word, sym = word[src], out
        return sym, np.r_[0, np.cumsum(np.bincount(word, minlength=n_words))]

    def encode(self, texts: pa.Array, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string array."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(
            pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")
        buf, offs = text_buffer(texts)
        buf, offs = buf[offs[0]:offs[-1]], offs - offs[0]
        ids, counts = [], np.zeros(len(offs) - 1, np.int64)
        for lo, hi in self._slices(buf):
            starts = offs[np.searchsorted(offs, lo):np.searchsorted(offs, hi)]
            got, per_word, begins = self._slice_ids(buf[lo:hi], np.r_[lo, starts] - lo)
            ids.append(got)
            np.add.at(counts, np.searchsorted(offs, begins + lo, "right") - 1, per_word)
        ids = np.concatenate([*ids, np.zeros(0, np.int32)])
        out = np.r_[0, np.cumsum(counts)]
        if end:
            ids = np.insert(ids, out[1:], self.end_id)
            out = out + np.arange(len(out))
        return ids, out

    def _slices(self, buf: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of about ``SLICE`` bytes that end where a word begins."""
        lo = 0
        while lo < len(buf):
            hi, look = min(lo + SLICE, len(buf)), 1 << 12
            while hi < len(buf):
                cuts = self.words(buf[hi - 1:hi + look], np.zeros(0, np.int64))
                cuts = cuts[cuts > 0]
                if len(cuts) and hi - 1 + cuts[0] < len(buf):
                    hi += int(cuts[0]) - 1
                    break
                if hi + look >= len(buf):
                    hi = len(buf)
                    break
                look *= 2
            yield lo, hi
            lo = hi

    def _slice_ids(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ids, ids per word, word begins) of one slice."""
        begins = self.words(buf, starts)
        offs = np.r_[begins, len(buf)].astype(np.int32)
        found = pa.BinaryArray.from_buffers(
            pa.binary(), len(begins), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(buf))]
        ).dictionary_encode()
        distinct = found.dictionary
        _, off, data = distinct.buffers()
        off = np.frombuffer(off, np.int32, len(distinct) + 1).astype(np.int64)
        ids, rows = self.encode_words(np.frombuffer(data, np.uint8)[:off[-1]], off)
        number = found.indices.to_numpy()
        count = np.diff(rows)[number]
        at = np.arange(count.sum()) + np.repeat(rows[number] - (np.cumsum(count) - count), count)
        return ids[at], count, begins

    def token_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids end to end, length of each)."""
        size = self.length[ids]
        at = np.arange(size.sum()) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.data[at], size

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        """Texts of rows of ids (``offs``: row starts and the end)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("id outside the vocabulary")
        data, size = self.token_bytes(ids)
        ends = np.r_[0, np.cumsum(size)]
        lo, hi = ends[offs[:-1]], ends[offs[1:]]
        # one dummy space goes from the front, unless a byte piece made it
        seen = np.r_[np.flatnonzero(size > 0), len(ids)]
        first = seen[np.searchsorted(seen, offs[:-1])]
        front = np.flatnonzero((first < offs[1:]) & (hi > lo))
        front = front[(data[lo[front]] == 32) & (self.data[self.start[ids[first[front]]]] == 32)
                      & ~self.is_byte[ids[first[front]]] & ~self.unknown[ids[first[front]]]]
        lo = lo.copy()
        lo[front] += 1
        raw = data.tobytes()
        out = [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        bytes_of = np.r_[0, np.cumsum(self.is_byte[ids])]
        for i in np.flatnonzero(np.diff(bytes_of[offs])):
            try:
                out[i].decode()
            except UnicodeDecodeError:
                out[i] = out[i].decode("utf-8", "one_byte").encode()
        return pa.array(out, pa.binary()).cast(pa.string())


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model a Python worker and file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model: str, end: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``, the piece ids of ``text`` (with the end id if ``end``)."""
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids, offs = m.encode(b.column("text"), end)
                rows = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), rows], schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the text of the piece ids in ``ids`` (null ids: null)."""
    schema = T.StructType([*(f for f in rows.schema if f.name != out), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                col = b.column(ids)
                offs = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))]
                text = m.decode(col.flatten().to_numpy(zero_copy_only=False), offs)
                text = pc.if_else(col.is_valid(), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [text if c == out else b.column(c) for c in schema.names], schema.names)

    return rows.select(*[c for c in rows.columns if c != out]).mapInArrow(run, schema)

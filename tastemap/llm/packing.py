"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Documents are tokenised (an end id after each) and queue up by source.  In every
round of one window's length a source earns a quantum of ``window * weight``
tokens; the whole tokens of its credit are dequeued and the fraction stays as its
deficit for the next round.  A source whose quantum is under ``min_quantum``
tokens is served only every m-th round, for m quanta at once.  The rounds' tokens,
laid end to end, are cut at every ``window`` tokens into sequences, so every
sequence but the last is full, and each holds the sources in their target
proportions to within one quantum.  The default weights are the sources' shares
of all tokens, so that the queues run dry together.

A deficit after k rounds is ``k * quantum - floor(k * quantum)``: no state is
handed from window to window, so the position of any token follows from its place
in its queue, and each task computes its own documents' positions with the
deficits that the windows before it would have left.

Jobs: (1) tokenise once and store the ids beside each document's place among its
task's tokens of its source; (2) sum per (source, task) and give each its offset;
(3) join the offsets (one row per source and task) and cut.  Texts and ids are
never sorted, and only the totals per source reach the driver.

Defined results: a null or empty text is just the end id; null is a source of its
own; repeated rows are packed each; extra columns are ignored; no rows, no
sequences.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, lean, stored

WINDOW = 2048
MIN_QUANTUM = 64
END_ID = 1

_encoders: dict[tuple[str, str | None], object] = {}


class Encoder:
    """Ids of a byte-level BPE file of ``tokenizers``.

    With ``ranks``, the same vocabulary as a rank file, ordinary Latin text goes
    through tiktoken (same ids, several times faster); everything else, and any
    text it refuses, goes through ``tokenizers`` itself, which is loaded for the first
    such text: a worker that meets none does not hold the vocabulary twice.
    """

    # letters, digits, marks and white space that both libraries split alike
    _PLAIN = re.compile("[\t\n\r -~\xa1-ɏ‐-‧]*")

    def __init__(self, path: str, ranks: str | None):
        self.path, self.fast = path, None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN
            with open(ranks, "rb") as f:
                pairs = dict(line.split() for line in f)
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=PATTERN, special_tokens={},
                mergeable_ranks={base64.b64decode(k): int(v) for k, v in pairs.items()})

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and "<|" not in text and self._PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str, ranks: str | None) -> Encoder:
    """One encoder a Python worker and file."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def release() -> None:
    """Drop a worker's encoders and what they and past batches took."""
    if _encoders:
        _encoders.clear()
        give_back()


def tokenised(docs: DataFrame, tokenizer: str, ranks: str | None = None,
              end_id: int = END_ID) -> DataFrame:
    """(doc_id, queue, task, before, n, ids): ``before`` counts the tokens of the same
    source that the same task has seen earlier; ids are little-endian uint32."""
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select("doc_id", queue.alias("queue"), "text")
    schema = docs.select("doc_id").schema.add("queue", "string").add("task", "integer").add(
        "before", "long").add("n", "long").add("ids", "binary")
    names = schema.names
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer, ranks), {}
        task = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                before, n, ids = [], [], []
                for q, text in zip(b.column("queue").to_pylist(), b.column("text").to_pylist()):
                    got = np.concatenate([encode(text or "").astype("<u4"), end])
                    before.append(seen.get(q, 0))
                    n.append(len(got))
                    ids.append(got.tobytes())
                    seen[q] = before[-1] + len(got)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("queue"), pa.array([task] * len(n), pa.int32()),
                     pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names)

    return rows.mapInArrow(lean(run), schema)


@dataclass
class Rounds:
    """The order in which the queues are served; ``total`` and ``quantum`` by source."""
    total: np.ndarray            # tokens
    every: np.ndarray            # served every so many rounds
    quantum: np.ndarray          # tokens earned between two services
    window: int

    @classmethod
    def of(cls, total: np.ndarray, weight: np.ndarray, window: int, min_quantum: int) -> "Rounds":
        share = window * weight / max(weight.sum(), 1e-300)
        every = np.maximum(1, np.ceil(min_quantum / np.maximum(share, 1e-300))).astype(np.int64)
        return cls(total.astype(np.int64), every, share * every, window)

    def served(self, s, k: np.ndarray) -> np.ndarray:
        """Tokens that source ``s`` has given after ``k`` services."""
        return np.minimum(self.total[s], np.floor(k * self.quantum[s]).astype(np.int64))

    def service_of(self, s: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The service in which a token of source ``s`` leaves its queue."""
        k = np.floor(token / self.quantum[s]).astype(np.int64)
        k -= self.served(s, k) > token
        k += self.served(s, k + 1) <= token
        return k

    def before(self, s: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Tokens of all sources that come before service ``k`` of source ``s``."""
        rnd = k * self.every[s]
        out = np.zeros(len(k), np.int64)
        for t in range(len(self.total)):
            # services of t in earlier rounds, and in this round if t comes first
            n = (rnd - (t >= s)) // self.every[t] + 1
            out += self.served(t, np.maximum(n, 0))
        return out

    def pieces(self, s: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start, length, sequence, offset) for documents at places
        ``a .. a + n`` of the queues of sources ``s``."""
        first, last = self.service_of(s, a), self.service_of(s, a + n - 1)
        count = last - first + 1
        doc = np.repeat(np.arange(len(s)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
        src = s[doc]
        lo = np.maximum(a[doc], self.served(src, k))
        hi = np.minimum(a[doc] + n[doc], self.served(src, k + 1))
        pos = self.before(src, k) + lo - self.served(src, k)
        full = hi > lo
        doc, lo, hi, pos = doc[full], lo[full], hi[full], pos[full]
        w0, w1 = pos // self.window, (pos + hi - lo - 1) // self.window
        count = w1 - w0 + 1
        row = np.repeat(np.arange(len(doc)), count)
        w = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + w0[row]
        p = np.maximum(pos[row], w * self.window)
        e = np.minimum(pos[row] + hi[row] - lo[row], (w + 1) * self.window)
        start = lo[row] - a[doc[row]] + p - pos[row]
        return doc[row], start, e - p, w, p - w * self.window


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW,
         min_quantum: int = MIN_QUANTUM, weights: dict[str | None, float] | None = None,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and the piece's ids.  ``weights`` are target proportions by source (default:
    the corpus's own; a source without a weight has the smallest one given)."""
    tokens = stored(tokenised(docs, tokenizer, ranks, end_id), "packing-tokens")
    per_task = tokens.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(per_task.select("queue", "task", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base")),
                     "packing-offsets")
    totals = offsets.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()
    total = np.array([r["n"] for r in totals], np.int64)
    if weights:
        named = {"" if k is None else "=" + str(k): v for k, v in weights.items()}
        weight = np.array([named.get(r["queue"], min(named.values())) for r in totals], float)
    else:
        weight = total.astype(float)
    rounds = Rounds.of(total, weight, window, min_quantum)
    number = {r["queue"]: i for i, r in enumerate(totals)}

    piece = "array<struct<start:long,length:long,sequence_id:long,offset:long>>"

    @F.arrow_udf(piece)
    def pieces(queue: pa.Array, n: pa.Array, at: pa.Array) -> pa.Array:
        release()               # every text is tokenised: a worker that is used again needs them no more
        s = np.array([number[q] for q in queue.to_pylist()], np.int64)
        doc, *cut = rounds.pieces(s, at.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False))
        rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cut],
                                          ["start", "length", "sequence_id", "offset"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(s)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    # only the places go through Python: the ids stay beside them and are cut by the plan
    placed = tokens.join(offsets.select("queue", "task", "base"), ["queue", "task"]).select(
        "doc_id", "n", "ids", pieces("queue", "n", F.col("base") + F.col("before")).alias("_p"))
    cut = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return placed.select("doc_id", "n", "ids", F.inline("_p")).select(
        "doc_id", "start", "length", F.crc32(cut).alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        "sequence_id", "offset", cut.alias("ids"))

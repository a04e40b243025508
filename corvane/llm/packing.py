"""Mixture-controlled packing by deficit round-robin over source queues.

The tokens of a source form one queue: its documents in the order of the stored table. A window (sequence) is filled in
turns: each source earns its share of the window as credit, and is served when its credit reaches `min_piece`; what it
doesn't use is carried to the next window, and a window that the ring leaves open is filled by the sources with the
largest credit, which then owe. Every `epoch_windows` windows the credits are settled by whole tokens from a closed
form of the position, so any task can lay out any epoch by itself: no state passes between tasks, and the deficits
still carry over windows, epochs and partitions. The layout depends on the sources' totals alone; a document finds its
pieces from its place in its queue, which a running sum inside its task and a small table of (source, task) sums give.

Without weights a source's share is its share of the tokens, so all queues end together; with weights a queue that
ends leaves the others to share by weight.

Cases: a null text has only the end token; null sources are one queue; repeated rows are packed each; no tokens, no
rows. All windows are full but the last.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.bpe import ByteBpe, coded, pre_tokens, slices
from corvane.llm.common import ship, source_key, stored, text_or_empty

STRETCH = 600_000


@dataclass
class Layout:
    """Which tokens of which queue lie where, by epoch."""

    totals: list[int]
    weights: list[float] | None = None
    window: int = 2048
    epoch_windows: int = 64
    min_piece: int = 256
    phases: list = field(default_factory=list)  # (first token, tokens, queue positions, amounts, the source that takes what rounding leaves)
    _made: dict = field(default_factory=dict)

    def __post_init__(self):
        sources = len(self.totals)
        self.epoch_windows = max(self.epoch_windows, -(-sources * sources // self.window) + 1)
        self.tokens = sum(self.totals)
        left, done, at = list(self.totals), [0] * sources, 0
        while any(left):
            live = [s for s in range(sources) if left[s] and (not self.weights or self.weights[s] > 0)] or [s for s in range(sources) if left[s]]
            if not self.weights or all(self.weights[s] <= 0 for s in live):
                amounts = [left[s] if s in live else 0 for s in range(sources)]
            else:
                first = min(live, key=lambda s: left[s] / self.weights[s])
                unit = left[first] / self.weights[first]
                amounts = [0] * sources
                for s in live:
                    amounts[s] = left[s] if s == first else min(left[s], int(unit * self.weights[s]))
            size = sum(amounts)
            self.phases.append((at, size, list(done), amounts, max(range(sources), key=lambda s: amounts[s])))
            done = [a + b for a, b in zip(done, amounts, strict=True)]
            left = [a - b for a, b in zip(left, amounts, strict=True)]
            at += size

    def upto(self, token: int) -> list[int]:
        """How far each queue is when `token` tokens are placed."""
        token = min(token, self.tokens)
        if not self.phases:
            return [0] * len(self.totals)
        at, size, done, amounts, big = self.phases[max(0, bisect.bisect_right(self.phases, token, key=lambda p: p[0]) - 1)]
        x = token - at
        out = [x * a // size for a in amounts]
        out[big] += x - sum(out)
        return [a + b for a, b in zip(done, out, strict=True)]

    def epoch(self, e: int) -> list[list[tuple[int, int, int, int]]]:
        """By source, in queue order: (queue position, length, window, offset)."""
        if e not in self._made:
            if len(self._made) > 64:
                self._made.pop(next(iter(self._made)))
            self._made[e] = self._fill(e)
        return self._made[e]

    def _fill(self, e: int) -> list[list[tuple[int, int, int, int]]]:
        span = self.window * self.epoch_windows
        begin, end = self.upto(e * span), self.upto((e + 1) * span)
        size = min(self.tokens - e * span, span)
        quota = [b - a for a, b in zip(begin, end, strict=True)]
        live = [s for s, q in enumerate(quota) if q > 0]
        served = [0] * len(quota)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in quota]
        turn = e % max(1, len(live))
        for w in range(-(-size // self.window)):
            upto = min(size, (w + 1) * self.window)
            room, offset = upto - w * self.window, 0
            ring = live[turn:] + live[:turn]
            credit = {s: quota[s] * upto // size - served[s] for s in ring}

            def serve(s, n, w=w, credit=credit):
                nonlocal room, offset
                out[s].append((begin[s] + served[s], n, e * self.epoch_windows + w, offset))
                served[s] += n
                credit[s] -= n
                room -= n
                offset += n

            for s in ring:
                if room and credit[s] > 0 and (credit[s] >= self.min_piece or served[s] + credit[s] == quota[s]):
                    serve(s, min(credit[s], room))
            while room:
                s = max((s for s in ring if served[s] < quota[s]), key=credit.get)
                serve(s, min(room, quota[s] - served[s], max(credit[s], self.min_piece)))
            turn = (turn + 1) % len(live)
        return out

    def pieces(self, source: int, begin: int, end: int, hint: int = 0):
        """(from, length, window, offset) of the queue's tokens begin to end, and the epoch where it ends."""
        span = self.window * self.epoch_windows
        e = hint if self.upto(hint * span)[source] <= begin else 0
        if self.upto((e + 8) * span)[source] <= begin:  # far ahead
            low, high = e, self.tokens // span + 1
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self.upto(mid * span)[source] <= begin else (low, mid - 1)
            e = low
        found = []
        while begin < end:
            own = self.epoch(e)[source]
            k = bisect.bisect_right(own, begin, key=lambda p: p[0]) - 1
            for at, n, window, offset in own[max(k, 0) :]:
                if at >= end:
                    break
                if at + n > begin:
                    upto = min(end, at + n)
                    found.append((begin, upto - begin, window, offset + begin - at))
                    begin = upto
            if begin < end:
                e += 1
        return found, e


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """src, part, at (tokens of the source before it in the task), doc_id, n, ids: in the shared folder."""
    ship(docs.sparkSession)
    bpe = ByteBpe.load(path)
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("src"), pre_tokens(text_or_empty(), list(bpe.specials)).alias("words"))
    kind = np.uint16 if bpe.width == 2 else np.uint32

    def encode(batches):
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        sums: dict[str, int] = {}
        for whole in batches:
            lists = whole.column(2)
            for a, b in slices(lists, STRETCH):
                words, which, bounds = coded(lists.slice(a, b - a))
                ids, lens = shared.value.distinct(words)
                ids, lens = np.r_[ids, np.int32(end_id)], np.r_[lens, 1]
                which = np.insert(which, bounds[1:], len(lens) - 1)
                size = lens[which]
                before = np.cumsum(size) - size
                flat = ids[np.repeat((np.cumsum(lens) - lens)[which] - before, size) + np.arange(int(size.sum()))].astype(kind)
                ends = np.r_[0, (before + size)[bounds[1:] + np.arange(b - a)]]
                src = whole.column(1).slice(a, b - a)
                at = []
                for s, n in zip(src.to_pylist(), np.diff(ends).tolist(), strict=True):
                    at.append(sums.get(s, 0))
                    sums[s] = at[-1] + n
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * kind().itemsize).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([src, pa.array([part] * (b - a), pa.int64()), pa.array(at, pa.int64()), whole.column(0).slice(a, b - a), pa.array(np.diff(ends), pa.int64()), blob], names=["src", "part", "at", "doc_id", "n", "ids"])

    return stored(rows.mapInArrow(encode, "src string, part long, at long, doc_id long, n long, ids binary"), "pack-tokens")


def pack(docs: DataFrame, path: str, weights=None, window: int = 2048, epoch_windows: int = 64, min_piece: int = 256, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    weights: None, or a function of the sorted source keys. The driver holds a total per source.
    """
    spark = docs.sparkSession
    wide = ByteBpe.load(path).width
    tokens = tokenised(docs, path, end_id)
    sums = stored(tokens.groupBy("src", "part").agg(F.sum("n").alias("n")), "pack-sums")
    totals = {r["src"]: r["n"] for r in sums.groupBy("src").agg(F.sum("n").alias("n")).collect()}
    keys = sorted(totals, key=lambda s: s.encode())
    layout = Layout([totals[s] for s in keys], weights and weights(keys), window, epoch_windows, min_piece)
    shared = spark.sparkContext.broadcast((layout, {s: i for i, s in enumerate(keys)}))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(sums.select("src", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "pack-base")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches):
        made, number = shared.value
        last: dict[str, int] = {}
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            blobs = []
            for src, at, doc_id, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                ids = np.frombuffer(blob.as_buffer(), np.uint16 if wide == 2 else np.uint32).astype("<u4")
                view = memoryview(ids).cast("B")
                found, last[src] = made.pieces(number[src], at, at + n, last.get(src, 0))
                for begin, size, sequence, offset in found:
                    raw = view[4 * (begin - at) : 4 * (begin - at + size)]
                    for column, value in zip(columns, (doc_id, begin - at, size, zlib.crc32(raw), n, sequence, offset), strict=True):
                        column.append(value)
                    if with_ids:
                        blobs.append(raw.tobytes())
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(blobs, pa.binary())] if with_ids else arrays, names=[*names, "ids"] if with_ids else names)

    rows = tokens.join(base, ["src", "part"]).select("src", (F.col("base") + F.col("at")).alias("at"), "doc_id", "n", "ids")
    return rows.mapInArrow(cut, ", ".join(f"{c} long" for c in names) + ", ids binary" * with_ids)

"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text (the last 16 count); a chunk ends where the hash falls below a threshold, so
an insertion moves only the chunks that it touches. Chunks are deduplicated by a digest of 128 bits: of a chunk that more
than one document has, the occurrences in the first document stay: the first by identifier, then by a hash of the text,
then by place in the table, which matters for rows repeated in full. Neighbouring repeated chunks of a document
make a run, runs under `min_bytes` are left alone, and the others are cut into passages that stay here and that stay
elsewhere.

First the rows that have a digest are counted, by half of it; what may repeat passes a bloom filter of 16 bits a repeated
digest (8 MB at most: with more than 4 million of them it lets ever more chunks through, and all are compared). For what
passes, the first document of each whole digest is found by an aggregation that starts before the shuffle, and joined
to the chunks. Digests of very common chunks (a 2,000th of the chunks that pass, or more) are joined by broadcast, so they
don't gather in one task. Text in which no chunk ends for `max_chunk` bytes is cut there.

Cases: null text counts as empty and has no chunks; repeated rows are documents of their own, whatever their
identifiers, null ones too, which come last; an empty table gives an empty result. A repetition inside one document
alone is not one between documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import hit_filter, join_spread, maybe_hit, ship, stored, text_or_empty

REACH = 16
STRETCH = 2_000_000


def gear_table(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**32, 256, dtype=np.uint32)


GEAR = gear_table()


def chunk_ends(offsets: np.ndarray, data: np.ndarray, mean: int, max_chunk: int) -> np.ndarray:
    """Where the chunks of the texts end, as positions in data; every text ends one."""
    n = len(data)
    lens = np.diff(offsets)
    # the texts with REACH zero values between them, so that no hash reaches back over a border
    shift = np.repeat(np.arange(1, len(lens) + 1) * REACH, lens)
    held = np.zeros(n + REACH * (len(lens) + 1), np.uint32)
    spot = np.arange(n) + shift
    held[spot] = GEAR[data]
    k = 1
    while k < REACH:  # sums of 1, 2, 4, ... values, each shifted by its age
        held[k:] += held[:-k] << np.uint32(k)
        k *= 2
    flags = held[spot] < np.uint32(2**32 // mean)
    flags[offsets[1:][lens > 0] - 1] = True
    ends = np.flatnonzero(flags) + 1
    starts = np.r_[0, ends[:-1]]
    size = ends - starts
    if (size > max_chunk).any():
        parts = -(-size // max_chunk)
        step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.minimum(np.repeat(starts, parts) + (step + 1) * max_chunk, np.repeat(ends, parts))
    return ends


def chunks(docs: DataFrame, mean: int = 32, max_chunk: int = 512) -> DataFrame:
    """digest and digest2, rid, doc_id, h, at, size of every chunk: in the shared folder. rid numbers the rows, h is a hash of the text.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), F.xxhash64(text_or_empty()).alias("h"))

    def run(batches):
        context = TaskContext.get()
        rid = (context.partitionId() if context else 0) << 33
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1)
                own = offsets[at : upto + 1] - offsets[at]
                raw = data[offsets[at] : offsets[upto]]
                ends = chunk_ends(own, raw, mean, max_chunk)
                starts = np.r_[0, ends[:-1]] if len(ends) else ends
                view, digest = memoryview(raw), xxhash.xxh3_128_digest
                digests = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                one, two = np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1])
                doc = np.searchsorted(own, starts, "right") - 1
                which = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array(rid + doc), batch.column(0).slice(at, upto - at).take(which), batch.column(2).slice(at, upto - at).take(which), pa.array((starts - own[doc]).astype(np.int32)), pa.array((ends - starts).astype(np.int32))],
                    names=["digest", "digest2", "rid", "doc_id", "h", "at", "size"],
                )
                rid += upto - at
                at = upto

    return stored(rows.mapInArrow(run, "digest long, digest2 long, rid long, doc_id long, h long, at int, size int"), "substring-chunks")


def repeated_passages(docs: DataFrame, mean: int = 32, max_chunk: int = 512, min_bytes: int = 112) -> DataFrame:
    """doc_id, start, end, n_bytes, n_chunks, kept: one row per passage that another document has too.

    start and end count bytes of the UTF-8 text; kept: the passage stays here. A run of neighbouring repeated chunks is cut
    into passages where that changes, and `min_bytes` is the least length of a run. Text to remove is what the rows with
    kept = false cover, all of it: the runs then have each repeated chunk in one document only.
    """
    made = chunks(docs, mean, max_chunk)
    seen = made.groupBy("digest").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low <> high").select("digest")
    seen = stored(seen, "substring-repeated")
    n = seen.count()
    some = made
    if n:
        some = made.where(maybe_hit(docs.sparkSession, *hit_filter(seen, n))(F.col("digest")))
    some = stored(some, "substring-some")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "rid")
    keys = ["digest", "digest2"]
    owner = some.groupBy(*keys).agg(F.min(place).alias("owner"), F.max("rid").alias("high"), F.min("rid").alias("low"), F.count(F.lit(1)).alias("n"))
    owner = stored(owner.where("low <> high").select(*keys, F.col("owner.rid").alias("owner"), "n"), "substring-owners")
    found = join_spread(some, owner, keys, "n", some.count()).select("rid", "doc_id", "at", "size", (F.col("rid") == F.col("owner")).alias("own"))
    order = Window.partitionBy("rid").orderBy("at")
    found = found.withColumn("new", F.col("at") != F.lag(F.col("at") + F.col("size"), 1, -1).over(order))
    found = found.withColumn("turn", F.col("new") | (F.col("own") != F.lag("own").over(order)))
    found = found.withColumn("run", F.sum(F.col("new").cast("int")).over(order)).withColumn("passage", F.sum(F.col("turn").cast("int")).over(order))
    passages = found.groupBy("rid", "run", "passage").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("end"), F.count(F.lit(1)).alias("n_chunks"), F.first("own").alias("kept"))
    run = Window.partitionBy("rid", "run")
    passages = passages.withColumn("run_bytes", F.max("end").over(run) - F.min("start").over(run)).where(F.col("run_bytes") >= min_bytes)
    return passages.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("end") - F.col("start")).cast("long").alias("n_bytes"), "n_chunks", "kept")

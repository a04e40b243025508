"""Exact dedup by a log-structured merge index.

Write path: every task keeps a memtable of digests and, when it is full, flushes it as a run sorted by digest; an
entry of a run holds the smallest identifier, the number of rows and the identifiers of one digest, so a group of
copies of any size leaves a task as a few entries. Each run ends with a footer: its least and largest digest and a
filter of its digests, by which `lookup` asks only the runs that may hold a document.

Compaction deals the runs by digest range, merges each range in digest order and keeps the smallest identifier. The
merged runs have footers as well, whose filters hold the digests that more than one row has (hits). Texts and entries
probe the one run whose range covers them: what its filter excludes is unique; texts that pass are grouped by digest *and*
bytes, which is the byte verification, and the verified classes replace the hits. A digest that two different texts share
is resolved by its bytes. The filters of the hits have 16 bits a hit and 16 MB at most together; beyond that more unique
texts are verified, and none is lost.

Cases: null text counts as empty; null identifiers sort last (a group of nothing else has a null keep_id); of rows
that repeat an identifier one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import KEY, SPACE, keep_rows, row_key, ship, stored, text_or_empty

RUN_SCHEMA = "run long, seq long, digest binary, min_id long, n long, ids array<long>, last binary, filter binary"
_ARROW_RUN = pa.schema([("run", pa.int64()), ("seq", pa.int64()), ("digest", pa.binary()), ("min_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("last", pa.binary()), ("filter", pa.binary())])
LEVEL_SCHEMA = "digest binary, n long, min_id long, keep_run long, keep_seq long, last binary, filter binary"
FOOTER = -1
BITS_A_DIGEST = 16
MOST_FILTER_BITS = 1 << 27


def normalised(text: str = "text"):
    """Runs of ASCII white space become one space."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def digest_of(norm):
    return F.unhex(F.sha2(norm, 256))


def second_digest(norm):
    """Tells texts apart that share a digest."""
    return F.sha2(F.concat(F.lit("#"), norm), 256)


def words_of(digests: np.ndarray) -> np.ndarray:
    """Digests of 32 bytes as rows of four numbers, which order like the bytes."""
    return digests.view(">u8").reshape(-1, 4).astype(np.uint64)


def filter_of(words: np.ndarray, most_bits: int = MOST_FILTER_BITS) -> bytes:
    """A bloom filter of digests: each of the four words of a digest sets a bit."""
    bits = max(6, min(int(most_bits).bit_length() - 1, (BITS_A_DIGEST * len(words) - 1).bit_length()))
    flags = np.zeros(1 << bits, bool)
    flags[words >> np.uint64(64 - bits)] = True
    return np.packbits(flags, bitorder="little").tobytes()


class Runs:
    """Footers of runs: which of them may hold a digest."""

    def __init__(self, footers: list[tuple[bytes, bytes, bytes]]):
        footers = sorted(footers)
        self.least = np.array([f[0] for f in footers], "S32")
        self.most = np.array([f[1] for f in footers], "S32")
        self.filters = [np.frombuffer(f[2], np.uint8) for f in footers]

    def admits(self, run: int, words: np.ndarray) -> np.ndarray:
        held = self.filters[run]
        spots = words >> np.uint64(64 - (8 * len(held)).bit_length() + 1)
        return ((held[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def covering(self, digests: np.ndarray) -> np.ndarray:
        """Whether the run whose range covers a digest may hold it; for runs with ranges that don't overlap."""
        flat, words = digests.view("S32"), words_of(digests)
        found = np.zeros(len(flat), bool)
        if len(self.least):
            at = np.searchsorted(self.least, flat, "right") - 1
            inside = (at >= 0) & (flat <= self.most[np.maximum(at, 0)])
            for run in np.unique(at[inside]).tolist():
                own = np.flatnonzero(inside & (at == run))
                found[own] = self.admits(run, words[own])
        return found

    def any(self, digests: np.ndarray) -> np.ndarray:
        """Whether any run may hold a digest."""
        flat, words = digests.view("S32"), words_of(digests)
        found = np.zeros(len(flat), bool)
        for run in range(len(self.least)):
            own = np.flatnonzero(~found & (flat >= self.least[run]) & (flat <= self.most[run]))
            found[own] = self.admits(run, words[own])
        return found


def raw(column: pa.Array) -> np.ndarray:
    """A column of digests of 32 bytes as their bytes."""
    column = column.cast(pa.binary())
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[32 * column.offset : 32 * (column.offset + len(column))] if len(column) else np.zeros(0, np.uint8)


def flush_runs(batches, memtable_rows: int, entry_ids: int):
    """mapInArrow body: (doc_id, digest) rows to sorted runs, each with its footer."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    table: dict[bytes, list] = {}
    held = run = 0

    def flush():
        nonlocal table, held, run
        rows = []
        order = sorted(table)
        for digest in order:
            ids = sorted(table[digest], key=lambda x: (x is None, x or 0))
            for at in range(0, len(ids), entry_ids):
                piece = ids[at : at + entry_ids]
                rows.append({"run": (part << 24) | run, "seq": len(rows), "digest": digest, "min_id": piece[0], "n": len(piece), "ids": piece})
        words = words_of(np.frombuffer(b"".join(order), np.uint8))
        rows.append({"run": (part << 24) | run, "seq": FOOTER, "digest": order[0], "n": len(order), "last": order[-1], "filter": filter_of(words)})
        table, held, run = {}, 0, run + 1
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW_RUN)

    for batch in batches:
        for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table.setdefault(digest, []).append(doc_id)
            held += 1
            if held >= memtable_rows:
                yield flush()
    if held:
        yield flush()


def write_runs(docs: DataFrame, memtable_rows: int = 50_000, entry_ids: int = 4096) -> DataFrame:
    """Level 0: the runs of all memtables, in the shared folder."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(normalised()).alias("digest"))
    return stored(rows.mapInArrow(lambda it: flush_runs(it, memtable_rows, entry_ids), RUN_SCHEMA), "dedup-runs")


def merge_sorted(batches, most_bits: int):
    """mapInArrow body: entries in the order of digest and identifier to one entry a digest, and a footer with the filter of the hits."""
    names = ["digest", "n", "min_id", "keep_run", "keep_seq"]
    held = least = last = None
    hits = [np.zeros((0, 4), np.uint64)]

    def merged(table: pa.Table, starts: np.ndarray, sums: np.ndarray, words: np.ndarray):
        nonlocal least, last
        taken = table.take(pa.array(starts))
        hits.append(words[starts][sums > 1])
        least = least or taken.column(0)[0].as_py()
        last = taken.column(0)[-1].as_py()
        none = pa.nulls(len(starts), pa.binary())
        return pa.RecordBatch.from_arrays([taken.column(0).combine_chunks(), pa.array(sums), *(taken.column(i).combine_chunks() for i in (2, 3, 4)), none, none], names=[*names, "last", "filter"])

    for batch in batches:
        table = pa.table([batch.column(i) for i in range(5)], names=names).combine_chunks()
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not len(table):
            continue
        words = words_of(raw(table.column(0).chunk(0)))
        starts = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(axis=1)])
        sums = np.add.reduceat(table.column("n").to_numpy(), starts)
        if len(starts) > 1:  # the last digest may go on in the next batch
            yield merged(table, starts[:-1], sums[:-1], words)
        held = table.slice(int(starts[-1]), 1).set_column(1, "n", pa.array(sums[-1:]))
    if held is not None:
        yield merged(held, np.zeros(1, np.int64), held.column("n").to_numpy(), words_of(raw(held.column(0).combine_chunks())))
        every = np.concatenate(hits)
        yield pa.RecordBatch.from_arrays([pa.array([least], pa.binary()), pa.array([len(every)], pa.int64()), *[pa.nulls(1, pa.int64())] * 3, pa.array([last], pa.binary()), pa.array([filter_of(every, most_bits)], pa.binary())], names=[*names, "last", "filter"])


def compact(runs: DataFrame, range_entries: int = 500_000) -> DataFrame:
    """Level 1: runs of disjoint digest ranges, in the shared folder; an entry a digest, with the smallest identifier, the size and the entry that holds the kept row; and a footer a run."""
    ship(runs.sparkSession)
    entries = runs.where(F.col("seq") != FOOTER).select("digest", "n", "min_id", "run", "seq")
    ranges = max(8, -(-entries.count() // range_entries))
    most_bits = max(64, MOST_FILTER_BITS // ranges)
    dealt = entries.repartitionByRange(ranges, "digest").sortWithinPartitions("digest", F.col("min_id").asc_nulls_last(), "run", "seq")
    return stored(dealt.mapInArrow(lambda it: merge_sorted(it, most_bits), LEVEL_SCHEMA), "dedup-level")


def prober(spark, footers: DataFrame, covering: bool):
    """A condition on the digest: false only where the footers (digest, last, filter) exclude it."""
    shared = spark.sparkContext.broadcast(Runs([(bytes(r["digest"]), bytes(r["last"]), bytes(r["filter"])) for r in footers.select("digest", "last", "filter").collect()]))

    @F.arrow_udf("boolean")
    def probe(digests: pa.Array) -> pa.Array:
        return pa.array((shared.value.covering if covering else shared.value.any)(raw(digests)))

    return probe


def lookup(runs: DataFrame, docs: DataFrame, most_bytes: int = 1 << 26) -> DataFrame:
    """doc_id, keep_id of the documents of a new batch whose text an index (its level 0) already has; keep_id is the smallest identifier there.

    The batch is written as runs too, so copies travel as few entries. Only entries that a run's range and filter admit are
    joined; filters of more than 64 MB together (32 million digests) aren't asked, and all entries are joined.
    """
    new = write_runs(docs).where(F.col("seq") != FOOTER).select("digest", "ids")
    footers = runs.where(F.col("seq") == FOOTER)
    if (footers.agg(F.sum(F.octet_length("filter"))).collect()[0][0] or 0) <= most_bytes:
        new = new.where(prober(docs.sparkSession, footers, False)("digest"))
    known = runs.where(F.col("seq") != FOOTER).groupBy("digest").agg(F.min("min_id").alias("keep_id"))
    return new.join(known, "digest").select(F.explode("ids").alias("doc_id"), "keep_id")


def exact_dedup(docs: DataFrame, memtable_rows: int = 50_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    spark = docs.sparkSession
    runs = write_runs(docs, memtable_rows)
    level = compact(runs)
    entries = runs.where(F.col("seq") != FOOTER).select("run", "seq", "digest", "ids")
    maybe = prober(spark, level.where("filter is not null"), True)
    name = F.lower(F.hex("digest")).alias("text_sha256")
    alone = [F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), name]
    unique = entries.where(~maybe("digest")).select(F.get("ids", F.lit(0)).alias("doc_id"), F.get("ids", F.lit(0)).alias("keep_id"), *alone)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")).withColumn("digest", digest_of(F.col("norm")))
    classes = texts.where(maybe("digest")).groupBy("digest", "norm").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_n"))
    classes = stored(classes.select("digest", "class_id", "class_n", second_digest(F.col("norm")).alias("second")), "dedup-classes")
    verified = classes.groupBy("digest").agg(F.min("class_id").alias("class_id"), F.sum("class_n").alias("class_n"), F.count(F.lit(1)).alias("n_texts"))
    clash = stored(verified.where("n_texts > 1").select("digest"), "dedup-clashes")
    index = level.where("filter is null and n > 1").join(verified, "digest").select("digest", "keep_run", "keep_seq", F.col("class_id").alias("keep_id"), F.col("class_n").alias("group_size"))
    rows = entries.where(maybe("digest")).join(index, "digest", "left").select(name, "keep_id", F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("group_size").isNull().alias("single"), ((F.col("run") == F.col("keep_run")) & (F.col("seq") == F.col("keep_seq"))).alias("first"), F.posexplode("ids").alias("pos", "doc_id"))
    hits = rows.select("doc_id", F.when(F.col("single"), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size", (F.col("single") | (F.col("first") & (F.col("pos") == 0))).alias("kept"), "text_sha256")
    if not clash.isEmpty():  # texts that share a digest: by their bytes
        hits = hits.join(clash.select(name), "text_sha256", "left_anti").select(hits.columns)
        own = texts.join(clash, "digest").withColumn("second", second_digest(F.col("norm"))).join(classes, ["digest", "second"])
        hits = hits.unionByName(own.select("doc_id", F.col("class_id").alias("keep_id"), F.col("class_n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), name))
    return unique.unionByName(hits)


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, once each, with all their columns; of rows that share identifier and text, the one of the least hash of all columns."""
    keys = found.where("kept").select(row_key(F.col("text_sha256")).alias(KEY))
    return keep_rows(docs, row_key(F.sha2(normalised(), 256)), keys)

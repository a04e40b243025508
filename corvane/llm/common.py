"""What the operators of this subpackage share: the shared folder, word patterns and small helpers.

Operators select the columns they need first, so further columns of the input, whatever their names, never
meet the names used inside.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators write it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset.

    It is deleted when the driver ends: results that are still lazy read from it until then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    path = f"{(found or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/corvane-{spark.sparkContext.applicationId}"
    if path not in _CLEANED:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)  # only what exists can be marked
        files.deleteOnExit(at)
        _CLEANED.add(path)
    return path


_CLEANED: set[str] = set()
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: Python workers import what operators send them by name."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    made = os.path.join(tempfile.mkdtemp(prefix="corvane-code-"), f"corvane-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(made, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(made)  # copied to Spark's own folder and served to the executors from there
    _SHIPPED.add(context.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def source_key(name: str = "source") -> Column:
    """A key that is never null and sorts by code point with null last: 's' + source, or 't'."""
    return F.when(F.col(name).isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col(name)))


def seeded_hash(seed: int, *names: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(n) for n in names])


def bucket_bits(rows: int, per_bucket: int, most: int = 16) -> int:
    """The bits of a bucket number that leave about per_bucket rows to a bucket; bounded, so that tables of buckets are."""
    return max(1, min(most, (max(1, rows) // per_bucket).bit_length()))


def top_bits(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int")


def longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def cut_index(x: Column, cuts: list) -> Column:
    """How many of the ascending cuts are at most x, by binary search."""
    if not cuts:
        return F.lit(0)
    held = longs(cuts)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(held, at + s - 1) <= x, F.lit(False)), at + s).otherwise(at))


def hash_buckets(rows: DataFrame, n: int, per_bucket: int) -> Column:
    """A bucket number for each of n rows that ascends with (h, g) and leaves about per_bucket rows to a bucket.

    h is a hash of a row's content and g of its place. Rows of one h that make up a 4,096th of all rows or more, the same
    row repeated, are dealt over buckets of their own by g; the driver holds those hashes, 4,096 at most.
    """
    bits = bucket_bits(n, per_bucket)
    bucket = F.shiftright("h", 64 - bits).cast("long")
    found = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(per_bucket, n / 4096)).select("h").collect() if n > per_bucket else []
    if not found:
        return bucket
    hot = sorted(r["h"] for r in found)
    upto = cut_index(F.col("h"), hot)
    same = F.coalesce(F.get(longs(hot), upto - 1) == F.col("h"), F.lit(False))
    fine = bucket_bits(n, per_bucket * len(hot))
    inside = F.when(same, F.shiftright("g", 64 - fine) + (1 << (fine - 1))).otherwise(F.lit(1 << fine))
    return (bucket * (len(hot) + 1) + upto) * ((1 << fine) + 1) + inside


def join_spread(many: DataFrame, one: DataFrame, keys: list[str], n: str, total: int, parts: int = 2000) -> DataFrame:
    """many joined with one, which has a row for each key and in column n the rows that many has of it.

    A key with at least a 2,000th of the total goes by broadcast, so no task gathers it; there are 2,000 of them at most.
    """
    least = max(2, -(-total // parts))
    hot = F.broadcast(one.where(F.col(n) >= least))
    rest = many.join(F.broadcast(one.where(F.col(n) >= least).select(*keys)), keys, "left_anti").join(one.where(F.col(n) < least), keys)
    return many.join(hot, keys).unionByName(rest)


#: Where rows are chosen by a key, its column.
KEY = "key"


def row_key(told_apart_by: Column | None = None) -> Column:
    """Identifier and text in short: rows that share it are the same row repeated."""
    text = F.hex(F.xxhash64(text_or_empty())) if told_apart_by is None else told_apart_by
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def addressed(docs: DataFrame, to: str) -> DataFrame:
    """docs and an address of each row, the same at every read: file and place in it, or a number given in a stored copy."""
    try:
        at = docs.metadataColumn("_metadata")
        return docs.withColumn(to, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row")))
    except AnalysisException:  # not read from files that number their rows
        number = F.monotonically_increasing_id()
        return stored(docs.withColumn(to, F.struct(F.lit(0).cast("long").alias("file"), number.alias("row"))), "rows")


def content_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row: orders rows that an identifier and a text don't tell apart."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def keep_rows(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of docs whose key is in keys (column KEY), one for each key: the one of the least hash of all its columns.

    What is decided on are keys and addresses; the texts themselves are filtered by the addresses to drop, and shuffled only
    if those are too many to broadcast.
    """
    at = fresh(docs, "_row")
    rows = addressed(docs, at)
    small = stored(rows.select(key.alias(KEY), content_hash(docs).alias("tie"), F.col(at).alias("row")), "keys")
    kept = small.join(keys.select(KEY), KEY, "left_semi").groupBy(KEY).agg(F.min(F.struct("tie", "row")).alias("kept")).select("kept.row")
    dropped = stored(small.select(F.col("row").alias(at)).join(kept.withColumnRenamed("row", at), at, "left_anti"), "dropped")
    return rows.join(dropped, at, "left_anti").select(*[f"`{c}`" for c in docs.columns])


HASHES = 4


def _spots(digest: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(digest, F.lit(i)), 64 - bits) for i in range(HASHES)]


def hit_filter(hits: DataFrame, n_hits: int, most_bits: int = 26) -> tuple[np.ndarray, int]:
    """A bloom filter of the hits: 16 bits a digest, at most 2^most_bits bits (8 MB), as words of 64 bits.

    Beyond its size it lets more rows through to the exact step; no hit is ever lost.
    """
    bits = max(10, min(most_bits, (16 * n_hits - 1).bit_length()))
    spots = hits.select(F.explode(F.array(*_spots(F.col("digest"), bits))).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out, bits


def maybe_hit(spark: SparkSession, words: np.ndarray, bits: int):
    """A condition on the digest: false only where the filter excludes it."""
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def probe(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        keep = np.ones(len(a), bool)
        for x in (a, b, c, d):
            spot = np.asarray(x).view(np.uint64)
            keep &= (shared.value[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return pa.array(keep)

    return lambda digest: probe(*_spots(digest, bits))

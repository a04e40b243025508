"""Token counts by rank-synchronous array merging.

Pre-tokens are cut on the JVM; a batch's distinct pre-tokens are merged together in `bpe`, and a document's count is a
difference of running sums. Nothing is shuffled and a batch is worked off in stretches of bounded size.

Cases: null text counts as empty (0 tokens); repeated rows and null identifiers are counted like any other; special
strings count as one token each, the library's default; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import ByteBpe, coded, pre_tokens, slices
from corvane.llm.common import ship, text_or_empty

STRETCH = 1_000_000


def count_lists(bpe: ByteBpe, lists: pa.ListArray) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for a, b in slices(lists, STRETCH):
        words, which, bounds = coded(lists.slice(a, b - a))
        _, lens = bpe.distinct(words)
        running = np.r_[0, np.cumsum(lens[which])] if len(which) else np.zeros(1, np.int64)
        out.append(running[bounds[1:]] - running[bounds[:-1]])
    return np.concatenate(out)


def token_count(spark, path: str, text: Column) -> Column:
    ship(spark)
    bpe = ByteBpe.load(path)
    shared = spark.sparkContext.broadcast(bpe)

    @F.arrow_udf("long")
    def count(lists: pa.Array) -> pa.Array:
        return pa.array(count_lists(shared.value, lists))

    return count(pre_tokens(text, list(bpe.specials)))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    text = text_or_empty()
    n = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(docs.sparkSession, path, text).alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)

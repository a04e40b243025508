"""A quality classifier: a byte-level convolutional network in numpy.

Filters of `width` bytes run over the whole document. It is cut into chunks of `chunk` windows; neighbouring chunks
overlap by width - 1 bytes, so every window lies in exactly one. Each filter is max-pooled over each chunk; the largest
and the mean of the pooled values over the chunks give one probability. A filter is a table of 256 bytes by place, so a
window costs `width` look-ups.

The network is fitted on the driver from at most `sample` labelled documents of at most `most_bytes` together, chosen by
a hash of their identifier (documented bounds; every document is scored, over its whole text). Inputs are the bytes of the text alone.

Cases: null text counts as empty and scores as what the network makes of no windows; without labelled rows every score
is 0.5; a null identifier counts as held out; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ship, text_or_empty

PAD = 256
STRETCH = 4_000_000


def chunked(offsets: np.ndarray, data: np.ndarray, chunk: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the documents, each padded to whole chunks by width - 1 or more, and the number of chunks of each: no window reaches the next document."""
    lens = np.diff(offsets)
    chunks = np.maximum(1, -(-(lens + width - 1) // chunk))
    first = (np.cumsum(chunks) - chunks) * chunk
    out = np.full(int(chunks.sum()) * chunk, PAD, np.int16)
    src = data[offsets[0] : offsets[-1]]
    out[np.repeat(first - (offsets[:-1] - offsets[0]), lens) + np.arange(len(src))] = src
    return out, chunks


@dataclass
class ByteNet:
    filters: np.ndarray  # place, byte, filter; the row of PAD at the first place closes windows that begin behind the text
    bias: np.ndarray
    top: np.ndarray  # weights of the largest, then of the mean pooled values
    shift: float
    chunk: int = 256

    @classmethod
    def new(cls, width: int, filters: int, chunk: int, seed: int) -> ByteNet:
        random = np.random.default_rng(seed)
        table = (random.standard_normal((width, PAD + 1, filters)) * 0.3).astype(np.float32)
        table[:, PAD] = 0
        table[0, PAD] = -1e4
        return cls(table, np.zeros(filters, np.float32), (random.standard_normal(2 * filters) * 0.2).astype(np.float32), 0.0, chunk)

    def pooled(self, text: np.ndarray, where: bool = False):
        """Chunk by filter: the largest window value, and its place if asked for."""
        width, _, filters = self.filters.shape
        padded = np.concatenate([text, np.full(width, PAD, np.int16)])
        n = len(text) // self.chunk
        out, places = np.empty((n, filters), np.float32), np.empty((n, filters), np.int32)
        step = max(1, 32_768 // self.chunk)
        for at in range(0, n, step):
            upto = min(n, at + step)
            size = (upto - at) * self.chunk
            total = np.take(self.filters[0], padded[at * self.chunk :][:size], axis=0)
            for place in range(1, width):
                total += np.take(self.filters[place], padded[at * self.chunk + place :][:size], axis=0)
            total = total.reshape(upto - at, self.chunk, filters)
            out[at:upto] = total.max(axis=1)
            if where:
                places[at:upto] = total.argmax(axis=1) + (np.arange(at, upto) * self.chunk)[:, None]
        return out + self.bias, places

    def combined(self, pooled: np.ndarray, chunks: np.ndarray):
        held = np.maximum(pooled, 0)
        first = np.cumsum(chunks) - chunks
        most = np.maximum.reduceat(held, first, axis=0)
        mean = np.add.reduceat(held, first, axis=0) / chunks[:, None]
        logit = np.concatenate([most, mean], axis=1) @ self.top + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), most, mean

    def score(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        text, chunks = chunked(offsets, data, self.chunk, len(self.filters))
        return self.combined(self.pooled(text)[0], chunks)[0].astype(float)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), np.frombuffer(b"".join(texts), np.uint8)


def fit(texts: list[bytes], labels: list[int], width: int = 6, filters: int = 16, chunk: int = 256, epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 5, least_steps: int = 300) -> ByteNet:
    """Logistic loss by Adam, for `epochs` rounds or `least_steps` steps; the gradient of a pooled value goes to the window that won."""
    net = ByteNet.new(width, filters, chunk, seed)
    y = np.array(labels, np.float32)
    net.shift = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    random = np.random.default_rng(seed)
    names = ("filters", "bias", "top", "shift")
    moments = {n: [np.zeros_like(np.asarray(getattr(net, n), np.float32)) for _ in range(2)] for n in names}
    step = 0
    rounds = max(epochs, -(-least_steps // -(-len(texts) // batch)))
    total = rounds * -(-len(texts) // batch)
    for _ in range(rounds):
        order = random.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            text, chunks = chunked(*joined([texts[i] for i in own]), chunk, width)
            pooled, places = net.pooled(text, where=True)
            p, most, mean = net.combined(pooled, chunks)
            error = ((p - y[own]) / len(own)).astype(np.float32)
            back = error[:, None] * net.top[None, :]
            doc = np.repeat(np.arange(len(own)), chunks)
            through = (pooled > 0) * (back[doc, filters:] / chunks[doc][:, None] + back[doc, :filters] * (pooled == most[doc]))
            grad = {"filters": np.zeros_like(net.filters), "bias": through.sum(axis=0), "top": error @ np.concatenate([most, mean], axis=1), "shift": error.sum()}
            padded = np.concatenate([text, np.full(width, PAD, np.int16)])
            which = np.broadcast_to(np.arange(filters), places.shape)
            for place in range(width):
                np.add.at(grad["filters"][place], (padded[places + place], which), through)
            grad["filters"][:, PAD] = 0
            step += 1
            pace = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for n in names:
                m, v = moments[n]
                m += 0.1 * (grad[n] - m)
                v += 0.001 * (grad[n] ** 2 - v)
                change = pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, getattr(net, n) - change if n == "shift" else (getattr(net, n) - change).astype(np.float32))
    net.shift = float(net.shift)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_bytes: int = 32_000_000, **how) -> ByteNet | None:
    """Fit on at most `sample` labelled documents that aren't held out and hold at most `most_bytes`; they are taken in the order of a hash of their identifier, which depends on nothing else."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_label"))
    known = known.where(~held_out("_id")).withColumn("_order", F.xxhash64(F.lit(11), "_id")).orderBy("_order", "_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().cast("binary").alias("_bytes"))
    sizes = texts.select("_id", F.octet_length("_bytes").alias("_size")).join(F.broadcast(known), "_id").groupBy("_id", "_label", "_order").agg(F.sum("_size").alias("_size")).orderBy("_order", "_id").collect()
    chosen, held = [], 0
    for r in sizes:
        held += r["_size"]
        if held > most_bytes and chosen:
            break
        chosen.append((r["_id"], r["_label"]))
    if not chosen:
        return None
    own = docs.sparkSession.createDataFrame(chosen, "_id long, _label int")
    rows = texts.join(F.broadcast(own), "_id").orderBy("_id", "_bytes").collect()
    return fit([bytes(r["_bytes"]) for r in rows], [int(r["_label"]) for r in rows], **how)


def quality_score(spark, net: ByteNet | None, text: Column) -> Column:
    if net is None:
        return F.lit(0.5)
    ship(spark)
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out, at = [np.zeros(0)], 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1)
            out.append(shared.value.score(offsets[at : upto + 1], data))
            at = upto
        return pa.array(np.concatenate(out))

    return score(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    net = train(docs, labels, **how)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), quality_score(docs.sparkSession, net, text_or_empty()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are sorted by the population counts of their four 16-bit quarters and cut into tiles. A pair of
tiles whose counts differ by more than the radius (summed over the quarters, a lower bound of the distance) is skipped;
so are pairs of stretches inside tiles. All others are compared exactly by numpy exclusive-or and bit counts. A pair of
tiles gives a spanning forest of its links, never all of them, and `components` joins the forests.

With `min_similarity` a link also needs that estimated Jaccard similarity of five-word shingles, from a sketch of 128
minima of one byte each that travels with the fingerprint. A wide radius then finds copies that differ by more than a
few words, and the sketch keeps unrelated texts apart.

With `least_jaccard` these links are candidates, and each is confirmed by the Jaccard similarity of the whole shingle
sets (of 64-bit hashes). Two passes do it: the first confirms a spanning forest of the likeliest candidates, the second
all candidates between the components that this makes. So every candidate is confirmed, refuted or inside a component.
No Jaccard similarity is above the ratio of the sets' sizes, so tiles are cut by size here, and pairs of tiles or
stretches whose sizes are too far apart are skipped; no link of that similarity is lost by it.

The comparison is exact, so its cost grows with the square of the distinct fingerprints that the counts or sizes let
through.
The driver holds one row per tile (1,024 at most), never fingerprints; tiles of more than 60,000 points are dealt into
parts of that size, so what a task holds doesn't grow with the table.

Cases: null text counts as empty; texts without words have fingerprint zero; equal texts share fingerprint and
component; null identifiers are members, but never name a component unless it has no other; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import KEY, join_spread, keep_rows, row_key, ship, stored, text_or_empty
from corvane.llm.components import components

LANES = 128
STRETCH = 256
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the shingles, repeats included; of all words if there are fewer; none without words."""
    own = text.translate(_LOWER).split()  # bytes split at ASCII white space only
    if not own:
        return np.zeros(0, np.uint64)
    whole = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own])
    n = max(1, len(own) - words + 1)
    begin = np.r_[0, ends[: n - 1]].tolist()
    end = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(begin, end, strict=True)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """Bit by bit, 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def sketch(hashes: np.ndarray) -> bytes:
    """The least hash of each of 128 lanes as one byte, 0 for an empty lane."""
    lane = (hashes >> np.uint64(57)).astype(np.int64)
    order = np.argsort(hashes)
    least = np.zeros(LANES, np.uint8)
    least[lane[order[::-1]]] = (hashes[order[::-1]] % np.uint64(255)).astype(np.uint8) + 1
    return least.tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of lanes; 1 where both are empty."""
    some = ((a | b) != 0).sum(axis=1)
    return np.where(some, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(some, 1), 1.0)


def set_key(distinct: np.ndarray) -> int:
    """One number for a set of shingles, given in ascending order."""
    return xxhash.xxh64_intdigest(distinct.tobytes())


def fingerprinted(docs: DataFrame, words: int = 3, sketch_words: int = 0, by_set: bool = False) -> DataFrame:
    """doc_id, fp (signed), sketch, row_key, node: in the shared folder. by_set: nodes are the sets of shingles, size is their number."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), row_key().alias("row_key"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            prints, sketches = np.zeros(len(texts), np.uint64), []
            keys, sizes = (np.zeros(len(texts) if by_set else 0, t) for t in (np.uint64, np.int64))
            for i, text in enumerate(texts):
                raw = text.as_py()
                hashes = shingle_hashes(raw, words)
                prints[i] = simhash(hashes)
                if sketch_words and sketch_words != words:
                    hashes = shingle_hashes(raw, sketch_words)
                sketches.append(sketch(hashes) if sketch_words else b"")
                if by_set:
                    distinct = np.unique(hashes)
                    keys[i], sizes[i] = set_key(distinct), len(distinct)
            columns = [batch.column(0), pa.array(prints.view(np.int64)), pa.array(sketches, pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(keys.view(np.int64)), pa.array(sizes)] if by_set else [])], names=["doc_id", "fp", "sketch", "row_key", *(["node", "size"] if by_set else [])])

    made = rows.mapInArrow(run, "doc_id long, fp long, sketch binary, row_key string" + ", node long, size long" * by_set)
    if by_set:
        return stored(made, "simhash-rows")
    return stored(made.withColumn("node", F.xxhash64("fp", "sketch") if sketch_words else F.col("fp")), "simhash-rows")


def quarters(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def boxes(counts: np.ndarray) -> np.ndarray:
    """Least and largest counts of each stretch: stretch, (least, largest), quarter."""
    starts = np.arange(0, len(counts), STRETCH)
    return np.stack([np.minimum.reduceat(counts, starts, axis=0), np.maximum.reduceat(counts, starts, axis=0)], axis=1)


def gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the distance between any members of boxes a (rows) and b (columns)."""
    a, b = a[:, None].astype(np.int32), b[None].astype(np.int32)
    return np.maximum(0, np.maximum(a[:, :, 0] - b[:, :, 1], b[:, :, 0] - a[:, :, 1])).sum(axis=2)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between 0 .. n - 1 reduced to one from each node to the least of its component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (label[a], label[b], a, b):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def compare(one: tuple, two: tuple | None, radius: int, min_similarity: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Links within a tile (two is None) or between two, as a forest over their nodes. A tile: prints, nodes, sketches."""
    other = two or one
    base = 0 if two is None else len(one[0])
    a_box, b_box = boxes(quarters(one[0])), boxes(quarters(other[0]))
    a_links, b_links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held = 0
    size = len(one[0]) + (0 if two is None else len(two[0]))
    for i, row in enumerate(gap(a_box, b_box) <= radius):
        left = one[0][i * STRETCH : (i + 1) * STRETCH, None]
        for j in np.flatnonzero(row):
            if two is None and j < i:
                continue
            right = other[0][j * STRETCH : (j + 1) * STRETCH]
            p, q = np.nonzero(np.bitwise_count(left ^ right) <= radius)
            p, q = p + i * STRETCH, q + j * STRETCH
            if two is None:
                p, q = p[p < q], q[p < q]
            if min_similarity is not None and len(p):
                near = similarity(one[2][p], other[2][q]) >= min_similarity
                p, q = p[near], q[near]
            if len(p) > STRETCH:  # a family of copies: its forest is enough
                nodes, index = np.unique(np.r_[p, q + base], return_inverse=True)
                x, y = forest(index[: len(p)], index[len(p) :], len(nodes))
                a_links.append(nodes[x])
                b_links.append(nodes[y])
            elif len(p):
                a_links.append(p)
                b_links.append(q + base)
            held += len(a_links[-1]) if len(p) else 0
            if held > 4 * size + 65_536:
                x, y = forest(np.concatenate(a_links), np.concatenate(b_links), size)
                a_links, b_links, held = [x], [y], len(x)
    x, y = forest(np.concatenate(a_links), np.concatenate(b_links), size)
    nodes = one[1] if two is None else np.concatenate([one[1], two[1]])
    return nodes[x], nodes[y]


def likeliest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which links between 0 .. n - 1 make the spanning forest of the greatest weight."""
    order = np.argsort(-weight, kind="stable")
    a, b = a[order], b[order]
    label, left, taken = np.arange(n), np.arange(len(a)), np.zeros(len(a), bool)
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return order[taken]
        best = np.full(n, len(a))  # the best link of each component
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        links = np.unique(best[best < len(a)])
        taken[links] = True
        nodes, least = forest(label[a[links]], label[b[links]], n)
        moved = np.arange(n)
        moved[nodes] = least
        label = moved[label]


def sizes_allow(a: np.ndarray, b: np.ndarray, least_jaccard: float) -> np.ndarray:
    """Whether any members of ranges of set sizes a (rows: least, largest) and b (columns) can be that similar."""
    a, b = a[:, None].astype(np.float64), b[None].astype(np.float64)
    least = least_jaccard * (1 - 1e-9)
    return (a[:, :, 1] >= least * b[:, :, 0]) & (b[:, :, 1] >= least * a[:, :, 0])


def size_ranges(sizes: np.ndarray) -> np.ndarray:
    starts = np.arange(0, len(sizes), STRETCH)
    return np.stack([np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts)], axis=1)


class Within:
    """Which of two stretches' fingerprints differ by at most radius bits; works in the same memory at each call."""

    def __init__(self, radius: int):
        self.radius = radius
        self.bits, self.counts, self.hits = np.empty(STRETCH**2, np.uint64), np.empty(STRETCH**2, np.uint8), np.empty(STRETCH**2, bool)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        n = len(left) * len(right)
        bits, counts, hits = (x[:n].reshape(len(left), len(right)) for x in (self.bits, self.counts, self.hits))
        np.bitwise_xor(left[:, None], right, out=bits)
        np.bitwise_count(bits, out=counts)
        np.less_equal(counts, self.radius, out=hits)
        return np.nonzero(hits) if hits.any() else None


def candidates(one: tuple, two: tuple | None, radius: int, min_similarity: float, every: bool, least_jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within a tile (two is None) or between two: every one whose labels differ, or the likeliest forest of them.

    A tile: prints, nodes, sketches, labels (of nodes of one label no pair is wanted), sizes of the sets, by which it is sorted.
    """
    other = two or one
    base = 0 if two is None else len(one[0])
    size = base + len(other[0])
    none = np.zeros(0, np.int64)
    a, b, weight, held = [none], [none], [np.zeros(0)], 0
    within = Within(radius)
    near = gap(boxes(quarters(one[0])), boxes(quarters(other[0]))) <= radius
    for i, row in enumerate(near & sizes_allow(size_ranges(one[4]), size_ranges(other[4]), least_jaccard)):
        left = one[0][i * STRETCH : (i + 1) * STRETCH]
        for j in np.flatnonzero(row):
            if two is None and j < i:
                continue
            found = within(left, other[0][j * STRETCH : (j + 1) * STRETCH])
            if found is None:
                continue
            p, q = found[0] + i * STRETCH, found[1] + j * STRETCH
            wanted = one[3][p] != other[3][q]
            if two is None:
                wanted &= p < q
            p, q = p[wanted], q[wanted]
            if not len(p):
                continue
            like = similarity(one[2][p], other[2][q])
            near = like >= min_similarity
            if not near.any():
                continue
            a.append(p[near])
            b.append(q[near] + base)
            weight.append(like[near])
            held += len(a[-1])
            if not every and held > 4 * size + 65_536:
                x, y, w = np.concatenate(a), np.concatenate(b), np.concatenate(weight)
                best = likeliest(x, y, w, size)
                a, b, weight, held = [x[best]], [y[best]], [w[best]], len(best)
    x, y = np.concatenate(a), np.concatenate(b)
    if not every:
        best = likeliest(x, y, np.concatenate(weight), size)
        x, y = x[best], y[best]
    nodes = one[1] if two is None else np.concatenate([one[1], two[1]])
    return nodes[x], nodes[y]


def near_links(points: DataFrame, radius: int, min_similarity: float | None = None, tile_rows: int = 60_000, least_tiles: int = 16, most_tiles: int = 1024, pairs_of: str | None = None, least_jaccard: float = 0.0) -> DataFrame:
    """points (fp, sketch, node; distinct) to links (a, b) that join whatever is near.

    pairs_of: near pairs themselves, a "forest" of them or "every" one between labels (points have a label), as a row for
    each pair of tiles: pair, a and b (arrays of longs as bytes), ends (the nodes in them). Points have a size then, and
    pairs whose sizes exclude least_jaccard are left out.
    """
    spark = points.sparkSession
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(0xFFFF)) for q in range(4)]
    place = counts[0] * 17**3 + counts[1] * 17**2 + counts[2] * 17 + counts[3]
    if pairs_of:
        place = F.col("size")
    # the order: the quarters' counts or the size, then the fingerprint as a fraction
    points = points.withColumn("place", place.cast("double") + F.pmod(F.xxhash64("fp", "node"), F.lit(1 << 20)) / float(1 << 20))
    n = points.count()
    tiles = max(least_tiles, min(most_tiles, -(-n // tile_rows)))
    parts = max(1, -(-n // (tiles * tile_rows)))  # of a tile, by hash, so that none is larger however many points there are
    cuts = points.select(F.percentile_approx("place", [k / tiles for k in range(1, tiles)], 20 * tiles).alias("cuts")).collect()[0]["cuts"] or []
    number = sum((F.col("place") > c).cast("int") for c in cuts) if cuts else F.lit(0)

    def cut(table: pa.Table) -> pa.Table:
        prints = table.column("fp").to_numpy().view(np.uint64)
        own = quarters(prints)
        sizes = table.column("size").to_numpy() if pairs_of else None
        order = np.argsort(sizes, kind="stable") if pairs_of else np.lexsort((*own.T[::-1],))
        table = table.take(pa.array(order))
        prints = np.ascontiguousarray(prints[order])
        own = own[order]
        box = np.stack([own.min(axis=0), own.max(axis=0)]).ravel().tolist()
        nodes = np.ascontiguousarray(table.column("node").to_numpy())
        sketches = b"".join(table.column("sketch").to_pylist())
        labels = {}
        if pairs_of:
            sizes = np.ascontiguousarray(sizes[order])
            labels = {"labels": pa.array([np.ascontiguousarray(table.column("label").to_numpy()).tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()), "span": pa.array([[int(sizes[0]), int(sizes[-1])]], pa.list_(pa.int64()))}
        return pa.table({"tile": pa.array([table.column("tile")[0].as_py()], pa.int32()), "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "box": pa.array([box], pa.list_(pa.int32())), "fps": pa.array([prints.tobytes()], pa.binary()), "nodes": pa.array([nodes.tobytes()], pa.binary()), "sketches": pa.array([sketches], pa.binary()), **labels})

    if pairs_of == "forest":
        points = points.withColumn("label", F.col("node"))
    columns = ["fp", "node", "sketch", *(["label", "size"] if pairs_of else [])]
    cutting = points.select(number.cast("int").alias("tile"), F.pmod(F.xxhash64("node", F.lit(3)), F.lit(parts)).cast("int").alias("part"), *columns)
    cutting = cutting.groupBy("tile", "part").applyInArrow(cut, "tile int, part int, box array<int>, fps binary, nodes binary, sketches binary" + ", labels binary, sizes binary, span array<long>" * bool(pairs_of))
    made = stored(cutting, "simhash-tiles")
    sides = [F.min(F.col("box")[k]) for k in range(4)] + [F.max(F.col("box")[k]) for k in range(4, 8)]
    span = [F.array(F.min(F.col("span")[0]), F.max(F.col("span")[1])).alias("span")] if pairs_of else []
    found = made.groupBy("tile").agg(F.array(*sides).alias("box"), *span).collect()
    box = np.array([r["box"] for r in found], np.int16).reshape(-1, 2, 4)
    near = gap(box, box) <= radius if len(found) else np.zeros((0, 0), bool)
    if pairs_of and found:
        spans = np.array([r["span"] for r in found])
        near &= sizes_allow(spans, spans, least_jaccard)
    pairs = [(k, found[i]["tile"], found[j]["tile"]) for k, (i, j) in enumerate(zip(*np.nonzero(near), strict=True)) if found[i]["tile"] <= found[j]["tile"]]
    of = F.sequence(F.lit(0), F.lit(parts - 1))
    wanted = spark.createDataFrame(pairs or [(0, -1, -1)], "k long, i int, j int").select("*", F.explode(of).alias("p")).select("*", F.explode(of).alias("q")).where("i <> j or p <= q")
    ends = F.array_distinct(F.array(F.struct(F.col("i").alias("tile"), F.col("p").alias("part")), F.struct(F.col("j").alias("tile"), F.col("q").alias("part"))))
    wanted = wanted.select(((F.col("k") * parts + F.col("p")) * parts + F.col("q")).alias("pair"), F.explode(ends).alias("of")).select("pair", "of.*")

    def work(table: pa.Table) -> pa.Table:
        own = []
        for row in table.sort_by([("tile", "ascending"), ("part", "ascending")]).to_pylist():
            prints = np.frombuffer(row["fps"], np.uint64)
            own.append((prints, np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["sketches"], np.uint8).reshape(len(prints), -1)))
            if pairs_of:
                own[-1] += (np.frombuffer(row["labels"], np.int64), np.frombuffer(row["sizes"], np.int64))
        two = own[1] if len(own) > 1 else None
        if pairs_of:
            a, b = candidates(own[0], two, radius, min_similarity, pairs_of == "every", least_jaccard)
            some = 1 if len(a) else 0
            row = {"pair": [table.column("pair")[0].as_py()], "a": [a.tobytes()], "b": [b.tobytes()], "ends": [np.unique(np.r_[a, b])]}
            return pa.table({k: pa.array(v[:some], t) for (k, v), t in zip(row.items(), (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)})
        a, b = compare(own[0], two, radius, min_similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return made.drop("box", "span").join(wanted, ["tile", "part"]).groupBy("pair").applyInArrow(work, "pair long, a binary, b binary, ends array<long>" if pairs_of else "a long, b long")


def confirmed(docs: DataFrame, points: DataFrame, links: DataFrame, words: int, least_jaccard: float) -> DataFrame:
    """Links (a, b) that join what the links of at least that Jaccard similarity join; links as near_links has pairs.

    Sets are made of the linked texts only and go to a pair of tiles once, not once a link.
    """
    ship(docs.sparkSession)
    needs = links.select(F.col("pair").alias("place"), F.explode("ends").alias("node"))
    keys = points.join(needs.select("node").distinct(), "node").select(F.col("rep.row_key").alias(KEY))
    rows = docs.select(text_or_empty().cast("binary").alias("text"), row_key().alias(KEY)).join(keys, KEY, "left_semi").select("text")

    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(text.as_py(), words) for text in batch.column(0)]
            sets = [np.unique(own) for own in sets]
            keys = np.array([set_key(own) for own in sets], np.uint64)
            sets = [own.view(np.int64) for own in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = stored(rows.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), "simhash-sets")

    def verify(pairs: pa.Table, held: pa.Table) -> pa.Table:
        nodes = held.column("node").to_numpy()
        of = [x.values.to_numpy() for x in held.column("shingles")]
        order = np.argsort(nodes)
        a, b = (order[np.searchsorted(nodes, np.frombuffer(pairs.column(k)[0].as_py(), np.int64), sorter=order)] for k in ("a", "b"))
        good = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = of[i], of[j]
            if min(len(x), len(y)) >= least_jaccard * max(len(x), len(y)) - 1:  # no similarity is above the sizes' ratio
                common = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = common / (len(x) + len(y) - common) >= least_jaccard
        x, y = forest(a[good], b[good], len(nodes))
        return pa.table({"a": pa.array(nodes[x], pa.int64()), "b": pa.array(nodes[y], pa.int64())})

    return links.groupBy("pair").cogroup(needs.join(sets, "node").groupBy("place")).applyInArrow(verify, "a long, b long")


def confirmed_links(docs: DataFrame, points: DataFrame, words: int, radius: int, min_similarity: float, least_jaccard: float, **tiling) -> DataFrame:
    """Links (a, b) of that Jaccard similarity which join all that candidates of that similarity join."""
    bare = points.select("fp", "sketch", "node", "size")
    tiling["least_jaccard"] = least_jaccard
    first = stored(near_links(bare, radius, min_similarity, pairs_of="forest", **tiling), "simhash-forest")
    good = stored(confirmed(docs, points, first, words, least_jaccard), "simhash-confirmed")
    labelled = bare.join(components(good), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = near_links(stored(labelled, "simhash-labelled"), radius, min_similarity, pairs_of="every", **tiling)
    return good.unionByName(confirmed(docs, points, stored(rest, "simhash-rest"), words, least_jaccard))


def near_components(docs: DataFrame, words: int = 3, radius: int = 3, sketch_words: int = 0, min_similarity: float | None = None, least_jaccard: float | None = None, **tiling) -> DataFrame:
    """doc_id, fingerprint (hex), component_id; represents: the row that stands for its component; row_key.

    least_jaccard needs sketch_words and min_similarity, which then make candidates only.
    """
    rows = fingerprinted(docs, words, sketch_words if min_similarity is not None else 0, least_jaccard is not None)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    sized = [F.first("size").alias("size")] if least_jaccard is not None else []
    points = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), *sized, F.min(first).alias("rep"), F.count(F.lit(1)).alias("n"))
    points = stored(points, "simhash-points")
    n_rows, n_points = (r or 0 for r in points.agg(F.sum("n"), F.count(F.lit(1))).collect()[0])
    if least_jaccard is None:
        links = near_links(points.select("fp", "sketch", "node"), radius, min_similarity, **tiling)
    else:
        links = confirmed_links(docs, points, sketch_words, radius, min_similarity, least_jaccard, **tiling)
    linked = components(links)
    labelled = points.select("node", "rep", "n").join(linked, "node", "left").select("node", "rep", "n", F.coalesce("label", "node").alias("label"))
    labelled = stored(labelled, "simhash-labels")
    named = stored(labelled.groupBy("label").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("points")), "simhash-names")
    names = join_spread(labelled.select("node", "label", "n"), named, ["label"], "points", n_points)
    names = stored(names.select("node", "n", F.col("rep.doc_id").alias("component_id"), F.col("rep.row_key").alias("rep_key")), "simhash-named")
    out = join_spread(rows, names, ["node"], "n", n_rows)  # a text that very many rows share doesn't gather in one task
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("row_key") == F.col("rep_key")).alias("represents"), "row_key")


def keep_representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that represent their component, once each, with all their columns."""
    return keep_rows(docs, row_key(), found.where("represents").select(F.col("row_key").alias(KEY)))

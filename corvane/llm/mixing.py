"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). A flow routes the words of
the patterns to the quotas of the sources; taking a document again costs more each time (convex), so words are
repeated only where a quota can't be met otherwise. The flow of a pattern becomes copies: every document whole times,
and a seeded choice of documents once more. The choice is a prefix of the order (h, g): h is a seeded hash of the whole
row, g one of its address, which matters for rows repeated in full only. The bucket of the order in which the quota ends
is found by sums over buckets and split again by further bits, first of h, then of g, until it holds few rows, whatever
the size of the buckets. An exact subset sum over the documents around the end closes what is left of the quota.

Cases: null text has no words; a null source is a source of its own, last in order; documents without words are taken 0
words; repeated rows are taken each for itself; rows that share identifier and text but differ elsewhere are rows of
their own; an empty table gives an empty result. Reruns agree, up to which of fully equal rows is meant. Very long
texts: where the documents around the end have more than 4 million words, the longest of them are taken in order of
their length while they fit, and the subset sum is over the others.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, addressed, bucket_bits, content_hash, fresh, seeded_hash, ship, source_key, stored

MOST_TIMES = 3


def share_targets(sizes: list[int], weights: list[float], total: float | None = None, most: int = MOST_TIMES) -> list[float]:
    """Shares of the total by weight; a share stops at `most` times its size, and the excess is shared again by weight."""
    left = float(sum(sizes) if total is None else total)
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in over]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
    return out


def min_cost_flow(patterns: list[tuple[frozenset, int]], quotas: dict, most: int = MOST_TIMES) -> list[dict]:
    """Words of each pattern that go to each source: successive shortest paths on start -> pattern (a tier a repetition, cost 0, 1, 2, ...) -> source -> end."""
    names = list(quotas)
    n = len(patterns) + len(names) + 2
    start, end = n - 2, n - 1
    node = {s: len(patterns) + i for i, s in enumerate(names)}
    arcs: list[list] = []  # to, capacity, cost
    out: list[list[int]] = [[] for _ in range(n)]

    def add(a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, c, w])
        return len(arcs) - 2

    links = []
    for p, (members, words) in enumerate(patterns):
        for tier in range(most):
            add(start, p, words, tier)
        links.append({s: add(p, node[s], most * words, 0) for s in sorted(members) if s in node})
    for s in names:
        add(node[s], end, quotas[s], 0)
    potential = [0] * n
    while True:
        far, via, heap = [float("inf")] * n, [-1] * n, [(0, start)]
        far[start] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for k in out[x]:
                y, cap, cost = arcs[k]
                if cap > 0 and (e := d + cost + potential[x] - potential[y]) < far[y]:
                    far[y], via[y] = e, k
                    heapq.heappush(heap, (e, y))
        if far[end] == float("inf"):
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    return [{s: arcs[k ^ 1][1] for s, k in of.items()} for of in links]


def fill(sizes: list[int], room: int, most: int = 1 << 22) -> list[bool]:
    """A subset of few sizes whose sum comes nearest to room from below, by sets of reachable sums held as bits.

    Exact if the sizes' sum is `most` at most; otherwise the longest are taken while they fit until that holds for the rest.
    """
    taken = [False] * len(sizes)
    total, open_ = sum(sizes), sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    while open_ and total > most:
        i = open_.pop()
        total -= sizes[i]
        if sizes[i] <= room:
            taken[i], room = True, room - sizes[i]
    reach = [1]
    mask = (1 << (min(room, total) + 1)) - 1
    for i in open_:
        reach.append((reach[-1] | reach[-1] << sizes[i]) & mask if sizes[i] <= room else reach[-1])
    best = reach[-1].bit_length() - 1
    for k in range(len(open_) - 1, -1, -1):
        if not reach[k] >> best & 1:
            taken[open_[k]], best = True, best - sizes[open_[k]]
    return taken


def choose(sizes: list[int], room: int, tail: int) -> list[bool]:
    """In order while they fit, then a subset of the `tail` documents from the first that doesn't, and of half as many before it."""
    at, left = 0, room
    while at < len(sizes) and sizes[at] <= left:
        left, at = left - sizes[at], at + 1
    back = min(tail // 2, at)  # the last documents of the prefix are open again
    at, left = at - back, left + sum(sizes[at - back : at])
    around = sizes[at : at + tail + back]
    return [True] * at + fill(around, min(left, sum(around))) + [False] * (len(sizes) - at - len(around))


def prefix(bits: str) -> Column:
    """The first bits of (h, g), 128 together, as a number that ascends with them inside what bits - 64 of h leave."""
    return F.expr(f"CASE WHEN {bits} = 0 THEN 0L WHEN {bits} <= 64 THEN shiftright(h, 64 - {bits}) ELSE shiftright(g, 128 - {bits}) END")


def side() -> Column:
    """-1, 0 or 1: before, in or behind the bucket in which the pattern's prefix ends."""
    own = prefix("bits")
    fine = F.col("bits") > 64
    return F.when(fine & (F.col("h") < F.col("h_at")), -1).when(fine & (F.col("h") > F.col("h_at")), 1).when(own < F.col("at"), -1).when(own > F.col("at"), 1).when(own == F.col("at"), 0)


def ends(rows: DataFrame, rooms: list[tuple], step: int, few: int) -> list[tuple]:
    """(pattern, room, bits, at, h_at): the bucket in which each pattern's prefix ends, and the words to take from there on.

    rows (pattern, size, h, g). Every round splits the buckets that hold more than `few` rows by further bits.
    """
    spark = rows.sparkSession
    now, done, inside = [(pattern, room, 0, 0, 0) for pattern, room in rooms if room > 0], [], rows
    while now:
        state = spark.createDataFrame(now, STATE)
        inside = inside.join(F.broadcast(state), "pattern").where(side() == 0)
        inside = inside.withColumn("next", F.least(F.col("bits") + step, F.when(F.col("bits") < 64, 64).otherwise(128)))
        sums = inside.groupBy("pattern", "room", "next", prefix("next").alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("h").alias("least_h"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("upto", upto).where((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("words") <= F.col("room"))).collect()
        now = []
        for r in found:
            (now if r["n"] > few and r["next"] < 128 else done).append((r["pattern"], r["room"] - r["upto"] + r["words"], r["next"], r["bucket"], r["least_h"]))
        if now:
            inside, step = stored(inside.select(rows.columns), "mix-inside"), 12
    return done


def borders(rows: DataFrame, found: list[tuple], step: int, tail: int) -> list[tuple]:
    """(pattern, from_h, from_g, upto_h, upto_g, words): tail / 2 documents before the bucket of each pattern's end, with their words, and tail behind it."""
    spark = rows.sparkSession
    state = F.broadcast(spark.createDataFrame(found, STATE))
    first = F.expr(f"shiftright(h, {64 - step})")
    # only buckets that may hold those documents are sorted
    own = spark.createDataFrame([(pattern, at >> (bits - step) if bits <= 64 else h_at >> (64 - step)) for pattern, _, bits, at, h_at in found], "pattern string, own long")
    counts = rows.groupBy("pattern", first.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    behind = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("pattern").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(F.broadcast(own), "pattern").withColumn("under", F.col("bucket") < F.col("own")).withColumn("over", F.col("bucket") > F.col("own"))
    left = F.coalesce(F.sum(F.when(F.col("under"), F.col("n")).otherwise(0)).over(ahead), F.lit(0))
    right = F.coalesce(F.sum(F.when(F.col("over"), F.col("n")).otherwise(0)).over(behind), F.lit(0))
    reach = counts.withColumn("wanted", F.when(F.col("under"), left < tail // 2).when(F.col("over"), right < tail).otherwise(True))
    reach = reach.where("wanted").groupBy("pattern").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    near = rows.join(state, "pattern").join(F.broadcast(reach), "pattern").where(first.between(F.col("low"), F.col("high"))).withColumn("side", side())
    key = F.struct("h", "g")
    before = near.where("side < 0").withColumn("k", F.row_number().over(Window.partitionBy("pattern").orderBy(F.desc("h"), F.desc("g")))).where(F.col("k") <= tail // 2)
    after = near.where("side > 0").withColumn("k", F.row_number().over(Window.partitionBy("pattern").orderBy("h", "g"))).where(F.col("k") <= tail)
    before = before.groupBy("pattern").agg(F.min(key).alias("key"), F.sum("size").alias("words")).withColumn("side", F.lit(-1))
    after = after.groupBy("pattern").agg(F.max(key).alias("key"), F.sum("size").alias("words")).withColumn("side", F.lit(1))
    got = {(r["pattern"], r["side"]): r for r in before.unionByName(after).collect()}
    out = []
    for pattern, *_ in found:
        a, b = got.get((pattern, -1)), got.get((pattern, 1))
        out.append((pattern, *((a["key"]["h"], a["key"]["g"]) if a else (None, None)), *((b["key"]["h"], b["key"]["g"]) if b else (None, None)), a["words"] if a else 0))
    return out


STATE = "pattern string, room long, bits int, at long, h_at long"
BORDERS = "pattern string, from_h long, from_g long, upto_h long, upto_g long, words long"


def mix(docs: DataFrame, members: Column, weight_of, seed: int = 29, total: float | None = None, per_bucket: int = 256, tail: int = 48, few: int = 512, rows: DataFrame | None = None, at: str = "") -> tuple[DataFrame, dict]:
    """(doc_id, row, pattern, size, times), and the plan on the driver: sizes, targets and flows by source.

    members: an array of the keys of the sources that a document belongs to. weight_of: sorted keys to weights. row: the
    address of the row; the caller may give rows, which is docs with the addresses in the column at. The driver holds a row
    per membership pattern, never a row per document.
    """
    spark = docs.sparkSession
    ship(spark)
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    if rows is None:
        at = fresh(docs, "_row")
        rows = addressed(docs, at)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(at).alias("row"), size.alias("size"), F.array_sort(F.array_distinct(members)).alias("members"), F.xxhash64(F.lit(seed), content_hash(docs)).alias("h"))
    rows = stored(rows.withColumn("pattern", F.to_json("members")).withColumn("g", seeded_hash(seed, "row")), "mix-rows")
    found = rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    patterns = [(frozenset(r["members"]), r["size"]) for r in found]
    keys = sorted({s for p, _ in patterns for s in p}, key=lambda s: s.encode())
    sizes = {s: sum(w for p, w in patterns if s in p) for s in keys}
    targets = dict(zip(keys, share_targets([sizes[s] for s in keys], weight_of(keys), sum(w for _, w in patterns) if total is None else total), strict=True))
    flows = min_cost_flow(patterns, {s: round(t) for s, t in targets.items()})
    plan = {"sizes": sizes, "targets": targets, "flows": [(r["pattern"], r["members"], f) for r, f in zip(found, flows, strict=True)]}
    takes = [(r["pattern"], (got := sum(f.values())) // max(1, r["size"]), got % max(1, r["size"])) for r, f in zip(found, flows, strict=True)]
    whole = spark.createDataFrame([t[:2] for t in takes] or [("", 0)], "pattern string, whole long")
    rows = rows.drop("members")
    columns = ["doc_id", "row", "pattern", "size"]
    step = bucket_bits(sum(r["n"] for r in found), per_bucket)
    last = ends(rows.select("pattern", "size", "h", "g"), [(p, room) for p, _, room in takes], step, few)
    if not last:
        return rows.join(F.broadcast(whole), "pattern").select(*columns, F.col("whole").alias("times")), plan
    around = borders(rows.select("pattern", "size", "h", "g"), last, step, tail)
    marked = rows.join(F.broadcast(spark.createDataFrame(last, STATE)), "pattern", "left").join(F.broadcast(spark.createDataFrame(around, BORDERS)), "pattern", "left").withColumn("side", side())
    key = F.struct(F.col("h").alias("x"), F.col("g").alias("y"))
    edge = lambda name: F.struct(F.col(f"{name}_h").alias("x"), F.col(f"{name}_g").alias("y"))
    open_ = F.when(F.col("side") == 0, True).when(F.col("side") < 0, F.col("from_h").isNotNull() & (key >= edge("from"))).when(F.col("side") > 0, F.col("upto_h").isNotNull() & (key <= edge("upto")))
    marked = marked.withColumn("open", F.coalesce(open_, F.lit(False)))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "g"], kind="stable")
        return pdf.assign(extra=choose([int(x) for x in pdf["size"]], int(pdf["room"].iloc[0] + pdf["words"].iloc[0]), tail))[["doc_id", "file", "line", "pattern", "size", "extra"]]

    opened = marked.where("open").select("doc_id", F.col("row.file").alias("file"), F.col("row.row").alias("line"), "pattern", "size", "h", "g", "room", "words")
    opened = opened.groupBy("pattern").applyInPandas(pick, "doc_id long, file long, line long, pattern string, size long, extra boolean")
    opened = opened.select("doc_id", F.struct("file", F.col("line").alias("row")).alias("row"), "pattern", "size", "extra")
    rest = marked.where("not open").select(*columns, F.coalesce(F.col("side") < 0, F.lit(False)).alias("extra"))
    out = rest.unionByName(opened).join(F.broadcast(whole), "pattern")
    return out.select(*columns, (F.col("whole") + F.col("extra").cast("long")).alias("times")), plan


def repeating_weights(keys: list[str], cycle: tuple = (5, 2, 1)) -> list[float]:
    return [float(cycle[i % len(cycle)]) for i in range(len(keys))]


def mix_by_source(docs: DataFrame, seed: int = 29) -> DataFrame:
    """doc_id, size, source_size, target, taken, times: every document belongs to its own source alone."""
    out, plan = mix(docs, F.array(source_key()), repeating_weights, seed)
    known = [(pattern, plan["sizes"][members[0]], plan["targets"][members[0]]) for pattern, members, _ in plan["flows"]]
    table = docs.sparkSession.createDataFrame(known or [("", 0, 0.0)], "pattern string, source_size long, target double")
    return out.join(table, "pattern").select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")


def mixed(docs: DataFrame, seed: int = 29) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns. Texts are shuffled only if the rows not taken once are too many to broadcast."""
    at, copy, times = (fresh(docs, c) for c in ("_row", "_copy", "_times"))
    rows = addressed(docs, at)
    out, _ = mix(docs, F.array(source_key()), repeating_weights, seed, rows=rows, at=at)
    changed = stored(out.where("times <> 1").select(F.col("row").alias(at), F.col("times").cast("int").alias(times)), "mix-times")
    rows = rows.join(changed, at, "left").withColumn(times, F.coalesce(times, F.lit(1))).where(F.col(times) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[f"`{c}`" for c in docs.columns])

"""Nearest neighbours by inner product along shifted space-filling curves.

Vectors are made equal in length (one added component holds what a vector lacks to the longest), rotated at random, and
each of several Hilbert curves orders them by a few of the rotated components, each on a grid of its own shift.  A
query's candidates are the rows within a window of places around it on any curve; their inner products with it are
computed on the original vectors, and the best of all windows are merged.

A curve's order is a range partitioning cut into blocks of rows; a query goes to the blocks that its window meets, so
work is spread over (curve, block).  Blocks are as wide as half a window at least, and stream through their tasks: a
query has few partial results however wide its window is, and no task holds a block.  Equal vectors are one row with the
smallest of their ids, so copies neither crowd windows nor meet in one task.

How wide windows must be depends on the data: vectors without low-dimensional structure need wide ones.  So the width
is calibrated: a bounded sample of queries is compared with all rows, and the window is the one within which the wanted
share of their true neighbours lies on some curve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Curves, components that each orders by, bits of each component.
CURVES, COMPONENTS, BITS = 8, 8, 8
#: Rows of a block at least, and such blocks whose queries are asked together.
BLOCK, GROUP = 4096, 16
#: Queries that calibrate the window, and the share of their neighbours that it must hold.
SAMPLE, WANTED = 64, 0.985


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates below 2**bits, one row a point, by the transposed
    Gray code of Skilling (2004)."""
    x = grid.T.astype(np.uint64).copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        for i in range(len(x)):
            swap = (x[0] ^ x[i]) & (q - one)
            high = (x[i] & q) > 0
            x[0] ^= np.where(high, q - one, swap)
            x[i] ^= np.where(high, np.uint64(0), swap)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn ^= np.where((x[-1] & q) > 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def _keys(rotation: np.ndarray, shifts: np.ndarray, longest: float, spread: float, bits: int):
    """Each vector with its place on each curve: (curve, key, vector id)."""

    def run(batches):
        curves, components = shifts.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("vector"))
            v = np.hstack([v, np.sqrt(np.maximum(longest**2 - (v * v).sum(axis=1), 0))[:, None]]) @ rotation
            uid = batch.column("uid")
            for c in range(curves):
                own = v[:, [(c * components + k) % v.shape[1] for k in range(components)]] if c * components < v.shape[1] else v @ np.roll(np.eye(v.shape[1]), c, axis=0)[:, :components]
                unit = (np.clip(own / spread, -1, 1) + 1) / 2  # most lie within `spread` of 0
                key = hilbert(np.minimum((unit + shifts[c]) / 2 * (1 << bits), (1 << bits) - 1), bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array((key ^ (np.uint64(1) << np.uint64(63))).view(np.int64)), uid], ["curve", "key", "uid"])

    return run


def _encoded():
    """(vec_id, vector): the rows whose vectors take part, their components as doubles in one binary value."""

    def run(batches):
        for batch in batches:
            keep, out = [], []
            lists = batch.column("embedding")
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes a NaN
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(np.nan_to_num(sizes.astype(float)).astype(np.int64))])
            for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                v = values[a:b]
                if b > a and np.isfinite(v).all() and v.any():
                    keep.append(i)
                    out.append((v + 0.0).tobytes())  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["vec_id", "vector"])

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in one order whatever the batch."""
    return (q * x).sum(axis=1)


def _best(k: int):
    """Each query's k best rows of its window in one block.  Rows come sorted by (curve, block, group, kind), a group's
    queries before the block's rows; the rows stream past, so that a task holds a group's queries and their best only."""
    schema = pa.schema([("query", pa.int64()), ("uid", pa.int64()), ("least", pa.int64()), ("score", pa.float64())])

    def emit(asked, ids, least, scores):
        if not len(asked):
            return
        who, at = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(asked[who]), pa.array(ids[who, at]), pa.array(least[who, at]), pa.array(scores[who, at])], schema=schema)

    def merge(q, low, high, ids, least, scores, part):
        x, own, place, smallest = _matrix(part.column("vector")), *(part.column(c).to_numpy() for c in ("uid", "low", "least"))
        size = np.sqrt((x * x).sum(axis=1).max())
        n = min(k + 4, len(own))  # some to spare: the exact products below may differ in the last bit
        for a in range(0, len(q), 512):
            b = min(a + 512, len(q))
            s = q[a:b] @ x.T
            s[(place[None, :] < low[a:b, None]) | (place[None, :] > high[a:b, None])] = -np.inf
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            # where more rows than that tie at the cut, those of the smallest ids
            cut = np.take_along_axis(s, top, 1).min(axis=1)
            slack = 1e-12 * size * np.sqrt((q[a:b] * q[a:b]).sum(axis=1))
            for i in np.flatnonzero((cut > -np.inf) & ((s >= (cut - slack)[:, None]).sum(axis=1) > n)):
                tied = np.flatnonzero(s[i] >= cut[i] - slack[i])
                top[i] = tied[np.lexsort((own[tied], smallest[tied], -products(q[a + i][None, :], x[tied])))[:n]]
            near = products(np.repeat(q[a:b], n, axis=0), x[top.reshape(-1)]).reshape(b - a, n)
            near[np.take_along_axis(s, top, 1) == -np.inf] = -np.inf
            all_scores, all_ids = np.hstack([scores[a:b], near]), np.hstack([ids[a:b], own[top]])
            all_least = np.hstack([least[a:b], smallest[top]])
            order = np.lexsort((all_ids, all_least, -all_scores), axis=1)[:, :k]
            least[a:b] = np.take_along_axis(all_least, order, 1)
            scores[a:b], ids[a:b] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    def run(batches):
        at, parts, open_ = None, [], False
        asked = q = low = high = ids = least = scores = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("curve", "block", "group", "kind")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part, key, kind = batch.slice(a, b - a), tuple(keys[:3, a]), keys[3, a]
                if key != at:
                    if open_:
                        yield from emit(asked, ids, least, scores)
                    at, parts, open_ = key, [], False
                if kind == 0:
                    parts.append(part)
                elif parts or open_:
                    if not open_:
                        asked = np.concatenate([p.column("uid").to_numpy() for p in parts])
                        q = np.vstack([_matrix(p.column("vector")) for p in parts])
                        low, high = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("low", "high"))
                        ids, least, scores = np.zeros((len(q), k), np.int64), np.zeros((len(q), k), np.int64), np.full((len(q), k), -np.inf)
                        parts, open_ = [], True
                    merge(q, low, high, ids, least, scores, part)
        if open_:
            yield from emit(asked, ids, least, scores)

    return run


def _exact(queries: np.ndarray, names: np.ndarray, k: int):
    """A task's k best rows of each sampled query."""

    def run(batches):
        best: list[list[tuple[float, int]]] = [[] for _ in names]
        for batch in batches:
            x, ids = _matrix(batch.column("vector")), batch.column("uid").to_numpy()
            if not len(ids):
                continue
            s = queries @ x.T
            s[names[:, None] == ids[None, :]] = -np.inf
            n = min(k, len(ids))
            for i, top in enumerate(np.argpartition(-s, n - 1, axis=1)[:, :n]):
                best[i] = sorted([*best[i], *((-s[i, j], int(ids[j])) for j in top if s[i, j] > -np.inf)])[:k]
        rows = [(int(names[i]), u, -s) for i, b in enumerate(best) for s, u in b]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query", "uid", "score"])

    return run


def _top(found: DataFrame, k: int, *ties: str) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), *ties, "uid")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def nearest(vectors: DataFrame, is_query, k: int = 20, curves: int = CURVES, wanted: float = WANTED, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` (vec_id, embedding) for which the column `is_query` of
    vec_id holds, the k rows of other ids with the largest inner products, ties to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose number of
    components is not the most frequent one, nor null ids.  Equal rows are one.  Fewer than k candidates give all of them.
    Scores are double-precision products of the original vectors.  No rows give no rows; other columns are ignored.
    """
    own = written(vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding").mapInArrow(_encoded(), "vec_id long, vector binary"))
    length = own.groupBy(F.length("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return own.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    own = own.where(F.length("vector") == length[0]).withColumn("uid", F.xxhash64("vector"))
    # Equal vectors are one, with their k+1 smallest ids; copies are cut down before they meet.
    few = lambda keys: Window.partitionBy(*keys).orderBy("vec_id")
    ids = own.groupBy("uid", "vec_id").agg(F.first("vector").alias("vector")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    ids = written(ids)
    kept = ids.select("uid", "vec_id", "salt").withColumn("r", F.row_number().over(few(["uid", "salt"]))).where(F.col("r") <= k + 1)
    kept = kept.withColumn("r", F.row_number().over(few(["uid"]))).where(F.col("r") <= k + 1).select("uid", "vec_id")
    first = ids.groupBy("uid").agg(F.first("vector").alias("vector"), F.max(is_query(F.col("vec_id"))).alias("asked"), F.min("vec_id").alias("least"))
    rows = written(first)
    total, longest = rows.count(), None
    norm = rows.mapInArrow(_norms, "square double, peak double").agg(F.max("square"), F.max("peak")).first()
    longest, dim = float(np.sqrt(norm[0])), length[0] // 8 + 1
    r = np.random.default_rng(11)
    rotation = np.linalg.qr(r.normal(size=(dim, dim)))[0]
    shifts = r.random((curves, min(COMPONENTS, dim)))
    keyed = rows.select("uid", "vector").mapInArrow(_keys(rotation, shifts, longest, 3.0 * longest / np.sqrt(dim), BITS), "curve int, key long, uid long")
    placed = written(_places(keyed))
    window = _window(rows, placed, k, total, wanted)
    block = max(block, window)  # a window meets three blocks at most, however wide it is
    span = BLOCK * GROUP  # queries go by their own places, so that no task holds more of them than a span has rows
    low, high = F.greatest(F.col("place") - window, F.lit(0)), F.least(F.col("place") + window, F.lit(total - 1))
    start = F.col("block") * block
    groups = F.sequence(F.floor(F.greatest(start - window, F.lit(0)) / span), F.floor(F.least(start + (block - 1 + window), F.lit(total - 1)) / span))
    asked = placed.join(rows.where("asked"), "uid").select("curve", F.explode(F.sequence(F.floor(low / block), F.floor(high / block))).alias("block"), F.floor(F.col("place") / span).alias("group"), F.lit(0).alias("kind"), low.alias("low"), high.alias("high"), "uid", "least", "vector")
    blocks = placed.withColumn("block", F.floor(F.col("place") / block)).join(rows, "uid").select("curve", "block", F.explode(groups).alias("group"), F.lit(1).alias("kind"), F.col("place").alias("low"), F.col("place").alias("high"), "uid", "least", "vector")
    met = asked.unionByName(blocks).repartition("curve", "block", "group").sortWithinPartitions("curve", "block", "group", "kind")
    found = met.mapInArrow(_best(k + 1), "query long, uid long, least long, score double")
    best = written(_top(found.distinct(), k + 1, "least"))
    # Back to ids: each query takes the ids of its vector's best rows but its own.
    offered = best.join(kept, "uid").select("query", "vec_id", "score")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    offered = offered.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("offers"))
    queries = ids.where(is_query(F.col("vec_id"))).select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"))
    out = queries.join(offered, "query").select("query_id", F.slice(F.filter("offers", lambda o: o["vec_id"] != F.col("query_id")), 1, k).alias("offers"))
    return out.select("query_id", F.posexplode("offers").alias("rank", "o")).select("query_id", (F.col("rank") + 1).alias("rank"), "o.vec_id", "o.score")


def _norms(batches):
    for batch in batches:
        if batch.num_rows:
            v = _matrix(batch.column("vector"))
            yield pa.RecordBatch.from_arrays([pa.array([float((v * v).sum(axis=1).max())]), pa.array([float(np.abs(v).max())])], ["square", "peak"])


def _places(keyed: DataFrame) -> DataFrame:
    """(curve, uid, place): each row's place along its curve, from 0, by prefix sums over range partitions."""
    dealt = written(keyed)
    dealt = dealt.repartitionByRange("curve", "key", "uid").sortWithinPartitions("curve", "key", "uid")
    dealt = written(dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "curve", "uid"))
    counts = dealt.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = counts.select("curve", "part", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("curve", "part").orderBy("at")) - 1
    return dealt.withColumn("inside", inside).join(before, ["curve", "part"]).select("curve", "uid", (F.col("before") + F.col("inside")).alias("place"))


def _window(rows: DataFrame, placed: DataFrame, k: int, total: int, wanted: float) -> int:
    """Half a window's rows: the sampled queries' true neighbours lie within it, on some curve, to the wanted share."""
    sample = rows.where("asked").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).collect()
    if not sample:
        return 0
    names, queries = np.array([r["uid"] for r in sample], np.int64), np.stack([np.frombuffer(r["vector"], np.float64) for r in sample])
    true = _top(rows.select("uid", "vector").mapInArrow(_exact(queries, names, k), "query long, uid long, score double"), k)
    mine = placed.where(F.col("uid").isin([int(x) for x in names])).select("curve", F.col("uid").alias("query"), F.col("place").alias("from"))
    gaps = true.join(placed, "uid").join(F.broadcast(mine), ["curve", "query"]).groupBy("query", "uid").agg(F.min(F.abs(F.col("place") - F.col("from"))).alias("gap"))
    found = gaps.agg(F.percentile("gap", wanted)).first()[0]  # of at most SAMPLE * k numbers
    return min(total, int(np.ceil(found or 0)) + 1)

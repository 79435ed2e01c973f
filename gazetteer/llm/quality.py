"""Quality selection by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled good) and one of raw text (all
documents), give each document a log importance weight: the sum over its n-grams of the log-ratio of their
probabilities.  Gumbel noise is added to the weights and the top k are kept, which samples k documents without
replacement in proportion to their weights.  k is the number of documents whose weight passes a cut calibrated on the
labelled ones.

The n-grams are of word shapes (which kinds of bytes a word begins and ends with, its length, whether it repeats one of
the two words before it) in runs of one, two and three, and of single words; all are hashed into one table of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import unused, written

#: Buckets of the n-gram table.
BUCKETS = 1 << 15
#: At most so many labelled rows are used to fit the target model (those with the smallest hashes of their ids).
SAMPLE = 40_000
#: Share of labelled documents that calibration may leave on the wrong side of a class's edge.
TAIL = 0.001

_KIND = np.zeros(256, np.uint8)
_KIND[33:128] = np.arange(33, 128)  # punctuation stands for itself
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4
_LENGTH = np.minimum(np.array([0, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4, *[5] * 5, *[6] * 10, 7]), 7).astype(np.uint64)


def gram_buckets(raws: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts in order, and where each text's begin (one entry more than texts)."""
    buf, starts, ends, hashes, bounds = tb.words(raws)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(raws) + 1, np.int64)
    kind = _KIND[buf].astype(np.uint64)
    size = ends - starts
    inner = np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts)
    shape = kind[starts] | kind[inner[0]] << np.uint64(8) | kind[inner[1]] << np.uint64(16) | kind[ends - 1] << np.uint64(24) | _LENGTH[np.minimum(size, len(_LENGTH) - 1)] << np.uint64(32)
    at = np.arange(len(starts)) - np.repeat(bounds[:-1], np.diff(bounds))  # place in its text
    again = np.zeros(len(starts), np.uint64)
    for back in (1, 2):
        same = np.zeros(len(starts), bool)
        same[back:] = hashes[back:] == hashes[:-back]
        again |= (same & (at >= back)).astype(np.uint64) << np.uint64(40 + back)
    shape = tb.mix(shape | again)
    with np.errstate(over="ignore"):
        grams, rolled = [shape, tb.mix(hashes + np.uint64(7))], shape
        for back in (1, 2):
            before = np.zeros(len(shape), np.uint64)
            before[back:] = shape[:-back]
            before[at < back] = np.uint64(back)  # the text's begin
            rolled = tb.mix(rolled * np.uint64(31) + before)
            grams.append(rolled)
    every = np.stack(grams, axis=1).reshape(-1)
    return (every % np.uint64(buckets)).astype(np.int64), bounds * len(grams)


def _counter(buckets: int, wanted: frozenset):
    """Raw counts of all documents and target counts of the wanted ones; one row for each bucket that a task has met."""

    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in tb.slices(batches):
            ids = batch.column("doc_id").to_pylist()
            mine = np.fromiter((i in wanted for i in ids), bool, len(ids))
            for a, b, raws in tb.batches(batch.column("text").to_pylist(), lower=False):
                grams, bounds = gram_buckets(raws, buckets)
                raw += np.bincount(grams, minlength=buckets)
                target += np.bincount(grams[np.repeat(mine[a:b], np.diff(bounds))], minlength=buckets)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(raw[met]), pa.array(target[met])], ["bucket", "raw", "target"])

    return run


@dataclass
class Weights:
    """Log-ratio of target and raw probability by bucket."""

    ratio: np.ndarray
    seed: int = 17

    def __call__(self, raws: list[bytes]) -> np.ndarray:
        grams, bounds = gram_buckets(raws, len(self.ratio))
        sums = np.concatenate([[0.0], np.cumsum(self.ratio[grams])])
        return sums[bounds[1:]] - sums[bounds[:-1]]


def fit_weights(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> Weights:
    """The two models: raw from all of `docs`, target from the documents labelled quality 1 (at most `sample`).  Without
    such labels the ratio is 0 everywhere."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    wanted = frozenset(r[0] for r in good.collect())
    counts = docs.select("doc_id", "text").mapInArrow(_counter(buckets, wanted), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in counts.collect():  # one row a bucket: a fixed number
        raw[b], target[b] = r, t
    if not target.sum():
        return Weights(np.zeros(buckets))
    smooth = 0.5
    p, q = (target + smooth) / (target.sum() + smooth * buckets), (raw + smooth) / (raw.sum() + smooth * buckets)
    return Weights(np.log(p) - np.log(q))


def _with_keys(weights: Weights, names: list[str]):
    """Adds the log-weight and the key, which is the weight and noise (standard Gumbel, from a hash of seed, id and text);
    null for texts without words."""

    def run(batches):
        for batch in tb.slices(batches):
            if not batch.num_rows:
                continue
            out, noise = np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows)
            ids = batch.column("doc_id").to_pylist()
            for a, b, raws in tb.batches(batch.column("text").to_pylist(), lower=False):
                got = weights(raws)
                keys = np.array([hash_of(weights.seed, ids[a + i], r) for i, r in enumerate(raws)], np.uint64)
                noise[a:b] = -np.log(-np.log((keys >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54))
                empty = np.array([not r.strip() for r in raws])
                out[a:b] = np.where(empty, np.nan, got)
            null = np.isnan(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64(), mask=null), pa.array(np.where(null, 0, out + noise), pa.float64(), mask=null)], [*batch.schema.names, *names])

    return run


def hash_of(seed: int, doc_id, raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw, seed) ^ xxhash.xxh64_intdigest(str(doc_id).encode(), seed + 1)


def with_keys(docs: DataFrame, weights: Weights, names: tuple[str, str] = ("_log_weight", "_key")) -> DataFrame:
    schema = docs.withColumns(dict.fromkeys(names, F.lit(0.0))).schema
    for field in schema.fields:
        field.nullable = True
    return docs.mapInArrow(_with_keys(weights, list(names)), schema)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column `_key` (doubles): a search by halves over counts, 2**8 cuts a pass, so the driver
    sees a few hundred numbers a pass however many rows there are.  Rows equal to it all count as kept."""
    low, high, n = keys.agg(F.min("_key"), F.max("_key"), F.count("_key")).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    parts = 256
    while True:
        width = (high - low) / parts
        if width <= 0 or low + width == low:
            return high
        slot = F.least(F.floor((F.col("_key") - F.lit(low)) / F.lit(width)), F.lit(parts - 1))
        found = {r[0]: r[1:] for r in keys.where(F.col("_key").between(low, high)).groupBy(slot.alias("s")).agg(F.count("*"), F.min("_key"), F.max("_key")).collect()}
        above = keys.where(F.col("_key") > high).count()
        for s in sorted(found, reverse=True):
            n, least, most = found[s]
            if above + n >= k:
                break
            above += n
        if least == most or above + n == k:
            return least
        low, high = least, most


def calibrated_cut(scored: DataFrame, labels: DataFrame, tail: float = TAIL) -> float:
    """A weight below all but a share `tail` of the labelled good documents and, if the classes part there, above all but
    that share of the bad ones (a quarter of the way down the gap); never above 0, where the target model finds the text
    as likely as the raw one does."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = lambda q, share: F.percentile_approx(F.when(F.col("quality") == q, F.col("_log_weight")), share, 10_000)
    good, bad = scored.join(marks, "doc_id").agg(weight(1, tail), weight(0, 1 - tail)).first()
    if good is None:
        return float("-inf")
    return min(0.0, good if bad is None or bad >= good else good + (bad - good) / 4)


@dataclass
class Selection:
    weights: Weights
    threshold: float


def fit_selection(docs: DataFrame, labels: DataFrame, k: int | None = None) -> tuple[Selection, DataFrame]:
    """The fitted weights with the key that the k-th document has, and the table (doc_id, _log_weight, _key) of all."""
    weights = fit_weights(docs, labels)
    scored = written(with_keys(docs.select("doc_id", "text"), weights).select("doc_id", "_log_weight", "_key"))
    if k is None:
        k = scored.where(F.col("_log_weight") >= calibrated_cut(scored, labels)).count()
    return Selection(weights, kth_largest(scored, k)), scored


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected for each row of `docs` (doc_id, text).

    Null and empty texts, and texts of white space, have no weight and are not selected.  Repeated rows have equal keys
    and are selected together, as are ties at the k-th place.  Without good labels all weights are 0 and every text with
    words is selected (or k of them, by noise alone).  No rows give no rows; other columns are ignored.
    """
    chosen, scored = fit_selection(docs, labels, k)
    return scored.select("doc_id", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("gumbel_key"), F.coalesce(F.col("_key") >= chosen.threshold, F.lit(False)).alias("selected"))


def selected_documents(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The selected rows of `docs`, all columns, whatever they are called.

    Null and empty texts, and texts of white space, go.  Equal rows stay or go together, as do ties at the k-th place; a
    null id is no labelled one.  Without good labels every text with words stays (or k of them, by noise alone).  No rows
    give no rows.
    """
    chosen, _ = fit_selection(docs, labels, k)
    weight, key = unused(docs, "_log_weight", "_key")
    return with_keys(docs, chosen.weights, (weight, key)).where(F.col(key) >= chosen.threshold).drop(weight, key)

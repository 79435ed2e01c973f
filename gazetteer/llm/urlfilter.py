"""URL filtering by rules and by a ratio of character language models.

Two variable-order Markov models of bytes, one of accepted and one of rejected URLs, are smoothed by Witten-Bell
interpolation: a context of up to `ORDER` bytes is trusted as far as it was seen, the rest goes to the next shorter one.
A URL's score is the difference of the two log-likelihoods a byte; the threshold is calibrated on labelled URLs that the
models have not seen.  Rules come first: the longest that fits decides; the models decide the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest context in bytes.  A context and the byte after it are one 64-bit code, so at most 7.
ORDER = 5
#: At most so many labelled URLs of each class are used to fit (those with the smallest hashes, whatever the table's size).
SAMPLE = 20_000
#: Rules up to this number become one expression; more are joined by host suffix.
INLINE_RULES = 64


@dataclass(frozen=True)
class Rule:
    """`pattern` is host/path; it fits the host, its subdomains, and paths that start with the rule's path."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    host = F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def with_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """`pages` (with columns host and path) and the longest fitting `rule` and its `rule_verdict`, or nulls."""
    if len(rules) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):  # the longest is asked first
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            rule, verdict = F.when(fits, F.lit(r.pattern)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
        return pages.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = pages.sparkSession
    known = spark.createDataFrame([(r.host, r.path, r.pattern, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # host suffixes are few; a page's hits are reduced before they leave the task
    hits = pages.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(known, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.rule_verdict")}).drop("best")


def _codes(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All URLs between start and end marks as one buffer, and where each begins (one entry more than URLs)."""
    pad = b"\x02" * ORDER
    buf = np.frombuffer(b"".join(pad + u + b"\x03" for u in urls), np.uint8)
    at = np.zeros(len(urls) + 1, np.int64)
    at[1:] = np.cumsum([len(u) + ORDER + 1 for u in urls])
    return buf, at


def _grams(buf: np.ndarray, order: int) -> np.ndarray:
    """At each place the code of the byte there and the `order` bytes before it."""
    code = np.zeros(len(buf), np.int64)
    for k in range(order, -1, -1):
        code <<= 8
        code[k:] |= buf[: len(buf) - k]
    return code


class MarkovModel:
    """Counts of contexts and following bytes for each order; probabilities interpolate from the longest to none."""

    def __init__(self, urls: list[bytes]):
        buf, at = _codes(urls)
        real = np.ones(len(buf), bool)
        for k in range(ORDER):
            real[at[:-1] + k] = False
        self.tables = []
        for order in range(ORDER + 1):
            grams, n = np.unique(_grams(buf, order)[real], return_counts=True)
            contexts, first = np.unique(grams >> 8, return_index=True)
            total = np.add.reduceat(n, first) if len(n) else n
            kinds = np.diff(np.append(first, len(grams)))
            self.tables.append((grams, n.astype(np.float64), contexts, total.astype(np.float64), kinds.astype(np.float64)))

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, values[i], 0.0)

    def log_likelihood(self, urls: list[bytes]) -> np.ndarray:
        """Natural log-likelihood of each URL with its end mark."""
        buf, at = _codes(urls)
        p = np.full(len(buf), 1 / 256)
        for order, (grams, n, contexts, total, kinds) in enumerate(self.tables):
            code = _grams(buf, order)
            all_, seen = self._find(contexts, total, code >> 8), self._find(contexts, kinds, code >> 8)
            p = np.where(all_ > 0, (self._find(grams, n, code) + seen * p) / np.maximum(all_ + seen, 1), p)
        lp = np.log(p)
        for k in range(ORDER):
            lp[at[:-1] + k] = 0
        return np.add.reduceat(lp, at[:-1]) if len(urls) else np.zeros(0)


@dataclass
class RatioFilter:
    accepted: MarkovModel
    rejected: MarkovModel
    threshold: float

    def score(self, urls: list[bytes]) -> np.ndarray:
        return (self.accepted.log_likelihood(urls) - self.rejected.log_likelihood(urls)) / (np.array([len(u) for u in urls]) + 1)


def fit_ratio(accepted: list[bytes], rejected: list[bytes]) -> RatioFilter:
    """Models from four fifths of the labelled URLs; the threshold is the score that splits the last fifth with the best
    balanced accuracy, the lowest of equals, so that a URL unlike both classes is allowed.  A class without URLs leaves the prior alone, and all URLs are allowed."""
    accepted, rejected = sorted(accepted), sorted(rejected)
    part = lambda urls, held: [u for i, u in enumerate(urls) if (i % 5 == 4) == held]
    found = RatioFilter(MarkovModel(part(accepted, False)), MarkovModel(part(rejected, False)), -np.inf)
    good, bad = part(accepted, True), part(rejected, True)
    if good and bad:
        g, b = np.sort(found.score(good)), np.sort(found.score(bad))
        cuts = np.unique(np.concatenate([g, b]))
        right = (1 - np.searchsorted(g, cuts) / len(g)) + np.searchsorted(b, cuts) / len(b)
        best = np.flatnonzero(right == right.max())
        found.threshold = float(cuts[best[0]])
    return found


def _key(url: str | None) -> bytes:
    return (url or "").encode("utf-8", "surrogatepass").lower()


def _scorer(model: RatioFilter):
    def run(batches):
        for batch in batches:
            urls = [_key(u) for u in batch.column("url").to_pylist()]
            if urls:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(urls), pa.float64())], [*batch.schema.names, "score"])

    return run


def judge_urls(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score for each row of `pages` (page_id, url).

    URLs that a rule judges are the labelled ones from which the models learn (distinct URLs, at most `sample` a class).
    A null URL is allowed unless a rule says otherwise: there is nothing to judge.  Repeated rows are judged alike; rows
    and other columns never influence each other.  No rows give no rows.
    """
    host, path = host_path(F.col("url"))
    judged = with_rules(pages.select("page_id", "url", host.alias("host"), path.alias("path")), rules)
    labelled = judged.where(F.col("rule").isNotNull() & F.col("url").isNotNull()).select("url", "rule_verdict").distinct()
    fit = {v: [_key(r[0]) for r in labelled.where(F.col("rule_verdict") == v).orderBy(F.xxhash64("url"), "url").limit(sample).select("url").collect()] for v in ("allow", "block")}
    model = fit_ratio(fit["allow"], fit["block"])
    columns = ["page_id", "url", "host", "path", "rule", "rule_verdict"]
    scored = judged.select(*columns).mapInArrow(_scorer(model), judged.select(*columns).withColumn("score", F.lit(0.0)).schema)
    own = F.when(F.col("url").isNull() | (F.col("score") >= F.lit(model.threshold)), F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")

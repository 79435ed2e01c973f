"""Ranked text search over posting tables.

Each field is indexed in three forms: folded (with positions), lower and strict.  A posting is (field, form, term, doc,
tf, positions, length); document frequencies and field statistics are tables beside it, and so are the folded terms' keys
for fuzzy search.  Queries are a table too, so any number of them is one plan of joins on terms.

Scores are BM25 with k1 = 1.2 and b = 0.75, weighted by field and clause; a fuzzy hit adds its clause's weight alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..scratch import written

FORMS = {"folded": tx.tokens_folded, "lower": tx.tokens_lower, "strict": tx.tokens_strict}
FIELDS = ("name", "hier")
K1, B = 1.2, 0.75
#: Hits of a query before later filters.
TOP = 50


@dataclass(frozen=True)
class Boosts:
    """Weights of the clauses, by field."""

    exact: dict[str, float] = field(default_factory=lambda: {"name": 5.0, "hier": 2.0})
    phrase: dict[str, float] = field(default_factory=lambda: {"name": 10.0, "hier": 4.0})
    strict: dict[str, float] = field(default_factory=lambda: {"name": 3.0, "hier": 1.2})
    lower: dict[str, float] = field(default_factory=lambda: {"name": 2.0, "hier": 0.8})
    fuzzy: dict[str, float] = field(default_factory=lambda: {"name": 1.5, "hier": 0.5})


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, length: Column, average: Column) -> Column:
    return (K1 + 1) * tf / (tf + K1 * (1 - B + B * length / average))


def deletions(term: Column, most: Column) -> Column:
    """The term and what is left of it without one or, where `most` is two, two of its letters.  Two words within so many
    edits, neighbouring swaps counted as one, have one of these in common."""
    drop = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    one = F.when(F.length(term) > 0, drop(term)).otherwise(F.array().cast("array<string>"))
    two = F.flatten(F.transform(one, lambda t: F.when(F.length(t) > 0, drop(t)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(term), one, F.when(most >= 2, two).otherwise(F.array().cast("array<string>"))))


@dataclass
class TextIndex:
    postings: DataFrame  # field, form, term, doc, tf, positions, length
    terms: DataFrame  # field, form, term, df
    fields: DataFrame  # field, form, n, average
    keys: DataFrame  # key, term: of the folded terms

    TABLES = ("postings", "terms", "fields", "keys")

    @classmethod
    def build(cls, documents: DataFrame, abbreviations: list[tuple[str, str]] | None = None, stored: bool = True) -> TextIndex:
        """`documents`: id, name, hier.  Abbreviations are put into the folded form only.  The postings are written once
        unless `stored` is off, which is for a caller that saves them."""
        forms = []
        for f in FIELDS:
            for form, split in FORMS.items():
                source = tx.expand_abbreviations(F.col(f), abbreviations) if abbreviations and form == "folded" else F.col(f)
                forms.append(F.struct(F.lit(f).alias("field"), F.lit(form).alias("form"), split(F.coalesce(source, F.lit(""))).alias("tokens")))
        docs = documents.select(F.col("id").alias("doc"), F.explode(F.array(*forms)).alias("f")).select("doc", "f.*")
        # A form without tokens still counts as a document: it has one row without a term.
        each = docs.select("field", "form", "doc", F.size("tokens").cast("long").alias("length"), F.posexplode_outer("tokens").alias("pos", "term"))
        spread = each.groupBy("field", "form", "term", "doc").agg(F.count("pos").alias("tf"), F.first("length").alias("length"), F.array_sort(F.collect_list("pos")).alias("positions"))
        if not stored:
            return cls.over(spread)
        index = cls.over(written(spread))
        return cls(index.postings, written(index.terms), written(index.fields), index.keys)

    @classmethod
    def over(cls, postings: DataFrame) -> TextIndex:
        """The index over a table of postings."""
        # each document of a field is counted where its first term stands, or where it has none
        first = F.col("term").isNull() | F.array_contains("positions", 0)
        fields = postings.where(first).groupBy("field", "form").agg(F.count("*").alias("n"), F.avg("length").alias("average"))
        real = postings.where(F.col("term").isNotNull())
        terms = real.groupBy("field", "form", "term").agg(F.count("*").alias("df"))
        words = real.where("form = 'folded'").select("term").distinct()
        keys = words.select(F.explode(deletions(F.col("term"), F.lit(2))).alias("key"), "term")
        return cls(real, terms, fields, keys)

    def save(self, path: str) -> None:
        """Postings sorted by term within files, so that a search's terms skip most row groups."""
        for name in self.TABLES:
            table = getattr(self, name)
            by = {"postings": ["form", "term"], "terms": ["form", "term"], "keys": ["key"]}.get(name)
            (table.repartitionByRange(*by).sortWithinPartitions(*by) if by else table).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in cls.TABLES])

    def weighted(self, asked: DataFrame, of: DataFrame | None = None) -> DataFrame:
        """Postings of the asked terms (field, form, term and more) with idf and tf_norm; only those in the documents `of`
        each query (query_id, doc), if given."""
        known = asked.join(self.terms, ["field", "form", "term"]).join(F.broadcast(self.fields), ["field", "form"])  # six rows
        hit = known.join(self.postings, ["field", "form", "term"]) if of is None else known.join(of, "query_id").join(self.postings, ["field", "form", "term", "doc"])
        return hit.withColumns({"idf": idf(F.col("n"), F.col("df")), "tfn": tf_norm(F.col("tf"), F.col("length"), F.col("average"))})


def asked_terms(queries: DataFrame, *clauses: tuple[str, dict[str, float]]) -> DataFrame:
    """(query_id, qpos, field, form, term, boost, tokens): each query token in each field, for clauses (form, weights)."""
    parts = []
    for form, weights in clauses:
        per = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("boost")) for f, w in weights.items()]))
        toks = FORMS[form](F.col("text"))
        q = queries.select("query_id", F.size(toks).alias("tokens"), F.posexplode(toks).alias("qpos", "term"))
        parts.append(q.withColumn("_f", per).select("query_id", "qpos", "_f.field", F.lit(form).alias("form"), "term", "_f.boost", "tokens"))
    return reduce(DataFrame.unionByName, parts)


def term_scores(index: TextIndex, queries: DataFrame, boosts: Boosts = Boosts()) -> DataFrame:
    """(query_id, doc, field, qpos, score): what each folded query token adds by itself."""
    hit = index.weighted(asked_terms(queries, ("folded", boosts.exact)))
    return hit.select("query_id", "doc", "field", "qpos", (F.col("boost") * F.col("idf") * F.col("tfn")).alias("score"))


def rarest_docs(index: TextIndex, queries: DataFrame, boosts: Boosts = Boosts()) -> DataFrame:
    """(query_id, doc): documents that hold the token of the query that fewest hold.  Those that hold every token are among
    them; a query with a token that none holds has none."""
    asked = asked_terms(queries, ("folded", boosts.exact))
    held = asked.join(index.terms, ["field", "form", "term"], "left").groupBy("query_id", "qpos", "term").agg(F.sum(F.coalesce("df", F.lit(0))).alias("held"))
    rarest = held.groupBy("query_id").agg(F.min(F.struct("held", "qpos", "term")).alias("r")).where("r.held > 0").select("query_id", F.col("r.term").alias("term"))
    folded = index.postings.where((F.col("form") == "folded") & F.col("field").isin(*boosts.exact)).select("term", "doc")
    return rarest.join(folded, "term").select("query_id", "doc").distinct()


def clause_scores(index: TextIndex, queries: DataFrame, boosts: Boosts = Boosts(), of: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, exact, phrase, letters, found, tokens): the sums of each clause for documents that hold any token,
    with how many of the query's tokens are found; only for the documents `of` each query, if given.  One join with the
    postings serves all clauses; a document's hits of a query (at most six a token) are put together once."""
    hit = index.weighted(asked_terms(queries, ("folded", boosts.exact), ("strict", boosts.strict), ("lower", boosts.lower)), of)
    one = F.struct("field", "form", "qpos", "idf", (F.col("boost") * F.col("idf") * F.col("tfn")).alias("score"), F.when(F.col("form") == "folded", F.col("positions")).alias("positions"), "length", "average", "tokens")
    g = hit.groupBy("query_id", "doc").agg(F.collect_list(one).alias("hits"))
    folded = F.filter("hits", lambda h: h["form"] == "folded")
    total = lambda hits: F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["score"])
    g = g.select("query_id", "doc", folded.alias("folded"), total(F.filter("hits", lambda h: h["form"] != "folded")).alias("letters"))

    def phrase(f: str) -> Column:
        """Places where every token's positions, less its place in the query, agree."""
        own = F.filter("folded", lambda h: h["field"] == f)
        starts = F.transform(own, lambda h: F.transform(h["positions"], lambda p: p - h["qpos"]))
        tf = F.size(F.aggregate(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), starts[0], lambda a, s: F.array_intersect(a, s)))
        weight = F.aggregate(own, F.lit(0.0), lambda a, h: a + h["idf"])
        score = F.lit(boosts.phrase[f]) * weight * tf_norm(tf, own[0]["length"], own[0]["average"])
        return F.when((F.size(own) >= 2) & (F.size(own) == own[0]["tokens"]) & (tf > 0), score).otherwise(F.lit(0.0))

    found = F.size(F.array_distinct(F.transform("folded", lambda h: h["qpos"])))
    return g.where(F.size("folded") > 0).select("query_id", "doc", total(F.col("folded")).alias("exact"), (phrase("name") + phrase("hier")).alias("phrase"), "letters", found.alias("found"), F.col("folded")[0]["tokens"].alias("tokens"))


def strict_scores(index: TextIndex, queries: DataFrame, boosts: Boosts = Boosts()) -> DataFrame:
    """(query_id, doc, score): documents that hold every token in one field or another, with phrase, letter-case and
    accent bonuses.  Only documents with the query's rarest token are looked at."""
    whole = clause_scores(index, queries, boosts, rarest_docs(index, queries, boosts)).where(F.col("found") == F.col("tokens"))
    return whole.select("query_id", "doc", (F.col("exact") + F.col("phrase") + F.col("letters")).alias("score"))


def osa_distance(a: str, b: str, most: int) -> int:
    """Edits between two words with neighbouring swaps as one edit; more than `most` is not told apart."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def osa_distances(a: pd.Series, b: pd.Series, most: int) -> np.ndarray:
    """`osa_distance` of all pairs: those of the same two lengths go through the table together."""
    out = np.full(len(a), most + 1, np.int32)
    n, m = a.str.len().to_numpy(), b.str.len().to_numpy()
    letters = lambda words, width: np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), width)
    for la, lb in set(zip(n.tolist(), m.tolist())):
        if abs(la - lb) > most:
            continue
        at = np.flatnonzero((n == la) & (m == lb))
        x, y = letters(a.iloc[at], la), letters(b.iloc[at], lb)
        two, one = None, [np.full(len(at), j, np.int32) for j in range(lb + 1)]
        for i in range(1, la + 1):
            row = [np.full(len(at), i, np.int32)]
            for j in range(1, lb + 1):
                d = np.minimum(np.minimum(one[j], row[-1]) + 1, one[j - 1] + (x[:, i - 1] != y[:, j - 1]))
                if i > 1 and j > 1:
                    swapped = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                    d = np.where(swapped, np.minimum(d, two[j - 2] + 1), d)
                row.append(d)
            two, one = one, row
        out[at] = one[-1]
    return out


@F.pandas_udf(T.IntegerType())
def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(osa_distances(a, b, 2))


def near_words(index: TextIndex, words: DataFrame) -> DataFrame:
    """(wanted, term): indexed folded terms within the distance of each of `words` (wanted).  Words meet on what is left of
    them without a letter or two, so only near ones meet; the few that do are verified."""
    reach = words.select("wanted", F.explode(deletions(F.col("wanted"), tx.fuzzy_distance(F.col("wanted")))).alias("key"))
    close = reach.join(index.keys, "key").select("wanted", "term").distinct()
    return close.where(F.abs(F.length("wanted") - F.length("term")) <= 2).where(_osa("wanted", "term") <= tx.fuzzy_distance(F.col("wanted")))


def word_scores(index: TextIndex, words: DataFrame, boosts: Boosts) -> DataFrame:
    """(wanted, doc, score): what each of `words` (wanted) adds to documents, exact by BM25 and within its distance by the
    clause's weight, once a field."""
    folded = lambda weights: F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit("folded").alias("form"), F.lit(w).alias("boost")) for f, w in weights.items()]))
    hit = index.weighted(words.select(F.col("wanted").alias("term"), folded(boosts.exact).alias("f")).select("term", "f.*"))
    exact = hit.select(F.col("term").alias("wanted"), "doc", (F.col("boost") * F.col("idf") * F.col("tfn")).alias("score"))
    near = near_words(index, words).select("wanted", "term", folded(boosts.fuzzy).alias("f")).select("wanted", "term", "f.*")
    near = near.join(index.postings.select("field", "form", "term", "doc"), ["field", "form", "term"]).select("wanted", "doc", "field", F.col("boost").alias("score")).distinct()
    return exact.unionByName(near.drop("field")).groupBy("wanted", "doc").agg(F.sum("score").alias("score"))


def loose_scores(index: TextIndex, queries: DataFrame, boosts: Boosts = Boosts()) -> DataFrame:
    """(query_id, doc, score): any token, exact by BM25 or within its distance by the clause's weight (once a token and
    field).  A word's documents are found once for all queries that ask for it."""
    tokens = queries.select("query_id", F.explode(tx.tokens_folded(F.col("text"))).alias("wanted"))
    by_word = word_scores(index, tokens.select("wanted").distinct(), boosts)
    return tokens.join(by_word, "wanted").groupBy("query_id", "doc").agg(F.sum("score").alias("score"))


def loose_parts(index: TextIndex, near: DataFrame, boosts: Boosts) -> DataFrame:
    """(wanted, exact, n, most): each word's documents in two parts, those that hold it and those that hold only words near
    it, with at least as many as they are and at least what the word adds to one of them.  `near` is (wanted, term)."""
    weight = lambda weights: reduce(lambda c, f: c.when(F.col("field") == f, F.lit(max(weights[f], 0.0))), weights, F.when(F.lit(False), 0.0)).otherwise(F.lit(0.0))
    held = near.join(index.terms.where(F.col("form") == "folded"), "term").join(F.broadcast(index.fields), ["field", "form"])  # six rows
    same = F.col("term") == F.col("wanted")
    by_field = held.groupBy("wanted", "field").agg(
        F.sum(F.when(same, F.col("df")).otherwise(0)).alias("own"), F.sum(F.when(same, F.lit(0)).otherwise(F.col("df"))).alias("others"),
        F.max(F.when(same, weight(boosts.exact) * idf(F.col("n"), F.col("df")) * (K1 + 1)).otherwise(0.0)).alias("gain"), F.max(weight(boosts.fuzzy)).alias("fuzzy"),
    )
    g = by_field.groupBy("wanted").agg(*[F.sum(c).alias(c) for c in ("own", "others", "gain", "fuzzy")])
    part = lambda exact, n, most: F.struct(F.lit(exact).alias("exact"), n.alias("n"), most.alias("most"))
    return g.select("wanted", F.explode(F.array(part(True, F.col("own"), F.col("gain") + F.col("fuzzy")), part(False, F.col("others"), F.col("fuzzy")))).alias("p")).select("wanted", "p.*").where("n > 0")


def scores_of(index: TextIndex, asked: DataFrame, near: DataFrame, pairs: DataFrame, boosts: Boosts) -> DataFrame:
    """(query_id, doc, score): as `loose_scores`, for `pairs` (query_id, doc) alone.  `asked` is (query_id, wanted, times),
    `near` (wanted, term)."""
    weight = lambda weights: reduce(lambda c, f: c.when(F.col("field") == f, F.lit(weights[f])), weights, F.when(F.lit(False), 0.0))
    known = near.select("term").distinct().join(index.terms.where(F.col("form") == "folded"), "term").join(F.broadcast(index.fields), ["field", "form"])  # six rows
    held = index.postings.select("field", "form", "term", "doc", "tf", "length").join(known, ["field", "form", "term"])
    held = held.select("doc", "field", "term", (weight(boosts.exact) * idf(F.col("n"), F.col("df")) * tf_norm(F.col("tf"), F.col("length"), F.col("average"))).alias("bm25"), weight(boosts.fuzzy).alias("fuzzy"))
    hit = pairs.join(held, "doc").join(asked.join(near, "wanted"), ["query_id", "term"])
    own = F.when(F.col("term") == F.col("wanted"), F.col("bm25"))
    g = hit.groupBy("query_id", "doc", "wanted", "field").agg(F.max("times").alias("times"), F.max(own).alias("own"), F.max("fuzzy").alias("fuzzy"))
    g = g.where(F.col("own").isNotNull() | F.col("fuzzy").isNotNull())
    return g.groupBy("query_id", "doc").agg(F.sum(F.col("times") * (F.coalesce("own", F.lit(0.0)) + F.coalesce("fuzzy", F.lit(0.0)))).alias("score"))


def best_loose(index: TextIndex, queries: DataFrame, boosts: Boosts = Boosts(), top: int = TOP) -> DataFrame:
    """(query_id, doc, score): rows of `loose_scores`, each query's `top` first among them.

    The parts of a query's words that add most, the smallest first of like ones, are looked at until they may hold `top`
    documents.  Documents in none of these get no more than the sum of what the other parts add; where the last of the
    `top` found has more than that they can't be among the first.  Where it has not, parts are added until it has."""
    asked = written(queries.select("query_id", F.explode(tx.tokens_folded(F.col("text"))).alias("wanted")).groupBy("query_id", "wanted").agg(F.count("*").alias("times")))
    near = written(near_words(index, asked.select("wanted").distinct()))
    folded = index.postings.where((F.col("form") == "folded") & F.col("field").isin(*{**boosts.exact, **boosts.fuzzy})).select("term", "doc")

    def best(taken: DataFrame) -> DataFrame:
        terms = taken.join(near, "wanted").where(F.col("exact") == (F.col("term") == F.col("wanted"))).select("query_id", "term").distinct()
        return written(ranked(scores_of(index, asked, near, terms.join(folded, "term").select("query_id", "doc").distinct(), boosts), top))

    parts = asked.join(loose_parts(index, near, boosts), "wanted").withColumn("most", F.col("most") * F.col("times"))
    order = Window.partitionBy("query_id").orderBy(F.rint(F.col("most") * 2).desc(), "n", "wanted", "exact")
    before, on = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.sum("most").over(order.rowsBetween(0, Window.unboundedFollowing))
    # `rest`: no less than what this part and all after it add together
    parts = written(parts.select("query_id", "wanted", "exact", (F.coalesce(before, F.lit(0)) < top).alias("taken"), on.alias("rest")))
    found = best(parts.where("taken"))
    last = found.where(F.col("rank") == top).select("query_id", F.col("score").alias("last"))
    # a part stays out only if it and all after it can't bring a document among the first
    more = parts.join(last, "query_id", "left").withColumn("needed", F.col("last").isNull() | (F.col("last") <= F.col("rest") + 1e-6))
    left = written(more.where("needed and not taken").select("query_id").distinct())
    found = found.drop("rank")
    if not left.take(1):
        return found
    again = best(more.where("needed or taken").join(left, "query_id", "left_semi")).drop("rank")
    return found.join(left, "query_id", "left_anti").unionByName(again)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """Each query's `top` rows by score, with rank.  Equal scores go by id; sums whose last bits differ by their order are
    equal."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return found.withColumn("score", F.rint(F.col("score") * 1e9) / 1e9).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(index: TextIndex, queries: DataFrame, boosts: Boosts = Boosts(), allowed: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """(query_id, doc, score, rank): strict hits, or loose ones for queries without any; `allowed` (doc) restricts the
    documents before the cut.  Equal scores go by id."""
    within = lambda df: df if allowed is None else df.join(allowed.select("doc").distinct(), "doc", "left_semi")
    strict = written(within(strict_scores(index, queries, boosts)).select("query_id", "doc", "score"))
    left = queries.join(strict.select("query_id").distinct(), "query_id", "left_anti")
    loose = best_loose(index, left, boosts, top) if allowed is None else within(loose_scores(index, left, boosts))
    return ranked(strict.unionByName(loose.select("query_id", "doc", "score")), top)

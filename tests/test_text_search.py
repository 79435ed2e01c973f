"""Text search over many texts that share a word: right rows, and no pair of a query and a document without need."""

import random

import pandas as pd
from pyspark.sql import functions as F

from gazetteer.operators import textindex as ti

from .test_spatial import joined_rows

N = 200


def many(spark):
    """Documents and queries that share their first word and, but for one, differ in the second."""
    docs = spark.range(N).select("id", F.concat(F.lit("common w"), F.col("id") + 1000).alias("name"), F.lit("").alias("hier"))
    return ti.TextIndex.build(docs), spark.range(N).select(F.col("id").alias("query_id"), F.concat(F.lit("common w"), F.col("id") + 1000).alias("text"))


def most_joined(spark, since):
    """The most rows that any join gave in the executions after the first `since`."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for r in range(since, runs.size()):
        run = runs.apply(r).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            for j in range(node.metrics().size() if "Join" in node.name() else 0):
                m = node.metrics().apply(j)
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_strict_search_looks_at_documents_with_the_rarest_word(spark):
    index, queries = many(spark)
    rows, most = joined_rows(spark, ti.strict_scores(index, queries))
    assert sorted((r.query_id, r.doc) for r in rows) == [(i, i) for i in range(N)]
    assert 0 < most <= 12 * N  # of N * N pairs
    none = queries.limit(3).withColumn("text", F.lit("common nowhere"))
    assert ti.strict_scores(index, none).count() == 0 and ti.strict_scores(index, none.withColumn("text", F.lit(" "))).count() == 0


def test_distances_in_batches():
    a, b = pd.Series(["rnig", "abc", "", "", "abcd", "ca", "a\U0001f600b", "kitten"]), pd.Series(["ring", "abcdef", "", "xy", "badc", "abc", "ab\U0001f600", "sitting"])
    assert ti.osa_distances(a, b, 2).tolist()[:7] == [1, 3, 0, 2, 2, 3, 1]
    assert [min(x, 3) for x in ti.osa_distances(a, b, 2)] == [min(ti.osa_distance(x, y, 2), 3) for x, y in zip(a, b)]


def test_loose_search_finds_a_words_documents_once(spark):
    docs = spark.range(N).select("id", F.concat(F.lit("common w"), F.col("id") + 1000).alias("name"), F.lit("").alias("hier"))
    index = ti.TextIndex.build(docs)
    queries = spark.range(N).select(F.col("id").alias("query_id"), F.lit("common zzzzzzzz").alias("text"))
    words = queries.limit(1).select(F.lit("common").alias("wanted"))
    rows, most = joined_rows(spark, ti.word_scores(index, words, ti.Boosts()))
    assert len(rows) == N and len({r.score for r in rows}) == 1 and most <= 4 * N
    found = ti.search(index, queries, top=3).collect()
    assert sorted((r.query_id, r["rank"], r.doc) for r in found) == [(q, k + 1, k) for q in range(N) for k in range(3)]


def test_loose_search_leaves_out_documents_that_cannot_be_first(spark):
    """Each rare word is held by three documents, the common one by all: three hits need no other documents."""
    word = F.concat(F.lit("common "), F.substring(F.md5((F.col("id") % 100).cast("string")), 1, 10))
    index = ti.TextIndex.build(spark.range(300).select("id", word.alias("name"), F.lit("").alias("hier")))
    queries = spark.range(100).select(F.col("id").alias("query_id"), F.concat(word, F.lit(" zzzzzzzzzzzzzz")).alias("text"))
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    found = ti.search(index, queries, top=3).collect()
    assert sorted((r.query_id, r["rank"], r.doc) for r in found) == [(q, k + 1, q + 100 * k) for q in range(100) for k in range(3)]
    assert 0 < most_joined(spark, since) <= 10_000  # of 100 * 300 pairs


def test_loose_search_of_parts_is_that_of_all(spark):
    words = ["rua", "rue", "ruas", "porto", "porta", "portos", "norte", "sul", "101", "102", "s101"]
    rng = random.Random(5)
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.35)), len(words) - 1)] for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randint(1, 4)), text(rng.randint(0, 6))) for i in range(400)], "id long, name string, hier string")
    queries = spark.createDataFrame([(i, text(rng.randint(1, 4))) for i in range(60)] + [(60, "nowhere"), (61, ""), (62, "rua rua 103 portx")], "query_id long, text string")
    index = ti.TextIndex.build(docs)
    for boosts in (ti.Boosts(), ti.Boosts(exact={"name": 0.5}, fuzzy={"hier": 2.0})):
        whole = ti.ranked(ti.loose_scores(index, queries, boosts), 1 << 30).collect()
        for top in (1, 20, 1 << 30):
            found = ti.ranked(ti.best_loose(index, queries, boosts, top), top).collect()
            assert sorted((r.query_id, r["rank"], r.doc) for r in found) == sorted((r.query_id, r["rank"], r.doc) for r in whole if r["rank"] <= top)
            scores = {(r.query_id, r.doc): r.score for r in whole}
            assert all(abs(r.score - scores[r.query_id, r.doc]) < 1e-6 for r in found)


def test_equal_sums_go_by_id(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in the last bit; they are one score."""
    index, queries = many(spark)
    scores = iter([[(0, 5, 0.3 + 0.2 + 0.1), (0, 3, 0.1 + 0.2 + 0.3)], [(0, 5, 0.1 + 0.2 + 0.3), (0, 3, 0.3 + 0.2 + 0.1)]])
    for rows in scores:
        strict = spark.createDataFrame(rows, "query_id long, doc long, score double")
        old, ti.strict_scores = ti.strict_scores, lambda *_: strict
        try:
            found = ti.search(index, queries.limit(1)).collect()
        finally:
            ti.strict_scores = old
        assert [r.doc for r in sorted(found, key=lambda r: r["rank"])] == [3, 5]

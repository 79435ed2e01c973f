"""Joins of points, streets and houses that share places: right rows, and no pair of copies compared twice."""

import pytest
from pyspark.sql import functions as F

from gazetteer import query as qy
from gazetteer.functions import shapes
from gazetteer.operators import housenumbers as hn
from gazetteer.operators import spatial as sp
from gazetteer.plans import fixtures as fx
from gazetteer.plans import suite
from gazetteer.scratch import written

N = 300


def joined_rows(spark, df):
    """The rows of `df`, and the most rows that any join of its plan gave."""
    rows = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1).executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for i in range(nodes.size()):
        node = nodes.apply(i)
        for j in range(node.metrics().size() if "Join" in node.name() else 0):
            m = node.metrics().apply(j)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return rows, most


def test_closest_house_of_many_at_one_place(spark):
    points = spark.range(N).select(F.col("id").alias("query_id"), F.lit(1).alias("street_id"), F.lit(2.0).alias("lon"), F.lit(3.0).alias("lat"))
    houses = spark.range(N).select(F.lit(1).alias("street_id"), (F.col("id") + 7).alias("node_id"), F.col("id").cast("string").alias("number"), F.lit(2.0).alias("x"), F.lit(3.0001).alias("y"))
    rows, most = joined_rows(spark, hn.closest(points, houses))
    assert sorted(tuple(r) for r in rows) == [(i, 1, "0", 11) for i in range(N)]
    assert 0 < most <= 2 * N


def crowd(spark):
    """Points at one place, and a street of one segment as often; a second place and segment are far from them."""
    points = spark.range(N).select(F.col("id").alias("cid"), F.when(F.col("id") == 5, 9.0).otherwise(2.0).alias("lon"), F.lit(3.0).alias("lat"))
    far = F.when(F.col("id") == 1, 4.0).otherwise(0.0)
    return points, spark.range(N).select("id", F.lit("A").alias("name"), (2.0 + far).alias("x1"), F.lit(3.0001).alias("y1"), (2.01 + far).alias("x2"), F.lit(3.0001).alias("y2"))


def test_first_streets_of_many_at_one_place(spark):
    points, streets = crowd(spark)
    rows, most = joined_rows(spark, sp.nearby_streets(points, streets, "cid").select("cid", "id", "rank", "metres"))
    first = [i for i in range(11) if i != 1]
    assert sorted(tuple(r) for r in rows) == [(c, i, k, 11) for c in range(N) if c != 5 for k, i in enumerate(first, 1)]
    assert 0 < most <= 10 * N


def test_point_with_two_places_keeps_its_first_streets(spark):
    points = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 3.0002)], "cid long, lon double, lat double")
    _, streets = crowd(spark)
    rows = sp.nearby_streets(points, streets, "cid").select("id", "rank", "metres").collect()
    assert sorted((r.rank, r.metres) for r in rows) == [(k, 11) for k in range(1, 11)]


def test_first_streets_in_a_region_of_many_at_one_place(spark):
    points, streets = crowd(spark)
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 2.0), (3.0, 2.0), (2.0, 5.0), (1.0, 2.0))])
    rows, most = joined_rows(spark, sp.nearby_streets(points, streets, "cid", ring, envelope=(1.0, 2.0, 3.0, 5.0)).select("cid", "id"))
    assert len(rows) == 10 * (N - 1) and 0 < most <= 10 * N
    outside = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 2.0), (3.0, 2.0), (3.0, 3.0), (1.0, 2.0))])
    assert sp.nearby_streets(points, streets, "cid", outside).count() == 0


def test_all_streets_of_many_at_one_place(spark):
    points, streets = crowd(spark)
    all_of = sp.nearby_streets(points, streets, "cid", top=None)
    assert all_of.where("metres <= 11").count() == (N - 1) ** 2
    rows, most = joined_rows(spark, all_of.where("metres < 11"))
    assert rows == [] and most <= N  # no pairs of copies before the filter


def test_nearest_of_many_streets_at_one_place(spark):
    points, streets = crowd(spark)
    rows, most = joined_rows(spark, sp.match_houses(points.withColumn("addr_street", F.lit(None).cast("string")), streets, "cid", 0.15))
    assert sorted((r.cid, r.street_id, r.strategy) for r in rows) == [(c, 0, 0) for c in range(N) if c != 5]
    assert 0 < most <= N


def test_match_of_many_houses_at_one_place_and_name(spark):
    points, streets = crowd(spark)
    named = points.withColumn("addr_street", F.when(F.col("cid") % 2 == 0, "a"))
    far = streets.withColumn("name", F.when(F.col("id") % 3 == 0, "b").otherwise("A"))
    rows, most = joined_rows(spark, sp.match_houses(named, far, "cid"))
    # street 1 lies 4 degrees off, so the smallest id of the name near by is 2
    assert sorted((r.cid, r.street_id, r.strategy) for r in rows) == [(c, 0 if c % 2 else 2, 1 - c % 2) for c in range(N) if c != 5]
    assert 0 < most <= N


def test_houses_found_by_name_alone(spark):
    points, streets = crowd(spark)
    named = points.withColumn("addr_street", F.when(F.col("cid") % 2 == 0, "a").otherwise("c"))
    rows, most = joined_rows(spark, sp.match_houses_by_name(named, streets, "cid"))
    assert sorted((r.cid, r.street_id, r.strategy) for r in rows) == [(c, 0, 1) for c in range(0, N, 2)]
    assert 0 < most <= N


def test_lines_of_many_at_one_place(spark):
    points, streets = crowd(spark)
    xy = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = sp.with_box(streets).select("id", "name", F.array(F.array(xy("x1", "y1"), xy("x2", "y2"))).alias("lines"), "minx", "miny", "maxx", "maxy")
    rows, most = joined_rows(spark, sp.match_houses_to_lines(points.withColumn("addr_street", F.when(F.col("cid") % 2 == 0, "a")), lines, "cid"))
    assert sorted((r.cid, r.street_id, r.strategy) for r in rows) == [(c, 0, 1 - c % 2) for c in range(N) if c != 5]
    assert 0 < most <= N
    near = sp.nearby_lines(points.where("cid < 3").select(F.col("cid").alias("query_id"), "lon", "lat"), lines.drop("name"))
    assert sorted((r.query_id, r.id, r.metres) for r in near.collect()) == [(c, i, 11) for c in range(3) for i in range(N) if i != 1]


def test_first_lines_of_many_at_one_place(spark):
    points, streets = crowd(spark)
    xy = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    areas = streets.select(F.col("id").cast("long").alias("id"), F.lit(12).alias("admin_level"), "name", shapes.of_lines(shapes.LINE, F.array(F.array(xy("x1", "y1"), xy("x2", "y2")))).alias("geom"))
    asked, tables = points.where("cid < 3").select(F.col("cid").alias("query_id"), "lon", "lat"), qy.Tables(areas, None, None, None)
    rows, most = joined_rows(spark, qy.street_candidates(asked, tables, qy.Filters()))
    assert sorted((r.query_id, r.place, r.id) for r in rows) == [(c, k, i) for c in range(3) for k, i in enumerate([i for i in range(11) if i != 1], 1)]
    assert 0 < most <= 30
    assert len(qy.street_candidates(asked, tables, qy.Filters(), early=False).collect()) == len(qy.street_candidates(asked, tables, qy.Filters(levels=(12,))).collect()) == 3 * (N - 1)


@pytest.mark.parametrize("early", [True, False])
def test_matches_of_many_points_at_one_place(spark, monkeypatch, early):
    f = fx.Fixtures(spark, "/root/testdata/sf0.001")
    tables, street = suite._tables(f), f.streets().orderBy("id").first()
    points = spark.range(N).select((F.col("id") + 4).alias("query_id"), F.lit(street.y1).alias("lat"), F.lit(street.x1).alias("lon"))
    sizes = []

    def counted(df):
        table = written(df)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(qy, "written", counted)
    rows = qy.coordinate_matches(points, tables, qy.Filters(include_wkt=False), early).select("query_id", "rank", "id").collect()
    one = sorted((r.rank, r.id) for r in rows if r.query_id == 4)
    assert one[0] == (1, street.id) and sorted(tuple(r) for r in rows) == [(q + 4, *m) for q in range(N) for m in one]
    assert max(sizes) <= f.streets().count()

"""Geocoding over small hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from gazetteer import query as qy
from gazetteer import service
from gazetteer.functions import shapes
from gazetteer.operators import areas as ar
from gazetteer.operators import hierarchy as hi
from gazetteer.operators import textindex as ti
from gazetteer.scratch import written

PT = lambda x, y: {"x": float(x), "y": float(y)}


def line(i, name, x1, y1, x2, y2, post=None, level=12):
    return (i * 2, None, i, level, name, None, post, (shapes.LINE, [[[PT(x1, y1), PT(x2, y2)]]]))


def box(i, name, level, x1, y1, x2, y2, iso=None, post=None):
    ring = [PT(x1, y1), PT(x1, y2), PT(x2, y2), PT(x2, y1), PT(x1, y1)]
    return (i * 2 + 1, i, None, level, name, iso, post, (shapes.POLYGONS, [[ring]]))


def tables(spark, areas, houses=()):
    a = written(spark.createDataFrame(areas, ar.AREA))
    h = written(ar.hierarchy(a))
    docs = written(hi.documents(a.withColumnRenamed("admin_level", "level"), h))
    return qy.Tables(a, h, spark.createDataFrame(list(houses), ar.HOUSES), ar.boxes(a), ti.TextIndex.build(docs), docs.select("id", "level"))


def ask(t, *texts, **options):
    q = t.areas.sparkSession.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    rows = qy.geocode(t, q, **options).orderBy("query_id", "rank").collect()
    return [[r for r in rows if r.query_id == i] for i in range(len(texts))]


@pytest.fixture(scope="module")
def golden(spark):
    return tables(spark, [line(1, "rua castro alves", 0, 0, 0.001, 0, "11250-000"), line(3, "Praça da Sé", 0.002, 0, 0.003, 0)])


def test_scores_and_similarity(golden):
    asked = ["rua castro alves", "rua", "rua castro", "castro alves", "rua alves", "alves castro rua", "rua castro alvez", "11250-000", "hotel rua castro alves", "praca da se", "11250000", "nothing at all", None]
    found = ask(golden, *asked)
    assert [round(float(m[0].score), 4) for m in found[:11]] == pytest.approx([36.5982, 6.0997, 24.3988, 24.3988, 12.1994, 18.2991, 10.5997, 24.3988, 13.6495, 40.1296, 6.0997], abs=2e-4)
    assert [round(float(m[0].similarity), 5) for m in found[:11]] == [1, 1, 1, 1, 1, 1, 0.66667, 1, 0.75, 1, 1]
    assert found[11] == found[12] == []


@pytest.fixture(scope="module")
def town(spark):
    areas = [
        box(1, "Land", 2, -10, -10, 10, 10, "LD"), box(2, "State", 4, -5, -5, 5, 5, None, "S-1"), box(3, "City", 8, -1, -1, 1, 1),
        box(4, "Outer", 10, -0.5, -0.5, 0.5, 0.5), box(5, "Inner", 10, -0.2, -0.2, 0.2, 0.2, None, "I-9"),
        line(10, "Rua 25 de Março", 0, 0, 0.01, 0, "OWN-1"), line(11, "Rua do Porto", 0, 0.001, 0.01, 0.001), line(12, "Rua do Porto", 0.3, 0.3, 0.31, 0.3), line(13, "Far Road", 3, 3, 3.01, 3),
    ]
    houses = [(1, 22, "100", 0.001, 0.001, 0), (2, 22, "200", 0.005, 0.001, 0), (3, 22, "300 ", 0.009, 0.001, 1), (4, 22, "12A", 0.002, 0.001, 0), (5, 20, "7", 0.004, 0.0, 0)]
    return tables(spark, areas, houses)


def test_answers(town):
    point, bare, far, exact, between, absent, letter, street = ask(town, "0.0001, 0.0041", "0,0.0", "80,100", "rua do porto 200", "rua do porto 150", "rua do porto, 900", "rua do porto 12a", "rua 25 de março", include_wkt=False)
    first, second, *rest = point
    assert (first.id, second.id) == (20, 22) and not rest and first.service == "coordinates_to_address" and far == []
    assert [(p.level, p.name) for p in first.admin_levels] == [(2, "Land"), (4, "State"), (8, "City"), (10, "Outer"), (10, "Inner"), (12, "Rua 25 de Março"), (30, "7")]
    assert (first.latitude, first.longitude) == (0.0, 0.0041) and first.coordinates_distance_in_meters == 11
    assert first.attributes.country_iso_3166_1_alpha_2_code == "LD" and first.attributes.post_code == "I-9"
    assert first.friendly_name.startswith("Rua 25 de Março, 7, ") and first.house_number is None and first.similarity is None
    # no number within reach: the stored name, the own post code last
    assert bare[0].friendly_name == "Rua 25 de Março, Inner, Outer, City, State, Land, OWN-1"
    # numbers of text queries
    hit = exact[0]
    assert hit.id == 22 and hit.house_number.asDict() == {"number": "200", "kind": "exact"} and (hit.longitude, hit.latitude) == (0.005, 0.001)
    assert hit.similarity == pytest.approx(0.76) and [p.level for p in hit.admin_levels][-1] == 30
    other = exact[1]
    assert other.id == 24 and other.house_number.kind == "absent" and other.similarity == pytest.approx(0.75)
    assert between[0].house_number.kind == "interpolated" and between[0].longitude == 0.003
    assert absent[0].house_number.kind == "absent" and absent[0].admin_levels[-1].level == 12
    assert letter[0].house_number.asDict() == {"number": "12a", "kind": "exact"}
    assert street[0].id == 20 and street[0].house_number is None and street[0].similarity == 1
    assert street[0].attributes.post_code == "I-9" and (street[0].longitude, street[0].latitude) == (0.005, 0.0)


def test_filters(town):
    ids = lambda *texts, **o: [[m.id for m in found] for found in ask(town, *texts, include_wkt=False, **o)]
    assert ids("0.0001,0.0041", "rua do porto xyz", min_quality=0.85) == [[20], []]
    assert ids("0.0001,0.0041", "porto", region="POLYGON((-1 0.0005,0.2 0.0005,0.2 1,-1 1,-1 0.0005))") == [[22], [22]]
    assert ids("0.0001,0.0041", "rua do porto 200", "city", levels=(12,)) == [[22], [24, 20], [24, 20, 22]]  # a resolved number makes 30 the last level
    for bad in ({"region": "POINT(0 0)"}, {"template": "{what}"}):
        with pytest.raises(ValueError):
            ask(town, "0,0", **bad)


def test_names_and_shapes(town):
    m = ask(town, "far road", template="{admin_level_12_name}, {admin_level_8_name}, {admin_level_2_name}")[0][0]
    assert m.friendly_name == "Far Road, Land"
    assert m.admin_levels[-1].wkt == "LINESTRING(3 3,3.01 3)" and m.admin_levels[0].wkt.startswith("MULTIPOLYGON(((-10 -10")


def test_a_region_beyond_the_text_cut(spark):
    many = [line(100 + i, "strong road road", 2 + i * 0.01, 2, 2.005 + i * 0.01, 2) for i in range(55)]
    t = tables(spark, [*many, line(1, "weak strong road of the other side", 0, 0, 0.01, 0)])
    assert [m.id for m in ask(t, "strong road", region="POLYGON((-1 -1,1 -1,1 1,-1 1,-1 -1))", include_wkt=False)[0]] == [2]


def test_service(spark, town, tmp_path):
    from gazetteer.workspace import Workspace

    ws = Workspace(spark, str(tmp_path / "w"))
    get = lambda url, method="GET": service.answer(ws, town, method, url)
    status, kind, body = get("/geocode?query=rua%20do%20porto+200&include_wkt=false&quality=abc")
    first = json.loads(body)["matches"][0]
    assert status == 200 and kind == service.JSON and first["house_number"] == {"number": "200", "kind": "exact"} and "wkt" not in first["admin_levels"][0]
    assert [get(u)[0] for u in ("/geocode", "/geocode?query=x&bounding_wkt=POINT(1%201)", "/geocode?query=x&last_admin_levels=,", "/geocode?query=x&friendly_name_format={z}", "/nowhere", "/status", "/", "/docs", "/openapi.json")] == [400, 400, 400, 400, 404, 503, 200, 200, 200]
    assert get("/geocode", "OPTIONS")[0] == 204 and get("/geocode", "POST")[0] == 405 and get("/nowhere", "POST")[0] == 404
    bare = qy.Tables(town.areas, town.hierarchy, town.houses, town.boxes)
    assert service.answer(ws, bare, "GET", "/geocode?query=rua")[0] == 503 and service.answer(ws, bare, "GET", "/geocode?query=0,0&include_wkt=false")[0] == 200
    assert service.is_coordinates(" -23.9 , 46") and not service.is_coordinates("91,0") and not service.is_coordinates("nan,1") and not service.is_coordinates("12")


def test_json_of_matches(spark):
    part = "named_struct('level', 12, 'name', 'A', 'osm_relation_id', cast(null AS long), 'osm_way_id', 1L, 'wkt', cast(null AS string))"
    row = "SELECT 7L AS query_id, 'text_to_address' AS service, {0} AS rank, {0}L AS id, array(" + part + ") AS admin_levels, 0D AS latitude, 1D AS longitude, cast(null AS long) AS coordinates_distance_in_meters, cast(1 AS float) AS similarity, cast(2 AS float) AS score, 'A' AS friendly_name, named_struct('post_code', 'P') AS attributes, cast(null AS struct<number:string,kind:string>) AS house_number"
    rows = spark.sql(row.format(2)).unionByName(spark.sql(row.format(1)))
    out = json.loads(qy.as_json(rows).first().output)
    assert [m["id"] for m in out["matches"]] == [1, 2] and out["matches"][0]["house_number"] is None
    plain = qy.document("text_to_address", [r.asDict(recursive=True) for r in rows.orderBy("rank").collect()])
    assert "house_number" not in plain["matches"][0] and "wkt" not in plain["matches"][0]["admin_levels"][0] and plain["matches"][0]["score"] == 2


def test_plans_have_no_nested_loops(spark, town):
    p = spark.createDataFrame([(0, 0.0, 0.0)], "query_id long, lat double, lon double")
    plan = qy.coordinate_matches(p, town, qy.Filters(include_wkt=False))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stream_of_queries(spark, town, tmp_path):
    from gazetteer.streaming.answers import answer_stream

    spark.createDataFrame([(5, "far road")], "query_id long, text string").write.json(str(tmp_path / "in"))
    asked = spark.readStream.schema("query_id long, text string").json(str(tmp_path / "in"))
    answer_stream(asked, town, str(tmp_path / "out"), include_wkt=False).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.query_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("rank") == 1).collect()] == [(5, 26)]

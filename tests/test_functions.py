import pytest
from pyspark.sql import functions as F

from gazetteer.functions import text as tx
from gazetteer.operators import hierarchy, osm
from gazetteer.operators import textindex as ti


def test_url_decoding():
    assert tx.url_decode("a%20b+c") == "a b c"
    assert tx.url_decode("50%zz") == "50%zz"
    assert tx.query_param("x=1&query=rua%20a&query=b", "query") == "rua a"


def test_template_grammar():
    assert tx.parse_template("{admin_level_8_name}, {house_number}") == [("level", "8"), ("text", ", "), ("house_number", "")]
    assert tx.parse_template("a} {admin_level_255_name}") == [("text", "a} "), ("level", "255")]
    for bad in ("{x}", "a{", "{admin_level_999_name}", "{admin_level__name}"):
        with pytest.raises(ValueError):
            tx.parse_template(bad)


def test_swapped_letters_are_one_edit():
    assert ti.osa_distance("rnig", "ring", 2) == 1
    assert ti.osa_distance("abc", "abcdef", 2) > 2


def test_rings_join_reversed_ways():
    assert len(osm.join_rings([[(0, 0), (1, 0), (1, 1)], [(0, 0), (0, 1), (1, 1)]])[0]) == 5
    assert osm.join_rings([[(0, 0), (1, 0)], [(5, 5), (6, 6)]]) == []


def test_a_ring_goes_on_while_a_way_fits():
    square = [(0, 0), (1, 0), (1, 1), (0, 0)]
    assert osm.join_rings([square, [(0, 0), (9, 9)]]) == []  # the second way fits the closed ring's end and opens it
    assert osm.join_rings([square, [(5, 5), (9, 9)]]) == [square]


def test_a_cycle_of_parents_is_an_error(spark):
    of = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent_id long")
    with pytest.raises(ValueError):
        hierarchy.ancestor_chains(of, 4)
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 3)], "id long, parent_id long")
    assert {r.id: r.ancestor_ids for r in hierarchy.ancestor_chains(chain).collect()} == {1: [2, 3, 4], 2: [3, 4], 3: [4], 9: [3, 4]}


def test_deletions_meet_for_near_words(spark):
    rows = spark.createDataFrame([("rnig", "ring"), ("castro", "castor"), ("alvez", "alves"), ("ab", "ba"), ("street", "straat")], "a string, b string")
    two = F.lit(2)
    assert all(r[0] for r in rows.select(F.arrays_overlap(ti.deletions(F.col("a"), two), ti.deletions(F.col("b"), two))).collect())


def test_entity_text(spark):
    rows = spark.createDataFrame([("Rua A", " 11250-000 "), ("Rua B", "  "), ("Rua C", None), ("Rua D", "123")], "n string, p string")
    assert [r[0] for r in rows.select(tx.entity_text(F.col("n"), F.col("p"))).collect()] == ["Rua A 11250-000 11250000", "Rua B", "Rua C", "Rua D 123"]


def test_packed_ids_come_apart(spark):
    r = spark.range(1).select(tx.unpack_id(tx.pack_id(F.lit(7), F.lit(True))).alias("a"), tx.unpack_id(tx.pack_id(F.lit(7), F.lit(False))).alias("b")).first()
    assert (r.a.osm_id, r.a.relation, r.b.osm_id, r.b.relation) == (7, True, 7, False)


def test_level_rules(spark):
    rows = spark.createDataFrame([(1, "suburb", None), (2, None, "park"), (3, None, None)], "id int, place string, leisure string").withColumns({"building": F.lit(None).cast("string"), "waterway": F.lit(None).cast("string"), "highway": F.lit(None).cast("string")})
    p = osm.way_predicates(F.col)
    assert [r.id for r in rows.where(osm.level_filter(10, p)).collect()] == [1]
    assert [r.id for r in rows.where(osm.level_filter(12, p)).collect()] == [3]


def test_ranking_of_an_exact_hit(spark):
    docs = spark.createDataFrame([(1, "Rua Castro Alves", "Santos"), (2, "Praça da Sé", "Santos")], "id long, name string, hier string")
    index = ti.TextIndex.build(docs)
    q = spark.createDataFrame([(0, "rua castro alves"), (1, "rua castro alvez"), (2, "praca da se")], "query_id int, text string")
    best = {r.query_id: (r.doc, r.score) for r in ti.search(index, q, top=1).collect()}
    assert best[0][0] == 1 and best[1][0] == 1 and best[2][0] == 2
    assert best[0][1] > best[1][1]


def test_parent_polygon_holds_the_centroid(spark):
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in (*ps, ps[0])]
    box, ell = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))
    rows = [(1, 2, 16.0, [[box]]), (2, 4, 7.0, [[ell]]), (3, 6, 15.0, [[box, ring((2.5, 2.5), (3.5, 2.5), (3.5, 3.5), (2.5, 3.5))]])]
    c = spark.createDataFrame(rows, "id long, level int, area double, polygons array<array<array<struct<x: double, y: double>>>>").selectExpr("*", "0d AS minx", "0d AS miny", "4d AS maxx", "4d AS maxy")
    asked = [(10, 5, 0.0, 0.5, 0.5), (11, 5, 0.0, 3.0, 3.0), (12, 12, 0.0, 3.0, 3.0), (13, 12, 0.0, 2.0, 2.0)]
    got = hierarchy.parents(spark.createDataFrame(asked, "id long, level int, area double, lon double, lat double"), c).collect()
    assert dict(map(tuple, got)) == {10: 2, 11: 1, 12: 1, 13: 3}

"""The registered queries: each operator on the test tables' derived shapes, with the SQL that says the same.

Distances and scores leave as scaled longs, so that two engines' last bits do not matter; every order ends in a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import presets
from .. import query as qy
from ..functions import geo, shapes
from ..functions import text as tx
from ..operators import areas as ar
from ..operators import catalog
from ..operators import hierarchy as hi
from ..operators import housenumbers as hn
from ..operators import osm
from ..operators import spatial as sp
from ..operators import textindex as ti
from ..scratch import written
from ..sources import osmpbf
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fx.Fixtures(spark, sf_dir))
        QUERIES[f.__name__].__name__ = f.__name__
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


micro = lambda c: F.round(c * F.lit(1e6)).cast("long")
STREETS, PTS, NODES = fx.cte("streets", fx.STREETS, "supplier"), fx.cte("pts", fx.PTS, "customer"), fx.cte("nodes", fx.NODES, "part")
TAGGED = fx.cte("tagged", fx.TAGGED, "orders")

# --- coordinates to streets --------------------------------------------------------------------------------------------

_T = "greatest(0e0, least(1e0, CASE WHEN (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) = 0 THEN 0e0 ELSE ((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) END))"
_HAV = "2e0*6371008.8e0*asin(sqrt(power(sin(radians({b}-{a})/2e0),2)+cos(radians({a}))*cos(radians({b}))*power(sin(radians({d}-{c})/2e0),2)))"
_NEAR = f"""{STREETS}, {PTS},
near AS (SELECT cid, lon, lat, id, name, x1 + t*(x2-x1) AS qx, y1 + t*(y2-y1) AS qy FROM (SELECT *, {_T} AS t FROM pts, streets
 WHERE least(x1,x2) <= lon+1e-1 AND greatest(x1,x2) >= lon-1e-1 AND least(y1,y2) <= lat+1e-1 AND greatest(y1,y2) >= lat-1e-1)),
metres AS (SELECT *, CAST(round({_HAV.format(a='lat', b='qy', c='lon', d='qx')}) AS BIGINT) AS metres FROM near)"""
_TOP = "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cid ORDER BY metres, id) AS INTEGER) AS rank FROM {src}) WHERE rank <= 10"


@query(f"WITH {_NEAR} SELECT cid, id AS street_id, rank, metres FROM ({_TOP.format(src='metres')})")
def reverse_geocode_top10(f):
    return sp.nearby_streets(f.points(), f.streets(), "cid").select("cid", F.col("id").alias("street_id"), F.col("rank").cast("int").alias("rank"), "metres")


_TRIANGLE = [(-46.4, -24.0), (-45.9, -24.0), (-46.4, -23.2), (-46.4, -24.0)]


_ENVELOPE = (min(x for x, _ in _TRIANGLE), min(y for _, y in _TRIANGLE), max(x for x, _ in _TRIANGLE), max(y for _, y in _TRIANGLE))


def _ring():
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in _TRIANGLE])



_IN = " + ".join(f"CASE WHEN ({b[1]}e0 > qy) <> ({a[1]}e0 > qy) AND qx < ({b[0]}e0 - {a[0]}e0)*(qy - {a[1]}e0)/nullif({b[1]}e0 - {a[1]}e0, 0e0) + {a[0]}e0 THEN 1 ELSE 0 END" for a, b in zip(_TRIANGLE, _TRIANGLE[1:]))
_ON = " OR ".join(f"(({b[0]}e0 - {a[0]}e0)*(qy - {a[1]}e0) = ({b[1]}e0 - {a[1]}e0)*(qx - {a[0]}e0) AND qx BETWEEN {min(a[0], b[0])}e0 AND {max(a[0], b[0])}e0 AND qy BETWEEN {min(a[1], b[1])}e0 AND {max(a[1], b[1])}e0)" for a, b in zip(_TRIANGLE, _TRIANGLE[1:]))


@query(f"WITH {_NEAR}, inside AS (SELECT * FROM metres WHERE ({_IN}) % 2 = 1 AND NOT ({_ON})) SELECT cid, id AS street_id, rank, metres FROM ({_TOP.format(src='inside')})")
def region_filtered_reverse(f):
    return sp.nearby_streets(f.points(), f.streets(), "cid", _ring(), envelope=_ENVELOPE).select("cid", F.col("id").alias("street_id"), F.col("rank").cast("int").alias("rank"), "metres")


@query(f"WITH {_NEAR} SELECT cid, id AS street_id, CAST(round(greatest(0e0, least(1e0, 1e0 - metres/1e2))*1e6) AS BIGINT) AS quality FROM metres WHERE greatest(0e0, least(1e0, 1e0 - metres/1e2)) >= 2e-1")
def coordinate_quality_filter(f):
    near = sp.nearby_streets(f.points(), f.streets(), "cid", top=None)
    q = geo.coordinate_quality(F.col("metres"))
    return near.where(q >= 0.2).select("cid", F.col("id").alias("street_id"), micro(q).alias("quality"))


@query(f"WITH {STREETS} SELECT id FROM streets WHERE least(x1,x2) <= -4.60e1 AND greatest(x1,x2) >= -4.62e1 AND least(y1,y2) <= -2.36e1 AND greatest(y1,y2) >= -2.39e1")
def bbox_ids(f):
    return sp.with_box(f.streets()).where("minx <= -4.60e1 AND maxx >= -4.62e1 AND miny <= -2.36e1 AND maxy >= -2.39e1").select("id")


@query(f"WITH {PTS}, q AS (SELECT cid, lon AS qx, lat AS qy FROM pts) SELECT cid, ({_IN}) % 2 = 1 AS inside, ({_IN}) % 2 = 1 AND NOT ({_ON}) AS strictly FROM q")
def point_in_polygon(f):
    return f.points().select("cid", geo.in_ring(F.col("lon"), F.col("lat"), _ring()).alias("inside"), geo.strictly_inside(F.col("lon"), F.col("lat"), _ring()).alias("strictly"))


@query("SELECT CAST(k AS INTEGER) AS k, CAST(round(lat*1e6) AS BIGINT) AS lat, CAST(round(lon*1e6) AS BIGINT) AS lon FROM (VALUES (0, -2.395e1, -4.64e1), (1, 9e1, 1.8e2), (4, 1e0, 2e0)) AS t(k, lat, lon)")
def parse_coordinates(f):
    texts = ["-23.95, -46.4", "90,180", "91,0", "abc,1", " 1 , 2 ", "NaN,1", "12", "1,2,3"]
    df = f.spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    p = tx.parse_coordinates(F.col("t"))
    return df.withColumn("p", p).where(F.col("p").isNotNull()).select("k", micro(F.col("p.lat")).alias("lat"), micro(F.col("p.lon")).alias("lon"))


@query(f"WITH {PTS} SELECT cid, CAST(floor(lon/2e0) AS BIGINT) AS tx, CAST(floor(lat/2e0) AS BIGINT) AS ty FROM pts")
def tile_keys(f):
    return f.points().select("cid", geo.tile(F.col("lon"), 2.0).alias("tx"), geo.tile(F.col("lat"), 2.0).alias("ty"))


_R5 = "CASE WHEN {0} < 0 THEN -floor(abs({0}*1e5)+5e-1) ELSE floor(abs({0}*1e5)+5e-1) END"


@query(f"WITH {PTS} SELECT cid, CAST({_R5.format('(lon*lat)')} AS BIGINT) AS v FROM pts")
def round5_coords(f):
    return f.points().select("cid", F.round(geo.round5(F.col("lon") * F.col("lat")) * 1e5).cast("long").alias("v"))


#: Streets whose box comes within the search window of the point.
_WINDOW = "least(x1,x2) <= lon+1e-1 AND greatest(x1,x2) >= lon-1e-1 AND least(y1,y2) <= lat+1e-1 AND greatest(y1,y2) >= lat-1e-1"
_SEG = f"SELECT cid, id, x1 + t*(x2-x1) AS qx, y1 + t*(y2-y1) AS qy, lon, lat, x1, y1, x2, y2 FROM (SELECT *, {_T} AS t FROM pts, streets)"


@query(f"WITH {STREETS}, {PTS}, n AS ({_SEG}), d AS (SELECT *, (lon-qx)*(lon-qx)+(lat-qy)*(lat-qy) AS d2 FROM n) SELECT cid, id AS street_id, CAST(round(sqrt(d2)*1e6) AS BIGINT) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY d2, id) AS r FROM d WHERE d2 <= 2.25e-2) WHERE r = 1")
def nearest_street(f):
    out = sp.match_houses(f.points().withColumn("addr_street", F.lit(None).cast("string")), f.streets(), "cid", 0.15)
    j = out.join(f.points(), "cid")
    return j.select("cid", "street_id", micro(F.sqrt(F.pow(F.col("lon") - F.col("x"), 2) + F.pow(F.col("lat") - F.col("y"), 2))).alias("dist"))


# --- administrative areas ----------------------------------------------------------------------------------------------

_B = f"{fx.BOUNDS_SQL}, b AS (SELECT *, (maxx-minx)*(maxy-miny) AS area FROM bounds), {STREETS}"
_E = "e AS (SELECT id, name, 12 AS level, 0e0 AS area, (x1+x2)/2e0 AS lon, (y1+y2)/2e0 AS lat FROM streets UNION ALL SELECT id + 1000000, name, level, area, (minx+maxx)/2e0, (miny+maxy)/2e0 FROM b)"
_P = """cand AS (SELECT e.id, b.id + 1000000 AS pid, row_number() OVER (PARTITION BY e.id ORDER BY b.level DESC, b.area, b.id) AS r FROM e JOIN b ON lon >= minx AND lon < maxx AND lat >= miny AND lat < maxy AND b.id + 1000000 <> e.id
 AND (b.level < e.level OR (b.level = e.level AND b.area > e.area))), parent AS (SELECT id, pid AS parent_id FROM cand WHERE r = 1)"""


def _box_ring():
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(*[pt(x, y) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])


def _areas(f):
    b = f.bounds().withColumn("area", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).withColumn("id", F.col("id").cast("long") + 1000000).withColumn("polygons", F.array(F.array(_box_ring())))
    own = b.select("id", "name", "level", "area", ((F.col("minx") + F.col("maxx")) / 2).alias("lon"), ((F.col("miny") + F.col("maxy")) / 2).alias("lat"))
    s = f.streets().select("id", "name", F.lit(12).alias("level"), F.lit(0.0).alias("area"), ((F.col("x1") + F.col("x2")) / 2).alias("lon"), ((F.col("y1") + F.col("y2")) / 2).alias("lat"))
    return s.unionByName(own), b


@query(f"WITH {_B}, {_E}, {_P} SELECT id, parent_id FROM parent")
def hierarchy_parent(f):
    areas, b = _areas(f)
    return hi.parents(areas, b)


@query(f"WITH RECURSIVE {_B}, {_E}, {_P}, up(id, anc, pos) AS (SELECT id, parent_id, 1 FROM parent UNION ALL SELECT up.id, parent.parent_id, pos + 1 FROM up JOIN parent ON parent.id = up.anc), names AS (SELECT up.id, string_agg(e.name, ', ' ORDER BY pos) AS ns, count(*) AS n FROM up JOIN e ON e.id = up.anc GROUP BY up.id) SELECT e.id, CAST(coalesce(n, 0) AS INTEGER) AS depth, concat_ws(', ', e.name, ns) AS friendly_name FROM e LEFT JOIN names ON names.id = e.id")
def hierarchy_chain(f):
    areas, b = _areas(f)
    chains = hi.ancestor_chains(hi.parents(areas, b))
    names = hi.friendly_names(areas, chains, areas)
    return names.join(chains, "id", "left").select("id", F.coalesce(F.size("ancestor_ids"), F.lit(0)).alias("depth"), "friendly_name").withColumn("depth", F.greatest("depth", F.lit(0)))


@query(f"WITH {_B} SELECT id, CAST(row_number() OVER (ORDER BY level, area DESC, id) AS INTEGER) AS place FROM b")
def level_area_order(f):
    b = f.bounds().withColumn("area", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))
    return hi.global_rank(b.select("id", "level", "area"), F.col("level"), F.desc("area"), F.col("id")).select("id", "place")


@query("SELECT n_nationkey AS id, concat_ws(', ', n_name, nullif(trim(CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat(' ', n_nationkey, '-9') END), '')) AS friendly_name FROM nation")
def postcode_friendly_name(f):
    n = f.table("nation").selectExpr("n_nationkey AS id", "n_name AS name", "CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat(' ', n_nationkey, '-9') END AS post_code")
    none = f.spark.createDataFrame([], "id long, ancestor_ids array<long>")
    return hi.friendly_names(n, none, n).select("id", "friendly_name")


# --- house numbers -----------------------------------------------------------------------------------------------------

_CANON = "CASE WHEN regexp_full_match(trim(number), '[0-9]+[ -]?[A-Za-z]') THEN concat(regexp_extract(trim(number), '^[0-9]+'), upper(right(trim(number), 1))) ELSE trim(number) END"


@query(f"WITH {fx.HN_SQL} SELECT node_id, {_CANON} AS number FROM hn WHERE number IS NOT NULL AND trim(number) <> '' AND lower(number) NOT IN ('s/n')")
def house_number_canonical(f):
    return hn.candidates(f.house_nodes(), ["s/n"]).select("node_id", "number")


_MATCH = f"""{fx.HN_SQL}, {STREETS}, pr AS (SELECT node_id, id, x1 + t*(x2-x1) AS qx, y1 + t*(y2-y1) AS qy, lon, lat, lower(addr_street) = lower(name) AND abs(floor((least(x1,x2)+greatest(x1,x2))/2e0/2e0) - floor(lon/2e0)) <= 1
 AND abs(floor((least(y1,y2)+greatest(y1,y2))/2e0/2e0) - floor(lat/2e0)) <= 1 AS named FROM (SELECT *, {_T} AS t FROM hn, streets)),
d AS (SELECT *, (lon-qx)*(lon-qx)+(lat-qy)*(lat-qy) AS d2 FROM pr),
c AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CASE WHEN named THEN 0 ELSE 1 END, d2, id) AS r FROM d WHERE named OR d2 <= 2.25e-2)"""


@query(f"WITH {_MATCH} SELECT node_id, id AS street_id, CASE WHEN named THEN 1 ELSE 0 END AS strategy, CAST(round(qx*1e6) AS BIGINT) AS x, CAST(round(qy*1e6) AS BIGINT) AS y FROM c WHERE r = 1")
def house_match(f):
    return sp.match_houses(f.house_nodes(), f.streets(), "node_id").select("node_id", "street_id", "strategy", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))


_STREET_HOUSES = "h AS (SELECT l_orderkey % 50 AS street_id, l_partkey * 100 + l_suppkey AS node_id, min(l_partkey % 300) AS n, min(l_suppkey / 1e1) AS x, min(l_linenumber / 1e0) AS y FROM lineitem GROUP BY 1, 2)"


def _houses(f):
    return f.table("lineitem").groupBy(F.expr("l_orderkey % 50").alias("street_id"), F.expr("l_partkey * 100 + l_suppkey").alias("node_id")).agg(F.expr("cast(min(l_partkey % 300) as string)").alias("number"), F.expr("min(l_suppkey / 1e1)").alias("x"), F.expr("min(l_linenumber / 1e0)").alias("y"))


@query(f"""WITH {_STREET_HOUSES}, a AS (SELECT DISTINCT street_id, street_id * 5 AS w FROM h),
e AS (SELECT a.street_id, a.w, arg_min({{'x': x, 'y': y}}, node_id) AS p FROM a JOIN h ON h.street_id = a.street_id AND n = w GROUP BY ALL),
lo AS (SELECT * FROM (SELECT a.street_id, n, x, y, row_number() OVER (PARTITION BY a.street_id ORDER BY n DESC, node_id) AS r FROM a JOIN h ON h.street_id = a.street_id AND n < w) WHERE r = 1),
up AS (SELECT * FROM (SELECT a.street_id, n, x, y, row_number() OVER (PARTITION BY a.street_id ORDER BY n, node_id) AS r FROM a JOIN h ON h.street_id = a.street_id AND n > w) WHERE r = 1)
SELECT a.street_id, CASE WHEN p IS NOT NULL THEN 'exact' WHEN lo.n IS NOT NULL AND up.n IS NOT NULL THEN 'interpolated' ELSE 'absent' END AS kind,
CAST(round((CASE WHEN p IS NOT NULL THEN p.x ELSE lo.x + (up.x-lo.x)*((a.w-lo.n)/(1e0*(up.n-lo.n))) END)*1e6) AS BIGINT) AS x,
CAST(round((CASE WHEN p IS NOT NULL THEN p.y ELSE lo.y + (up.y-lo.y)*((a.w-lo.n)/(1e0*(up.n-lo.n))) END)*1e6) AS BIGINT) AS y
FROM a LEFT JOIN e USING (street_id) LEFT JOIN lo USING (street_id) LEFT JOIN up USING (street_id)""")
def house_number_interpolated(f):
    h = _houses(f)
    asked = h.select("street_id").distinct().select(F.lit(0).alias("query_id"), "street_id", F.expr("cast(street_id * 5 as string)").alias("wanted"))
    return hn.resolve(asked, h).select("street_id", "kind", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))


@query(f"WITH {fx.HN_SQL}, {PTS}, p AS (SELECT a.cid, h.node_id, {_HAV.format(a='a.lat', b='h.lat', c='a.lon', d='h.lon')} AS m FROM pts a JOIN hn h ON a.cid % 20 = h.node_id % 20) SELECT cid, node_id, CAST(round(m) AS BIGINT) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY m, node_id) AS r FROM p WHERE m <= 50) WHERE r = 1")
def closest_house_50m(f):
    h = f.house_nodes().select(F.expr("node_id % 20").alias("street_id"), "node_id", F.col("node_id").alias("number"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    p = f.points().select(F.col("cid").alias("query_id"), F.expr("cid % 20").alias("street_id"), "lon", "lat")
    return hn.closest(p, h).select(F.col("query_id").alias("cid"), F.col("number").alias("node_id"), "metres")


# --- tags, ways, relations ---------------------------------------------------------------------------------------------


def _pred():
    return osm.way_predicates(lambda k: F.col(k))


@query(f"WITH {TAGGED} SELECT way_id FROM tagged WHERE name IS NOT NULL AND place IN ('neighbourhood', 'suburb')")
def way_filters_include(f):
    return f.tagged().where(F.col("name").isNotNull() & osm.level_filter(10, _pred())).select("way_id")


@query(f"WITH {TAGGED} SELECT way_id FROM tagged WHERE name IS NOT NULL AND coalesce(place, '') NOT IN ('neighbourhood', 'suburb') AND coalesce(leisure, '') <> 'park' AND building IS NULL AND waterway IS NULL")
def way_filters_exclude(f):
    return f.tagged().where(F.col("name").isNotNull() & osm.level_filter(12, _pred())).select("way_id")


@query(f"WITH {TAGGED} " + " UNION ALL ".join(f"SELECT '{h}' AS kind, count(*) AS n FROM tagged WHERE highway = '{h}'" for h in osm.HIGHWAYS))
def way_predicate_counts(f):
    p = _pred()
    per = f.tagged().select(F.explode(F.array(*[F.when(p[f"highway_{h}"], F.lit(h)) for h in osm.HIGHWAYS])).alias("kind"))
    return per.where(F.col("kind").isNotNull()).groupBy("kind").agg(F.count("*").alias("n"))


_REFS = "refs AS (SELECT l_orderkey AS way_id, l_partkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem)"


def _ways(f):
    l = f.table("lineitem")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda r: r["l_partkey"])
    return l.groupBy(F.col("l_orderkey").alias("way_id")).agg(refs.alias("refs"))


_DIGEST = "CAST(round(sum((lon*1e3 + lat)*pos)*1e3) AS BIGINT)"


@query(f"WITH {NODES}, {_REFS} SELECT way_id, count(*) AS n, md5(string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos)) AS ids FROM refs JOIN nodes USING (node_id) WHERE node_id % 10 <> 0 GROUP BY way_id")
def way_coords(f):
    nodes = f.nodes().where("node_id % 10 <> 0").select("node_id", F.col("node_id").cast("double").alias("lon"), "lat")
    lines = osm.way_coords(_ways(f), nodes)
    return lines.select("way_id", F.size("line").cast("long").alias("n"), F.md5(F.array_join(F.transform("line", lambda p: p["x"].cast("long").cast("string")), ",").cast("binary")).alias("ids"))


@query(f"WITH {NODES}, {_REFS}, m AS (SELECT o_custkey AS relation_id, o_orderkey AS way_id FROM orders) SELECT relation_id, md5(string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY way_id, pos)) AS ids FROM m JOIN refs USING (way_id) JOIN nodes USING (node_id) GROUP BY relation_id")
def relation_coords(f):
    nodes = f.nodes().select("node_id", F.col("node_id").cast("double").alias("lon"), "lat")
    way = lambda i: F.struct(F.lit("w").alias("type"), i.alias("id"), F.lit("outer").alias("role"))
    members = F.concat(F.array(F.struct(F.lit("n").alias("type"), F.lit(0).cast("long").alias("id"), F.lit("admin_centre").alias("role"))), F.transform(F.array_sort(F.collect_list("o_orderkey")), way))
    rel = f.table("orders").groupBy(F.col("o_custkey").alias("relation_id")).agg(members.alias("members"))
    out = osm.relation_ways(rel, osm.way_coords(_ways(f), nodes))
    return out.select("relation_id", F.md5(F.array_join(F.transform(F.flatten("lines"), lambda p: p["x"].cast("long").cast("string")), ",").cast("binary")).alias("ids"))


@query(f"WITH {TAGGED} SELECT way_id FROM tagged t WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = way_id AND l_linenumber = 1)")
def remaining_ids(f):
    stored = f.table("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("way_id"))
    return osm.pending(f.tagged().where("name IS NOT NULL"), stored, ["way_id"]).select("way_id")


@query("SELECT c_custkey AS relation_id FROM customer WHERE c_custkey % 5 + 6 = 8 AND c_custkey % 4 <> 0")
def relation_candidates(f):
    tags = F.map_filter(F.create_map(F.lit("admin_level"), F.expr("cast(c_custkey % 5 + 6 as string)"), F.lit("name"), F.expr("CASE WHEN c_custkey % 4 <> 0 THEN c_name END")), lambda k, v: v.isNotNull())
    return osm.relation_candidates(f.table("customer").select(F.col("c_custkey").alias("relation_id"), tags.alias("tags")), 8).select("relation_id")


@query(f"WITH {TAGGED} SELECT way_id AS id FROM tagged WHERE place = 'suburb' UNION SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 = 2")
def level10_union(f):
    return f.tagged().where(_pred()["place_suburb"]).select(F.col("way_id").alias("id")).unionByName(f.table("customer").where("c_custkey % 5 = 2").select(F.col("c_custkey").alias("id"))).distinct()


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, json_extract_string(props, '$.k')) AS name, nullif(upper(trim(CASE WHEN event_id % 4 = 0 THEN ' ' ELSE concat(' ', event_type) END)), '') AS code FROM events WHERE coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, json_extract_string(props, '$.k')) IS NOT NULL")
def name_priority(f):
    tags = F.create_map(F.lit("name:pt"), F.expr("CASE WHEN event_id % 3 = 0 THEN event_type END"), F.lit("name"), F.get_json_object("props", "$.k"))
    e = f.table("events").select("event_id", tx.name_by_priority(tags, ["name:pt", "name"]).alias("name"), tx.clean_code(F.expr("CASE WHEN event_id % 4 = 0 THEN ' ' ELSE concat(' ', event_type) END")).alias("code"))
    return e.where(F.col("name").isNotNull())


@query("SELECT s_suppkey AS osm_id, s_suppkey * 2 + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS id FROM supplier")
def pack_ids(f):
    return f.table("supplier").select(F.col("s_suppkey").alias("osm_id"), tx.pack_id(F.col("s_suppkey"), F.expr("s_suppkey % 3 = 0")).alias("id"))


@query("SELECT event_id, CAST(count(*) AS INTEGER) AS n FROM (SELECT event_id, unnest(['a', 'b', 'source']) AS k FROM events) WHERE k NOT IN ('source') GROUP BY event_id")
def map_tag_filter(f):
    m = F.create_map(*[F.lit(x) for x in ("a", "1", "b", "2", "source", "x")])
    return f.table("events").select("event_id", F.size(F.map_filter(m, lambda k, v: ~k.isin("source"))).alias("n"))


@query("SELECT event_id, CAST(sum(CAST(round(value*1e2) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM events")
def delta_decode(f):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return f.table("events").select("event_id", F.sum(F.round(F.col("value") * 1e2).cast("long")).over(w).alias("v"))


_MERGE = "a AS (SELECT c_custkey AS id, 8 AS level, c_name AS name FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS id, 10 AS level, c_mktsegment AS name FROM customer WHERE c_custkey % 3 = 0)"


def _sides(f):
    c = f.table("customer")
    return c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "8 AS level", "c_name AS name"), c.where("c_custkey % 3 = 0").selectExpr("c_custkey AS id", "10 AS level", "c_mktsegment AS name")


@query(f"WITH {_MERGE} SELECT coalesce(a.id, b.id) AS id, coalesce(a.level, b.level) AS level, coalesce(b.name, a.name) AS name FROM a FULL JOIN b ON a.id = b.id")
def upsert_merge(f):
    return hi.last_wins(*_sides(f), keep_first=["level"])


@query(f"WITH {_MERGE} SELECT coalesce(a.id, b.id) AS id, coalesce(a.level, b.level) AS level, coalesce(a.name, b.name) AS name FROM a FULL JOIN b ON a.id = b.id")
def insert_or_ignore(f):
    return hi.first_wins(*_sides(f), key="id")


@query("SELECT o_orderpriority AS file, count(*) AS files, CAST(sum(coalesce(c, 0)) AS BIGINT) AS houses FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def counts_per_file(f):
    c = f.table("lineitem").where("l_linenumber = 2").groupBy("l_orderkey").agg(F.count("*").alias("c"))
    return f.table("orders").join(c, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_orderpriority").alias("file")).agg(F.count("*").alias("files"), F.sum(F.coalesce("c", F.lit(0))).alias("houses"))


@query(f"WITH {TAGGED} SELECT min(way_id) AS lo, max(way_id) AS hi, count(*) AS n FROM tagged WHERE name IS NOT NULL")
def id_range(f):
    return f.tagged().where("name IS NOT NULL").agg(F.min("way_id").alias("lo"), F.max("way_id").alias("hi"), F.count("*").alias("n"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 5000 ORDER BY 1 LIMIT 500")
def keyset_page(f):
    return f.table("orders").where("o_orderkey > 100 AND o_orderkey <= 5000").select(F.col("o_orderkey").alias("id")).orderBy("id").limit(500)


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def lookup_semi_join(f):
    return f.table("orders").join(f.table("lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_access(f):
    return f.table("events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events")
def epoch_stamp(f):
    return f.table("events").select("event_id", F.unix_timestamp("ts").alias("at"))


# --- text --------------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') AS toks FROM documents")
def tokens_lower(f):
    return f.table("documents").select("doc_id", F.array_join(tx.tokens_lower(F.col("text")), " ").alias("toks"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+'), ' ') AS toks FROM documents")
def tokens_strict(f):
    return f.table("documents").select("doc_id", F.array_join(tx.tokens_strict(F.col("text")), " ").alias("toks"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{L}\p{N}]+'), ' ') AS toks FROM documents")
def tokens_folded(f):
    return f.table("documents").select("doc_id", F.array_join(tx.tokens_folded(F.col("text")), " ").alias("toks"))


_PC = "CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat(p_size, '-', p_partkey % 1000) ELSE concat('', p_partkey) END"


@query(f"SELECT p_partkey AS id, concat_ws(' ', p_name, pc, CASE WHEN regexp_replace(pc, '[^0-9]', '', 'g') <> pc THEN regexp_replace(pc, '[^0-9]', '', 'g') END) AS t FROM (SELECT *, {_PC} AS pc FROM part)")
def entity_text(f):
    return f.table("part").select(F.col("p_partkey").alias("id"), tx.entity_text(F.col("p_name"), F.expr(_PC)).alias("t"))


_AB = [("small", "sm"), ("ring", "rg")]


@query("SELECT p_partkey AS id, concat_ws(' ', p_name, " + ", ".join(f"CASE WHEN contains(lower(p_name), '{a}') THEN replace(lower(p_name), '{a}', '{b}') WHEN contains(lower(p_name), '{b}') THEN replace(lower(p_name), '{b}', '{a}') END" for a, b in _AB) + ") AS t FROM part")
def abbrev_expand(f):
    return f.table("part").select(F.col("p_partkey").alias("id"), tx.expand_abbreviations(F.col("p_name"), _AB).alias("t"))


_QS = [(0, "small ring"), (1, "ring small"), (2, "SMALL Ring"), (3, "rnig small"), (4, "small zzzz"), (5, "25")]
_DOCS = "docs AS (SELECT p_partkey AS id, p_name AS name, concat(p_brand, ' ', p_type) AS hier FROM part)"


def _index(f):
    return ti.TextIndex.build(f.table("part").selectExpr("p_partkey AS id", "p_name AS name", "concat(p_brand, ' ', p_type) AS hier"))


def _asked(f, keep=None):
    return f.spark.createDataFrame([q for q in _QS if keep is None or q[0] in keep], "query_id int, text string")


_RX = {"folded": "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')", "lower": "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')", "strict": "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+')"}
_QV = "q(query_id, text) AS (VALUES " + ", ".join(f"({a}, '{b}')" for a, b in _QS) + ")"
_POST = ",\n".join(
    f"d_{n} AS (SELECT '{n}' AS form, '{f}' AS field, id AS doc, {_RX[n].format(f)} AS w FROM docs)".replace(f"d_{n} ", f"d_{n}_{f} ") for n in _RX for f in ("name", "hier")
)
_CORE = f"""{_DOCS}, {_QV}, {_POST},
alld AS ({' UNION ALL '.join(f'SELECT * FROM d_{n}_{f}' for n in _RX for f in ('name', 'hier'))}),
st AS (SELECT form, field, count(*) AS n, avg(len(w)) AS av FROM alld GROUP BY ALL),
sp AS (SELECT form, field, doc, len(w) AS l, unnest(w) AS term, unnest(range(len(w))) AS pos FROM alld),
po AS (SELECT form, field, doc, l, term, count(*) AS tf FROM sp GROUP BY ALL),
te AS (SELECT form, field, term, count(*) AS df FROM po GROUP BY ALL),
qt AS (SELECT query_id, form, unnest(w) AS term, unnest(range(len(w))) AS qpos, len(w) AS nt FROM ({' UNION ALL '.join(f"SELECT query_id, '{n}' AS form, {_RX[n].format('text')} AS w FROM q" for n in _RX)})),
hit AS (SELECT query_id, doc, qt.form, po.field, qpos, nt, ln(1 + (n - df + 0.5e0)/(df + 0.5e0)) AS idf, 2.2e0*tf/(tf + 1.2e0*(0.25e0 + 0.75e0*l/av)) AS tfn FROM qt JOIN po ON po.form = qt.form AND po.term = qt.term JOIN te ON te.form = po.form AND te.field = po.field AND te.term = po.term JOIN st ON st.form = po.form AND st.field = po.field),
ex AS (SELECT query_id, doc, sum(CASE field WHEN 'name' THEN 5e0 ELSE 2e0 END*idf*tfn) AS s, count(DISTINCT qpos) AS c, max(nt) AS nt FROM hit WHERE form = 'folded' GROUP BY ALL),
wh AS (SELECT query_id, doc, s FROM ex WHERE c = nt),
ph AS (SELECT query_id, sp.field, sp.doc, pos - qpos AS st0, count(*) AS c, max(nt) AS nt, max(l) AS l, sum(ln(1 + (n - df + 0.5e0)/(df + 0.5e0))) AS idf, max(av) AS av FROM qt JOIN sp ON sp.form = 'folded' AND qt.form = 'folded' AND sp.term = qt.term JOIN te ON te.form = 'folded' AND te.field = sp.field AND te.term = sp.term JOIN st ON st.form = 'folded' AND st.field = sp.field WHERE nt >= 2 GROUP BY ALL),
pf AS (SELECT query_id, doc, field, count(*) AS tf, max(idf) AS idf, max(l) AS l, max(av) AS av FROM ph WHERE c = nt GROUP BY ALL),
pb AS (SELECT query_id, doc, CASE field WHEN 'name' THEN 10e0 ELSE 4e0 END*idf*2.2e0*tf/(tf + 1.2e0*(0.25e0 + 0.75e0*l/av)) AS s FROM pf),
bo AS (SELECT query_id, doc, CASE WHEN form = 'strict' THEN CASE field WHEN 'name' THEN 3e0 ELSE 1.2e0 END ELSE CASE field WHEN 'name' THEN 2e0 ELSE 0.8e0 END END*idf*tfn AS s FROM hit WHERE form <> 'folded'),
su AS (SELECT query_id, doc, sum(s) AS score FROM (SELECT * FROM wh UNION ALL SELECT pb.* FROM pb SEMI JOIN wh USING (query_id, doc) UNION ALL SELECT bo.* FROM bo SEMI JOIN wh USING (query_id, doc)) GROUP BY ALL),
fz AS (SELECT DISTINCT query_id, doc, po.field, qpos FROM qt JOIN po ON qt.form = 'folded' AND po.form = 'folded' AND damerau_levenshtein(qt.term, po.term) <= CASE WHEN length(qt.term) < 4 THEN 1 ELSE 2 END),
lo AS (SELECT query_id, doc, sum(s) AS score FROM (SELECT query_id, doc, CASE field WHEN 'name' THEN 5e0 ELSE 2e0 END*idf*tfn AS s FROM hit WHERE form = 'folded' UNION ALL SELECT query_id, doc, CASE field WHEN 'name' THEN 1.5e0 ELSE 0.5e0 END FROM fz) GROUP BY ALL)"""
_OUT = "CAST(query_id AS INTEGER) AS query_id, doc, CAST(round(score*1e4) AS BIGINT) AS score"


def _s4():
    return F.round(F.col("score") * F.lit(1e4)).cast("long").alias("score")




@query(f"WITH {_CORE} SELECT CAST(query_id AS INTEGER) AS query_id, doc, CAST(round(s*1e4) AS BIGINT) AS score FROM wh")
def bm25_strict_all(f):
    return ti.clause_scores(_index(f), _asked(f)).where("found = tokens").select("query_id", "doc", F.col("exact").alias("score")).select("query_id", "doc", _s4())


@query(f"WITH {_CORE} SELECT {_OUT} FROM su")
def bm25_with_bonuses(f):
    return ti.strict_scores(_index(f), _asked(f)).select("query_id", "doc", _s4())


@query(f"WITH {_CORE} SELECT {_OUT} FROM lo")
def fuzzy_loose(f):
    return ti.loose_scores(_index(f), _asked(f)).select("query_id", "doc", _s4())


@query(f"WITH {_CORE}, f AS (SELECT * FROM su UNION ALL SELECT * FROM lo WHERE query_id NOT IN (SELECT query_id FROM su)) SELECT query_id, count(*) AS n, CAST(round(max(score)*1e4) AS BIGINT) AS best FROM f GROUP BY query_id")
def strict_else_loose(f):
    return ti.search(_index(f), _asked(f), top=1 << 30).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score") * 1e4).cast("long").alias("best"))


_FOUND = "f AS (SELECT * FROM su UNION ALL SELECT * FROM lo WHERE query_id NOT IN (SELECT query_id FROM su))"
_INSIDE = "lon BETWEEN -4.62e1 AND -4.58e1 AND lat BETWEEN -2.38e1 AND -2.33e1"
#: The core with documents restricted before strict or loose is chosen.
_WITHIN = """ws AS (SELECT su.* FROM su SEMI JOIN ok USING (doc)), wf AS (SELECT * FROM ws UNION ALL SELECT lo.* FROM lo SEMI JOIN ok USING (doc) WHERE query_id NOT IN (SELECT query_id FROM ws)),
 cut AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score*1e9) DESC, doc) AS INTEGER) AS rank FROM wf)"""


def _ranked(hits):
    return hits.select("query_id", "doc", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {_CORE}, {NODES}, ok AS (SELECT node_id AS doc FROM nodes WHERE {_INSIDE}), {_WITHIN} SELECT CAST(query_id AS INTEGER) AS query_id, count(*) AS n, CAST(round(max(score)*1e4) AS BIGINT) AS best, CAST(round(min(score)*1e4) AS BIGINT) AS worst FROM cut WHERE rank <= 50 GROUP BY query_id")
def spatial_first_text(f):
    """All queries in a region: its documents are found first, so the cut at 50 loses none of them to others."""
    boxes = f.nodes().select(F.col("node_id").alias("doc"), F.col("lon").alias("minx"), F.col("lat").alias("miny"), F.col("lon").alias("maxx"), F.col("lat").alias("maxy"))
    allowed = sp.within_envelope(boxes, (-46.2, -23.8, -45.8, -23.3)).select("doc")
    return _scored(ti.search(_index(f), _asked(f), allowed=allowed))


def _scored(hits):
    micros = lambda c: F.round(c * 1e4).cast("long")
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), micros(F.max("score")).alias("best"), micros(F.min("score")).alias("worst"))


@query(f"WITH {_CORE}, ok AS (SELECT p_partkey AS doc FROM part WHERE p_size % 4 = 1), {_WITHIN} SELECT CAST(query_id AS INTEGER) AS query_id, count(*) AS n, CAST(round(max(score)*1e4) AS BIGINT) AS best, CAST(round(min(score)*1e4) AS BIGINT) AS worst FROM cut WHERE rank <= 20 GROUP BY query_id")
def level_filter_prerank(f):
    """Only documents of one level are ranked and cut."""
    docs = f.table("part").selectExpr("p_partkey AS id", "p_size % 4 AS level")
    tables = qy.Tables(None, None, None, None, None, docs)
    return _scored(ti.search(_index(f), _asked(f), allowed=qy.allowed_docs(tables, qy.Filters(levels=(1,))), top=20))


@query(f"WITH {_CORE} SELECT CAST(query_id AS INTEGER) AS query_id, doc, field, CAST(qpos AS INTEGER) AS qpos, CAST(round(CASE field WHEN 'name' THEN 5e0 ELSE 2e0 END*idf*tfn*1e4) AS BIGINT) AS score FROM hit WHERE form = 'folded'")
def bm25_term(f):
    return ti.term_scores(_index(f), _asked(f)).select("query_id", "doc", "field", "qpos", _s4())


@query(f"WITH {_CORE} SELECT CAST(query_id AS INTEGER) AS query_id, doc, CAST(round(sum(s)*1e4) AS BIGINT) AS score FROM pb GROUP BY ALL")
def bm25_phrase(f):
    return ti.clause_scores(_index(f), _asked(f)).where("phrase > 0").select("query_id", "doc", F.col("phrase").alias("score")).select("query_id", "doc", _s4())


@query(f"WITH {_CORE} SELECT CAST(query_id AS INTEGER) AS query_id, doc, CAST(round(sum(s)*1e4) AS BIGINT) AS score FROM bo GROUP BY ALL")
def bm25_case_bonus(f):
    return ti.clause_scores(_index(f), _asked(f)).where("letters > 0").select("query_id", "doc", F.col("letters").alias("score")).select("query_id", "doc", _s4())


@query(f"WITH {_CORE.replace(_QV, 'q AS (SELECT min(p_partkey) AS query_id, p_name AS text FROM part GROUP BY p_name)')} SELECT CAST(query_id AS BIGINT) AS query_id, count(*) AS n, CAST(round(max(score)*1e4) AS BIGINT) AS best FROM su GROUP BY query_id")
def bm25_every_name(f):
    """Every different name asked for: how many documents hold all its words, and the best score."""
    asked = f.table("part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("query_id"))
    return ti.strict_scores(_index(f), asked).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score") * 1e4).cast("long").alias("best"))


@query(r"SELECT p_partkey AS id, CAST(round(1e6*len(list_filter(['small','ring','small'], lambda t: list_contains(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), t)))/3e0) AS BIGINT) AS coverage FROM part")
def token_coverage(f):
    return f.table("part").select(F.col("p_partkey").alias("id"), micro(tx.token_coverage(F.array(*map(F.lit, ("small", "ring", "small"))), tx.tokens_folded(F.col("p_name")))).alias("coverage"))


@query(r"SELECT p_partkey AS id, t, regexp_full_match(t, '[0-9]{1,5}[A-Za-z]?,?') AS shaped FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(p_partkey, ',') WHEN 1 THEN concat(p_partkey, 'b') WHEN 2 THEN concat(p_partkey, '00') ELSE 'Rua' END AS t FROM part)")
def house_token_shape(f):
    t = f.table("part").selectExpr("p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN concat(p_partkey, ',') WHEN 1 THEN concat(p_partkey, 'b') WHEN 2 THEN concat(p_partkey, '00') ELSE 'Rua' END AS t")
    return t.select("id", "t", tx.house_token(F.col("t")).isNotNull().alias("shaped"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 AND p_size = p_partkey % 50 THEN concat('', p_partkey % 900, 'a') WHEN p_size = p_partkey % 50 THEN concat('', p_partkey % 900, 'a') ELSE concat('', p_partkey % 50) END AS number FROM part")
def first_house_token(f):
    p = f.table("part").selectExpr("p_partkey AS id", "concat('Rua ', p_size) AS street", "concat('rua ', p_partkey % 50, ', ', p_partkey % 900, 'a') AS q")
    return p.select("id", tx.first_house_number(F.col("q"), F.col("street")).alias("number"))


@query("SELECT n_nationkey AS id, concat_ws(', ', n_name, CASE WHEN n_nationkey % 2 = 0 THEN concat('', n_nationkey) END, concat('city', n_regionkey), r_name) AS name FROM nation JOIN region ON r_regionkey = n_regionkey")
def friendly_name_default(f):
    n = f.table("nation").join(f.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    level = lambda k, c: F.struct(F.lit(k).alias("level"), c.alias("name"))
    levels = F.array(level(2, F.col("r_name")), level(12, F.col("n_name")), level(8, F.expr("concat('city', n_regionkey)")), level(30, F.expr("CASE WHEN n_nationkey % 2 = 0 THEN concat('', n_nationkey) END")))
    return n.select(F.col("n_nationkey").alias("id"), tx.default_friendly_name(F.filter(levels, lambda x: x["name"].isNotNull())).alias("name"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN concat(n_name, ' no ', n_nationkey, ', ', r_name) ELSE concat(n_name, ' no ', r_name) END AS name FROM nation JOIN region ON r_regionkey = n_regionkey")
def friendly_name_template(f):
    n = f.table("nation").join(f.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    names = F.create_map(F.lit(12), F.col("n_name"), F.lit(2), F.col("r_name"))
    number = F.expr("CASE WHEN n_nationkey % 2 = 0 THEN concat('', n_nationkey) END")
    return n.select(F.col("n_nationkey").alias("id"), tx.render_template("{admin_level_12_name} no {house_number}, {admin_level_2_name}", names, number).alias("name"))


# --- shapes ------------------------------------------------------------------------------------------------------------


def _square(f):
    return f.bounds().select("id", _box_ring().alias("ring"))


@query(f"WITH {fx.BOUNDS_SQL} SELECT id, CAST(round((maxx-minx)*(maxy-miny)*1e6) AS BIGINT) AS area, CAST(-round((maxx-minx)*(maxy-miny)*1e6) AS BIGINT) AS turned FROM bounds")
def ring_area_winding(f):
    s = _square(f)
    return s.select("id", micro(F.abs(geo.twice_area(F.col("ring"))) / 2).alias("area"), micro(geo.twice_area(geo.clockwise(F.col("ring"))) / 2).alias("turned"))


@query(f"WITH {fx.BOUNDS_SQL} SELECT id, CAST(round(2e0*((maxx-minx)+(maxy-miny))*1e6) AS BIGINT) AS length, CAST(round(minx*1e6) AS BIGINT) AS minx, CAST(round(maxy*1e6) AS BIGINT) AS maxy FROM bounds")
def polyline_length_bbox(f):
    box = geo.bbox(F.col("ring"))
    return _square(f).select("id", micro(geo.line_length(F.col("ring"))).alias("length"), micro(box["minx"]).alias("minx"), micro(box["maxy"]).alias("maxy"))


@query(f"WITH {STREETS}, {PTS}, n AS ({_SEG}) SELECT cid, id, CAST(round(qx*1e6) AS BIGINT) AS x, CAST(round(qy*1e6) AS BIGINT) AS y FROM n WHERE {_WINDOW}")
def closest_point_on_line(f):
    line = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    near = sp.nearby_segments(f.points(), f.streets()).withColumn("n", geo.closest_on_line(line, F.col("lon"), F.col("lat")))
    near = near.select(*sp.PLACE, *sp.SEGMENT, micro(F.col("n.x")).alias("x"), micro(F.col("n.y")).alias("y"))
    return sp.shared(f.points(), f.streets(), near).select("cid", "id", "x", "y")


_BOX_VALUES = "minx, miny, maxx, maxy"
_XY = "CAST(round({}*1e6) AS BIGINT)"


def _pt(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def _ell():
    """The box without its upper right quarter, as a closed ring."""
    c, mx, my = F.col, (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    return F.array(_pt(c("minx"), c("miny")), _pt(c("maxx"), c("miny")), _pt(c("maxx"), my), _pt(mx, my), _pt(mx, c("maxy")), _pt(c("minx"), c("maxy")), _pt(c("minx"), c("miny")))


@query(f"WITH {fx.BOUNDS_SQL} SELECT id, 'MultiPolygon' AS kind, 1 AS rings, 5 AS points, {_XY.format('-2e0*(maxx-minx)*(maxy-miny)')} AS turned FROM bounds")
def assemble_rings(f):
    """Boxes cut into three ways, the second reversed, put together again: one clockwise ring of five points each."""
    c = F.col
    a, b, d, e = _pt(c("minx"), c("miny")), _pt(c("maxx"), c("miny")), _pt(c("maxx"), c("maxy")), _pt(c("minx"), c("maxy"))
    ways = F.array(F.array(a, b), F.array(e, d, b), F.array(e, a))
    whole = osm.relation_geometry(f.bounds().select(F.col("id").cast("long").alias("relation_id"), ways.alias("lines")))
    return whole.select(F.col("relation_id").cast("int").alias("id"), "kind", F.size("lines").alias("rings"), F.size(F.col("lines")[0]).alias("points"), micro(geo.twice_area(F.col("lines")[0])).alias("turned"))


_W, _H = "(maxx-minx)", "(maxy-miny)"


@query(f"""WITH {fx.BOUNDS_SQL}, {STREETS} SELECT id, {_XY.format(f'75e-2*{_W}*{_H}')} AS area, {_XY.format(f'((minx+{_W}/2e0)*5e-1+(minx+{_W}/4e0)*25e-2)/75e-2')} AS x, {_XY.format(f'((miny+{_H}/4e0)*5e-1+(miny+3e0*{_H}/4e0)*25e-2)/75e-2')} AS y FROM bounds
UNION ALL SELECT id + 1000, 0, {_XY.format('(x1+x2)/2e0')}, {_XY.format('(y1+y2)/2e0')} FROM streets""")
def ring_area_centroid(f):
    """Area and centroid of areas that are no boxes, by area, and of streets, by length."""
    areas = f.bounds().select(F.col("id").cast("long").alias("id"), F.struct(F.lit(shapes.POLYGON).alias("kind"), F.array(F.array(_ell())).alias("parts")).alias("g"))
    lines = f.streets().select((F.col("id") + 1000).alias("id"), shapes.of_lines(shapes.LINE, F.array(F.array(_pt(F.col("x1"), F.col("y1")), _pt(F.col("x2"), F.col("y2"))))).alias("g"))
    c = shapes.centroid(F.col("g"))
    return areas.unionByName(lines).select("id", micro(shapes.area(F.col("g"))).alias("area"), micro(c["x"]).alias("x"), micro(c["y"]).alias("y"))


@query(f"WITH {fx.BOUNDS_SQL} SELECT id, {_XY.format('(minx+maxx)/2e0')} AS x, {_XY.format('(miny+maxy)/2e0')} AS y, 2 AS lines, 1 AS parts FROM bounds")
def box_centre_and_parts(f):
    """Centre of the box; a polygon with a hole as two lines, and as one part."""
    hole = F.array(*[_pt((F.col("minx") + F.col("maxx")) / 2 + dx, (F.col("miny") + F.col("maxy")) / 2 + dy) for dx, dy in ((0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.0))])
    g = F.struct(F.lit(shapes.POLYGON).alias("kind"), F.array(F.array(_box_ring(), hole)).alias("parts"))
    c = shapes.box_centre(shapes.box(F.col("g")))
    return f.bounds().withColumn("g", g).select("id", micro(c["x"]).alias("x"), micro(c["y"]).alias("y"), F.size(shapes.lines(F.col("g"))).alias("lines"), F.size(shapes.polygons(F.col("g"))).alias("parts"))


_N = "regexp_replace(CAST(CAST({} AS DECIMAL(20,9)) AS VARCHAR), '\\.?0+$', '')"
_XY_TEXT = lambda x, y: f"{_N.format(x)} || ' ' || {_N.format(y)}"


@query(f"WITH {fx.BOUNDS_SQL} SELECT id, 'POLYGON((' || {_XY_TEXT('minx', 'miny')} || ',' || {_XY_TEXT('maxx', 'miny')} || ',' || {_XY_TEXT('maxx', 'maxy')} || ',' || {_XY_TEXT('minx', 'maxy')} || ',' || {_XY_TEXT('minx', 'miny')} || '))' AS wkt FROM bounds")
def wkt_text(f):
    """Shapes through the binary codec and out as text."""
    b = f.bounds().select("id", F.lit(shapes.POLYGON).alias("kind"), F.array(F.array(_box_ring())).alias("parts"))
    return b.select("id", shapes.wkt(shapes.from_blob(shapes.to_blob(F.col("kind"), F.col("parts")))).alias("wkt"))


_D2 = "((lon-(x1+t*(x2-x1)))*(lon-(x1+t*(x2-x1)))+(lat-(y1+t*(y2-y1)))*(lat-(y1+t*(y2-y1))))"


@query(f"""WITH {STREETS}, {PTS}, pairs AS (SELECT id, x1, y1, x2, y2, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2 FROM streets UNION ALL SELECT id, x1, y1 + 1e-2, x2, y2 + 1e-2, x1, y1, x2, y2 FROM streets),
d AS (SELECT cid, id, sqrt({_D2}) AS d FROM (SELECT *, {_T} AS t FROM pts, pairs WHERE least(bx1,bx2) <= lon+1e-1 AND greatest(bx1,bx2) >= lon-1e-1 AND least(by1,by2) <= lat+1e-1 AND greatest(by1,by2) >= lat-1e-1))
SELECT cid, id, {_XY.format('min(d)')} AS dist FROM d GROUP BY ALL""")
def point_line_distance(f):
    """Planar distance from each point to the streets around it, each street a pair of parallel lines."""
    line = lambda dy: F.array(_pt(F.col("x1"), F.col("y1") + F.lit(dy)), _pt(F.col("x2"), F.col("y2") + F.lit(dy)))
    near = sp.nearby_segments(f.points(), f.streets()).withColumn("lines", F.array(line(0.0), line(0.01)))
    near = near.select(*sp.PLACE, *sp.SEGMENT, micro(shapes.distance_to_lines(F.col("lines"), F.col("lon"), F.col("lat"))).alias("dist"))
    return sp.shared(f.points(), f.streets(), near).select("cid", "id", "dist")


_HOLED = "POLYGON((-46.3 -23.9,-46.0 -23.9,-46.0 -23.4,-46.3 -23.4,-46.3 -23.9),(-46.2 -23.8,-46.1 -23.8,-46.1 -23.6,-46.2 -23.6,-46.2 -23.8))"


@query(f"WITH {PTS} SELECT cid FROM pts WHERE lon > -4.63e1 AND lon < -4.60e1 AND lat > -2.39e1 AND lat < -2.34e1 AND NOT (lon BETWEEN -4.62e1 AND -4.61e1 AND lat BETWEEN -2.38e1 AND -2.36e1)")
def strict_containment(f):
    """Points inside a region with a hole, none on its boundaries."""
    return f.points().where(shapes.strictly_in_polygons(F.col("lon"), F.col("lat"), shapes.literal(shapes.parse_region(_HOLED)))).select("cid")


_RINGS = """rp AS (SELECT e.id, b.id + 1000000 AS pid, row_number() OVER (PARTITION BY e.id ORDER BY b.level DESC, b.area, b.id) AS r FROM e JOIN (SELECT *, CASE level WHEN 4 THEN 75e-2 * area0 ELSE area0 END AS area FROM (SELECT * EXCLUDE (area), area AS area0 FROM b)) b
 ON lon >= minx AND lon < maxx AND lat >= miny AND lat < maxy AND NOT (b.level = 4 AND lon >= (minx+maxx)/2 AND lat >= (miny+maxy)/2) AND b.id + 1000000 <> e.id AND b.level < e.level)"""


@query(f"WITH {_B}, {_E}, {_RINGS} SELECT id, CAST(pid AS BIGINT) AS parent_id FROM rp WHERE r = 1 AND id < 1000000")
def hierarchy_parent_rings(f):
    """Streets' parents where the nations are no boxes."""
    areas, b = _areas(f)
    ells = b.withColumn("polygons", F.when(F.col("level") == 4, F.array(F.array(_ell()))).otherwise(F.col("polygons"))).withColumn("area", F.when(F.col("level") == 4, F.col("area") * 0.75).otherwise(F.col("area")))
    return hi.parents(areas.where("id < 1000000"), ells)


# --- stored tables -----------------------------------------------------------------------------------------------------


@query(f"WITH {STREETS} SELECT id FROM streets WHERE id NOT IN (SELECT n_nationkey * 4 FROM nation)")
def pending_streets(f):
    """Streets without a place in the hierarchy."""
    placed = f.table("nation").select((F.col("n_nationkey").cast("long") * 4).alias("id"))
    return osm.pending(f.streets(), placed, ["id"]).select("id")


_CHUNK = "SELECT o_custkey AS file_id, o_orderkey * 100 AS first_byte, {} AS chunk_size, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS TINYINT) AS chunk_type FROM orders WHERE o_orderkey % {} = 0"


@query(f"""WITH s AS ({_CHUNK.format(10, 2)}), n AS ({_CHUNK.format(20, 3)}), c AS (SELECT coalesce(s.file_id, n.file_id) AS file_id, coalesce(s.first_byte, n.first_byte) AS first_byte, coalesce(n.chunk_size, s.chunk_size) AS chunk_size, coalesce(s.chunk_type, n.chunk_type) AS chunk_type FROM s FULL JOIN n ON s.file_id = n.file_id AND s.first_byte = n.first_byte)
SELECT file_id, count(*) AS n, CAST(sum(chunk_size) AS BIGINT) AS size, min(CASE WHEN chunk_type = 0 THEN first_byte END) AS header FROM c GROUP BY file_id""")
def chunk_lookup(f):
    """Blobs put in twice, the last winning: each file's number, size and first header."""
    make = lambda size, n: f.table("orders").where(f"o_orderkey % {n} = 0").selectExpr("o_custkey AS file_id", "o_orderkey * 100 AS first_byte", f"{size}L AS chunk_size", "cast(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS tinyint) AS chunk_type")
    c = catalog.chunks_upserted(make(10, 2), make(20, 3))
    return c.groupBy("file_id").agg(F.count("*").alias("n"), F.sum("chunk_size").alias("size"), F.min(F.when(F.col("chunk_type") == 0, F.col("first_byte"))).alias("header"))


_INPUTS = ["Brazil", "sul", "sudeste-latest", "centro-oeste", "brazil-south", "PERU", "my peru extract", "portugal", "netherlands/utrecht", "atlantis", "default", "switzerland", "guyana-suriname"]
_NAMED = [n for n in presets.LEVELS if n != "default"]


@query(
    "WITH i(input) AS (VALUES " + ", ".join(f"('{x}')" for x in _INPUTS) + "), p(pos, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMED)) + "), "
    "x(name, id) AS (SELECT name, name FROM p UNION ALL VALUES " + ", ".join(f"('{v}', '{k}')" for k, v in presets.ALSO.items()) + ") "
    "SELECT input, coalesce((SELECT x.name FROM x WHERE x.id = lower(input)), (SELECT arg_min(p.name, p.pos) FROM p WHERE contains(lower(input), p.name)), 'default') AS preset FROM i"
)
def preset_resolution(f):
    return f.spark.createDataFrame([(x, presets.resolve(x).name) for x in _INPUTS], "input string, preset string")


@query("SELECT event_id, json_extract_string(props, '$.k') AS name FROM events WHERE event_id % 3 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL")
def name_priority_null_drop(f):
    """Areas have the tag name, but where the priority names another tag only, those without it go."""
    tags = F.create_map(F.lit("name"), F.col("event_type"), F.lit("name:pt"), F.when(F.col("event_id") % 3 != 0, F.get_json_object("props", "$.k")))
    preset = presets.Preset("one", (12,), ("name:pt",), (), ())
    return ar._named(f.table("events").withColumn("tags", tags), preset).select("event_id", "name")


@query(f"WITH {fx.BOUNDS_SQL}, {STREETS} SELECT level, count(*) AS n FROM (SELECT level FROM bounds UNION ALL SELECT 12 FROM streets) GROUP BY level")
def level_counts_with_geometry(f):
    """Areas with coordinates by level: those below streets, and streets."""
    return ar.boxes(_area_table(f)).groupBy(F.col("admin_level").alias("level")).agg(F.count("*").alias("n"))


def _area_table(f):
    """Streets and boxes as areas: nations have post codes, regions country codes."""
    line = F.array(_pt(F.col("x1"), F.col("y1")), _pt(F.col("x2"), F.col("y2")))
    none = lambda t: F.lit(None).cast(t)
    streets = f.streets().select(F.col("id"), none("long").alias("relation_id"), F.col("id").alias("way_id"), F.lit(12).alias("admin_level"), "name", none("string").alias("country_iso_code"), F.when(F.col("id") % 6 == 0, F.concat(F.lit("S"), F.col("id"))).alias("post_code"), shapes.of_lines(shapes.LINE, F.array(line)).alias("geom"))
    b = f.bounds()
    box = F.struct(F.lit(shapes.POLYGON).alias("kind"), F.array(F.array(_box_ring())).alias("parts"))
    areas = b.select((F.col("id").cast("long") + 1000000).alias("id"), F.col("id").cast("long").alias("relation_id"), none("long").alias("way_id"), F.col("level").alias("admin_level"), "name", F.when(F.col("level") == 2, F.upper(F.substring("name", 1, 2))).alias("country_iso_code"), F.when((F.col("level") == 4) & (F.col("id") % 4 == 1), F.concat(F.lit("N"), F.col("id"))).alias("post_code"), box.alias("geom"))
    return streets.unionByName(areas)


_FACTS = """f AS (SELECT id, name, CAST(NULL AS VARCHAR) AS iso, CASE WHEN id % 6 = 0 THEN 'S' || id END AS pc, 12 AS level FROM streets UNION ALL SELECT id + 1000000, name, CASE level WHEN 2 THEN upper(name[1:2]) END, CASE WHEN level = 4 AND id % 4 = 1 THEN 'N' || id END, level FROM b)"""
_UP = "up(id, anc, pos) AS (SELECT id, parent_id, 1 FROM parent UNION ALL SELECT up.id, parent.parent_id, pos + 1 FROM up JOIN parent ON parent.id = up.anc)"
_TEXT = "concat_ws(' ', name, pc, CASE WHEN regexp_replace(pc, '[^0-9]', '', 'g') NOT IN (pc, '') THEN regexp_replace(pc, '[^0-9]', '', 'g') END)"


@query(f"WITH RECURSIVE {_B}, {_E}, {_P}, {_UP}, {_FACTS}, h AS (SELECT up.id, string_agg({_TEXT}, ' ' ORDER BY pos) AS hier FROM up JOIN f ON f.id = up.anc GROUP BY up.id) SELECT f.id, f.level, {_TEXT} AS name, coalesce(hier, '') AS hier FROM f LEFT JOIN h ON h.id = f.id")
def doc_assembly(f):
    """The text index's documents of all areas."""
    areas = written(_area_table(f))
    return hi.documents(areas.withColumnRenamed("admin_level", "level"), ar.hierarchy(areas))


@query(f"WITH RECURSIVE {_B}, {_E}, {_P}, {_UP}, {_FACTS} SELECT f.id, max(CASE WHEN a.level = 2 THEN a.iso END) AS country, arg_max(a.pc, a.level) FILTER (a.pc IS NOT NULL) AS text_code, coalesce(arg_max(a.pc, a.level) FILTER (a.pc IS NOT NULL), max(f.pc)) AS point_code FROM f JOIN up ON up.id = f.id JOIN f a ON a.id = up.anc GROUP BY f.id")
def country_postcode_pick(f):
    """Country and post code of all areas that have ancestors, as text and as coordinate matches have them."""
    areas = written(_area_table(f))
    own = F.struct(*[F.col(c) for c in ("id", "level", "name", "relation_id", "way_id", "country_iso_code", "post_code")])
    rows = areas.withColumnRenamed("admin_level", "level").join(ar.hierarchy(areas).select("id", "ancestors"), "id").where(F.size("ancestors") > 0)
    text, point = hi.by_level(F.col("ancestors"), False), hi.by_level(F.col("ancestors"), True)
    return rows.select("id", hi.country_code(point, own).alias("country"), hi.post_code(text).alias("text_code"), F.coalesce(hi.post_code(point), F.col("post_code")).alias("point_code"))


_STEPS = "SELECT c_custkey AS id, unnest([8, 8 + c_nationkey % 2, 4, 4, 2]) AS level, unnest(range(5)) AS pos, unnest(['a', 'b', 'c', 'd', 'e']) AS name FROM customer"


def _steps(f):
    level = lambda i: [F.lit(8), 8 + F.col("c_nationkey") % 2, F.lit(4), F.lit(4), F.lit(2)][i].cast("int")
    chain = F.array(*[F.struct(level(i).alias("level"), F.lit(n).alias("name")) for i, n in enumerate("abcde")])
    return f.table("customer").select(F.col("c_custkey").alias("id"), chain.alias("chain"))


@query(f"SELECT id, string_agg(name, '' ORDER BY level, pos) AS names FROM ({_STEPS}) GROUP BY id")
def ancestor_order_text(f):
    return _steps(f).select("id", F.array_join(F.transform(hi.by_level(F.col("chain"), False), lambda a: a["name"]), "").alias("names"))


@query(f"SELECT id, string_agg(name, '' ORDER BY level, pos DESC) AS names FROM ({_STEPS}) GROUP BY id")
def ancestor_order_coord(f):
    return _steps(f).select("id", F.array_join(F.transform(hi.by_level(F.col("chain"), True), lambda a: a["name"]), "").alias("names"))


# --- answers -----------------------------------------------------------------------------------------------------------


@query("""SELECT c_nationkey AS query_id, CAST(rank AS INTEGER) AS rank, c_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 DESC, CAST(c_custkey % 11 AS FLOAT) / 10 DESC, c_custkey) AS rank FROM customer
 WHERE coalesce(CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 11 AS FLOAT) / 10 END, 1e0 - (c_custkey % 100) / 1e2) >= 3e-1 AND c_custkey % 100 > 20 AND c_custkey % 100 < 80 AND c_custkey % 4 IN (0, 1)) WHERE rank <= 10""")
def rank_and_truncate(f):
    """Quality by similarity or distance, region, level of the last part, order by score and similarity, ten of each."""
    c = f.table("customer")
    similarity = (F.col("c_custkey") % 11).cast("float") / F.lit(10).cast("float")
    m = c.select(
        F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("score"), similarity.alias("order_by"), F.when(F.col("c_custkey") % 3 != 0, similarity).alias("similarity"), (F.col("c_custkey") % 100).alias("coordinates_distance_in_meters"),
        (F.col("c_custkey") % 100).cast("double").alias("longitude"), F.lit(0.5).alias("latitude"), F.array(F.struct(F.lit(2).cast("long").alias("level")), F.struct((F.col("c_custkey") % 4).alias("level"))).alias("admin_levels"),
    )
    filters = qy.Filters(min_quality=0.3, region="POLYGON((20 0,80 0,80 1,20 1,20 0))", levels=(0, 1))
    return qy.cut(m, filters, F.desc("score"), F.desc("order_by"), F.col("id")).select("query_id", F.col("rank").cast("int").alias("rank"), "id")


def _tables(f, text: bool = False):
    """All that queries read, over streets, boxes and house numbers of the test tables."""
    areas = written(_area_table(f))
    preset = presets.of("brazil")
    nodes = f.house_nodes()
    tags = F.map_filter(F.create_map(F.lit("addr:housenumber"), F.col("number"), F.lit("addr:street"), F.col("addr_street")), lambda k, v: v.isNotNull())
    houses = written(ar.house_numbers(nodes.select(F.col("node_id").alias("id"), "lon", "lat", tags.alias("tags")), areas, preset))
    hierarchy = written(ar.hierarchy(areas))
    tables = qy.Tables(areas, hierarchy, houses, ar.boxes(areas))
    if text:
        docs = hi.documents(areas.withColumnRenamed("admin_level", "level"), hierarchy)
        tables.index, tables.docs = ti.TextIndex.build(docs), docs.select("id", "level")
    return tables


def _points(f):
    return f.points().select(F.col("cid").alias("query_id"), "lat", "lon")


_HNUM = f"hnum AS (SELECT node_id, {_CANON} AS num FROM hn WHERE lower(trim(number)) NOT IN ('s/n') AND trim(number) <> '')"
_KEPT = f"hk AS (SELECT node_id, id AS street_id, qx AS hx, qy AS hy FROM c WHERE r = 1), {_HNUM}"


@query(f"""WITH {_NEAR}, {_MATCH.replace(f'{STREETS}, ', '')}, {_KEPT}, t AS ({_TOP.format(src='metres')}),
w AS (SELECT t.cid, t.id, arg_min(num, {{'m': {_HAV.format(a='t.lat', b='hy', c='t.lon', d='hx')}, 'n': hk.node_id}}) AS num FROM t JOIN hk ON hk.street_id = t.id JOIN hnum USING (node_id) WHERE {_HAV.format(a='t.lat', b='hy', c='t.lon', d='hx')} <= 50 GROUP BY ALL)
SELECT t.cid, t.rank, t.id, t.metres, w.num AS number, CASE WHEN w.num IS NULL THEN 12 ELSE 30 END AS leaf FROM t LEFT JOIN w ON w.cid = t.cid AND w.id = t.id""")
def house_enrich_coord(f):
    """Coordinate matches with the closest house number within 50 m as their last part; the point stays on the street."""
    m = qy.coordinate_matches(_points(f), _tables(f), qy.Filters(include_wkt=False))
    leaf = F.element_at("admin_levels", -1)
    return m.select(F.col("query_id").alias("cid"), F.col("rank").cast("int").alias("rank"), "id", F.col("coordinates_distance_in_meters").alias("metres"), F.when(leaf["level"] == 30, leaf["name"]).alias("number"), leaf["level"].alias("leaf"))


@query(f"WITH {_NEAR}, t AS ({_TOP.format(src='metres')}) SELECT 0 AS differing, count(*) AS n FROM t")
def early_cut_equivalence(f):
    """Coordinate matches cut before and after enrichment: how many rows only one of the two has, and how many there are."""
    tables, columns = _tables(f), ["query_id", "rank", "id", "friendly_name", "latitude", "longitude", "coordinates_distance_in_meters"]
    early, late = (written(qy.coordinate_matches(_points(f), tables, qy.Filters(include_wkt=False), early=e).select(*columns)) for e in (True, False))
    other = early.exceptAll(late).unionByName(late.exceptAll(early)).agg(F.count("*").cast("int").alias("differing"))
    return early.agg(F.count("*").alias("n")).join(F.broadcast(other)).select("differing", "n")  # one row each


_HOUSES_OF = "h AS (SELECT node_id, id AS street_id, qx AS x, qy AS y, TRY_CAST(regexp_extract(num, '^[0-9]+') AS BIGINT) AS n, num FROM c JOIN hnum USING (node_id) WHERE r = 1)"
_SPOT = "{'x': x, 'y': y, 'n': n}"


@query(f"""WITH {_MATCH}, {_HNUM}, {_HOUSES_OF}, a AS (SELECT id AS street_id, name, id % 400 AS w FROM streets),
e AS (SELECT a.street_id, arg_min({_SPOT}, node_id) AS p FROM a JOIN h ON h.street_id = a.street_id AND lower(num) = concat('', w) GROUP BY ALL),
lo AS (SELECT a.street_id, arg_min({_SPOT}, {{'n': -n, 'i': node_id}}) AS p FROM a JOIN h ON h.street_id = a.street_id AND n < w GROUP BY ALL),
up AS (SELECT a.street_id, arg_min({_SPOT}, {{'n': n, 'i': node_id}}) AS p FROM a JOIN h ON h.street_id = a.street_id AND n > w GROUP BY ALL),
k AS (SELECT a.street_id, w, e.p AS ep, lo.p AS lp, up.p AS pp, CASE WHEN e.p IS NOT NULL THEN 'exact' WHEN lo.p IS NOT NULL AND up.p IS NOT NULL THEN 'interpolated' ELSE 'absent' END AS kind FROM a LEFT JOIN e USING (street_id) LEFT JOIN lo USING (street_id) LEFT JOIN up USING (street_id))
SELECT street_id AS id, kind, CASE WHEN kind = 'absent' THEN 66667 ELSE 67667 END AS similarity, CASE WHEN kind = 'absent' THEN 12 ELSE 30 END AS leaf FROM k""")
def house_enrich_text(f):
    """Each street asked for by name with a number: how the number resolves, what that adds to the similarity, and the
    level of the last part."""
    tables = _tables(f)
    asked = f.streets().select(F.col("id").alias("query_id"), F.concat("name", F.lit(" "), F.col("id") % 400).alias("text"), "id")
    docs = hi.documents(tables.areas.withColumnRenamed("admin_level", "level").where("level = 12"), tables.hierarchy.withColumn("ancestors", F.slice("ancestors", 1, 0)))
    tables.index, tables.docs = ti.TextIndex.build(docs.withColumn("name", F.concat_ws(" ", "name", F.lit(""), F.col("id") % 400))), docs.select("id", "level")
    m = qy.text_matches(asked.select("query_id", "text"), qy.Tables(tables.areas.withColumn("post_code", F.lit(None).cast("string")), tables.hierarchy.withColumn("ancestors", F.slice("ancestors", 1, 0)), tables.houses, tables.boxes, tables.index, tables.docs), qy.Filters(include_wkt=False))
    return m.where(F.col("id") == F.col("query_id")).select("id", F.col("house_number.kind").alias("kind"), F.round(F.col("similarity").cast("double") * 1e5).cast("int").alias("similarity"), F.element_at("admin_levels", -1)["level"].alias("leaf"))


@query(f"WITH {_MATCH} SELECT node_id, id AS street_id FROM c WHERE r = 1 AND named")
def house_by_name(f):
    """Houses whose address names a street near by."""
    return sp.match_houses_by_name(f.house_nodes(), f.streets(), "node_id").select("node_id", "street_id")


@query(f"WITH {_STREET_HOUSES}, a AS (SELECT DISTINCT street_id, street_id * 5 AS w FROM h) SELECT a.street_id, {_XY.format('arg_min(x, node_id)')} AS x, {_XY.format('arg_min(y, node_id)')} AS y FROM a JOIN h ON h.street_id = a.street_id AND n = w GROUP BY a.street_id")
def house_number_exact(f):
    h = _houses(f)
    asked = h.select("street_id").distinct().select(F.lit(0).alias("query_id"), "street_id", F.expr("cast(street_id * 5 as string)").alias("wanted"))
    return hn.resolve(asked, h).where("kind = 'exact'").select("street_id", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))


@query(r"""SELECT p_partkey AS id, CAST(round(1e5*len(list_filter(q, lambda t: list_contains(d, t)))/len(q)) AS BIGINT) AS similarity FROM (SELECT p_partkey, regexp_extract_all(lower(p_type || ' ring ' || p_size), '[\p{L}\p{N}]+') AS q, regexp_extract_all(lower(concat_ws(' ', p_name, p_brand, p_size % 20)), '[\p{L}\p{N}]+') AS d FROM part)""")
def text_similarity(f):
    """Share of a query's words that an area's or its ancestors' texts hold."""
    up = F.array(F.struct(F.col("p_brand").alias("name"), (F.col("p_size") % 20).cast("string").alias("post_code")))
    text = F.concat("p_type", F.lit(" ring "), "p_size")
    return f.table("part").select(F.col("p_partkey").alias("id"), F.round(qy.similarity(text, F.col("p_name"), F.lit(None).cast("string"), up) * 1e5).cast("long").alias("similarity"))


@query(f"WITH {_CORE}, {_FOUND}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score*1e9) DESC, doc) AS rank FROM f) SELECT CAST(query_id AS INTEGER) AS query_id, count(*) AS n, CAST(round(max(score)*1e4) AS BIGINT) AS best, CAST(round(min(score)*1e4) AS BIGINT) AS worst FROM k WHERE rank <= 50 GROUP BY query_id")
def text_top50(f):
    return _scored(ti.search(_index(f), _asked(f)))


# --- files -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {NODES}, refs AS (SELECT l_orderkey AS way_id, l_partkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem)
SELECT 'node' AS kind, node_id AS id, concat(CAST(round(lat*1e7) AS BIGINT), '/', CAST(round(lon*1e7) AS BIGINT), '/', CASE WHEN node_id % 3 = 0 THEN concat('ref=', node_id) ELSE '' END) AS content FROM nodes
UNION ALL SELECT 'way', way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) FROM refs GROUP BY way_id
UNION ALL SELECT 'relation', o_custkey, string_agg(concat(CASE WHEN o_orderkey % 2 = 0 THEN 'w' ELSE 'n' END, o_orderkey, o_orderstatus), ',' ORDER BY o_orderkey) FROM orders GROUP BY o_custkey""")
def osmpbf_scan(f):
    """Nodes, ways and relations written as deflated blobs and decoded again."""
    tags = F.map_filter(F.create_map(F.lit("ref"), F.when(F.col("node_id") % 3 == 0, F.col("node_id").cast("string")), F.lit("source"), F.lit("x")), lambda k, v: v.isNotNull())
    nodes = f.nodes().select(F.col("node_id").alias("id"), "lat", "lon", tags.alias("tags"))
    none = F.create_map().cast("map<string,string>")
    ways = _ways(f).select(F.col("way_id").alias("id"), "refs", none.alias("tags"))
    member = F.struct(F.when(F.col("o_orderkey") % 2 == 0, "w").otherwise("n").alias("type"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("role"))
    relations = f.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), member.alias("m")))).alias("ms")).select("id", F.transform("ms", lambda x: x["m"]).alias("members"), none.alias("tags"))
    back = lambda rows, e: osmpbf.decoded(osmpbf.encoded(rows, e), e, ignore=("source",))
    n7 = lambda c: F.round(F.col(c) * 1e7).cast("long")
    tag = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return (
        back(nodes, "nodes").select(F.lit("node").alias("kind"), "id", F.concat_ws("/", n7("lat"), n7("lon"), tag).alias("content"))
        .unionByName(back(ways, "ways").select(F.lit("way").alias("kind"), "id", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("content")))
        .unionByName(back(relations, "relations").select(F.lit("relation").alias("kind"), "id", F.array_join(F.transform("members", lambda m: F.concat(m["type"], m["id"].cast("string"), m["role"])), ",").alias("content")))
    )


@query()
def geocode_text_e2e(f):
    """Streets by name, with and without numbers, and points, through the whole of geocode; rows only."""
    s = f.streets()
    texts = s.select("id", F.lower("name").alias("text")).unionByName(s.select((F.col("id") + 10000).alias("id"), F.concat(F.lower("name"), F.lit(" "), F.col("id") % 300).alias("text"))).unionByName(f.points().select((F.col("cid") + 20000).alias("id"), F.concat(F.round("lat", 5).cast("string"), F.lit(","), F.round("lon", 5).cast("string")).alias("text")))
    m = qy.geocode(_tables(f, True), texts.withColumnRenamed("id", "query_id"))
    return m.select("query_id", "service", "rank", "id", "friendly_name", "latitude", "longitude", "coordinates_distance_in_meters", "similarity", "house_number")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)

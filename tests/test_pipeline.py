"""From extract files to answers: stages, workspace, catalog, merge and command line."""

import json

import pytest

from gazetteer import cli
from gazetteer.operators import catalog
from gazetteer.pipeline import Pipeline
from gazetteer.query import geocode
from gazetteer.sources import extracts
from gazetteer.sources import osmpbf as pbf
from gazetteer.workspace import Workspace, merge


def region(n: int, x: float) -> bytes:
    """A city of two boundary ways with a street, a suburb and a house, in an extract of its own; ids begin at n * 1000."""
    i = n * 1000
    at = lambda k, dx, dy, **tags: {"id": i + k, "lat": dy, "lon": x + dx, "tags": tags}
    nodes = [at(1, 0, 0), at(2, 0.5, 0), at(3, 0.5, 0.5), at(4, 0, 0.5), at(5, 0.1, 0.1), at(6, 0.11, 0.1), at(9, 0.105, 0.1002, **{"addr:housenumber": "12 a", "addr:street": f"Rua {n}"}), at(10, 0.4, 0.4, **{"addr:housenumber": "S/N"})]
    ways = [
        {"id": i + 20, "refs": [i + 1, i + 2, i + 3], "tags": {}}, {"id": i + 21, "refs": [i + 1, i + 4, i + 3], "tags": {}}, {"id": i + 22, "refs": [i + 5, i + 6], "tags": {"highway": "residential", "name": f"Rua {n}"}},
        {"id": i + 23, "refs": [i + 5, i + 6, i + 3, i + 5], "tags": {"place": "suburb", "name": f"Bairro {n}"}}, {"id": i + 24, "refs": [i + 5, i + 6], "tags": {"building": "yes", "name": "House"}},
    ]
    outer = [{"type": "w", "id": i + 20, "role": "outer"}, {"type": "w", "id": i + 21, "role": "outer"}, {"type": "n", "id": i + 1, "role": "admin_centre"}]
    relations = [
        {"id": i + 30, "members": outer, "tags": {"admin_level": "8", "name": f"City {n}", "name:pt": f"Cidade {n}", "postal_code": f" p-{n} "}},
        {"id": i + 31, "members": outer, "tags": {"admin_level": "2", "name": f"Land {n}", "ISO3166-1": "br"}}, {"id": i + 32, "members": outer, "tags": {"admin_level": "4"}},
    ]
    head = pbf.header_block(x, x + 1, 1, 0, ["OsmSchema-V0.6"], program="test", sequence=n)
    return b"".join([pbf.framed("OSMHeader", pbf.blob(head)), *(pbf.framed("OSMData", pbf.blob(pbf.block(e, r))) for e, r in (("nodes", nodes), ("ways", ways), ("relations", relations)))])


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for n, x in ((1, 0.0), (2, 3.0)):
        (folder / f"r{n}.osm.pbf").write_bytes(region(n, x))
    return folder


@pytest.fixture(scope="module")
def built(spark, files, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ws")
    out = {}
    for name, numbers in (("both", (1, 2)), ("one", (1,)), ("two", (2,))):
        out[name] = Workspace(spark, str(folder / name))
        p = Pipeline(out[name], "brazil")
        if name == "both":
            p.build([str(files / f"r{n}.osm.pbf") for n in numbers])
        else:  # the others are merged, so they need no indexes
            for n in numbers:
                p.extract_data(str(files / f"r{n}.osm.pbf"))
            p.extract_admin_levels()
            p.extract_house_numbers()
    return out


def answers(ws):
    q = ws.spark.createDataFrame([(0, "rua 1"), (1, "rua 2"), (2, "0.1001,0.105"), (3, "0.1001,3.105"), (4, "cidade 2"), (5, "bairro 1")], "query_id long, text string")
    rows = geocode(ws, q).orderBy("query_id", "rank").collect()
    return [(r.query_id, r.rank, r.id, r.friendly_name, r.latitude, r.longitude, str(r.attributes), [p.name for p in r.admin_levels]) for r in rows]


def test_build(built):
    ws = built["both"]
    areas = {r.name: r for r in ws.table("admin_levels").collect()}
    assert sorted(areas) == ["Bairro 1", "Bairro 2", "Cidade 1", "Cidade 2", "Land 1", "Land 2", "Rua 1", "Rua 2"]
    city, land = areas["Cidade 1"], areas["Land 1"]
    assert (city.id, city.relation_id, city.post_code, city.geom.kind) == (2061, 1030, "P-1", "MultiPolygon") and land.country_iso_code == "BR"
    assert areas["Rua 1"].id == 2044 and areas["Rua 1"].geom.kind == "LineString" and areas["Bairro 1"].geom.kind == "MultiPolygon" and areas["Bairro 1"].admin_level == 10
    (house,) = ws.table("house_numbers").where("node_id = 1009").collect()
    assert (house.admin_level_id, house.number, house.strategy) == (2044, "12A", 1) and house.y == pytest.approx(0.1)
    assert ws.table("house_numbers").count() == 2
    chain = ws.table("hierarchy").where("id = 2044").first()
    assert chain.friendly_name == "Rua 1, Bairro 1, Cidade 1, Land 1" and ws.status()["is_ok"]
    row = {r.file_path.rsplit("/", 1)[-1]: r for r in ws.table("pbf_files").collect()}["r1.osm.pbf"]
    assert (row.node_count, row.way_count, row.relation_count, row.header_writingprogram, row.header_replication_sequence_number) == (8, 5, 3, "test", 1)
    assert row.admin_levels_count == 4 and row.house_numbers_count == 1 and row.header_bbox_wkt.startswith("POLYGON((0 0")
    found = answers(ws)
    assert [f[3] for f in found if f[0] == 2][0] == "Rua 1, 12A, Bairro 1, Cidade 1, Land 1"


def test_stages_run_again_change_nothing(built, files):
    ws = built["one"]
    p = Pipeline(ws, "brazil")
    assert p.index_coordinates() == 4
    before = sorted(map(str, ws.table("admin_levels").collect()))
    assert p.extract_chunks(str(files / "r1.osm.pbf")) == 4 and p.extract_data(str(files / "r1.osm.pbf"))["node_count"] == 8
    assert p.extract_admin_levels() == 4 and sorted(map(str, ws.table("admin_levels").collect())) == before
    assert catalog.header_chunk(ws.table("blob_chunks"), 1).first().chunk_type == 0
    assert [c.chunk_type for c in catalog.file_chunks(ws.table("blob_chunks"), 1).collect()] == [0, 1, 1, 1]


def test_merge_equals_a_combined_build(spark, built, tmp_path):
    base = Workspace(spark, str(tmp_path / "merged"))
    assert merge(base, [built["one"], built["two"]]) == (8, 2)
    assert base.index() is None and not base.has("hierarchy")
    Pipeline(base, "brazil").index()
    assert answers(base) == answers(built["both"])
    with pytest.raises(ValueError):
        merge(base, [])
    with pytest.raises(ValueError):
        merge(Workspace(spark, str(tmp_path / "a")), [Workspace(spark, str(tmp_path / "b"))])


def test_merge_keeps_levels_and_houses(spark, tmp_path):
    a, b = Workspace(spark, str(tmp_path / "a")), Workspace(spark, str(tmp_path / "b"))
    line = "named_struct('kind', 'LineString', 'parts', array(array(array(named_struct('x', {0}, 'y', 0D), named_struct('x', 1D, 'y', 0D)))))"
    area = lambda level, name, x: spark.sql(f"SELECT 4L AS id, cast(null AS long) AS relation_id, 2L AS way_id, {level} AS admin_level, '{name}' AS name, cast(null AS string) AS country_iso_code, cast(null AS string) AS post_code, {line.format(x)} AS geom")
    house = lambda number: spark.sql(f"SELECT 100L AS node_id, 4L AS admin_level_id, '{number}' AS number, 0D AS x, 0D AS y, 0 AS strategy")
    a.put("admin_levels", area(10, "old", "0D")), a.put("house_numbers", house("1"))
    b.put("admin_levels", area(12, "new", "0.5D")), b.put("house_numbers", house("2"))
    merge(a, [b])
    row = a.table("admin_levels").first()
    assert (row.admin_level, row.name, row.geom.parts[0][0][0].x) == (10, "new", 0.5) and a.table("house_numbers").first().number == "1"


def test_workspace(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "w"))
    assert ws.table("nodes").count() == 0 and ws.index() is None and ws.status()["is_ok"] is False
    ws.put("boxes", spark.createDataFrame([(1, 12, 0.0, 0.0, 1.0, 1.0)], "id long, admin_level int, minx double, miny double, maxx double, maxy double").repartition(3))
    before, after = ws.compact()
    assert ws.table("boxes").count() == 1 and after <= before and ws.size() > 0
    meta = f"{ws.path}/_meta.json"
    ws.files.write(meta, ws.files.read(meta).replace('"version": 1', '"version": 0'))
    with pytest.raises(ValueError, match="schema version"):
        Workspace(spark, str(tmp_path / "w"))
    with pytest.raises(FileNotFoundError):
        Workspace(spark, str(tmp_path / "none"), create=False)


INDEX = json.dumps({"features": [{"properties": {"id": "a", "name": "A", "urls": {"pbf": "http://x/a.osm.pbf"}}}, {"properties": {"id": "b", "name": "B", "parent": "a"}}]})


def test_regions_and_downloads(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "w"))
    calls = []
    get = lambda url: calls.append(url) or INDEX
    assert [tuple(r) for r in extracts.list_regions(ws, get=get).collect()] == [("a", "A", "http://x/a.osm.pbf"), ("b", "B", "-")]
    extracts.list_regions(ws, get=get)
    assert len(calls) == 1 and extracts.region_url(ws, "a", get=get) == "http://x/a.osm.pbf" and extracts.region_url(ws, "b", get=get) is None
    content = bytes(range(256)) * 5

    def get_range(url, first, last, path):
        with open(path, "wb") as f:
            f.write(content[first : last + 1])

    by = {"length": lambda u: len(content), "get_range": get_range, "get": lambda u: "0000 a.osm.pbf"}
    got = extracts.download_region(ws, "a", str(tmp_path / "data"), 3, **by)
    assert (tmp_path / "data" / "a.osm.pbf").read_bytes() == content and got.verdict == "mismatch" and not got.reused
    assert extracts.download("http://x/a.osm.pbf", str(tmp_path / "data"), 3, **(by | {"get": lambda u: got.md5})).verdict == "ok"
    assert extracts.check_md5("u", "x", lambda u: "") == "unavailable"
    assert extracts.local_files(str(tmp_path / "data")) == [(got.path, len(content))] and extracts.local_files("/nowhere") == []
    assert extracts.find_file(ws, "a", "/nowhere") == got.path and extracts.find_file(ws, "a.osm.pbf", str(tmp_path / "data")) == got.path and extracts.find_file(ws, "zz", "/nowhere") is None
    row = ws.table("pbf_files").where("region_id = 'a'").first()
    assert row.size_bytes == len(content) and row.md5 == got.md5
    extracts.list_regions(ws, fresh=True, get=get)
    assert ws.table("pbf_files").count() == 2 and catalog.path_of(ws.table("pbf_files"), str(row.id)) == got.path


def test_command_line(spark, built, files, tmp_path):
    said = []
    run = lambda where, *a: cli.run(["--workspace", where, "--data", str(files), "--preset", "brazil", *a], spark, said.append)
    new, one = str(tmp_path / "w"), built["two"].path
    assert run(new, "query", "rua") == 1  # nothing is built
    assert run(new, "extract", "blob-chunks", "r1.osm.pbf") == 0 and said[-1] == "4 blobs"
    assert run(new, "extract", "header", "none.pbf") == 1 and run(new, "index", "nonsense") == 1
    assert run(one, "query", "3.1001,0.105", "--include-wkt", "false") == 1 and "no text index" in said[-1]
    assert run(built["both"].path, "query", "80.1,0.105", "--include-wkt", "false") == 0 and json.loads(said[-1]) == {"service": "coordinates_to_address", "matches": []}
    assert run(one, "optimize", "delete-intermediary-data") == 0 and not built["two"].has("nodes")
    assert run(one, "pbf", "ls", "--local") == 0 and "r1.osm.pbf" in said[-2]
    with pytest.raises(SystemExit):
        run(new, "query", "x", "--min-quality", "7")

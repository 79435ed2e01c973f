"""From decoded OSM rows to candidate areas: tag predicates, name and code rules, ordered geometry joins, rings."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGHWAYS = ("residential", "primary", "secondary", "tertiary", "unclassified", "living_street")


def way_predicates(tag) -> dict[str, Column]:
    """Named predicates over a function from tag key to column; the not_ ones hold where the tag is missing."""
    absent = lambda key, value: F.coalesce(tag(key), F.lit("")) != value
    return (
        {f"highway_{h}": F.coalesce(tag("highway") == h, F.lit(False)) for h in HIGHWAYS}
        | {f"place_{p}": F.coalesce(tag("place") == p, F.lit(False)) for p in ("neighbourhood", "suburb")}
        | {"not_neighbourhood": absent("place", "neighbourhood"), "not_suburb": absent("place", "suburb"), "not_park": absent("leisure", "park"), "not_building": tag("building").isNull(), "not_waterway": tag("waterway").isNull()}
    )


#: What levels 10 and 12 take and leave unless a rule overrides both lists.
INCLUDE = {10: ("place_neighbourhood", "place_suburb")}
EXCLUDE = {12: ("not_neighbourhood", "not_suburb", "not_park", "not_building", "not_waterway")}


def level_filter(level: int, predicates: dict[str, Column], override: tuple[tuple[str, ...], tuple[str, ...]] | None = None) -> Column:
    """Included kinds are alternatives, excluded ones must all be absent.  Level 10 knows no excludes, level 12 no includes."""
    include, exclude = override or (INCLUDE.get(level, ()), EXCLUDE.get(level, ()))
    parts = []
    if include and level != 12:
        parts.append(reduce(or_, [predicates[k] for k in include]))
    if exclude and level != 10:
        parts.append(reduce(and_, [predicates[k] for k in exclude]))
    return reduce(and_, parts, F.lit(True))


def relation_candidates(relations: DataFrame, level: int) -> DataFrame:
    """Relations of a level that have a name."""
    t = lambda k: F.try_element_at("tags", F.lit(k))
    return relations.where((t("admin_level") == str(level)) & t("name").isNotNull())


def way_coords(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, line): each way's nodes in order; nodes that are not there are left out."""
    steps = ways.select("way_id", F.posexplode("refs").alias("pos", "node_id"))
    placed = steps.join(nodes, "node_id")
    line = F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y"))))
    return placed.groupBy("way_id").agg(F.transform(line, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def relation_ways(relations: DataFrame, way_lines: DataFrame) -> DataFrame:
    """(relation_id, lines): the lines of a relation's member ways in member order; other members and missing ways go."""
    members = relations.select("relation_id", F.posexplode("members").alias("ord", "m")).where(F.col("m.type") == "w").select("relation_id", "ord", F.col("m.id").alias("way_id"))
    lines = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return members.join(way_lines, "way_id").groupBy("relation_id").agg(F.transform(lines, lambda x: x["line"]).alias("lines"))


def join_rings(lines: list[list[tuple[float, float]]], eps: float = 1e-9) -> list[list[tuple[float, float]]]:
    """Closed rings of at least four points from a relation's ways: a ring begins with the first way left, and as long as
    some way begins or, reversed, ends at its tail, the first such way extends it."""
    meet = lambda a, b: abs(a[0] - b[0]) < eps and abs(a[1] - b[1]) < eps
    left, rings = [line for line in lines if len(line)], []
    while left:
        ring = list(left.pop(0))
        while (found := next(((i, r) for i, line in enumerate(left) for r in (False, True) if meet(ring[-1], line[-1] if r else line[0])), None)) is not None:
            line = left.pop(found[0])
            ring += (line[::-1] if found[1] else line)[1:]
        if len(ring) >= 4 and meet(ring[0], ring[-1]):
            rings.append(ring)
    return rings


def _clockwise(ring):
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    return ring[::-1] if area > 0 else ring


_LINES = "array<array<struct<x:double,y:double>>>"
_SHAPED = pa.schema([("relation_id", pa.int64()), ("kind", pa.string()), ("lines", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])


def relation_geometry(relations: DataFrame) -> DataFrame:
    """(relation_id, kind, lines): clockwise outer rings as a MultiPolygon, or the ways as a MultiLineString if none
    closes; relations without points go.  Ring assembly depends on the order of the ways, so it runs row by row in
    Arrow batches, on one relation's ways at a time."""

    def run(batches):
        for batch in batches:
            out = []
            for rid, lines in zip(batch.column("relation_id").to_pylist(), batch.column("lines").to_pylist()):
                ways = [[(p["x"], p["y"]) for p in line] for line in lines if line]
                rings = [_clockwise(r) for r in join_rings(ways)]
                if ways:
                    out.append({"relation_id": rid, "kind": "MultiPolygon" if rings else "MultiLineString", "lines": [[{"x": x, "y": y} for x, y in part] for part in rings or ways]})
            yield pa.RecordBatch.from_pylist(out, _SHAPED)

    return relations.select("relation_id", "lines").mapInArrow(run, f"relation_id long, kind string, lines {_LINES}")


def pending(candidates: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Candidates that are not stored yet."""
    return candidates.join(stored, on, "left_anti")

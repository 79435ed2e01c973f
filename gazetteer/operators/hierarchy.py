"""Administrative parents, ancestor chains, and what is derived from them.

The parent of an area is, among the polygons that hold its centroid, one of the most specific level that is not below
its own, the smallest of that level, then the smallest id.  On its own level only strictly larger areas count.

Chains are the transitive closure.  Only areas that are someone's parent take part in it; all others (streets above all)
take their parent's chain in one join, so the closure's size is that of the boundaries, not of the streets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..scratch import written
from .spatial import containing_boxes

#: Rounds of doubling after which a chain must have ended: 4096 levels, which only a cycle can exceed.
MOST_ROUNDS = 12
STREET, HOUSE, COUNTRY = 12, 30, 2


def parents(areas: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, parent_id): `areas` have id, level, area, lon, lat (the centroid); `candidates` have id, level, area, box and
    polygons, arrays of rings whose first is the outer one, which must hold the centroid."""
    c = candidates.select(F.col("id").alias("cand_id"), F.col("level").alias("cand_level"), F.col("area").alias("cand_area"), "minx", "miny", "maxx", "maxy", F.col("polygons").alias("cand_polygons"))
    pairs = containing_boxes(areas, c).where((F.col("cand_id") != F.col("id")) & ((F.col("cand_level") < F.col("level")) | ((F.col("cand_level") == F.col("level")) & (F.col("cand_area") > F.col("area")))))
    pairs = pairs.where(geo.in_polygons(F.col("lon"), F.col("lat"), F.col("cand_polygons")))
    best = pairs.groupBy("id").agg(F.min(F.struct((-F.col("cand_level")).alias("l"), F.col("cand_area").alias("a"), F.col("cand_id").alias("c"))).alias("b"))
    return best.select("id", F.col("b.c").alias("parent_id"))


def ancestor_chains(of: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id, ancestor_ids): the chain from the parent on, for each row of (id, parent_id).  Among the parents chains double
    in length each round; ones that still grow after `most_rounds` are a cycle, which is an error."""
    of = written(of)
    up = of.select(F.col("parent_id").alias("id")).distinct()
    inner = of.join(up, "id", "left_semi").select("id", F.array("parent_id").alias("chain"))
    for left in range(most_rounds, -1, -1):
        inner = written(inner)
        more = inner.select(F.col("id").alias("tail"), F.col("chain").alias("more"))
        grown = inner.join(more, F.element_at("chain", -1) == F.col("tail"), "left")
        if not grown.where(F.col("more").isNotNull()).take(1):
            break
        if not left:
            raise ValueError("the parents hold a cycle")
        inner = grown.select("id", F.concat("chain", F.coalesce("more", F.array().cast("array<bigint>"))).alias("chain"))
    whole = of.join(inner.select(F.col("id").alias("parent_id"), "chain"), "parent_id", "left")
    return whole.select("id", F.concat(F.array("parent_id"), F.coalesce("chain", F.array().cast("array<bigint>"))).alias("ancestor_ids"))


def ancestors(chains: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, ancestors): the chains with each ancestor's row of `facts` (id and more) in its place; ancestors without a row
    are left out.  Chains are resolved once for each that differs, so an ancestor that half of all areas share is joined
    as often as chains differ."""
    distinct = written(chains.select("ancestor_ids").distinct())
    rest = [c for c in facts.columns if c != "id"]
    steps = distinct.select("ancestor_ids", F.posexplode("ancestor_ids").alias("pos", "id")).join(facts, "id")
    held = steps.groupBy("ancestor_ids").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("id", *rest).alias("fact")))).alias("found"))
    resolved = distinct.join(held, "ancestor_ids", "left").select("ancestor_ids", F.transform("found", lambda s: s["fact"]).alias("ancestors"))
    return chains.join(resolved, "ancestor_ids", "left").select("id", "ancestor_ids", "ancestors")


def friendly_names(areas: DataFrame, chains: DataFrame, names: DataFrame) -> DataFrame:
    """(id, friendly_name): own name, the ancestors' names from near to far, then the own post code."""
    joined = ancestors(chains, names.select("id", "name"))
    up = F.array_join(F.transform("ancestors", lambda a: a["name"]), ", ")
    post = F.nullif(F.trim("post_code"), F.lit("")) if "post_code" in areas.columns else F.lit(None).cast("string")
    return areas.join(joined, "id", "left").select("id", F.concat_ws(", ", "name", F.when(F.size("ancestors") > 0, up), post).alias("friendly_name"))


def documents(areas: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id, level, name, hier) of the text index: an area's own entity text, and its ancestors' texts from near to far.
    `areas` have id, level, name, post_code; `resolved` is (id, ancestors) with name and post_code."""
    hier = F.array_join(F.transform("ancestors", lambda a: tx.entity_text(a["name"], a["post_code"])), " ")
    return areas.join(resolved.select("id", "ancestors"), "id").select("id", "level", tx.entity_text(F.col("name"), F.col("post_code")).alias("name"), F.coalesce(hier, F.lit("")).alias("hier"))


def by_level(chain: Column, far_first: bool) -> Column:
    """Ancestors (from near to far) sorted by level; within a level near to far, or far to near."""
    keyed = F.transform(chain, lambda a, i: F.struct(a["level"].alias("l"), (F.size(chain) - i if far_first else i).alias("i"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda k: k["a"])


def country_code(sorted_up: Column, own: Column) -> Column:
    """The code of the first country among the ancestors, then the area itself; null if that country has none."""
    return F.try_element_at(F.filter(F.concat(sorted_up, F.array(own)), lambda a: a["level"] == COUNTRY), F.lit(1))["country_iso_code"]


def post_code(sorted_up: Column) -> Column:
    """The post code of the most specific ancestor that has one; the last of equal levels."""
    return F.try_element_at(F.filter(sorted_up, lambda a: a["post_code"].isNotNull()), F.lit(-1))["post_code"]


def global_rank(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """`df` with its rows' places from 1 in an order that ends in a key: range partitions, their sizes' prefix sums, and
    places within partitions, so that no task holds all rows."""
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # a partition's numbers go up by one a row from its own first
    first = dealt.groupBy("_part").agg(F.min("_at").alias("_first"))
    return dealt.join(before.join(first, "_part"), "_part").withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int")).drop("_part", "_at", "_before", "_first")


def last_wins(base: DataFrame, source: DataFrame, keep_first: list[str]) -> DataFrame:
    """Upsert by id: the source's values win, but the columns in `keep_first` stay as they were first stored."""
    both = base.withColumn("_o", F.lit(0)).unionByName(source.withColumn("_o", F.lit(1)))
    values = [c for c in base.columns if c != "id"]
    aggs = [(F.min_by if c in keep_first else F.max_by)(F.struct(c), F.col("_o")).alias(c) for c in values]
    return both.groupBy("id").agg(*aggs).select("id", *[F.col(f"{c}.{c}").alias(c) for c in values])


def first_wins(base: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Insert or ignore: a key that is already there keeps its row."""
    both = base.withColumn("_o", F.lit(0)).unionByName(source.withColumn("_o", F.lit(1)))
    rest = [c for c in base.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("_o")).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def once(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


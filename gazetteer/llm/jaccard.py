"""Groups of documents linked by the Jaccard similarity of their word n-grams.

Equal sets are one node (a 64-bit hash of the set), so exact copies cost nothing beyond the first.  For the links between
nodes the join is rare-first prefix filtering: a set's shingles are ordered by how often their hash bucket occurs in the
corpus, and two sets that are similar enough share a shingle in the first few.  The shorter set of a pair needs a shorter
prefix than the longer.  Length and position bounds drop most candidates, a suffix bound on shingle counts by hash range
most of the rest; each remaining pair is verified once, on the whole sets.

Only components are wanted, so a family of n near copies must not become n*n candidates.  First every prefix shingle's
holders are put in a random order of its own, and only neighbours in it are verified.  That joins nearly all of a family.
Next the holders outside a shingle's largest component are verified against its best linked
holder.  Then the candidates are those whose two sets are not yet in one component, all of them, so no link between components is
lost: a holder outside its shingle's largest component is compared with the holders of other components.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import discard, unused, written
from .graph import components

#: Buckets of the frequency table that orders shingles (a power of two; the table has one byte a bucket).
FREQUENCY_BITS = 18
#: Bits of the table of candidates' ids that saves hashing texts which no pair needs; what passes wrongly is joined away.
NEEDED_BITS = 20
#: Bits for each id of the table that tells which rows a join by id must look at, at least, and its most bits, as a power of two.
MARKS, MOST_MARKS = 8, 27
#: Holders are verified against hubs if the pairs left would be more than so many times the rows left.
ROUND_GAIN = 8
#: Random orders of the nodes that shingles' holders are put in.
ORDERS = 2
#: Hash ranges of the suffix bound, at least, and shingles of a set to each: a long set has more ranges, always a power of two
#: times as many, or the counts of any two long sets would be alike.
RANGES, EACH = 128, 4


def least_overlap(n: int, m: int, threshold: Fraction) -> int:
    """The least intersection with which sets of n and m shingles have at least this similarity."""
    t = threshold
    return -((-t.numerator * (n + m)) // (t.numerator + t.denominator))


def prefix_lengths(n: int, t: Fraction) -> tuple[int, int]:
    """How many of a set's rarest shingles can hold the first shared one: as the shorter of a pair, and as the longer."""
    return n - least_overlap(n, n, t) + 1, n - -((-t.numerator * n) // t.denominator) + 1


def node_of(shingles: np.ndarray) -> int:
    """The set's id: a signed 64-bit hash of its sorted shingles."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def _sets(batch, n: int):
    for a, _, raws in tb.batches(batch.column("text").to_pylist()):
        for i, s in enumerate(tb.shingle_sets(raws, n)):
            yield a + i, s


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def ranges_for(n: int) -> int:
    """How many hash ranges a set of n shingles is counted by."""
    r = RANGES
    while r * EACH < n:
        r *= 2
    return r


def _describe(n: int):
    """A row for each document (node, set size, shingle counts by hash range), then the task's shingle counts by frequency
    bucket, which stands in place of the node."""

    def run(batches):
        counts = np.zeros(1 << FREQUENCY_BITS, np.int64)
        names, ranges_of, id_type = ["counted", "doc_id", "n", "node", "ranges"], pa.list_(pa.int16()), pa.null()
        for batch in tb.slices(batches):
            id_type = batch.column("doc_id").type
            sizes, nodes, ranges, held = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, []
            for i, s in _sets(batch, n):
                sizes[i], nodes[i] = len(s), node_of(s)
                r = ranges_for(len(s))
                ranges[i] = np.bincount((s % np.uint64(r)).astype(np.int64), minlength=r).clip(max=32767).astype(np.int16)
                held.append(s)
            if held:
                counts += np.bincount(_bucket(np.concatenate(held)), minlength=len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, bool)), batch.column("doc_id"), pa.array(sizes), pa.array(nodes, mask=sizes == 0), pa.array(ranges, ranges_of)], names)
        met = np.flatnonzero(counts)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(met), bool)), pa.nulls(len(met), id_type), pa.array(counts[met]), pa.array(met), pa.nulls(len(met), ranges_of)], names)

    return run


def _prefixes(n: int, t: Fraction, rank: np.ndarray):
    """Each set's prefix, once a task: shingle, its place, the set's size and node, and whether it is also in the prefix
    that the set needs as the shorter of a pair."""

    def run(batches):
        seen: set[int] = set()
        for batch in tb.slices(batches):
            token, place, size, node, short = [], [], [], [], []
            for _, s in _sets(batch, n):
                me = node_of(s)
                if not len(s) or me in seen:
                    continue
                if len(seen) < 1 << 20:  # beyond that a copy's rows are dropped where they meet, not here
                    seen.add(me)
                as_short, as_long = prefix_lengths(len(s), t)
                key = (rank[_bucket(s)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                first = np.argpartition(key, as_long - 1)[:as_long]
                first = first[np.lexsort((s[first], key[first]))]
                token.append(s[first].view(np.int64))
                place.append(np.arange(as_long, dtype=np.int32))
                size.append(np.full(as_long, len(s), np.int32))
                node.append(np.full(as_long, me, np.int64))
                short.append(np.arange(as_long) < as_short)
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, place, size, node, short)], ["token", "place", "n", "node", "short"])

    return run


def _company(t: Fraction):
    """Over rows sorted by shingle and a random order: the rows whose shingle has another holder (or may have one in the
    next partition), each with `next`, the holder after it, where their sizes allow a link."""

    def settle(table: pa.Table, before: int | None, first: bool, last: bool):
        token, node, n = (table.column(c).to_numpy() for c in ("token", "node", "n"))
        same = np.append(token[1:] == token[:-1], last)  # the row after has the same shingle, or is not known
        repeat = np.append(same[:-1] & (node[1:] == node[:-1]), False)
        prior = np.concatenate([[first or before == token[0]], same[:-1]])
        other, m = np.roll(node, -1), np.roll(n, -1)
        able = same & ~repeat & (np.minimum(n, m) * t.denominator >= np.maximum(n, m) * t.numerator)
        able[-1] = False
        rows = np.flatnonzero((same | prior) & ~repeat)
        rows = rows[rows < len(token) - (not last)]  # a row whose successor is still to come waits
        return table.take(pa.array(rows)).append_column("next", pa.array(other[rows], mask=~able[rows]))

    def run(batches):
        carry, before, first = None, None, True
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
                if table.num_rows > 1:
                    yield from settle(table, before, first, False).combine_chunks().to_batches()
                    before, first = table.column("token")[table.num_rows - 2].as_py(), False
                carry = table.slice(table.num_rows - 1)
        if carry is not None:
            yield from settle(carry, before, first, True).combine_chunks().to_batches()

    return run


def _needed_sets(n: int, bits: np.ndarray):
    """(node, shingles) of the documents whose id's bit is set, once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in tb.slices(batches):
            rows = np.flatnonzero(bits[batch.column("bit").to_numpy()])
            nodes, sets = [], []
            for _, s in _sets(batch.take(pa.array(rows)), n) if len(rows) else ():
                me = node_of(s)
                if len(s) and me not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(me)
                    nodes.append(me)
                    sets.append(s.view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def folded(ranges: Column, few: Column) -> Column:
    """Counts by so many ranges from counts by a multiple of them."""
    times = F.floor(F.size(ranges) / few).cast("int")
    sums = F.transform(F.sequence(F.lit(0), few - 1), lambda i: F.aggregate(F.sequence(F.lit(0), times - 1), F.lit(0), lambda total, k: total + ranges[i + k * few].cast("int")))
    return F.when(times > 1, sums).otherwise(ranges.cast("array<int>"))


def _bit(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(1 << NEEDED_BITS)), F.lit(0))


class JaccardJoin:
    """The join's tables over one set of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int, threshold: Fraction):
        self.docs, self.words, self.t = docs.select("doc_id", "text"), words, threshold
        id_type = docs.schema["doc_id"].dataType.simpleString()
        told = written(self.docs.mapInArrow(_describe(words), f"counted boolean, doc_id {id_type}, n long, node long, ranges array<smallint>"))
        self.nodes = told.where(~F.col("counted")).drop("counted")
        counts = told.where("counted").groupBy("node").agg(F.sum("n").alias("n"))
        rank = np.zeros(1 << FREQUENCY_BITS, np.uint8)
        for bucket, c in counts.collect():  # a fixed number of buckets
            rank[bucket] = min(255, int(8 * np.log2(c + 1)))
        prefixes = written(self.docs.mapInArrow(_prefixes(words, threshold, rank), "token long, place int, n int, node long, short boolean"))
        self.holders = self.in_company(prefixes)
        discard(prefixes)
        # What pairs are judged by, of the nodes that can be in one: a range's count that is at its limit bounds nothing.
        described = self.nodes.where(F.col("node").isNotNull()).join(self.holders.select("node").distinct(), "node", "left_semi")
        self.described = written(described.groupBy("node").agg(F.min("n").alias("n"), F.min("ranges").alias("ranges"), F.min("doc_id").alias("doc_id")))
        self.tested: DataFrame | None = None

    def in_company(self, rows: DataFrame) -> DataFrame:
        """The holders that share a shingle, each with the `next` one in a random order of the shingle's own.  A shingle's
        rows may lie in several partitions, so a frequent one is no burden to any task."""
        order = [F.col("token"), F.xxhash64(F.pmod("token", F.lit(ORDERS)), "node"), F.col("node")]
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        return written(dealt.mapInArrow(_company(self.t), "token long, place int, n int, node long, short boolean, next long"))

    def overlap(self, n: Column, m: Column) -> Column:
        """The least intersection that links sets of these sizes."""
        a, b = self.t.numerator, self.t.numerator + self.t.denominator
        return F.floor((F.lit(a) * (n + m) + F.lit(b - 1)) / F.lit(b))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes that are links, each looked at once: the suffix bound first, then whole sets."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        side = lambda k: self.described.select(*[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "ranges", "doc_id")])
        both = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
        few = F.least(F.size("ranges_a"), F.size("ranges_b"))
        most = F.aggregate(F.zip_with(folded(F.col("ranges_a"), few), folded(F.col("ranges_b"), few), lambda x, y: F.when((x >= 32767) | (y >= 32767), F.lit(1 << 30)).otherwise(F.least(x, y))), F.lit(0).cast("long"), lambda x, y: x + y)
        left = written(both.where(most >= self.overlap(F.col("n_a"), F.col("n_b"))).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "doc_id_a", "doc_id_b"))
        marks = left.select(_bit(F.col("doc_id_a")).alias("bit")).unionByName(left.select(_bit(F.col("doc_id_b")).alias("bit")))
        words = marks.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        packed = np.zeros(1 << (NEEDED_BITS - 6), np.int64)
        for word, bits in words.collect():  # a fixed number of words
            packed[word] = bits
        bits = np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)
        sets = self.docs.withColumn("bit", _bit(F.col("doc_id"))).mapInArrow(_needed_sets(self.words, bits), "node long, shingles array<long>")
        # copies that several tasks have met are equal
        sets = written(sets.join(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").dropDuplicates(["node"]))
        whole = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        a, b = self.t.numerator, self.t.denominator
        shared = F.size(F.array_intersect("sa", "sb"))
        out = written(whole.where(shared * b >= (F.col("n") - shared) * a).select("a", "b"))
        discard(left, sets)
        return out

    def links(self) -> DataFrame:
        """Enough links (a, b) between nodes to give the components that all links give."""
        pairs = self.holders.where(F.col("next").isNotNull()).select(F.col("node").alias("a"), F.col("next").alias("b"))
        found = self.verified(pairs)
        held, rows, left = self.labelled(found)
        if left > ROUND_GAIN * rows:  # families whose members are not all joined yet
            found = found.unionByName(self.verified(self.hubs(held, found)))
            held, *_ = self.labelled(found)
        return found.unionByName(self.verified(self.crossing(held)))

    def labelled(self, links: DataFrame) -> tuple[DataFrame, int, int]:
        """The holders of shingles that holders of more than one component share, with `root`, and `most`: the component
        that holds the shingle most often; their number, and that of the pairs that `crossing` would look at, at most."""
        of = components(links)
        held = written(self.holders.drop("next").join(of, "node", "left").withColumn("root", F.coalesce("root", "node")))
        each = held.groupBy("token", "root").agg(F.count("*").alias("c"))
        crowd = each.groupBy("token").agg(F.count("*").alias("roots"), F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("top")).where(F.col("roots") > 1)
        crowd = written(crowd.select("token", "all", F.col("top.c").alias("c"), F.col("top.root").alias("most")))
        rows, pairs = crowd.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum((F.col("all") - F.col("c")) * F.col("all").cast("double")), F.lit(0.0))).first()
        crossed = written(held.join(crowd.select("token", "most"), "token"))
        discard(held, crowd)
        return crossed, rows, pairs

    def hubs(self, held: DataFrame, found: DataFrame) -> DataFrame:
        """For each shingle, the holders outside its largest component paired with that component's best linked holder:
        copies of one original often are nearer to it than to one another."""
        degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        inside = held.where(F.col("root") == F.col("most")).join(degree, "node", "left")
        hub = inside.groupBy("token").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), "node", "n")).alias("hub")).select("token", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"))
        able = F.least("n", "m") * self.t.denominator >= F.greatest("n", "m") * self.t.numerator
        return held.where(F.col("root") != F.col("most")).join(hub, "token").where(able).select(F.col("node").alias("a"), "b")

    def crossing(self, held: DataFrame) -> DataFrame:
        """All candidate pairs (a, b) of different components: one of the two is outside its shingle's largest."""
        x = held.where(F.col("root") != F.col("most")).select("token", *[F.col(c).alias(f"{c}_x") for c in ("place", "n", "node", "short", "root", "most")])
        y = held.select("token", *[F.col(c).alias(f"{c}_y") for c in ("place", "n", "node", "short", "root")])
        smaller_x = F.struct("n_x", "node_x") < F.struct("n_y", "node_y")
        need = self.overlap(F.col("n_x"), F.col("n_y"))
        once = (F.col("root_y") == F.col("most_x")) | (F.col("node_x") < F.col("node_y"))
        length = F.least("n_x", "n_y") * self.t.denominator >= F.greatest("n_x", "n_y") * self.t.numerator
        place = (F.col("n_x") - F.col("place_x") >= need) & (F.col("n_y") - F.col("place_y") >= need)
        pair = x.join(y, (x.token == y.token) & (F.col("root_x") != F.col("root_y")) & once & length & place & F.when(smaller_x, F.col("short_x")).otherwise(F.col("short_y")))
        return pair.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))


def jaccard_groups(docs: DataFrame, words: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text).

    A set holds the distinct shingles of `words` words (runs without ASCII white space, A-Z lower-cased); a text of fewer
    words has one, its whole sequence; a null or wordless text has none and is linked with nothing.  Documents are linked
    from a similarity of `threshold` on (exact arithmetic).  component_id is the smallest doc_id that links reach.
    Repeated rows and copies share a component; a null doc_id takes its group's smallest id, or stays null alone.
    """
    join = JaccardJoin(docs, words, Fraction(threshold))
    return grouped(join.nodes, join.links())


def grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    of = components(links)
    rooted = written(nodes.select("doc_id", "n", "node").join(of, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root")))
    smallest = rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rooted.join(smallest, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def set_apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` whose doc_id is surely not one of `ids`, and the few others.  Which are which is told by a
    table of bits, a few for each of `ids`, so that no text moves but those of the second part."""
    size = 1 << min(MOST_MARKS, max(10, (MARKS * ids.count()).bit_length()))
    word, bits = unused(docs, "word", "bits")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    mark = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {size}L) % 64 as int))")
    marks = written(ids.select(F.shiftright(at, 6).alias(word), mark.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits)))
    told = docs.withColumn(word, F.shiftright(at, 6)).join(F.broadcast(marks), word, "left")
    met = F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(mark) != 0
    return told.where(~met).select(*docs.columns), told.where(met).select(*docs.columns)


def one_of_each(docs: DataFrame, words: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """The rows of `docs`, all columns, whose doc_id is the smallest of its group.  Rows without words or with a null id
    belong to no group and stay.  Rows that repeat an id are judged together, and of those with equal texts one stays."""
    groups = written(jaccard_groups(docs, words, threshold).where(F.col("doc_id").isNotNull()))
    gone = written(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    again = written(groups.groupBy("doc_id").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("doc_id"))
    rest, judged = set_apart(docs, gone.unionByName(again))
    kept = judged.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if again.take(1):
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    return rest.unionByName(kept)

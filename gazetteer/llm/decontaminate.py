"""Benchmark decontamination by a prefix-filtered join, with DataFrame functions only.

An item's windows are its runs of `WINDOW` words (an item of fewer words is one window).  A document that holds a window
holds every word of it, so the overlap needed is the whole window and the necessary prefix of a window, its words ordered
by rarity in the documents, is its single rarest word.  Documents' words are joined with these prefix words; a candidate
must leave room for the window around that position (positional and length bounds); then the window's words are compared
in place, which is exact.

The windows are joined as a broadcast table only while they number at most `MOST_BROADCAST`.  Beyond that the
documents' words are shuffled to the windows and candidates are joined with their texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, unused, written

#: Words in a window.
WINDOW = 10
#: Most windows, or benchmark words, that are broadcast: some 60 MB at ten words a window.
MOST_BROADCAST = 200_000
#: ... and, all together, have at most so many bytes.
MOST_BYTES = 32 << 20

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in order: runs of a-z, 0-9 and non-ASCII characters once A-Z are lower-cased; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): the distinct windows of all items."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("words")).distinct()


def rarest_first(windows: DataFrame, doc_words: DataFrame, small: bool) -> DataFrame:
    """The windows with their prefix: `token`, the window's rarest word in the documents, and `offset`, its first place."""
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    spoken = doc_words.select(F.explode("w").alias("word"))
    counts = spoken.join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    places = windows.withColumn("window", F.xxhash64("item_id", "words")).select("item_id", "words", "window", F.posexplode("words").alias("offset", "word"))
    # A word that no document holds has count 0: such a window has no candidate at all.
    ranked = places.join(counts, "word", "left").groupBy("item_id", "words", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("first"))
    return ranked.where(F.col("first.n") > 0).select("item_id", "words", F.col("first.word").alias("token"), F.col("first.offset").alias("offset"), F.size("words").alias("length"))


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """For each row of `docs` (row, doc_id, text; `row` tells rows apart) one row with `start` null that carries doc_id and
    n_words, and one row for each occurrence of an item's window in it: row, doc_id, n_words, item_id, start, length (in
    words, start from 0)."""
    windows = written(item_windows(items, window))
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0))).first()
    small = n <= most_broadcast and size <= MOST_BYTES
    worded = docs.select("row", "doc_id", words_of(F.col("text")).alias("w"))
    prefix = written(rarest_first(windows, worded, small))
    base = (F.col("word").isNull()).alias("base")
    if small:
        # The last word is null: it stands for the document itself, and joins with nothing.
        each = worded.select("row", "doc_id", "w", F.posexplode(F.array_append("w", F.lit(None).cast("string"))).alias("at", "word"))
        found = each.join(F.broadcast(prefix.hint("broadcast")), F.col("word") == F.col("token"), "left").where(F.col("token").isNotNull() | F.col("word").isNull())
        start = F.col("at") - F.col("offset")
        fits = (start >= 0) & (start + F.col("length") <= F.size("w"))
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.coalesce("length", F.lit(0))) == F.col("words")
        return found.where(F.col("word").isNull() | (fits & same)).select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "item_id", F.when(~base, start).alias("start"), "length")
    worded = written(worded)  # `row` must be the same on both sides of the join
    each = worded.select("row", F.posexplode("w").alias("at", "word"))
    candidates = each.join(prefix, F.col("word") == F.col("token")).where(F.col("at") >= F.col("offset")).select("row", "item_id", "words", "length", (F.col("at") - F.col("offset")).alias("start"))
    full = worded.join(candidates, "row").where((F.col("start") + F.col("length") <= F.size("w")) & (F.slice("w", F.col("start") + 1, F.col("length")) == F.col("words")))
    alone = worded.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"))
    return alone.unionByName(full.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "item_id", "start", "length"))


def covered(spans: Column) -> Column:
    """How many places an array of (start, end) covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of `docs` (doc_id, text).

    A null text has no words and is clean; repeated rows get a row each; an item that repeats counts once; null item
    texts have no windows; without items all documents are clean.  A text's hits meet in the task of that text.
    """
    hits = window_hits(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), items, window, most_broadcast)
    span = F.when(F.col("start").isNotNull(), F.struct(F.col("start").alias("start"), (F.col("start") + F.col("length")).alias("end")))
    each = hits.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    n_hit = covered(F.col("spans"))
    return each.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no window of any item.

    Hits are told by two hashes of the text, as equal texts have equal hits.  While they are few the documents are
    filtered where they are read; beyond `most_broadcast` they are shuffled to the hits.  Null texts and texts without
    words hold nothing and stay, as do all without items; equal texts stay or go together.  No rows give no rows.
    """
    key = F.struct(F.xxhash64("text").alias("a"), F.crc32(F.col("text").cast("binary")).alias("b"))
    hits = window_hits(docs.select(key.alias("row"), "doc_id", "text"), items, window, most_broadcast).where(F.col("start").isNotNull())
    hits = written(hits.select(F.col("row").alias("_hit_text")).distinct())
    own = unused(docs, "_hit_text")[0]
    gone = F.broadcast(hits) if hits.count() <= most_broadcast else hits
    return docs.withColumn(own, key).join(gone.withColumnRenamed("_hit_text", own), own, "left_anti").select(*docs.columns)

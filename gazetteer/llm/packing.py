"""Packing tokenised documents into fixed-length sequences by cutting stock with column generation.

A document's tokens are cut into full sequences and one remainder.  The remainders' lengths, in classes of `GRAIN`
tokens, form a histogram; a linear program finds how often each pattern of classes should fill a sequence.  Its columns
are generated: a knapsack dynamic program over the dual prices finds the pattern that helps most, until none helps more
than `GAP`.  The solution is rounded down, what is left is packed first-fit decreasing, and the patterns' slots are
dealt out to the documents by their rank in their class.

The program sees only the histogram, whose size is fixed, so it runs on the driver at any input size.  Ranks come from
counts by partition and class.  Tokens never leave the task that made them; a row of a few numbers a piece does.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import written

#: Tokens in a sequence, and in a length class (it must divide the sequence).
SEQUENCE, GRAIN = 4096, 8
#: The program stops when its bound is within this share of its value, or after so many columns.
GAP, MOST_COLUMNS = 5e-4, 4000
#: Words kept with their ids by a worker, in each of two generations: when the younger is full it becomes the older, and a
#: word that is met again comes back, so frequent words stay.
MOST_CACHED = 150_000


# --- the linear program ------------------------------------------------------------------------------------------------


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes that fits the capacity: unbounded knapsack by dynamic programming."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, p = sizes[order], prices[order]
    for w in range(1, capacity + 1):
        k = np.searchsorted(s, w, side="right")
        value[w] = value[w - 1]
        if k:
            got = value[w - s[:k]] + p[:k]
            i = int(got.argmax())
            if got[i] > value[w] + 1e-12:
                value[w], took[w] = got[i], i
    pattern, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[order[took[w]]] += 1
            w -= s[took[w]]
    return float(value[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each size) and how often each is used: together they hold `demand` items of each size, with
    near the fewest bins.  Revised simplex with a maintained inverse; one new column a step.  Rounding errors can only cost
    bins: what is used never exceeds the demand, and the rest is packed anyway."""
    times = lambda a, v: np.einsum("ij,j->i", a, v)  # noqa: E731  small: a library's threads would only wait for each other
    m = len(sizes)
    if not m:
        return []
    columns = [np.where(np.arange(m) == i, capacity // sizes[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / np.array([c.sum() for c in columns], float))
    x = times(inverse, demand)
    for _ in range(MOST_COLUMNS):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(sizes, prices, capacity)
        if worth <= 1 + 1e-9 or x.sum() * (1 - 1 / worth) <= GAP * x.sum():
            break
        move = times(inverse, pattern)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-10, x / move, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        columns[out] = pattern
        x = np.maximum(times(inverse, demand), 0)
    left, used = demand.copy(), []
    for j in np.argsort(-x, kind="stable"):
        # never more often than the pattern's items are there
        fits = min((left[i] // columns[j][i] for i in np.flatnonzero(columns[j])), default=0)
        if (n := int(min(np.floor(x[j] + 1e-9), fits))) > 0:
            used.append((columns[j], n))
            left = left - n * columns[j]
    return used + first_fit(sizes, left, capacity)


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """What rounding leaves: bins filled with the largest sizes that still fit."""
    left, used, order = left.copy(), [], np.argsort(-sizes)
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i in order:
            n = min(left[i], room // sizes[i])
            pattern[i], room = n, room - n * sizes[i]
        times = int(min(left[i] // pattern[i] for i in np.flatnonzero(pattern)))
        used.append((pattern, times))
        left -= times * pattern
    return used


@dataclass
class Plan:
    """For each class the runs of ranks: first rank, first sequence, sequences of the run, first slot."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def place(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for c in np.unique(classes):
            first, base, times, at = self.runs[int(c)]
            mine = classes == c
            k = np.searchsorted(first, ranks[mine], side="right") - 1
            t = ranks[mine] - first[k]
            sequence[mine], slot[mine] = base[k] + t % times[k], at[k] + t // times[k]
        return sequence, slot


def plan_of(histogram: dict[int, int], capacity: int) -> Plan:
    """Where each rank of each class goes; a class of the whole capacity fills sequences alone."""
    sizes = np.array(sorted(histogram), np.int64)
    whole = histogram.get(capacity, 0)
    sizes = sizes[sizes < capacity]
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    held: dict[int, list[tuple[int, int, int, int]]] = {capacity: [(0, 0, max(whole, 1), 0)]}
    given, base = dict.fromkeys(map(int, sizes), 0), whole
    for pattern, times in cutting_stock(sizes, demand, capacity):
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            s, a = int(sizes[i]), int(pattern[i])
            held.setdefault(s, []).append((given[s], base, times, slot))
            given[s] += a * times
            slot += a
        base += times
    return Plan({c: tuple(np.array(x, np.int64) for x in zip(*runs)) for c, runs in held.items()})

#: A single closing mark between a letter or digit and white space: a token of its own to tokenizers that part letters,
#: digits and marks.
_MARK = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \t\n\r\x0b\x0c])")


# --- tokens ------------------------------------------------------------------------------------------------------------


class WordTokens:
    """Token ids of words as little-endian bytes, for a tokenizer that drops white space and never joins across it."""

    _own: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """The worker's own, which its next tasks find with the words it has met."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        # Where capitals and a closing mark's place make no difference, fewer words are distinct.
        one, other = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("Words, Ends. X9, \u00c9a. ", "words , ends . x9 , \u00c9a . "))
        self.folds = one == other
        # Words of small letters alone are what they are after normalising and splitting.
        self.unit_split = self._split_pattern(path) if self.folds else None
        if self.unit_split:
            self.units, vocabulary = Tokenizer.from_file(path), self.tokenizer.get_vocab()
            self.units.normalizer, self.units.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(self.suffix)]] = True

    def _split_pattern(self, path: str):
        """The pattern that parts text before a byte-level model whose tokens mark where such a part ends; None for any other
        kind of tokenizer, whose words are encoded one by one."""
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if not self.suffix or spec["model"]["type"] != "BPE" or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return None
        split, level = steps
        if not split["invert"] or split["behavior"] != "Removed" or "Regex" not in split["pattern"] or level["add_prefix_space"] or level["use_regex"]:
            return None
        return regex.compile(split["pattern"]["Regex"])

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn_units(self, parts: list[bytes]) -> None:
        """Puts the tokens of parts that the model takes whole among the known words: many go to the model in one text, and
        the tokens that end a part tell where the next begins."""
        flat = np.concatenate([np.array(e.ids, "<u4") for e in self.units.encode_batch_fast([_byte_text(b" ".join(parts[a : a + 256])) for a in range(0, len(parts), 256)], add_special_tokens=False)])
        cuts = np.flatnonzero(self.ends[flat]) + 1
        if len(cuts) != len(parts) or cuts[-1] != len(flat):
            raise ValueError("the tokenizer's parts do not end where its tokens say")
        raw, at = flat.tobytes(), (cuts * 4).tolist()
        self.known.update(zip(parts, map(raw.__getitem__, map(slice, [0, *at[:-1]], at))))

    def _learn(self, words: list[bytes]) -> None:
        known = self.known
        if not self.unit_split:
            known.update(zip(words, self._one_by_one(words)))
            return
        plain, rest, alone = [], [], []
        for w in words:
            if w.isalpha() and w.islower():  # of bytes: ASCII only
                plain.append(w)
            elif b"<|" in w:
                alone.append(w)
            else:
                u = w.decode("utf-8", "replace")
                (plain if u.isalpha() and u.lower() == u and unicodedata.is_normalized("NFC", u) else rest).append(w)
        if plain:
            self._learn_units(plain)
        whole = []
        for a in range(0, len(rest), 256):
            some = rest[a : a + 256]
            normal = self.tokenizer.normalizer.normalize_str(" ".join(w.decode("utf-8", "replace") for w in some)).split(" ")
            if len(normal) == len(some):
                whole += [(w, [p.encode() for p in self.unit_split.findall(n)]) for w, n in zip(some, normal)]
            else:  # a word that holds or becomes white space
                alone += some
        if new := list({p for _, parts in whole for p in parts}.difference(known)):
            self._learn_units(new)
        known.update((w, b"".join(map(known.__getitem__, parts))) for w, parts in whole)
        if alone:
            known.update(zip(alone, self._one_by_one(alone)))

    def encode(self, raws: list[bytes]) -> list[bytes]:
        texts = [(_MARK.sub(rb" \1", r.lower()) if self.folds and b"<|" not in r else r).split() for r in raws]
        if len(self.known) > MOST_CACHED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set().union(*texts).difference(known)
        again = new.intersection(older)
        known.update((w, older[w]) for w in again)
        if new := list(new.difference(again)):
            self._learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in texts]


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models write bytes with: printable ones stand for themselves, the others, in order, for
    the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)} | {32: " "}


_LETTERS = _byte_letters()


def _byte_text(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_LETTERS)


def _pieces(path: str, end: int, sequence: int, grain: int):
    """A row for each piece: where it is in its document, its checksum, its class, and its rank in its class and task."""

    def run(batches):
        from pyspark import TaskContext

        gc.disable()  # words and tokens are bytes, which hold no cycles; looking through a large cache for some takes time
        part, tokens, tail = TaskContext.get().partitionId(), WordTokens.of(path), np.array([end], "<u4").tobytes()
        ranks = np.zeros(sequence // grain + 1, np.int64)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "class", "rank"]
        for batch in tb.slices(batches):
            rows: list[list] = [[] for _ in names]
            ids = batch.column("doc_id").to_pylist()
            for a, _, raws in tb.batches(batch.column("text").to_pylist(), lower=False):
                for i, got in enumerate(tokens.encode(raws)):
                    got += tail
                    n, view = len(got) // 4, memoryview(got)
                    for start in range(0, n, sequence):
                        length = min(sequence, n - start)
                        c = -(-length // grain)
                        for column, value in zip(rows, (ids[a + i], start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n, part, c, ranks[c])):
                            column.append(value)
                        ranks[c] += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field("doc_id").type), *(pa.array(r, pa.int64()) for r in rows[1:])], names)
        gc.enable()

    return run


def _placed(plan: Plan):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sequence, slot = plan.place(batch.column("class").to_numpy(), batch.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)], [*batch.schema.names, "sequence_id", "slot"])

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 2, sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """A row for each piece of each row of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document's tokens are the ids of the tokenizer in file `tokenizer` (one whose words end at white space), then `end`;
    a null text is empty and has only `end`.  A document longer than a sequence gives full sequences and a remainder.
    Repeated rows are packed one by one.  No rows give no rows; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "part", "class", "rank"]
    schema = f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names)
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end, sequence, grain), schema))
    counts = written(pieces.groupBy("part", "class").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("class").agg(F.sum("n")).collect()}  # one row a class
    plan = plan_of(histogram, sequence // grain)
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "class", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "class"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank")
    placed = ranked.mapInArrow(_placed(plan), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, class long, rank long, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))

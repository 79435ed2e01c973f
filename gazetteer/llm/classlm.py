"""Scoring with a class-based bigram model over Brown classes.

The probability of a token is that of its class after the class before it, times that of the token in its class.  Words
are assigned to classes by the exchange algorithm: a word moves to the class that raises the likelihood of the training
text most.  It begins, sweep after sweep, with the most frequent words and, for all others, their endings.  Then every
other word that occurs `LEAST` times is moved by its own counts of classes before and after it, all words of a round at
once, and a round stays if the likelihood has risen.  Words too rare for that have their ending's class, and a
probability in its unit by their count.  Words that training has not seen have, all together, as much of their unit as
words seen once (Good-Turing), shared among as many as there may be (Chao's estimate from words seen once and twice, and
no fewer than those seen once), so an unseen word is never likelier than one seen once.

All counts cover all training texts.  The clustered words, with classes and counts, go to every task (17 bytes a word);
counts of the rare words stay distributed and meet the tokens that need them in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import discard, remainder, written

#: Most frequent words, endings, and classes of the clustering.
HEADS, ENDINGS, CLASSES, SWEEPS = 768, 255, 64, 5
#: Occurrences from which a word is clustered by its own counts, and rounds in which that is done.
LEAST, ROUNDS = 32, 2
#: A task's counts are passed on when it holds so many different words, and texts are read in pieces of so many bytes.
MOST_HELD, PIECE = 1 << 19, 1 << 18

END = np.uint64(0x454E44)  # the end token's hash; a word's is mixed, so a clash is as unlikely as between two words
END_CODE = -1


def _tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ending codes of the tokens of all texts, each text's end token included, and where texts begin."""
    buf, starts, ends, hashes, bounds = tb.words(raws)
    code = np.zeros(len(starts), np.int64)
    for back in (1, 2, 3):
        at = ends - back
        code = code * 256 + np.where(at >= starts, buf[np.maximum(at, 0)], 0)
    at = bounds[1:]
    n = np.arange(len(raws) + 1)
    return np.insert(hashes, at, END), np.insert(code, at, END_CODE), bounds + n


def _count():
    """(kind, key, code, n): kind 0 counts words by hash, kind 1 endings by code, of all training texts of the task."""

    def rows(kind: int, key: np.ndarray, code: np.ndarray, n: np.ndarray):
        for a in range(0, len(key), 1 << 18):
            k = slice(a, a + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[k]), kind, np.int8)), pa.array(key[k]), pa.array(code[k]), pa.array(n[k])], ["kind", "key", "code", "n"])

    def merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        key, code, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, code, n = key[order], code[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], code[first], np.add.reduceat(n, first)

    def run(batches):
        held, size, endings = [], 0, {}
        for batch in tb.slices(batches):
            for _, _, raws in tb.batches(batch.column("text").to_pylist(), PIECE):
                hashes, code, _ = _tokens(raws)
                held.append(merged([(hashes.view(np.int64), code, np.ones(len(code), np.int64))]))
                for c, n in zip(*np.unique(code, return_counts=True)):
                    endings[int(c)] = endings.get(int(c), 0) + int(n)
                size += len(held[-1][0])
                if size > MOST_HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > MOST_HELD // 2:
                        yield from rows(0, *held[0])
                        held, size = [], 0
        if held:
            yield from rows(0, *merged(held))
        if endings:
            keys = np.fromiter(endings, np.int64)
            yield from rows(1, keys, keys, np.fromiter(endings.values(), np.int64))

    return run


@dataclass
class Units:
    """The clustering's units: unit 0 is what is left, then heads by hash, then endings by code."""

    heads: np.ndarray  # sorted hashes
    endings: np.ndarray  # sorted codes

    @property
    def n(self) -> int:
        return 1 + len(self.heads) + len(self.endings)

    def of(self, hashes: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.where((h := _place(self.heads, hashes)) >= 0, 1 + h, 1 + len(self.heads) + np.where((e := _place(self.endings, code)) >= 0, e, -1 - len(self.heads)))


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value is in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, i, -1)


def _bigrams(units: Units):
    """(pair, n): counts of neighbouring units in the task's texts; an end token stands before each text."""

    def run(batches):
        counts = np.zeros(units.n * units.n, np.int64)
        for batch in tb.slices(batches):
            for _, _, raws in tb.batches(batch.column("text").to_pylist(), PIECE):
                hashes, code, _ = _tokens(raws)
                unit = units.of(hashes, code)
                end = units.of(np.array([END]), np.array([END_CODE]))
                counts += np.bincount(np.concatenate([end, unit[:-1]]) * units.n + unit, minlength=len(counts))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["pair", "n"])

    return run


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each unit: starting from classes by rank, each unit in turn moves to the class that gives the largest
    sum of n log n over class pairs less twice that over classes."""
    n = len(counts)
    k = min(classes, n)
    total = counts.sum(axis=0) + counts.sum(axis=1)
    of = np.empty(n, np.int64)
    of[np.argsort(-total, kind="stable")] = np.arange(n) % k
    one = np.zeros((n, k))
    one[np.arange(n), of] = 1
    pair = one.T @ counts @ one
    to, by = counts @ one, counts.T @ one  # unit before class; class before unit

    def h(x):
        return x * np.log(np.maximum(x, 1))

    left, right = pair.sum(axis=1), pair.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for u in np.argsort(-total, kind="stable"):
            a, self_n = of[u], counts[u, u]
            t, b = to[u].copy(), by[u].copy()
            t[a] -= self_n  # neighbours other than the unit itself
            b[a] -= self_n
            pair[a, :] -= t
            pair[:, a] -= b
            pair[a, a] -= self_n
            out, into = t.sum() + self_n, b.sum() + self_n
            left[a] -= out
            right[a] -= into
            # the gain of putting the unit into each class: its row and column, and the corner where they meet
            base = h(pair)
            gain = (h(pair + t[None, :]) - base).sum(axis=1) + (h(pair + b[:, None]) - base).sum(axis=0)
            corner = np.diag(pair)
            gain += h(corner + t + b + self_n) - h(corner + t) - h(corner + b) + h(corner)
            gain -= h(left + out) - h(left) + h(right + into) - h(right)
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = a
            pair[best, :] += t
            pair[:, best] += b
            pair[best, best] += self_n
            left[best] += out
            right[best] += into
            if best != a:
                moved += 1
                of[u] = best
                to[:, a] -= counts[:, u]
                to[:, best] += counts[:, u]
                by[:, a] -= counts[u]
                by[:, best] += counts[u]
        if not moved:
            break
    return of


def _h(x):
    return x * np.log(np.maximum(x, 1))


def _likelihood(pair: np.ndarray) -> float:
    """Of a table of class pairs, but for what no assignment changes."""
    return float(_h(pair).sum() - _h(pair.sum(axis=0)).sum() - _h(pair.sum(axis=1)).sum())


@dataclass
class Classes:
    """Clustered words by hash, sorted, with their classes; all other words' classes by their endings' units."""

    hashes: np.ndarray
    of: np.ndarray  # class of word
    rest: Units  # no heads
    of_rest: np.ndarray  # class of ending's unit
    k: int

    def find(self, hashes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its place among the clustered words or -1, its ending's unit and its class."""
        at, unit = _place(self.hashes, hashes), self.rest.of(hashes, code)
        return at, unit, np.where(at >= 0, self.of[at], self.of_rest[unit]).astype(np.int64)


def _contexts(shared, words: bool):
    """(word, ctx, n): for the clustered words that are no heads counts by class after the word (ctx from 0), class before
    it (from k), and of the word after itself (2k), which the others leave out; for a pair of classes word is -1 - pair."""

    def rows(keys: np.ndarray, n: np.ndarray, width: int):
        for a in range(0, len(keys), 1 << 18):
            k = keys[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array((k // width).astype(np.int32)), pa.array((k % width).astype(np.int16)), pa.array(n[a : a + (1 << 18)])], ["word", "ctx", "n"])

    def merged(held):
        key, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[first], np.add.reduceat(n, first) if len(first) else n

    def run(batches):
        known, moves = shared.value
        k = known.k
        width, pairs = 2 * k + 1, np.zeros(k * k, np.int64)
        held, size = [], 0
        end = [x[0] for x in known.find(np.array([END]), np.array([END_CODE]))]
        for batch in tb.slices(batches):
            for _, _, raws in tb.batches(batch.column("text").to_pylist(), PIECE):
                at, _, c = known.find(*_tokens(raws)[:2])
                pairs += np.bincount(np.append(end[2], c[:-1]) * k + c, minlength=k * k)
                if not words:
                    continue
                before, after = np.append(end[0], at[:-1]), at
                own = (before == after) & (before >= 0)
                cb = np.append(end[2], c[:-1])
                one = (after >= 0) & moves[after] & ~own
                two = (before >= 0) & moves[before] & ~own
                own &= moves[after]
                keys = np.concatenate([after[one] * width + k + cb[one], before[two] * width + c[two], after[own] * width + 2 * k])
                held.append(merged([(keys, np.ones(len(keys), np.int64))]))
                size += len(held[-1][0])
                if size > MOST_HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > MOST_HELD // 2:
                        yield from rows(*held[0], width)
                        held, size = [], 0
        if held:
            yield from rows(*merged(held), width)
        met = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array((-1 - met).astype(np.int32)), pa.array(np.zeros(len(met), np.int16)), pa.array(pairs[met])], ["word", "ctx", "n"])

    return run


def best_classes(pair: np.ndarray, own: np.ndarray, word: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For words of the classes `own` the class with the largest likelihood, as in `exchange`, the other words staying
    where they are.  Entries (word, ctx, n) are sorted by word, which counts from 0, with contexts as in `_contexts`."""
    k, w = len(pair), len(own)
    whole = np.zeros((w, 2 * k + 1))
    whole[word, ctx] = n
    t, b, self_n = whole[:, :k], whole[:, k : 2 * k], whole[:, 2 * k]
    gain, each = np.zeros((w, k)), np.arange(w)
    for first, table, mine, other in ((0, pair.T, t, b), (k, pair, b, t)):
        at, c = np.nonzero(mine)
        if not len(at):
            continue
        add = mine[at, c]
        rest = table[c].astype(float)  # the pair counts without the word
        rest[np.arange(len(at)), own[at]] -= add
        same = np.flatnonzero(c == own[at])
        rest[same] -= other[at[same]]
        rest[same, own[at[same]]] -= self_n[at[same]]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        gain[at[starts]] += np.add.reduceat(_h(rest + add[:, None]) - _h(rest), starts, axis=0)
    corner = np.repeat(np.diag(pair)[None, :].astype(float), w, axis=0)
    corner[each, own] -= t[each, own] + b[each, own] + self_n
    s = self_n[:, None]
    gain += _h(corner + t + b + s) - _h(corner + t) - _h(corner + b) + _h(corner)
    for axis, out in ((1, t.sum(axis=1) + self_n), (0, b.sum(axis=1) + self_n)):
        side = np.repeat(pair.sum(axis=axis)[None, :].astype(float), w, axis=0)
        side[each, own] -= out
        gain -= _h(side + out[:, None]) - _h(side)
    best = gain.argmax(axis=1)
    return np.where(gain[each, best] > gain[each, own] + 1e-9, best, own)


def _moved(shared):
    """(word, class) of the words that move."""

    def run(batches):
        pair, of = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                words = batch.column("word").to_numpy()
                sizes = batch.column("contexts").value_lengths().to_numpy()
                flat = batch.column("contexts").flatten()
                ctx, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                own = of[words].astype(np.int64)
                best = best_classes(pair, own, np.repeat(np.arange(len(words)), sizes), ctx, n)
                go = best != own
                yield pa.RecordBatch.from_arrays([pa.array(words[go]), pa.array(best[go].astype(np.int32))], ["word", "to"])

    return run


def _clustered(docs: DataFrame, known: Classes, heads: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each clustered word after the rounds, and the counts of class pairs; heads stay where they are."""
    spark, texts, best = docs.sparkSession, docs.select("text"), None
    moves = _place(heads, known.hashes) < 0
    rounds = rounds if moves.any() else 0
    for r in range(rounds + 1):
        shared = spark.sparkContext.broadcast((known, moves))
        found = texts.mapInArrow(_contexts(shared, r < rounds), "word int, ctx short, n long")
        told = written(found.groupBy("word", "ctx").agg(F.sum("n").alias("n")))
        pairs = told.where("word < 0").select("word", "n").toPandas()  # at most classes squared
        pair = np.zeros(known.k * known.k)
        pair[-1 - pairs["word"].to_numpy(np.int64)] = pairs["n"].to_numpy()
        pair = pair.reshape(known.k, known.k)
        rose = best is None or _likelihood(pair) > _likelihood(best[1])
        if rose:
            best = known.of, pair
        if r < rounds and rose:
            sent = spark.sparkContext.broadcast((pair, known.of))
            each = told.where("word >= 0").groupBy("word").agg(F.collect_list(F.struct("ctx", "n")).alias("contexts"))  # 2k + 1 at most
            go = each.mapInArrow(_moved(sent), "word int, to int").toPandas()
            of = known.of.copy()
            of[go["word"].to_numpy(np.int64)] = go["to"].to_numpy()
            known = Classes(known.hashes, of, known.rest, known.of_rest, known.k)
        discard(told)
        shared.unpersist()
        if not rose:
            break
    return best


@dataclass
class ClassModel:
    """Everything that scoring needs but the rare words' counts."""

    known: Classes
    counts: np.ndarray  # of the clustered words
    step: np.ndarray  # log10 of class after class
    total: np.ndarray  # log10 of a class's tokens
    emit: np.ndarray  # log10 of an ending's unit in its class
    mass: np.ndarray  # tokens of an ending's rare words, what all unseen words have beside them, and what one has
    unseen: np.ndarray
    one_unseen: np.ndarray
    tokens: int
    kinds: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + self.kinds + 1.0))


def train(docs: DataFrame, heads: int = HEADS, endings: int = ENDINGS, classes: int = CLASSES, least: int = LEAST, rounds: int = ROUNDS) -> tuple[ClassModel, DataFrame]:
    """The model of the texts of `docs`, and the table (key, n) of all words' counts by hash."""
    told = written(docs.select("text").mapInArrow(_count(), "kind byte, key long, code long, n long").groupBy("kind", "key").agg(F.first("code").alias("code"), F.sum("n").alias("n")))
    words = told.where("kind = 0")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = [r[0] for r in words.orderBy(F.desc("n"), "key").limit(heads).select("key").collect()]
    ends = [r[0] for r in told.where("kind = 1 and key >= 0").orderBy(F.desc("n"), "key").limit(endings).select("key").collect()]
    head = np.unique(np.concatenate([np.array(top, np.int64).view(np.uint64), [END]]).astype(np.uint64))
    units = Units(head, np.array(sorted(ends), np.int64))
    bigrams = docs.select("text").mapInArrow(_bigrams(units), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most units squared
    counts = np.zeros(units.n * units.n)
    counts[bigrams["pair"].to_numpy(np.int64)] = bigrams["n"].to_numpy()
    of = exchange(counts.reshape(units.n, units.n), classes)
    del counts, bigrams
    small = F.broadcast(docs.sparkSession.createDataFrame([(int(k),) for k in head.view(np.int64)], "key long"))
    often = words.where(F.col("n") >= least).select("key", "n").unionByName(words.where(F.col("n") < least).join(small, "key", "left_semi").select("key", "n")).toPandas()
    key, n = often["key"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    if END not in key:  # without training texts
        key, n = np.append(key, END), np.append(n, 0)
    order = np.argsort(key)
    key, n = key[order], n[order]
    rest = Units(np.zeros(0, np.uint64), units.endings)
    of_rest = np.append(of[0], of[1 + len(head) :])
    # words begin in their endings' classes, heads in their own
    codes = words.where(F.col("n") >= least).select("key", "code").toPandas()
    code = np.full(len(key), END_CODE)
    code[_place(key, codes["key"].to_numpy(np.int64).view(np.uint64))] = codes["code"].to_numpy(np.int64)
    at = _place(head, key)
    first = np.where(at >= 0, of[1 + at], of_rest[rest.of(key, code)]).astype(np.int8 if of.max() < 128 else np.int16)
    del often, codes
    known = Classes(key, first, rest, of_rest, int(of.max()) + 1)
    moved, pair = _clustered(docs, known, head, rounds)
    known = Classes(key, moved, rest, of_rest, known.k)
    alone = pair.sum(axis=0) + 0.5
    alone /= alone.sum()
    kinds_after = (pair > 0).sum(axis=1, keepdims=True) + 1  # Witten-Bell: as much goes to the class alone
    step = (pair + kinds_after * alone[None, :]) / (pair.sum(axis=1, keepdims=True) + kinds_after)
    # the tokens of the words that are not clustered, and the words seen once, by unit
    ending = F.create_map(*[F.lit(x) for i, c in enumerate(rest.endings) for x in (int(c), 1 + i)])[F.col("code")] if len(rest.endings) else F.lit(None).cast("int")
    rare = words.where(F.col("n") < least).join(small, "key", "left_anti").groupBy(F.coalesce(ending, F.lit(0)).alias("unit")).agg(F.sum("n"), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).collect()  # one row a unit
    mass, unseen, one_unseen = np.zeros(rest.n), np.full(rest.n, 0.5), np.full(rest.n, 0.5)
    for u, m, once, twice in rare:
        mass[u], unseen[u] = m, once + 0.5
        one_unseen[u] = unseen[u] / max(once * (once - 1) / (2 * (twice + 1)), once + 0.5)
    share = mass + unseen  # of a unit, in tokens: so a class's words and its unseen words add up to one
    total = np.bincount(moved, np.maximum(n, 0.5), known.k) + np.bincount(of_rest, share, known.k)
    return ClassModel(known, n, np.log10(step), np.log10(np.maximum(total, 0.5)), np.log10(share / total[of_rest]), mass, unseen, one_unseen, int(tokens), int(kinds)), words.select("key", "n")


def _score(shared):
    """A row for each text (kind 0: its id and tokens, and what is known here of its sums), and one for each different rare
    word of a text (kind 1: hash, unit, times).  Texts are numbered by task and place."""

    def run(batches):
        from pyspark import TaskContext

        model, row = shared.value, TaskContext.get().partitionId() << 40
        names = ["kind", "row", "doc_id", "held_out", "key", "unit", "times", "base", "score"]
        for batch in tb.slices(batches):
            for a, b, raws in tb.batches(batch.column("text").to_pylist(), PIECE):
                hashes, code, bounds = _tokens(raws)
                at, unit, c = model.known.find(hashes, code)
                before = np.roll(c, 1)
                before[bounds[:-1]] = model.known.find(np.array([END]), np.array([END_CODE]))[2][0]
                found = at >= 0
                count = np.where(found, model.counts[at], 0)
                score = model.step[before, c] + np.where(found, np.log10(np.maximum(count, 0.5)) - model.total[c], model.emit[unit])
                sums = lambda x: np.add.reduceat(x, bounds[:-1])
                n, rows = np.diff(bounds), np.arange(row, row + b - a)
                row += b - a
                zero = pa.array(np.zeros(b - a, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(b - a, np.int8)), pa.array(rows), *(batch.column(x).slice(a, b - a) for x in ("doc_id", "held_out")), zero, pa.array(sums(found.astype(np.int64)).astype(np.int32)), pa.array(n), pa.array(sums(np.where(found, model.base(count), 0))), pa.array(sums(score))], names
                )
                rare = np.flatnonzero(~found)
                if len(rare):
                    text = np.repeat(np.arange(b - a), n)[rare]
                    order = np.lexsort((hashes[rare], text))
                    text, key, u = text[order], hashes[rare][order], unit[rare][order]
                    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])]))
                    times, zero = np.diff(np.append(first, len(text))), np.zeros(len(first))
                    none = [pa.nulls(len(first), batch.column(x).type) for x in ("doc_id", "held_out")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(first), np.int8)), pa.array(rows[text[first]]), *none, pa.array(key[first].view(np.int64)), pa.array(u[first].astype(np.int32)), pa.array(times), pa.array(zero), pa.array(zero)], names)

    return run


def score_documents(docs: DataFrame, held_out: Column, learned: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs` (doc_id, text).

    The model learns from the rows where `learned` holds.  A null or empty text is one end token.  Repeated rows count
    again in training and are scored alike.  Without training rows every token is unseen.  Words are told apart by
    64-bit hashes.  No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    model, words = train(docs.where(learned))
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", held_out.alias("held_out"), "text")
    told = written(own.mapInArrow(_score(shared), f"kind byte, row long, doc_id {id_type}, held_out boolean, key long, unit int, times long, base double, score double"))
    rare = told.where("kind = 1").select("row", "key", "unit", "times").join(words, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # a unit's mass and unseen words, as a table of one row a unit
    facts = spark.createDataFrame([(i, float(m), float(u), float(o)) for i, (m, u, o) in enumerate(zip(model.mass, model.unseen, model.one_unseen))], "unit int, mass double, unseen double, one double")
    in_unit = F.log10(F.when(F.col("n") > 0, F.col("n").cast("double")).otherwise(F.col("one")) / (F.col("mass") + F.col("unseen")))
    of_rare = (
        rare.join(F.broadcast(facts), "unit")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("known"), F.sum(F.col("times") * F.log10((F.col("n") + 1.0) / F.lit(model.tokens + model.kinds + 1.0))).alias("rare_base"), F.sum(F.col("times") * in_unit).alias("rare_score"))
    )
    texts = told.where("kind = 0").select("row", "doc_id", "held_out", F.col("times").alias("n_tokens"), F.col("unit").cast("long").alias("here"), "base", "score")
    out = texts.join(of_rare, "row", "left")
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("here") + zero("known", 0)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("rare_base", 0.0)).alias("base_score"), (F.col("score") + zero("rare_score", 0.0)).alias("score"))


def score_all(docs: DataFrame) -> DataFrame:
    """All documents, learning from those whose crc32 of the id modulo 7 is not 2; a null id is neither held out nor
    learned from."""
    r = remainder(F.col("doc_id"), 7)
    return score_documents(docs, F.coalesce(r == 2, F.lit(False)), F.coalesce(r != 2, F.lit(False)))

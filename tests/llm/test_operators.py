"""The pipeline operators against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazetteer.llm import chat, classlm, decontaminate, jaccard, langid, neighbours, packing, quality, queries, sharding, urlfilter
from gazetteer.llm.graph import components

WORDS = [f"w{i}" for i in range(60)]


def text(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def near(base, seed):
    w = base.split()
    w[seed % len(w)] = f"x{seed}"
    return " ".join(w)


@pytest.fixture(scope="module")
def docs(spark):
    a, b = text(1, 80), text(2, 60)
    rows = [(1, a), (2, a), (3, near(a, 5)), (4, near(a, 40)), (5, b), (6, near(b, 3)), (7, None), (8, ""), (9, "  \n"), (10, "one"), (11, "One"), (12, text(3, 4000)), (13, text(4, 9)), (14, "ÉA b c"), (14, "ÉA b c"), (None, text(5, 30))]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", 0, "clash", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, node int")


def sets(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize(("n", "threshold"), [(3, "0.9"), (5, "0.8"), (2, "0.5")])
def test_jaccard_groups(docs, n, threshold):
    rows = [(r.doc_id, sets(r.text, n)) for r in docs.collect()]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if a and b and len(a & b) >= float(threshold) * len(a | b):
            up[find(i)] = find(j)
    least = {find(i): min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None) for i in range(len(rows))}
    want = sorted(((r[0], len(r[1]), least[find(i)]) for i, r in enumerate(rows)), key=str)
    assert sorted(map(tuple, jaccard.jaccard_groups(docs, n, threshold).collect()), key=str) == want


def test_one_of_each(docs):
    kept = jaccard.one_of_each(docs, 3, "0.9")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(14) == 1 and 2 not in ids and {1, 5, 7, 8, 9, 10, 12, 13, None} <= set(ids)


def test_one_of_each_moves_few_texts(spark):
    rows = [(i, f"only {i} here") for i in range(3000)] + [(5000 + i, f"only {i} here") for i in range(20)] + [(7, "other 7 there"), (7, "other 7 there"), (None, "only 1 here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard.one_of_each(df, 3, "0.9")
        kept = out.collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        store = spark._jsparkSession.sharedState().statusStore()
        runs = store.executionsList()
        last = runs.apply(runs.size() - 1).executionId()
        values, nodes, moved = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
        for i in range(nodes.size()):
            for j in range(nodes.apply(i).metrics().size()):
                m = nodes.apply(i).metrics().apply(j)
                if m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
                    moved += int(values.apply(m.accumulatorId()).replace(",", ""))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept) == sorted([(False, i, f"only {i} here") for i in range(3000)] + [(False, 7, "other 7 there"), (True, 0, "only 1 here")])
    assert 20 <= moved < 1000


def test_large_family_keeps_its_links(spark):
    base = text(9, 200)
    rows = [(i, near(base, i) if i else base) for i in range(300)]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, "0.9").collect()
    assert {r.component_id for r in got} == {0}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (3, 10)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 8: 8, 9: 8}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_contamination(spark, docs, broadcast):
    whole = {r.doc_id: r.text for r in docs.collect() if r.text}
    items = [(1, " ".join(whole[1].split()[10:35])), (2, "one"), (3, None), (4, "..."), (1, " ".join(whole[1].split()[10:35])), (5, whole[13])]
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), most_broadcast=broadcast)
    found = {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in got.collect()}
    assert {(1, 25, 1, True), (2, 25, 1, True), (4, 25, 1, True), (10, 1, 1, True), (11, 1, 1, True), (13, 9, 1, True), (7, 0, 0, False), (5, 0, 0, False)} <= found
    assert got.count() == docs.count()
    clean = decontaminate.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"), most_broadcast=broadcast)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {5, 6, 7, 8, 9, 12, 14, None} | {r[0] for r in found if r[0] == 3 and not r[3]}


def test_shards(docs):
    got = sharding.shard_documents(docs, 4).collect()
    size = {(r.doc_id, r.text_crc32): r.size for r in got}
    want = {(r.doc_id, zlib.crc32((r.text or "").encode())): len((r.text or "").encode()) + 8 for r in docs.collect()}
    assert size == want and len(got) == docs.count()
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, sequence=256).collect()
    used, pieces = {}, {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    for r in docs.where("doc_id <> 14").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[(r.doc_id, len(ids))], key=lambda p: p.start)
        assert sum(p.length for p in mine) == len(ids)
        for p in mine:
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32


def test_cutting_stock_is_near_the_bound():
    r = np.random.default_rng(3)
    sizes, demand = np.arange(1, 60), r.integers(50, 400, 59)
    used = packing.cutting_stock(sizes, demand, 64)
    assert all((p * sizes).sum() <= 64 for p, _ in used)
    assert (sum(p * n for p, n in used) == demand).all()
    assert sum(n for _, n in used) <= 1.02 * (sizes * demand).sum() / 64 + 20


def test_class_lm(spark):
    rows = [(i, text(i, 40)) for i in range(200)] + [(900, None), (901, "never seen words"), (None, "w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = classlm.score_all(df).collect()
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count: dict = {}
    for t in train:
        for w in [*(t or "").lower().split(), None]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        toks = [*(t or "").lower().split(), None]
        assert by[i].n_tokens == len(toks) and by[i].train_tokens == n and by[i].n_known == sum(w in count for w in toks)
        assert by[i].base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in toks))
        assert by[i].score < 0


def test_exchange_separates_two_languages():
    counts = np.kron(np.eye(2), np.ones((8, 8))) * 50 + 1
    of = classlm.exchange(counts, 2)
    assert len(set(of[:8])) == len(set(of[8:])) == 1 and of[0] != of[8]


def test_best_class_is_that_of_the_whole_likelihood():
    r = np.random.default_rng(4)
    n, k = 40, 5
    counts, of = r.integers(0, 6, (n, n)), r.integers(0, k, n)

    def table(own):
        one = np.eye(k)[own]
        return one.T @ counts @ one

    for u in range(n):
        others = np.delete(np.arange(n), u)
        t, b = (np.bincount(of[others], x[others], k) for x in (counts[u], counts[:, u]))
        whole = np.concatenate([t, b, [counts[u, u]]])
        got = classlm.best_classes(table(of), of[[u]], np.zeros(2 * k + 1, int), np.arange(2 * k + 1), whole)[0]
        assert got == np.argmax([classlm._likelihood(table(np.where(np.arange(n) == u, g, of))) for g in range(k)])


def test_words_beyond_the_heads_have_classes_by_their_own_counts(spark):
    r = np.random.default_rng(6)
    sides = [[f"{s}{i}same" for i in range(60)] for s in "ab"]  # one ending, so that it tells nothing
    rows = [(i, " ".join(f"{r.choice(sides[0])} the {r.choice(sides[1])} of" for _ in range(60))) for i in range(60)]
    model, _ = classlm.train(spark.createDataFrame(rows, "doc_id long, text string"), heads=2, endings=4, classes=4)
    own = [{int(model.known.find(*classlm._tokens([w.encode()])[:2])[2][0]) for w in side} for side in sides]
    assert len(model.known.hashes) == 123 and not own[0] & own[1]


def test_language_id(spark):
    r = np.random.default_rng(1)
    make = lambda words: " ".join(r.choice(words, 60))
    rows = [(i, make(["the", "and", "with", "house"]) if i % 2 else make(["der", "und", "für", "haus"]), "en" if i % 2 else "de") for i in range(240)]
    df = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "12 %%", None), (None, "the house", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(df).collect()}
    held = [i for i, *_ in rows if got[i].held_out]
    assert held and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held)
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and not got[None].held_out


def test_quality(spark):
    good = [(i, text(i, 50).capitalize() + ".", 1) for i in range(150)]
    bad = [(1000 + i, " | ".join(["spam"] * 60), 0) for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad if i % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.selected for r in quality.resample(df, labels).collect()}
    assert all(got[i] for i, *_ in good) and not any(got[i] for i, *_ in bad) and not got[5000] and not got[5001]
    assert quality.resample(df, labels, k=20).where("selected").count() == 20


def test_urls(spark):
    rows = [(1, "https://A.Example.COM/en/7x?q"), (2, "http://x.com/en/1"), (3, "http://b.net/de/1"), (4, "http://example.net/de/8"), (5, None), (6, "no scheme"), (7, "http://notexample.com"), (8, "http://c.org/es/#t")]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    for limit in (urlfilter.INLINE_RULES, 0):
        urlfilter.INLINE_RULES = limit
        got = {r.page_id: r for r in urlfilter.judge_urls(df, queries.RULES).collect()}
        urlfilter.INLINE_RULES = 64
        assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
        assert [got[i].rule for i in (2, 3, 4, 7, 8)] == ["com/en/", "net/de/", "example.net/de/8", None, "org/es/"]
        assert got[5].host == got[6].path == "" and got[5].rule is None and got[5].verdict in ("allow", "block")


def test_markov_model_is_a_distribution():
    m = urlfilter.MarkovModel([b"abc", b"abd"])
    p = np.exp(m.log_likelihood([b"abc", b"abd", b"zzz"]))
    assert p[0] > p[2] and p.sum() < 1


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "ok"), (0, 3, "assistant", "A"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "ok"), (1, 3, "assistant", "B"), (1, 3, "assistant", "B"), (2, 0, "user", None), (None, 0, "user", "x")]
    seg = chat.neighbouring_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.pair_id: r for r in chat.assemble(seg).collect()}
    assert got[0].prompt.count("<|") == 3 and got[0].chosen == "<|assistant|>\nA\n" and got[0].rejected == "<|assistant|>\nB\n"
    assert [tuple(x) for x in got[0].chosen_loss] == [(0, 16)] and got[1].prompt == "" and got[1].chosen_loss == []


def test_neighbours(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 16))
    rows = [(i, [float(v) for v in x[i % 250]]) for i in range(300)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = {i: np.array(e, np.float32).astype(float) for i, e in rows if i < 300}
    got: dict = {}
    for q in neighbours.nearest(df, lambda c: F.pmod(c, F.lit(20)) == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
    hit = 0
    for i in range(0, 300, 20):
        want = sorted(((-float((v[i] * v[j]).sum()), j) for j in v if j != i))[:10]
        hit += len({j for _, j in want} & {j for j, _ in got[i]})
        assert len(got[i]) == 10 and all(s == pytest.approx(float((v[i] * v[j]).sum())) for j, s in got[i])
    assert set(got) == set(range(0, 300, 20)) and hit >= 0.9 * 150


def test_neighbours_that_tie_come_by_id(spark):
    rows = [(i, [float(j == i % 90 or j == 95) for j in range(96)]) for i in range(90)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda c: F.pmod(c, F.lit(20)) == 0, k=10, curves=2).collect()
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in range(0, 90, 20)} == {q: [i for i in range(11) if i != q][:10] for q in range(0, 90, 20)}


def test_hilbert_neighbours_touch():
    g = np.stack(np.meshgrid(np.arange(8), np.arange(8)), -1).reshape(-1, 2)
    walk = g[np.argsort(neighbours.hilbert(g.astype(np.uint64), 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels, items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    results = [
        jaccard.jaccard_groups(d), jaccard.one_of_each(d), decontaminate.contamination(d, items), sharding.shard_documents(d), packing.pack(d, queries.tokenizer_path()), classlm.score_all(d), langid.identify(d), quality.resample(d, labels),
        urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string"), queries.RULES), chat.neighbouring_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
        neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda c: c == 0),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_word_tokens_are_those_of_the_whole_text():
    path = queries.tokenizer_path()
    words = packing.WordTokens(path)
    texts = ["Hi. A, b.c ?. x., It's. <|ENDOFTEXT|>. K. Á, 9. 9.\n", "<|endoftext|> a<|endoftext|>b Y.", "İ. I, X.̸ .", "Wow... It'S, e.g. 3,4. 5, ß. (a). \"b\", end.", "", " \t\n", "日本語. Éa, x̸,"]
    for _ in range(2):  # the second time from the cache
        for text, got in zip(texts, words.encode([t.encode() for t in texts])):
            assert np.frombuffer(got, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids

"""Operators that SQL does not express, recomputed row by row in plain Python."""

import hashlib
import zlib
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazetteer.llm import classlm, jaccard, langid, quality, queries, sharding, urlfilter
from gazetteer.llm.common import unused

WORDS = [f"w{i}" for i in range(60)]


def text(seed, n, words=WORDS):
    return " ".join(np.random.default_rng(seed).choice(words, n))


# --- op1 ----------------------------------------------------------------------------------------------------------------


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([i for i in map(path.find, "?#") if i >= 0], default=len(path))
    return host, path[:end]


def rule_of(host, path):
    best = None
    for r in queries.RULES:
        h, slash, p = r.pattern.partition("/") if hasattr(r, "pattern") else r.rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (0, "", ""), (len(h + slash + p), h + slash + p, r.verdict))
    return best


def naive_model(urls):
    counts = [Counter() for _ in range(urlfilter.ORDER + 1)]
    for u in urls:
        b = b"\x02" * urlfilter.ORDER + u + b"\x03"
        for i in range(urlfilter.ORDER, len(b)):
            for k, c in enumerate(counts):
                c[b[i - k : i + 1]] += 1
    follow = [{} for _ in counts]
    for f, c in zip(follow, counts):
        for gram, n in c.items():
            t, kinds = f.get(gram[:-1], (0, 0))
            f[gram[:-1]] = (t + n, kinds + 1)

    def rate(u):
        b, total = b"\x02" * urlfilter.ORDER + u + b"\x03", 0.0
        for i in range(urlfilter.ORDER, len(b)):
            p = 1 / 256
            for k, c in enumerate(counts):
                t, kinds = follow[k].get(b[i - k : i], (0, 0))
                if t:
                    p = (c[b[i - k : i + 1]] + kinds * p) / (t + kinds)
            total += log(p)
        return total

    return rate


def test_urls_row_by_row(spark):
    r = np.random.default_rng(2)
    hosts = ["a.com", "B.Example.com", "x.net", "example.net", "y.org", "plain.io", "notexample.com"]
    urls = [f"http://{hosts[i % 7]}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.integers(0, 90)}{r.choice(['', '?q=1', '#t', '/deep/er'])}" for i in range(140)] + [None, "", "no scheme", "http://", "://only.com/en/"]
    got = {x.page_id: x for x in urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.RULES).collect()}
    judged = {u: rule_of(*parts(u)) for u in urls}
    fit = {v: sorted({u.lower().encode() for u, j in judged.items() if u and j and j[2] == v}) for v in ("allow", "block")}
    split = lambda us, held: [u for i, u in enumerate(us) if (i % 5 == 4) == held]
    good, bad = (naive_model(split(fit[v], False)) for v in ("allow", "block"))
    score = lambda u: (good(u) - bad(u)) / (len(u) + 1)
    g, b = ([score(u) for u in split(fit[v], True)] for v in ("allow", "block"))
    balanced = {c: sum(s >= c for s in g) / len(g) + sum(s < c for s in b) / len(b) for c in sorted({*g, *b})}
    threshold = min(c for c, v in balanced.items() if v > max(balanced.values()) - 1e-12)
    for i, u in enumerate(urls):
        host, path = parts(u)
        rule, x = judged[u], got[i]
        assert (x.host, x.path, x.rule) == (host, path, rule[1] if rule else None)
        mine = score((u or "").lower().encode())
        assert x.score == pytest.approx(mine)
        if rule:
            assert x.verdict == rule[2]
        elif abs(mine - threshold) > 1e-9:
            assert x.verdict == ("allow" if u is None or mine >= threshold else "block")


# --- op3 ----------------------------------------------------------------------------------------------------------------


def test_shards_are_runs_of_near_equal_bytes_and_whole_groups(spark):
    r = np.random.default_rng(3)
    rows = [(i, text(i, int(r.integers(1, 60)))) for i in range(600)]
    rows += [(1000 + 10 * g + k, text(5000 + g, 30)) for g in range(100) for k in range(3)]  # groups that are kept whole
    rows += [(3000 + k, "the same words again") for k in range(900)]  # one that is not
    rows += [(i, None) for i in range(9000, 9003)] + [(None, "a"), (7, "again"), (7, "again")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert sorted((str(x.doc_id), x.text_crc32, x.size) for x in got) == sorted((str(i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    total, by = sum(x.size for x in got), [[x for x in got if x.shard == s] for s in range(8)]
    for s in by:
        assert sorted(x.slot for x in s) == list(range(len(s)))
        assert abs(sum(x.size for x in s) - total / 8) <= 0.05 * total / 8 + 2 * max(x.size for x in got)
    # the shards are runs of one order: by the texts' hashes
    place = {zlib.crc32(t.encode()): hashlib.md5(t.encode()).hexdigest() for t in {t or "" for _, t in rows}}
    order = [place[x.text_crc32] for x in sorted(got, key=lambda x: (x.shard, x.slot))]
    assert order == sorted(order)
    where: dict = {}
    for x in got:
        where.setdefault(x.text_crc32, set()).add(x.shard)
    split = [c for c, shards in where.items() if len(shards) > 1]
    assert split in ([], [zlib.crc32(b"the same words again")])


# --- op4 ----------------------------------------------------------------------------------------------------------------


def test_quality_row_by_row(spark):
    rows = [(i, text(i, 40).capitalize() + ".") for i in range(60)] + [(100 + i, "buy | now | " * 10 + str(i)) for i in range(20)] + [(200, None), (201, " "), (None, text(9, 30)), (-1, text(8, 30))]
    labels = [(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(-1, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=40).collect()}
    good, raw, target = {i for i, q, _ in labels if q}, Counter(), Counter()
    grams = {i: quality.gram_buckets([(t or "").encode()])[0].tolist() for i, t in rows}
    for i, g in grams.items():
        raw.update(g)
        if i in good:
            target.update(g)
    smooth = 0.5 * quality.BUCKETS
    ratio = lambda b: log((target[b] + 0.5) / (sum(target.values()) + smooth)) - log((raw[b] + 0.5) / (sum(raw.values()) + smooth))
    keys = {}
    for i, t in rows:
        if t and t.strip():
            weight = sum(map(ratio, grams[i]))
            assert got[i].log_weight == pytest.approx(weight)
            u = (quality.hash_of(17, i, t.encode()) >> 11) / (1 << 53) + 2.0**-54
            keys[i] = weight - log(-log(u))
        else:
            assert got[i].log_weight is None and not got[i].selected
    assert {i for i, x in got.items() if x.selected} == set(sorted(keys, key=lambda i: -keys[i])[:40])


# --- op5 ----------------------------------------------------------------------------------------------------------------


def test_class_lm_row_by_row(spark):
    # one ending each for most words, so that units hold rare words, words seen once, and clustered ones
    rows = [(i, " ".join([text(i, 30), f"once{i}aaa", f"pair{i // 2}bbb", "The END"])) for i in range(150)] + [(900, None), (901, "never seen words zzz once5aaa"), (None, "w1 unseenaaa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model, words = classlm.train(docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)))
    count = {k: n for k, n in ((r[0], r[1]) for r in words.collect())}
    find = lambda raws: (classlm._tokens(raws)[:2], model.known.find(*classlm._tokens(raws)[:2]))
    end = find([b""])[1][2][0]
    got = {r.doc_id: r for r in classlm.score_all(docs).collect()}
    per = {True: [], False: []}
    for i, t in rows:
        (hashes, _), (at, unit, c) = find([(t or "").lower().encode()])
        total, before = 0.0, end
        for h, a, u, k in zip(hashes.view(np.int64).tolist(), at, unit, c):
            total += model.step[before, k]
            if a >= 0:
                total += np.log10(max(model.counts[a], 0.5)) - model.total[k]
            else:
                total += model.emit[u] + np.log10((count.get(h) or model.one_unseen[u]) / (model.mass[u] + model.unseen[u]))
            before = k
        assert got[i].score == pytest.approx(total)
        if i is not None and i < 150:
            per[held(i)].append(total / len(hashes))
    assert np.mean(per[True]) < np.mean(per[False])  # what was not learned from scores lower
    # a distribution: each class's words and rare units take all of it, and each step does
    assert np.allclose((10**model.step).sum(axis=1), 1)
    own = np.bincount(model.known.of, np.maximum(model.counts, 0.5), model.known.k) / 10**model.total
    rare = np.bincount(model.known.of_rest, 10**model.emit, model.known.k)
    used = np.bincount(model.known.of, minlength=model.known.k) + np.bincount(model.known.of_rest, minlength=model.known.k) > 0
    assert np.allclose((own + rare)[used], 1) and (model.one_unseen <= 1).all() and (model.one_unseen <= model.unseen).all()


# --- ids, names ---------------------------------------------------------------------------------------------------------


def test_ids_of_other_kinds_and_clashing_names(spark):
    rows = [(f"d{i % 9}" if kind == "string" else i % 9, text(i % 7, 40), "en", 1.0, "x") for kind in ("string",) for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, _key double, _lang string")
    labels = spark.createDataFrame([(f"d{i}", 1, 0) for i in range(6)], "doc_id string, quality int, toxic int")
    assert jaccard.jaccard_groups(df, 3, "0.9").count() == 14 and jaccard.one_of_each(df, 3, "0.9").columns == df.columns
    assert quality.selected_documents(df, labels).columns == df.columns
    assert langid.identified_documents(df).columns == df.columns and langid.identify(df).count() == 14
    ints = df.withColumn("doc_id", F.substring("doc_id", 2, 9).cast("int"))
    assert jaccard.jaccard_groups(ints, 3, "0.9").schema["component_id"].dataType.simpleString() == "int"
    assert unused(df, "_key", "_lang", "free") == ["__key", "__lang", "free"]

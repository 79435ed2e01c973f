"""The pipeline's stages against brute force, on documents with nulls, copies, benchmark passages and clashing names."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from gazetteer.llm import queries

WORDS = {"en": "the and with house river green walks under never morning light stone bread open".split(), "de": "der und mit haus fluss grün geht unter niemals morgen licht stein brot offen".split()}


def prose(lang, seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang], n)).capitalize() + "."


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose("en", 999, 25)
    rows = [(i, prose("en" if i % 2 else "de", i, 60), "en" if i % 2 else "de") for i in range(160)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(5)]  # exact copies
    rows += [(300 + i, rows[10 + i][1].replace("The ", "the ", 1) + " stone", rows[10 + i][2]) for i in range(5)]  # near copies
    rows += [(400 + i, " ".join([prose("en", 5000 + i, 30), item, prose("en", 6000 + i, 30)]), "en") for i in range(4)]
    rows += [(500 + i, " | ".join(["$$ 00 ##"] * 40 + [str(i)]), None) for i in range(20)]
    rows += [(600, None, None), (601, "", "en"), (602, " \n", None), (None, prose("en", 777, 60), "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1.0, "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, _key double, _lang string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in (*range(0, 160, 2), *range(1, 160, 4), *range(500, 520, 2))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    quality, language, near, clean = kept.values()
    assert not {*range(500, 520), 600, 601, 602} & set(quality) and len(set(quality) & set(range(160))) >= 155
    assert len(language) >= 0.95 * len(quality) and set(language) <= set(quality)
    # one of each group that links of 0.8 make, that of the smallest id
    ids = sorted(i for i in language if i is not None)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = {i: shingles(language[i]) for i in ids}
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    assert set(near) == {find(i) for i in ids} | {None} & set(language)
    assert not {*range(200, 205), *range(300, 305)} & set(near)
    assert set(clean) == {i for i in near if i not in range(400, 404)}

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got: dict = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(clean)
    for i, text in clean.items():
        tokens = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(got[i], key=lambda p: p.start)
        assert sum(p.length for p in pieces) == len(tokens) and all(zlib.crc32(tokens[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

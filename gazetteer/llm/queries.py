"""The operators as queries over the standard tables, and the SQL of those that SQL expresses.

Each query applies its operator, with production parameters, to its whole table and derives the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classlm, decontaminate, jaccard, langid, neighbours, packing, quality, sharding, urlfilter
from .common import table

RULES = [urlfilter.Rule("com/en/", "block"), urlfilter.Rule("example.com/en/7", "allow"), urlfilter.Rule("net/de/", "allow"), urlfilter.Rule("example.net/de/8", "block"), urlfilter.Rule("org/es/", "block")]


def tokenizer_path() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score_all(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), 3, "0.9")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.neighbouring_pairs(table(spark, sf_dir, "conversations"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(20)) == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_decontaminate, op3_shard, op4_quality, op5_class_lm, op6_jaccard, op7_pack, op8_language, op9_preference, op10_neighbours)
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS v FROM s),
lens AS (SELECT DISTINCT l FROM win),
p AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS pos FROM d, lens WHERE len(w) >= l),
hit AS (SELECT doc_id, pos, p.l, item_id FROM p JOIN win ON win.l = p.l AND win.v = array_to_string(p.w[pos:pos + p.l - 1], ' ')),
places AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + l)) AS place FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.ks, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS t FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) AS component_id
FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
"""

OP9_SQL = """
WITH r AS (SELECT DISTINCT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role, text) - 1 AS INTEGER) AS n FROM r),
cut AS (SELECT pair_id, min(turn * 1000000 + n) AS cut FROM (SELECT pair_id, turn, n FROM t GROUP BY pair_id, turn, n, role, text HAVING count(*) < 2) GROUP BY pair_id),
m AS (SELECT t.*, cut IS NULL OR turn * 1000000 + n < cut AS shared FROM t LEFT JOIN cut USING (pair_id))
SELECT pair_id, CASE WHEN shared THEN 'prompt' ELSE side END AS part, turn, n, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS segment,
       CAST(octet_length(encode('<|' || role || '|>' || chr(10) || text || chr(10))) AS BIGINT) AS n_bytes, NOT shared AND role = 'assistant' AS loss
FROM m WHERE NOT shared OR side = 'chosen'
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op6_jaccard": OP6_SQL, "op9_preference": OP9_SQL}

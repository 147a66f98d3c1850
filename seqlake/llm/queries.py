"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hard_negatives, html_extract, langid, mixing, near_dup, packing, quality, spelling, suffix_dedup, token_counts, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.examples(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")), threshold=0.7)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), least_length=5, least_count=3, typo_every=97, ratio=2)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), epochs=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", label.alias("label")), positives=5, negatives=3, low=50, high=95, every=50)


QUERIES = {
    "op11_spelling": op11_spelling,
    "op12_mixing": op12_mixing,
    "op13_hard_negatives": op13_hard_negatives,
    "op7_quality": op7_quality,
    "op9_token_counts": op9_token_counts,
    "op10_langid": op10_langid,
    "op1_html_extract": op1_html_extract,
    "op4_chat_format": op4_chat_format,
    "op8_topk_search": op8_topk_search,
    "op2_decontaminate": op2_decontaminate,
    "op5_packing": op5_packing,
    "op3_near_dup": op3_near_dup,
    "op6_suffix_dedup": op6_suffix_dedup,
}

#: Shingle sets as text, all pairs that share one, and a recursive walk over the links.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
c AS MATERIALIZED (SELECT md5(array_to_string(list_sort(sh), chr(10))) AS k, min(doc_id) AS rep, any_value(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY 1),
e AS MATERIALIZED (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM c),
p AS MATERIALIZED (SELECT a.rep AS u, b.rep AS v FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
      HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT rep AS id, rep AS node FROM c UNION SELECT r.id, l.v FROM r JOIN l ON r.node = l.u),
m AS (SELECT id, min(node) AS component FROM r GROUP BY id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(m.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON len(s.sh) > 0 AND md5(array_to_string(list_sort(s.sh), chr(10))) = c.k LEFT JOIN m ON m.id = c.rep
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (
      SELECT item_id, unnest(CASE WHEN len(ws) < 10 THEN [ws] ELSE list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) END) AS g FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT n FROM w),
o AS MATERIALIZED (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
      SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, k WHERE len(ws) >= n)),
h AS MATERIALIZED (SELECT o.doc_id, o.i, o.n, w.item_id FROM o JOIN w ON o.n = w.n AND o.g = w.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS m,
      length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 13 AS chars FROM c),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(so_far) FILTER (role = 'assistant' OR i = m))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: crc32 byte by byte over a table of 256 made from the polynomial; words that share what is left without the same place are one replacement apart, a word and another without one place one deletion.
OP11_SQL = r"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}')) AS w FROM documents),
p AS MATERIALIZED (SELECT id, w, count(*) AS times, row_number() OVER () AS row FROM r GROUP BY id, w),
t0 AS (SELECT i, 0 AS k, i AS c FROM range(0, 256) x(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t0 WHERE k < 8),
t AS MATERIALIZED (SELECT i, c FROM t0 WHERE k = 8),
b AS MATERIALIZED (SELECT row, flatten(list_transform(string_split(id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END)) AS b FROM p),
h AS (SELECT row, b, 1 AS pos, 4294967295::BIGINT AS c FROM b
      UNION ALL SELECT row, b, pos + 1, xor(h.c >> 8, t.c) FROM h JOIN t ON t.i = (xor(h.c, b[pos]) & 255) WHERE pos <= len(b)),
f AS (SELECT w, times, xor(c, 4294967295) AS h FROM h JOIN p USING (row) WHERE pos = len(b) + 1),
n AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, times FROM f),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM n WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
v AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT x.word AS a, y.word AS b FROM v x JOIN v y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
      UNION ALL SELECT x.word, y.word FROM v x JOIN words y ON x.rest = y.word UNION ALL SELECT y.word, x.word FROM v x JOIN words y ON x.rest = y.word)),
m AS (SELECT a AS word, count(*)::BIGINT AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS most FROM e JOIN words ON words.word = e.b GROUP BY a),
o AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * n THEN b END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM words LEFT JOIN m USING (word)),
g AS (SELECT word, form AS root, 1 AS step FROM o WHERE form IS NOT NULL UNION ALL SELECT g.word, o.form, step + 1 FROM g JOIN o ON o.word = g.root WHERE o.form IS NOT NULL),
l AS (SELECT word, first(root ORDER BY step DESC) AS root FROM g GROUP BY word)
SELECT word, form, coalesce(l.root, word) AS root, n, n_near, form_n FROM o LEFT JOIN l USING (word)
"""

#: Sources by the ratio of their limit to their weight: the first that the level of all from it on doesn't pass gives the level.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
      sum(w) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s),
l AS (SELECT words::DOUBLE / weights::DOUBLE AS level FROM r WHERE words::DOUBLE / weights::DOUBLE <= 3.0::DOUBLE * n / w ORDER BY 3.0 * n / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, n, CASE WHEN (3 * n)::DOUBLE < level * w THEN (3 * n)::DOUBLE ELSE level * w END AS target FROM s, l),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN n > 0 THEN floor(target + 0.5)::BIGINT // n ELSE 0 END AS passes FROM t),
p AS (SELECT d.*, b.n, b.target, b.passes, b.budget - b.passes * b.n AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, n AS source_size, target, (passes * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""

OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.row, a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND len(a.v) = len(c.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM s WHERE label = own AND vec_id <> anchor_id) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.row, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s ON s.row = p.row AND s.label <> s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ORACLES = {
    "op11_spelling": OP11_SQL,
    "op12_mixing": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
    "op4_chat_format": OP4_SQL,
    "op8_topk_search": OP8_SQL,
    "op2_decontaminate": OP2_SQL,
    "op3_near_dup": OP3_SQL,
}

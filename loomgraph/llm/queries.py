"""The queries op1 to op10 over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A model file for op7: piece_bpe_32k.model of the public vocabularies; see tokenizer_path().
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


#: Words of op9's longest n-grams.
LM_ORDER = 3


def tokenizer_path() -> str:
    """The model file that op7 and the pipeline use: TOKENIZER, or the file that LOOM_TOKENIZER_PATH in the environment names."""
    return os.environ.get("LOOM_TOKENIZER_PATH", TOKENIZER)


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.multi_index import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), ids_only=True).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.quality_rules import quality_rules

    t = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.toxicity import toxicity

    t = toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return t.select("doc_id", "p_junk", "p_toxic", "toxic")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.cotraining import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.spm import encode, load

    return encode(_table(spark, sf_dir, "documents"), load(tokenizer_path()))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.jaccard import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.lm import lm_scores

    t = lm_scores(_table(spark, sf_dir, "documents"), order=LM_ORDER)
    return t.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.langid import held_out, language_id

    t = language_id(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return t.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_switches")


QUERIES = [op1_near_vectors, op2_mixing, op3_quality_rules, op4_license_scan, op5_toxicity, op6_quality_classifier, op7_sentencepiece, op8_ngram_jaccard, op9_lm_scores, op10_language_id]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS d FROM link GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(deg.d, 0) AS n_similar, comp.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN deg ON deg.a = d.doc_id JOIN comp ON comp.a = d.doc_id
"""


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || left(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
-- the level of a unit of weight, and how many sources are above their cap at the level before
fill AS (
  SELECT 0 AS step, (SELECT sum(source_size) / sum(w) FROM s) AS unit, -1::BIGINT AS n
  UNION ALL
  SELECT step + 1,
    (SELECT (sum(source_size) - sum(CASE WHEN w * unit > 3 * source_size THEN 3 * source_size ELSE 0 END)) / nullif(sum(CASE WHEN w * unit > 3 * source_size THEN 0 ELSE w END), 0) FROM s),
    (SELECT count(*) FROM s WHERE w * unit > 3 * source_size)
  FROM fill WHERE step < 100 AND unit IS NOT NULL AND n <> (SELECT count(*) FROM s WHERE w * unit > 3 * source_size)),
lvl AS (SELECT unit FROM fill WHERE unit IS NOT NULL ORDER BY step DESC LIMIT 1),
t AS (SELECT source, source_size, least(w * unit, 3.0 * source_size) AS target FROM s, lvl),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
r AS (SELECT *, target - passes * source_size AS rest FROM p),
hs AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
run AS (SELECT source, h, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto, words FROM hs),
cut AS (
  SELECT r.source, max(CASE WHEN r.rest > 0 AND (upto <= r.rest OR (upto - words < r.rest AND upto - r.rest < r.rest - (upto - words))) THEN h ELSE -1 END) AS upto
  FROM r JOIN run ON run.source IS NOT DISTINCT FROM r.source GROUP BY r.source)
SELECT doc_id, size, source_size, target, (CASE WHEN target > 0 THEN least(passes + (h <= cut.upto)::BIGINT, 3) ELSE 0 END * size)::BIGINT AS taken
FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source JOIN cut ON cut.source IS NOT DISTINCT FROM d.source
"""


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
li AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
s AS (
  SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN li USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
g AS (
  SELECT doc_id, stratum, base_failed, u.rule, CASE WHEN u.den > 0 THEN least(20, (u.num * 20 + u.den - 1) // u.den) ELSE 0 END AS k
  FROM (SELECT doc_id, stratum, base_failed, unnest([{'rule': 'symbols', 'num': n_symbols, 'den': word_chars}, {'rule': 'dup_lines', 'num': n_dup_lines, 'den': n_lines},
    {'rule': 'repeats', 'num': n_repeat_words, 'den': n_words}, {'rule': 'upper', 'num': n_upper, 'den': n_letters}]) AS u FROM b)),
y AS (SELECT doc_id FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT stratum, rule, k FROM g JOIN y USING (doc_id) WHERE NOT base_failed),
m AS (SELECT count(DISTINCT stratum) AS strata FROM h),
t AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER (WHERE k > cut) AS bad FROM h, range(20) AS r(cut) GROUP BY ALL),
p AS (
  SELECT stratum, rule, cut, any_value(n) AS n, any_value(bad) AS bad,
    sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.01) + (n - j) * ln(0.99))) AS tail
  FROM (SELECT *, unnest(range(bad + 1)) AS j FROM t WHERE bad <= 0.01 * n) GROUP BY stratum, rule, cut),
c AS (SELECT stratum, rule, min(cut) AS cut FROM p, m WHERE bad < n AND tail <= 0.05 / (strata * 80) GROUP BY stratum, rule),
x AS (
  SELECT g.doc_id, string_agg(rule, ',' ORDER BY CASE rule WHEN 'symbols' THEN 1 WHEN 'dup_lines' THEN 2 WHEN 'repeats' THEN 3 ELSE 4 END) AS rejected_by
  FROM g JOIN c USING (stratum, rule) WHERE k > cut GROUP BY g.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(rejected_by, '') AS rejected_by, NOT base_failed AND rejected_by IS NULL AS kept
FROM b LEFT JOIN x USING (doc_id)
"""

OP4_SQL = r"""
WITH tpl AS (SELECT label, list_distinct(string_split(t, ' ')) AS own FROM (VALUES
  ('apache-2.0', 'licensed under the apache license version 2 0'),
  ('mit', 'released under the mit license'),
  ('mit-grant', 'permission is hereby granted free of charge to any person obtaining a copy of this software'),
  ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
  ('gpl-3.0', 'this work is licensed under the gnu general public license version 3'),
  ('gpl-notice', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license'),
  ('cc-by-nc-4.0', 'licensed under cc by nc 4 0'),
  ('cc-by-sa-4.0', 'licensed under cc by sa 4 0'),
  ('mpl-2.0', 'this source code form is subject to the terms of the mozilla public license v 2 0'),
  ('proprietary', 'unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential')) AS v(label, t)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
pos AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
base AS (
  SELECT doc_id, i - 1 AS p, CASE WHEN a = 'cc' THEN 'cc-by' WHEN a = 'general' THEN 'gpl' ELSE 'reserved' END AS label
  FROM pos WHERE a = 'cc' AND b = 'by' OR a = 'general' AND b = 'public' AND c = 'license' OR a = 'all' AND b = 'rights' AND c = 'reserved'),
blk AS (SELECT doc_id, list_distinct(w[s + 1:s + 48]) AS ws FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 48 THEN [0] ELSE range(0, len(w) - 32, 16) END) AS s FROM d WHERE len(w) > 0)),
m AS (
  SELECT doc_id, label, max(len(list_intersect(ws, own)) / len(own)) AS score FROM blk, tpl
  WHERE len(list_intersect(ws, own)) >= ceil(len(own) * 0.9 - 1e-9) GROUP BY doc_id, label),
bs AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id),
sc AS (SELECT doc_id, max(score) AS score FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


OP1_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS d FROM link GROUP BY a)
SELECT e.vec_id, coalesce(deg.d, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp ON comp.a = e.vec_id LEFT JOIN deg ON deg.a = e.vec_id
"""


# crc32 by a table of 256 remainders; a start and an end of a text are words that no text can have. K is found by halving
# its range on the logarithmic scale
OP9_SQL = r"""
WITH RECURSIVE bit AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS step FROM range(256) AS r(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bit WHERE step < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bit WHERE step = 8),
walk AS (
  SELECT doc_id, doc_id::VARCHAR AS s, 1 AS i, 4294967295::BIGINT AS c FROM documents
  UNION ALL SELECT doc_id, s, i + 1, xor(c >> 8, t[(xor(c, ascii(s[i])) & 255) + 1]) FROM walk, crc WHERE i <= length(s)),
h AS (SELECT doc_id, xor(c, 4294967295) % 10 = 0 AS held FROM walk WHERE s IS NULL OR i = length(s) + 1),
d AS (
  SELECT doc_id, coalesce(held, false) AS held,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS w
  FROM documents LEFT JOIN h USING (doc_id)),
g AS (
  SELECT doc_id, held, w[i] AS w3, CASE WHEN i = 1 THEN ' start' ELSE w[i - 1] END AS w2, CASE WHEN i = 2 THEN ' start' WHEN i > 2 THEN w[i - 2] END AS w1
  FROM (SELECT doc_id, held, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT w3 AS a, count(*)::DOUBLE AS c FROM g WHERE NOT held GROUP BY ALL),
c2 AS (SELECT w2 AS a, w3 AS b, count(*)::DOUBLE AS c FROM g WHERE NOT held GROUP BY ALL),
c3 AS (SELECT w1 AS a, w2 AS b, w3 AS e, count(*)::DOUBLE AS c FROM g WHERE NOT held AND w1 IS NOT NULL GROUP BY ALL),
s AS (SELECT coalesce((SELECT sum(c) FROM c1), 0) AS n, (SELECT count(*) FROM c1)::DOUBLE AS v, (SELECT count(*) FROM d WHERE NOT held)::DOUBLE AS texts),
h1 AS (SELECT c, count(*)::DOUBLE AS n FROM c1 GROUP BY c),
h2 AS (SELECT c, count(*)::DOUBLE AS n FROM c2 GROUP BY c),
once AS (SELECT (SELECT count(*) FROM c2 WHERE c = 1)::DOUBLE AS o2, (SELECT count(*) FROM c3 WHERE c = 1)::DOUBLE AS o3),
halve AS (
  SELECT 0 AS step, 0.01::DOUBLE AS l2, 1e6::DOUBLE AS u2, 0.01::DOUBLE AS l3, 1e6::DOUBLE AS u3
  UNION ALL
  SELECT step + 1, CASE WHEN n2 < o2 THEN k2 ELSE l2 END, CASE WHEN n2 < o2 THEN u2 ELSE k2 END, CASE WHEN n3 < o3 THEN k3 ELSE l3 END, CASE WHEN n3 < o3 THEN u3 ELSE k3 END
  FROM (SELECT *, (SELECT coalesce(sum(n * CASE WHEN c < 1023 THEN c * k2 / (c - 1 + k2) ELSE k2 END), 0) FROM h1) AS n2, (SELECT coalesce(sum(n * CASE WHEN c < 1023 THEN c * k3 / (c - 1 + k3) ELSE k3 END), 0) FROM h2) AS n3
    FROM (SELECT *, sqrt(l2 * u2) AS k2, sqrt(l3 * u3) AS k3 FROM halve WHERE step < 100)), once),
k AS (SELECT sqrt(l2 * u2) AS k2, sqrt(l3 * u3) AS k3 FROM halve WHERE step = 100),
p AS (
  SELECT g.doc_id, g.w1, (coalesce(x.c, 0) + 0.1) / (n + 0.1 * (v + 1)) AS p1, x.c IS NOT NULL AS known,
    coalesce(y.c, 0) AS cy, CASE WHEN g.w2 = ' start' THEN texts ELSE coalesce(hx.c, 0) END AS chx, coalesce(z.c, 0) AS cz, coalesce(hy.c, 0) AS chy
  FROM g CROSS JOIN s LEFT JOIN c1 x ON x.a = g.w3 LEFT JOIN c1 hx ON hx.a = g.w2 LEFT JOIN c2 y ON y.a = g.w2 AND y.b = g.w3
    LEFT JOIN c2 hy ON hy.a = g.w1 AND hy.b = g.w2 LEFT JOIN c3 z ON z.a = g.w1 AND z.b = g.w2 AND z.e = g.w3),
q AS (SELECT *, (cy + k2 * p1) / (chx + k2) AS p2 FROM p, k),
r AS (
  SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, round(sum(log10(p1)), 6) AS base_score,
    round(sum(log10(CASE WHEN w1 IS NULL THEN p2 ELSE (cz + k3 * p2) / (chy + k3) END)), 6) AS score
  FROM q GROUP BY doc_id)
SELECT doc_id, held AS held_out, n_tokens, n_known, n::BIGINT AS train_tokens, base_score, score FROM d JOIN r USING (doc_id), s
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_vectors": OP1_SQL, "op3_quality_rules": OP3_SQL, "op4_license_scan": OP4_SQL, "op2_mixing": OP2_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_lm_scores": OP9_SQL}

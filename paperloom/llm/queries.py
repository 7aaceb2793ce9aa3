"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, collocations, compress, language, licenses, links, minhash, ngram, packing, secrets, spotsigs, toxicity

QUERIES = {
    "op1_lm_score": ngram.query,
    "op2_pack": packing.query,
    "op3_spotsigs": spotsigs.query,
    "op4_url_verdict": links.query,
    "op5_language": language.query,
    "op6_toxicity": toxicity.query,
    "op7_minhash_dedup": minhash.query,
    "op8_secrets": secrets.query,
    "op9_multi_index": ann.query,
    "op10_bpe": bpe.query,
    "op11_collocations": collocations.query,
    "op12_licenses": licenses.query,
    "op13_vector_codes": compress.query,
}

#: Near-duplicate components by brute force over shared shingles.
OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""

#: Collocations from the counts of all phrases of up to four words.
OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) AS ph FROM w),
f AS (SELECT lang, ph, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE len(ph) >= 2 AND a >= 30),
x AS (
  SELECT c.lang, c.ph, c.a, l.a AS l, r.a AS r, c.k, 2000000::HUGEINT * c.a // (l.a + r.a) AS score FROM (SELECT *, unnest(range(1, len(ph))) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:c.k] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[c.k + 1:]
), s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
m AS (SELECT lang, sub, max(a) AS most FROM (
  SELECT lang, a, unnest(flatten(list_transform(range(2, len(ph)), lambda k: list_transform(range(1, len(ph) - k + 2), lambda i: ph[i:i + k - 1])))) AS sub FROM c
) GROUP BY ALL),
o AS (SELECT s.lang, array_to_string(s.ph, ' ') AS phrase, s.a, s.l, s.r, t.n, s.score::BIGINT AS score FROM s JOIN t ON t.lang = s.lang LEFT JOIN m ON m.lang = s.lang AND m.sub = s.ph WHERE m.most IS NULL OR 100 * m.most < 80 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

ORACLE = {"op7_minhash_dedup": OP7, "op11_collocations": OP11}

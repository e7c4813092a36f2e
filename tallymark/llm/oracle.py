"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

import re

from . import line_dedup

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score FROM s
)
SELECT * FROM r WHERE "rank" <= 10
"""

OP4 = """
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS k FROM w) WHERE k > 1
), o AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r)
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM o GROUP BY doc_id, island
), k AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM s
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), max(n) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
), kept AS (
  SELECT k.doc_id, string_agg(substr(x, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS x FROM k JOIN d USING (doc_id) GROUP BY k.doc_id
), c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) JOIN kept USING (doc_id)
"""

OP7 = r"""
WITH b AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] || chr(10) || w[i+3] || chr(10) || w[i+4] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n >= 2
), rw AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM d, range(0, 5) t(k) GROUP BY doc_id
), ln AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines, count(*)::BIGINT AS n_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM b)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_bangs
  FROM b LEFT JOIN rw USING (doc_id) LEFT JOIN ln USING (doc_id)
), f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         n_symbols::DOUBLE / nullif(n_words, 0) AS sr, n_bangs::DOUBLE / nullif(n_words, 0) AS br, n_dup_lines::DOUBLE / nullif(n_lines, 0) AS dr, word_chars::DOUBLE / nullif(n_words, 0) AS mc
  FROM m
), q AS (
  SELECT lang, source, grouping(lang, source) AS level, count(*)::DOUBLE AS n, quantile_disc(sr, [0.1, 0.9]) AS sr, quantile_disc(br, [0.1, 0.9]) AS br,
         quantile_disc(dr, [0.1, 0.9]) AS dr, quantile_disc(mc, [0.1, 0.9]) AS mc
  FROM f WHERE NOT base_failed GROUP BY ROLLUP (lang, source)
), c AS (  -- each quantile averaged with 30 rows of its language, and that with 30 of all rows
  SELECT g.lang, g.source, k, (g.n * x + 30 * ((l.n * y + 30 * z) / (l.n + 30))) / (g.n + 30) AS v, metric
  FROM q g JOIN q l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM g.lang JOIN q a ON a.level = 3,
       LATERAL (SELECT unnest([1, 2, 1, 2, 1, 2, 1, 2]) AS k, unnest(['sr', 'sr', 'br', 'br', 'dr', 'dr', 'mc', 'mc']) AS metric,
                unnest(g.sr || g.br || g.dr || g.mc) AS x, unnest(l.sr || l.br || l.dr || l.mc) AS y, unnest(a.sr || a.br || a.dr || a.mc) AS z)
  WHERE g.level = 0
), e AS (
  SELECT lang, source, metric, max(v) FILTER (k = 1) AS lo, max(v) FILTER (k = 2) AS hi FROM c GROUP BY ALL
), t AS (
  SELECT lang, source, max(hi + 1.0::DOUBLE * (hi - lo)) FILTER (metric = 'sr') AS max_sr, max(hi + 1.0::DOUBLE * (hi - lo)) FILTER (metric = 'br') AS max_br,
         max(hi + 1.0::DOUBLE * (hi - lo)) FILTER (metric = 'dr') AS max_dr, max(hi + 1.0::DOUBLE * (hi - lo)) FILTER (metric = 'mc') AS max_mc,
         max(lo - 1.0::DOUBLE * (hi - lo)) FILTER (metric = 'mc') AS min_mc
  FROM e GROUP BY ALL
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT coalesce(mc < min_mc OR mc > max_mc OR n_symbols > max_sr * n_words + 3 OR n_bangs > max_br * n_words + 3 OR n_dup_lines > max_dr * n_lines + 3, FALSE)) AS kept
FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), cut AS (  -- U+E000 stands at every end: of lines, and of clauses
  SELECT doc_id, text, 'line' AS kind, string_split(replace(low, chr(10), chr(10) || chr(57344)), chr(57344)) AS s FROM d
  UNION ALL
  SELECT doc_id, text, 'clause', string_split(regexp_replace(regexp_replace(replace(low, chr(10), chr(10) || chr(57344)),
    '([.,;:!?\x{2026}]+)([\x20\x09-\x0D])', '\1' || chr(57344) || '\2', 'g'), '([\x{3002}\x{FF0C}\x{3001}\x{FF1B}\x{FF1A}\x{FF01}\x{FF1F}]+)', '\1' || chr(57344), 'g'), chr(57344)) FROM d
), part AS (
  SELECT doc_id, kind, i, piece, (sum(length(piece)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(piece))::BIGINT AS base
  FROM (SELECT doc_id, kind, generate_subscripts(s, 1) AS i, unnest(s) AS piece FROM cut)
), word AS (
  SELECT doc_id, kind, i, regexp_extract_all(piece, '[^\x20\x09-\x0D]+') AS w,
         base + length(regexp_extract(piece, '^[\x20\x09-\x0D]*')) AS start, base + length(regexp_replace(piece, '[\x20\x09-\x0D]+$', '')) AS stop
  FROM part WHERE regexp_matches(piece, '[^\x20\x09-\x0D]')
), form AS (
  SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS i, start, stop, array_to_string(w, ' ') AS norm,
         greatest(len(w), strlen(array_to_string(w, ' ')) // 24) AS weight
  FROM word
), total AS (
  SELECT *, (sum(weight) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS upto FROM form WHERE kind = 'clause'
), ends AS (  -- the first clause that brings a paragraph to its length
  SELECT a.doc_id, a.i, a.start, b.stop, b.i AS j FROM (SELECT *, upto - weight + PASSAGE_WORDS AS goal FROM total) a ASOF JOIN total b ON a.doc_id = b.doc_id AND b.upto >= a.goal
), listed AS (SELECT doc_id, list(norm ORDER BY i) AS norms FROM total GROUP BY doc_id
), para AS (
  SELECT e.doc_id, e.start, e.stop, array_to_string(norms[e.i:e.j], ' ') AS norm FROM ends e JOIN listed USING (doc_id)
), u AS (
  SELECT * FROM para
  UNION ALL SELECT doc_id, start, stop, norm FROM form f WHERE kind = 'line' AND weight >= LINE_WORDS AND NOT EXISTS (FROM para p WHERE p.doc_id = f.doc_id AND p.start = f.start AND p.stop = f.stop)
), g AS (SELECT norm, count(*) AS n, min({'doc_id': doc_id, 'start': start, 'stop': stop}) AS one FROM u GROUP BY norm
), late AS (
  SELECT u.doc_id, u.start, u.stop
  FROM u JOIN g USING (norm) WHERE g.n > 1 AND NOT (u.doc_id = g.one.doc_id AND u.start < g.one.stop)
), island AS (
  SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS k
  FROM (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT doc_id, start, stop FROM late))
), gone AS (SELECT doc_id, min(start) AS a, max(stop) AS b FROM island GROUP BY doc_id, k
), removed AS (
  SELECT doc_id, count(*)::BIGINT AS n_removed, sum(b - a)::BIGINT AS removed_chars, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM gone GROUP BY doc_id
), counted AS (SELECT doc_id, count(*)::BIGINT AS n_units FROM u GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN removed USING (doc_id)
""".replace("LINE_WORDS", str(line_dedup.PASSAGE_WORDS)).replace("PASSAGE_WORDS", str(line_dedup.PASSAGE_WORDS))


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII string: bytes go in by eight bit steps each."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ord(substr({text}, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"


OP11 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, '=' || source AS tree, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         CASE WHEN CRC % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents
), leaf AS (
  SELECT k, doc_id, coalesce(tree, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS claim FROM d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS pos FROM leaf
), low AS (
  SELECT 0 AS level, tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT level + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY level, tree, pos // 3, n
), subroot AS (SELECT tree, h, level AS height FROM low WHERE n = 1
), top AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n
), runs AS (  -- each run of three: in a tree of a source, and over the sources (after the levels of that tree)
  SELECT level, tree, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM low WHERE n > 1 GROUP BY ALL
), over_runs AS (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL
), tree AS (SELECT tree, h AS subroot, height, row_number() OVER (ORDER BY tree) - 1 AS pos FROM subroot
), way AS (
  SELECT k, claim AS h, '' AS proof, 0 AS level, placed.pos, height, tree, tree.pos AS tree_pos FROM placed JOIN tree USING (tree)
  UNION ALL
  SELECT k, sha256(array_to_string(list_transform(hs, lambda x, i: CASE WHEN i = p % 3 + 1 THEN h ELSE x END), '')), proof || array_to_string(list_filter(hs, lambda x, i: i <> p % 3 + 1), ''), level + 1, CASE WHEN level < height THEN pos // 3 ELSE pos END, height, tree, CASE WHEN level < height THEN tree_pos ELSE tree_pos // 3 END
  FROM (
    SELECT w.*, r.hs, w.pos AS p FROM way w JOIN runs r ON w.level < w.height AND r.level = w.level AND r.tree = w.tree AND r.run = w.pos // 3
    UNION ALL
    SELECT w.*, r.hs, w.tree_pos FROM way w JOIN over_runs r ON w.level >= w.height AND r.level = w.level - w.height AND r.run = w.tree_pos // 3)
), last AS (SELECT k, h, proof FROM way QUALIFY row_number() OVER (PARTITION BY k ORDER BY level DESC) = 1
), root AS (SELECT h AS root FROM top WHERE n = 1
)
SELECT p.doc_id, p.leaf, t.subroot, r.root, sha256(l.proof) AS proof_sha256, l.h AS folded_root, l.h = r.root AS verified
FROM placed p JOIN tree t USING (tree) JOIN last l USING (k) CROSS JOIN root r
""".replace("CRC", _crc32("doc_id::VARCHAR"))

#: A row's best way from each state is a struct (cost, audit, lines); structs compare by their fields in turn.
OP12 = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS n FROM conversations
), dam AS (
  SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE WHEN n = 1 THEN '' WHEN n = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, range(0, 2) t(copy) WHERE n <> 0 AND (copy = 0 OR n = 3)
), ord AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(strlen(role) || ':' || role || text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dam
), f AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM ord
), c AS (
  SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS extra, role[1] AS r FROM f
), best AS (
  SELECT conv_id, max(n) + 1 AS i, {'c': 0, 'a': '', 'l': []::VARCHAR[]} AS s0, {'c': 6, 'a': 'II', 'l': ['user:', 'assistant:']} AS s1, {'c': 3, 'a': 'I', 'l': ['assistant:']} AS s2, {'c': 0, 'a': '', 'l': []::VARCHAR[]} AS s3
  FROM c GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(g0, IU(g2), IUA(g3)), least(g1, IU(g2), IUA(g3)), least(g2, IA(g3)), least(g3, IU(g2))
  FROM (
    SELECT b.conv_id, c.i, least(DEL(s0), UPTO(s2, 'u', 'user'), KEEP(s1, 's')) AS g0, least(DEL(s1), UPTO(s2, 'u', 'user')) AS g1, least(DEL(s2), UPTO(s3, 'a', 'assistant')) AS g2, least(DEL(s3), UPTO(s2, 'u', 'user')) AS g3
    FROM best b JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.i = b.i - 1)
), done AS (SELECT conv_id, s0 FROM best WHERE i = 1
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (again AND NOT blank)::BIGINT AS duplicate,
         count(*) FILTER (extra > 0)::BIGINT AS truncated, count(*) FILTER (i > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM c GROUP BY conv_id
)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM v.conv_id
""".replace("CRC", _crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"))
_WAY = "{{'c': {0}.c + {1}, 'a': '{2}' || {0}.a, 'l': list_concat({3}, {0}.l)}}"
OP12 = re.sub(r"\bIUA\((\w+)\)", lambda m: _WAY.format(m[1], 6, "II", "['user:', 'assistant:']"), OP12)
OP12 = re.sub(r"\bIU\((\w+)\)", lambda m: _WAY.format(m[1], 3, "I", "['user:']"), OP12)
OP12 = re.sub(r"\bIA\((\w+)\)", lambda m: _WAY.format(m[1], 3, "I", "['assistant:']"), OP12)
OP12 = re.sub(r"\bDEL\((\w+)\)", lambda m: _WAY.format(m[1], 4, "D", "[]::VARCHAR[]"), OP12)
OP12 = re.sub(r"\bUPTO\((\w+), ('\w'), '(\w+)'\)", lambda m: f"KEEP({m[1]}, {m[2]}), CASE WHEN NOT gone THEN " + _WAY.format(m[1], "3 + extra", "R", f"['{m[3]}:' || text]") + " END", OP12)
OP12 = re.sub(r"\bKEEP\((\w+), ('\w')\)", lambda m: f"CASE WHEN NOT gone AND r = {m[2]} THEN " + _WAY.format(m[1], "extra", "K", "[role || ':' || text]") + " END", OP12)


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1, "op4_suffix_dedup": OP4, "op7_quality_rules": OP7, "op8_minhash_dedup": OP8, "op10_line_dedup": OP10, "op11_merkle_manifest": OP11, "op12_conversation_repair": OP12}

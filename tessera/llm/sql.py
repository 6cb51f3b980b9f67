"""DuckDB SQL that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from tessera.llm import quality_rules as rules
from tessera.llm import parity_join, secrets

#: White-space separated words of a text.
WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _broken(r: rules.Rule) -> str:
    value = f"CAST({r.part} AS DOUBLE)" if not r.whole else f"100.0 * {r.part} / greatest({r.whole}, 1)"
    wrong = [f"{value} < {r.least}"] * (r.least is not None) + [f"{value} > {r.most}"] * (r.most is not None)
    return f"(({' OR '.join(wrong)}) AND n_words >= {r.from_words})"


QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
     n AS (SELECT doc_id, row_number() OVER () AS id, w, text,
                  [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
     win AS (SELECT id, unnest(range(0, len(w) - 7)) AS i, w FROM n WHERE len(w) > 8),
     rep AS (SELECT id, i, count(*) OVER (PARTITION BY id, array_to_string(w[i + 1:i + 8], ' ')) AS c FROM win),
     cov AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 8) t(k) WHERE c > 1 GROUP BY id),
     m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
                  CAST(length(text) - length(regexp_replace(text, '[{rules.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS BIGINT) AS n_upper,
                  len([x FOR x IN w IF x IN ({', '.join(f"'{x}'" for x in rules.STOP_WORDS)})]) AS n_stop_words,
                  len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
           FROM n LEFT JOIN cov USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {' OR '.join(map(_broken, rules.BASE))} AS base_failed,
       NOT ({' OR '.join(map(_broken, (*rules.BASE, *rules.RULES)))}) AS kept
FROM m
"""

MIXING = """
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                      md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), md5(text))) AS k FROM documents),
     s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
     s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s0),
     s2 AS (SELECT *, [5, 2, 1][CAST(nth % 3 + 1 AS INT)] AS weight, 2 * source_size AS top FROM s1),
     s3 AS (SELECT *, (CAST((SELECT sum(source_size) FROM s0) AS BIGINT) * 1.5::DOUBLE
                       - CAST(coalesce(sum(top) OVER (ORDER BY top::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
                      / CAST(sum(weight) OVER (ORDER BY top::DOUBLE / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM s2),
     lev AS (SELECT arg_min(level, top::DOUBLE / weight * 1e6 + nth) AS level FROM s3 WHERE level <= top::DOUBLE / weight),
     s4 AS (SELECT s3.* EXCLUDE (level), least(top::DOUBLE, lev.level * weight) AS target,
                   source_size >= 256 * 256 AS joint,
                   CAST(CASE WHEN source_size >= 256 * 256 THEN 256 ELSE greatest(1, source_size // 256) END AS BIGINT) AS block,
                   CAST(greatest(1, least(65536, ceil(source_size / 1000000.0))) AS BIGINT) AS n_shards FROM s3, lev),
     seats AS (SELECT CAST(coalesce(floor(sum(target) FILTER (joint) / 256 + 0.5), 0) AS BIGINT) AS n FROM s4),
     quot AS (SELECT nth, row_number() OVER (ORDER BY target / (2 * q + 1) DESC, nth) AS r FROM s4, seats, range(0, seats.n) t(q) WHERE joint),
     got AS (SELECT nth, count(*) AS blocks FROM quot, seats WHERE r <= seats.n GROUP BY nth),
     s5 AS (SELECT s4.*, CASE WHEN joint THEN coalesce(blocks, 0) ELSE CAST(floor(target / block + 0.5) AS BIGINT) END AS blocks FROM s4 LEFT JOIN got USING (nth)),
     d AS (SELECT z.*, s5.* EXCLUDE (source), CAST('0x' || substr(k, 1, 8) AS BIGINT) % n_shards AS shard
           FROM sized z JOIN s5 ON z.source IS NOT DISTINCT FROM s5.source),
     c0 AS (SELECT nth, shard, block, blocks, CAST(sum(size) AS BIGINT) AS cell_size FROM d GROUP BY ALL),
     cq AS (SELECT nth, shard, blocks, row_number() OVER (PARTITION BY nth ORDER BY cell_size::DOUBLE / (2 * q + 1) DESC, shard) AS r FROM c0, range(0, (SELECT max(blocks) FROM s5)) t(q)),
     cg AS (SELECT nth, shard, count(*) AS quota FROM cq WHERE r <= blocks GROUP BY ALL),
     c1 AS (SELECT nth, shard, CAST(ceil(cell_size::DOUBLE / block) AS BIGINT) AS n_blocks,
                   least(coalesce(quota, 0), 2 * CAST(ceil(cell_size::DOUBLE / block) AS BIGINT)) AS quota FROM c0 LEFT JOIN cg USING (nth, shard)),
     p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY nth, shard ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM d),
     j AS (SELECT p.*, stop - size AS start, greatest(n_blocks, 1) AS n_blocks, quota // greatest(n_blocks, 1) AS passes, quota % greatest(n_blocks, 1) AS rest
           FROM p JOIN c1 USING (nth, shard)),
     run AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', 'mix', source, CAST(shard AS VARCHAR))), 1, 8) AS BIGINT) % (n_blocks - rest + 1) AS first FROM j)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(stop, (first + rest) * block) - greatest(start, first * block)) AS BIGINT) AS taken FROM run
"""


def _spans(nth: int, r: secrets.Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    return f"""SELECT id, {nth} AS nth, '{r.kind}' AS kind, stop - len(m[i]) AS start, stop FROM (
        SELECT id, i, m, g, CAST(list_sum([len(x) FOR x IN m[1:i]]) + list_sum([len(x) FOR x IN p[1:i]]) AS BIGINT) AS stop FROM (
            SELECT id, unnest(range(1, len(m) + 1)) AS i, m, g, p FROM (
                SELECT id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS g,
                       string_split_regex(text, '{pattern}') AS p FROM d WHERE regexp_matches(text, '{pattern}'))))
        WHERE len(g[i]) >= {r.least}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
     f AS ({' UNION ALL '.join(_spans(i, r) for i, r in enumerate(secrets.RULES))}),
     g AS (SELECT id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)},
                  string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, nth) FILTER (nth < {len(secrets.BASE)}) AS base,
                  string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, nth) AS spans FROM f GROUP BY id)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (id)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PARITY_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     sh AS (SELECT DISTINCT id, array_to_string(w[i + 1:i + {parity_join.SHINGLE}], ' ') AS s
            FROM (SELECT id, w, unnest(range(0, greatest(1, len(w) - {parity_join.SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
     both_have AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
     link AS (SELECT x, y FROM both_have JOIN n nx ON nx.id = x JOIN n ny ON ny.id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
     reach(id, r) AS (SELECT id, id FROM d UNION SELECT reach.id, link.y FROM reach JOIN link ON link.x = reach.r),
     low AS (SELECT reach.id, min(d.doc_id) AS component_id FROM reach JOIN d ON d.id = reach.r GROUP BY reach.id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (id) JOIN low USING (id)
"""

HARD_NEGATIVES = """
WITH r AS (SELECT row_number() OVER () AS id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.id AS a, a.vec_id AS anchor_id, b.id AS b, b.vec_id AS other_id, a.label = b.label AS same,
                  CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
           FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.id <> b.id),
     p AS (SELECT a, anchor_id, b AS p, other_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id) <= 5),
     n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.other_id) AS rank
           FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

#: A byte put into a CRC-32, bit by bit.
_BYTE = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda k, _: xor(k >> 1, 3988292384 * (k & 1)))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: {_BYTE}))"

RESAMPLING = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     g AS (SELECT unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f FROM benchmark),
     df AS (SELECT id, unnest(w) AS f FROM d),
     b AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM g))),
     k AS (SELECT f, {_CRC} % 10000 AS bucket
           FROM (SELECT f, [CAST('0x' || substr(h, 2 * CAST(i AS INT) + 1, 2) AS BIGINT) FOR i IN range(0, len(h) // 2)] AS bytes FROM b)),
     s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY bucket),
     t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (f) GROUP BY bucket),
     gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)
                     / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)))) AS BIGINT) AS gain
              FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
     sums AS (SELECT id, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN k USING (f) JOIN gain USING (bucket) GROUP BY id),
     x AS (SELECT id, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
                  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
           FROM d LEFT JOIN sums USING (id)),
     y AS (SELECT id, doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
     z AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM z) // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (id)
"""

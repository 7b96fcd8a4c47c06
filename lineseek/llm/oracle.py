"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, {LOWERED} AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule_host, rule_path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM split JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT s.page_id, s.host, s.path, f.rule,
       CASE WHEN f.verdict IS NOT NULL THEN f.verdict
            WHEN starts_with(s.host, 'ads-track.') OR contains(s.host, '.ads-track.') THEN 'block'
            WHEN contains(s.path, '/wp-admin/') THEN 'block'
            WHEN contains(s.path || '/', '/user/login/') OR contains(s.path || '/', '/account/login/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM split s LEFT JOIN fitting f ON f.page_id = s.page_id AND f.place = 1
"""

CHAT = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
  FROM turns),
rolling AS (
  SELECT *, md5(string_agg(md5(role || chr(1) || text), '' ORDER BY place)
                OVER (PARTITION BY conv_id ORDER BY place)) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY place) AS upto
  FROM placed),
whole AS (SELECT conv_id, n_turns, prefix FROM rolling WHERE place = n_turns),
kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, prefix, count(*) AS copies FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM rolling r
                    WHERE r.place = w.n_turns AND r.prefix = w.prefix AND r.n_turns > w.n_turns)
  GROUP BY n_turns, prefix)
SELECT r.conv_id, r.place AS turn_no, r.n_turns, r.role, CAST(r.upto - length(r.rendered) AS BIGINT) AS start,
       length(r.rendered) AS n_chars, r.rendered, k.copies
FROM rolling r JOIN kept k ON k.conv_id = r.conv_id
"""


def mixing(rounds: int = 25, budget: float = 0.5, tolerance: float = 1e-4) -> str:
    """Raking to a budget written out, one step after the other. The level at which
    capped goals add up to the budget comes from values sorted by held / target."""
    steps = [
        """rows_ AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         CASE WHEN contains(coalesce(text, ''), '@') OR contains(coalesce(text, ''), '://') THEN 'contact'
              WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
              WHEN contains(coalesce(text, ''), 'icense') OR contains(coalesce(text, ''), 'opyright') THEN 'licence'
              ELSE 'prose' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents)""",
        f"""cells_0_topic AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens, CAST({budget} AS DOUBLE) AS factor
  FROM rows_ WHERE tokens > 0 GROUP BY ALL)""",
        f"wanted AS MATERIALIZED (SELECT sum(tokens) * {budget} AS wanted FROM cells_0_topic)",
        "off_0 AS (SELECT CAST(1 AS DOUBLE) AS off)",
    ]
    for name, temper in (("source", 0.7), ("lang", 0.7), ("topic", 1.0)):
        steps.append(
            f"""held_{name} AS (
  SELECT {name}, sum(tokens) AS held, pow(sum(tokens), {temper}) AS want FROM cells_0_topic GROUP BY {name}),
goal_{name} AS MATERIALIZED (
  SELECT {name}, least(held, want * (SELECT max(mark) FROM (
    SELECT (wanted - coalesce(sum(held) OVER before, 0)) / sum(want) OVER after AS mark, held / want AS filled
    FROM held_{name}, wanted
    WINDOW before AS (ORDER BY held / want, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           after AS (ORDER BY held / want, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    WHERE mark <= filled)) AS goal
  FROM held_{name})"""
        )
    before = "cells_0_topic"
    for step in range(1, rounds + 1):
        for name in ("source", "lang", "topic"):
            steps.append(
                f"""change_{step}_{name} AS (
  SELECT {name}, CASE WHEN given > goal THEN goal / given
                      WHEN rising > goal * 1e-9 THEN 1 + (goal - given) / rising ELSE 1 END AS change
  FROM (SELECT {name}, sum(tokens * least(factor, 1)) AS given,
               sum(CASE WHEN factor < 1 THEN tokens * factor ELSE 0 END) AS rising FROM {before} GROUP BY {name})
  JOIN goal_{name} USING ({name})),
cells_{step}_{name} AS MATERIALIZED (
  SELECT source, lang, topic, tokens,
         factor * CASE WHEN off > {tolerance} THEN change ELSE 1 END AS factor
  FROM {before} JOIN change_{step}_{name} USING ({name}), off_{step - 1})"""
            )
            before = f"cells_{step}_{name}"
        parts = " UNION ALL ".join(
            f"SELECT max(abs(given - goal)) AS off FROM (SELECT {name}, sum(tokens * least(factor, 1)) AS given"
            f" FROM {before} GROUP BY {name}) JOIN goal_{name} USING ({name})"
            for name in ("source", "lang", "topic")
        )
        steps.append(f"off_{step} AS MATERIALIZED (SELECT max(off) / any_value(wanted) AS off FROM ({parts}), wanted)")
    return (
        "WITH " + ",\n".join(steps) + f""",
judged AS (
  SELECT r.doc_id, r.source, r.lang, r.topic, r.tokens,
         CASE WHEN s.factor IS NULL THEN 0 ELSE round(least(s.factor, 1), 9) END AS probability
  FROM rows_ r LEFT JOIN {before} s
    ON r.source = s.source AND r.lang = s.lang AND r.topic = s.topic AND r.tokens > 0)
SELECT *, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < probability AS kept
FROM judged"""
    )


SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
strings AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k
  FROM d, LATERAL (SELECT unnest(generate_series(0, CAST(length(h) // 2 AS BIGINT) - 100)) AS i)),
late AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM strings)
  WHERE place > 1),
marked AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM late),
numbered AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY doc_id ORDER BY i) AS span
  FROM marked),
spans AS (SELECT doc_id, span, min(i) AS s, max(i) + 100 AS e FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS q FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed,
         string_agg(substr(h, 2 * q + 1, 2 * (s - q)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle
  FROM w, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 3))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * c >= 80 * (s.n + t.n - c)),
reached AS (
  SELECT doc_id, doc_id AS r FROM w
  UNION SELECT b, r FROM reached JOIN links ON a = doc_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
WHERE place <= 5
"""

#: Every pair of equal words at most a quarter of the text apart, their stretches, and the smallest period of each.
PERIODIC = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)],
             flatten([[CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
           lambda a, x: CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END),
           4294967295) AS h
  FROM documents),
planted AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed,
         CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a,
         CASE WHEN len(w) > 0 THEN 1 + (len(w) - h // 10 % len(w)) // (3 + h // 10 % 8) END AS p
  FROM d),
words AS MATERIALIZED (
  SELECT doc_id, n, i, CASE WHEN changed AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM planted)),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q
  FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
longest AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM runs),
listed AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS line
  FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length)
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, l.start, l.length, l.period,
       1000 * l.length // l.period AS exponent_milli,
       sha256(coalesce(t.line, '')) AS runs_sha256, sha256(coalesce(k.line, '')) AS collapsed_sha256
FROM d LEFT JOIN listed t USING (doc_id) LEFT JOIN longest l ON l.doc_id = d.doc_id AND l.place = 1
LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

#: Every kept term of a language in every of its groups, zeros included.
DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
held AS (SELECT lang, source, sum(n) AS held FROM counts GROUP BY ALL),
full_ AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(h.held, 0) + s.v) AS BIGINT) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source),
whole AS MATERIALIZED (
  SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v)) AS BIGINT) AS q
  FROM counts JOIN sizes USING (lang) GROUP BY lang, term),
sums AS (
  SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // y.p) AS BIGINT) AS value
  FROM full_ x JOIN full_ y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM full_ JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


ORACLE: dict[str, str] = {
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op2_chat_snapshots": CHAT,
    "op3_url_filters": URL_FILTERS,
    "op4_minhash_near_dedup": NEAR_DEDUP,
    "op6_exact_dedup": EXACT_DEDUP,
    "op7_exact_top_k": TOP_K,
    "op10_mixing": mixing(),
    "op11_source_divergence": DIVERGENCE,
    "op12_periodic_runs": PERIODIC,
}

"""DuckDB twins of the registered queries (the six source tables are views)."""

from __future__ import annotations

#: (doc_id, source, measures, base_failed) of every document; shared with the pipeline's SQL.
QUALITY_BASE = r"""
q_text AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
q_words AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM q_text),
q_grams AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM q_words)),
q_again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM q_grams) WHERE c > 1),
q_repeat AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM q_again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
q_lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM q_text)
            WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
q_base AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(q_lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(q_repeat.n, 0) AS BIGINT) AS n_repeat_words
  FROM q_words LEFT JOIN q_lines USING (doc_id) LEFT JOIN q_repeat USING (doc_id)),
q_judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q_base),
q_hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM q_judged GROUP BY source),
q_all AS (SELECT sum(n) AS nn, sum(f) / sum(n) AS m FROM q_hosts),
q_spread AS (
  SELECT any_value(m) AS m, sum(n / nn * (f / n - m) ** 2) AS s, sum(n / nn * (1 - n / nn)) AS c,
         sum(n / nn * (1 - n / nn) / n) AS d FROM q_hosts, q_all),
q_prior AS (
  SELECT m, CASE WHEN m IN (0, 1) THEN 1e6
                 WHEN c > d THEN 1 / least(0.5, greatest(1 / (1 + 1e6), (s - m * (1 - m) * d) / (m * (1 - m) * (c - d)))) - 1
                 ELSE 1e6 END AS a FROM q_spread),
q_rates AS (SELECT source, (f + a * m) / (n + a) AS host_rate FROM q_hosts, q_prior),
q_kept AS (
  SELECT j.*, NOT base_failed AND host_rate <= 0.5 AS kept, host_rate
  FROM q_judged j JOIN q_rates r ON j.source IS NOT DISTINCT FROM r.source)
"""

QUALITY_RULES = f"""WITH {QUALITY_BASE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, source AS host,
       round(host_rate, 6) AS host_rate
FROM q_kept"""

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(name, rule_host, rule_path, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS ruled
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
ruled AS (SELECT parts.*, rule, ruled FROM parts LEFT JOIN fits USING (page_id)),
listed AS (SELECT host FROM ruled GROUP BY host HAVING count(*) FILTER (ruled = 'block') > 0.4 * count(*))
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""

#: Every word match of a document and an item proposes its alignment; no seeds are used.
DECONTAMINATION = r"""
WITH d_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b_words AS (
  SELECT min(item_id) AS item_id, w FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) >= 8 GROUP BY w),
d AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d_words),
b AS (SELECT item_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM b_words),
same AS (SELECT doc_id, item_id, d.p - b.p AS shift, b.p AS p, d.n AS dn, b.n AS bn FROM d JOIN b USING (x)),
near AS (
  SELECT doc_id, item_id, shift, any_value(dn) AS dn, any_value(bn) AS bn, list(p) AS ps
  FROM same GROUP BY ALL HAVING count(*) >= least(any_value(bn), 13) - CASE WHEN any_value(bn) < 13 THEN 0 ELSE 3 END),
starts AS (
  SELECT *, least(bn, 13) AS span, CASE WHEN bn < 13 THEN 0 ELSE 3 END AS allowed,
         unnest(generate_series(greatest(0, -shift), least(bn, dn - shift) - least(bn, 13))) AS q FROM near),
windows AS (
  SELECT doc_id, item_id, q + shift AS start, allowed, span - len(list_filter(ps, lambda y: y >= q AND y < q + span)) AS bad FROM starts)
SELECT doc_id, item_id, CAST(min(start) AS BIGINT) AS first_word, CAST(count(*) AS BIGINT) AS n_windows, CAST(min(bad) AS BIGINT) AS substitutions
FROM windows WHERE bad <= allowed GROUP BY doc_id, item_id"""


def _license_rows() -> str:
    from .licenses import template_bigrams

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, g))}])" for n, g in template_bigrams().items())


#: Every unit against every template, without the size listing.
LICENSES = r"""
WITH units AS (
  SELECT doc_id, 0 AS unit, coalesce(text, '') AS u FROM documents WHERE doc_id IS NOT NULL AND contains(text, chr(10))
  UNION ALL
  SELECT doc_id, generate_subscripts(l, 1) AS unit, unnest(l) AS u
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL)),
words AS (SELECT doc_id, unit, list_filter(string_split_regex(lower(u), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM units),
grams AS (SELECT doc_id, unit, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g
          FROM words WHERE len(w) > 1),
templates(license, t) AS (VALUES """ + _license_rows() + r"""),
dice AS (SELECT doc_id, license, unit, len(list_intersect(g, t)) AS c, len(g) + len(t) AS n FROM grams, templates)
SELECT doc_id, license, max(2.0::DOUBLE * c / n) AS dice, count(*) AS n_units, CAST(min(unit) AS BIGINT) AS first_unit
FROM dice WHERE 200 * c >= 80 * n GROUP BY doc_id, license"""


def _codebook_round(i: int) -> str:
    """Assignment to the codebooks b{i} and, up to the last one, their replacement b{i + 1}."""
    assigned = f"""
a{i} AS MATERIALIZED (
  SELECT r, part, x, arg_min(k, d * 256 + k) AS k, min(d) AS d FROM (
    SELECT r, parts.part, x, k, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d
    FROM parts JOIN b{i} ON parts.part = b{i}.part) GROUP BY r, part, x)"""
    replaced = f""",
n{i} AS (
  SELECT part, k, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM (
    SELECT part, k, pos, sum(v) AS s, count(*) AS n
    FROM (SELECT part, k, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY part, k, pos) GROUP BY part, k),
b{i + 1} AS MATERIALIZED (
  SELECT b{i}.part, b{i}.k, coalesce(n{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN n{i} ON n{i}.part = b{i}.part AND n{i}.k = b{i}.k)"""
    return assigned + (replaced if i < 4 else "")


#: Every distance to every entry, in whole numbers.
VECTOR_CODES = r"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT len(v) AS n FROM whole WHERE len(v) % 4 = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v, n // 4 AS w FROM whole JOIN size ON len(v) = n),
parts AS MATERIALIZED (
  SELECT r, p.part, v[p.part * w + 1:(p.part + 1) * w] AS x FROM kept, (SELECT unnest([0, 1, 2, 3]) AS part) p),
b0 AS MATERIALIZED (SELECT part, r - 1 AS k, x AS c FROM parts WHERE r <= 256),""" + ",".join(map(_codebook_round, range(5))) + r""",
coded AS (
  SELECT r, string_agg(printf('%02x', CAST(k AS INT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r),
digest AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, k, pos)) AS h
  FROM (SELECT part, k, unnest(c) AS v, generate_subscripts(c, 1) AS pos FROM b4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), digest"""

#: Every n-gram of every piece, grouped by its text.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, doc_id, row_number() OVER () AS id, w FROM (
    SELECT coalesce(lang, 'und') AS lang, doc_id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
      SELECT lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))
  WHERE len(w) > 0),
grams AS (
  SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (
    SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS p FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g),
sizes AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.k, c.g, c.f AS a, i, array_to_string(string_split(c.g, ' ')[1:i], ' ') AS lg, array_to_string(string_split(c.g, ' ')[i + 1:], ' ') AS rg
  FROM f c, (SELECT unnest([1, 2]) AS i) WHERE c.k > i AND c.f >= 10),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.g, a, i, lf.f AS l, rf.f AS r, CAST(1000000::HUGEINT * a * a // (lf.f::HUGEINT * rf.f) AS BIGINT) AS score
  FROM cuts JOIN f lf ON lf.lang = cuts.lang AND lf.g = lg JOIN f rf ON rf.lang = cuts.lang AND rf.g = rg),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
inside AS (
  SELECT lang, a, unnest([array_to_string(string_split(g, ' ')[1:2], ' '), array_to_string(string_split(g, ' ')[2:3], ' ')]) AS g FROM least WHERE k = 3),
kept AS (
  SELECT * FROM least WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = least.lang AND inside.g = least.g AND 100 * inside.a >= 50 * least.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""

"""SQL of the contracts that SQL expresses."""

from __future__ import annotations

from rowfield.llm.host_rules import Rules

OP3 = """
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisits THEN first END AS refers_to
FROM (SELECT *, strlen(html) >= 100 AND page_id <> first AS revisits
      FROM (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""


def op8(r: Rules = Rules()) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
c AS (
  SELECT rid, doc_id, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM d),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS e FROM c, unnest(range(1, len(w) - 1)) AS u(i)),
m AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, e) AS n FROM g) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT i + o) AS n FROM m, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
f AS (
  SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(l) AS n_lines, n_upper
  FROM c LEFT JOIN p USING (rid)),
x AS (
  SELECT *, n_words < {r.min_words} OR n_repeat_words > {r.max_repeat_share} * n_words AS base_failed,
         greatest(CASE WHEN n_words > 0 THEN n_symbols / ({r.max_symbols_per_word}::DOUBLE * n_words) ELSE 0 END,
                  CASE WHEN n_lines > 0 THEN n_dup_lines / ({r.max_dup_line_share}::DOUBLE * n_lines) ELSE 0 END,
                  CASE WHEN word_chars > 0 THEN n_upper / ({r.max_upper_share}::DOUBLE * word_chars) ELSE 0 END) AS excess
  FROM f),
h AS (SELECT source, count(*)::DOUBLE AS docs, sum(CASE WHEN base_failed OR excess > 1 THEN 1 ELSE 0 END)::DOUBLE AS failures FROM x GROUP BY source),
a AS (SELECT least(greatest(avg(failures / docs), 1e-6), 1 - 1e-6) AS mean, coalesce(var_pop(failures / docs), 0) AS v, avg(1 / docs) AS inv FROM h),
s AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-9) - 1, 1.0), 1e6) AS strength FROM a),
v AS (SELECT source, (failures + mean * strength) / (docs + strength) AS host_rate, mean FROM h, s),
k AS (SELECT source, host_rate, least(greatest((mean / (1 - mean)) * (1 - host_rate) / host_rate, {r.least_limit}), {r.most_limit}) AS host_limit FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND excess <= host_limit AS kept,
       round(host_rate, 6) AS host_rate, round(host_limit, 6) AS host_limit
FROM x JOIN k ON x.source IS NOT DISTINCT FROM k.source
"""


ORACLES = {"op3_warc_zip": OP3, "op8_host_rules": op8()}

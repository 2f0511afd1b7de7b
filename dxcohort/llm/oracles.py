"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import BASE_PHRASES, K, MIN_COVERAGE, SLACK, TEMPLATES
from .queries import SPAM_SITES, URL_RULES

OP8 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

OP10 = rf"""
WITH cut AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
             FROM pages),
u AS (SELECT page_id, r, rest,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
          lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params FROM cut),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)$', ''), '^(www|m)\.', '')
        || regexp_replace(path, '(/index\.html?|\.html?|/)$', '')
        || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM u),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\.)({"|".join(SPAM_SITES)})\.') AND canonical <> ''),
rules(rhost, rpath, rverdict) AS (VALUES {_RULES}),
fit AS (SELECT r, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
        FROM c JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r)
SELECT page_id, host, path, rule,
       coalesce(rverdict, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
       canonical IN (SELECT canonical FROM listed) AS listed
FROM c LEFT JOIN fit USING (r)
"""

_PHRASES = ", ".join(
    f"({i}, '{label}', {str(base).lower()}, string_split('{phrase}', ' '))"
    for i, (base, (label, phrase)) in enumerate([(True, p) for p in BASE_PHRASES]
                                                + [(False, p) for p in TEMPLATES]))

OP3 = rf"""
WITH phrases(template, label, base, pw) AS (VALUES {_PHRASES}),
tgrams AS (SELECT template, label, base, len(pw) - {K - 1} AS grams, j - 1 AS tpos, pw[j:j+{K - 1}] AS gram
           FROM phrases, unnest(generate_series(1, len(pw) - {K - 1})) AS g(j)),
d AS (SELECT doc_id, row_number() OVER () AS r,
        list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
dgrams AS (SELECT r, i - 1 AS p, w[i:i+{K - 1}] AS gram FROM d, unnest(generate_series(1, len(w) - {K - 1})) AS g(i)),
lines AS (SELECT r, template, label, base, grams, p - tpos AS diagonal, list(DISTINCT tpos) AS tset, min(tpos) AS lo, max(tpos) AS hi
          FROM dgrams JOIN tgrams USING (gram) GROUP BY ALL),
cut AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {SLACK}, true)
                  THEN 1 ELSE 0 END AS fresh FROM lines),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM cut),
spans AS (SELECT r, template, label, base, min(diagonal + lo) AS start, len(list_distinct(flatten(list(tset)))) / grams AS coverage
          FROM numbered GROUP BY r, template, label, base, grams, span),
judged AS (SELECT *, CASE WHEN base THEN coverage = 1 ELSE coverage >= {MIN_COVERAGE} END AS verified FROM spans),
found AS (SELECT r, count(*) FILTER (base AND verified) AS n_base, min(start) FILTER (base AND verified) AS first_word,
            max(start) FILTER (base AND verified) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND verified) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels,
            max(coverage) FILTER (verified OR NOT base) AS score FROM judged GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": OP3, "op8_exact_dedup": OP8, "op10_url_filter": OP10}

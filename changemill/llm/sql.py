"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

#: Host labels whose pages make up the list of unwanted URLs, of the query and of its SQL: every label of the given
#: pages' hosts that names advertising, spam, gambling, adult content or pills.
UNWANTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

SQL["op8_url_filter"] = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
c AS (SELECT *, regexp_replace(host, '^www\\.', '') || rtrim(path, '/') AS form FROM p),
bad AS (SELECT DISTINCT form FROM c
        WHERE list_has_any(string_split(host, '.'), {UNWANTED_LABELS})),
rules(kind, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT c.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(kind, length(h || p)) AS kind
      FROM (SELECT DISTINCT page_id, host, path FROM c) AS c JOIN (SELECT kind, h, p FROM rules) AS rules
      ON (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p) GROUP BY c.page_id)
SELECT c.page_id, c.host, c.path, f.rule,
       coalesce(f.kind, CASE WHEN c.form <> '' AND c.form IN (SELECT form FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN f ON c.page_id = f.page_id"""

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op5_line_dedup"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS dropped FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id"""

SQL["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v AS a, v AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS n FROM s WHERE same),
w AS (SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS n
      FROM p JOIN s ON p.anchor_id = s.anchor_id
      WHERE p.n <= 5 AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, n::INTEGER AS rank, negative_id, positive_score, negative_score FROM w WHERE n <= 3"""

SQL["op6_ngram_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i + 3], ' '))) AS shingle
      FROM w WHERE len(words) > 0),
n AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON n.doc_id = reach.a GROUP BY n.doc_id, n.n"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

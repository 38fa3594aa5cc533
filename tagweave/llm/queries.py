"""Registered queries of the numbered operators and their SQL."""

from __future__ import annotations

from tagweave.llm.bpe import op5_bpe_round_trip
from tagweave.llm.decontaminate import op2_decontamination
from tagweave.llm.exact import op11_exact_dedup
from tagweave.llm.jaccard import op3_ngram_jaccard
from tagweave.llm.licenses import TEMPLATES, op9_license_scan
from tagweave.llm.lines import op10_line_dedup
from tagweave.llm.prefix_trie import op12_prefix_trie
from tagweave.llm.quality import op8_quality_rules
from tagweave.llm.secrets import op4_secret_scan
from tagweave.llm.token_counts import op1_token_counts
from tagweave.llm.toxicity import op6_toxicity
from tagweave.llm.warc import op7_warc_revisits
from tagweave.llm.whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_decontamination, op3_ngram_jaccard, op4_secret_scan, op5_bpe_round_trip, op6_toxicity, op7_warc_revisits,
    op8_quality_rules, op9_license_scan, op10_line_dedup, op11_exact_dedup, op12_prefix_trie, op13_embedding_whitening)}

_SECRET_ASSIGN = (r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
                  r"[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                  r"""["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+))""")
SECRET_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS src, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, src, 0 AS k, 'assign' AS kind, t, '{_SECRET_ASSIGN}' AS p, 2 AS grp, 6 AS need FROM d
  UNION ALL SELECT doc_id, src, 1, 'access', t, '(AKIA[A-Z0-9]+)', 1, 20 FROM d
  UNION ALL SELECT doc_id, src, 2, 'hex', t, '([0-9a-f]+)', 1, 24 FROM d
  UNION ALL SELECT doc_id, src, 3, 'owned', t, '([A-Za-z0-9+/_=-]+)', 1, 20 FROM d),
f AS (
  SELECT doc_id, src, k, kind, need, string_split_regex(t, p) AS g, regexp_extract_all(t, p) AS w,
         CASE WHEN grp = 2 THEN regexp_extract_all(t, '{_SECRET_ASSIGN}', 2) ELSE regexp_extract_all(t, p) END AS v
  FROM m),
n AS (
  SELECT doc_id, src, k, kind, need, unnest(w) AS one, unnest(v) AS val, unnest(g[1:len(w)]) AS gap,
         unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) > 0),
c AS (
  SELECT *, sum(length(gap) + length(one)) OVER (PARTITION BY doc_id, k ORDER BY i) AS fin FROM n),
s AS (
  SELECT doc_id, src, k, kind, val, CAST(fin - length(one) AS BIGINT) AS st, CAST(fin AS BIGINT) AS en FROM c
  WHERE length(val) >= need AND (k < 3 OR regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')
        AND regexp_matches(val, '[0-9].*[0-9]'))),
o AS (SELECT val, count(DISTINCT src) AS owners FROM s GROUP BY val),
j AS (SELECT s.*, owners FROM s JOIN o USING (val)),
base AS (SELECT * FROM j WHERE k < 3),
more AS (
  SELECT * FROM j a WHERE k = 3 AND owners <= 1 AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.st < a.en AND a.st < b.en)),
per_base AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
         count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (owners <= 1) AS n_live,
         count(*) FILTER (owners >= 3) AS n_copied,
         string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k) AS l FROM base GROUP BY doc_id),
per_all AS (
  SELECT doc_id, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k, en) AS l
  FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.l, '')) AS base_sha256, coalesce(a.l, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per_base b USING (doc_id) LEFT JOIN per_all a USING (doc_id)
"""

_TEMPLATE_ROWS = ", ".join("('" + "', '".join(v.replace("'", "''") for v in row) + "')" for row in TEMPLATES)
_WORDS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
LICENSE_SQL = f"""
WITH t AS (SELECT license, family, {_WORDS.format("text")} AS w
           FROM (VALUES {_TEMPLATE_ROWS}) v(license, family, text)),
ts AS (SELECT DISTINCT license, family, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM t)),
tn AS (SELECT license, family, count(*) AS n, greatest(ceil(log(greatest(count(*), 1)) / log(2) - 1e-9), 0) AS c
       FROM ts GROUP BY ALL),
steps AS (SELECT c, max(n) AS step FROM tn GROUP BY c),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
held AS (SELECT DISTINCT doc_id, c, i, s FROM ds JOIN (SELECT DISTINCT s, c FROM ts JOIN tn USING (license, family))
         USING (s)),
placed AS (SELECT doc_id, c, s, dense_rank() OVER (PARTITION BY doc_id, c ORDER BY i) - 1 AS i FROM held),
m AS (SELECT DISTINCT doc_id, license, family, n, i, step, s
      FROM placed JOIN (SELECT * FROM ts JOIN tn USING (license, family)) USING (s, c) JOIN steps USING (c)),
win AS (SELECT doc_id, license, family, n, s, i // step AS win FROM m
        UNION ALL SELECT doc_id, license, family, n, s, i // step - 1 FROM m),
per AS (SELECT doc_id, license, family, n, win, count(DISTINCT s) AS k FROM win GROUP BY ALL),
best AS (SELECT doc_id, license, family, n, max(k) AS k FROM per WHERE k >= 0.8 * n - 1e-9 GROUP BY ALL)
SELECT doc_id, license, family, k AS n_shared, n AS n_shingles, CAST(k AS DOUBLE) / n AS containment,
       row_number() OVER (PARTITION BY doc_id, family ORDER BY CAST(k AS DOUBLE) / n DESC, n DESC, license) = 1 AS best
FROM best
"""

WARC_SQL = r"""
WITH p AS (
  SELECT page_id AS n, html, md5(html) AS tag, 'day ' || page_id AS day,
         regexp_replace(url, '#.*$', '') AS bare FROM pages),
q AS (
  SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS front,
         regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM p),
u AS (
  SELECT n, html, tag, day,
         regexp_replace(regexp_replace(front, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
         || CASE WHEN regexp_replace(rest, '\?.*$', '') = '' THEN '/' ELSE regexp_replace(rest, '\?.*$', '') END AS path,
         list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN regexp_replace(rest, '^[^?]*\?', '')
           ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params
  FROM q),
c AS (SELECT n, html, tag, day, path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END
      AS url FROM u),
full_ AS (
  SELECT 'page-' || n || '-1' AS id, url, n * 10 + 1 AS ts, '"' || tag || '"' AS etag, day AS lm,
         strlen(html)::VARCHAR AS size, html AS body FROM c WHERE n % 4 <> 3
  UNION ALL
  SELECT 'page-' || n || '-5', url, n * 10 + 5, '"' || tag || '-2"', day || ' late', NULL, html || '<!-- 2 -->'
  FROM c WHERE n % 3 = 0),
rev AS (
  SELECT 'page-' || n || '-3' AS record_id, url, n * 10 + 3 AS ts, '"' || tag || '"' AS match, 'W/"' || tag || '"' AS etag,
         NULL AS lm, '7' AS age, 'text/plain' AS kind FROM c
  UNION ALL
  SELECT 'page-' || n || '-7', url, n * 10 + 7, CASE WHEN n % 5 <> 1 THEN '"' || tag || '-2"' END,
         CASE WHEN n % 5 <> 1 THEN '"' || tag || '-2"' END, day || ' late', '9', NULL FROM c),
j AS (
  SELECT r.*, f.id AS refers_to, f.etag AS old_etag, f.lm AS old_lm, f.size AS old_size, f.body,
         CASE WHEN f.id IS NULL THEN 'no_earlier'
              WHEN CASE WHEN r.match IS NOT NULL THEN r.match = f.etag ELSE r.lm = f.lm END THEN 'resolved'
              ELSE 'mismatch' END AS outcome
  FROM rev r ASOF LEFT JOIN full_ f ON r.url = f.url AND r.ts > f.ts)
SELECT record_id, url, ts, outcome, refers_to,
       sha256(array_to_string(list_sort(list_filter(CASE WHEN outcome = 'resolved'
         THEN ['etag:' || coalesce(etag, old_etag), 'last-modified:' || coalesce(lm, old_lm), 'content-type:text/html',
               'content-length:' || old_size, 'x-age:' || age]
         ELSE ['etag:' || etag, 'last-modified:' || lm, 'content-type:' || kind, 'x-age:' || age] END,
         lambda x: x IS NOT NULL)), chr(10))) AS headers_sha256,
       CASE WHEN outcome = 'resolved' THEN sha256(body) END AS body_sha256
FROM j
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

# one step of crc32 takes a byte into the value: eight shifts by the reversed polynomial
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
TRIE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role,
               sha256(octet_length(encode(role)) || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, ({_CRC.format("conv_id::VARCHAR")}) % 9 AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(d.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
      FROM h LEFT JOIN own d ON d.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS len, unnest(range(0, len(turns) + 1)) AS d, turns FROM r),
m AS (SELECT conv_id, len, d, turns[1:d] AS path FROM p),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends_sha256
          FROM m GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n, 0) AS n_children,
                 CASE WHEN nodes.d > 0 THEN (n_convs - 1) * strlen(nodes.path[nodes.d].text) ELSE 0 END AS own
          FROM nodes LEFT JOIN kids USING (path, d)),
up AS (SELECT path[1:a] AS path, a AS d, own, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_)),
subs AS (SELECT path, d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN subs USING (path, d) LEFT JOIN nodes q ON q.d = f.d - 1 AND q.path = f.path[1:f.d - 1]
"""
ORACLES: dict[str, str] = {"op7_warc_revisits": WARC_SQL, "op4_secret_scan": SECRET_SQL, "op9_license_scan": LICENSE_SQL,
                           "op11_exact_dedup": EXACT_SQL, "op12_prefix_trie": TRIE_SQL}

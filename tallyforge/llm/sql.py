"""DuckDB twins of the queries that SQL can express."""

SQL = {}

SQL["op1_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(k) ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
      SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM dup)) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""

SQL["op2_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b, s = na AND s = nb AS same FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS s FROM g x JOIN g y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN (SELECT doc_id AS a, n AS na FROM n) USING (a) JOIN (SELECT doc_id AS b, n AS nb FROM n) USING (b)
  WHERE 1000 * s >= 800 * (na + nb - s)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
grp AS (SELECT a AS doc_id, min(b) AS group_id FROM reach GROUP BY a)
SELECT doc_id, least(doc_id, (SELECT min(b) FROM link WHERE a = doc_id AND same)) AS class_id, group_id, (SELECT count(*) FROM link WHERE a = doc_id) AS n_links
FROM grp"""

SQL["op5_decontaminate"] = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
items AS (
  SELECT item_id, ws, least(13, len(ws)) AS n FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark)
  WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM items) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)"""

SQL["op8_quality_rules"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
lw AS (
  SELECT doc_id, ls, list_transform(ls, lambda x: list_filter(regexp_split_to_array(x, '[ \x09-\x0D]+'), lambda y: y <> '')) AS ws,
         list_transform(ls, lambda x: regexp_replace(regexp_replace(x, '^[ \x09-\x0D>|·•»›]+', ''), '[ \x09-\x0D]>([ \x09-\x0D])', ' |\1', 'g')) AS bare,
         list_transform(ls, lambda x: regexp_matches(x, '[.!?…:;,。！？)\]"''”’»][ \x09-\x0D]*$')) AS ended FROM w),
op AS (SELECT *, list_transform(range(1, len(ls) + 1), lambda k: CASE WHEN len(ws[k]) BETWEEN 2 AND 6 AND NOT ended[k] THEN ws[k][1] || ' ' || ws[k][2] END) AS ops FROM lw),
good AS (
  SELECT doc_id, list_transform(list_filter(range(1, len(ls) + 1), lambda k: NOT (
      (length(regexp_replace(ls[k], '[^#*$%&<>]+', '', 'g')) >= 3 AND 8 * length(regexp_replace(ls[k], '[^#*$%&<>]+', '', 'g')) > length(ls[k]))
      OR (length(regexp_replace(ls[k], '[^!]+', '', 'g')) >= 3 AND 8 * length(regexp_replace(ls[k], '[^!]+', '', 'g')) > length(ls[k]))
      OR (regexp_matches(bare[k], '[|·•»›]') AND len(list_filter(regexp_split_to_array(translate(bare[k], '|·•»›', '     '), '[ \x09-\x0D]+'), lambda y: y <> '')) <= 3 * (length(regexp_replace(bare[k], '[^|·•»›]+', '', 'g')) + 1))
      OR (len(ws[k]) >= 4 AND NOT ended[k] AND 5 * len(list_filter(ws[k], lambda y: regexp_matches(y, '^\p{Lu}'))) >= 4 * len(ws[k]))
      OR (len(ws[k]) >= 4 AND 3 * len(list_filter(range(2, len(ws[k]) + 1), lambda j: ws[k][j] = ws[k][j - 1])) >= len(ws[k]))
      OR (ops[k] IS NOT NULL AND len(list_filter(ops, lambda y: y = ops[k])) >= 4)
      OR regexp_matches(ls[k], '^[^a-zA-Z0-9]*(?:[cC][oO][pP][yY][rR][iI][gG][hH][tT]|©|\([cC]\)).*(?:19|20)[0-9][0-9]')
      OR regexp_matches(lower(ls[k]), 'all rights reserved|licensed under|terms of use|terms of service|privacy policy|cookie policy|uses cookies|use of cookies|enable javascript|javascript is disabled|lorem ipsum|subscribe to our|sign up for|click here|skip to content|powered by|alle rechte vorbehalten|lizenziert unter|nutzungsbedingungen|verwendet cookies|verwendung von cookies|newsletter abonnieren|hier klicken|zum inhalt springen|tous droits réservés|sous licence|conditions d''utilisation|politique de confidentialité|utilise des cookies|cliquez ici|aller au contenu|todos los derechos reservados|bajo la licencia|condiciones de uso|política de privacidad|utiliza cookies|uso de cookies|haga clic aquí|ir al contenido'))), lambda k: ls[k]) AS gs
  FROM op),
b AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, length(array_to_string(ls, '')) AS whole, length(array_to_string(gs, '')) AS rest
  FROM w JOIN good USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (whole = 0 OR (whole - rest) / whole <= 0.3) AS kept
FROM f"""

SQL["op9_warc_fixity"] = r"""
WITH r AS (
  SELECT page_id, floor(page_id / 256)::BIGINT AS file,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages),
o AS (
  SELECT page_id, file, row_number() OVER w - 1 AS seq, strlen(rec)::BIGINT AS length, sha256(rec) AS sha256,
         coalesce(sum(strlen(rec)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT page_id, file, seq, "offset", length, sha256, substr(md5(page_id::VARCHAR), 1, 2) NOT IN ('07', '2a', 'a3', 'c5', 'e1') AS intact FROM o"""

"""DuckDB SQL of the opN_ queries that SQL can express; written apart from the operators."""

from __future__ import annotations

from .queries import SHARD_BYTES, URL_RULES

_rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

_PAGES = """u AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, html, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*(\\?[^#]*)?', 1) AS query FROM u)"""

#: Classes come from a recursive closure over link(src, dst).
_CLASSES = """both_ways AS (SELECT src, dst FROM link WHERE src <> dst UNION SELECT dst, src FROM link WHERE src <> dst),
reach(node, other) AS (SELECT src, src FROM both_ways UNION SELECT reach.node, both_ways.dst FROM reach JOIN both_ways ON reach.other = both_ways.src),
fit AS (SELECT node, arg_max(a, length(h || p)) AS a FROM (SELECT DISTINCT node FROM reach) n, rules
        WHERE (split_part(node, '/', 1) = h OR ends_with(split_part(node, '/', 1), '.' || h)) AND starts_with(regexp_extract(node, '^[^/?]*([^?]*)', 1), p) GROUP BY node),
shared AS (SELECT reach.node, min(other) AS class_id, CASE WHEN bool_or(a = 'allow') THEN 'allow' WHEN bool_or(a = 'block') THEN 'block' END AS a
           FROM reach LEFT JOIN fit ON fit.node = reach.other GROUP BY reach.node),
own AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(a, length(h || p)) AS a
        FROM s, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(own.a, shared.a, 'allow') AS verdict, class_id
FROM s LEFT JOIN own USING (page_id) LEFT JOIN shared ON shared.node = host || path || query"""

#: Links: a page's first canonical tag with an absolute target.
OP1 = f"""
WITH RECURSIVE rules(h, p, a) AS (VALUES {_rules}), {_PAGES},
raw AS (SELECT host || path || query AS src, regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*["'']([^"'']*)', 1) AS t FROM s WHERE host <> ''),
link AS (SELECT DISTINCT src, split_part(split_part(t, '://', 2), '#', 1) AS dst FROM raw WHERE t LIKE '%://%'),
{_CLASSES}
"""

#: The links that the query plants, by page id.
ALIASES = f"""
WITH RECURSIVE rules(h, p, a) AS (VALUES {_rules}), {_PAGES},
n AS (SELECT page_id AS i, host || path || query AS a, 'mirror.org/' || page_id // 40 AS m, page_id % 10 AS k FROM s WHERE host <> ''),
link AS (SELECT a AS src, 'hub.net/es/front' AS dst FROM n WHERE k = 0 UNION SELECT a, m FROM n WHERE k IN (1, 2, 3) OR i % 30 = 5 UNION SELECT a, 'b.net/fr/' || i // 400 FROM n WHERE k = 3
  UNION SELECT a, 'mirror.org/' || (i // 40 + 1) FROM n WHERE k = 4 AND i // 40 % 5 <> 4 UNION SELECT 'mirror.org/' || page_id // 40, 'ok.com/x' FROM pages WHERE page_id % 280 = 5),
{_CLASSES}
"""

OP2 = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i,
             coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
m AS (SELECT p.conv_id, perspective, i, role = perspective AS own,
        '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
          ELSE 'user name=' || regexp_replace(role, '[^\\p{L}\\p{N}_.-]+', '_', 'g') END || chr(10) AS head, text || '<|im_end|>' AS body
      FROM p JOIN t USING (conv_id)),
a AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos FROM m)
SELECT conv_id, perspective, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY i) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(pos AS BIGINT) || '-' || CAST(pos + length(body) AS BIGINT) END, ',' ORDER BY i), '') AS mask
FROM a GROUP BY conv_id, perspective
"""


# The line rules, written out apart from the operator's.
_END = r"[.!?…。！？][\"'”’»)\]]*($|[\x20\x09-\x0D])".replace("'", "''")
_BARS = r"[|»›•·]|(^|\s)[/>](\s|$)"
_LEADS = (
    r"(?i)^\W*(home|menu|next|prev(ious)?|back|top|search|login|log in|sign (in|up)|register|contact( us)?|about( us)?|sitemap|share|(read )?more|help|faq|skip to content"
    r"|startseite|menü|weiter|zurück|suche|anmelden|registrieren|kontakt|über uns|teilen|weiterlesen|mehr( lesen)?|hilfe|zum inhalt"
    r"|inicio|menú|siguiente|anterior|volver|buscar|iniciar sesión|registrarse|contacto|acerca de|sobre nosotros|compartir|(leer )?más|ayuda|ir al contenido"
    r"|accueil|suivant|précédent|retour|rechercher|connexion|inscription|se connecter|à propos|partager|lire la suite|plus|aide|aller au contenu)\W*$"
)
_NOTICES = (
    r"(?i)all rights reserved|licensed under|released under the|©|&copy;|cookie (policy|settings|notice)|uses cookies|privacy policy|terms of (use|service)|enable javascript|click here|subscribe to|newsletter"
    r"|lorem ipsum|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|todos los derechos reservados|política de privacidad|términos de uso|tous droits réservés"
    r"|politique de confidentialité|conditions d''utilisation"
)


OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS full_, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
b AS (SELECT doc_id, line, full_, nw > 0 AND ((nw >= 4 AND NOT regexp_matches(line, '{_END}')) OR regexp_matches(line, '{_LEADS}')
        OR len(regexp_extract_all(line, '{_BARS}')) >= greatest(2.0, nw * (1.0 / 3)) OR regexp_matches(line, '{_NOTICES}')) AS bad FROM l),
s AS (SELECT doc_id, count(*) FILTER (full_) - count(DISTINCT line) FILTER (full_) AS n_dup_lines, count(*) FILTER (bad) AS n_lines_removed,
        coalesce(sum(length(line)) FILTER (bad), 0) AS lost_chars, coalesce(sum(length(line)) FILTER (full_), 0) AS line_chars FROM b GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws)) AS base_failed,
  NOT (len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws)) AND lost_chars <= 0.5 * line_chars AS kept,
  n_lines_removed::BIGINT AS n_lines_removed, lost_chars::BIGINT AS lost_chars
FROM w LEFT JOIN rep USING (doc_id) JOIN s USING (doc_id)
"""

#: A row's bucket is its shallowest prefix whose rows fit the limit.
OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
lv AS (SELECT doc_id, bytes, h, depth, h >> (60 - depth) AS prefix FROM d, (SELECT unnest(range(0, 30))::INTEGER AS depth)),
sums AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes FROM lv GROUP BY ALL HAVING sum(bytes) <= {SHARD_BYTES} OR count(DISTINCT h) = 1)
SELECT doc_id, prefix, depth, 0::BIGINT AS page, shard_bytes, bytes FROM lv JOIN sums USING (depth, prefix)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


#: Every 50-byte window of every text as hex digits; a window goes if it also starts in a document of smaller id.
OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > least),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS opens FROM r),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b NULLS LAST), 0) AS since FROM cuts)
SELECT doc_id, any_value(length(h) // 2)::BIGINT AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(b)::BIGINT AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, b NULLS LAST))) AS kept_sha256
FROM parts JOIN d USING (doc_id) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1, "url_alias_classes": ALIASES, "op2_chat_formatting": OP2, "op3_quality_rules": OP3, "op5_sharding": OP5, "op7_suffix_dedup": OP7}

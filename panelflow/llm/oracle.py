"""Independent DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import license_scan, quality_rules
from .mixing import SEED

SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _stop_list() -> str:
    return "[" + ", ".join(_quote(w) for w in quality_rules.STOP_WORDS) + "]"


SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SPLIT} AS w FROM documents),
     g AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s
           FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
     twice AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
     gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM g JOIN twice USING (s))),
     cut AS (SELECT rid, list(p) AS ps FROM gone GROUP BY rid),
     kept AS (SELECT d.doc_id, len(w) AS n, CASE WHEN ps IS NULL THEN w ELSE
                     list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS k
              FROM d LEFT JOIN cut USING (rid))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {SPLIT} AS w FROM documents),
     g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s
           FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
     twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
     rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
     l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
     m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
                  coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                  len(list_filter(w, lambda x: list_contains({_stop_list()}, x))) AS n_stop
           FROM d JOIN l USING (rid) LEFT JOIN rep USING (rid)),
     f AS (SELECT *, concat_ws(',',
                  CASE WHEN n_words < 10 THEN 'length_min' END,
                  CASE WHEN word_chars::DOUBLE / greatest(n_words, 1) < 2 THEN 'word_length_min' END,
                  CASE WHEN word_chars::DOUBLE / greatest(n_words, 1) > 15 THEN 'word_length_max' END,
                  CASE WHEN n_symbols::DOUBLE / greatest(n_words, 1) > 0.25::DOUBLE THEN 'symbols_max' END,
                  CASE WHEN (n_stop + 1)::DOUBLE / (greatest(n_words, 1) + 1) < 0.05::DOUBLE THEN 'stop_words_min' END,
                  CASE WHEN n_dup_lines::DOUBLE / greatest(n_lines, 1) > 0.5::DOUBLE THEN 'repeated_lines_max' END,
                  CASE WHEN n_repeat_words::DOUBLE / greatest(n_words, 1) > 0.2::DOUBLE THEN 'repeated_words_max' END) AS failed_rules,
                  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM f
"""


def _license_sql() -> str:
    ls = license_scan
    found = r"\b(" + "|".join(a for a, _ in ls.SPELLINGS) + r")\b"
    unified = "t"
    for a, b in ls.SPELLINGS:
        unified = f"regexp_replace({unified}, '\\b{a}\\b', '{b}', 'g')"

    def canon(source: str) -> str:
        return f"""SELECT * EXCLUDE (raw, t), CASE WHEN regexp_matches(t, '{found}') THEN {unified} ELSE t END AS canon
            FROM (SELECT *, regexp_replace(regexp_replace(lower(coalesce(raw, '')), {_quote(ls.COPYRIGHT_LINE)}, '', 'g'),
                                           '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS t FROM {source})"""

    digest = r"sha256(trim(regexp_replace({0}, '[ \n]+', ' ', 'g')))"
    lic = ", ".join(f"({_quote(k)}, {_quote(t)})" for k, t in sorted(ls.LICENSES.items()))
    notes = ", ".join(f"({_quote(k)}, {_quote(t)})" for k, ts in sorted(ls.NOTICES.items()) for t in ts)
    longest = max(len(t) for ts in ls.NOTICES.values() for t in ts) + 64
    return f"""
WITH raw_docs AS (SELECT row_number() OVER () AS rid, doc_id, text AS raw FROM documents),
     raw_lic AS (SELECT * FROM (VALUES {lic}) AS x(license_id, raw)),
     raw_note AS (SELECT * FROM (VALUES {notes}) AS x(notice_id, raw)),
     d AS ({canon('raw_docs')}),
     known AS (SELECT license_id, {digest.format('canon')} AS digest FROM ({canon('raw_lic')})),
     notes AS (SELECT DISTINCT notice_id, {digest.format('canon')} AS digest FROM ({canon('raw_note')})),
     lines AS (SELECT doc_id, {digest.format('line')} AS digest
               FROM (SELECT doc_id, unnest(string_split(canon, chr(10))) AS line FROM d)
               WHERE length(line) <= {longest} AND contains(line, 'license')),
     hits AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT notice_id)), ',') AS ids
              FROM lines JOIN notes USING (digest) GROUP BY doc_id)
SELECT d.doc_id, {digest.format('canon')} AS digest, license_id, coalesce(n, 0)::BIGINT AS n_notices, ids AS notices
FROM d LEFT JOIN known ON known.digest = {digest.format('canon')} LEFT JOIN hits ON hits.doc_id IS NOT DISTINCT FROM d.doc_id
"""


URLS = r"""
WITH RECURSIVE p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
     r AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                          WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                          WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                          WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                          WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
                  list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM p),
     s AS (SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS says,
                  list_transform(parts, lambda x: regexp_replace(x,
                      '[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,}|[0-9]+', '*', 'g')) AS segs FROM r),
     t AS (SELECT *, array_to_string(segs, '/') AS tpl FROM s),
     leaves AS (SELECT host, tpl, segs, count(says) AS nl, count(*) FILTER (says = 'block') AS nb FROM t GROUP BY ALL),
     lev AS (SELECT host, tpl, nl, nb, d, array_to_string(segs[1:d], '/') AS node, array_to_string(segs[1:d - 1], '/') AS parent
             FROM (SELECT *, unnest(range(0, len(segs) + 1)) AS d FROM leaves)),
     nodes AS (SELECT host, d, node, parent, sum(nl)::BIGINT AS n, sum(nb)::BIGINT AS b FROM lev GROUP BY ALL),
     alike AS (SELECT *, row_number() OVER (PARTITION BY host, d, parent ORDER BY b::DOUBLE / n, n) AS r
               FROM (SELECT host, d, parent, n, b, count(*) AS k FROM nodes WHERE d > 0 AND n > 0 GROUP BY ALL)),
     fold AS (SELECT host, d, parent, r, k * n AS gn, k * b AS gb, n AS rn, b AS rb, 1 AS g FROM alike WHERE r = 1
              UNION ALL
              SELECT a.host, a.d, a.parent, a.r, CASE WHEN x.apart THEN 0 ELSE f.gn END + a.k * a.n,
                     CASE WHEN x.apart THEN 0 ELSE f.gb END + a.k * a.b, CASE WHEN x.apart OR a.n > f.rn THEN a.n ELSE f.rn END,
                     CASE WHEN x.apart OR a.n > f.rn THEN a.b ELSE f.rb END, f.g + x.apart::INT
              FROM fold f JOIN alike a ON a.host = f.host AND a.d = f.d AND a.parent = f.parent AND a.r = f.r + 1,
                   LATERAL (SELECT pow(a.b::DOUBLE / a.n - f.rb::DOUBLE / f.rn, 2) * a.n * f.rn
                                   > 3.84::DOUBLE * ((f.rb + a.b)::DOUBLE / (f.rn + a.n)) * (1 - (f.rb + a.b)::DOUBLE / (f.rn + a.n)) * (f.rn + a.n) AS apart) x),
     sums AS (SELECT host, d, parent, g, arg_max(gn, r) AS gn, arg_max(gb, r) AS gb FROM fold GROUP BY ALL),
     placed AS (SELECT nodes.host, nodes.d, node, sums.gn, sums.gb
                FROM nodes JOIN alike a USING (host, d, parent, n, b) JOIN fold f ON f.host = a.host AND f.d = a.d AND f.parent = a.parent AND f.r = a.r
                           JOIN sums ON sums.host = a.host AND sums.d = a.d AND sums.parent = a.parent AND sums.g = f.g),
     overall AS (SELECT (sum(b) + 1)::DOUBLE / (sum(n) + 2) AS share FROM nodes WHERE d = 0),
     pur AS (SELECT host, tpl, 0 AS d, (b + 8 * share) / (n + 8) AS purity FROM leaves JOIN (SELECT host, n, b FROM nodes WHERE d = 0) USING (host), overall
             UNION ALL
             SELECT pur.host, pur.tpl, lev.d, (coalesce(gb, 0) + 8 * purity) / (coalesce(gn, 0) + 8)
             FROM pur JOIN lev ON lev.host = pur.host AND lev.tpl = pur.tpl AND lev.d = pur.d + 1
                      LEFT JOIN placed ON placed.host = lev.host AND placed.d = lev.d AND placed.node = lev.node),
     says AS (SELECT host, tpl, CASE WHEN arg_max(purity, d) > 0.5 THEN 'block' ELSE 'allow' END AS v FROM pur GROUP BY ALL)
SELECT page_id, t.host, t.path, t.rule, coalesce(t.says, says.v) AS verdict, t.tpl AS template FROM t JOIN says USING (host, tpl)
"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, len({SPLIT})::BIGINT AS size,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D#*$%&|<>]+', '', 'g') AS plain,
                  (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-' || coalesce(md5(text), ''))), 1, 13))::BIGINT::DOUBLE
                   + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
     k AS (SELECT *, -ln(u) / greatest(0.05::DOUBLE, coalesce(length(plain)::DOUBLE / nullif(length(chars), 0), 0)) AS key FROM d),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM k GROUP BY source),
     c AS (SELECT *, [3.0, 1.0, 2.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
     l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0))
                     / nullif(sum(w) OVER () - coalesce(sum(w) OVER before, 0), 0) AS level
           FROM c WINDOW before AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     pick AS (SELECT level FROM l WHERE cap / w >= level ORDER BY cap / w, rank LIMIT 1),
     t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM pick)) AS target FROM c),
     o AS (SELECT k.doc_id, size, t.source_size, t.target, sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id) - size AS reached,
                  least(2, floor(coalesce(target / nullif(source_size, 0), 0))) AS epochs
           FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (size * (epochs + CASE WHEN epochs < 2 AND size > 0 AND reached + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""

DECONTAMINATE = r"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item,
                  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
     d AS (SELECT row_number() OVER () AS rid, doc_id,
                  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
     i AS (SELECT item, w, least(len(w), 10) AS t FROM b WHERE len(w) > 0),
     bw AS (SELECT DISTINCT item, t, array_to_string(w[p:p + t - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - t + 2)) AS p FROM i)),
     g AS (SELECT rid, p, t, array_to_string(w[p:p + t - 1], ' ') AS s
           FROM (SELECT rid, w, t, unnest(range(1, len(w) - t + 2)) AS p FROM d, (SELECT DISTINCT t FROM bw) WHERE len(w) >= t)),
     h AS (SELECT * FROM g SEMI JOIN bw USING (s, t)),
     n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + t)) AS q FROM h) GROUP BY rid),
     m AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM h JOIN bw USING (s, t) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""

# crc32 of the decimal id, bit by bit (reflected polynomial 0xEDB88320)
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                         lambda z, o: xor(z >> 1, 3988292384::BIGINT * (z & 1)))), 4294967295::BIGINT)"""

TRIE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                  coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
     ids AS (SELECT c, c - c % 100 AS trunk, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM t)),
     re AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d
            FROM (SELECT c, 0 AS own, pos, r, x FROM ids JOIN t ON t.conv_id = trunk AND pos <= h
                  UNION ALL SELECT c, 1, pos, r, x FROM ids JOIN t ON t.conv_id = c AND pos > h)),
     pre AS (SELECT c, d, length(x) AS chars, list(md5(length(r) || ':' || r || x)) OVER (PARTITION BY c ORDER BY d) AS k FROM re
             UNION ALL SELECT c, 0, 0, [] FROM ids),
     node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM pre GROUP BY k, d),
     kid AS (SELECT k[1:len(k) - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
     own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kid USING (k)),
     below AS (SELECT k[1:i] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * chars) AS saved
               FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM own) GROUP BY 1),
     ends AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
              FROM (SELECT *, max(d) OVER (PARTITION BY c) AS len FROM pre) WHERE d = len GROUP BY k)
SELECT own.conv_id, own.d::BIGINT AS depth, up.conv_id AS parent_conv_id, own.n::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN below USING (k) LEFT JOIN ends USING (k) LEFT JOIN node up ON own.d > 0 AND up.d = own.d - 1 AND up.k = own.k[1:own.d - 1]
"""

ORACLE = {
    "op3_substring_dedup": SUBSTRING,
    "op6_quality_rules": QUALITY,
    "op8_license_scan": _license_sql(),
    "op9_url_filter": URLS,
    "op10_mixing": MIX,
    "op12_prefix_trie": TRIE,
    "op13_decontaminate": DECONTAMINATE,
}

"""DuckDB SQL for those operators' queries that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _straight(p: str) -> str:
    """A path without dot segments, as text; / for an empty one."""
    walked = f"list_reduce(list_prepend('', string_split({p}, '/')[2:]), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END)"
    return f"{walked} || CASE WHEN {p} = '' OR string_split({p}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END"


def _node(u: str) -> str:
    plain = f"regexp_extract({u}, '(?s)^([^#]*)', 1)"
    head = f"translate(regexp_extract({plain}, '(?s)^(.*?://[^/?]*)', 1), '{_UP}', '{_LOW}')"
    rest = f"regexp_extract({plain}, '(?s)^.*?://[^/?]*(.*)$', 1)"
    path = f"regexp_extract({rest}, '(?s)^([^?]*)', 1)"
    return rf"CASE WHEN {head} <> '' THEN regexp_replace(regexp_replace({head}, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || {_straight(path)} || regexp_extract({rest}, '(?s)^[^?]*(.*)$', 1) END"


def _resolved(t: str, base: str) -> str:
    origin, bare = f"regexp_extract({base}, '(?s)^(.*?://[^/?]*)', 1)", f"regexp_extract({base}, '(?s)^([^?]*)', 1)"
    place = f"regexp_extract({bare}, '(?s)^(.*?://.*/)', 1)"
    return f"""CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {t} WHEN starts_with({t}, '//') THEN regexp_extract({base}, '^([^:]*:)', 1) || {t} WHEN starts_with({t}, '/') THEN {origin} || {t}
  WHEN starts_with({t}, '#') OR {t} = '' THEN {base} WHEN starts_with({t}, '?') THEN {bare} || {t} WHEN length({place}) > length({origin}) THEN {place} || {t} ELSE {origin} || '/' || {t} END"""


_HREF = r"""(?i)[\s"''/]href\s*=\s*(?:"\s*([^"]*)"|''\s*([^'']*)''|([^\s"''>]+))"""
_VALUE = f"trim(replace(regexp_extract(x, '{_HREF}', 1) || regexp_extract(x, '{_HREF}', 2) || regexp_extract(x, '{_HREF}', 3), '&amp;', '&'))"

#: Hosts, paths, rules, and blocks carried over canonical-link and refresh edges by reachability.
OP2 = rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
pg AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  url, regexp_replace(coalesce(html, ''), '(?s)<!--.*?(?:-->|$)', ' ', 'g') AS html FROM pages),
nd AS (SELECT *, {_node('url')} AS node FROM pg),
read AS (SELECT node AS src, list_filter(list_concat(list_transform(list_filter(regexp_extract_all(html, '(?i)<link\b[^<>]*>'), lambda x: regexp_matches(x, '(?i)[\s"''/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?''|canonical[\s>/])')), lambda x: {_VALUE}),
  list_transform(list_filter(regexp_extract_all(html, '(?i)<meta\b[^<>]*>'), lambda x: regexp_matches(x, '(?i)[\s"''/]http-equiv\s*=\s*["'']?\s*refresh["''\s>/]')), lambda x: trim(replace(regexp_extract(x, '(?i)[\s"'';0-9,]url\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&')))), lambda x: x <> '') AS ts,
  list_filter(list_transform(regexp_extract_all(html, '(?i)<base\b[^<>]*>'), lambda x: {_VALUE}), lambda x: x <> '')[1] AS b FROM nd WHERE node IS NOT NULL),
named AS (SELECT src, unnest(ts) AS t, CASE WHEN b IS NULL THEN src ELSE {_resolved('b', 'src')} END AS b FROM read), based AS (SELECT src, t, coalesce({_node('b')}, src) AS b FROM named),
absolute AS (SELECT src, {_resolved('t', 'b')} AS u FROM based), edges AS (SELECT src, {_node('u')} AS dst FROM absolute),
ties AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
judged AS (SELECT n.node, arg_max(v, length(h || p)) AS v FROM (SELECT DISTINCT a AS node, translate(regexp_extract(a, '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(a, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM ties) n JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n.node),
reach(node) AS (SELECT node FROM judged WHERE v = 'block' UNION SELECT b FROM reach JOIN ties ON a = node),
ruled AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM nd JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN node IN (SELECT node FROM reach) THEN 'block' END, 'allow') AS verdict FROM nd LEFT JOIN ruled USING (page_id)
"""

#: All pairs that share a shingle, components by reachability.
OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(x) < 3 THEN array_to_string(x, ' ') ELSE x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] END AS g FROM (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 1, 2))) AS i FROM w WHERE len(x) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.k + y.k - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach(d, r) AS (SELECT a, b FROM e UNION SELECT d, b FROM reach JOIN e ON a = r)
SELECT doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d AS doc_id, min(r) AS m FROM reach GROUP BY d) USING (doc_id)
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every item joined with the documents' word runs of its length.
OP6 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS x FROM documents), b AS (SELECT item_id, {_WORDS} AS x FROM benchmark), b2 AS (SELECT item_id, x, least(len(x), 10) AS n FROM b WHERE len(x) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(x[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(x) - n + 2)) AS i FROM b2)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, i, array_to_string(x[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, x, unnest(range(1, len(x) - n + 2)) AS i FROM d JOIN sizes ON len(x) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM runs JOIN win USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Prefixes told by the joined hashes of their turns, ancestors by the conversations that pass both; the CRC bit by bit.
OP11 = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, count(*) AS k, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id),
i AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda j: ascii(s[j])::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h FROM k),
c AS (SELECT i.conv_id, h, least(h, coalesce(k.k, 0)) AS got FROM i LEFT JOIN k ON k.conv_id = i.conv_id - i.conv_id % 20),
r AS (SELECT c.conv_id, pos AS d, role, txt FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE pos <= h UNION ALL SELECT conv_id, pos - h + got, role, txt FROM c JOIN t USING (conv_id) WHERE pos > h),
q AS (SELECT conv_id, d, md5(string_agg(md5(length(role) || ':' || role || txt), '') OVER (PARTITION BY conv_id ORDER BY d)) AS p, len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) AS w FROM r),
m AS (SELECT conv_id, d, p, coalesce(lag(p) OVER (PARTITION BY conv_id ORDER BY d), '') AS up, w FROM q UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
node AS (SELECT p, d, any_value(up) AS up, min(conv_id) AS low, count(*) AS n, any_value(w) AS w FROM m GROUP BY p, d),
kids AS (SELECT up AS p, count(*) AS kids FROM node WHERE up IS NOT NULL GROUP BY up),
full_node AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (p)),
under AS (SELECT DISTINCT x.p AS a, y.p AS b FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.d <= y.d),
sums AS (SELECT a AS p, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * w) AS saved FROM under JOIN full_node ON b = full_node.p GROUP BY a),
ends AS (SELECT p, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(p, d) AS p FROM m GROUP BY conv_id) GROUP BY p)
SELECT f.low AS conv_id, CAST(f.d AS BIGINT) AS depth, u.low AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_node f JOIN sums USING (p) LEFT JOIN full_node u ON u.p = f.up LEFT JOIN ends ON ends.p = f.p
"""

#: Failed filters of every document, counted by part, then all orders and steps by masks.
OP13 = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
e AS (SELECT t, min(doc_id) AS low FROM w GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(x) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(x)) < 50 * len(x) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INTEGER)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > low, false) AS INTEGER) AS m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w JOIN e USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, m),
k(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT k1.l || k2.l || k3.l || k4.l || k5.l AS filter_order, [k1.b, k2.b, k3.b, k4.b, k5.b] AS bs FROM k k1, k k2, k k3, k k4, k k5 WHERE k1.b + k2.b + k3.b + k4.b + k5.b = 31 AND k1.b | k2.b | k3.b | k4.b | k5.b = 31),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bs[i] AS own, coalesce(list_sum(bs[1:i - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(i)),
big AS (SELECT part, filter_order, step, own, before, m, n, g, x FROM c, s),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (m & (own | before) = 0) AS kept, sum(n) FILTER (m & own <> 0 AND m & before = 0) AS removed, sum(n) FILTER (m & own <> 0 AND m & before <> 0) AS redundant,
  sum(n) FILTER (m = own) AS unique_fails, sum(g) FILTER (m & own <> 0 AND m & before = 0) AS good_lost, sum(x) FILTER (m & own <> 0 AND m & before = 0) AS toxic_lost FROM big GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r
"""

"""SQL (DuckDB) for the queries of this package that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = rf"""
WITH i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS x
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
m AS (SELECT r, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.x = iw.x),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM m GROUP BY r),
p AS (SELECT r, w, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
f AS (SELECT term, count(*) AS c FROM p GROUP BY term),
iwt AS (SELECT row_number() OVER () AS q, item_id, n + 2 AS room, list_distinct(string_split(x, ' ')) AS terms FROM iw),
rare AS (SELECT q, arg_min(term, coalesce(c, 0)) AS term FROM (SELECT q, unnest(terms) AS term FROM iwt) LEFT JOIN f USING (term) GROUP BY q HAVING min(coalesce(c, 0)) > 0),
around AS (SELECT r, item_id, terms, room, w[greatest(1, p - room + 1):p + room - 1] AS a FROM iwt JOIN rare USING (q) JOIN p USING (term)),
near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM around
       WHERE list_has_all(a, terms) AND len(list_filter(range(1, len(a) + 1), lambda s: list_has_all(a[s:s + room - 1], terms))) > 0 GROUP BY r)
SELECT doc_id, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN near USING (r)
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
       -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
       / coalesce(greatest(0.05, length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE / nullif(length(text), 0)::DOUBLE), 0.05) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0 * source_size / w AS room FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
       / sum(w) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN room <= level OR max(CASE WHEN room > level THEN level END) OVER () IS NULL THEN 2.0::DOUBLE * source_size
       ELSE max(CASE WHEN room > level THEN level END) OVER () * w END AS target FROM l),
e AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS epochs FROM t),
x AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM e),
p AS (SELECT d.doc_id, d.size, x.source_size, x.target, x.epochs, x.rest - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
       FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM p
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, CASE WHEN first <> page_id THEN NULL ELSE true END AS digest_ok
FROM p LEFT JOIN f ON p.d = f.d
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
       UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
f AS (SELECT *, replace(replace({_ESCAPED.format("role")}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') AS r, {_ESCAPED.format("text")} AS x FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

# crc32 of ASCII and two-byte UTF-8 texts; the table comes from its rule
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: " + _CRC_STEP.format("a") + ") ORDER BY i) AS t FROM range(256) r(i))"
_BYTES = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN c = '' THEN []::BIGINT[] WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END))"
_CRC = "xor(list_reduce(list_concat([4294967295], " + _BYTES + "), lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295)"

TRIE = rf"""
WITH {_CRC_TABLE}, r AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
       CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(h ORDER BY turn NULLS FIRST, role, h) AS h, list(w ORDER BY turn NULLS FIRST, role, h) AS w FROM r GROUP BY conv_id),
k AS (SELECT c.*, CAST({_CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS INT) AS n FROM c, crc),
b AS (SELECT k.conv_id, list_concat(coalesce(o.h, [])[1:k.n], k.h[k.n + 1:]) AS h, list_concat(coalesce(o.w, [])[1:k.n], k.w[k.n + 1:]) AS w FROM k LEFT JOIN c o ON o.conv_id = k.conv_id - k.conv_id % 20),
p AS (SELECT conv_id, d, len(h) = d AS ends, sha256(array_to_string(h[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(h[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w,
       list_transform(range(0, d + 1), lambda i: sha256(array_to_string(h[1:i], ','))) AS above FROM (SELECT *, unnest(range(0, len(h) + 1)) AS d FROM b)),
n AS (SELECT node, min(up) AS up, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w, min(above) AS above, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY node),
m AS (SELECT n.*, CAST(coalesce(k, 0) AS BIGINT) AS n_children FROM n LEFT JOIN (SELECT up, count(*) AS k FROM n GROUP BY up) q ON q.up = n.node),
s AS (SELECT a AS node, CAST(sum((n_children = 0)::INT) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens FROM (SELECT unnest(above) AS a, n_children, n_convs, w FROM m) GROUP BY a)
SELECT m.conv_id, m.depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256 FROM m JOIN s USING (node) LEFT JOIN n o ON o.node = m.up
"""

SPELLING = rf"""
WITH {_CRC_TABLE}, r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
d AS (SELECT doc_id, x, count(*) AS n FROM r WHERE length(x) >= 5 GROUP BY ALL),
h AS (SELECT x, n, {_CRC.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || x")} AS h FROM d, crc),
l AS (SELECT CASE WHEN h % 97 = 0 THEN substr(x, 1, CAST(h % length(x) AS BIGINT)) || substr(x, CAST(h % length(x) AS BIGINT) + 2) ELSE x END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM l WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n FROM g a JOIN g b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
       UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.cut UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.cut),
q AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(near, struct_pack(a := -n, b := encode(near))) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN most >= 2 * v.n THEN best END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n FROM v LEFT JOIN q USING (word)),
RECURSIVE_ROOTS
SELECT f.word, f.form, o.root, f.n, f.n_near, f.form_n FROM f JOIN o USING (word)
"""
SPELLING = SPELLING.replace("WITH crc", "WITH RECURSIVE crc", 1).replace("RECURSIVE_ROOTS", "z AS (SELECT word, word AS root FROM f UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL), o AS (SELECT z.word, z.root FROM z JOIN f ON f.word = z.root WHERE f.form IS NULL)")


def secrets_sql(kinds: dict, scope: int) -> str:
    """Offsets from the texts between matches, then the links of parts within the scope."""
    parts = []
    for k, (name, (pattern, group, least, _, _)) in enumerate(kinds.items()):
        pattern = pattern.replace("(?<![0-9a-f])", "").replace("(?<![A-Za-z0-9+/])", "").replace("'", "''")
        more = " AND regexp_matches(g, '[a-z]') AND regexp_matches(g, '[A-Z]') AND regexp_matches(g, '[0-9]')" if name == "opaque" else ""
        parts.append(f"""SELECT r, {k} AS k, e - l AS s, e FROM (SELECT r, g, l, sum(gap + l) OVER (PARTITION BY r ORDER BY i) AS e FROM (
            SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda x: length(x))) AS l, unnest(g) AS g, unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) AS gap FROM (
            SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS gaps FROM d))) WHERE length(g) >= {least}{more}""")
    of = lambda test: ", ".join(str(n) for n, v in enumerate(kinds.values()) if test(v))
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    base, ids, secrets, ends = of(lambda v: v[4]), of(lambda v: v[3] == "id"), of(lambda v: v[3] == "secret"), of(lambda v: v[3] == "endpoint")
    text = "array_to_string(list_transform({0}, lambda x: {1}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    count = lambda k: f"CAST(len(list_filter(coalesce(b, []), lambda x: x.k = {k})) AS BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED (SELECT r, k, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ({" UNION ALL ".join(parts)})),
n AS (SELECT w.r, w.k, w.s, w.e, bool_or(o.k IN ({ids}) AND NOT (o.s < w.e AND w.s < o.e)) AS near_id, bool_or(o.k IN ({secrets}) AND NOT (o.s < w.e AND w.s < o.e)) AS near_secret, bool_or(o.k IN ({base}) AND o.s < w.e AND w.s < o.e) AS taken
    FROM p w JOIN p o ON w.r = o.r AND greatest(o.s - w.e, w.s - o.e) <= {scope} WHERE w.k NOT IN ({base}) GROUP BY ALL),
a AS (SELECT r, k, s, e FROM p WHERE k IN ({base}) UNION ALL SELECT r, k, s, e FROM n WHERE NOT taken AND ((k IN ({ids}) AND near_secret) OR (k IN ({secrets}) AND near_id) OR (k IN ({ends}) AND near_id AND near_secret))),
g AS (SELECT r, list(struct_pack(s := s, k := k, e := e) ORDER BY s, k, e) AS a, list(struct_pack(s := s, k := k, e := e) ORDER BY s, k, e) FILTER (k IN ({base})) AS b FROM a GROUP BY r)
SELECT doc_id, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex, sha256({text.format("coalesce(b, [])", names)}) AS base_sha256, {text.format("coalesce(a, [])", names)} AS spans FROM d LEFT JOIN g USING (r)
"""

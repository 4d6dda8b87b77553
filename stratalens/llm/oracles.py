"""SQL of the corpus operators that SQL can express, for DuckDB: what a query returns, said without its method."""

from __future__ import annotations

from .op11_secrets import PATTERNS
from .op7_licenses import PHRASES, TEMPLATES

SUBSTRINGS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 20], ' ')) AS name FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY name ORDER BY doc_id, p) AS n FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r WHERE n > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.i = words.i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

SUFFIXES = r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
h AS (SELECT doc_id, p, md5(b[p + 1:p + 400]) AS name FROM (SELECT doc_id, b, unnest(range(n - 399)) AS p FROM d WHERE n >= 400)),
m AS (SELECT name FROM h GROUP BY name HAVING count(*) > 1),
s AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM h SEMI JOIN m USING (name)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM s),
c AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY doc_id, span),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y, a, z FROM c),
e AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(hex(b[x + 1:y]), '' ORDER BY a) AS body FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN body IS NULL THEN sha256(b) ELSE sha256(unhex(body || hex(b[last + 1:n]))) END AS kept_sha256 FROM d LEFT JOIN e USING (doc_id)"""


def licenses(k: int = 3, slack: int = 2, coverage: float = 0.7) -> str:
    listed = ", ".join(f"('{label}', '{label}/{i}', '{text}')" for label, texts in TEMPLATES.items() for i, text in enumerate(texts))
    phrases = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES.items())
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
ph(label, p) AS (VALUES {phrases}),
base AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) x, ph WHERE w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
bs AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id),
t(label, template, text) AS (VALUES {listed}),
tg AS (SELECT label, template, len(tw) - {k - 1} AS t_grams, t_pos, array_to_string(tw[t_pos + 1:t_pos + {k}], ' ') AS g FROM (SELECT label, template, tw, unnest(range(len(tw) - {k - 1})) AS t_pos FROM (SELECT label, template, string_split(text, ' ') AS tw FROM t))),
dg AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + {k}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - {k - 1})) AS pos FROM d WHERE len(w) >= {k})),
v AS (SELECT doc_id, label, template, t_grams, t_pos, pos, pos - t_pos AS diagonal FROM dg JOIN tg USING (g)),
l AS (SELECT doc_id, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {slack} THEN 1 ELSE 0 END AS apart FROM (SELECT DISTINCT doc_id, template, diagonal FROM v)),
o AS (SELECT doc_id, template, diagonal, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM l),
s AS (SELECT doc_id, label, template, t_grams, count(DISTINCT t_pos) / t_grams AS coverage, min(pos) AS a, max(pos) + {k - 1} AS z FROM v JOIN o USING (doc_id, template, diagonal) GROUP BY doc_id, label, template, t_grams, span),
f AS (SELECT doc_id, list(DISTINCT label) AS more, max(coverage) AS best FROM s WHERE coverage >= {coverage} AND z - a + 1 <= 1.5 * (t_grams + {k - 1}) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(labels, []), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') AS labels, round(least(1.0, greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)), 6)::DOUBLE AS score FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN f USING (doc_id)"""


#: The best window of a document and an item, over all windows that begin at a shared shingle; a window's radius is no condition here.
LEAKS = r"""WITH it AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item_id, w, len(w) AS size, least(len(w), 5) AS k FROM it WHERE len(w) > 0),
ig AS (SELECT item_id, size, k, size - k + 1 AS n, array_to_string(w[i + 1:i + k], ' ') AS g FROM (SELECT *, unnest(range(size - k + 1)) AS i FROM iw)),
ic AS (SELECT item_id, size, k, n, g, count(*) AS ci FROM ig GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM ic),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, k, len(w) AS words, pos, array_to_string(w[pos + 1:pos + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS pos FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, words, item_id, size, k, n, ci, dg.g, pos FROM dg JOIN ic USING (k, g)),
st AS (SELECT DISTINCT doc_id, words, item_id, size, n, least(pos, greatest(0, words - size)) AS start FROM hit),
ov AS (SELECT doc_id, words, item_id, size, n, start, g, least(count(*), max(ci)) AS c FROM st JOIN (SELECT doc_id, item_id, g, pos, ci FROM hit) h USING (doc_id, item_id) WHERE pos >= start AND pos < start + n AND pos < start + least(n, words - (size - n)) GROUP BY ALL),
sm AS (SELECT doc_id, words, item_id, size, n, start, sum(c) AS common FROM ov GROUP BY ALL),
si AS (SELECT doc_id, item_id, start, least(words, size) AS n_words, round(common / (n + least(n, words - (size - n)) - common), 6) AS similarity FROM sm),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn FROM si WHERE similarity >= 0.8)
SELECT doc_id, item_id, start::BIGINT AS start_word, n_words::BIGINT AS n_words, similarity::DOUBLE AS similarity FROM b WHERE rn = 1"""

#: Each text with its second half replaced by the beginning of the next one, descending ids.
EDITED = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first(t) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nt FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2)) AS edited_sha256 FROM n"""


def secrets() -> str:
    """Where named patterns stand: what lies between matches, and the matches, one after another."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{kind}' AS kind, {least} AS least, string_split_regex(t, {quoted(p)}) AS gaps, regexp_extract_all(t, {quoted(p)}) AS found, regexp_extract_all(t, {quoted(p)}, {group}) AS part FROM d" for i, (kind, (p, group, least)) in enumerate(PATTERNS.items()))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
i AS (SELECT doc_id, o, kind, least, part[i] AS part, found[i] AS found, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
s AS (SELECT doc_id, o, kind, a::BIGINT AS a, (a + length(found))::BIGINT AS z FROM i WHERE length(part) >= least),
l AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o) AS line FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(line, '')) AS base_sha256 FROM d LEFT JOIN l USING (doc_id)"""


#: Every kept term of every group, each pair of groups by each term.
DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
o AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, g.source, k.term, coalesce(c, 0) AS c, (1 + 1000000000 * (coalesce(c, 0) + 2)::HUGEINT // (g.n + 2 * v.v)::HUGEINT)::BIGINT AS p, (1 + 1000000000 * (total + 2)::HUGEINT // (v.n + 2 * v.v)::HUGEINT)::BIGINT AS q FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM x) WHERE part = 'pair' OR rank <= 10"""

#: Rebuilt conversations, every prefix as a list; below a node lies what its members' longer prefixes are.
TRIE = r"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT c, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)) AS bytes FROM (SELECT DISTINCT c FROM t)),
h AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(bytes, lambda x: [x::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END), 4294967295) % 4 AS h FROM b),
r AS (SELECT h.c, 0 AS late, i, x FROM h JOIN t ON t.c = h.base AND t.i <= h.h UNION ALL SELECT h.c, 1, i, x FROM h JOIN t ON t.c = h.c AND t.i > h.h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY late, i) AS d, x FROM r),
p AS (SELECT c, d, list(x) OVER (PARTITION BY c ORDER BY d) AS k FROM o UNION ALL SELECT c, 0, [] FROM h),
m AS (SELECT k, d, min(c) AS conv, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS line FROM (SELECT c, k, d, max(d) OVER (PARTITION BY c) AS most FROM p) WHERE d = most GROUP BY k),
l AS (SELECT m.*, (n - 1) * CASE WHEN m.d = 0 THEN 0 ELSE len(regexp_extract_all(m.k[m.d].text, '[^\x20\x09-\x0D]+')) END AS saved, count(z.k) AS children FROM m LEFT JOIN (SELECT k, d, k[1:d - 1] AS up FROM m WHERE d > 0) z ON z.d = m.d + 1 AND z.up = m.k GROUP BY ALL),
s AS (SELECT v.k, sum(u.saved)::BIGINT AS saved_tokens, count(*) FILTER (u.children = 0) AS n_leaves FROM (SELECT DISTINCT v.k, u.k AS uk FROM p v JOIN p u ON u.c = v.c AND u.d >= v.d) v JOIN l u ON u.k = v.uk GROUP BY v.k)
SELECT l.conv AS conv_id, l.d AS depth, up.conv AS parent_conv_id, l.n AS n_convs, l.children AS n_children, n_leaves, saved_tokens, sha256(coalesce(line, '')) AS ends_sha256 FROM l JOIN s ON s.k = l.k LEFT JOIN e ON e.k = l.k LEFT JOIN m up ON l.d > 0 AND up.d = l.d - 1 AND up.k = l.k[1:l.d - 1]"""

ORACLES = {"edited_texts": EDITED, "op12_divergence": DIVERGENCE, "op13_prefix_trie": TRIE, "secret_spans": secrets(), "op3_decontamination": LEAKS, "op6_substring_dedup": SUBSTRINGS, "op7_license_scan": licenses(), "op8_suffix_dedup": SUFFIXES}

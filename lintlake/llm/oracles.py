"""DuckDB SQL for the rows of the queries that SQL can express, written without the operators' methods."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_COMPONENTS = """
reach(node, seen) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
parts AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

ORACLES["op1_vector_dedup"] = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding])),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_COMPONENTS},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN parts ON node = vec_id LEFT JOIN counts ON a = vec_id
"""

ORACLES["op2_suffix_dedup"] = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS body, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (
  SELECT doc_id, i, md5_number(substr(body, 2 * i + 1, 400)) AS mark
  FROM (SELECT doc_id, body, unnest(range(0, n - 199)) AS i FROM texts WHERE n >= 200)),
twice AS (SELECT mark FROM windows GROUP BY mark HAVING count(*) > 1),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows SEMI JOIN twice USING (mark)),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits)
  GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL
  SELECT t.doc_id, coalesce(last, 0), n FROM texts t LEFT JOIN (SELECT doc_id, max(b) AS last FROM runs GROUP BY doc_id) l ON l.doc_id = t.doc_id),
glued AS (
  SELECT k.doc_id, string_agg(substr(body, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS body
  FROM kept k JOIN texts t ON t.doc_id = k.doc_id GROUP BY k.doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(g.body)) AS kept_sha256
FROM texts t JOIN glued g ON g.doc_id = t.doc_id LEFT JOIN sums s ON s.doc_id = t.doc_id
"""

ORACLES["op3_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, rest,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) AS place
  FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)),
words(place, name, pattern) AS (VALUES
  (1, 'free bets', '(?i)(^|[^a-z0-9])free-bets?([^a-z0-9]|$)'), (2, 'casino', '(?i)(^|[^a-z0-9])casino([^a-z0-9]|$)'),
  (3, 'poker', '(?i)(^|[^a-z0-9])poker([^a-z0-9]|$)'), (4, 'porn', '(?i)(^|[^a-z0-9])porn([^a-z0-9]|$)'),
  (5, 'xxx', '(?i)(^|[^a-z0-9])xxx([^a-z0-9]|$)'), (6, 'cheap pills', '(?i)(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)')),
named AS (
  SELECT page_id, arg_min(name, place) AS word FROM split JOIN words ON regexp_matches(host || path, pattern) GROUP BY page_id)
SELECT s.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN r_verdict WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN word END AS word_rule
FROM split s LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (page_id) LEFT JOIN named n USING (page_id)
"""


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: gaps and hits of the text alternate, so running lengths give the offsets."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {order} AS kind_order, s AS s, s + length(hit) AS e
  FROM (
    SELECT doc_id, unnest(hits) AS hit, unnest(vals) AS val,
      unnest([list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0)
        FOR i IN range(1, len(hits) + 1)])::BIGINT AS s
    FROM (
      SELECT doc_id, regexp_split_to_array(body, '{pattern}') AS gaps, regexp_extract_all(body, '{pattern}', 0) AS hits,
        regexp_extract_all(body, '{pattern}', {group}) AS vals
      FROM texts WHERE regexp_matches(body, '{pattern}')))
  WHERE length(val) >= {least}"""


_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
ORACLES["op6_minhash_dedup"] = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN parts ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

ORACLES["op10_secret_scan"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS ({" UNION ALL ".join([
    _spans("assign", 0, _ASSIGN, 2, 6), _spans("access", 1, "AKIA[A-Z0-9]+", 0, 20), _spans("hex", 2, "[0-9a-f]+", 0, 24),
    _spans("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    _spans("jwt", 4, "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 30)])}),
rolled AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order) FILTER (kind_order < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order) AS spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN rolled USING (doc_id)
"""

ORACLES["op12_spelling_variants"] = """
WITH RECURSIVE steps(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crcs AS (SELECT i, c FROM steps WHERE k = 8),
texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(body, '[a-z\u00C0-\u00FF]+')) AS run FROM texts)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed(doc_id, run, body, k, c) AS (
  SELECT doc_id, run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), 0, 4294967295::BIGINT FROM runs
  UNION ALL
  SELECT doc_id, run, body, k + 1, xor(h.c // 256, t.c)
  FROM hashed h JOIN crcs t ON t.i = xor(h.c % 256, ('0x' || substr(body, 2 * k + 1, 2))::BIGINT) WHERE k < length(body) // 2),
marks AS (SELECT doc_id, run, xor(c, 4294967295) AS h FROM hashed WHERE k = length(body) // 2),
found AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(r.run, (h % length(r.run))::INT) || substr(r.run, (h % length(r.run))::INT + 2) ELSE r.run END AS word, n
  FROM runs r JOIN marks m ON m.run = r.run AND m.doc_id IS NOT DISTINCT FROM r.doc_id),
words AS (SELECT word, sum(n)::BIGINT AS n FROM found WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
skips AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM spots),
longer AS (SELECT DISTINCT s.word, s.n, w.word AS other, w.n AS other_n FROM skips s JOIN words w ON w.word = s.a || s.b),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
  UNION ALL SELECT * FROM longer
  UNION ALL SELECT other, other_n, word, n FROM longer),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS top, max(other_n) AS top_n, any_value(n) AS n FROM near GROUP BY word),
forms AS (SELECT word, top AS form, top_n AS form_n FROM best WHERE top_n >= 10 * n),
chain(word, last) AS (
  SELECT word, word FROM words
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.last),
ends AS (SELECT c.word, c.last AS root FROM chain c ANTI JOIN forms f ON f.word = c.last)
SELECT w.word, w.n, form, root, coalesce(n_near, 0) AS n_near, form_n
FROM words w JOIN ends USING (word) LEFT JOIN forms USING (word) LEFT JOIN best USING (word)
"""

ORACLES["op13_phrase_mining"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS p FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, array_to_string(p, ' ') AS phrase, any_value(p) AS p, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM candidates c JOIN (VALUES (1), (2)) v(cut) ON cut < c.k
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[cut + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS part FROM candidates WHERE k = 3)
  GROUP BY lang, part),
kept AS (SELECT w.* FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.part = w.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r.r, n, score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""

"""SQL (DuckDB) that recomputes queries of this subpackage another way."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOW_WORDS = _WORDS.format(_LOWER.format("{0}"))

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS ws FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
grams AS (SELECT doc_id, i, ws[i:i+2] AS g FROM tri),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT *, array_to_string({_LOW_WORDS.format('line')}, ' ') AS norm, len({_WORDS.format('line')}) AS n
  FROM raw WHERE len({_WORDS.format('line')}) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
templates AS (SELECT host, norm, min(doc_id) AS first FROM lines GROUP BY host, norm HAVING count(DISTINCT text) > MIN_DOCS),
gone AS (SELECT doc_id, count(*) AS n, sum(l.n) AS words FROM lines l JOIN templates t
  ON t.host = l.host AND t.norm = l.norm AND t.first <> l.doc_id GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  coalesce(gone.n, 0) AS n_template_lines, coalesce(gone.words, 0) AS n_template_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_template_words >= 0.3 * n_words AS kept,
  CAST(n_template_lines AS BIGINT) AS n_template_lines, CAST(n_template_words AS BIGINT) AS n_template_words FROM f"""



def quality(min_docs: int) -> str:
    """The verdicts where a line of more than ``min_docs`` distinct documents of a host is a template."""
    return _QUALITY.replace("MIN_DOCS", str(min_docs))


#: With the operator's own limit, as in the pipeline.
QUALITY = quality(20)

LINES = rf"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, line, list_sort(list_distinct({_LOW_WORDS.format('text')})) AS words FROM raw),
classes AS (SELECT words, min(struct_pack(d := doc_id, l := line)) AS first, row_number() OVER () AS id, len(words) AS n
  FROM lines WHERE len(words) > 0 GROUP BY words),
tokens AS (SELECT id, n, first, unnest(words) AS w FROM classes),
often AS (SELECT w, count(*) AS c FROM tokens GROUP BY w),
rare AS (SELECT id, n, first, w FROM tokens JOIN often USING (w)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, w) <= n - ceil(0.8 * n - 0.000001) + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM rare a JOIN rare b ON a.w = b.w AND b.first < a.first AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
alike AS (SELECT DISTINCT a FROM (SELECT p.a, x.n + y.n AS total, len(list_intersect(x.words, y.words)) AS common
  FROM pairs p JOIN classes x ON x.id = p.a JOIN classes y ON y.id = p.b) WHERE 5 * common >= 4 * (total - common)),
gone AS (SELECT l.doc_id, l.line FROM lines l JOIN classes c ON c.words = l.words LEFT JOIN alike ON alike.a = c.id
  WHERE alike.a IS NOT NULL OR c.first <> struct_pack(d := l.doc_id, l := l.line))
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(count(g.line) AS BIGINT) AS n_removed, coalesce(string_agg(g.line, ',' ORDER BY g.line), '') AS removed
FROM documents d LEFT JOIN gone g USING (doc_id) GROUP BY d.doc_id, d.text"""

COMPONENTS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_LOW_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT r.start, l.b FROM reach r JOIN links l ON l.a = r.node)
SELECT start AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(node) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = start GROUP BY start, n.n"""

# Every kept term against every pair of sources, without a tree.
DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL),
g AS (SELECT o.lang, o.source, l.v, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) o
  LEFT JOIN langs l ON l.lang = o.lang LEFT JOIN sums s ON s.lang = o.lang AND s.source = o.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
  1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q FROM g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

NEGATIVES = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, a.label = b.label AS same, b.id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor AS anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

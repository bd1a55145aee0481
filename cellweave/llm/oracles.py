"""SQL that gives the rows of those queries of this subpackage that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""WITH RECURSIVE split AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM split)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id),
roots AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN roots r USING (doc_id)"""

# an item of fewer than five words is one shingle, so its shingles have k words
_GRAMS = "list_transform(range(1, len({w}) - {k} + 2), lambda i: array_to_string({w}[i : i + {k} - 1], ' '))"

DECONTAMINATION = f"""WITH items AS (SELECT item_id, len(w) AS size, least(len(w), 5) AS k, w FROM (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL), sizes AS (SELECT DISTINCT k FROM items),
item_grams AS (SELECT item_id, w AS item, size, k, unnest({_GRAMS.format(w='w', k='k')}) AS s, unnest(range(size - k + 1)) AS place FROM items),
doc_grams AS (SELECT doc_id, k, unnest({_GRAMS.format(w='w', k='k')}) AS s, unnest(range(len(w) - k + 1)) AS place FROM docs, sizes WHERE len(w) >= k),
starts AS (SELECT DISTINCT d.doc_id, i.item_id, i.item, i.size, i.k, greatest(d.place - i.place, 0) AS start FROM doc_grams d JOIN item_grams i USING (k, s)),
laid AS (SELECT s.doc_id, s.item_id, s.item, s.start, s.k, d.w[s.start + 1 : s.start + s.size] AS ww FROM starts s JOIN docs d USING (doc_id)),
grams AS (SELECT doc_id, item_id, item, start, unnest({_GRAMS.format(w='ww', k='k')}) AS s FROM laid),
mine AS (SELECT doc_id, item_id, item, start, s, count(*) AS n FROM grams GROUP BY ALL), theirs AS (SELECT item_id, item, s, count(*) AS n FROM item_grams GROUP BY ALL),
shared AS (SELECT doc_id, item_id, item, start, sum(least(mine.n, theirs.n)) AS both_n FROM mine JOIN theirs USING (item_id, item, s) GROUP BY ALL),
scored AS (SELECT h.doc_id, h.item_id, h.start, CAST(h.both_n AS DOUBLE) / CAST(a.n + b.n - h.both_n AS DOUBLE) AS similarity FROM shared h
  JOIN (SELECT doc_id, item_id, item, start, count(*) AS n FROM grams GROUP BY ALL) a USING (doc_id, item_id, item, start) JOIN (SELECT item_id, item, count(*) AS n FROM item_grams GROUP BY ALL) b USING (item_id, item))
SELECT doc_id, item_id, CAST(start AS INT) AS first_word, similarity FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""

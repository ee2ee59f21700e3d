"""SQL of the corpus queries that SQL can express over whole tables."""

RANKED_SEARCH = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
lengths AS (SELECT row_number() OVER () AS d, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
found AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
asked AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM found GROUP BY ALL),
occurrences AS (SELECT d, unnest(ws) AS term FROM lengths),
postings AS (SELECT d, term, CAST(count(*) AS BIGINT) AS tf FROM occurrences SEMI JOIN (SELECT DISTINCT term FROM asked) USING (term) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scored AS (
  SELECT item_id, doc_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (d), totals
  GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM cut GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM cut, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS c FROM f WHERE k > 1),
sides AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, c, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:c], ' ')
            JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[c + 1:], ' ')),
lowest AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
around AS (
  SELECT lang, sub, max(a) AS longest FROM (
    SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS sub
    FROM (SELECT lang, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 2), (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i)
    WHERE m < k AND i + m - 1 <= k)
  GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN around ON around.lang = lowest.lang AND around.sub = lowest.phrase WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

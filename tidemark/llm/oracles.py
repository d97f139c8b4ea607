"""SQL for the numbered operators whose results SQL can express at a bearable cost."""

_FOLD = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

REPEATS = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT doc_id, word, pos, CASE WHEN pos + 49 <= len(w) THEN md5(array_to_string(w[pos:pos + 49], ' ')) END AS code FROM p),
c AS (SELECT *, code IS NOT NULL AND min(doc_id) OVER (PARTITION BY code) < doc_id AS covered FROM k),
r AS (SELECT *, max(CASE WHEN covered THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM c),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format(x="coalesce(text, '')")}, {_ALNUM}) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD.format(x="coalesce(text, '')")}, {_ALNUM}) AS w FROM benchmark),
j AS (SELECT item, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS s FROM j)),
x AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM v))),
h AS (SELECT DISTINCT doc_id, s, x.n, item FROM x JOIN v ON x.win = v.win AND x.n = v.n),
g AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS word FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)"""

JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format(x="coalesce(text, '')")}, {_WORD}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) AS sh FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS code FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.code = b.code AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, CAST(coalesce(len(sh), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id FROM d LEFT JOIN s USING (doc_id)"""

_SAID = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPED = r"regexp_replace({x}, '<(\\*)\|', '<\1\\|', 'g')"

CONVERSATIONS = rf"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', {_SAID}), (-1, 1, 'assistant', {_SAID})),
k AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM c),
e AS (SELECT *, 24 + length({_ESCAPED.format(x="replace(replace(r, chr(92), repeat(chr(92), 2)), chr(10), chr(92) || 'n')")}) + length({_ESCAPED.format(x="t")}) AS chars FROM k)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

_PIECE = r"'[.,;:!?\x0A-\x0D]'"

PHRASES = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD.format(x="coalesce(text, '')")}, {_PIECE})) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1), cut AS (SELECT lang, k, phrase, a, c, array_to_string(w[:c], ' ') AS first, array_to_string(w[c + 1:], ' ') AS rest FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM c)),
s AS (SELECT cut.*, x.a AS l, y.a AS r, CAST((2000000 * CAST(cut.a AS HUGEINT)) // (x.a + y.a) AS BIGINT) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
h AS (SELECT lang, first AS phrase FROM s WHERE k > 2 AND c = k - 1 AND 100 * a >= 80 * l UNION SELECT lang, rest FROM s WHERE k > 2 AND c = 1 AND 100 * a >= 80 * r)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score FROM b ANTI JOIN h ON b.lang = h.lang AND b.phrase = h.phrase JOIN t ON t.lang = b.lang QUALIFY rank <= 2000"""


def _crc(x: int, steps: int = 4, poly: int = 0xEDB88320) -> int:
    for _ in range(steps):
        x = (x >> 1) ^ (poly if x & 1 else 0)
    return x


#: crc32 of a text, half a byte at a time: the low half of each byte comes first
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(generate_series(1, len({h})), lambda i: CAST(instr('0123456789ABCDEF', {h}[i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END]) - 1 AS BIGINT))), "
    f"lambda c, x: xor(c >> 4, {[_crc(i) for i in range(16)]}[1 + (xor(c, x) & 15)])))"
)

SPELLING = rf"""WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_FOLD.format(x="text")}, '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents),
o AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS h FROM r GROUP BY 1, 2), q AS (SELECT run, k, {_CRC32.format(h="h")} AS crc FROM o),
v AS (SELECT CASE WHEN crc % 199 = 0 THEN run[:crc % length(run)] || run[crc % length(run) + 2:] ELSE run END AS word, k FROM q),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
d AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS v FROM (SELECT *, unnest(generate_series(1, length(word))) AS p FROM w)),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.p = b.p AND a.v = b.v AND a.word <> b.word UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.v = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.v = w.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM e GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, c.root FROM f JOIN c ON f.form = c.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c USING (word)"""

"""Queries of namespaces that overlap, JSON shapes and spans through marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import availability as A
from tidemark.operators import markup as M
from tidemark.operators import payloads as P
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_ID = "'k.n' || {n} || '.ch0' || {c} || '.s0' || {s}"
_STUDY_SQL = f"""sections AS (SELECT doc_id AS section_id, source AS book_id, place, CASE place WHEN 1 THEN {_ID.format(n="doc_id % 7", c="doc_id % 5", s="doc_id % 3")} WHEN 2 THEN {_ID.format(n="(doc_id * 3) % 11", c="doc_id % 4", s="doc_id % 9")} || 'x' ELSE 'loose' END AS knowledge_id FROM documents, (VALUES (1), (2), (3)) p(place)),
books AS (SELECT DISTINCT book_id, length(book_id) % 2 AS domain, knowledge_id FROM sections), questions AS (SELECT 'bank-' || user_id % 8 AS bank_id, event_id AS question_id, {_ID.format(n="CAST(json_extract_string(props, '$.k') AS INT) % 9", c="user_id % 4", s="event_id % 4")} || CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END AS knowledge_id FROM events),
banks AS (SELECT DISTINCT bank_id, CAST(right(bank_id, 1) AS INT) % 2 AS domain, knowledge_id FROM questions),
ns AS (SELECT 'book' AS side, book_id AS id, domain, regexp_extract(knowledge_id, '^([^.]*\\.[^.]*)', 1) AS n FROM books UNION SELECT 'bank', bank_id, domain, regexp_extract(knowledge_id, '^([^.]*\\.[^.]*)', 1) FROM banks),
pairs AS (SELECT DISTINCT a.id AS book_id, b.id AS bank_id FROM ns a JOIN ns b ON a.domain = b.domain AND a.n = b.n AND a.n <> '' AND a.side = 'book' AND b.side = 'bank'),
counts AS (SELECT bank_id, match_level, id AS knowledge_id, count(DISTINCT question_id) AS question_count FROM (SELECT bank_id, question_id, 'section' AS match_level, knowledge_id AS id FROM questions UNION ALL SELECT bank_id, question_id, 'chapter', regexp_extract(knowledge_id, '^(.+\\.ch\\d{{2}})(?:\\.|$)', 1) FROM questions
  UNION ALL SELECT bank_id, question_id, 'comprehensive', regexp_extract(knowledge_id, '^([^.]*\\.[^.]*)', 1) FROM questions) WHERE id <> '' GROUP BY 1, 2, 3)"""


def _study(spark, sf_dir):
    def kid(n, c, s):
        return F.concat(F.lit("k.n"), n.cast("string"), F.lit(".ch0"), c.cast("string"), F.lit(".s0"), s.cast("string"))

    d, e, k = F.col("doc_id"), table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("int")
    ids = F.array(kid(d % 7, d % 5, d % 3), F.concat(kid(d * 3 % 11, d % 4, d % 9), F.lit("x")), F.lit("loose"))
    sections = table(spark, sf_dir, "documents").select(d.alias("section_id"), F.col("source").alias("book_id"), F.posexplode(ids).alias("place", "knowledge_id"))
    questions = e.select(F.concat(F.lit("bank-"), (F.col("user_id") % 8).cast("string")).alias("bank_id"), F.col("event_id").alias("question_id"), F.concat(kid(k % 9, F.col("user_id") % 4, F.col("event_id") % 4), F.when(F.col("event_id") % 3 == 0, "x").otherwise("")).alias("knowledge_id"))
    books = sections.select("book_id", (F.length("book_id") % 2).alias("domain"), "knowledge_id").distinct()
    banks = questions.select("bank_id", (F.right("bank_id", F.lit(1)).cast("int") % 2).alias("domain"), "knowledge_id").distinct()
    return sections, books, banks, A.question_counts(questions)


@query(f"WITH {_STUDY_SQL} SELECT book_id, bank_id FROM pairs")
def namespace_overlap(spark, sf_dir):
    _, books, banks, _ = _study(spark, sf_dir)
    return A.namespace_overlap(books, banks)


@query(f"WITH {_STUDY_SQL} SELECT p.book_id, p.bank_id, c.knowledge_id, match_level, question_count FROM pairs p JOIN ns ON side = 'book' AND id = p.book_id JOIN counts c ON c.bank_id = p.bank_id AND c.knowledge_id = n AND match_level = 'comprehensive'")
def book_availability(spark, sf_dir):
    _, books, banks, counts = _study(spark, sf_dir)
    return A.book_availability(books, banks, counts)


@query(f"""WITH {_STUDY_SQL}, x AS (SELECT section_id, c.bank_id, c.knowledge_id, match_level, question_count FROM sections s JOIN pairs p USING (book_id) JOIN counts c ON c.bank_id = p.bank_id AND c.knowledge_id = s.knowledge_id AND match_level = 'section' WHERE contains(s.knowledge_id, '.s')
  QUALIFY row_number() OVER (PARTITION BY section_id, c.bank_id ORDER BY length(c.knowledge_id) DESC, place) = 1),
y AS (SELECT DISTINCT section_id, c.bank_id, c.knowledge_id, match_level, question_count FROM sections s JOIN pairs p USING (book_id) JOIN counts c ON c.bank_id = p.bank_id AND c.knowledge_id = regexp_extract(s.knowledge_id, '^(.+\\.ch\\d{{2}})(?:\\.|$)', 1) AND match_level = 'chapter')
SELECT * FROM x UNION ALL SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.section_id = y.section_id AND x.bank_id = y.bank_id)""")
def section_availability(spark, sf_dir):
    return A.section_availability(*_study(spark, sf_dir))


_PAYLOAD_SQL = """p AS (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN 'not json' WHEN event_id % 9 = 4 THEN '{"z":' || props || ',"a":1,"z":2}' ELSE '{ "z" : ' || props || ',"m":{"t":"' || event_type || 'é","v":' || CAST(floor(value) AS BIGINT) || ',"deep":{"k":[1]}},' || CASE WHEN event_id % 3 = 0 THEN '"b":[],' ELSE '' END || '"a":[' || user_id || ', null,"x",{"q":true}]}' END AS payload FROM events)"""


def _payloads(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    text = F.concat(
        F.lit('{ "z" : '), "props", F.lit(',"m":{"t":"'), "event_type", F.lit('é","v":'), F.floor("value").cast("string"), F.lit(',"deep":{"k":[1]}},'),
        F.when(i % 3 == 0, '"b":[],').otherwise(""), F.lit('"a":['), F.col("user_id").cast("string"), F.lit(', null,"x",{"q":true}]}'),
    )
    twice = F.concat(F.lit('{"z":'), "props", F.lit(',"a":1,"z":2}'))
    return e.select("event_id", F.when(i % 50 == 7, "not json").when(i % 9 == 4, twice).otherwise(text).alias("payload"))


@query("""SELECT event_id, CASE WHEN event_id % 50 <> 7 AND event_id % 9 <> 4 THEN sha256('{"a":[' || user_id || ',null,"x",{"q":true}],' || CASE WHEN event_id % 3 = 0 THEN '"b":[],' ELSE '' END || '"m":{"deep":{"k":[1]},"t":"' || event_type || 'é","v":' || CAST(floor(value) AS BIGINT) || '},"z":{"k":' || json_extract_string(props, '$.k') || '}}') END AS payload_sha256 FROM events""")
def canonical_payloads(spark, sf_dir):
    return _payloads(spark, sf_dir).select("event_id", P.canonical_sha256(F.col("payload")).alias("payload_sha256"))


@query(f"""WITH {_PAYLOAD_SQL}, v AS (SELECT event_id, CASE WHEN event_id % 50 <> 7 AND event_id % 9 <> 4 THEN CAST(payload AS JSON) END AS j FROM p),
a AS (SELECT '$' AS path, j FROM v WHERE j IS NOT NULL), b AS (SELECT a.path || CASE WHEN json_type(a.j) = 'ARRAY' THEN '[]' ELSE '.' || e.key END AS path, e.value AS j FROM a, json_each(a.j) e WHERE json_type(a.j) IN ('OBJECT', 'ARRAY')),
c AS (SELECT b.path || CASE WHEN json_type(b.j) = 'ARRAY' THEN '[]' ELSE '.' || e.key END AS path, e.value AS j FROM b, json_each(b.j) e WHERE json_type(b.j) IN ('OBJECT', 'ARRAY')),
k AS (SELECT path, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(json_array_length(j) AS BIGINT) END AS size FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) UNION ALL SELECT '$', 'invalid', NULL FROM v WHERE j IS NULL)
SELECT path, kind, count(*) AS n, max(size) AS longest FROM k GROUP BY 1, 2""")
def payload_shapes(spark, sf_dir):
    return P.shapes(_payloads(spark, sf_dir), "payload")


_CUT = 700
_MARKS_SQL = r"""t AS (SELECT page_id, string_split_regex(coalesce(html, ''), '(?i)</?div(?:[\s/][^>]*)?>') AS g, regexp_extract_all(coalesce(html, ''), '(?i)</?div(?:[\s/][^>]*)?>') AS m FROM pages),
u AS (SELECT page_id, unnest(m) AS mark, generate_subscripts(m, 1) AS i, g, m FROM t), k AS (SELECT page_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos, CASE WHEN starts_with(mark, '</') THEN -1 ELSE 1 END AS delta FROM u)"""


@query(f"""WITH {_MARKS_SQL}, s AS (SELECT page_id, CAST(unnest(generate_series(0, length(coalesce(html, '')) // {_CUT})) * {_CUT} AS BIGINT) AS a, length(coalesce(html, '')) AS n FROM pages), x AS (SELECT page_id, a, least(a + {_CUT}, n) AS b FROM s),
e AS (SELECT page_id, pos, delta FROM k UNION ALL SELECT page_id, pos, 0 FROM (SELECT page_id, a AS pos FROM x UNION SELECT page_id, b FROM x)), l AS (SELECT *, sum(delta) OVER w AS level, max(CASE WHEN delta = 1 THEN pos END) OVER w AS last_open FROM e WINDOW w AS (PARTITION BY page_id ORDER BY pos, abs(delta) ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, CAST(level - least(0, min(level) OVER (PARTITION BY page_id ORDER BY pos, abs(delta) ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS depth FROM l)
SELECT x.page_id, x.a AS start, x.b AS "end", repeat('<div>', f.depth) AS prefix, repeat('</div>', g.depth) AS suffix, f.last_open FROM x JOIN d f ON f.page_id = x.page_id AND f.pos = x.a AND f.delta = 0 JOIN d g ON g.page_id = x.page_id AND g.pos = x.b AND g.delta = 0""")
def span_wrappers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    n = F.length(F.coalesce("html", F.lit(""))).cast("long")
    cuts = pages.select("page_id", n.alias("n"), F.explode(F.expr(f"sequence(0L, cast(char_length(coalesce(html, '')) div {_CUT} AS bigint))")).alias("i"))
    spans = cuts.select("page_id", (F.col("i") * _CUT).alias("start"), F.least(F.col("i") * _CUT + _CUT, "n").alias("end"))
    return M.span_wrappers(pages, "page_id", "html", spans, "div")

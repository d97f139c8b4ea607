"""Queries over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import documents as D
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_RULES = (("the", "THE"), ("that", "THAT"), ("on", "0N"), ("de", "DE"))
_PROTECTED = ("then", "onto", "desde")
_TERMS = ("the", "que", "der", "de la")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("""SELECT doc_id, substring(sha256(concat_ws(':', source, lang, CAST(n_chars AS VARCHAR))), 1, 16) AS id, substring(sha1(source || chr(0) || CAST(doc_id AS VARCHAR)), 1, 12) AS path_id FROM documents""")
def stable_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.short_id(F.col("source"), F.col("lang"), F.col("n_chars")).alias("id"), X.path_id(F.col("source"), F.col("doc_id")).alias("path_id"))


@query("SELECT doc_id, sha256(text) AS sha256, length(text) = n_chars AS whole FROM documents")
def content_hash_verify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), (F.length("text") == F.col("n_chars")).alias("whole"))


@query("""WITH a AS (SELECT source, doc_id AS k, sha256(text) AS h FROM documents), b AS (SELECT source, k // 4096 AS r, sha256(string_agg(k || ':' || h, ';' ORDER BY k)) AS h FROM a GROUP BY 1, 2),
c AS (SELECT source, r // 4096 AS q, sha256(string_agg(r || ':' || h, ';' ORDER BY r)) AS h FROM b GROUP BY 1, 2) SELECT source, sha256(string_agg(q || ':' || h, ';' ORDER BY q)) AS set_sha256 FROM c GROUP BY 1""")
def page_set_hash(spark, sf_dir):
    return D.set_hash(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("WITH t AS (SELECT doc_id, unnest(['" + "', '".join(_TERMS) + "']) AS term, lower(text) AS x FROM documents) SELECT term, CAST(sum((length(x) - length(replace(x, term, ''))) // length(term)) AS BIGINT) AS n FROM t GROUP BY 1")
def term_frequency(spark, sf_dir):
    low = F.lower("text")
    rows = _docs(spark, sf_dir).select(*[F.sum(X.count_term(low, t)).alias(t) for t in _TERMS])
    return rows.unpivot([], list(_TERMS), "term", "n")


_NOISE = {"digits": "[0-9]{4,}", "marks": "[!?]{2,}", "table": " \\| ", "symbols": "[#*$%&]{3}", "link": "https?://"}


@query("SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS {n}" for n, p in _NOISE.items()) + ", source FROM documents GROUP BY source")
def noise_pattern_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(*[F.sum(F.regexp_count("text", F.lit(p))).cast("long").alias(n) for n, p in _NOISE.items()])


@query("SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents WHERE length(text) > 200 QUALIFY copies > 1")
def duplicate_long_text(spark, sf_dir):
    from pyspark.sql import Window

    rows = _docs(spark, sf_dir).where(F.length("text") > 200).select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("copies > 1").select("doc_id", "copies")


def _fold_sql(x):
    for i, w in enumerate(sorted(_PROTECTED, key=lambda w: (-len(w), w))):
        x = f"replace({x}, '{w}', chr({0xE000 + i}))"
    for old, new in sorted(_RULES, key=lambda r: (-len(r[0]), r[0])):
        x = f"replace({x}, '{old}', '{new}')"
    for i, w in enumerate(sorted(_PROTECTED, key=lambda w: (-len(w), w))):
        x = f"replace({x}, chr({0xE000 + i}), '{w}')"
    return x


@query(f"SELECT doc_id, sha256({_fold_sql('text')}) AS cleaned_sha256 FROM documents")
def protected_replace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.guarded_replace(F.col("text"), _RULES, _PROTECTED), 256).alias("cleaned_sha256"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
s AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, arg_min(line, line_no) AS title, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM s GROUP BY 1, 2""")
def heading_sections(spark, sf_dir):
    return D.sections(D.lines(_docs(spark, sf_dir), "doc_id", "text"), "doc_id", F.length("line") < 60)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""")
def line_offsets(spark, sf_dir):
    return D.lines(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "line_no", F.col("offset").cast("long").alias("offset"))


_CUTS = "coalesce(" + ", ".join(f"CASE WHEN contains(late, {m}) THEN length(late) - instr(reverse(late), reverse({m})) + 1 END" for m in ("chr(10) || chr(10)", "chr(10)", "'。'", "'. '", "' '")) + ", 750)"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS (SELECT doc_id, 0 AS part, '' AS chunk, text AS rest FROM d UNION ALL SELECT doc_id, part + 1, left(rest, CAST(cut AS BIGINT)), substring(rest, CAST(cut AS BIGINT) + 1) FROM (SELECT *, CASE WHEN length(rest) > 1500 THEN 750 + {_CUTS} ELSE length(rest) END AS cut FROM (SELECT *, substring(rest, 751, 750) AS late FROM r WHERE part = 0 OR rest <> '')))
SELECT doc_id, part, max(part) OVER (PARTITION BY doc_id) AS parts, length(chunk) AS n_chars, sha256(chunk) AS sha256 FROM r WHERE part > 0""")
def text_chunks(spark, sf_dir):
    return D.chunks(_docs(spark, sf_dir), "doc_id", "text", 1500).select("doc_id", "part", "parts", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("sha256"))


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, n_chars, i, 1 AS page, n_chars + 80 AS used FROM d WHERE i = 1 UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.i, page + CASE WHEN used + d.n_chars + 80 > 5000 THEN 1 ELSE 0 END, CASE WHEN used + d.n_chars + 80 > 5000 THEN 0 ELSE used END + d.n_chars + 80 FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1)
SELECT source, doc_id, n_chars, page FROM r""")
def page_bin_packing(spark, sf_dir):
    return D.pages(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 5000)


_NUMERAL_SQL = """n AS (SELECT p_partkey, p_partkey % 1000 AS n FROM part), d AS (SELECT *, n // 100 AS h, (n % 100) // 10 AS t, n % 10 AS o, '一二三四五六七八九' AS w FROM n),
t AS (SELECT *, CASE WHEN h > 0 THEN w[h] || '百' || CASE WHEN t = 0 AND o > 0 THEN '零' ELSE '' END ELSE '' END || CASE WHEN t = 0 THEN '' WHEN h = 0 AND t = 1 THEN '十' ELSE w[t] || '十' END || CASE WHEN o > 0 THEN w[o] ELSE '' END || CASE WHEN p_partkey % 37 = 0 THEN '?' ELSE '' END AS numeral FROM d)"""


@query(f"WITH {_NUMERAL_SQL} SELECT p_partkey, numeral, CASE WHEN n > 0 AND p_partkey % 37 > 0 THEN n END AS value FROM t")
def chinese_numeral_parse(spark, sf_dir):
    """Numerals of part keys below a thousand, and their values read back."""
    n = F.col("p_partkey") % 1000
    h, t, o = F.floor(n / 100), F.floor(n % 100 / 10), n % 10
    word = lambda d: F.substring(F.lit("一二三四五六七八九"), d.cast("int"), F.lit(1))
    text = F.concat(
        F.when(h > 0, F.concat(word(h), F.lit("百"), F.when((t == 0) & (o > 0), "零").otherwise(""))).otherwise(""), F.when(t == 0, "").when((h == 0) & (t == 1), "十").otherwise(F.concat(word(t), F.lit("十"))),
        F.when(o > 0, word(o)).otherwise(""), F.when(F.col("p_partkey") % 37 == 0, "?").otherwise(""),
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("numeral")).withColumn("value", X.numeral(F.col("numeral")).cast("long"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '第十二章、' || source || '与 病变' WHEN 1 THEN doc_id || '. ' || coalesce(text, '') WHEN 2 THEN replace(source, '-', ' ') || '：麻醉' || doc_id WHEN 3 THEN coalesce(text, '') || '过敏' ELSE source || '（' || lang || '）' END AS title FROM documents),
b AS (SELECT *, replace(regexp_replace(regexp_replace(coalesce(title, ''), '^(?:第[一二三四五六七八九十百\d]+章|\d+)[\s、.．]*', ''), '[\s\x0B·•:：,，。.!！?？()（）\[\]【】/／与及和病变]', '', 'g'), '过敏', '敏感') AS bare, regexp_extract(coalesce(title, ''), '^([A-Za-z][A-Za-z \-'']*)[:：]\s*([\x{3400}-\x{9fff}].*)$', 1) AS latin FROM t)
SELECT doc_id, sha256(bare) AS bare_sha256, sha256(CASE WHEN latin <> '' THEN trim(latin) ELSE title END) AS term_sha256, regexp_extract(coalesce(title, ''), '^([A-Za-z][A-Za-z \-'']*)[:：]\s*([\x{3400}-\x{9fff}].*)$', 2) AS translation FROM b""")
def title_normalizer(spark, sf_dir):
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    title = (
        F.when(d % 5 == 0, F.concat(F.lit("第十二章、"), "source", F.lit("与 病变"))).when(d % 5 == 1, F.concat(d.cast("string"), F.lit(". "), text)).when(d % 5 == 2, F.concat(F.replace("source", F.lit("-"), F.lit(" ")), F.lit("：麻醉"), d.cast("string")))
        .when(d % 5 == 3, F.concat(text, F.lit("过敏"))).otherwise(F.concat("source", F.lit("（"), "lang", F.lit("）")))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"))
    term, translation = X.bilingual(F.col("title"))
    return rows.select("doc_id", F.sha2(X.bare_title(F.col("title")), 256).alias("bare_sha256"), F.sha2(term, 256).alias("term_sha256"), F.coalesce(translation, F.lit("")).alias("translation"))


@query("SELECT CAST(e.value AS BIGINT) AS k, count(*) AS n FROM events, json_each(props) e WHERE e.key = 'k' GROUP BY 1")
def json_map_explode(spark, sf_dir):
    props = F.from_json("props", "map<string,bigint>")
    return table(spark, sf_dir, "events").select(F.explode(props).alias("key", "k")).where("key = 'k'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT array_to_string(json_keys(props), ',') AS keys, count(*) AS n FROM events GROUP BY 1")
def json_shape_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.array_join(F.json_object_keys("props"), ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"))

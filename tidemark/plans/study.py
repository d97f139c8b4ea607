"""Queries of prompts, answers, notes, identifiers and dates, each over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import study as T
from tidemark.plans.registry import query
from tidemark.sources.tables import table


@query("""SELECT p_partkey, CASE WHEN p_partkey % 110 BETWEEN 1 AND 99 THEN CASE WHEN n < 10 THEN '' WHEN n < 20 THEN '十' ELSE substring('〇一二三四五六七八九', CAST(n // 10 AS INT) + 1, 1) || '十' END || CASE WHEN n % 10 = 0 THEN '' ELSE substring('〇一二三四五六七八九', CAST(n % 10 AS INT) + 1, 1) END END AS numeral
FROM (SELECT p_partkey, p_partkey % 110 AS n FROM part)""")
def chinese_numerals(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.chinese_number(F.col("p_partkey") % 110).alias("numeral"))


@query("""WITH k AS (SELECT doc_id, lang, source, CASE doc_id % 3 WHEN 0 THEN 'alone' WHEN 1 THEN lang || '.' || source || '.ch' || doc_id % 12 || '.s01' ELSE lang || '.' || source END AS id FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN split_part(id, '.', 1) || '.' || split_part(id, '.', 2) END AS namespace, coalesce(regexp_extract(id, '^(.*?\\.ch\\d+)(?:\\.|$)', 1), '') AS chapter, lang || ':' || CASE WHEN doc_id % 2 = 0 THEN 'default' ELSE source END AS subject FROM k WHERE id IS NOT NULL""")
def knowledge_names(spark, sf_dir):
    dotted = F.lit("").cast("string")
    d = table(spark, sf_dir, "documents")
    both = F.concat("lang", F.lit("."), "source")
    dotted = F.when(F.col("doc_id") % 3 == 0, "alone").when(F.col("doc_id") % 3 == 1, F.concat(both, F.lit(".ch"), (F.col("doc_id") % 12).cast("string"), F.lit(".s01"))).otherwise(both)
    d = d.withColumn("id", dotted).where("id is not null")
    subject = T.subject_key(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("source")))
    return d.select("doc_id", T.namespace(F.col("id")).alias("namespace"), F.coalesce(T.chapter_prefix(F.col("id")), F.lit("")).alias("chapter"), subject.alias("subject"))


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '…' ELSE text END AS preview,
  CASE WHEN strpos(text, 'the') > 0 THEN substring(text, greatest(1, strpos(text, 'the') - 24), strpos(text, 'the') - greatest(1, strpos(text, 'the') - 24) + 27) END AS excerpt FROM documents""")
def text_previews(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(text).alias("preview"), T.excerpt(text, F.lit("the")).alias("excerpt"))


@query("""WITH f AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\b(\\d{1,2})\\b', 1), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 1 AND 20))) AS found FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(found, ',') AS found, CAST(20 - len(found) AS INT) AS n_missing, array_to_string(list_filter(range(1, 21), lambda x: NOT list_contains(found, x)), ',') AS missing FROM f""")
def protected_cloze_missing(spark, sf_dir):
    found = T.marked_numbers(F.col("text"))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", found.alias("found"))
    missing = T.missing_numbers(F.col("found"))
    return d.select("doc_id", F.array_join(F.col("found").cast("array<string>"), ",").alias("found"), F.size(missing).alias("n_missing"), F.array_join(missing.cast("array<string>"), ",").alias("missing"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, 'Paragraph ' || turn % 3 || ' and para ' || conv_id % 4 || ', about ' || conv_id % 200 || ' words. ' || text AS prompt FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) ELSE len(regexp_extract_all(text, '[A-Za-z]+')) END AS words, CAST(regexp_extract(lower(prompt), 'about (\\d+) words', 1) AS INT) AS asked,
  CASE WHEN turn % 3 = conv_id % 4 THEN CAST(turn % 3 AS VARCHAR) ELSE turn % 3 || ',' || conv_id % 4 END AS paragraphs, length(CASE WHEN contains(text, 'a') THEN text ELSE 'a' || chr(10) || text END) AS tagged FROM c""")
def answer_word_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    prompt = F.concat(F.lit("Paragraph "), F.col("turn") % 3, F.lit(" and para "), F.col("conv_id") % 4, F.lit(", about "), F.col("conv_id") % 200, F.lit(" words. "), "text")
    tagged = T.with_tag(F.col("text"), F.lit("a"))
    return c.withColumn("prompt", prompt).select(
        "conv_id", "turn", T.answer_words(F.col("text"), F.col("role") == "user").alias("words"), T.asked_words(F.col("prompt")).alias("asked"),
        F.array_join(F.slice(T.paragraph_references(F.col("prompt")), 1, 2), ",").alias("paragraphs"), F.length(tagged).cast("long").alias("tagged"),
    )


@query("""WITH n AS (SELECT conv_id, string_agg(trim(text, ' ' || chr(10)), chr(10) || '---' || chr(10) ORDER BY turn) AS note, count(*) FILTER (trim(text, ' ' || chr(10)) <> '') AS entries, bool_or(contains(lower(text), 'the')) AS has_prompt FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?m)^---$') GROUP BY 1)
SELECT conv_id, entries, length(note) AS chars, has_prompt FROM n""")
def note_entries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").where(~F.col("text").rlike("(?m)^---$"))
    own = F.trim("text", F.lit(" \n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", own.alias("t")))), lambda x: x["t"])
    notes = c.groupBy("conv_id").agg(F.array_join(parts, "\n---\n").alias("note"))
    return notes.select("conv_id", F.size(T.note_entries(F.col("note"))).cast("long").alias("entries"), F.length("note").cast("long").alias("chars"), F.contains(F.lower("note"), F.lit("the")).alias("has_prompt"))


@query("""WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 10000 THEN printf('%.1fw', floor(n / 1000.0 + 0.5) / 10) WHEN n >= 1000 THEN printf('%.1fk', floor(n / 100.0 + 0.5) / 10) ELSE CAST(n AS VARCHAR) END AS compact FROM n""")
def compact_numbers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.compact_number(F.floor(F.col("o_totalprice") / 10).cast("long")).alias("compact"))


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN starts_with(trim(x, ' '), 'License') OR starts_with(trim(x, ' '), 'Copyright') THEN '' ELSE x END) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(array_to_string(x, chr(10))) AS blanked, len(x) AS lines FROM l""")
def watermark_lines(spark, sf_dir):
    out = T.blanked_lines(F.col("text"), ("License", "Copyright"))
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.sha2(out, 256).alias("blanked"), F.size(F.split(out, "\n")).cast("long").alias("lines"))


@query("""WITH h AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'intro' || chr(10) || '# Title ' || role || '  ' || chr(10) || 'body' ELSE 'none' END AS t, role FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Title ' || role ELSE role END AS heading, CASE WHEN turn % 2 = 0 THEN role || ',x' ELSE role END AS tags FROM h""")
def first_headings(spark, sf_dir):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("intro\n# Title "), "role", F.lit("  \nbody"))).otherwise("none")
    tags = T.tags(F.col("role"), F.lit(" "), F.col("role"), F.when(F.col("turn") % 2 == 0, "x"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.first_heading(text, F.col("role")).alias("heading"), F.array_join(tags, ",").alias("tags"))


@query("""SELECT event_id, '{"a":"' || event_type || '","k":"' || coalesce(json_extract_string(props, '$.k'), '') || '"}' AS canonical, coalesce(json_extract_string(props, '$.k'), '') AS k,
  substring(sha256(event_type || chr(9247) || CAST(user_id AS VARCHAR)), 1, 16) AS joined_id, substring(sha256(CAST(event_id AS VARCHAR) || chr(9247) || sha256(event_type)), 1, 16) AS build FROM events""")
def canonical_ids(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    json = F.to_json(F.create_map(F.lit("k"), k, F.lit("a"), F.col("event_type")))
    return table(spark, sf_dir, "events").select(
        "event_id", T.canonical_json(json).alias("canonical"), F.array_join(T.by_suffix(json, "k"), ",").alias("k"),
        T.joined_id(F.concat(F.lit(" "), "event_type"), F.col("user_id").cast("string")).alias("joined_id"), T.joined_id(F.col("event_id").cast("string"), F.sha2("event_type", 256)).alias("build"),
    )


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T10:00:00' END AS stamp, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 1 END AS modified FROM orders),
k AS (SELECT o_orderkey, coalesce(TRY_CAST(substring(stamp, 1, 10) AS DATE), modified, DATE '1998-01-01') AS day FROM d)
SELECT o_orderkey, CAST(day AS VARCHAR) AS day, month(day) || '月' || day(day) || '日' AS label, DATE '1998-01-01' - day AS days, CASE WHEN DATE '1998-01-01' - day <= 30 THEN 'final' WHEN DATE '1998-01-01' - day <= 120 THEN 'near' ELSE 'early' END AS stage FROM k""")
def date_labels(spark, sf_dir):
    fixed = F.lit("1998-01-01").cast("date")
    stamp = F.when(F.col("o_orderkey") % 3 == 0, "bad").otherwise(F.concat(F.to_date("o_orderdate").cast("string"), F.lit("T10:00:00")))
    modified = F.when(F.col("o_orderkey") % 2 == 0, F.date_add(F.to_date("o_orderdate"), 1))
    o = table(spark, sf_dir, "orders").select("o_orderkey", T.day_of(stamp, modified, fixed).alias("day"))
    left = T.countdown(fixed, F.col("day"))
    return o.select("o_orderkey", F.col("day").cast("string").alias("day"), T.day_label(F.col("day")).alias("label"), left["days"].cast("long").alias("days"), left["stage"].alias("stage"))

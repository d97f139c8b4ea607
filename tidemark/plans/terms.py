"""Queries of terms written wrongly, over documents: a mark in a term, what it is confused with, and words to leave alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import terms as T
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_TERMS, _CONFUSIONS, _OVERRIDES, _PROTECTED = ("th@", "@ing", "w@h", "@"), ("ea", "e", "on", "a"), (("hew", "h@w"), ("the", "THE")), ("there", "then", "wash", "beaing", "oned")
_values = lambda rows: ", ".join(f"({', '.join(repr(x) for x in (r if isinstance(r, tuple) else (r,)))})" for r in rows)
_RULES_SQL = f"""terms(term) AS (VALUES {_values(_TERMS)}), confusions(confusion) AS (VALUES {_values(_CONFUSIONS)}), overrides(alias, canonical) AS (VALUES {_values(_OVERRIDES)}), protected(word) AS (VALUES {_values(_PROTECTED)}),
made AS (SELECT replace(term, '@', confusion) AS alias, term AS canonical, 0 AS own FROM terms, confusions WHERE length(term) > 1 UNION ALL SELECT alias, canonical, 1 FROM overrides),
rules AS (SELECT alias, canonical, (alias LIKE '%e%' OR alias LIKE '%a%') AND alias NOT LIKE '%ea%' AND alias NOT LIKE '%on%' AS strict FROM made QUALIFY row_number() OVER (PARTITION BY alias ORDER BY own DESC, canonical DESC) = 1)"""
_FOUND_SQL = f"""{_RULES_SQL}, d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pl AS (SELECT doc_id, word, CAST(sum(length(part)) OVER (PARTITION BY doc_id, word ORDER BY i) + (i - 1) * length(word) AS INT) AS s, i, n FROM (SELECT doc_id, word, unnest(string_split(text, word)) AS part, generate_subscripts(string_split(text, word), 1) AS i, len(string_split(text, word)) AS n FROM d, (SELECT alias AS word FROM rules UNION SELECT word FROM protected) WHERE contains(text, word)) ),
occ AS (SELECT doc_id, word, s, s + length(word) AS e FROM pl WHERE i < n),
c AS (SELECT o.doc_id, o.s, o.e, alias, canonical, strict AND EXISTS (SELECT 1 FROM occ p JOIN protected USING (word) WHERE p.doc_id = o.doc_id AND p.s < o.e AND o.s < p.e) AS guarded FROM occ o JOIN rules ON alias = o.word),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, alias, s) AS i FROM c),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s INT, e INT)[]) AS taken, false AS here FROM d UNION ALL
  SELECT k.doc_id, k.i, CASE WHEN NOT guarded AND len(list_filter(taken, lambda t: t.s < k.e AND k.s < t.e)) = 0 THEN list_append(taken, {{'s': k.s, 'e': k.e}}) ELSE taken END, len(list_filter(taken, lambda t: t.s < k.e AND k.s < t.e)) = 0 FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1),
f AS (SELECT k.* FROM k JOIN r ON r.doc_id = k.doc_id AND r.i = k.i WHERE here)"""


def _rules(spark):
    one = lambda rows, *names: spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names))
    return T.alias_rules(one(_TERMS, "term"), one(_CONFUSIONS, "confusion"), one(_OVERRIDES, "alias", "canonical"), "@"), one(_PROTECTED, "word")


def _found(spark, sf_dir):
    return T.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text", *_rules(spark))


@query(f"WITH RECURSIVE {_FOUND_SQL} SELECT alias, canonical, count(DISTINCT CASE WHEN NOT guarded THEN doc_id END) AS documents, count(*) FILTER (NOT guarded) AS occurrences, count(*) FILTER (guarded) AS guarded FROM f GROUP BY 1, 2")
def term_residuals(spark, sf_dir):
    return T.residuals(_found(spark, sf_dir))


@query(f"""WITH RECURSIVE {_FOUND_SQL}, u AS (SELECT doc_id, s, e, canonical, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS past FROM f WHERE NOT guarded),
p AS (SELECT doc_id, string_agg(substring(text, past + 1, s - past) || canonical, '' ORDER BY s) AS head, max(e) AS past, count(*) AS n FROM u JOIN d USING (doc_id) GROUP BY 1), g AS (SELECT doc_id, count(*) AS n_guarded FROM f WHERE guarded GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_replaced, coalesce(n_guarded, 0) AS n_guarded, sha256(coalesce(head, '') || substring(text, coalesce(past, 0) + 1)) AS text_sha256 FROM d LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)""")
def terms_replaced(spark, sf_dir):
    rows = _found(spark, sf_dir)
    n = lambda guarded: F.size(F.filter("spans", lambda x: x["guarded"] == guarded)).cast("long")
    return rows.select("doc_id", n(False).alias("n_replaced"), n(True).alias("n_guarded"), F.sha2("replaced", 256).alias("text_sha256"))


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\bth[aeo]\b')) AS a, len(regexp_extract_all(coalesce(text, ''), '[a-z]ing[,.]')) AS b FROM documents)
SELECT doc_id, 'bare' AS rule, a AS n FROM c WHERE a > 0 UNION ALL SELECT doc_id, 'ending', b FROM c WHERE b > 0""")
def pattern_residuals(spark, sf_dir):
    return T.pattern_residuals(table(spark, sf_dir, "documents"), "doc_id", "text", {"bare": r"\bth[aeo]\b", "ending": r"[a-z]ing[,.]"})


@query(f"WITH {_RULES_SQL} SELECT alias, canonical, strict, row_number() OVER (ORDER BY length(alias) DESC, alias) AS place, (SELECT count(*) FROM documents WHERE contains(text, alias)) AS documents FROM rules")
def alias_rule_expansion(spark, sf_dir):
    rules, _ = _rules(spark)
    rows = table(spark, sf_dir, "documents").select("text")
    aliases = [r["alias"] for r in rules.select("alias").collect()]  # a configuration
    counts = rows.agg(*[F.count_if(F.contains("text", F.lit(a))).alias(f"c{i}") for i, a in enumerate(aliases)]).select(F.inline(F.array(*[F.struct(F.lit(a).alias("alias"), F.col(f"c{i}").alias("documents")) for i, a in enumerate(aliases)])))
    return rules.join(counts, "alias").withColumn("place", F.col("place").cast("long"))

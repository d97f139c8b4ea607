"""Quality rules whose cutoffs come with a guarantee on false rejections.

Each rule is a share that is high in bad texts. Labelled texts are halved by a hash of the
text, and equal texts count once, so that no copy is on both halves. In each stratum the
good texts of one half propose LEVELS sets of cutoffs, from mild to strict: level m cuts
every rule at the share that m * STEP of them exceed. A rule takes part where more of the
half's bad texts lie beyond its middle cutoff than USEFUL times as many good ones as
should. The good texts of the other half then test the sets: a level passes if, were the
true rate of good texts that it rejects RISK or more, so few of them would be rejected
with a probability of at most FAIL / strata: an exact binomial bound on all rules
together, with Bonferroni's correction over strata. Levels are nested, so they are tested
from the mildest on and the first that fails ends the sequence, which needs no further
correction. With a probability of 1 - FAIL no stratum then loses more than RISK of its
good texts. A stratum with too few labels certifies nothing, and keeps all that the base
keeps.

Everything is DataFrame and SQL functions. Defined results: null and empty texts have no
words and fail the base; a null stratum is one of its own, apart from the empty one; of
several labels of a doc_id or of a text the lowest counts; repeated rows each give a row,
and equal texts of a stratum fare alike; a null doc_id has no label; an empty table gives
none; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

RISK = 0.05
FAIL = 0.05
LEVELS = 32
#: of good texts that one more level puts beyond each rule
STEP = 0.002
USEFUL = 2
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RULES = ("symbol_share", "mark_share", "capital_share", "double_line_share", "repeat_share", "word_length")


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def repeat_words_sql(words: str) -> str:
    """SQL for the number of words in 3-word windows that an array of words has twice or more.

    Windows are sorted with their places, so that equal ones meet; a place then adds the
    words up to the next one, three at most.
    """
    codes = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    equal = "filter(s, (e, k) -> (k > 0 AND s[greatest(k - 1, 0)].c = e.c) OR (k + 1 < size(s) AND s[least(k + 1, size(s) - 1)].c = e.c))"
    gaps = "aggregate(transform(p, (x, k) -> IF(k + 1 < size(p), least(3, p[least(k + 1, size(p) - 1)] - x), 3)), 0L, (a, b) -> a + b)"
    sorted_ = "array_sort(transform(h, (c, i) -> named_struct('c', c, 'i', i)))"
    found = _let(sorted_, "s", _let(f"array_sort(transform({equal}, e -> e.i))", "p", gaps))
    some = _let(codes, "h", f"IF(size(array_distinct(h)) = size(h), 0L, {found})")
    return _let(words, "w", f"IF(size(w) < 3, 0L, {some})")


def base_counts(df: DataFrame, key: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """doc_id, stratum, twin (a hash of the text), the base counts, base_failed, and a share for each of RULES."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), (F.col(stratum).cast("string") if stratum in df.columns else F.lit(None).cast("string")).alias("stratum"), body.alias("text"))
    split = rows.withColumns(
        {
            "ws": F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""),
            "ls": F.filter(F.split("text", "\\n"), lambda x: _without(x, WHITE) != ""),
        }
    )
    chars = F.length("text")
    counts = split.select(
        "doc_id", "stratum", F.xxhash64("text").alias("twin"), F.size("ws").cast("long").alias("n_words"), F.length(_without(F.col("text"), WHITE)).cast("long").alias("word_chars"),
        (chars - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"), (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat_words_sql("ws")).alias("n_repeat_words"), F.size("ls").alias("lines"), chars.alias("chars"),
        (chars - F.length(_without(F.col("text"), "!?"))).alias("marks"), (chars - F.length(_without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("capitals"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    shares = [share("n_symbols", "chars"), share("marks", "chars"), share("capitals", "chars"), share("n_dup_lines", "lines"), share("n_repeat_words", "n_words"), share("word_chars", "n_words")]
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return counts.select("doc_id", "stratum", "twin", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *(s.alias(r) for s, r in zip(shares, RULES, strict=True)))


def _log_factorial(x: str) -> str:
    """Stirling's series from x + 8 on, so that it holds for small x as well."""
    y = f"({x} + 8D)"
    steps = " + ".join(f"ln({x} + {k}D)" for k in range(1, 9))
    return f"({y} * ln({y}) - {y} + 0.5D * ln(2D * pi() * {y}) + 1D / (12D * {y}) - 1D / (360D * power({y}, 3)) + 1D / (1260D * power({y}, 5)) - ({steps}))"


def binomial_tail_sql(n: str, k: str, p: str) -> str:
    """SQL for P(X <= k) of a binomial X, k below its mean; 1 from the mean on. Terms fall from k down to beyond any double's precision."""
    top = f"exp({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')} + {k} * ln({p}) + ({n} - {k}) * ln(1D - {p}))"
    width = f"CAST(ceil(14D * sqrt({n} * {p})) + 64 AS BIGINT)"
    terms = f"IF({k} < 1, CAST(array() AS ARRAY<BIGINT>), sequence(CAST({k} AS BIGINT), greatest(1L, CAST({k} AS BIGINT) - {width}), -1L))"
    total = f"aggregate({terms}, named_struct('t', 1D, 's', 1D), (a, j) -> named_struct('t', a.t * j * (1D - {p}) / (({n} - j + 1D) * {p}), 's', a.s + a.t * j * (1D - {p}) / (({n} - j + 1D) * {p})), a -> a.s)"
    return f"CASE WHEN {k} >= {n} * {p} THEN 1D ELSE least(1D, {top} * {total}) END"


def cutoffs(counts: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", risk: float = RISK, fail: float = FAIL) -> DataFrame:
    """(stratum, limits): for each stratum that certifies a level, its cutoffs by rule. One row a stratum."""
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("good")).dropna().groupBy("doc_id").agg(F.min("good").alias("good")).where("good in (0, 1)")
    rows = counts.where(~F.col("base_failed")).join(known, "doc_id").groupBy("stratum", "twin").agg(F.min("good").alias("good"), *[F.first(r).alias(r) for r in RULES])
    rows = written(rows.withColumn("half", F.pmod(F.xxhash64("twin", F.lit("half")), F.lit(2))))
    parts = F.array(*[F.lit(1 - STEP * (m + 1)) for m in range(LEVELS)])
    grid = rows.where("half = 0 AND good = 1").groupBy("stratum").agg(*[F.percentile_approx(r, parts, F.lit(10_000)).alias("grid_" + r) for r in RULES])
    grid = grid.withColumnRenamed("stratum", "of")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    middle = LEVELS // 2
    beyond = [F.avg((F.col(r) > F.col("grid_" + r)[middle]).cast("double")) >= USEFUL * STEP * (middle + 1) for r in RULES]
    useful = rows.where("half = 0 AND good = 0").join(grid, same("stratum", "of")).groupBy("stratum").agg(*[b.alias("use_" + r) for r, b in zip(RULES, beyond, strict=True)])
    sets = written(grid.join(useful, same("of", "stratum")).drop("stratum"))
    level = F.least(*[F.when(F.col("use_" + r), F.expr(f"size(filter(grid_{r}, g -> {r} <= g))")).otherwise(LEVELS) for r in RULES])
    hit = rows.where("half = 1 AND good = 1").join(sets, same("stratum", "of")).groupBy("of", level.alias("level")).agg(F.count(F.lit(1)).alias("k"))
    tests = sets.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("tests"))
    seen = hit.groupBy("of").agg(F.sum("k").cast("double").alias("n"), F.collect_list(F.struct("level", "k")).alias("by")).crossJoin(tests)  # one row
    tried = seen.select("of", "n", "tests", "by", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("m"))
    tried = tried.withColumn("k", F.expr("CAST(aggregate(filter(by, b -> b.level <= m), 0L, (a, b) -> a + b.k) AS DOUBLE)"))
    tried = tried.withColumn("ok", F.expr(binomial_tail_sql("n", "k", f"{risk!r}D")) <= F.lit(fail) / F.col("tests"))
    milder = Window.partitionBy("of").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    best = tried.withColumn("ok", F.min("ok").over(milder)).where("ok").groupBy("of").agg(F.max("m").alias("m")).withColumnRenamed("of", "stratum")
    limits = F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*[F.when(F.col("use_" + r), F.col("grid_" + r)[F.col("m")]) for r in RULES]))
    return best.join(sets, same("stratum", "of")).select("stratum", limits.alias("limits"))


def verdicts(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    counts = written(base_counts(df, key, text, stratum))
    limits = cutoffs(counts, labels, key).withColumnRenamed("stratum", "of")
    joined = counts.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left")
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col(r) > F.col("limits")[r], F.lit(False)) for r in RULES])
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))


def op5_risk_controlled_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return verdicts(docs, labels)

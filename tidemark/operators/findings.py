"""Data-quality rules as findings in long format, their rollup and the gates on them.

A rule is a severity, a code and a predicate on one row; rules on several rows give
findings of the same shape through window and anti joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_blank

SHAPE = ["id", "severity", "code"]


@dataclass
class Rule:
    code: str
    fires: Column

    @property
    def severity(self) -> str:
        return "blocker" if self.code[:1] == "E" else "warning"


def row_findings(rows: DataFrame, rules: Sequence[Rule], key: str) -> DataFrame:
    """All rules on each row, in one pass."""
    found = F.filter(F.array(*[F.when(F.coalesce(r.fires, F.lit(False)), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"))) for r in rules]), lambda x: x.isNotNull())
    return rows.select(F.col(key).cast("string").alias("id"), F.explode(found).alias("f")).select("id", "f.*")


def question_rules() -> list[Rule]:
    """Rules on one question: question_id, question_type, stem_md, options, correct_answers, knowledge_ids, source_refs, source_analysis_md, status, local_number."""
    labels = F.transform("options", lambda o: o["label"])
    expected = F.transform(F.sequence(F.lit(0), F.greatest(F.size("options") - 1, F.lit(0))), lambda i: F.char(i + 65))
    answers = F.coalesce("correct_answers", F.array().cast("array<string>"))
    single = F.col("question_type") == "single_choice"
    return [
        Rule("E013", ~F.coalesce(F.col("question_id").rlike("^[A-Za-z0-9][A-Za-z0-9._-]{3,}$"), F.lit(False))),
        Rule("E015", ~F.coalesce(F.col("question_type").isin("single_choice", "multiple_choice"), F.lit(False))),
        Rule("E016", is_blank(F.col("stem_md"))),
        Rule("E017", F.col("options").isNull() | (F.size("options") < 2) | (labels != expected) | F.exists("options", lambda o: is_blank(o["text_md"]))),
        Rule("E018", F.size(answers) == 0),
        Rule("E019", F.size(F.array_except(answers, F.coalesce(labels, F.array().cast("array<string>")))) > 0),
        Rule("E020", single & (F.size(answers) != 1)),
        Rule("E021", F.exists("knowledge_ids", lambda k: ~k.rlike(r"^[a-z0-9_-]+(\.[a-z0-9_-]+)+$"))),
        Rule("E023", F.coalesce(F.size("source_refs"), F.lit(0)) <= 0),
        Rule("E025", is_blank(F.col("source_analysis_md"))),
        Rule("E026", ~F.col("status").eqNullSafe(F.lit("ready"))),
        Rule("E055", F.col("local_number") < 1),
        Rule("W002", F.coalesce(F.size("knowledge_ids"), F.lit(0)) <= 0),
        Rule("W003", (F.col("question_type") == "multiple_choice") & (F.size(answers) == 1)),
        Rule("W009", F.size(F.array_distinct(answers)) < F.size(answers)),
        Rule("W013", F.col("local_number").isNull()),
    ]


def repeated(rows: DataFrame, key: str, order: str, code: str, *keys: str) -> DataFrame:
    """A finding for each row whose keys an earlier row has."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("n", n).where("n > 1").select(F.col(key).cast("string").alias("id"), F.lit(Rule(code, F.lit(True)).severity).alias("severity"), F.lit(code).alias("code"))


def unresolved(rows: DataFrame, refs: DataFrame, key: str, array: str, ref: str, code: str) -> DataFrame:
    """A finding for each reference of a row that refs lacks."""
    each = rows.select(F.col(key).cast("string").alias("id"), F.explode(array).alias(ref))
    return each.join(refs.select(ref).distinct(), ref, "left_anti").select("id", F.lit(Rule(code, F.lit(True)).severity).alias("severity"), F.lit(code).alias("code"))


def rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts of each severity, and the status that follows."""
    b, w = F.count_if(F.col("severity") == "blocker"), F.count_if(F.col("severity") == "warning")
    return findings.groupBy(*keys).agg(b.alias("blockers"), w.alias("warnings"), F.when(b > 0, "blocked").when(w > 0, "warning").otherwise("pass").alias("status"))


def admitted(rows: DataFrame, findings: DataFrame, group: str, key: str) -> DataFrame:
    """Rows of the groups without a blocker: one failure drops the whole group."""
    bad = rows.join(findings.where("severity = 'blocker'").select(F.col("id").alias(key)).distinct(), key).select(group).distinct()
    return rows.join(bad, group, "left_anti")


def heading_lint(line: Column) -> Column:
    """Reasons against a heading line, in order."""
    text = F.trim(line)
    reasons = [
        ("blank", text == ""), ("long", F.length(text) > 60), ("sentence", text.rlike("[.!?。！？]$")), ("numeric", text.rlike("^[0-9 .]+$")), ("unbalanced", F.regexp_count(text, F.lit("[(（]")) != F.regexp_count(text, F.lit("[)）]"))),
    ]
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in reasons]), lambda x: x.isNotNull()), ",")


def length_gate(original: Column, candidate: Column, least: float = 0.85) -> tuple[Column, Column]:
    """Ratio of the lengths, and whether it reaches least."""
    ratio = F.round(F.length(candidate) / F.greatest(F.length(original), F.lit(1)), 4)
    return ratio, ratio >= least

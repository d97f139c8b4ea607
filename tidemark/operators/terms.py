"""Terms written wrongly: a table of aliases by rule, their occurrences as intervals, replacement, and what is left over.

Rules are a cross product of terms and confusions: each confusion stands in a term where
its mark stands. A table of rules is a configuration, of as many rows as there are terms
times confusions, and each task holds it as an automaton; texts are streamed.

Occurrences are taken by rule, the longest first, and from the left, none over another;
one that overlaps a protected word is left as it is. Rules of the strict kind (a single confused
character) heed protected words; others do so only if told to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.documents import few_at_once

SPANS = "array<struct<alias: string, canonical: string, start: int, end: int, guarded: boolean>>"


def alias_rules(terms: DataFrame, confusions: DataFrame, overrides: DataFrame, mark: str) -> DataFrame:
    """(alias, canonical, strict, place): each term that has the mark and more, with each confusion instead of the mark. terms: (term),
    confusions: (confusion), overrides: (alias, canonical), which win. Longest first, then by code points. Of two terms with one alias the larger stands."""
    whole = terms.where(F.contains("term", F.lit(mark)) & (F.char_length("term") > 1)).select("term").distinct()
    made = whole.crossJoin(F.broadcast(confusions.select("confusion").distinct()))  # two small dimensions of a configuration
    made = made.select(F.replace("term", F.lit(mark), F.col("confusion")).alias("alias"), F.col("term").alias("canonical"), F.lit(0).alias("own"))
    both = made.unionByName(overrides.select("alias", "canonical", F.lit(1).alias("own"))).where("alias != canonical AND alias != ''")
    best = both.groupBy("alias").agg(F.max(F.struct("own", "canonical")).alias("b")).select("alias", F.col("b.canonical").alias("canonical"))
    one, many = (F.collect_set(F.when(c, F.col("confusion"))) for c in (F.char_length("confusion") == 1, F.char_length("confusion") > 1))
    sets = confusions.agg(one.alias("one"), many.alias("many"))  # one row
    holds = lambda name: F.exists(name, lambda c: F.contains(F.col("alias"), c))
    best = best.crossJoin(F.broadcast(sets)).withColumn("strict", holds("one") & ~holds("many")).drop("one", "many")
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.char_length("alias")), "alias")))


def chosen(found: list[tuple[int, int, int]], protected: list[tuple[int, int]], strict: list[bool], size: int) -> list[tuple[int, int, int, bool]]:
    """Of (start, end, rule) those to replace and those to leave: by rule, then from the left. One that a protected interval
    overlaps is left, if its rule is strict, and makes way for later rules inside it, but not for its own."""
    taken, inside, out = bytearray(size), bytearray(size), []
    for start, end in protected:
        inside[start:end] = b"\1" * (end - start)
    past: dict[int, int] = {}
    for start, end, rule in sorted(found, key=lambda x: (x[2], x[0])):
        if start < past.get(rule, 0) or any(taken[start:end]):
            continue
        past[rule] = end
        guarded = strict[rule] and any(inside[start:end])
        if not guarded:
            taken[start:end] = b"\1" * (end - start)
        out.append((start, end, rule, guarded))
    return sorted(out)


def occurrences(docs: DataFrame, key: str, text: str, rules: DataFrame, protected: DataFrame, guard_all: bool = False) -> DataFrame:
    """(key, spans, replaced): chosen occurrences of each text, as array of (alias, canonical, start from 0, end, guarded), and the
    text with the canonical term in place of each that is not guarded. protected: (word). Null texts are empty.

    guard_all: rules that are not strict heed protected words too, where the alias holds one of them.
    """
    table = [(r["alias"], r["canonical"], r["strict"]) for r in rules.orderBy("place").select("alias", "canonical", "strict").collect()]
    words = [r["word"] for r in protected.select("word").distinct().collect() if r["word"]]
    if guard_all:
        table = [(a, c, s or any(w in a for w in words)) for a, c, s in table]
    kind, strict = dict(docs.dtypes)[key], [s for _, _, s in table]
    span = pa.list_(pa.struct([("alias", pa.string()), ("canonical", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("guarded", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, (alias, _, _) in enumerate(table):
            automaton.add_word(alias, (len(alias), i, -1))
        for w in words:
            automaton.add_word(w, (len(w), automaton.get(w)[1] if w in automaton else -1, 0))
        if len(automaton):
            automaton.make_automaton()
        for batch in few_at_once(batches):
            out, texts = [], []
            for x in batch.column(1).to_pylist():
                found, held, x = [], [], x or ""
                for end, (n, rule, guards) in automaton.iter(x) if x and len(automaton) else ():
                    if rule >= 0:
                        found.append((end + 1 - n, end + 1, rule))
                    if guards >= 0:
                        held.append((end + 1 - n, end + 1))
                own, at, parts = chosen(found, held, strict, len(x)), 0, []
                for start, end, rule, guarded in own:
                    if not guarded:
                        parts += [x[at:start], table[rule][1]]
                        at = end
                out.append([{"alias": table[r][0], "canonical": table[r][1], "start": a, "end": b, "guarded": g} for a, b, r, g in own])
                texts.append("".join([*parts, x[at:]]))
            yield pa.record_batch([batch.column(0), pa.array(out, span), pa.array(texts, pa.string())], [key, "spans", "replaced"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, spans {SPANS}, replaced string")


def residuals(found: DataFrame) -> DataFrame:
    """(alias, canonical, documents, occurrences, guarded) over all texts: what a text that is to be published may not have, and what is let be."""
    rows = found.select(F.inline("spans")).groupBy("alias", "canonical").agg(F.count_if(~F.col("guarded")).alias("occurrences"), F.count_if("guarded").alias("guarded"))
    held = found.select(F.explode(F.expr("array_distinct(transform(filter(spans, x -> NOT x.guarded), x -> x.alias))")).alias("alias")).groupBy("alias").agg(F.count(F.lit(1)).alias("documents"))
    return rows.join(held, "alias", "left").select("alias", "canonical", F.coalesce("documents", F.lit(0)).alias("documents"), "occurrences", "guarded")


def pattern_residuals(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, rule, n): matches of each pattern, where there are any."""
    counts = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)).cast("long").alias("n")) for name, p in patterns.items()])
    return docs.select(key, F.inline(counts)).where("n > 0")

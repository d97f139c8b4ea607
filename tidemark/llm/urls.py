"""URL verdicts: rules first, then the log-likelihood ratio of two character models.

URLs that a rule allows or blocks are the labelled ones. A fifth of them, by hash, is
held out; the rest gives the counts of a variable-order Markov model for each verdict.
A character's chance interpolates all orders up to ORDER by Witten and Bell's weights,
so that a context that was never seen falls back to shorter ones. What decides on the
other URLs is the difference of the models' mean log-likelihood per character, against
the cutoff that parts the held-out URLs best (the mean of the two error rates is least).

The models read whole URLs, scheme, query and fragment included; only rules go by host and
path. All contexts count, however rare: the models are a written table with a row for each
verdict and context, summed in each task first. URLs are scored in chunks of about
CHUNK_BYTES, dealt by a hash; a chunk asks the table for its own contexts, each once, so
that neither the driver nor a task holds a model. The empty context and those of one ASCII
character, which all chunks ask for, are dealt over a salt for each SALT_CHUNKS chunks.

Defined results: a URL without "://" has an empty host and path and no rule, and is judged
by its text like any other; a null or empty one has a difference of 0 and is allowed; with
URLs of one verdict only, or none, the method allows; of cutoffs that part alike the middle
one is taken, in steps of 20 / BINS between -10 and 10; a URL at the cutoff is allowed;
repeated rows each give a row; an empty table gives none; other columns are ignored,
whatever their names. A very long URL is one row of one task, scored in time linear in it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_bytes, written

ORDER = 5
CHUNK_BYTES = 1 << 16
SALT_CHUNKS = 4096
BINS = 2000
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null. rules is a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def contexts(text: str, order: int = ORDER) -> Iterator[tuple[str, str]]:
    """(context, character) for every order; the text is led in by a mark and ended by one."""
    s = "\x02" + text + "\x03"
    for i in range(1, len(s)):
        for k in range(min(order, i) + 1):
            yield s[i - k : i], s[i]


def model_counts(labelled: DataFrame) -> DataFrame:
    """(verdict, context, next, n) over all rows of (verdict, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for verdict, text in zip(batch["verdict"], batch["text"], strict=True):
                seen.update((verdict, c, x) for c, x in contexts(text))
            if seen:
                yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["verdict", "context", "next", "n"])

    return labelled.select("verdict", "text").mapInPandas(run, "verdict string, context string, next string, n long").groupBy("verdict", "context", "next").agg(F.sum("n").alias("n"))


class MarkovModel:
    """context to (total, {character: count})."""

    def __init__(self, table: dict[str, tuple[int, dict[str, int]]], letters: int) -> None:
        self.table, self.letters = table, letters

    def mean_log(self, text: str) -> float:
        total, s = 0.0, "\x02" + text + "\x03"
        for i in range(1, len(s)):
            p = 1.0 / self.letters
            for k in range(min(ORDER, i) + 1):
                known = self.table.get(s[i - k : i])
                if known is None:
                    break
                kinds = len(known[1])
                p = (known[1].get(s[i], 0) + kinds * p) / (known[0] + kinds)
            total += np.log(p)
        return float(total / (len(s) - 1))


def train(labelled: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The models as a written table (verdict, context, total, letters, counts), and for each verdict its number of kinds of characters, plus one."""
    by = model_counts(labelled).groupBy("context", "verdict").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("next", "n"))).alias("by"))
    table = written(by.select("verdict", "context", "total", F.col("by.next").alias("letters"), F.col("by.n").alias("counts")))
    return table, {r["verdict"]: 1 + r["n"] for r in table.where("context = ''").select("verdict", F.size("letters").alias("n")).collect()}


def _asked(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distinct contexts of a chunk of texts."""
    asked = {c for t in set(pdf["text"]) for c, _ in contexts(t)}
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "context": list(asked)})


def _salted(asked: DataFrame, models: DataFrame, salts: int) -> DataFrame:
    """asked joined with models by context; the 129 contexts that every chunk has are dealt over salts rows each."""
    common = F.col("context").rlike(r"^\p{ASCII}?\z")
    ask = asked.withColumn("salt", F.when(common, F.pmod("chunk", F.lit(salts))).otherwise(0))
    known = models.withColumn("salt", F.explode(F.when(common, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return ask.join(known.withColumn("salt", F.col("salt").cast("long")), ["context", "salt"]).drop("salt")


def differences(df: DataFrame, models: DataFrame, letters: dict[str, int], chunk_bytes: int = CHUNK_BYTES, salt_chunks: int = SALT_CHUNKS) -> DataFrame:
    """df with diff: how much likelier the text is per character among allowed URLs. models and letters as train() gives them."""
    chunks = max(1, -(-text_bytes(df) // chunk_bytes))
    rows = written(df.withColumn("chunk", F.pmod(F.xxhash64(*df.columns), F.lit(chunks))))
    asked = rows.select("chunk", "text").groupBy("chunk").applyInPandas(_asked, "chunk long, context string")
    known = _salted(asked, models, 1 + chunks // salt_chunks).select("chunk", "verdict", "context", "total", "letters", "counts")
    schema = df.withColumn("diff", F.lit(0.0)).schema

    def score(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        tables: dict[str, dict] = {v: {} for v in letters}
        for verdict, context, total, xs, ns in zip(*(known[c] for c in ("verdict", "context", "total", "letters", "counts")), strict=True):
            tables[verdict][context] = (total, dict(zip(xs, ns, strict=True)))
        allow, block = (MarkovModel(tables[v], letters[v]) for v in ("allow", "block"))
        diff = [allow.mean_log(t) - block.mean_log(t) if t else 0.0 for t in texts["text"]]
        return texts.drop(columns="chunk").assign(diff=np.array(diff, float))

    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(score, schema)


def best_cutoff(held: DataFrame) -> float:
    """From BINS steps of the held-out differences: the one with the least mean error rate."""
    bins = held.select("verdict", F.floor(F.least(F.greatest("diff", F.lit(-10.0)), F.lit(10.0)) * (BINS / 20)).cast("int").alias("bin")).groupBy("verdict", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {v: np.zeros(BINS + 1) for v in ("allow", "block")}
    for r in bins:
        n[r["verdict"]][r["bin"] + BINS // 2] = r["n"]
    below = {v: np.concatenate([[0], np.cumsum(x)]) / max(1, x.sum()) for v, x in n.items()}
    error = below["allow"] + 1 - below["block"]
    least = np.flatnonzero(error <= error.min() + 1e-12)
    return float((least[len(least) // 2] - BINS // 2) * 20 / BINS)


def judge(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col(url).cast("string"))
    rows = df.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("by", longest_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("verdict"), "text")
    labelled = rows.where("verdict is not null").withColumn("held", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)
    models, letters = train(labelled.where("not held"))
    if len(letters) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    cutoff = best_cutoff(differences(labelled.where("held").select("page_id", "verdict", "text"), models, letters))
    scored = differences(rows.where("verdict is null").drop("verdict"), models, letters)
    own = F.when((F.col("text") == "") | (F.col("diff") >= cutoff), "allow").otherwise("block").alias("verdict")
    return rows.where("verdict is not null").select("page_id", "host", "path", "rule", "verdict").unionByName(scored.select("page_id", "host", "path", "rule", own))


def op7_markov_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))

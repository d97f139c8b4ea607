"""Phrases whose words stand together more often than by their parts: collocations of each language.

The n-grams of each length are rows, made and counted in chunks within tasks and then
summed by (lang, phrase). Lengths are taken in ascending order: an n-gram is as rare as
its rarest part, so one of which either part of n - 1 words is below the least count
cannot reach it and is not made. The parts are looked up in a bitmap of bounded size,
which may let through more n-grams than it must, never fewer; counts are of the words
themselves and exact. Each cut of a candidate then joins the counts of what stands before
and after it, scores are whole numbers from 38-digit decimals, phrases that a longer one
holds go by an anti join with the one-word extensions (what holds for an extension by
more words holds for one in between), and a window ranks each language.

Defined results: null text is empty, null lang is "und"; equal scores and counts are
ordered by the bytes of the phrase; repeated rows count each; very long texts are counted
whole, in a chunk of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bitmap import bitmap, in_bitmap
from tidemark.llm.pieces import gather
from tidemark.llm.shared import written
from tidemark.llm.words import Words, chunks, codes_between, mix, words

MIN_COUNT = 30
MAX_N = 4
TOP = 2000
#: text whose n-grams are counted together before they leave a task
COUNT_BYTES = 1 << 19
MOST_BITS = 1 << 29
ROWS = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = bytes([0x20, 0x09, *np.flatnonzero(_BREAK)])


def _lang_codes(langs: list[str]) -> np.ndarray:
    raw = [x.encode() for x in langs]
    at = np.cumsum([0, *map(len, raw)])
    return codes_between(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])


def _keys(w: Words, n: int, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code of the n words from each word on and their language, and whether they lie in one document."""
    code, fits = (w.code, np.ones(len(w.code), bool)) if n == 1 else w.windows(n)
    return mix(code ^ mix(lang + np.uint64(n))), fits


def count_grams(batches: Iterator[pa.RecordBatch], n: int, common: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of the n-grams of (lang, text), counted by chunks; common: the bitmap of parts of n - 1 words."""
    for batch, raw in chunks(batches, most=COUNT_BYTES):
        w = words([r.translate(_LOWER) for r in raw], _BETWEEN)
        langs = batch.column("lang")
        if not len(w.code):
            continue
        of, data = w.doc, np.frombuffer(w.buf, np.uint8)
        lang = _lang_codes(langs.to_pylist())[of]
        key, fits = _keys(w, n, lang)
        if n > 1:
            piece = np.cumsum(_BREAK[data])[w.start]
            fits[: len(fits) - n + 1] &= piece[: len(piece) - n + 1] == piece[n - 1 :]
        if common is not None:
            part = in_bitmap(common, _keys(w, n - 1, lang)[0])
            fits &= part
            fits[:-1] &= part[1:]
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        _, first, count = np.unique(key[at], return_index=True, return_counts=True)
        at = at[first]
        spaced = np.where(_BREAK[data] | (data == 0x09), np.uint8(0x20), data)
        row, ends = gather(spaced, w.start, w.end - w.start + 1, np.arange(len(w.start)))  # each word and one space
        for lo in range(0, len(at), ROWS):
            own = at[lo : lo + ROWS]
            flat, edge = gather(row, ends[:-1], ends[np.minimum(np.arange(len(w.start)) + n, len(w.start))] - 1 - ends[:-1], own)
            phrase = pa.StringArray.from_buffers(len(own), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)))
            yield pa.record_batch([langs.take(pa.array(of[own])), phrase, pa.array(count[lo : lo + ROWS].astype(np.int64))], ["lang", "phrase", "n"])


def _coded(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The codes of phrases of n words, as count_grams() has them."""
    for batch, raw in chunks(batches, "phrase"):
        w = words(raw, _BETWEEN)
        lang = _lang_codes(batch.column("lang").to_pylist())
        yield pa.record_batch([pa.array(_keys(w, n, lang[w.doc])[0][w.first[:-1]].astype(np.int64))], ["code"])


def phrase_counts(df: DataFrame, min_count: int = MIN_COUNT, max_n: int = MAX_N, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of up to max_n words that occur min_count times, and (lang, n) of all words."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    found, totals, held = None, None, None
    for n in range(1, max_n + 1):

        def run(batches: Iterator[pa.RecordBatch], n=n, held=held) -> Iterator[pa.RecordBatch]:
            return count_grams(batches, n, held.value if held else None)

        counts = docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if n == 1:
            counts = written(counts)
            totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
            counts = counts.where(F.col("n") >= min_count)
        else:
            counts = written(counts.where(F.col("n") >= min_count))
        own = counts.withColumn("words", F.lit(n))
        found = own if found is None else found.unionByName(own)
        if held:
            held.destroy()
        if n < max_n:
            codes = counts.select("lang", "phrase").mapInArrow(lambda b, n=n: _coded(b, n), "code long")
            held = spark.sparkContext.broadcast(bitmap(codes, "code", 32 * counts.count(), MOST_BITS))
    return found, totals


def collocations(df: DataFrame, min_count: int = MIN_COUNT, max_n: int = MAX_N, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """The top phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(df, min_count, max_n, text, lang)
    cuts = (
        counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
        .withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, char_length(first) + 2)"))
    )
    before = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    after = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = written(cuts.join(before, ["lang", "first"]).join(after, ["lang", "rest"]))
    exact = lambda x: f"cast({x} AS decimal(38, 0))"
    best = cuts.withColumn("score", F.expr(f"(2000000 * {exact('a')}) div ({exact('l')} + {exact('r')})")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    held = [cuts.where(f"words > 2 AND k = {k} AND 100 * {exact('a')} >= 80 * {exact(n)}").select("lang", F.col(part).alias("phrase")) for part, k, n in (("first", "words - 1", "l"), ("rest", "1", "r"))]
    free = best.join(held[0].unionByName(held[1]).distinct(), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "best.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = free.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))

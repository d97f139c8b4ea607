"""Words grouped by spelling: each word's neighbours at one edit, the form it most likely is of, and the root of forms.

Of two words one edit apart, the shorter with m letters, the edit lies in the first
floor(m / 2) letters of the shorter or after them, so the other half stands in both. A
forward dictionary holds each word under its first half and a reversed one under its last
half turned round; a word may be the shorter or the longer of a pair, so it is in both
for its own m and for one less. The dictionaries are sorted by ranges, and a scan
compares the words of each block.

A block of over BLOCK words is subdivided by where the edit is: words that agree but for
one letter at one place meet under what is left of them, and a word meets the longer
words that become it by leaving out one letter. Such blocks hold as many words as there
are letters, or one star around the shorter word, and never all pairs. Which blocks are
large is counted before any rows meet, and known by a bitmap of bounded size; a block
that it takes for large by mistake is subdivided as well, which gives the same pairs.

Words consist of letters of one byte in Latin-1, which is what the scan compares.

Defined results: null text has no words; a null doc_id counts as an empty one; of equally
frequent neighbours the smallest in code-point order is the form; repeated rows count
each; very long runs are words like others; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bitmap import bitmap, in_bitmap
from tidemark.llm.shared import texts, written
from tidemark.llm.words import release

MIN_LETTERS = 6
MIN_COUNT = 5
#: a form is so many times as frequent as the word
FACTOR = 5
SPOILT = 199
BLOCK = 64
MOST_BITS = 1 << 29
#: rows, and letters with their padding, that a scan holds
SCAN_ROWS = 8192
SCAN_LETTERS = 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIRS = "word string, near string, near_n long"


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", spoilt: int = SPOILT, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of enough letters and occurrences, a share of one in spoilt with a letter left out."""
    runs = texts(df, key, text).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{min_letters},}}"), F.lit(0))).alias("run"),
    )
    runs = runs.withColumn("h", F.expr("crc32(concat(id, ':', run))"))
    without = F.expr("concat(substring(run, 1, cast(h % char_length(run) AS int)), substring(run, cast(h % char_length(run) AS int) + 2))")
    words = runs.select(F.when(F.col("h") % spoilt == 0, without).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def halves(words: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n, side, m, half, code): the places of each word in the forward and the reversed dictionary."""
    m = "filter(array(char_length(word), char_length(word) - 1), x -> x >= %d)" % min_letters
    places = f"""flatten(transform({m}, m -> array(
        named_struct('side', 'forward', 'm', m, 'half', substring(word, 1, m div 2)),
        named_struct('side', 'reversed', 'm', m, 'half', reverse(right(word, m - m div 2))))))"""
    rows = words.select("word", "n", F.explode(F.expr(places)).alias("p")).select("word", "n", F.col("p.side"), F.col("p.m").cast("int").alias("m"), F.col("p.half"))
    return rows.withColumn("code", F.xxhash64("side", "m", "half"))


def subdivided(rows: DataFrame) -> DataFrame:
    """(word, n, side, m, half, centre): rows of large blocks by where the edit is. A star has its centre under 'inserted'."""
    low, high = "IF(side = 'forward', m div 2, 0)", "IF(side = 'forward', m, m div 2)"
    cut = "concat(substring(word, 1, p), substring(word, p + 2))"
    replaced = f"IF(char_length(word) = m, transform(sequence({low}, {high} - 1), p -> named_struct('side', concat('replaced ', p), 'half', {cut}, 'centre', false)), array())"
    inserted = f"IF(char_length(word) = m, array(named_struct('side', 'inserted', 'half', word, 'centre', true)), transform(sequence({low}, {high}), p -> named_struct('side', 'inserted', 'half', {cut}, 'centre', false)))"
    out = rows.select("word", "n", "m", F.explode(F.expr(f"concat({replaced}, {inserted})")).alias("p"))
    return out.select("word", "n", F.col("p.side"), "m", F.col("p.half"), F.col("p.centre"))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters from the left, letters from the right, padded with 0, and lengths."""
    raw = [w.encode("latin-1") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    row, at = np.repeat(np.arange(len(raw)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    left, right = np.zeros((2, len(raw), int(size.max(initial=0))), np.uint8)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    left[row, at] = flat
    right[row, np.repeat(size, size) - 1 - at] = flat
    return left, right, size


def one_edit_apart(left: np.ndarray, right: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i], which differ, do so by one edit: what they share from either end leaves no more."""
    shared = (left[a] != left[b]).argmax(axis=1) + (right[a] != right[b]).argmax(axis=1)
    short, gap = np.minimum(size[a], size[b]), np.abs(size[a] - size[b])
    return (gap <= 1) & (shared >= short - (gap == 0))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words from rows (side, m, half, word, n, centre) sorted by block and word, in both directions."""
    rows: list[tuple] = []
    widest = 0

    def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        word = [r[3] for r in rows]
        block = np.cumsum([i > 0 and rows[i][:3] != rows[i - 1][:3] for i in range(len(rows))])
        left, right, size = _letters(word)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stars = np.array([r[0] == "inserted" for r in rows])
        centre = np.flatnonzero([r[5] for r in rows])
        if len(centre):
            of = np.full(int(block[-1]) + 1, -1)
            of[block[centre]] = centre
            other = np.flatnonzero(stars & (of[block] >= 0) & (of[block] != np.arange(len(rows))))
            found.append((of[block[other]], other))
        clique = np.flatnonzero(~stars)
        for d in range(1, len(clique)):
            a, b = clique[:-d], clique[d:]
            same = block[a] == block[b]
            if not same.any():
                break
            found.append((a[same], b[same]))
        step = max(1, SCAN_LETTERS // max(1, left.shape[1]))
        for a, b in found:
            for lo in range(0, len(a), step):
                x, y = a[lo : lo + step], b[lo : lo + step]
                near = one_edit_apart(left, right, size, x, y)
                x, y = x[near].tolist(), y[near].tolist()
                if x:
                    i, j = x + y, y + x
                    yield pa.record_batch([pa.array([word[k] for k in i]), pa.array([word[k] for k in j]), pa.array([rows[k][4] for k in j], pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = not rows or row[:3] != rows[-1][:3]
            if new and (len(rows) >= SCAN_ROWS or len(rows) * widest > SCAN_LETTERS):
                yield from pairs(rows)
                rows, widest = [], 0
            if new or row[3] != rows[-1][3]:  # a word may come to a block twice
                rows.append(row)
                widest = max(widest, len(row[3]))
    if rows:
        yield from pairs(rows)
    release()


def near_words(words: DataFrame, block: int = BLOCK, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, near, near_n) of all pairs of words one edit apart, in both directions. words: (word, n), each word once."""
    places = halves(words, min_letters)
    large = written(places.groupBy("code").count().where(F.col("count") > block).select("code"))
    bits = words.sparkSession.sparkContext.broadcast(bitmap(large, "code", 32 * large.count(), MOST_BITS))

    @F.pandas_udf("boolean")
    def is_large(code: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, code.to_numpy(np.int64)))

    marked = written(places.withColumn("large", is_large("code")))
    small = marked.where("NOT large").select("side", "m", "half", "word", "n", F.lit(False).alias("centre"))
    rows = small.unionByName(subdivided(marked.where("large")).select(*small.columns))
    order = ["side", "m", "half"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "word").mapInArrow(scan, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. A form is more frequent than its word, so no chain is a ring."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = written(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_groups(words: DataFrame, factor: int = FACTOR, block: int = BLOCK, min_letters: int = MIN_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    words = written(words)
    pairs = near_words(words, block, min_letters).repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    likely = -F.col("best.less") >= factor * F.col("n")
    found = written(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.near")).alias("form"), F.when(likely, -F.col("best.less")).alias("form_n")
        )
    )
    led = roots(written(found.where("form IS NOT NULL").select("word", "form")))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")))

"""Benchmark passages in documents: a prefix-filtered set join with exact verification.

The sets are the shingles of item windows. A document can only hold a window if it holds
all its shingles, so one is enough as the necessary prefix. The steps:

1.  The benchmark becomes a table of distinct windows with their shingles.
2.  One pass over the documents counts those shingles (summed in each task first); a
    window's prefix is its rarest shingle. A window whose rarest is nowhere cannot occur.
3.  A second pass reports the places of prefixes, with the words around. They are joined
    to the prefixes. A prefix's place in its window says where the window would start: it
    must lie within the document (length and positional bounds), and then its words are
    compared.
4.  The spans of hit words are counted for each document, and its items listed.

Both passes are two for a benchmark of any size. What is broadcast are bitmaps over
shingles and over documents with hits, of MOST_BITS at most: a full one only lets more
rows through to the joins.

Defined results: null, empty and wordless texts have no words and no hits; items without
words or id match nothing; items with one id count once; repeated rows each give a row;
a null key is kept; empty tables give no rows, or no hits; other columns pass, but for
columns named n_words, n_hit, n_items, items or contaminated, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bitmap import bitmap, in_bitmap
from tidemark.llm.shared import written
from tidemark.llm.words import NOT_ALNUM, Words, chunks, words

WINDOW = 10
SHINGLE = 3
MOST_BITS = 1 << 29


def _parsed(raw: list[bytes]) -> Words:
    return words(raw, NOT_ALNUM, fold=True)


def _own(w: Words, a: int, b: int) -> str:
    return b" ".join([w.text(i) for i in range(a, b)]).lower().decode()


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, words, n, codes) of (item, text): each window's words joined by a space, and its shingles' codes by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches):
            w, names = _parsed(raw), batch.column("item").to_pylist()
            codes = {k: w.windows(k)[0].view(np.int64) for k in range(1, shingle + 1)}
            for item, a, b in zip(names, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                n = min(window, b - a)
                k = min(shingle, n)
                at = range(a, b - n + 1) if n else ()
                if at:
                    yield pa.record_batch([pa.array([item] * len(at)), pa.array([_own(w, i, i + n) for i in at]), pa.array([n] * len(at), pa.int32()), pa.array([codes[k][i : i + n - k + 1].tolist() for i in at], pa.list_(pa.int64()))], ["item", "words", "n", "codes"])

    return items.mapInArrow(run, "item string, words string, n int, codes array<long>")


def _bits(keys: DataFrame, column: str):
    """A broadcast bitmap over the distinct values of column."""
    keys = keys.select(column).distinct()
    return keys.sparkSession.sparkContext.broadcast(bitmap(keys, column, 64 * keys.count(), MOST_BITS))


def shingle_counts(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """(code, seen): how often the documents have each shingle of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in chunks(batches):
            w = _parsed(raw)
            for k in sizes:
                code, inside = w.windows(k)
                code = code.view(np.int64)
                code, n = np.unique(code[inside & in_bitmap(bits.value, code)], return_counts=True)
                yield pa.record_batch([pa.array(code), pa.array(n)], ["code", "seen"])

    return docs.select("text").mapInArrow(run, "code long, seen long").groupBy("code").agg(F.sum("seen").alias("seen"))


def prefix_places(docs: DataFrame, bits, sizes: list[int], window: int) -> DataFrame:
    """(row, code, at, before, around): each place of a prefix, the words around it, and how many of them come before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches):
            w, row = _parsed(raw), np.asarray(batch.column("row"))
            doc = w.doc
            for k in sizes:
                code, inside = w.windows(k)
                code = code.view(np.int64)
                pos = np.flatnonzero(inside & in_bitmap(bits.value, code))
                home = doc[pos]
                a, b = np.maximum(pos - window + k, w.first[home]), np.minimum(pos + window, w.first[home + 1])
                around = [_own(w, x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                yield pa.record_batch([pa.array(row[home]), pa.array(code[pos]), pa.array((pos - w.first[home]).astype(np.int32)), pa.array((pos - a).astype(np.int32)), pa.array(around, pa.string())], ["row", "code", "at", "before", "around"])

    return docs.mapInArrow(run, "row long, code long, at int, before int, around string")


def found_windows(docs: DataFrame, windows: DataFrame, window: int, shingle: int) -> DataFrame:
    """(row, start, n, words): every place where a document (row, text) has a window's words."""
    sizes = sorted(r["k"] for r in windows.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect())  # shingle values at most
    distinct = written(windows.select("words", "n", "codes").distinct())
    shingles = distinct.select("words", "n", F.posexplode("codes").alias("place", "code"))
    counts = shingle_counts(docs, _bits(shingles, "code"), sizes)
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "place", "code")).alias("p")
    prefixes = written(shingles.join(counts, "code", "left").groupBy("words", "n").agg(rarest).where("p.seen > 0").select("words", "n", "p.place", "p.code"))
    places = prefix_places(docs, _bits(prefixes, "code"), sizes, window).join(prefixes, "code").where("before >= place")
    own = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("place") + 1, F.col("n")), " ")
    return places.where(own == F.col("words")).select("row", (F.col("at") - F.col("place")).alias("start"), "n", "words").distinct()


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """df with n_words, n_hit, n_items, items (sorted as strings) and contaminated."""
    df = df.drop("n_words", "n_hit", "n_items", "items", "contaminated", "_row")
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).dropna()
    windows = written(item_windows(items, window, shingle).distinct())
    marked = df.withColumn("_row", F.xxhash64(*df.columns))  # equal rows fare alike
    hits = written(found_windows(marked.select(F.col("_row").alias("row"), F.col(text).cast("string").alias("text")), windows, window, shingle))
    # spans in order; each adds the words beyond the end of those before
    covered = F.expr("aggregate(array_sort(collect_set(struct(start, start + n AS stop))), struct(0 AS stop, 0L AS n), (a, s) -> struct(greatest(a.stop, s.stop) AS stop, a.n + greatest(0, s.stop - greatest(a.stop, s.start)) AS n), a -> a.n)")
    spans = hits.groupBy("row").agg(covered.alias("n_hit"))
    named = hits.select("row", "words").distinct().join(windows.select("words", "item").distinct(), "words").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = written(spans.join(named, "row").withColumnRenamed("row", "_row"))
    bits = _bits(found, "_row")
    schema = T.StructType([*marked.schema.fields, T.StructField("n_words", T.LongType())])

    @F.pandas_udf("boolean")
    def hit(rows: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, rows.to_numpy(np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches, text):
            yield pa.record_batch([*batch.columns, pa.array(np.diff(_parsed(raw).first), pa.int64())], schema.names)

    def cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count(b.filter(pa.array(~in_bitmap(bits.value, np.asarray(b.column("_row"))))) for b in batches)

    # rows that the bitmap clears stay where they are; each step in Python has a task of its own, as every further one in a task is a worker more
    clear = marked.mapInArrow(cleared, schema).withColumns({"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")})
    rest = marked.where(hit("_row")).repartition("_row").mapInArrow(count, schema).join(found, "_row", "left")
    rest = rest.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    out = clear.unionByName(rest).drop("_row")
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def op6_prefix_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs.select("doc_id", "text"), bench)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


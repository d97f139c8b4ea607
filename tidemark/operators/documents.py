"""Documents as lines, sections and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line, offset): offset is where the line starts in characters."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("i", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(key, (F.col("i") + 1).alias("line_no"), "line", F.coalesce(before, F.lit(0)).alias("offset"))


def sections(rows: DataFrame, key: str, heading: Column) -> DataFrame:
    """Lines (line_no, line) cut before each heading: (key, section from 0, title, n_lines, characters)."""
    number = F.sum(heading.cast("int")).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("section", number)
    return marked.groupBy(key, "section").agg(F.min_by("line", "line_no").alias("title"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("characters"))


def outside_fences(rows: DataFrame, key: str, fence: str = "```") -> DataFrame:
    """Lines with whether a code fence is open at them; the lines of a fence itself are inside."""
    is_fence = F.col("line").startswith(fence)
    seen = F.sum(is_fence.cast("int")).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("outside", (seen % 2 == 0) & ~is_fence)


def chunk(text: str, most: int) -> list[str]:
    """Cuts at the last paragraph, sentence or word end past half of most; what is joined again is the text."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        for mark in ("\n\n", "\n", "。", ". ", " "):
            cut = text.rfind(mark, at + most // 2, end)
            if cut >= 0:
                end = cut + len(mark)
                break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if text[at:] or not out else out


def few_at_once(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of so many texts: what a task makes of them is held for these only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, part from 1, parts, chunk). Cutting is sequential in a text, so it runs in Arrow batches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_once(batches):
            cut = [chunk(t or "", most) for t in batch.column(1).to_pylist()]
            row, part, parts, found = (pa.array(x, t) for x, t in zip(zip(*[(r, i + 1, len(cs), c) for r, cs in enumerate(cut) for i, c in enumerate(cs)], strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True))
            yield pa.record_batch([batch.column(0).take(row), part, parts, found], [key, "part", "parts", "chunk"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, part int, parts int, chunk string")


def pages(rows: DataFrame, group: str, order: str, size: str, most: int, overhead: int = 80) -> DataFrame:
    """Page of each row: rows fill a page in order until the next would pass most; a larger row has a page of its own.

    A group is streamed in sorted batches with the page and its fill as the only state, so that its size is not bound by memory.
    """
    rows = rows.select(group, order, size)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, page, used = object(), 1, 0
        for batch in batches:
            out = []
            for g, n in zip(batch[group], batch[size] + overhead, strict=True):
                if g != last:
                    last, page, used = g, 1, 0
                if used and used + n > most:
                    page, used = page + 1, 0
                used += n
                out.append(page)
            yield batch.assign(page=out)

    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(fill, rows.withColumn("page", F.lit(1)).schema)


def set_hash(rows: DataFrame, group: str, order: str, text: str, width: int = 1 << 12) -> DataFrame:
    """(group, set_sha256): of the texts in order. Ranges of width orders are hashed first, then ranges of ranges, then these, so that no task holds a group."""
    part = lambda: F.concat_ws(":", F.col("at").cast("string"), "h")
    own = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", part().alias("p")))), lambda x: x["p"]), ";"), 256)
    out = rows.select(group, F.col(order).cast("long").alias("at"), F.sha2(F.col(text), 256).alias("h"))
    for _ in range(2):
        out = out.groupBy(group, F.floor(F.col("at") / width).alias("range")).agg(own().alias("h")).withColumnRenamed("range", "at")
    return out.groupBy(group).agg(own().alias("set_sha256"))

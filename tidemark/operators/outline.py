"""Checks of outlines and their pages, numbering within groups, and pairs of tables that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORT_PAGE, LONG_PAGE = 300, 30_000
ROWS_PER_TASK = 500_000


def page_findings(pages: DataFrame, last_lines: DataFrame) -> DataFrame:
    """(book_id, page, code) over pages (book_id, page, order, start, end, chars) of inclusive lines; last_lines (book_id, last).

    One window of a book's pages gives order gaps, line gaps and overlaps; sizes and ranges are predicates of a page.
    """
    by = Window.partitionBy("book_id").orderBy("order", "page")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumns({"covered": F.max("end").over(before), "previous": F.lag("order").over(by)})
    found = {
        "page_range": F.col("end") < F.col("start"), "page_order_gap": F.col("order") > F.coalesce("previous", F.lit(0)) + 1, "page_duplicate": F.col("order") == F.col("previous"),
        "source_gap": F.col("start") > F.coalesce("covered", F.lit(0)) + 1, "source_overlap": F.col("start") <= F.col("covered"),
        "short_page": F.col("chars") < SHORT_PAGE, "long_page": F.col("chars") > LONG_PAGE,
    }
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in found.items()]))
    tail = pages.groupBy("book_id").agg(F.max("end").alias("end")).join(last_lines, "book_id").where(F.col("end") < F.col("last"))
    return rows.select("book_id", "page", F.explode(codes).alias("code")).unionByName(tail.select("book_id", F.lit(None).cast("long").alias("page"), F.lit("source_tail").alias("code")))


def without_pages(chapters: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    return chapters.join(pages.select(key), key, "left_anti")


def numbering(df: DataFrame, group: str, number: str, tie: str) -> DataFrame:
    """(tie, code): numbers of a group that come twice, skip one, or do not begin with 1."""
    by = Window.partitionBy(group).orderBy(F.asc_nulls_last(number), F.asc_nulls_last(tie))
    before = F.lag(number).over(by)
    code = F.when(before.isNull() & (F.col(number) != 1), "first_number").when(F.col(number) == before, "order_duplicate").when(F.col(number) > before + 1, "number_gap")
    return df.select(group, tie, code.alias("code")).where("code is not null")


def renumbered(df: DataFrame, group: str, order: str, kept: Column) -> DataFrame:
    """Kept rows with number, their new place in the group, and twin, the place among rows of one title."""
    by = Window.partitionBy(group).orderBy(order)
    return df.where(kept).withColumns({"number": F.row_number().over(by), "twin": F.row_number().over(Window.partitionBy(group, "title").orderBy(order))})


def group_starts(df: DataFrame, key: str, group: str, order: str, own: str, marker: str) -> DataFrame:
    """df with start: the group's own start on the first row of each run of a group, else the marker."""
    new = ~F.lag(group).over(Window.partitionBy(key).orderBy(order)).eqNullSafe(F.col(group))
    return df.withColumn("start", F.when(new, F.col(own)).otherwise(F.col(marker)))


def set_differences(declared: DataFrame, found: DataFrame, group: str, name: str) -> DataFrame:
    """Per group: names only declared and only found; groups that agree are left out.

    Names are met in tasks of so many rows, whatever the size of the tables; those of both sides go before groups are put together.
    """
    side = lambda df, bit: df.select(group, name, F.lit(bit).alias("side"))
    both = side(declared, 1).unionByName(side(found, 2))
    tasks = max(both.sparkSession.sparkContext.defaultParallelism, -(-both.count() // ROWS_PER_TASK))
    one = both.repartition(tasks, group, name).groupBy(group, name).agg(F.bit_or("side").alias("side")).where("side < 3")
    return one.groupBy(group).agg(F.count_if(F.col("side") == 1).alias("only_declared"), F.count_if(F.col("side") == 2).alias("only_found"))


def paired(prompts: DataFrame, references: DataFrame) -> DataFrame:
    """prompts (key) with the reference (key, content) of key-analysis, else of the key without -subjective, else of the next section sNN.

    The three keys are stacked, so that one join serves all; the first of them that is there wins.
    """
    number = F.regexp_extract("key", r"\.s(\d+)$", 1)
    after = F.when(number != "", F.concat(F.regexp_replace("key", r"\d+$", ""), F.lpad((number.cast("int") + 1).cast("string"), 2, "0")))
    keys = F.array(F.concat("key", F.lit("-analysis")), F.when(F.endswith("key", F.lit("-subjective")), F.regexp_replace("key", "-subjective$", "")), after)
    asked = prompts.select("key", F.posexplode(keys).alias("rank", "wanted")).where("wanted is not null")
    met = asked.join(references.withColumnRenamed("key", "wanted"), "wanted").groupBy("key").agg(F.min_by("wanted", "rank").alias("reference"), F.min_by("content", "rank").alias("content"))
    return prompts.join(met, "key", "left")


def companions(banks: DataFrame, books: DataFrame, aggregate: str, first: int, last: int) -> DataFrame:
    """banks (bank_id, year, paper) with the book of that year and paper, else the aggregate one for years first to last, else null."""
    out = banks.join(books.select("year", "paper", "book_id"), ["year", "paper"], "left")
    return out.withColumn("book_id", F.coalesce("book_id", F.when(F.col("year").between(first, last), aggregate)))


def drifted(existing: DataFrame, planned: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ids that the plan has neither by themselves nor by what their alias ends in. aliases (legacy_id, canonical_id)."""
    ends = existing.join(aliases.withColumnRenamed("legacy_id", "id"), "id", "left").select("id", F.coalesce("canonical_id", "id").alias("end"))
    return ends.join(planned.select(F.col("id").alias("end")), "end", "left_anti").select("id")


def alias_sets(resolved: DataFrame) -> DataFrame:
    """(canonical_id, ids): itself and all that lead to it, sorted. resolved (legacy_id, canonical_id), nulls are of no set."""
    return resolved.where("canonical_id is not null").groupBy("canonical_id").agg(F.array_sort(F.array_union(F.collect_set("legacy_id"), F.array(F.first("canonical_id")))).alias("ids"))


def ids_by_page(entries: DataFrame) -> DataFrame:
    """(page_id, ids) of entries (id, pages): the inverted index."""
    return entries.select("id", F.explode("pages").alias("page_id")).groupBy("page_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def context_labels(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """questions (question_id, bank_id, subject) with the first non-blank label (bank_id, pos, label) of their bank, else its subject, else its id."""
    first = labels.where(F.trim("label") != "").groupBy("bank_id").agg(F.min_by("label", "pos").alias("label"))
    out = questions.join(first, "bank_id", "left")
    return out.withColumn("label", F.coalesce("label", F.nullif(F.trim("subject"), F.lit("")), "bank_id"))

"""Outlines of sections by fallback tiers, repair of headings cut in two, carving of pages, ids in order of entry, signatures of sets, chunks of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fences of code, headings, the two tiers that go before heading levels, titles that are no part of an outline, and what headings are compared without.
FENCE, HEADING = "```", r"^(#{1,6})\s+(.+?)\s*#*\s*$"
POINT, MAJOR = r"(?i)^考点\s*\d+", r"^[一二三四五六七八九十百]+[、.．]\s*"
NO_PART = r"^第[一二三四五六七八九十百零〇\d]+章|^>{0,2}\s*导言$"
KEY_DROPPED = r"(?U)[*_`~#\s·•:,。.!?()\[\]【】]+"
CHUNK_RANGE = r"pages-(\d+)-(\d+)"


def heading_key(title: Column) -> Column:
    """A heading in lower case without what KEY_DROPPED has, for comparison; full-width characters count as plain ones."""
    wide, plain = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    return F.lower(F.regexp_replace(F.translate(F.coalesce(title, F.lit("")), wide, plain), KEY_DROPPED, ""))


def section_guides(rows: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """(key, line_no, level, title, tier): the outline of each text of lines (key, line_no, line). titles: (key, title) of the whole texts.

    What comes before the first heading that is the text's own title is no part of it. Of the headings, points are taken where there are
    two, else major ones where there are two, else those of the shallowest level where there are two headings; of equal ones the first.
    Lines in code fences are no headings.
    """
    is_fence = F.col("line").startswith(FENCE)
    some = rows.where(F.col(key).isNotNull() & (is_fence | F.col("line").rlike(HEADING)))  # the only lines that are shuffled
    some = some.select(key, "line_no", is_fence.alias("fence"), F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.trim(F.regexp_extract("line", HEADING, 2)).alias("title"))
    some = some.select("*", heading_key(F.col("title")).alias("same"), F.col("title").rlike(NO_PART).alias("no_part"), F.col("title").rlike(POINT).alias("point"), F.col("title").rlike(MAJOR).alias("major"))
    some = some.withColumn("title", F.when(~F.col("no_part"), F.col("title")))
    named = titles.where(F.col(key).isNotNull()).select(key, heading_key(F.col("title")).alias("own"))  # these rows have no line_no, so they come first
    whole, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    h = some.unionByName(named, allowMissingColumns=True).select("*", F.first("own").over(upto).alias("name"), F.count_if("fence").over(upto).alias("fences")).where("line_no IS NOT NULL AND NOT fence AND fences % 2 = 0")
    h = h.withColumn("begin", F.min(F.when(F.col("same") == F.col("name"), F.col("line_no"))).over(whole)).where("(begin IS NULL OR line_no > begin) AND NOT no_part AND title != '' AND same IS DISTINCT FROM name")
    counts = F.count_if("point").over(whole), F.count_if("major").over(whole), F.count(F.lit(1)).over(whole)
    h = h.select(key, "line_no", "level", "title", "same", "point", "major", *[c.alias(n) for c, n in zip(counts, ("points", "majors", "all"), strict=True)], F.min("level").over(whole).alias("shallowest"))
    tier = F.when(F.col("points") >= 2, "point").when(F.col("majors") >= 2, "major").when(F.col("all") >= 2, "level")
    chosen = h.withColumn("tier", tier).where("(tier = 'point' AND point) OR (tier = 'major' AND major) OR (tier = 'level' AND level = shallowest)")
    first = chosen.where("same != ''").groupBy(key, "tier", "same").agg(F.min(F.struct("line_no", "level", "title")).alias("h"))
    return first.select(key, "h.line_no", "h.level", "h.title", "tier")


def heading_repairs(rows: DataFrame, page: str, head: str, tail: str) -> DataFrame:
    """(page, line_no, old, new): what to put in lines (page, line_no, line) so that paragraphs are numbered within each page.

    A paragraph's heading is head, number and tail; one cut in two is a line head and, after blank lines at most, a line tail. The
    second of such a pair becomes empty. Headings whose number is missing or another one get theirs.
    """
    text = rows.select(page, "line_no", F.trim("line").alias("old")).where("old != ''")
    own = Window.partitionBy(page).orderBy("line_no")
    hashes, name = head.split(" ", 1)
    pattern = rf"^{hashes}\s*(?:{name}\s*)?(\d+)?\s*{tail.split(' ', 1)[1]}\s*$"
    first = (F.col("old") == head) & (F.lead("old").over(own) == tail)
    second = (F.col("old") == tail) & (F.lag("old").over(own) == head)
    marked = text.withColumn("second", F.coalesce(second, F.lit(False))).withColumn("heads", F.coalesce(first, F.lit(False)) | (F.col("old").rlike(pattern) & ~F.coalesce(second, F.lit(False))))
    number = F.count_if("heads").over(own.rowsBetween(Window.unboundedPreceding, 0))
    new = F.when(F.col("second"), "").otherwise(F.concat(F.lit(head), number.cast("string"), F.lit(tail.split(" ", 1)[1])))
    return marked.withColumn("new", new).where("(second OR heads) AND old != new").select(page, "line_no", "old", "new")


def carved(pages: DataFrame, cuts: DataFrame, book: str) -> DataFrame:
    """pages (book, start, end, role) with each cut (book, cut_start, cut_end) a reference page of its own, and order anew by start.

    A cut lies in one page; what is left of that page before and after it keeps its role.
    """
    inside = (F.col("cut_start") >= F.col("start")) & (F.col("cut_end") <= F.col("end"))
    hit = pages.join(cuts, book).where(inside).select(book, "start", "end", "role", "cut_start", "cut_end")
    parts = F.array(
        F.struct(F.col("start").alias("s"), (F.col("cut_start") - 1).alias("e"), F.col("role").alias("r")), F.struct(F.col("cut_start").alias("s"), F.col("cut_end").alias("e"), F.lit("reference").alias("r")),
        F.struct((F.col("cut_end") + 1).alias("s"), F.col("end").alias("e"), F.col("role").alias("r")),
    )
    split = hit.select(book, F.inline(parts)).where("s <= e").select(book, F.col("s").alias("start"), F.col("e").alias("end"), F.col("r").alias("role"))
    whole = pages.join(hit.select(book, "start").distinct(), [book, "start"], "left_anti").select(book, "start", "end", "role")
    return whole.unionByName(split).withColumn("order", F.row_number().over(Window.partitionBy(book).orderBy("start")))


def attached_ids(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """sections (section_id, ...) with the ids of the entries (place, id, page_ids) that name them, in order of entry and as often as named."""
    rows = entries.select("place", "id", F.posexplode("page_ids").alias("i", "section_id"))
    listed = rows.groupBy("section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "i", "id"))), lambda x: x["id"]).alias("knowledge_ids"))
    return sections.join(listed, "section_id", "left").withColumn("knowledge_ids", F.coalesce("knowledge_ids", F.array().cast("array<string>")))


def signature(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(signature, n) of a set of rows, whatever their order: a hash of the hashes of 4,096 shares, each over its sorted rows. Nulls count as empty."""
    line = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    joined = lambda of, by: F.sha2(F.array_join(F.array_sort(F.collect_list(of)), by), 256)
    shares = rows.select(line.alias("line")).groupBy(F.substring(F.sha2("line", 256), 1, 3).alias("share")).agg(joined(F.col("line"), "\n").alias("h"), F.count(F.lit(1)).alias("n"))
    return shares.agg(joined(F.concat_ws(":", "share", "h"), "\n").alias("signature"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def chunk_files(spark: SparkSession, root: str) -> DataFrame:
    """(book, first, last, path, text) of the Markdown files in folders pages-A-B under root; book is the folder above."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    part = lambda i: F.regexp_extract("path", f"/([^/]*)/{CHUNK_RANGE}/", i)
    return files.where(part(2) != "").select(part(1).alias("book"), part(2).cast("long").alias("first"), part(3).cast("long").alias("last"), "path", "text")


def chunk_findings(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """(book, first, code): chunk_twin, range_backwards, range_gap, range_overlap of chunks (book, first, last), and page_total where they do not end with the total (book, pages)."""
    ranges = chunks.groupBy("book", "first", "last").agg(F.count(F.lit(1)).alias("files"))
    own = Window.partitionBy("book").orderBy("first", "last")
    due = F.coalesce(F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(0))
    seen = ranges.withColumn("due", due)
    codes = F.array_compact(F.array(F.when(F.col("files") > 1, "chunk_twin"), F.when(F.col("last") < F.col("first"), "range_backwards"), F.when(F.col("first") > F.col("due"), "range_gap"), F.when(F.col("first") < F.col("due"), "range_overlap")))
    ends = totals.join(ranges.groupBy("book").agg((F.max("last") + 1).alias("past")), "book", "left").where("past IS DISTINCT FROM pages")
    return seen.select("book", "first", F.explode(codes).alias("code")).unionByName(ends.select("book", F.lit(None).cast("long").alias("first"), F.lit("page_total").alias("code")))


def assembled(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """(book, place, text, offset) of books without findings: each chunk under a comment that names its pages from 1, and where it starts in the whole."""
    own = Window.partitionBy("book").orderBy("first")
    body = F.regexp_replace(F.regexp_replace(F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", ""), F.lit("\r\n"), F.lit("\n")), r"^\s+", ""), r"\s+$", "")
    head = F.concat(F.lit("<!-- source-pdf-pages: "), (F.col("first") + 1).cast("string"), F.lit("-"), (F.col("last") + 1).cast("string"), F.lit(" -->\n\n"))
    rows = chunks.join(findings.select("book").distinct(), "book", "left_anti").select("book", "first", F.concat(head, body).alias("text"))
    before = F.coalesce(F.sum(F.length("text") + 2).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("book", F.row_number().over(own).cast("long").alias("place"), "text", before.alias("offset"))


def name_clashes(assets: DataFrame) -> DataFrame:
    """(book, name, contents) of names that stand for more than one content in a book. assets: (book, name, sha256)."""
    return assets.groupBy("book", "name").agg(F.count_distinct("sha256").alias("contents")).where("contents > 1")

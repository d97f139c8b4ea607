"""Question banks as JSON of any shape, held against all rules of a publishable bank, any number of banks at once.

files has a row a file: bank, path (as below), sha256 of its bytes, text. lines has a row a
line of the two question files: bank, path, line (from 1), text; file_lines() gives them for
files that fit a row. Findings are (bank, place, code, n): n counts what a rule found at that place.

JSON is read as VARIANT, so a value of a wrong type is a finding and never an error. A text
with one key twice in an object is no JSON here. Lookups (ids in the map, blocks in the
index, twins, reasons) are joins and windows by bank and id, so one bank may hold most rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_blank
from tidemark.sources.shared import written

# Names of files, registered values, formats and phrases that banks must agree on.
MANIFEST, INDEX, MAP, FORMAL = "manifest.json", "source-index.json", "knowledge-map.json", "questions.jsonl"
HELD, REASONS = "quarantine/questions.jsonl", "quarantine/reasons.json"
QUESTION_TYPES = ("single_choice", "multiple_choice")
DIFFICULTIES = ("basic", "advanced")
SCOPES = ("chapter", "comprehensive")
ROLES = ("primary", "auxiliary", "reference")
STATUSES = ("pass", "warning", "blocked")
KINDS = ("section", "chapter", "comprehensive", "topic")
CHANGES = ("ocr_fix", "separator_fix", "term_normalization", "answer_confirmation", "quote_fix", "structure_fix", "deduplication", "other")
QUESTION_ID = r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)*$"
KNOWLEDGE_ID = r"^[a-z0-9](?:[a-z0-9_-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9_-]*[a-z0-9])?)+$"
SHA256 = r"^[0-9a-f]{64}$"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
PROMOTION = r"(?:扫描右侧二维码|扫码兑换|关注公众号|QQ群|资料同步\s*VX|免费分享\s*PDF|认准淘宝店铺|赠送配套课程|涛涛提示)"
GUARD, GUARD_REASON = "【原书解析未可靠转录】", "content_quality_guard:"
MISPLACED = {"english-e2-2024-q-02": "digital technologies"}
BLANKS, LONG_ANALYSIS, SHARED_ANALYSIS = 20, 20_000, 200

_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
Counted = tuple["str | Column", Column]


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def shape(v: Column, path: str = "$") -> Column:
    """Its type as Spark names it; VOID for null and for what is not there."""
    return F.coalesce(F.schema_of_variant(at(v, path)), F.lit("VOID"))


def is_object(v: Column, path: str = "$") -> Column:
    return shape(v, path).startswith("OBJECT")


def text(v: Column, path: str) -> Column:
    return F.when(shape(v, path) == "STRING", at(v, path, "string"))


def filled(v: Column, path: str) -> Column:
    return ~is_blank(text(v, path))


def given(v: Column, path: str) -> Column:
    return F.coalesce(text(v, path) != "", F.lit(False))


def whole(v: Column, path: str) -> Column:
    return F.when(shape(v, path) == "BIGINT", at(v, path, "bigint"))


def items(v: Column, path: str) -> Column:
    return F.when(shape(v, path).startswith("ARRAY"), at(v, path, "array<variant>"))


def fits(value: Column, pattern: str) -> Column:
    return F.coalesce(value.rlike(pattern), F.lit(False))


def among(value: Column, values: Sequence[str]) -> Column:
    return F.coalesce(value.isin(*values), F.lit(False))


def length(array: Column) -> Column:
    return F.coalesce(F.greatest(F.size(array), F.lit(0)), F.lit(0))


def _n(*conditions: Column) -> Column:
    out = F.lit(0)
    for c in conditions:
        out = out + F.coalesce(c.cast("int"), F.lit(0))
    return out


def counted(rules: Sequence[Counted]) -> Column:
    """(code, n) of the rules that found anything."""
    each = [F.struct((F.lit(c) if isinstance(c, str) else c).alias("code"), F.coalesce(n.cast("long"), F.lit(0)).alias("n")) for c, n in rules]
    return F.filter(F.array(*each), lambda f: f["n"] > 0)


def fired(rows: DataFrame, place: Column, rules: Sequence[Counted]) -> DataFrame:
    """(bank, place, code, n) of all rules on each row, in one pass."""
    return rows.select("bank", place.alias("place"), F.explode(counted(rules)).alias("f")).select("bank", "place", "f.*")


def file_lines(files: DataFrame) -> DataFrame:
    """(bank, path, line, text) of the question files among files."""
    return files.where(F.col("path").isin(FORMAL, HELD)).select("bank", "path", F.posexplode(F.split("text", _BREAKS)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _json(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).select("bank", "text")


def _parsed(rows: DataFrame) -> DataFrame:
    """rows as a written table, its text read as v. Texts are written and not values: Parquet may widen an integer of a VARIANT to a decimal."""
    return written(rows).withColumn("v", F.try_parse_json("text")).drop("text")


def _twins(rows: DataFrame, place: Column, code: Column, order: str, *keys: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("bank", *keys).orderBy(order))
    return rows.withColumn("twin", n).where("twin > 1").select("bank", place.alias("place"), code.alias("code"), F.lit(1).cast("long").alias("n"))


def _each(rows: DataFrame, place: Column, code: str | Column) -> DataFrame:
    return rows.select("bank", place.alias("place"), (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(1).cast("long").alias("n"))


def _exploded(rows: DataFrame, path: str, name: str) -> DataFrame:
    """A row (bank, ..., n, name) for each item of an array of v, numbered from 0."""
    return rows.select("*", F.posexplode(items(F.col("v"), path)).alias("n", name))


def manifest_findings(heads: DataFrame, files: DataFrame) -> DataFrame:
    """Manifests and the files they declare. heads: (bank, v), v null where there is none."""
    v, place = F.col("v"), F.lit(MANIFEST)
    bank = is_object(v, "$.bank")
    blank = [~filled(v, f"$.bank.{f}") for f in ("id", "title", "domain", "subject", "resource_type", "status")]
    objects = heads.where(is_object(v))
    declared = objects.where(bank).select("bank", F.explode(F.array(*[F.struct(at(v, f"$.{d}").alias("node")) for d in ("knowledge_map", "questions", "source_index")])).alias("d")).select("bank", "d.node")
    node = F.col("node")
    sound = is_object(node) & given(node, "$.path") & fits(text(node, "$.sha256"), SHA256)
    named = declared.where(sound).select("bank", text(node, "$.path").alias("path"), text(node, "$.sha256").alias("want"))
    found = named.join(files.select("bank", "path", "sha256"), ["bank", "path"], "left")
    own = objects.select("bank", at(v, "$.questions.sha256", "string").alias("want")).join(files.where(F.col("path") == FORMAL).select("bank", "sha256"), "bank")
    return (
        fired(heads, place, [("E001/E002", v.isNull()), ("E002", v.isNotNull() & ~is_object(v))])
        .unionByName(fired(objects, place, [
            ("E003", ~F.coalesce(whole(v, "$.schema_version") == 1, F.lit(False))),
            ("E004", F.when(bank, _n(*blank, ~among(text(v, "$.bank.status"), ("ready",)))).otherwise(1)),
        ]))
        .unionByName(_each(declared.where(~sound), place, "E005"))
        .unionByName(fired(found, F.col("path"), [("E005", F.col("sha256").isNull()), ("E009", F.col("sha256") != F.col("want"))]))
        .unionByName(fired(own, F.lit(FORMAL), [("E009", (F.col("want") != "") & (F.col("sha256") != F.col("want")))]))
    )


def _other_bank(v: Column) -> Column:
    """Whether a file names no bank, or another than the manifest. Needs id (the manifest's) and has_bank."""
    return ~filled(v, "$.bank_id") | (F.col("has_bank") & ~text(v, "$.bank_id").eqNullSafe(F.col("id")))


def index_findings(index: DataFrame) -> DataFrame:
    """Source indexes: (bank, v, id, has_bank)."""
    v, s, b = F.col("v"), F.col("source"), F.col("block")
    objects = index.where(is_object(v))
    sources = _exploded(objects, "$.sources", "source")
    place = F.concat(F.lit(INDEX + ":"), F.col("n"))
    sound = sources.where(is_object(s)).withColumn("source_id", F.when(given(s, "$.source_id"), text(s, "$.source_id")))
    blocks = sound.where(items(s, "$.blocks").isNotNull()).select("bank", F.col("n").alias("of"), F.posexplode(items(s, "$.blocks")).alias("n", "block"))
    within = F.concat(F.lit(INDEX + ":"), F.col("of"), F.lit("."), F.col("n"))
    ids = blocks.where(is_object(b)).withColumn("block_id", F.when(given(b, "$.block_id"), text(b, "$.block_id")))
    start, end = whole(b, "$.start_line"), whole(b, "$.end_line")
    other = lambda f: ~shape(b, f).isin("VOID", "STRING")
    role, sha = text(s, "$.role"), text(s, "$.sha256")
    return (
        fired(index, F.lit(INDEX), [("E011", v.isNull())])
        .unionByName(fired(objects, F.lit(INDEX), [("E038", ~F.coalesce(whole(v, "$.index_version") == 1, F.lit(False))), ("E040", _other_bank(v)), ("E044", items(v, "$.sources").isNull())]))
        .unionByName(fired(sources, place, [("E045", ~(is_object(s) & given(s, "$.source_id")))]))
        .unionByName(fired(sound, place, [
            ("E047", _n(*[~filled(s, f"$.{f}") for f in ("filename", "display_name", "sha256", "role")], sha.isNotNull() & ~fits(sha, SHA256), role.isNotNull() & ~among(role, ROLES))),
            ("E048", items(s, "$.blocks").isNull()),
        ]))
        .unionByName(_twins(sound.where("source_id IS NOT NULL"), place, F.lit("E046"), "n", "source_id"))
        .unionByName(fired(blocks, within, [("E049", ~(is_object(b) & given(b, "$.block_id")))]))
        .unionByName(fired(ids, within, [
            ("E051", _n(~F.coalesce(start >= 1, F.lit(False)), ~F.coalesce(end >= 1, F.lit(False)))), ("E052", start > end), ("E053", _n(other("$.page"), other("$.page_label"))),
        ]))
        .unionByName(_twins(ids.where("block_id IS NOT NULL"), within, F.lit("E050"), "n", "of", "block_id"))
    )


def indexed(index: DataFrame) -> DataFrame:
    """(bank, source_id, source): of equal ids the last."""
    s = F.col("source")
    rows = _exploded(index.where(is_object(F.col("v"))), "$.sources", "source").where(is_object(s)).select("bank", text(s, "$.source_id").alias("source_id"), "n", "source").where("source_id IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("bank", "source_id").orderBy(F.desc("n")))
    return rows.withColumn("last", last).where("last = 1").select("bank", "source_id", "source")


def blocks_of(index: DataFrame) -> DataFrame:
    """(bank, source_id, block_id) that references may name."""
    rows = index.select("bank", "v").where(is_object(F.col("v")))
    sources = _exploded(rows, "$.sources", "source").where(items(F.col("source"), "$.blocks").isNotNull() & given(F.col("source"), "$.source_id")).withColumn("source_id", text(F.col("source"), "$.source_id"))
    last = F.row_number().over(Window.partitionBy("bank", "source_id").orderBy(F.desc("n")))
    blocks = sources.withColumn("last", last).where("last = 1").select("bank", "source_id", F.explode(items(F.col("source"), "$.blocks")).alias("block"))
    return blocks.where(is_object(F.col("block")) & given(F.col("block"), "$.block_id")).select("bank", "source_id", text(F.col("block"), "$.block_id").alias("block_id")).distinct()


def map_entries(maps: DataFrame) -> DataFrame:
    """(bank, n, entry, knowledge_id); the id is null where it is not well formed."""
    e = F.col("entry")
    rows = _exploded(maps.where(is_object(F.col("v"))).select("bank", "v"), "$.entries", "entry")
    return rows.select("bank", "n", "entry", F.when(is_object(e) & fits(text(e, "$.knowledge_id"), KNOWLEDGE_ID), text(e, "$.knowledge_id")).alias("knowledge_id"))


def map_findings(maps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Knowledge maps: (bank, v, id, has_bank)."""
    v, e = F.col("v"), F.col("entry")
    objects, entries = maps.where(is_object(v)), map_entries(maps)
    place = F.concat(F.lit(MAP + ":"), F.col("n"))
    good = entries.where("knowledge_id IS NOT NULL")
    path, ref = items(e, "$.path"), "$.source_ref"
    whole_ref = given(e, ref + ".source_id") & given(e, ref + ".block_id") & is_object(e, ref)
    refs = good.where(whole_ref).select("bank", "n", text(e, ref + ".source_id").alias("source_id"), text(e, ref + ".block_id").alias("block_id"))
    return (
        fired(maps, F.lit(MAP), [("E010", v.isNull())])
        .unionByName(fired(objects, F.lit(MAP), [("E054", ~F.coalesce(whole(v, "$.map_version") == 1, F.lit(False))), ("E039", _other_bank(v)), ("E010", items(v, "$.entries").isNull())]))
        .unionByName(fired(entries, place, [("E010", ~is_object(e)), ("E035", is_object(e) & F.col("knowledge_id").isNull())]))
        .unionByName(fired(good, place, [
            ("W015", ~among(text(e, "$.kind"), KINDS)), ("W018", ~filled(e, "$.label")),
            ("W017", path.isNull() | (length(path) == 0) | F.exists(path, lambda p: ~given(p, "$"))), ("W014", (shape(e, ref) != "VOID") & ~whole_ref),
        ]))
        .unionByName(_twins(good, place, F.lit("E034"), "n", "knowledge_id"))
        .unionByName(_each(refs.join(blocks, ["bank", "source_id", "block_id"], "left_anti"), place, "W014"))
    )


def record_rules() -> list[Counted]:
    """Rules on one record: v, held (whether it is quarantined) and id (of the bank)."""
    v, held = F.col("v"), F.col("held")
    either = lambda quarantined, formal: F.when(held, quarantined).otherwise(formal)
    options, answers, ids = items(v, "$.options"), items(v, "$.correct_answers"), items(v, "$.knowledge_ids")
    refs, changes = items(v, "$.source_refs"), items(v, "$.transformations")
    enough, kind, number = length(options) >= 2, text(v, "$.question_type"), whole(v, "$.local_number")
    objects = F.filter(options, lambda o: is_object(o))
    labels = F.when(enough, F.transform(objects, lambda o: F.coalesce(at(o, "$.label", "string"), F.lit("None")))).otherwise(F.array().cast("array<string>"))
    expected = F.transform(F.sequence(F.lit(0), length(options) - 1), lambda i: F.char(i + 65))
    blank_texts = length(F.filter(objects, lambda o: ~filled(o, "$.text_md")))
    options_wrong = (
        length(F.filter(options, lambda o: ~is_object(o))) + length(F.filter(objects, lambda o: ~fits(text(o, "$.label"), "^[A-Z]$")))
        + F.when(held, 0).otherwise(blank_texts) + _n((length(labels) > 0) & (labels != expected), length(F.array_distinct(labels)) != length(labels))
    )
    words = F.transform(F.filter(answers, lambda a: shape(a) == "STRING"), lambda a: at(a, "$", "string"))
    some = length(answers) > 0
    contents = F.concat(
        F.array(text(v, "$.context_md"), text(v, "$.stem_md"), text(v, "$.source_analysis_md")),
        F.coalesce(F.transform(objects, lambda o: text(o, "$.text_md")), F.array().cast("array<string>")),
        F.when(is_object(v, "$.distractor_analysis_md"), F.transform(F.map_values(at(v, "$.distractor_analysis_md", "map<string,variant>")), lambda x: text(x, "$"))).otherwise(F.array().cast("array<string>")),
    )
    holding = lambda pattern: length(F.filter(contents, lambda x: fits(x, pattern)))
    question_id = text(v, "$.question_id")
    return [
        (either("E043", "E042"), (shape(v, "$.bank_id") != "VOID") & (~filled(v, "$.bank_id") | (text(v, "$.bank_id") != F.col("id")))),
        ("E013", ~(fits(question_id, QUESTION_ID) & (F.length(question_id) >= 3))),
        ("E015", ~among(kind, QUESTION_TYPES)),
        (either("W007", "E016"), ~filled(v, "$.stem_md")),
        ("E017", F.when(enough, options_wrong).otherwise(1)),
        ("W004", F.when(held & enough, blank_texts).otherwise(0)),
        (either("W003", "E018"), ~some),
        ("E018", length(answers) - length(words)),
        ("E019", length(F.filter(words, lambda a: ~F.array_contains(labels, a)))),
        ("W009", length(F.array_distinct(words)) != length(words)),
        ("E020", some & (kind == "single_choice") & (length(answers) != 1)),
        ("W003", (kind == "multiple_choice") & (length(answers) == 1)),
        ("W002", ids.isNotNull() & (length(ids) == 0)),
        ("E021", F.when(ids.isNull(), 1).otherwise(length(F.filter(ids, lambda k: ~fits(text(k, "$"), KNOWLEDGE_ID))))),
        (either("W007", "E023"), length(refs) == 0),
        ("E024", _n(refs.isNull()) + length(F.filter(refs, lambda r: ~(is_object(r) & given(r, "$.source_id") & given(r, "$.block_id"))))),
        (either("W007", "E025"), ~filled(v, "$.source_analysis_md")),
        ("E058", ~shape(v, "$.context_md").isin("VOID", "STRING")),
        (either("W019", "E056"), holding(PROMOTION)),
        (either("W020", "E057"), holding(IMAGE)),
        ("W005", (shape(v, "$.distractor_analysis_md") != "VOID") & ~is_object(v, "$.distractor_analysis_md")),
        (either("E030", "E026"), ~F.coalesce(text(v, "$.status") == either("quarantined", "ready"), F.lit(False))),
        ("E027", F.when(changes.isNull(), 1).otherwise(length(F.filter(changes, lambda c: ~is_object(c))) + length(F.filter(changes, lambda c: is_object(c) & ~given(c, "$.type"))) + length(F.filter(changes, lambda c: is_object(c) & ~given(c, "$.reason"))))),
        ("W016", length(F.filter(changes, lambda c: text(c, "$.type").isNotNull() & ~among(text(c, "$.type"), CHANGES)))),
        ("W013", ~held & (shape(v, "$.local_number") == "VOID")),
        ("E055", ~held & (shape(v, "$.local_number") != "VOID") & ~F.coalesce(number >= 1, F.lit(False))),
        ("W010", ~held & ~among(text(v, "$.difficulty"), DIFFICULTIES)),
        ("W011", ~held & text(v, "$.scope").isNotNull() & ~among(text(v, "$.scope"), SCOPES)),
    ]


def taken(parsed: DataFrame) -> DataFrame:
    """What all other rules need of questions (bank, held, line, v, id), and found, what the rules on one record say; each JSON is read here and never again.

    fault is the code of a line that is no object; its other columns are null or empty.
    """
    v, held = F.col("v"), F.col("held")
    string = lambda path: F.coalesce(at(v, path, "string"), F.lit(""))
    named = F.filter(items(v, "$.source_refs"), lambda r: is_object(r) & given(r, "$.source_id") & given(r, "$.block_id"))
    guarded = F.exists(items(v, "$.transformations"), lambda c: F.coalesce(F.contains(at(c, "$.reason", "string"), F.lit(GUARD_REASON)), F.lit(False)))
    return parsed.withColumn("object", is_object(v)).select(
        "bank", "held", "line", F.when(~F.col("object"), F.when(held, "E030").when(v.isNull(), "E006").otherwise("E037")).alias("fault"), F.when(F.col("object"), counted(record_rules())).alias("found"),
        text(v, "$.question_id").alias("question_id"), string("$.unit_key").alias("unit"), string("$.question_type").alias("kind"), text(v, "$.question_type").alias("own_kind"), whole(v, "$.local_number").alias("number"),
        F.transform(items(v, "$.knowledge_ids"), lambda k: text(k, "$")).alias("knowledge_ids"), F.transform(named, lambda r: F.struct(text(r, "$.source_id").alias("source_id"), text(r, "$.block_id").alias("block_id"))).alias("refs"),
        F.when(text(v, "$.unit_key") == "use-of-english", string("$.context_md")).alias("cloze"), string("$.source_analysis_md").alias("analysis"), F.coalesce(guarded, F.lit(False)).alias("guarded"),
    )


def record_findings(records: DataFrame, known: DataFrame, blocks: DataFrame) -> DataFrame:
    """Questions as taken() gives them. known: (bank, knowledge_id)."""
    held = F.col("held")
    place = F.concat(F.when(held, HELD).otherwise(FORMAL), F.lit(":"), F.col("line"))
    named = records.where("question_id IS NOT NULL").select("bank", "held", "line", "question_id")
    keyed = records.where(~held & (F.col("number") >= 1)).select("bank", "held", "line", "unit", "kind", "number")
    ids = records.select("bank", "held", "line", F.explode("knowledge_ids").alias("knowledge_id")).where(fits(F.col("knowledge_id"), KNOWLEDGE_ID))
    refs = records.select("bank", "held", "line", F.explode("refs").alias("r")).select("bank", "held", "line", "r.*")
    formal = named.where(~held).select("bank", "question_id").distinct()
    return (
        records.select("bank", place.alias("place"), F.explode("found").alias("f")).select("bank", "place", "f.*")
        .unionByName(_twins(named, place, F.when(held, "E030").otherwise("E014"), "line", "held", "question_id"))
        .unionByName(_twins(keyed, place, F.lit("E028"), "line", "unit", "kind", "number"))
        .unionByName(_each(named.where(held).join(formal, ["bank", "question_id"], "left_semi"), place, "E029"))
        .unionByName(_each(ids.join(known, ["bank", "knowledge_id"], "left_anti"), place, "E022"))
        .unionByName(_each(refs.join(blocks, ["bank", "source_id", "block_id"], "left_anti"), place, "E024"))
    )


def missing_blanks(context: Column) -> Column:
    """Numbers from 1 to BLANKS without a mark in a cloze passage, read from the words "answer sheet" on."""
    low = F.lower(context)
    start = F.greatest(F.locate("answer sheet", low), F.locate("answer\u00a0sheet", low))
    body = F.when(start > 0, F.substr(context, start + F.lit(len("answer sheet")))).otherwise(context)
    marks = F.transform(F.regexp_extract_all(body, F.lit(r"(?<!\d)(\d{1,2})(?!\d)"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_except(F.sequence(F.lit(1), F.lit(BLANKS)), marks)


def content_findings(records: DataFrame) -> DataFrame:
    """W021 once for each distinct cloze passage, W022 for analyses that look spliced, noisy or shared."""
    place = F.concat(F.lit(FORMAL + ":"), F.col("line"))
    formal = records.where(~F.col("held"))
    cloze = formal.where("cloze IS NOT NULL").select("bank", "line", F.col("cloze").alias("context"))
    first = F.row_number().over(Window.partitionBy("bank", F.sha2("context", 256)).orderBy("line"))
    cloze = cloze.withColumn("first", first).where("first = 1")
    a = F.col("analysis")
    notes = formal.select("bank", "line", "question_id", "analysis", "guarded").where(~is_blank(a)).withColumn("h", F.sha2(a, 256))
    shared = notes.where(F.length(a) >= SHARED_ANALYSIS).groupBy("bank", "h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    often = lambda word, n: F.regexp_count(a, F.lit(word)) >= n
    misplaced = F.lit(False)
    for name, phrase in MISPLACED.items():
        misplaced = misplaced | (F.col("question_id").eqNullSafe(name) & a.contains(phrase))
    noisy = (F.length(a) > LONG_ANALYSIS) | a.contains("[无文本层") | often("配套", 8) | often("音频", 8) | often("\\x{fffd}", 3) | misplaced | F.col("copies").isNotNull()
    free = notes.where(~F.col("guarded") & ~F.regexp_replace(a, r"(?U)^\s+", "").startswith(GUARD)).join(shared, ["bank", "h"], "left")
    return fired(cloze, place, [("W021", F.size(missing_blanks(F.col("context"))) > 0)]).unionByName(fired(free, place, [("W022", noisy)]))


def count_findings(heads: DataFrame, formal_files: DataFrame, records: DataFrame, known: DataFrame) -> DataFrame:
    """Declared counts against counted ones, and map entries that no question names. formal_files: (bank) with a file of questions."""
    v, place = F.col("v"), F.lit(MANIFEST)
    n = records.groupBy("bank").agg(F.count_if(~F.col("held")).alias("formal"), F.count_if("held").alias("quarantined"))
    counted = heads.join(n, "bank", "left").na.fill(0, ["formal", "quarantined"])
    with_file = counted.join(formal_files, "bank", "left_semi")
    kinds = records.where(~F.col("held")).select("bank", F.col("own_kind").alias("kind")).where("kind IS NOT NULL").groupBy("bank", "kind").agg(F.count(F.lit(1)).alias("n"))
    declares = with_file.where(is_object(v, "$.question_type_counts"))
    declared = declares.select("bank", F.explode(at(v, "$.question_type_counts", "map<string,variant>")).alias("kind", "want")).select("bank", "kind", whole(F.col("want"), "$").alias("want"))
    differ = declared.join(kinds.join(declares.select("bank"), "bank", "left_semi"), ["bank", "kind"], "full").where("NOT (want <=> n)").select("bank").distinct()
    named = records.where(~F.col("held")).select("bank", F.explode("knowledge_ids").alias("knowledge_id")).distinct()
    orphans = known.join(formal_files, "bank", "left_semi").join(named, ["bank", "knowledge_id"], "left_anti")
    declared_held = shape(v, "$.quarantined_count") != "VOID"
    return (
        fired(with_file, place, [("E007", ~F.coalesce(whole(v, "$.question_count") == F.col("formal"), F.lit(False))), ("E008", ~is_object(v, "$.question_type_counts"))])
        .unionByName(_each(differ, place, "E008"))
        .unionByName(fired(counted.where(is_object(v)), place, [("E030", declared_held & ~F.coalesce(whole(v, "$.quarantined_count") == F.col("quarantined"), F.lit(False)))]))
        .unionByName(_each(orphans, F.col("knowledge_id"), "W001"))
        .unionByName(_each(heads.join(formal_files, "bank", "left_anti"), F.lit(FORMAL), "E005"))
    )


def reason_findings(reasons: DataFrame, records: DataFrame) -> DataFrame:
    """Reasons of quarantined questions: (bank, v, id), for the banks that have any such question."""
    v, r = F.col("v"), F.col("reason")
    held = records.where("held")
    ids = held.select("bank", "question_id").where("question_id IS NOT NULL").distinct()
    wanted = held.select("bank").distinct().join(reasons, "bank", "left")
    objects = wanted.where(is_object(v))
    each = _exploded(objects, "$.reasons", "reason")
    place = F.concat(F.lit(REASONS + ":"), F.col("n"))
    named = each.where(is_object(r) & given(r, "$.question_id")).withColumn("question_id", text(r, "$.question_id"))
    return (
        fired(wanted, F.lit(REASONS), [("E031", ~F.coalesce(is_object(v), F.lit(False)))])
        .unionByName(fired(objects, F.lit(REASONS), [("E041", ~filled(v, "$.bank_id") | ((F.col("id") != "") & (text(v, "$.bank_id") != F.col("id")))), ("E032", items(v, "$.reasons").isNull())]))
        .unionByName(fired(each, place, [("E032", ~(is_object(r) & given(r, "$.question_id")) | ~filled(r, "$.reason"))]))
        .unionByName(_each(named.join(ids, ["bank", "question_id"], "left_anti"), place, "W012"))
        .unionByName(_each(ids.join(named, ["bank", "question_id"], "left_anti"), F.col("question_id"), "E032"))
    )


def source_findings(heads: DataFrame, index: DataFrame) -> DataFrame:
    """Sources that a manifest declares, against the index."""
    v, s, m = F.col("v"), F.col("declared"), F.col("source")
    both = heads.where(is_object(v)).join(index.where(is_object(v)).select("bank"), "bank", "left_semi")
    each = _exploded(both.select("bank", "v"), "$.sources", "declared").withColumn("source_id", F.when(is_object(s) & given(s, "$.source_id"), text(s, "$.source_id")))
    matched = each.where("source_id IS NOT NULL").join(indexed(index), ["bank", "source_id"], "left")
    role, sha, place = text(s, "$.role"), text(s, "$.sha256"), F.concat(F.lit(MANIFEST + ":"), F.col("n"))
    same = lambda f: at(s, f, "string").eqNullSafe(at(m, f, "string"))
    blanks = [~given(s, f"$.{f}") for f in ("filename", "sha256", "role")]
    return (
        fired(both, F.lit(MANIFEST), [("E012", items(v, "$.sources").isNull())])
        .unionByName(_each(each.where("source_id IS NULL"), place, "E012"))
        .unionByName(fired(matched, place, [
            ("E012", _n(*blanks, sha.isNotNull() & ~fits(sha, SHA256), role.isNotNull() & ~among(role, ROLES), m.isNull() | ~(same("$.filename") & same("$.sha256") & same("$.role")))),
            ("W008", m.isNotNull() & (length(items(m, "$.blocks")) == 0)),
        ]))
    )


def quality_findings(heads: DataFrame, findings: DataFrame) -> DataFrame:
    """E033: what a manifest says of its quality against the findings of all other rules."""
    v = F.col("v")
    total = findings.groupBy("bank").agg(F.sum(F.when(F.col("code").startswith("E"), F.col("n"))).alias("b"), F.sum(F.when(F.col("code").startswith("W"), F.col("n"))).alias("w"))
    rows = heads.where(is_object(v)).join(total, "bank", "left").na.fill(0, ["b", "w"])
    status, b, w = text(v, "$.quality.status"), whole(v, "$.quality.blocker_count"), whole(v, "$.quality.warning_count")
    sound = among(status, STATUSES) & b.isNotNull() & w.isNotNull()
    says = F.when(b != 0, "blocked").when(w != 0, "warning").otherwise("pass")
    return fired(rows, F.lit(MANIFEST), [("E033", F.when(sound, _n(status != says, (b != F.col("b")) | (w != F.col("w")))).otherwise(1))])


def question_texts(lines: DataFrame) -> DataFrame:
    """(bank, held, line, text) of the lines that are not blank."""
    return lines.where(~is_blank(F.col("text"))).select("bank", (F.col("path") == HELD).alias("held"), "line", "text")


def questions(lines: DataFrame) -> DataFrame:
    """(bank, held, line, v) of the lines that are not blank; v is null where a line is no JSON."""
    return question_texts(lines).withColumn("v", F.try_parse_json("text")).drop("text")


def validate(files: DataFrame, lines: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """All findings (bank, place, severity, code, n). wanted: (bank) that must be there.

    A bank without a file has no row in files. files may leave out the text of the question files.
    """
    v, held = F.col("v"), F.col("held")
    banks = files.select("bank").distinct()
    heads = _parsed(banks.join(_json(files, MANIFEST), "bank", "left"))
    ids = heads.select("bank", F.coalesce(text(v, "$.bank.id"), F.lit("")).alias("id"), F.coalesce(is_object(v, "$.bank"), F.lit(False)).alias("has_bank"))
    index, maps = (_parsed(banks.join(_json(files, path), "bank", "left").join(ids, "bank")) for path in (INDEX, MAP))
    texts = question_texts(lines).join(ids, "bank", "left").na.fill({"id": ""})
    parsed = written(taken(texts.withColumn("v", F.try_parse_json("text")).drop("text")))
    records = parsed.where("fault IS NULL")
    known, blocks = map_entries(maps).select("bank", "knowledge_id").where("knowledge_id IS NOT NULL").distinct(), blocks_of(index)
    formal_files = files.where(F.col("path") == FORMAL).select("bank").distinct()
    place = F.concat(F.when(held, HELD).otherwise(FORMAL), F.lit(":"), F.col("line"))
    parts = [
        manifest_findings(heads, files), index_findings(index), map_findings(maps, blocks), record_findings(records, known, blocks), content_findings(records),
        count_findings(heads, formal_files, records, known), reason_findings(_parsed(_json(files, REASONS).join(ids, "bank")), records), source_findings(heads, index),
        _each(parsed.where("fault IS NOT NULL"), place, F.col("fault")),
    ]
    if wanted is not None:
        parts.append(_each(wanted.join(banks, "bank", "left_anti"), F.lit(""), "E001"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = written(found.groupBy("bank", "place", "code").agg(F.sum("n").alias("n")))
    severity = F.when(F.col("code").startswith("E"), "blocker").otherwise("warning")
    return found.unionByName(quality_findings(heads, found)).select("bank", "place", severity.alias("severity"), "code", "n")


def verdicts(banks: DataFrame, findings: DataFrame) -> DataFrame:
    """(bank, blockers, warnings, status) for each of banks (bank)."""
    b, w = (F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)) for s in ("blocker", "warning"))
    rows = banks.select("bank").distinct().join(findings, "bank", "left").groupBy("bank").agg(b.alias("blockers"), w.alias("warnings"))
    return rows.withColumn("status", F.when(F.col("blockers") > 0, "blocked").when(F.col("warnings") > 0, "warning").otherwise("pass"))


def totals(records: DataFrame) -> DataFrame:
    """Per bank: formal and quarantined questions, distinct formal ids, transformations of formal questions. records: (bank, held, line, v)."""
    v, formal = F.col("v"), ~F.col("held")
    rows = records.where(is_object(v)).select("bank", formal.alias("formal"), F.when(formal, text(v, "$.question_id")).alias("qid"), F.when(formal, length(items(v, "$.transformations"))).otherwise(0).alias("changes"))
    return rows.groupBy("bank").agg(F.count_if("formal").alias("question_count"), F.count_if(~F.col("formal")).alias("quarantined_count"), F.count_distinct("qid").alias("known_question_ids"), F.sum("changes").alias("transformations_total"))

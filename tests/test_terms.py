"""Alias rules, occurrences and replacement: rules applied one after another give the same where no rule makes another's alias."""

import random

from tidemark.operators import terms as T

MARK = "𬌗"
TERMS = ["𬌗面", "上𬌗架", "𬌗架", "𬌗支托", "平衡𬌗", "𬌗接触", "𬌗向", "𬌗", "邻𬌗面洞", "𬌗壁"]
CONFUSIONS = ["验", "骑", "雅", "酷", "矜", "体验"]
PROTECTED = ["实验", "检验", "优雅", "骑跨", "体验", "经验", "试验"]


def tables(spark, overrides=()):
    one = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    return T.alias_rules(one(TERMS, "term"), one(CONFUSIONS, "confusion"), spark.createDataFrame(list(overrides), "alias string, canonical string"), MARK), one(PROTECTED, "word")


def normal(spark, *texts, overrides=(), **kw):
    rules, protected = tables(spark, overrides)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = T.occurrences(docs, "id", "text", rules, protected, **kw)
    return [r["replaced"] for r in found.orderBy("id").collect()], found


def test_whole_terms_are_replaced(spark):
    out, _ = normal(spark, "验面 上骑架 体验支托 平衡雅 酷接触", "牙列、验与颌位", None, "")
    assert out == ["𬌗面 上𬌗架 𬌗支托 平衡𬌗 𬌗接触", "牙列、验与颌位", "", ""]
    assert normal(spark, "牙列、验与颌位", overrides=[("验与", "𬌗与"), ("验面", "面")])[0] == ["牙列、𬌗与颌位"]


def test_words_that_overlap_are_left(spark):
    source = "实验架 检验面 优雅面容 骑跨 体验 咬合 经验 试验"
    out, found = normal(spark, source)
    assert out == [source]
    got = {(r["alias"], r["occurrences"], r["guarded"]) for r in T.residuals(found).collect()}
    assert got == {("验架", 0, 1), ("验面", 0, 1), ("雅面", 0, 1)}
    assert normal(spark, "整体验向移动")[0] == ["整𬌗向移动"] and normal(spark, "整体验向移动", guard_all=True)[0] == ["整体验向移动"]


def test_bare_characters_are_left(spark):
    assert normal(spark, "验 骑 矜 雅 酷 合 咬")[0] == ["验 骑 矜 雅 酷 合 咬"]


def test_rules(spark):
    rules, _ = tables(spark, [("验面", "面"), ("same", "same"), ("", "x")])
    rows = rules.orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1)) and len({r["alias"] for r in rows}) == len(rows)
    assert [(-len(r["alias"]), r["alias"]) for r in rows] == sorted((-len(r["alias"]), r["alias"]) for r in rows)
    by = {r["alias"]: (r["canonical"], r["strict"]) for r in rows}
    assert by["验面"] == ("面", True) and by["体验架"] == ("𬌗架", False) and "验" not in by and "same" not in by and by["邻雅面洞"] == ("邻𬌗面洞", True)


def test_chosen_against_rules_one_after_another():
    rng = random.Random(6)
    rules = ["abcd", "bcd", "abc", "cda", "da", "cc"]
    for strict in ([True] * 6, [True, False] * 3):
        for _ in range(1500):
            text = "".join(rng.choices("abcd", k=rng.randint(0, 14)))
            words = ["dab", "cca"]
            places = lambda w: [(i, i + len(w)) for i in range(len(text)) if text.startswith(w, i)]  # noqa: E731,B023
            held = [p for w in words for p in places(w)]
            want, now = [], text
            for n, rule in enumerate(rules):
                at = 0
                while (i := now.find(rule, at)) >= 0:
                    at = i + len(rule)
                    guarded = strict[n] and any(a < at and i < b for a, b in held)
                    want.append((i, at, n, guarded))
                    if not guarded:
                        now = now[:i] + "#" * len(rule) + now[at:]
            assert T.chosen([(a, b, n) for n, rule in enumerate(rules) for a, b in places(rule)], held, strict, len(text)) == sorted(want)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "id long, text string")
    rules, protected = tables(spark)
    assert T.occurrences(none, "id", "text", rules, protected).count() == 0
    assert normal(spark, "验面 " * 50_000)[0] == ["𬌗面 " * 50_000]
    empty = T.alias_rules(spark.createDataFrame([], "term string"), spark.createDataFrame([], "confusion string"), spark.createDataFrame([], "alias string, canonical string"), MARK)
    assert T.occurrences(spark.createDataFrame([(1, "x")], "id long, text string"), "id", "text", empty, spark.createDataFrame([], "word string")).collect()[0]["spans"] == []


def test_pattern_residuals(spark):
    docs = spark.createDataFrame([(1, "深覆 深覆盖"), (2, None), (3, "")], "id long, text string")
    assert [tuple(r) for r in T.pattern_residuals(docs, "id", "text", {"deep": "深覆(?!盖)", "none": "x"}).collect()] == [(1, "deep", 1)]


class OneBatch:
    """A table of one batch, for what runs in a task."""

    def __init__(self, texts):
        import pyarrow as pa

        self.dtypes = [("id", "bigint"), ("text", "string")]
        self.batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def test_texts_are_gone_through_few_at_a_time(spark):
    rules, protected = tables(spark)
    texts = ["验面 x", None, "", "体验支托"] * 50
    made = T.occurrences(OneBatch(texts), "id", "text", rules, protected)
    assert max(b.num_rows for b in made) <= 64
    assert [x for b in made for x in b.column(2).to_pylist()] == ["𬌗面 x", "", "", "𬌗支托"] * 50
    assert [x for b in made for x in b.column(0).to_pylist()] == list(range(200))


def test_chunks_are_cut_few_texts_at_a_time():
    from tidemark.operators.documents import chunk, chunks

    texts = ["one two three four", None, "", "x" * 25] * 50
    made = chunks(OneBatch(texts), "id", "text", 10)
    assert max(len(set(b.column(0).to_pylist())) for b in made) <= 64
    want = [(i, n + 1, len(cs), c) for i, t in enumerate(texts) for cs in [chunk(t or "", 10)] for n, c in enumerate(cs)]
    assert [r for b in made for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == want

"""Each operator against a plain version on a small corpus with nulls, blanks, copies, near copies, ties and long texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

WORD = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, shard string, spans string"


def fold(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def corpus(n=90, seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeñüé", k=rng.randint(1, 6))) for _ in range(400)] + ["The", "x!", "A.B", "don't", "漢字"]
    text = lambda k: "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in rng.choices(vocab, k=k))
    texts, passage, shared = [], text(80), [text(120), text(70)]
    for i in range(n):
        kind = i % 9
        if kind == 0 and texts:
            texts.append(rng.choice(texts))
        elif kind == 1 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(text(rng.randint(0, 60)) + passage + text(rng.randint(0, 60)))
        elif kind == 3:
            texts.append(text(rng.randint(0, 9)))
        elif kind == 4:
            texts.append(rng.choice(shared)[rng.randint(0, 40):] + text(30))
        else:
            texts.append(text(rng.randint(20, 200)))
    texts += ["", "   \n\t ", "one", "one two three four", "ONE two three four", text(4000), "aa " * 130, "aa " * 131, "<|endoftext|> a<|endoftext|>", "a\u0085b\u00a0c\x1cd   e"]
    return [(3 * i + 1, t, None if i % 7 == 0 else "en", None, len(t), "clash", None, "x", "y") for i, t in enumerate(texts)] + [(5000, None, None, None, None, None, None, None, None)]


ROWS = corpus()
TEXTS = {k: t or "" for k, t, *_ in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


def test_jaccard(docs):
    from tidemark.llm.jaccard import near_copies

    sets = {k: (lambda w: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())(WORD.findall(fold(t))) for k, t in TEXTS.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_copies(docs).collect()}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}
    assert sum(find(k) != k for k in sets) > 10


def test_blocks_of_a_large_family(spark, monkeypatch):
    from tidemark.llm import jaccard

    monkeypatch.setattr(jaccard, "MEMBERS", 7)
    monkeypatch.setattr(jaccard, "QUERIES", 11)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 50] + [f"new{i}"] + base[i % 50 + 1 :])) for i in range(60)]
    got = {r["component_id"] for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def removed(texts):
    owner, out = {}, {}
    for k in sorted(texts):
        words = WORD.findall(texts[k])
        keep = [True] * len(words)
        for s in range(len(words) - 49):
            if owner.setdefault(tuple(words[s : s + 50]), k) < k:
                keep[s : s + 50] = [False] * 50
        kept = [w for w, y in zip(words, keep) if y]
        out[k] = (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("shards", [1, 7])
def test_repeats(docs, shards):
    from tidemark.llm.repeats import drop_repeats

    rows = drop_repeats(docs, shards=shards).collect()
    want = removed(TEXTS)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want
    assert sum(w[1] for w in want.values()) > 500
    for r in rows:
        assert hashlib.sha256(" ".join(WORD.findall(r["kept_text"])).encode()).hexdigest() == r["kept_sha256"]
        assert r["n_removed"] or r["kept_text"] == TEXTS[r["doc_id"]]


def test_repeats_are_what_the_automaton_hits():
    from tidemark.llm import repeats

    def gone(docs, passages):
        n = repeats.Normal([t.encode() for t in docs])
        return repeats.covered_words(n, np.arange(len(docs)) + 10, repeats.Normal([t.encode() for t in passages]), np.arange(len(passages))).tolist()

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    assert gone([f"x\t{a.replace(' ', chr(10))} y", b, "", "z"], [a]) == [False, *[True] * 60, False, *[False] * 61]
    assert not any(gone([a.replace("a30", "other")], [a])) and not any(gone([a, b], []))
    whole = repeats.automaton

    def deaf(passages):
        find, begin, where = whole(passages)
        return type("Deaf", (), {"iter": lambda self, text: ()})(), begin, where

    repeats.automaton = deaf
    try:
        assert not any(gone([a], [a]))
    finally:
        repeats.automaton = whole


def test_repeats_with_one_phrase_in_all_documents(spark):
    from tidemark.llm.repeats import drop_repeats

    rng, footer = random.Random(3), " ".join(f"license{i}" for i in range(12))
    own = [" ".join(f"{rng.randrange(10**6)}" for _ in range(70)) for _ in range(60)]
    texts = {i: f"{own[i % 40]} {footer} {own[i % 60]}" for i in range(160)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in drop_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shards=3).collect()}
    assert got == removed(texts)


def test_repeats_in_chunks_of_any_size(spark):
    from tidemark.llm.repeats import anchors, drop_repeats
    from tidemark.llm.words import words

    for n in range(130):
        code, fits, anchor = anchors(words([b" ".join(b"w%d" % i for i in range(n))]))
        assert (len(code), len(anchor), int(fits.sum())) == (n, n, max(0, n - 49))
    texts = {n: " ".join(f"w{i}" for i in range(n)) for n in range(61)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(61, "doc_id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in drop_repeats(rows).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == removed(texts)


def test_repeats_when_the_bitmap_is_full(docs, monkeypatch):
    from tidemark.llm import repeats

    monkeypatch.setattr(repeats, "recurring_bits", lambda docs, total: np.full(1 << 16, 255, np.uint8))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.drop_repeats(docs).collect()} == removed(TEXTS)


@pytest.mark.parametrize("most_bits", [1 << 29, 1])
def test_decontamination(spark, docs, most_bits, monkeypatch):
    from tidemark.llm import decontaminate as module
    from tidemark.llm.decontaminate import decontaminate

    monkeypatch.setattr(module, "MOST_BITS", most_bits)
    rng = random.Random(9)
    items = [(i, " ".join(ALNUM.findall(t)[5 : 5 + rng.randint(8, 40)])) for i, t in enumerate(TEXTS.values()) if i % 6 == 0] + [(900, "one TWO"), (901, "one"), (902, None), (None, "one two"), (903, "!!"), (1, "one"), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(fold(t or ""))
        for s in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows[tuple(w[s : s + 10])].add(str(i))
    want = {}
    for k, t in TEXTS.items():
        w, hit, own = ALNUM.findall(fold(t)), set(), set()
        for n in set(map(len, windows)):
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    own |= found
        want[k] = (str(len(w)), len(hit), sorted(own), bool(hit))
    got = {r["doc_id"]: (str(r["n_words"]), r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate(docs, bench).collect()}
    assert got == want
    assert sum(w[3] for w in want.values()) > 10


def test_decontamination_of_repeats_and_null_keys(spark):
    from tidemark.llm.decontaminate import decontaminate

    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage, 7), (1, passage, 7), (None, passage, 7), (None, None, 7), (2, f"{passage} {passage}", 7), (3, "p1 p2 p3", 7)]
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string, n_hit int"), spark.createDataFrame([("a", passage), ("b", passage)], "item_id string, text string"))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in got.collect()) == sorted([("1", 30, 30, 2, ["a", "b"])] * 2 + [("None", 30, 30, 2, ["a", "b"]), ("None", 0, 0, 0, []), ("2", 60, 60, 2, ["a", "b"]), ("3", 3, 0, 0, [])])


def test_bpe(docs):
    from tidemark.llm.bpe import encode_and_decode

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in encode_and_decode(docs, batch_bytes=5000).collect():
        ids = lib.encode(TEXTS[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def mixes(n, seed):
    """Random texts of words, white space of many scripts and special tokens."""
    rng = random.Random(seed)
    parts = ["a", "end.", "x", "word", "don't", "12", "!?", "漢字", "ß", "«", "–", "<", "<|", "endoftext|>", "<|endoftext|>", " ", " ", " ", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1f", "\u0085", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\u180e", "\ufeff"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("operator", ["bpe", "idfiles"])
def test_pieces_of_random_white_space_and_special_tokens(operator):
    from tidemark.llm import bpe, idfiles

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = mixes(20_000, 11) + ["First document ends here.\n <|endoftext|> Second document starts.", "one line\t <|endoftext|> next", "a \xa0 \xa0 b", "end. \xa0 \xa0\n", "x\n \xa0 \xa0 \xa0 y", "ends ", " <|endoftext|> begins", "<|endoftext|>"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    if operator == "bpe":
        own = bpe.PairIndexBpe(path)
        pieces = bpe.Pieces(own.pretokens.row, own.pretokens.alone, own.special, 10**9)
    else:
        pieces = idfiles._kept(path)[0]
        pieces.clear()
    numbers, begins = pieces.numbers([t.encode() for t in texts])
    pieces.learn()
    ids, at = pieces.ids(numbers, begins)
    wrong = [(t, w, ids[a:b].tolist()) for t, w, a, b in zip(texts, want, at[:-1], at[1:]) if ids[a:b].tolist() != w]
    assert not wrong, (len(wrong), wrong[:5])


def test_id_files(spark, docs, monkeypatch):
    from tidemark.llm import idfiles
    from tidemark.llm.shared import shared_dir

    monkeypatch.setattr(idfiles, "FILE_TEXT_BYTES", 20_000)
    lib, folder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), shared_dir(spark)
    written = idfiles.write_id_files(docs, folder)
    files = {r["number"]: (r["documents"], r["ids"]) for r in written.collect()}
    assert len(files) > 2
    rows = sorted(idfiles.read_id_files(folder, written).collect(), key=lambda r: (r["number"], r["place"]))
    assert [r["doc_id"] for r in rows] == sorted(TEXTS)
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(TEXTS[r["doc_id"]], add_special_tokens=False).ids + [2]
    assert sum(n for _, n in files.values()) == sum(r["n_tokens"] for r in rows)


def test_id_files_query_with_repeats_nulls_and_a_lost_attempt(spark, docs, tmp_path, monkeypatch):
    from tidemark.llm import idfiles

    monkeypatch.setattr(idfiles, "FILE_TEXT_BYTES", 20_000)
    rows = [(None, "no id"), (None, None), *((7, f"repeated id {i % 3} " * 40) for i in range(90)), *TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    lib, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    ids = {t: np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t in rows}
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, ids[r[1]])):
        want.append((k, at, len(ids[t]) // 4, zlib.crc32(ids[t])))
        at += len(ids[t]) // 4
    own = idfiles.shared_dir
    folder = own(spark)
    monkeypatch.setattr(idfiles, "shared_dir", lambda spark: folder)
    first = idfiles.op4_ranked_id_files(spark, str(tmp_path))
    where, place = idfiles._place(folder)
    with where.open_output_stream(f"{place}/ids/000000000000000-lost.ids") as f:  # what an attempt without a row leaves
        f.write(b"TMRK half a file")
    assert sorted(map(tuple, first.collect()), key=lambda r: r[1]) == want


def test_packing_round_trip():
    from tidemark.llm.idfiles import pack, unpack

    rng = np.random.default_rng(1)
    ranks = np.concatenate([rng.integers(0, 1 << b, 50) for b in (3, 8, 9, 16, 17, 24, 25, 32)]).astype(np.uint32)
    begins = np.array([0, 0, 1, 6, 50, 399, 400])
    for c, d, a, b in zip(*pack(ranks, begins), begins[:-1], begins[1:]):
        assert unpack(c, d, b - a).tolist() == ranks[a:b].tolist()


def test_shards(docs):
    from tidemark.llm.sharding import shard_rows

    rows = shard_rows(docs, 7).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((k, len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in TEXTS.items())
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_hypergeometric_law(spark):
    from math import comb

    from tidemark.llm.sharding import hypergeometric_sql

    n = 4000
    got = collections.Counter(r["k"] for r in spark.range(n).selectExpr(f"{hypergeometric_sql('20L', '8L', '6L', f'((id + 0.5D) / {n}D)')} AS k").collect())
    for k in range(7):
        assert abs(got[k] / n - comb(8, k) * comb(12, 6 - k) / comb(20, 6)) < 2 / n
    edge = spark.range(1).selectExpr(f"{hypergeometric_sql('0L', '0L', '0L', '0.5D')} AS a", f"{hypergeometric_sql('9L', '9L', '4L', '0.99D')} AS b", f"{hypergeometric_sql('9L', '0L', '4L', '0.01D')} AS c").first()
    assert tuple(edge) == (0, 4, 0)


def test_quality_base(docs):
    from tidemark.llm.quality import base_counts

    for r in base_counts(docs).collect():
        t = TEXTS[r["doc_id"]]
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))


def test_binomial_tail(spark):
    from math import comb

    from tidemark.llm.quality import binomial_tail_sql

    for n, k, p in ((1000, 3, 0.01), (50, 0, 0.1), (400, 30, 0.1), (7, 1, 0.3)):
        got = spark.range(1).selectExpr(f"{binomial_tail_sql(f'{n}D', f'{k}D', f'{p}D')} AS x").first()["x"]
        assert got == pytest.approx(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_quality_cutoffs_bound_false_rejection(spark):
    from tidemark.llm.quality import verdicts

    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows, labels = [], []
    for i in range(4000):
        bad = i % 4 == 0
        own = rng.choices(words, k=60)
        rows.append((i, " ".join(w + "#$" if bad and rng.random() < 0.7 else w for w in own), "en"))
        labels.append((i, 0 if bad else 1))
    got = {r["doc_id"]: r["kept"] for r in verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert sum(not got[i] for i, q in labels if q) / 3000 <= 0.05
    assert sum(not got[i] for i, q in labels if not q) / 1000 > 0.9


def test_quality_verdicts_against_a_plain_version(spark):
    """Strata null, empty and en; equal texts with several labels; the levels, the tests and the verdicts in plain Python."""
    from math import ceil
    from math import comb

    from pyspark.sql import functions as F

    from tidemark.llm.quality import FAIL, LEVELS, RISK, RULES, STEP, USEFUL, base_counts, verdicts

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 3 == 0
        own = [w + "#$" if bad and rng.random() < 0.5 else w + "!" if rng.random() < 0.02 else w for w in rng.choices(words, k=60)]
        rows.append((i, " ".join(own), [None, "", "en"][i // 7 % 3]))
        labels.append((i, 0 if bad else 1))
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(300)] + [(3000, None, "en"), (None, rows[0][1], "en")]
    labels += [(2000 + i, 0) for i in range(0, 300, 50)] + [(5, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    label: dict = {}
    for k, q in labels:
        label[k] = min(q, label.get(k, 1))
    counts = base_counts(docs).withColumn("half", F.pmod(F.xxhash64("twin", F.lit("half")), F.lit(2))).collect()
    by: dict = collections.defaultdict(dict)
    for r in counts:
        if not r["base_failed"] and r["doc_id"] in label:
            x = by[r["stratum"]].setdefault(r["twin"], [r["half"], 1, [r[c] for c in RULES]])
            x[1] = min(x[1], label[r["doc_id"]])
    limits = {}
    for stratum, seen in by.items():
        good = [x[2] for x in seen.values() if x[:2] == [0, 1]]
        cut = [[sorted(g[r] for g in good)[max(0, ceil((1 - STEP * (m + 1)) * len(good)) - 1)] for m in range(LEVELS)] for r in range(6)]
        bad = [x[2] for x in seen.values() if x[:2] == [0, 0]]
        use = [sum(b[r] > cut[r][LEVELS // 2] for b in bad) / len(bad) >= USEFUL * STEP * (LEVELS // 2 + 1) for r in range(6)]
        held, best = [x[2] for x in seen.values() if x[:2] == [1, 1]], None
        for m in range(LEVELS):
            k, n = sum(any(use[r] and h[r] > cut[r][m] for r in range(6)) for h in held), len(held)
            if sum(comb(n, i) * RISK**i * (1 - RISK) ** (n - i) for i in range(k + 1)) > FAIL / len(by):
                break
            best = m
        if best is not None:
            limits[stratum] = [cut[r][best] if use[r] else float("inf") for r in range(6)]
    assert len(by) == 3 and limits
    want = sorted((str(r["doc_id"]), not r["base_failed"] and all(r[c] <= v for c, v in zip(RULES, limits.get(r["stratum"], [9e9] * 6), strict=True))) for r in counts)
    got = sorted((str(r["doc_id"]), r["kept"]) for r in verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect())
    assert got == want and 0 < sum(not k for _, k in got) < len(got)


def test_toxicity_learns_and_holds_out(spark):
    from tidemark.llm.toxicity import score

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        own = rng.choices(words, k=60)
        if toxic:
            own[10:10] = ["you", rng.choice(["zork", "blah", "fnord"])] * 2
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    out = score(spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 902 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [i for i, _ in labels if by[i]["held_out"]]
    assert sum(by[i]["predicted"] == t for i, t in labels if i in set(held)) / len(held) > 0.95
    assert by[9000]["predicted"] == by[9001]["predicted"] == 0


def test_urls(spark):
    from tidemark.llm.urls import judge

    urls = {
        "http://A.Example.COM/en/x?q": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "x://b.www.example.com/en/z#f": ("b.www.example.com", "/en/z", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://com/a": ("com", "/a", "com/", "allow"),
        "http://q.net/es/1://2": ("q.net", "/es/1://2", "net/es/", "block"),
        "http://q.net/es": ("q.net", "/es", None, None),
        "http://q.com?/": ("q.com", "", None, None),
        "no scheme.com/": ("", "", None, None),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://good{i % 40}.com/a/{i}") for i in range(300)] + [(500 + i, f"http://spam-{i % 40}.net/fr/{i}") for i in range(300)] + [(900, "http://good99.org/a/9"), (901, "http://spam-99.org/fr/9")]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert (got[900]["verdict"], got[901]["verdict"]) == ("allow", "block")


def test_urls_are_judged_by_query_fragment_and_scheme_too(spark):
    from tidemark.llm.urls import judge

    rows = [(i, f"http://h{i % 30}.com/a?page={i}") for i in range(200)] + [(500 + i, f"http://h{i % 30}.net/fr/a?click=casino{i}#win") for i in range(200)]
    rows += [(900, "http://h3.org/a?page=17"), (901, "http://h3.org/a?click=casino17#win"), (902, "casino casino#win"), (903, "http://h3.org/a?page=" + "7" * 200_000)]
    got = {r["page_id"]: r["verdict"] for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i] for i in (900, 901, 902, 903)] == ["allow", "block", "block", "allow"]


@pytest.mark.parametrize(("chunk_bytes", "salt_chunks"), [(1 << 16, 4096), (40, 3)])
def test_url_differences_are_those_of_the_full_counts(spark, chunk_bytes, salt_chunks):
    from tidemark.llm.urls import MarkovModel, contexts, differences, train

    rng = random.Random(3)
    # over 150,000 contexts a verdict, nearly all of them rare
    letters = [chr(c) for c in range(0x4E00, 0x5200)] + list("ab\n")
    labelled = [(i, v, "".join(rng.choices(letters, k=40))) for v in ("allow", "block") for i in range(1000)]
    tables = {"allow": {}, "block": {}}
    for _, v, t in labelled:
        for c, x in contexts(t):
            tables[v].setdefault(c, collections.Counter())[x] += 1
    assert min(map(len, tables.values())) > 150_000
    models = {v: MarkovModel({c: (by.total(), by) for c, by in t.items()}, 1 + len(t[""])) for v, t in tables.items()}
    asked = [(i, t) for i, (_, _, t) in enumerate(labelled[::97])] + [(900, ""), (901, "neu"), (901, "neu")]
    out = differences(spark.createDataFrame(asked, "page_id long, text string"), *train(spark.createDataFrame(labelled, "page_id long, verdict string, text string")), chunk_bytes=chunk_bytes, salt_chunks=salt_chunks)
    got = sorted(tuple(r) for r in out.collect())
    want = sorted((i, t, models["allow"].mean_log(t) - models["block"].mean_log(t) if t else 0.0) for i, t in asked)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], rtol=0, atol=1e-9)


def test_markov_chances_sum_to_one():
    from tidemark.llm.urls import MarkovModel, contexts

    table = {}
    for t in ("abab", "abba", "ba"):
        for c, x in contexts(t):
            n, by = table.get(c, (0, {}))
            table[c] = (n + 1, {**by, x: by.get(x, 0) + 1})
    model = MarkovModel(table, 4)
    # over all one-letter texts and the letter that ends them
    total = sum(np.exp(model.mean_log(a) * (len(a) + 1)) for a in ("", "a", "b", "aa", "ab", "ba", "bb"))
    assert 0 < total < 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>  a\n b&amp;c&nbsp;d </p>", "a b&c d"),
        ("<html><head><title>no</title><style>p{}</style></head><body><nav><li>menu item one</li></nav><article><h1>Head</h1><p>One <b>bo</b>ld, text here and more of it.<p>Two.<script>var t='</p>'</script></article><footer>f</footer>", "Head One bold, text here and more of it. Two."),
        ("<div class='sidebar'>A long, long sidebar text.</div><div><p>The article text, as such, is here.</p></div><section id=comments><p>First, I say, and I like it.</p></section>", "The article text, as such, is here."),
        ("<article><p>Broken <i>markup, it is<p>Next one, and so on", "Broken markup, it is Next one, and so on"),
        ("<!-- <p>x</p> --><p title='a>b'>Real text, in a paragraph.</p><form><p>Your name, please, here.</p></form>", "Real text, in a paragraph."),
        ("<p>" + "word, " * 20000 + "</p>", ("word, " * 20000).strip()),
    ],
)
def test_html(page, text):
    from tidemark.llm.html import content

    assert content(page or "") == text


@pytest.mark.parametrize(
    "wrapper",
    [
        "<body class='page-template has-sidebar'>{}</body>", "<body class='no-nav'>{}</body>", "<body class='navy-theme'>{}</body>", "<div class='no-comments post'>{}</div>", "<article class='post comments-open'>{}</article>",
        "<div class='post comments-closed'>{}</div>", "<main class='nav-main'>{}</main>", "<div class='banner'>{}</div>", "<div class='navy'>{}</div><div class='nav'><a href=x>Home</a></div>",
    ],
)
def test_html_article_in_a_wrapper_with_a_telling_name(wrapper):
    from tidemark.llm.html import content

    body = "<h1>Title</h1>" + "".join(f"<p>Paragraph {i} of the article, which goes on for a while, and then it ends.</p>" for i in range(6)) + "<p class='footnotes'>1. A note at the foot of it, kept.</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p>"
    want = "Title " + " ".join(f"Paragraph {i} of the article, which goes on for a while, and then it ends." for i in range(6)) + " 1. A note at the foot of it, kept. Let x=1 hold."
    assert content(wrapper.format(body + "<div class='comments'><p>First!</p></div><nav><a href=x>Next</a></nav>")) == want


def test_html_comments_go_even_where_they_hold_most_of_the_text():
    from tidemark.llm.html import content

    said = "".join(f"<p>Reader {i} says that the story is too short, and goes on about it at length, as ever.</p>" for i in range(40))
    assert content(f"<div><p>A short article of one paragraph, which says all there is to say, and stops there.</p></div><div class='comments'>{said}</div>") == "A short article of one paragraph, which says all there is to say, and stops there."


@pytest.mark.parametrize("page", ["<a " * 60_000, "<!" * 60_000, "<div>" * 20_000, "<div>x" * 20_000, "<svg>" * 40_000, "<textarea>" * 30_000 + "</textarea>", "</p>" * 60_000, "<b>" * 30_000 + "</i>x" * 30_000, "<a title='" * 40_000, '<div class="x"><li>y' * 10_000])
def test_html_of_any_page_takes_linear_time(page):
    import time

    from tidemark.llm.html import content

    began = time.process_time()
    content(page)
    assert time.process_time() - began < 3


_LONG = "A sentence, with marks, goes on. " * 12


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article>" + f"<p>{_LONG}</p>" * 5 + "<ul>" + "".join(f"<li>item number {i}</li>" for i in range(4)) + "</ul><table><tr><td>a</td><td>b</td></tr></table></article>", " ".join([_LONG.strip()] * 5 + [f"item number {i}" for i in range(4)] + ["a", "b"])),
        ("<body>" + f"<p>{_LONG}</p>" * 5 + "<ul><li>one</li><li>two</li><li>three</li></ul><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li><li><a href=z>Contact</a></li></ul></body>", " ".join([_LONG.strip()] * 5 + ["one two three"])),
        ("<p>One.</p>a < b and the rest", "One. a < b and the rest"),
        ("<p>One.</p>the rest <a href='x", "One. the rest"),
        ("<title>Name<p>The text, as such.</p>", "The text, as such."),
        ("<div><button>Open<p>The text, as such.</p><button>x</button><p>More of it.</p></div>", "The text, as such. More of it."),
        ("<p>Before.</p><svg><path d='m'/><p>After.</p>", "Before. After."),
        ("<p>Before.</p><textarea>x<p>After.</p><select><option>y<p>End.</p>", "Before. After. End."),
    ],
)
def test_html_keeps_all_of_the_article(page, text):
    from tidemark.llm.html import content

    assert content(page) == text


_LONG = "A paragraph of the article tells a long story, with commas and stops, and ends only here. " * 3


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta x><body><p>{_LONG}</p></body>",
        f'<p title="abc>{_LONG}</p>',
        f'<p title="abc>{_LONG}<p class="x"></p>',
        f'<div class="legal-news"><p>{_LONG}</p></div><div class="legal">Terms apply</div>',
        f'<article class="search-and-rescue story"><p>{_LONG}</p></article>',
        f'<p data-html="<b>x</b> > y">{_LONG}</p>',
    ],
)
def test_html_of_broken_pages(page):
    from tidemark.llm.html import content

    assert content(page).removeprefix('<p title="abc>') == _LONG.strip()


def test_html_ratios_remove_what_no_list_names():
    """Words right and wrong, by the ratios and by the names alone, on pages whose menus and adverts have no telling names."""
    from tidemark.llm.html import _undoubted, content, nodes

    rng, right, wrong, missing, alone = random.Random(4), 0, 0, 0, 0
    for i in range(40):
        body = [" ".join(rng.choices(["story", "river", "then, of", "course.", "walked,", "home."], k=rng.randint(25, 90))) for _ in range(rng.randint(3, 8))]
        links = "".join(f"<li><a href=/{j}>Page {j}</a></li>" for j in range(rng.randint(4, 12)))
        boxes = [f'<div class="q{i}"><ul>{links}</ul></div>', '<div id="k2"><span>Buy now</span></div>', '<div class="z9"><b>Top deals</b></div>']
        rng.shuffle(boxes)
        page = boxes[0] + f'<div class="w{i}"><h1>The title</h1>' + "".join(f"<p>{b}</p>" for b in body) + "<p>He left.</p></div>" + "".join(boxes[1:])
        want = collections.Counter(" ".join(["The title", *body, "He left."]).split())
        got, listed = (collections.Counter(t.split()) for t in (content(page), " ".join(n.text for n in _undoubted([n for n in nodes(page) if n.weight > 0]))))
        right += (want & got).total()
        wrong, missing, alone = wrong + (got - want).total(), missing + (want - got).total(), alone + (listed - want).total()
    assert missing == 0 and wrong < alone / 4


def test_html_rows(spark):
    from tidemark.llm.html import extract

    rows = [(1, "u", f"<p>{_LONG}</p>", "x"), (1, "u", f"<p>{_LONG}</p>", "x"), (None, None, None, "x"), (2, "v", "", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", _LONG.strip(), len(_LONG.strip()))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)


def test_empty_tables(spark):
    from tidemark.llm.bpe import encode_and_decode
    from tidemark.llm.decontaminate import decontaminate
    from tidemark.llm.html import extract
    from tidemark.llm.jaccard import near_copies
    from tidemark.llm.quality import verdicts
    from tidemark.llm.repeats import drop_repeats
    from tidemark.llm.sharding import shard_rows
    from tidemark.llm.toxicity import score
    from tidemark.llm.urls import judge

    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (encode_and_decode(docs), decontaminate(docs, bench), extract(pages), near_copies(docs), verdicts(docs, labels), drop_repeats(docs), shard_rows(docs, 3), score(docs, labels), judge(pages)):
        assert out.count() == 0


def test_no_labels_and_no_items(spark, docs):
    from tidemark.llm.decontaminate import decontaminate
    from tidemark.llm.quality import verdicts
    from tidemark.llm.toxicity import score

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score(docs, labels).collect()} == {0.0}
    assert all(r["kept"] == (not r["base_failed"]) for r in verdicts(docs, labels).collect())
    assert not any(r["contaminated"] for r in decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect())


def test_repeated_rows_and_null_ids(spark):
    from tidemark.llm.jaccard import near_copies
    from tidemark.llm.repeats import drop_repeats
    from tidemark.llm.sharding import shard_rows

    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(4, text), (4, text), (2, text), (None, text), (None, None), (7, "other")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in drop_repeats(rows).collect())
    assert got == [(-1, 0), (-1, 60), (2, 0), (4, 60), (4, 60), (7, 0)]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in near_copies(rows).collect())
    assert got == [(-1, -1), (-1, -1), (2, 2), (4, 2), (4, 2), (7, 7)]
    assert sorted(r["slot"] for r in shard_rows(rows, 2).collect()) == [0, 0, 1, 1, 2, 2]


def test_without(spark):
    from tidemark.llm.bitmap import without

    rows = spark.createDataFrame([(i if i % 5 else None, str(i)) for i in range(300)], "doc_id long, text string")
    for most in (8, 1 << 29):
        got = without(rows, spark.range(100, 200).withColumnRenamed("id", "doc_id"), "doc_id", most)
        assert sorted(int(r["text"]) for r in got.collect()) == [i for i in range(300) if not (i % 5 and 100 <= i < 200)]
    assert without(rows, spark.createDataFrame([], "doc_id long"), "doc_id").count() == 300

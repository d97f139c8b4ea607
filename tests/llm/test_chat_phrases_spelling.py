"""Operators 11 to 13 against plain versions: nulls, blanks, ties, repeated rows, clashing columns, long texts, empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import pytest

WORD = re.compile(r"[^\x20\x09]+")
PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def fold(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Chat.

TURNS = "conv_id long, turn long, role string, text string, part long, spans string, n_turns int"


def turns():
    rng = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "<\\\\|im_end|>", "\n", "assistant\n", "é漢", " ", "x", ""]
    said = lambda: "".join(rng.choices(bits, k=rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb\\", "<|im_end|>", "\\n"]), rng.choice([said(), said(), None, ""])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "assistant", "of none"), (None, None, "user", None), (7, 2, "assistant", "twice"), (7, 2, "assistant", "twice"), (900, 0, "assistant", "<|" * 700_000), (900, 1, "user", "short")]
    rows += [(901, t, "assistant" if t % 2 else "user", f"turn {t} <|im_end|>\n") for t in range(4000)]
    rng.shuffle(rows)
    return [(*r, 5, "clash", 6) for r in rows]


def told(rows):
    first = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, (x or "").encode())
    out = {}
    for key, own in itertools.groupby(sorted(rows, key=lambda r: (first(r[0]), first(r[1]), text(r[2]), text(r[3]))), key=lambda r: r[0]):
        own = list(own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[key] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize("part_chars", [1, 300, 1 << 18])
def test_conversations_read_back(spark, part_chars):
    from tidemark.llm.chat import conversation_sums, format_conversations

    rows = turns()
    parts = format_conversations(spark.createDataFrame(rows, TURNS).repartition(6), part_chars=part_chars)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in conversation_sums(parts).collect()}
    assert got == told(rows)
    if part_chars > 1:
        whole = {k: "".join(t for _, t in sorted(v)) for k, v in itertools.groupby(sorted(((r["conv_id"] or -1, (r["part"], r["text"])) for r in parts.collect()), key=lambda x: x[0]), key=lambda x: x[0]) for v in [[y for _, y in v]]}
        assert whole[901].count("<|im_start|>") == 4000 and sum(map(len, whole.values())) == sum(r["formatted_chars"] for r in conversation_sums(parts).collect())


def test_no_conversations(spark):
    from tidemark.llm.chat import conversation_sums, format_conversations

    assert conversation_sums(format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_escapes_are_reversible():
    from tidemark.llm.chat import escape, escape_role, unescape, unescape_role

    for n in range(6):
        for s in map("".join, itertools.product("<|\\\nn", repeat=n)):
            assert unescape(escape(s)) == s and "<|" not in escape(s)
            assert unescape_role(escape_role(s)) == s and "\n" not in escape_role(s) and "<|" not in escape_role(s)


def render(source, filters=None, **known):
    from tidemark.llm.templates import compile_template

    return "".join(f"[{t}]" if g else t for t, g in compile_template(source, filters)(known) if t)


@pytest.mark.parametrize(
    "source, known, text",
    [
        ("a {{ x }} b", {"x": 3}, "a 3 b"),
        ("a {{- x -}} b", {"x": None}, "ab"),
        ("{# nothing #}{{ 'q\\n' ~ 1 ~ x }}", {}, "q\n1"),
        ("{{ 1 + 2 - 4 }}{{ - 3 }}", {}, "-1-3"),
        ("{{ 'a' if x else 'b' }}{{ 'c' if not x }}", {"x": 0}, "bc"),
        ("{{ x or 'none' }}{{ y and 'yes' }}", {"y": 1}, "noneyes"),
        ("{% for m in xs %}{{ loop.index }}{{ m }}{% if not loop.last %},{% endif %}{% else %}empty{% endfor %}", {"xs": ["a", "b"]}, "1a,2b"),
        ("{% for m in xs %}{% else %}empty{% endfor %}", {"xs": []}, "empty"),
        ("{% for m in xs %}{{ loop.previous.r }}>{{ m.r }}>{{ loop.next['r'] }};{% endfor %}", {"xs": [{"r": 1}, {"r": 2}]}, ">1>2;1>2>;"),
        ("{% if x == 1 %}one{% elif x in [1] %}never{% elif x is defined %}some{% else %}none{% endif %}", {"x": 2}, None),
        ("{% if x == 1 %}one{% elif 'b' in x %}b{% elif x is none %}null{% else %}else{% endif %}", {"x": "abc"}, "b"),
        ("{% set y = x | upper %}{% generation %}{{ y }}!{% endgeneration %}.", {"x": "u"}, "[U][!]."),
        ("{{ xs[0].r }}{{ xs[5].r }}{{ xs[-1].r }}", {"xs": [{"r": 4}, {"r": 5}]}, "45"),
        ("{{ x is not none and x not in 'ab' }}", {"x": "c"}, "true"),
    ],
)
def test_templates(source, known, text):
    from tidemark.llm.templates import TemplateError

    if text is None:
        with pytest.raises(TemplateError):
            render(source, **known)
    else:
        assert render(source, **known) == text


@pytest.mark.parametrize(
    "source",
    ["{{ x.__class__ | shell }}", "{{ __import__ }}", "{{ open('f') }}", "{{ x.y() }}", "{% import os %}", "{% for x in y %}", "{% if %}{% endif %}", "{{ }}", "{{ 1 2 }}", "{% macro a() %}{% endmacro %}", "{{ 'a' + 1 }}", "{{ 'a' < 1 }}", "{{ x", "{% endfor %}", "{{ " + "(" * 60 + "1" + ")" * 60 + " }}", "{{ x is prime }}", "{{ x ** 9 }}", "{% set _x = 1 %}"],
)
def test_templates_that_do_not_compile(source):
    from tidemark.llm.templates import TemplateError, compile_template

    with pytest.raises(TemplateError):
        compile_template(source)


def test_template_stays_in_its_box():
    from tidemark.llm.templates import TemplateError

    class Thing:
        secret = "s"

    for source in ("{{ x.secret }}", "{{ x }}", "{% for y in x %}{% endfor %}"):
        with pytest.raises(TemplateError):
            render(source, x=Thing())
    assert render("{{ x.__class__ }}{{ x['__class__'] }}", x={"a": 1}) == ""


def test_folding():
    from tidemark.llm.templates import Const, For, If, Name, Out, fold, parse

    assert fold(parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{{ none }}d")) == (Out(Const("ab1cd")),)
    assert fold(parse("{% for x in y %}{{ 'a' }}{{ 'b' | upper }}{% endfor %}")) == (For("x", Name("y"), (Out(Const("aB")),), ()),)
    assert fold(parse("{% if x and (1 > 2 or true) %}a{% endif %}"))[0] == If(fold(parse("{{ x and true }}"))[0].value, (Out(Const("a")),), ())
    assert fold(parse("{{ 1 and x }}{{ 0 and x }}")) == (Out(Name("x")), Out(Const("0")))


def test_streams_are_read_ahead_and_once():
    from tidemark.llm.templates import Ahead, TemplateError, compile_template

    t = compile_template("{% if messages[0].r == 's' %}S{% endif %}{% for m in messages %}{{ m.r }}{% endfor %}")
    assert "".join(x for x, _ in t({"messages": Ahead({"r": r} for r in "sab")})) == "Ssab"
    assert "".join(x for x, _ in t({"messages": Ahead([])})) == ""
    with pytest.raises(TemplateError):
        list(compile_template("{{ messages[99] }}")({"messages": Ahead([])}))


# Phrases.

DOCS = "doc_id long, text string, lang string, phrase string, n long, words string, rank int, score string"


def corpus(seed=4, n=140):
    rng = random.Random(seed)
    vocab = ["the", "of", "New", "york", "é", "漢字", "x-y", "don't", "\x1c", "a", "Ünder", "b2"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([["new", "York", "city"], ["of", "the"], [rng.choice(vocab)], [rng.choice(vocab)], ["machine", "learning", "is", "fun"]])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for w in words)
        rows.append((i, rng.choice([text, text, text, text, None, ""]), rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [(n, "loud noise " * 9000, "en"), (n, "loud noise " * 30, "xx"), (None, "loud noise " * 30, "xx"), (n + 1, "a b c d " * 31, "yy"), (n + 1, "a b c d " * 31, "yy"), (n + 2, "", "zz"), (n + 3, None, "zy")]
    return [(*r, "clash", 1, "w", 2, "s") for r in rows]


def mined(rows, least, most, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split(fold(text or "")):
            w = WORD.findall(piece)
            totals[lang] += len(w)
            for k in range(1, most + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        held = {q[i : i + k] for q, f in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * f >= 80 * own[q[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in held:
                score, _, left, right = min((int(Decimal(2_000_000) * a // (own[p[:k]] + own[p[k:]])), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, most, top, count_bytes, bits", [(3, 4, 2000, 1 << 21, 1 << 29), (4, 4, 5, 200, 1 << 29), (30, 4, 2000, 1 << 12, 1 << 29), (2, 5, 2000, 1 << 21, 8)])
def test_collocations(spark, monkeypatch, least, most, top, count_bytes, bits):
    from tidemark.llm import phrases

    monkeypatch.setattr(phrases, "COUNT_BYTES", count_bytes)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, most, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    want = mined(rows, least, most, top)
    assert got == want and len(want) > 5


def test_collocations_of_nothing(spark):
    from tidemark.llm.phrases import collocations

    assert collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, "", 1, "", 1, "")], DOCS)).count() == 0


# Spelling.

SPELLED = "doc_id long, text string, word string, n long, form string, root string, m int, side string"


def spelled(rows, spoilt, letters=6, least=5):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % spoilt else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= least}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) > len(b):
            a, b = b, a
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    close = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: (c[0] if c and n[c[0]] >= 5 * n[w] else None) for w, c in close.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None)
    return out


def scribbles(seed=8):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abé", k=rng.randint(5, 9))) for _ in range(90)] + ["ÀBCdefgh", "straße×÷", "aaaaaaa", "aaaaaaaa", "aaaaaab", "x" * 40, "x" * 41]
    words = list(base)
    for w in base:
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcÿ") + w[i + 1 :], w[:i] + rng.choice("abcÿ") + w[i:]]))
    rows = []
    for i in range(160):
        text = "".join(rng.choice(base[:12] if rng.random() < 0.7 else words).title() + rng.choice([" ", "-", "1", "ō", "'"]) for _ in range(rng.randint(0, 60)))
        rows.append((i if i % 9 else None, rng.choice([text, text, text, None, ""])))
    rows += [(500, "q" * 3000 + " "), (501, ("q" * 3000 + " ") * 30), (501, ("q" * 3000 + " ") * 30), (502, ("q" * 3001 + " ") * 6)]
    rows += [(600 + i, " ".join([w] * k)) for i, at in enumerate(["linked", "winter", "summer"]) for w, k in ((at, 5), (at + "s", 30), (at + "sy", 200), (at + "syx", 1100))]
    return rows


@pytest.mark.parametrize("block, scan_rows", [(64, 8192), (3, 8192), (0, 10), (10, 50)])
def test_spelling(spark, monkeypatch, block, scan_rows):
    from tidemark.llm import spelling

    monkeypatch.setattr(spelling, "SCAN_ROWS", scan_rows)
    rows = scribbles()
    docs = spark.createDataFrame([(*r, "clash", 3, "f", "r", 1, "s") for r in rows], SPELLED).repartition(5)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_groups(spelling.vocabulary(docs, spoilt=7), block=block).collect()}
    want = spelled(rows, 7)
    assert got == want
    assert sum(f is not None for f, *_ in want.values()) > 5 and any(f and f != r for f, r, *_ in want.values())


def test_spelling_of_one_hot_half(spark):
    """A third of all words in one block: it is subdivided, and candidates stay far below all pairs."""
    from tidemark.llm import spelling

    rng = random.Random(2)
    words = {"prefix" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(1500)} | {"".join(rng.choices("abcdefgh", k=9)) for _ in range(2500)}
    n = {w: rng.randint(5, 400) for w in words}
    got = {(r["word"], r["near"]) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    variants = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            variants[i, w[:i] + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                variants["in", w, i] = {w, w[:i] + w[i + 1 :]}
    assert got == {(a, b) for own in variants.values() for a in own for b in own if a != b} and len(got) > 100


def test_spelling_of_nothing(spark):
    from tidemark.llm import spelling

    empty = spark.createDataFrame([], SPELLED)
    assert spelling.spelling_groups(spelling.vocabulary(empty)).count() == 0
    assert spelling.spelling_groups(spelling.vocabulary(spark.createDataFrame([(1, None, "", 1, "", "", 1, "")], SPELLED))).count() == 0

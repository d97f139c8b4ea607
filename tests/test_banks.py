"""Rules of question banks: one sound bank, and one fault of each kind in a bank of its own."""

import copy
import hashlib
import json

import pytest

from tidemark.operators import banks as B

SHA = "a" * 64


def question(n, **more):
    return {
        "question_id": f"q-{n:02d}", "bank_id": "bk", "question_type": "single_choice", "difficulty": "basic", "scope": "chapter", "unit_key": "u", "local_number": n, "stem_md": "stem",
        "options": [{"label": "A", "text_md": "one"}, {"label": "B", "text_md": "two"}], "correct_answers": ["A"], "knowledge_ids": ["x.k1"], "source_refs": [{"source_id": "s1", "block_id": "b1"}],
        "source_analysis_md": f"because {n}", "status": "ready", "transformations": [{"type": "ocr_fix", "reason": "scan"}],
    } | more


def sound():
    return {
        "manifest": {
            "schema_version": 1, "bank": dict.fromkeys(("title", "domain", "subject", "resource_type"), "t") | {"id": "bk", "status": "ready"}, "question_count": 3, "question_type_counts": {"single_choice": 2, "multiple_choice": 1},
            "quarantined_count": 1, "sources": [{"source_id": "s1", "filename": "f", "sha256": SHA, "role": "primary"}], "quality": {"status": "pass", "blocker_count": 0, "warning_count": 0},
        },
        "index": {"index_version": 1, "bank_id": "bk", "sources": [{"source_id": "s1", "filename": "f", "display_name": "F", "sha256": SHA, "role": "primary", "blocks": [{"block_id": "b1", "start_line": 1, "end_line": 2, "page": "3"}]}]},
        "map": {"map_version": 1, "bank_id": "bk", "entries": [{"knowledge_id": "x.k1", "kind": "topic", "label": "l", "path": ["p"], "source_ref": {"source_id": "s1", "block_id": "b1"}}]},
        "formal": [question(1), question(2), question(3, question_type="multiple_choice", correct_answers=["A", "B"])],
        "held": [question(9, status="quarantined", local_number=None)],
        "reasons": {"bank_id": "bk", "reasons": [{"question_id": "q-09", "reason": "blurred"}]},
    }


def put(*path):
    """A fault: the value at the end of the path is set; the rest of the bank stays."""

    def change(bank):
        *way, last, value = path
        for step in way:
            bank = bank[step]
        if value is Ellipsis:
            del bank[last]
        elif isinstance(bank, list) and last == len(bank):
            bank.append(value)
        else:
            bank[last] = value

    return change


Q, H, M, I, K, R = ("formal", 0), ("held", 0), ("manifest",), ("index",), ("map",), ("reasons",)
S, BL, E = ("index", "sources", 0), ("index", "sources", 0, "blocks", 0), ("map", "entries", 0)
CLOZE = "Mark on the answer sheet. " + " ".join(f"a {n} b" for n in range(1, 21))
LONG = "z" * 200

# what a fault gives besides E033, with how often
FAULTS = [
    (put("manifest", "no json {"), {"E001/E002": 1, "E007": 1, "E008": 1, "E042": 3, "E043": 1}), (put("manifest", [1]), {"E002": 1, "E007": 1, "E008": 1, "E042": 3, "E043": 1}),
    (put(*M, "schema_version", "1"), {"E003": 1}), (put(*M, "bank", "title", " "), {"E004": 1}), (put(*M, "bank", "status", "draft"), {"E004": 1}), (put(*M, "bank", "status", 3), {"E004": 2}),
    (put(*M, "questions", 5), {"E005": 1}), (put(*M, "questions", {"path": "none.jsonl", "sha256": SHA}), {"E005": 1, "E009": 1}), (put(*M, "source_index", {"path": "source-index.json", "sha256": SHA}), {"E009": 1}),
    (put("formal", 3, "{broken"), {"E006": 1}), (put("formal", 3, [1, 2]), {"E037": 1}), (put(*M, "question_count", 4), {"E007": 1}), (put(*M, "question_count", "3"), {"E007": 1}),
    (put(*M, "question_type_counts", {"single_choice": 3}), {"E008": 1}), (put(*M, "question_type_counts", ...), {"E008": 1}), (put("map", None), {"E005": 1, "E010": 1, "E022": 4}), (put(*K, "entries", {}), {"E010": 1, "E022": 4}),
    (put(*K, "entries", 1, 7), {"E010": 1}), (put("index", None), {"E005": 1, "E011": 1, "E024": 4, "W014": 1}), (put(*M, "sources", {}), {"E012": 1}), (put(*M, "sources", 0, 1), {"E012": 1}),
    (put(*M, "sources", 0, "role", "other"), {"E012": 2}), (put(*M, "sources", 0, "source_id", "s9"), {"E012": 1}), (put(*Q, "question_id", "Bad_Id"), {"E013": 1}), (put(*Q, "question_id", "q-02"), {"E014": 1}),
    (put(*Q, "question_type", 3), {"E015": 1, "E008": 1}), (put(*Q, "stem_md", "　 "), {"E016": 1}), (put(*Q, "options", [{"label": "A", "text_md": "x"}]), {"E017": 1, "E019": 1}),
    (put(*Q, "options", 1, {"label": "b", "text_md": ""}), {"E017": 3}), (put(*Q, "options", 1, {"label": "A", "text_md": "x"}), {"E017": 2}), (put(*Q, "options", 1, "B"), {"E017": 2}), (put(*Q, "correct_answers", []), {"E018": 1}),
    (put(*Q, "correct_answers", [1]), {"E018": 1}), (put(*Q, "correct_answers", ["C"]), {"E019": 1}), (put(*Q, "correct_answers", ["A", "A"]), {"E020": 1, "W009": 1}), (put(*Q, "knowledge_ids", "x.k1"), {"E021": 1}),
    (put(*Q, "knowledge_ids", ["X.k", 4, "x.k1"]), {"E021": 2}), (put(*Q, "knowledge_ids", ["x.k2", "x.k2"]), {"E022": 2}), (put(*Q, "source_refs", []), {"E023": 1}), (put(*Q, "source_refs", 8), {"E024": 1, "E023": 1}),
    (put(*Q, "source_refs", [{"source_id": "s1"}, 5, {"source_id": "s1", "block_id": "b7"}, {"source_id": "s4", "block_id": "b1"}]), {"E024": 4}), (put(*Q, "source_analysis_md", None), {"E025": 1}), (put(*Q, "status", "draft"), {"E026": 1}),
    (put(*Q, "transformations", ...), {"E027": 1}), (put(*Q, "transformations", [{"type": "odd"}, 4, {"type": "", "reason": ""}]), {"E027": 4, "W016": 2}), (put(*Q, "local_number", 2), {"E028": 1}), (put(*H, "question_id", "q-01"), {"E029": 1, "E032": 1, "W012": 1}),
    (put("held", 1, "{"), {"E030": 1}), (put("held", 1, 4), {"E030": 1}), (put(*H, "status", "ready"), {"E030": 1}), (put(*M, "quarantined_count", 2), {"E030": 1}), (put("held", 1, question(9, status="quarantined")), {"E030": 2}),
    (put("reasons", None), {"E031": 1, "E032": 1}), (put("reasons", [1]), {"E031": 1, "E032": 1}), (put(*R, "reasons", 3), {"E032": 2}), (put(*R, "reasons", 0, "reason", " "), {"E032": 1}), (put(*R, "reasons", 1, 5), {"E032": 1}),
    (put(*K, "entries", 1, {"knowledge_id": "x.k1", "kind": "topic", "label": "l", "path": ["p"]}), {"E034": 1}), (put(*K, "entries", 1, {"knowledge_id": "solo"}), {"E035": 1}), (put(*I, "index_version", 2), {"E038": 1}), (put(*K, "map_version", None), {"E054": 1}),
    (put(*K, "bank_id", "zz"), {"E039": 1}), (put(*I, "bank_id", 4), {"E040": 1}), (put(*R, "bank_id", "zz"), {"E041": 1}), (put(*Q, "bank_id", ""), {"E042": 1}), (put(*H, "bank_id", "zz"), {"E043": 1}),
    (put(*I, "sources", 5), {"E044": 1, "E024": 4, "E012": 1, "W014": 1}), (put(*I, "sources", 1, {"source_id": ""}), {"E045": 1, "E047": 4, "E048": 1}), (put(*I, "sources", 1, 6), {"E045": 1}), (put(*I, "sources", 1, sound()["index"]["sources"][0]), {"E046": 1}), (put(*S, "display_name", ""), {"E047": 1}), (put(*S, "sha256", "XY"), {"E047": 1, "E012": 1}),
    (put(*S, "blocks", {}), {"E048": 1, "E024": 4, "W014": 1, "W008": 1}), (put(*S, "blocks", 1, {"block_id": 3, "start_line": 1, "end_line": 1}), {"E049": 1}), (put(*S, "blocks", 1, {"block_id": "b1", "start_line": 1, "end_line": 1}), {"E050": 1}),
    (put(*BL, "start_line", 0), {"E051": 1}), (put(*BL, "end_line", True), {"E051": 1}), (put(*BL, "start_line", 5), {"E052": 1}), (put(*BL, "page", 3), {"E053": 1}), (put(*Q, "local_number", 0), {"E055": 1}), (put(*Q, "local_number", 1.5), {"E055": 1}), (put(*Q, "local_number", 1.0), {"E055": 1}),
    (put(*Q, "stem_md", "关注公众号 now"), {"E056": 1}), (put(*Q, "distractor_analysis_md", {"A": "![x](y)", "B": 4}), {"E057": 1}), (put(*Q, "context_md", 4), {"E058": 1}), (put(*K, "entries", 1, {"knowledge_id": "x.k2", "kind": "topic", "label": "l", "path": ["p"]}), {"W001": 1}),
    (put(*Q, "knowledge_ids", []), {"W002": 1}), (put(*H, "correct_answers", []), {"W003": 1}), (put("formal", 2, "correct_answers", ["B"]), {"W003": 1}), (put(*H, "options", 1, "text_md", ""), {"W004": 1}), (put(*Q, "distractor_analysis_md", "x"), {"W005": 1}),
    (put(*H, "stem_md", ""), {"W007": 1}), (put(*H, "source_refs", []), {"W007": 1}), (put(*S, "blocks", []), {"W008": 1, "E024": 4, "W014": 1}), (put(*Q, "difficulty", "odd"), {"W010": 1}), (put(*Q, "difficulty", ...), {"W010": 1}), (put(*Q, "scope", "odd"), {"W011": 1}), (put(*Q, "scope", ...), {}),
    (put(*R, "reasons", 1, {"question_id": "q-77", "reason": "r"}), {"W012": 1}), (put(*Q, "local_number", ...), {"W013": 1}), (put(*E, "source_ref", 4), {"W014": 1}), (put(*E, "source_ref", "block_id", "b9"), {"W014": 1}), (put(*E, "kind", "odd"), {"W015": 1}), (put(*E, "path", ["p", ""]), {"W017": 1}), (put(*E, "label", None), {"W018": 1}),
    (put(*H, "stem_md", "QQ群"), {"W019": 1}), (put(*H, "stem_md", "![x](y)"), {"W020": 1}), (put("formal", [question(n, unit_key="use-of-english", context_md="10 points, answer sheet 1 2 3 x4y 155") for n in (1, 2)] + [question(3, question_type="multiple_choice", correct_answers=["A", "B"])]), {"W021": 1}),
    (put("formal", [question(n, unit_key="use-of-english", context_md=CLOZE) for n in (1, 2)] + [question(3, question_type="multiple_choice", correct_answers=["A", "B"])]), {}),
    (put(*Q, "source_analysis_md", "配套" * 8), {"W022": 1}), (put(*Q, "source_analysis_md", "�.�.�"), {"W022": 1}), (put(*Q, "source_analysis_md", B.GUARD + "音频" * 9), {}), (put("formal", [question(n, source_analysis_md=LONG) for n in (1, 2)] + [question(3, question_type="multiple_choice", correct_answers=["A", "B"])]), {"W022": 2}),
    (put(*M, "quality", {"status": "warning", "blocker_count": 0, "warning_count": 0}), {"E033": 1}), (put(*M, "quality", {"status": "pass", "blocker_count": 0, "warning_count": 2}), {"E033": 2}), (put(*M, "quality", ...), {"E033": 1}), (put("formal", None), {"E005": 2}), (put("held", None), {"E030": 1}),
]


def texts(bank):
    """The files of a bank by path; the manifest declares the other files' hashes unless the fault did."""
    dumps = lambda x: x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    out = {p: dumps(bank[k]) for k, p in (("index", B.INDEX), ("map", B.MAP), ("reasons", B.REASONS)) if bank[k] is not None}
    out |= {p: "\n\n".join(map(dumps, bank[k])) + "\n" for k, p in (("formal", B.FORMAL), ("held", B.HELD)) if bank[k] is not None}
    sha = lambda p: hashlib.sha256(out.get(p, "").encode()).hexdigest()
    if isinstance(bank["manifest"], dict):
        for name, p in (("questions", B.FORMAL), ("source_index", B.INDEX), ("knowledge_map", B.MAP)):
            bank["manifest"].setdefault(name, {"path": p, "sha256": sha(p)})
    return out | {B.MANIFEST: dumps(bank["manifest"])}


def as_files(spark, banks):
    rows = [(name, p, hashlib.sha256(t.encode()).hexdigest(), t) for name, bank in banks.items() for p, t in texts(bank).items()]
    return spark.createDataFrame(rows, "bank string, path string, sha256 string, text string")


@pytest.fixture(scope="module")
def found(spark):
    banks = {"sound": sound()}
    for i, (change, _) in enumerate(FAULTS):
        banks[f"{i:03d}"] = copy.deepcopy(sound())
        change(banks[f"{i:03d}"])
    files = as_files(spark, banks)
    got = B.validate(files, B.file_lines(files), spark.createDataFrame([("sound",), ("absent",)], "bank string"))
    out = {}
    for r in got.groupBy("bank", "code").agg(B.F.sum("n").alias("n")).collect():
        out.setdefault(r["bank"], {})[r["code"]] = r["n"]
    return out


def test_sound_bank_passes(found):
    assert "sound" not in found and found["absent"] == {"E001": 1}


def test_each_fault_is_found_as_often_as_it_occurs(found):
    wrong = []
    for i, (_, want) in enumerate(FAULTS):
        got = dict(found.get(f"{i:03d}", {}))
        if "E033" not in want:
            got.pop("E033", None)
        if got != want:
            wrong.append((i, got, want))
    assert not wrong


def test_verdicts_totals_and_empty_tables(spark):
    warned = sound()
    warned["formal"][0]["scope"] = "odd"
    warned["manifest"]["quality"] = {"status": "warning", "blocker_count": 0, "warning_count": 1}
    files = as_files(spark, {"good": sound(), "warned": warned})
    lines = B.file_lines(files)
    got = B.validate(files, lines)
    assert [(r["bank"], r["place"], r["severity"], r["code"], r["n"]) for r in got.collect()] == [("warned", "questions.jsonl:1", "warning", "W011", 1)]
    assert sorted(tuple(r) for r in B.verdicts(files, got).collect()) == [("good", 0, 0, "pass"), ("warned", 0, 1, "warning")]
    assert sorted(tuple(r) for r in B.totals(B.questions(lines)).collect()) == [("good", 3, 1, 3, 3), ("warned", 3, 1, 3, 3)]
    assert B.validate(files.limit(0), lines.limit(0)).count() == 0

"""Passages that an earlier document already has, located by Aho-Corasick automata.

A word goes if a window of WINDOW words around it also starts in a document with a
smaller doc_id. The steps:

1.  Each window has an anchor, the smallest hash among its PHRASE-word phrases. Equal
    windows have equal anchors. Anchors seen in two documents set bits of a bitmap,
    whose size follows the text up to MOST_BITS; it only spares work: the fuller it is,
    the more windows are counted, and the result stays the same.
2.  Consecutive windows with one such anchor are a run, known by a hash of its words. Of
    equal runs that of the smallest document alone shows its windows, so that copies cost
    a row for each run. Windows are then counted by their hash: the smallest document that
    has one owns it. Owned windows are confirmed passages, cut out of their owners' texts
    in segments of SEGMENT windows.
3.  Documents are dealt to shards of about SHARD_BYTES by a hash. A shard is sent the
    segments whose windows its documents have, each once, however many of them.
4.  A shard compiles the anchor phrases of its segments into an automaton, streams all of
    its documents through it, and lays each document against a segment at every hit. Where
    WINDOW words or more agree, byte by byte, and the segment's owner is smaller, the words
    go. A phrase that is not hit removes nothing.

A passage that a third of all documents share is counted in each task first, owned once,
and sent to each shard once. Defined results: null, empty and blank texts have no words;
rows with one doc_id never cover each other, and equal such rows fare alike; a null doc_id
counts as the largest; an empty table gives no rows; other columns pass, but for columns
named n_words, n_removed, kept_sha256 or kept_text, which the results replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bitmap import bitmap, in_bitmap
from tidemark.llm.shared import text_bytes, written
from tidemark.llm.words import Words, chunks, mix, release, words

WINDOW = 50
PHRASE = 8
SEGMENT = 128
SHARD_BYTES = 3 << 17
TASK_BYTES = 32 << 20
MOST_BITS = 1 << 29
_LAST = (1 << 63) - 1
_MARK = np.uint64(0x9E3779B97F4A7C15)


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: the hash of the window from it on, whether the window fits, and its anchor."""
    code, fits = w.windows(WINDOW)
    low = w.windows(PHRASE)[0]
    if len(low) < WINDOW:  # no window fits, and the slices below would turn over
        return code, fits, low.view(np.int64)
    span, width = WINDOW - PHRASE + 1, 1
    while 2 * width <= span:
        low[: len(low) - width] = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = span - width
    out = low.copy()
    if 0 < rest < len(low):
        out[: len(low) - rest] = np.minimum(low[: len(low) - rest], low[rest:])
    return code, fits, out.view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw in chunks(batches):
        w = words(raw)
        _, fits, anchor = anchors(w)
        keys = np.array(batch.column("doc_id").to_pylist(), np.int64)[w.doc]
        anchor, keys = anchor[fits], keys[fits]
        order = np.lexsort((keys, anchor))
        anchor, keys = anchor[order], keys[order]
        first = np.flatnonzero(np.diff(anchor, prepend=~anchor[:1])) if len(anchor) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(anchor)) - 1 if len(first) else first
        yield pa.record_batch([pa.array(anchor[first]), pa.array(keys[first]), pa.array(keys[last])], ["anchor", "low", "high"])


def recurring_bits(docs: DataFrame, total_bytes: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """A bitmap over the anchors of two documents or more."""
    found = (
        docs.mapInArrow(_anchor_rows, "anchor long, low long, high long")
        .groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("anchor")
    )
    return bitmap(found, "anchor", total_bytes // 16, most_bits)


def _runs(w: Words, bits: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of windows whose anchor may recur: code, mark (of code and document), text, first window and number of windows."""
    code, fits, anchor = anchors(w)
    pos = np.flatnonzero(fits & in_bitmap(bits, anchor))
    doc = w.doc[pos]
    new = np.ones(len(pos), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (anchor[pos[1:]] != anchor[pos[:-1]])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(pos)))
    unit = w.between(pos[at], pos[at] + size + WINDOW - 1)
    return unit.view(np.int64), mix(unit + keys[doc[at]].view(np.uint64) * _MARK).view(np.int64), doc[at], pos[at], size


def runs_of(docs: DataFrame, shared) -> DataFrame:
    """(unit, mark, doc_id, shard): a row for each run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches):
            keys = np.array(batch.column("doc_id"), np.int64)
            unit, mark, doc, _, _ = _runs(words(raw), shared.value, keys)
            yield pa.record_batch([pa.array(x) for x in (unit, mark, keys[doc], np.asarray(batch.column("shard"))[doc])], ["unit", "mark", "doc_id", "shard"])

    return docs.mapInArrow(run, "unit long, mark long, doc_id long, shard int")


def windows_of(docs: DataFrame, shared, marks) -> DataFrame:
    """(code, unit, doc_id, at): the windows of the runs whose mark is in the bitmap marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches):
            w, keys = words(raw), np.array(batch.column("doc_id"), np.int64)
            unit, mark, doc, at, size = _runs(w, shared.value, keys)
            unit, doc, at, size = (x[in_bitmap(marks.value, mark)] for x in (unit, doc, at, size))
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            code = w.windows(WINDOW)[0][np.repeat(at, size) + inside].view(np.int64)
            yield pa.record_batch([pa.array(x) for x in (code, np.repeat(unit, size), np.repeat(keys[doc], size), (np.repeat(at - w.first[doc], size) + inside).astype(np.int32))], ["code", "unit", "doc_id", "at"])

    return docs.mapInArrow(run, "code long, unit long, doc_id long, at int")


def segments(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, segment, passage): the text of each segment that is asked for, words joined by a space; of each row, where rows share a doc_id."""
    spans = asked.groupBy("doc_id", "segment").agg(F.min("low").alias("lo"), (F.max("high") + WINDOW).alias("hi"))
    per_doc = written(spans.groupBy("doc_id").agg(F.collect_list(F.struct("segment", "lo", "hi")).alias("spans")))  # as many as a text has segments
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(per_doc, "doc_id", 32 * per_doc.count(), MOST_BITS))

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, np.asarray(batch.column("doc_id")))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches):
            n, rows = Normal(raw), []
            for a, b, k, spans in zip(n.first[:-1].tolist(), n.first[1:].tolist(), batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                rows += [(k, s["segment"], n.text(a + s["lo"], min(b, a + s["hi"]))) for s in spans]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "segment", "passage"])

    # dealt anew, as two steps in Python in one task would be two workers
    some = docs.select("doc_id", "text").mapInArrow(owners, "doc_id long, text string").repartition("doc_id")
    return some.join(per_doc, "doc_id").mapInArrow(cut, "doc_id long, segment int, passage binary").distinct()


class Normal(Words):
    """Words of texts, and the texts with each word followed by one space, and led in by a line feed and a space."""

    def __init__(self, raw: list[bytes]) -> None:
        w = words(raw)
        super().__init__(w.buf, w.start, w.end, w.first, w.code)
        size = self.end - self.start + 1
        lead = np.zeros(len(size) + 1, np.int64)
        np.add.at(lead, self.first[:-1], 2)
        self.at = np.cumsum(np.append(0, size)) + np.cumsum(lead)  # of each word, and of what would follow the last
        data, out = np.frombuffer(self.buf, np.uint8), np.full(int(self.at[-1]), 0x20, np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[self.start] = 1
        inside[self.end] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        length = size - 1
        out[np.repeat(self.at[:-1] - np.cumsum(length) + length, length) + np.arange(length.sum())] = data[inside]
        out[(self.at[self.first[:-1]] - 2)] = 0x0A
        self.norm = out.tobytes()

    def text(self, a: int, b: int) -> bytes:
        """Words a to b of one text, joined by a space."""
        return self.norm[self.at[a] : self.at[b - 1] + self.end[b - 1] - self.start[b - 1]] if b > a else b""


def automaton(n: Normal):
    """Of the anchor phrases of segments: the automaton, and for phrase i the words begin[i]:begin[i + 1] of word at which it starts."""
    import ahocorasick

    code, fits, anchor = anchors(n)
    phrase, whole = n.windows(PHRASE)
    at = np.flatnonzero(whole & np.isin(phrase.view(np.int64), anchor[fits]))
    order = at[np.argsort(phrase[at], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = phrase[order][1:] != phrase[order][:-1]
    begin = np.append(np.flatnonzero(new), len(order))
    out = ahocorasick.Automaton()
    for i, w in enumerate(order[new].tolist()):  # bytes as letters, so that places are bytes; spaces on both sides, so that words are whole
        pattern = n.norm[n.at[w] - 1 : n.at[w + PHRASE - 1] + n.end[w + PHRASE - 1] - n.start[w + PHRASE - 1] + 1].decode("latin-1")
        out.add_word(pattern, (i, len(pattern)))
    if len(order):
        out.make_automaton()
    return (out if len(order) else None), begin, order


def covered_words(docs: Normal, keys: np.ndarray, passages: Normal, owners: np.ndarray) -> np.ndarray:
    """Whether each word of docs lies in WINDOW words that a passage of a smaller owner has. Only phrases that the automaton hits are looked at."""
    steps = np.zeros(len(docs.code) + 1, np.int64)
    find, begin, where = automaton(passages)
    if find is None or not len(docs.code):
        return steps[:-1] > 0
    hits = np.array([(end - size + 2, i) for end, (i, size) in find.iter(docs.norm.decode("latin-1"))], np.int64).reshape(-1, 2)
    at, which = np.searchsorted(docs.at[:-1], hits[:, 0]), hits[:, 1]
    count = begin[which + 1] - begin[which]
    other = where[np.repeat(begin[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    at = np.repeat(at, count)
    doc, passage = docs.doc, passages.doc
    earlier = owners[passage[other]] < keys[doc[at]]
    at, other = at[earlier], other[earlier]
    own, own_fits = docs.windows(WINDOW)
    theirs, their_fits = passages.windows(WINDOW)
    found = []
    for back in range(WINDOW - PHRASE + 1):
        a, b = at - back, other - back
        ok = (a >= docs.first[doc[at]]) & (b >= passages.first[passage[other]])
        a, b = a[ok], b[ok]
        ok = own_fits[a] & their_fits[b] & (own[a] == theirs[b])
        found.append(((a[ok] - b[ok] + len(passages.code)) << 32) | a[ok])
    lined = np.unique(np.concatenate(found))  # by how far passage and text are apart, then by place
    starts = np.flatnonzero(np.diff(lined, prepend=-2) != 1)
    many = np.diff(np.append(starts, len(lined))).tolist()
    for shift, a, n in zip(((lined[starts] >> 32) - len(passages.code)).tolist(), (lined[starts] & 0xFFFFFFFF).tolist(), many, strict=True):
        if docs.text(a, a + n + WINDOW - 1) == passages.text(a - shift, a - shift + n + WINDOW - 1):
            steps[a] += 1
            steps[a + n + WINDOW - 1] -= 1
    return np.cumsum(steps)[:-1] > 0


def _kept(docs: Normal, gone: np.ndarray) -> dict[str, pa.Array]:
    """Per text: words, words that go, the digest of the kept words, and the text without the others."""
    lost = np.concatenate([[0], np.cumsum(gone)])[docs.first]
    sha, text = [], []
    for a, b, n in zip(docs.first[:-1].tolist(), docs.first[1:].tolist(), np.diff(lost).tolist(), strict=True):
        if not n:
            sha.append(hashlib.sha256(docs.text(a, b)).hexdigest())
            text.append(None)
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], gone[a:b], [1]]).astype(np.int8))) + a
        runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        sha.append(hashlib.sha256(b" ".join([docs.text(x, y) for x, y in runs])).hexdigest())
        text.append(b" ".join([docs.buf[docs.start[x] : docs.end[y - 1]] for x, y in runs]).decode())  # with the white space inside a run
    return {"n_words": pa.array(np.diff(docs.first), pa.int64()), "n_removed": pa.array(np.diff(lost), pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(text, pa.string())}


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """df with n_words, n_removed, kept_sha256 (of the kept words, joined by a space) and kept_text (the text without the others)."""
    new = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    df = df.drop(*new, "_key", "_shard")
    total = text_bytes(df, text)
    shards = shards or max(1, -(-total // SHARD_BYTES))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    marked = df.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(_LAST)))
    marked = marked.withColumn("_shard", F.pmod(F.xxhash64("_key", text), F.lit(shards)).cast("int"))
    docs = marked.select(F.col("_key").alias("doc_id"), F.col("_shard").alias("shard"), F.col(text).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(recurring_bits(docs, total))
    units = written(runs_of(docs, shared))
    first = written(units.groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.min_by("mark", "doc_id").alias("mark")).select("mark"))
    marks = df.sparkSession.sparkContext.broadcast(bitmap(first, "mark", 16 * first.count(), MOST_BITS))
    shown = written(windows_of(docs, shared, marks))
    owner = shown.groupBy("code").agg(F.min("doc_id").alias("doc_id"), F.min_by("at", "doc_id").alias("at"))
    # of each run, the segments that its windows are owned by
    owned = shown.select("code", "unit").join(owner, "code").groupBy("unit", "doc_id", F.floor(F.col("at") / SEGMENT).cast("int").alias("segment")).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    asked = units.select("unit", "shard", F.col("doc_id").alias("asker")).join(owned, "unit").where("asker > doc_id")
    asked = written(asked.groupBy("shard", "doc_id", "segment").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    sent = asked.join(segments(docs, asked), ["doc_id", "segment"]).select(F.col("shard").alias("_shard"), F.col("doc_id").alias("owner"), "passage")
    schema = T.StructType([*df.schema.fields]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")

    def run(rows: pa.Table, passages: pa.Table) -> pa.Table:
        raw = [x or b"" for x in rows.column(text).cast(pa.large_binary()).to_pylist()]
        docs = Normal(raw)
        gone = covered_words(docs, np.asarray(rows.column("_key")), Normal(passages.column("passage").to_pylist()), np.asarray(passages.column("owner")))
        own = _kept(docs, gone)
        whole = pa.compute.fill_null(rows.column(text).cast(pa.string()), "")
        own["kept_text"] = pa.compute.coalesce(pa.chunked_array([own["kept_text"]]), whole)
        del docs, raw
        release()
        return pa.table([own[f.name] if f.name in own else rows.column(f.name) for f in schema], [f.name for f in schema])

    left, right = (x.repartition(tasks, "_shard").groupBy("_shard") for x in (marked, sent))
    return left.cogroup(right).applyInArrow(run, schema)


def op2_automata_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")

"""All documents whose word shingles have a Jaccard similarity of 0.75 or more, by a token-group matrix.

Documents with equal shingle sets are one set. Shingles are ordered: those that many
sets have come last, the rest by hash. Linked sets share one of their first
floor(n / 4) + 1 shingles in any such order, so the matrix holds these alone, and only
where two sets have them. The steps:

1.  A set joins the group of its most shared shingle and of its size (to GROWTH).
2.  The matrix has a row for each shingle and group: the union of its members' shingles.
3.  A set's row count against a group bounds its overlap with every member: what is not
    among the first shingles can add n - floor(n / 4) - 1 at most. Of a linked pair, the
    set whose first shingles end earlier always meets the bound, so no link is lost.
4.  Groups that meet the bound are opened: their sets, in blocks of members and of
    queries, are compared exactly. Each block gives a spanning forest of its links.
5.  Components of the forests name the groups of copies.

The list of common shingles is bounded by MOST_COMMON; it orders, and decides nothing.

Defined results: null, empty and blank texts have no shingles and no links; a text of
fewer words than a shingle is one shingle; repeated rows and equal texts are linked; a
null doc_id is in no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bitmap import bitmap, in_bitmap
from tidemark.llm.components import components
from tidemark.llm.shared import text_bytes, texts, written
from tidemark.llm.words import chunks, release, words

SHINGLE = 5
COMMON_SETS = 32
MOST_COMMON = 1 << 18
PART_TEXT_BYTES = 16 << 20
GROWTH = 1.08
MEMBERS = 1024
QUERIES = 4096
OPEN_BYTES = 16 << 20
#: of the bitmap of documents to open; a full one opens more than it must
MOST_BITS = 1 << 29
_FLUSH = 1_000_000
_COMMON_BIT = 1 << 62


def shingle_sets(batches: Iterator[pa.RecordBatch], k: int = SHINGLE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Per chunk of texts: its rows, all sets' shingles (sorted within a set), and where each row's begin. 62-bit codes."""
    for batch, raw in chunks(batches):
        w = words(raw, fold=True)
        code, fits = w.windows(k)
        size = np.diff(w.first)
        for n in range(1, k):  # a short text is one shingle
            short = w.first[:-1][size == n]
            if len(short):
                code[short], fits[short] = w.windows(n)[0][short], True
        doc, code = w.doc[fits], (code[fits] >> np.uint64(2)).astype(np.int64)
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        yield batch, code[new], np.searchsorted(doc[new], np.arange(len(size) + 1))


def _set_ids(code: np.ndarray, at: np.ndarray) -> list[int | None]:
    return [int.from_bytes(hashlib.blake2b(code[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set): a set's id is a hash of its shingles; null without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, code, at in shingle_sets(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(_set_ids(code, at), pa.int64())], ["doc_id", "n", "set"])

    return docs.mapInArrow(run, "doc_id long, n long, set long")


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray], bool]]:
    """Set ids and shingles in pieces of about _FLUSH shingles; equal sets of a piece come once."""
    held: dict[int, np.ndarray] = {}
    total = 0
    for _, code, at in shingle_sets(batches):
        for s, a, b in zip(_set_ids(code, at), at[:-1].tolist(), at[1:].tolist(), strict=True):
            if s is not None and s not in held:
                held[s] = code[a:b]
                total += b - a
        if total > _FLUSH:
            yield list(held), list(held.values()), True
            held, total = {}, 0
    yield list(held), list(held.values()), False


def common_shingles(docs: DataFrame, least: int = COMMON_SETS, most: int = MOST_COMMON) -> np.ndarray:
    """Sorted codes of the most common shingles: those that recur within tasks, with their counts over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, _ in _fresh(batches):
            code, n = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
            yield pa.record_batch([pa.array(code[n > 1]), pa.array(n[n > 1])], ["code", "n"])

    total = docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.array(sorted(r["code"] for r in total.orderBy(F.desc("n"), "code").limit(most).select("code").collect()), np.int64)


def shared_firsts(docs: DataFrame, common: np.ndarray, parts: int) -> DataFrame:
    """(token, set, sets): the first shingles of every set that two sets or more have, and how many have each."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for ids, codes, _ in _fresh(batches):
            size = np.fromiter(map(len, codes), np.int64, len(codes))
            code, of = np.concatenate([np.zeros(0, np.int64), *codes]), np.repeat(np.arange(len(ids)), size)
            if len(common):
                at = np.minimum(np.searchsorted(common, code), len(common) - 1)
                late = common[at] == code
                code = np.where(late, code | _COMMON_BIT, code)
                order = np.lexsort((code, of))
                code, of = code[order], of[order]
            rank = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            first = rank <= size[of] // 4
            code, own = code[first], np.array(ids, np.int64)[of[first]]
            part = code % parts
            order = np.argsort(part, kind="stable")
            part, code, own = part[order], code[order], own[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.record_batch([pa.array(some, pa.int32()), *(pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()) for x in (code, own))], ["part", "tokens", "sets"])

    def meet(table: pa.Table) -> pa.Table:
        token, own = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column(c)]) for c in ("tokens", "sets"))
        order = np.lexsort((own, token))
        token, own = token[order], own[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
        token, own = token[new], own[new]
        _, which, n = np.unique(token, return_inverse=True, return_counts=True)
        n = n[which]
        return pa.table([pa.array(x[n > 1]) for x in (token, own, n)], names=["token", "set", "sets"])

    return docs.mapInArrow(run, "part int, tokens binary, sets binary").groupBy("part").applyInArrow(meet, "token long, set long, sets long")


def qualifying(firsts: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, group, bucket) of every member, and of every query whose bound a group meets."""
    per_set = Window.partitionBy("set")
    rows = (
        firsts.withColumn("group", F.max(F.struct("sets", "token")).over(per_set)["token"])
        .join(sets.select("set", "n"), "set")
        .select("token", "set", "n", "group", F.floor(F.log(GROWTH, F.col("n"))).cast("int").alias("bucket"))
    )
    rows = written(rows)
    matrix = rows.groupBy("token", "group", "bucket").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    met = (
        rows.select("token", "set", "n").join(matrix, "token").where((F.col("most") * 4 >= F.col("n") * 3) & (F.col("least") * 3 <= F.col("n") * 4))
        .groupBy("set", "n", "group", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("least").alias("least"))
    )
    rest = F.col("n") - F.floor(F.col("n") / 4) - 1
    smallest = F.greatest("least", F.ceil(F.col("n") * 3 / 4))
    queries = met.where((F.col("rows") + rest) * 7 >= (F.col("n") + smallest) * 3)
    return rows.select("set", "group", "bucket").distinct(), queries.select("set", "group", "bucket")


def _short(code: np.ndarray) -> bytes:
    """Six bytes of each shingle: sets of n shingles then agree in one too many once in 2**48 / n**2 pairs."""
    return code.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def _linked(sets: list[np.ndarray], member: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Whether each member and query link, as a matrix of booleans."""
    m, q = len(member), len(query)
    size = np.array(list(map(len, sets)))
    if m * q <= 16:
        both = np.array([[len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in query] for a in member])
    else:
        _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = n[token] > 1
        number = np.cumsum(n > 1) - 1
        token, of = number[token[keep]], np.repeat(np.arange(len(sets)), size)[keep]
        order = np.argsort(token, kind="stable")
        token, of = token[order], of[order]
        both, width = np.zeros((m, q), np.float32), max(64, min(4096, (8 << 20) // len(sets)))
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            a, b = np.searchsorted(token, [lo, lo + width])
            has = np.zeros((len(sets), width), np.float32)
            has[of[a:b], token[a:b] - lo] = 1
            both += has[member] @ has[query].T
    return both * 7 >= (size[member][:, None] + size[query][None, :]) * 3


def _spanning(name: np.ndarray, member: np.ndarray, query: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that tie each set of a block to the smallest name of its part. linked: rows are the members, columns the queries."""
    label, big = name.copy(), np.iinfo(np.int64).max
    while True:
        was = label.copy()
        label[query] = np.minimum(label[query], np.where(linked, label[member][:, None], big).min(axis=0, initial=big))
        label[member] = np.minimum(label[member], np.where(linked, label[query][None, :], big).min(axis=1, initial=big))
        if (label == was).all():
            return [(a, b) for a, b in zip(name.tolist(), label.tolist(), strict=True) if a != b]


def _open(table: pa.Table) -> pa.Table:
    keys = [np.asarray(table.column(c)) for c in ("group", "bucket", "block", "chunk")]
    member, query, name = (np.asarray(table.column(c)) for c in ("member", "query", "doc_id"))
    order = np.lexsort((name, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    tokens, edges = table.column("tokens"), []
    for own in np.split(order, np.flatnonzero(new)[1:]):
        m, q = np.flatnonzero(member[own]), np.flatnonzero(query[own])
        if len(own) < 2 or not len(m) or not len(q):
            continue
        sets = [_long(tokens[int(i)].as_py()) for i in own]
        edges += _spanning(name[own], m, q, _linked(sets, m, q))
    release()
    a, b = zip(*set(edges), strict=True) if edges else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between the smallest doc_ids of linked sets: a spanning forest of the links. sets: (set, n, doc_id)."""
    parts = max(1, -(-text_bytes(docs) // PART_TEXT_BYTES))
    members, queries = qualifying(shared_firsts(docs, common_shingles(docs), parts), sets)
    queries = written(queries)
    key = ["group", "bucket"]
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("m")).join(queries.groupBy(key).agg(F.count(F.lit(1)).alias("q"), F.max("set").alias("any")), key)
    alone = members.join(sizes.where("m = 1 and q = 1"), key).where("set = any").select(*key)  # a group that only its one member asks for
    sizes = sizes.join(alone, key, "left_anti").select(*key, F.ceil(F.col("m") / MEMBERS).cast("int").alias("blocks"), F.ceil(F.col("q") / QUERIES).cast("int").alias("chunks"))
    both = members.select("set", *key, F.lit(True).alias("member"), F.lit(False).alias("query")).unionByName(queries.select("set", *key, F.lit(False).alias("member"), F.lit(True).alias("query"))).join(sizes, key)
    pick = lambda n: F.array(F.pmod(F.xxhash64("set"), F.col(n)).cast("int"))
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    ship = (
        both.withColumn("block", F.explode(F.when(F.col("member"), pick("blocks")).otherwise(spread("blocks"))))
        .withColumn("chunk", F.explode(F.when(F.col("query"), pick("chunks")).otherwise(spread("chunks"))))
        .groupBy(*key, "block", "chunk", "set").agg(F.max("member").alias("member"), F.max("query").alias("query"))
    )
    ship = written(ship.join(sets, "set"))
    need = ship.select("doc_id").distinct()
    size = ship.agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("docs")).first()
    shards = max(1, -(-8 * int(size["n"] or 0) // OPEN_BYTES))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(need, "doc_id", 32 * size["docs"], MOST_BITS))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(wanted.value, np.array(batch.column("doc_id").to_pylist(), np.int64))))
            for part, code, at in shingle_sets([batch]):
                own = _set_ids(code, at)
                yield pa.record_batch([part.column("doc_id"), pa.array(own, pa.int64()), pa.array([_short(code[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "set", "tokens"])

    # a row of the wanted doc_id and set; others that the bitmap let through find no partner
    loaded = docs.mapInArrow(load, "doc_id long, set long, tokens binary")
    rows = ship.join(loaded.hint("merge"), ["doc_id", "set"])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(*key, "block", "chunk"), F.lit(shards)))
    return rows.select("shard", *key, "block", "chunk", "member", "query", "doc_id", "tokens").groupBy("shard").applyInArrow(_open, "a long, b long")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to, itself included."""
    docs = texts(df, key, text)
    table = written(set_table(docs))
    sets = table.where("set is not null and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    roots = components(links(docs.where("doc_id is not null"), sets))
    known = sets.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set", F.coalesce("root", "doc_id").alias("root"))
    return table.join(known, "set", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def op9_token_group_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))

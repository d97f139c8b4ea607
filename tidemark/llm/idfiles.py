"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

Ids are ranked by how often the corpus has them, so that frequent ids are small
numbers. A rank takes 1 to 4 bytes; its length minus one is a 2-bit field of a
control byte, four ranks to a byte, and control bytes are kept apart from data
bytes. A file, all numbers little-endian:

    magic "TMRK" | version u32 | number u64 | documents u64
    doc_id i64, ids u64, control bytes u64, data bytes u64: one array each
    whether the doc_id is known u8: one array
    control bytes of all documents | data bytes of all documents

Documents are parted by ranges of doc_id, so files are numbered in its ascending order,
as their rows are inside. The rank table is one Parquet file beside them. Each task
attempt writes files of its own name; write_id_files() gives a row for each file of the
attempts that Spark took, and readers read those alone, so that a task run twice, or
lost half way, neither doubles nor breaks a file.

Defined results: null and empty texts hold the end id alone; rows with one doc_id stay
rows of their own, in the order of their ids; a null doc_id stays null and comes last; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_letters
from tidemark.llm.pieces import Pieces, per_piece
from tidemark.llm.shared import shared_dir, text_bytes, texts, written
from tidemark.llm.words import chunks

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: bytes of text whose ids make about one file
FILE_TEXT_BYTES = 24 << 20
_MAGIC = b"TMRK"
#: per control byte: how many data bytes its four ranks take, and where each of them starts
_FIELD = np.array([[(c >> (2 * k)) & 3 for k in range(4)] for c in range(256)], np.int64) + 1
_TOTAL = _FIELD.sum(axis=1)
_OFFSET = np.cumsum(_FIELD, axis=1) - _FIELD
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray, begins: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document; document i has the ranks begins[i]:begins[i + 1]."""
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    data = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(length.max(initial=0))):
        some = length > k
        data[ends[:-1][some] + k] = (ranks[some] >> np.uint32(8 * k)).astype(np.uint8)
    count = np.diff(begins)
    quads = -(-count // 4)
    edge = np.concatenate([[0], np.cumsum(quads)])
    field = np.zeros(4 * int(edge[-1]), np.uint8)  # a document starts at a control byte of its own
    field[np.arange(len(ranks)) + np.repeat(4 * edge[:-1] - begins[:-1], count)] = length - 1
    field = field.reshape(-1, 4)
    control = field[:, 0] | field[:, 1] << 2 | field[:, 2] << 4 | field[:, 3] << 6
    cut = lambda x, at: [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return cut(control, edge), cut(data, ends[begins])


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks: each control byte is looked up for the places and lengths of its four ranks."""
    c = np.frombuffer(control, np.uint8)
    total = _TOTAL[c]
    at = ((np.cumsum(total) - total)[:, None] + _OFFSET[c]).ravel()[:n]
    octets = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    word = sum(octets[at + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4)) if n else np.zeros(0, np.uint32)
    return word & _MASK[_FIELD[c].ravel()[:n]]


def file_bytes(number: int, keys: list[int | None], counts: list[int], controls: list[bytes], datas: list[bytes]) -> bytes:
    head = _MAGIC + np.array([2], "<u4").tobytes() + np.array([number, len(keys)], "<u8").tobytes()
    ids = np.array([0 if k is None else k for k in keys], "<i8")
    arrays = [ids, *(np.array(x, "<u8") for x in (counts, list(map(len, controls)), list(map(len, datas)))), np.array([k is not None for k in keys], np.uint8)]
    return b"".join([head, *(a.tobytes() for a in arrays), *controls, *datas])


def file_rows(raw: bytes) -> tuple[int, list[tuple[int | None, np.ndarray]]]:
    """A file's number, and (doc_id, ranks) in its order."""
    if raw[:4] != _MAGIC:
        raise ValueError("not a token-id file")
    number, docs = np.frombuffer(raw, "<u8", 2, 8).tolist()
    keys, at = np.frombuffer(raw, "<i8", docs, 24), 24 + 8 * docs
    counts, c, d = np.frombuffer(raw, "<u8", 3 * docs, at).astype(np.int64).reshape(3, -1)
    known, begin = np.frombuffer(raw, np.uint8, docs, at + 24 * docs), at + 25 * docs
    ctl = begin + np.cumsum(c) - c
    dat = begin + int(c.sum()) + np.cumsum(d) - d
    return number, [(int(k) if e else None, unpack(raw[x : x + u], raw[y : y + v], int(n))) for k, e, n, x, u, y, v in zip(keys, known, counts, ctl, c, dat, d, strict=True)]


@lru_cache(maxsize=2)
def _kept(path: str) -> tuple[Pieces, int]:
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    letters = byte_letters()
    special = {i: t.content for i, t in lib.get_added_tokens_decoder().items()}
    size = max(END_ID + 1, 1 + max(lib.get_vocab(with_added_tokens=True).values()))
    octets = np.zeros(size, np.int64)  # of each id
    for token, i in lib.get_vocab(with_added_tokens=True).items():
        octets[i] = len(token.encode()) if i in special or not all(c in letters for c in token) else len(token)

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in lib.encode_batch_fast(texts, add_special_tokens=False)]

    def row(raw: bytes, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        found = ids([raw.decode()])[0]
        counts = per_piece(pieces, octets[found])
        return None if counts is None else (found, counts)

    def alone(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = ids(pieces)
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    return Pieces(row, alone, special.values()), size


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids of each text and its end id, as unsigned 32-bit integers, or 16-bit ones where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = _kept(path)
        kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        for part, raw in chunks(batches):
            numbers, begins = pieces.numbers(raw)
            pieces.learn()
            ids, lo = pieces.ids(numbers, begins)
            ids = np.insert(ids, lo[1:], END_ID).astype(kind)
            lo = lo + np.arange(len(lo))
            yield pa.record_batch([part.column(0), pa.array([ids[a:b].tobytes() for a, b in zip(lo[:-1].tolist(), lo[1:].tolist(), strict=True)], pa.binary()), pa.array([kind.itemsize] * part.num_rows, pa.int32())], ["doc_id", "ids", "width"])
            if pieces.full():
                pieces.clear()

    return docs.mapInArrow(run, "doc_id long, ids binary, width int")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, width = batch.column("ids").to_pylist(), batch.column("width")[0].as_py() if batch.num_rows else 4
    return np.frombuffer(b"".join(raw), f"<u{width}"), np.cumsum([0, *map(len, raw)]) // width


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            own = np.bincount(_ids(batch)[0], minlength=len(total))
            own[: len(total)] += total
            total = own
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    return ids.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def rank_table(counts: DataFrame) -> list[int]:
    """Ids by falling count, ties by id. As many as the vocabulary has at most, so the driver may hold them."""
    return [r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))]


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_id_files(df: DataFrame, folder: str, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write df's ids under folder (a URI that all executors reach): a written table of (number, documents, ids, file), a row for each file."""
    spark, path = df.sparkSession, path or public_tokenizers.path(VOCABULARY)
    docs = texts(df, key, text)
    ids = written(encoded(docs, path))
    by_rank = rank_table(id_counts(ids))
    spark.createDataFrame(pd.DataFrame({"id": np.array(by_rank, np.int64), "rank": np.arange(len(by_rank))}), "id long, rank long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(1 + max(by_rank, default=0), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank_of)
    most = FILE_TEXT_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number, size = ranks.value, TaskContext.get().partitionId() << 24, 0
        keys, counts, controls, datas = [], [], [], []

        def put() -> pa.RecordBatch:
            where, at = _place(folder)
            name = f"{number:015d}-{uuid.uuid4().hex}.ids"
            where.create_dir(posixpath.join(at, "ids"), recursive=True)
            with where.open_output_stream(posixpath.join(at, "ids", name)) as f:
                f.write(file_bytes(number, keys, counts, controls, datas))
            row = [[number], [len(keys)], [sum(counts)], [name]]
            for x in (keys, counts, controls, datas):
                x.clear()
            return pa.record_batch([pa.array(x) for x in row], ["number", "documents", "ids", "file"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own, begins = _ids(part)
                control, data = pack(table[own], begins)
                keys += part.column(0).to_pylist()
                counts += np.diff(begins).tolist()
                controls += control
                datas += data
                size += sum(map(len, data))
                if size > most:  # a range of very many rows of one doc_id
                    yield put()
                    number, size = number + 1, 0
        if keys:
            yield put()

    files = max(1, -(-text_bytes(docs) // FILE_TEXT_BYTES))
    order = F.col("doc_id").asc_nulls_last()
    placed = ids.repartitionByRange(files, order).sortWithinPartitions(order, "ids")
    return written(placed.mapInArrow(write, "number long, documents long, ids long, file string"))


def read_id_files(folder: str, files: DataFrame) -> DataFrame:
    """number, place (in the file), doc_id, within (ids before it in the file), n_tokens, ids (little-endian unsigned 32-bit). files: as write_id_files() gives them."""
    spark = files.sparkSession
    ranked = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()  # one row for each id of the vocabulary at most
    by_rank = spark.sparkContext.broadcast(np.array([r["id"] for r in ranked], "<u4"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = by_rank.value
        for batch in batches:
            for raw in batch.column(0):
                number, rows = file_rows(raw.as_py())
                within = 0
                for at in range(0, len(rows), 500):
                    part = rows[at : at + 500]
                    n = np.array([len(r) for _, r in part], np.int64)
                    before = within + np.cumsum(n) - n
                    within += int(n.sum())
                    yield pa.record_batch(
                        [pa.array([number] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int64()), pa.array([k for k, _ in part], pa.int64()), pa.array(before), pa.array(n), pa.array([table[r].tobytes() for _, r in part], pa.binary())],
                        ["number", "place", "doc_id", "within", "n_tokens", "ids"],
                    )

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(f"{folder}/ids").withColumn("file", F.element_at(F.split("path", "/"), -1))
    return raw.join(files.select("file"), "file", "left_semi").select("content").mapInArrow(read, "number long, place long, doc_id long, within long, n_tokens long, ids binary")


def op4_ranked_id_files(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    files = write_id_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # one row for each file
    before = files.select("number", F.coalesce(F.sum("ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = read_id_files(folder, files).select("number", "doc_id", "within", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(before, "number").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")

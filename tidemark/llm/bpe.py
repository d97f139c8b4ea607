"""Byte-level BPE with a pair occurrence index, and decoding.

The merges of a batch of pre-tokens run together. An index maps each pair that
has a rank to all its positions. The lowest rank that has positions is applied to
all of them at once; the pairs to the left and right of each merge then enter the
lists of their own ranks. A merge only makes pairs of higher rank, so that each
rank is visited once, in ascending order, and the ids are those of greedy BPE.

Defined results: null and empty texts have no ids; repeated rows each give a row;
an empty table gives none; other columns are ignored. A special token's string in
a text becomes its id, as in the public library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from tidemark.llm.pieces import Pieces, Pretokens
from tidemark.llm.shared import texts
from tidemark.llm.words import chunks, release

VOCABULARY = "byte_bpe_50k.json"
#: text of one batch of merges
BATCH_BYTES = 3 << 19
#: pieces that a worker remembers from batch to batch
MOST_PIECES = 120_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBpe:
    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pretokens = Pretokens(regex.compile(public_tokenizers.PATTERN), self.special, self.merge)
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        key = (self.left << 32) | self.right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it has none."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def merge(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and how many each has."""
        if not pretokens:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = [t.encode() for t in pretokens]
        buf = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(size + 1) - 1
        sym = self.byte_id[buf]
        sym[end] = -1
        n = len(sym)
        before, after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        before[0], after[-1] = n - 1, n - 1  # the last symbol is a border
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[after[at]])
            known = rank >= 0
            at, rank = at[known], rank[known]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(sym >= 0))
        while active:
            r = heapq.heappop(active)
            a, b, c = self.left[r], self.right[r], self.made[r]
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[(sym[at] == a) & (sym[after[at]] == b)]  # others have been merged away
            if len(at) > 1:
                at = np.unique(at)
                if a == b:  # of overlapping ones, the left comes first
                    keep, gone = [], -1
                    for p in at.tolist():
                        if p != gone:
                            keep.append(p)
                            gone = int(after[p])
                    at = np.array(keep)
            if not len(at):
                continue
            dead = after[at]
            sym[at], sym[dead] = c, -2
            beyond = after[dead]
            after[at], before[beyond] = beyond, at
            enter(np.concatenate([before[at], at]))
        live = sym >= 0
        return sym[live], np.diff(np.concatenate([[0], np.cumsum(live)[end]]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _kept(path: str) -> tuple[PairIndexBpe, Pieces]:
    bpe = PairIndexBpe(path)
    release()  # what reading the vocabulary took
    return bpe, Pieces(bpe.pretokens.row, bpe.pretokens.alone, bpe.special, MOST_PIECES)


def encode_and_decode(df: DataFrame, path: str | None = None, batch_bytes: int = BATCH_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, the sha256 of the ids as little-endian unsigned 32-bit integers, and of the decoded text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = _kept(path)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pieces.learn()
            for keys, numbers, begins in held:
                ids, at = pieces.ids(numbers, begins)
                n, a, b = [], [], []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = ids[lo:hi]
                    n.append(hi - lo)
                    a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(own.tolist()).encode()).hexdigest())
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            held.clear()
            if pieces.full():
                pieces.clear()

        size = 0
        for part, raw in chunks(batches):
            held.append((part.column(0).to_pylist(), *pieces.numbers(raw)))
            size += sum(map(len, raw))
            if size > batch_bytes:
                yield from flush()
                size = 0
        yield from flush()

    return texts(df, key, text).mapInArrow(run, SCHEMA)


def op8_pair_index_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Texts as pieces that a byte-level BPE encodes one by one, kept with their ids in each Python worker.

A piece starts at a space that stands between two characters of which neither is white
space of any script, and neither belongs to a special token. Such a space always starts
a pre-token, so encoding piece by piece gives what encoding the text gives. Pieces are
cut and looked up for many texts at once; only those not yet known are encoded, a long
row of them in one call. Should a tokenizer not keep to the rule, so that a token crosses
a border of pieces in a row, the pieces of that row are encoded one by one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable

import numpy as np

from tidemark.llm.words import codes_between

#: pieces that a worker remembers at most
MOST_PIECES = 700_000
#: white space of one byte, and the first bytes of characters that may be white space
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_RISKY = _WHITE | _LEADS

Encoded = tuple[np.ndarray, np.ndarray]


class _Index(dict):
    """Pre-token to its number."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = i = len(self)
        self.new.append(key)
        return i


def cut(texts: list[bytes], special: re.Pattern[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row, where pieces begin (and the last ends), and the first piece of each text (and the end)."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    begins = data == 0x20
    before = _WHITE[data]  # bytes that may end white space
    before[1:] |= data[:-1] == 0xC2
    before[2:] |= _LEADS[data[:-2]]
    begins[1:] &= ~before[:-1]
    begins[:-1] &= ~_RISKY[data[1:]]
    begins[at[1:][at[1:] > 0] - 1] = False  # a space that ends a text
    for m in special.finditer(joined) if special else ():
        begins[max(0, m.start() - 1) : m.end() + 1] = False
    begins[at[:-1][np.diff(at) > 0]] = True
    start = np.append(np.flatnonzero(begins), len(data))
    return data, start, np.searchsorted(start[:-1], at)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start[i] : start[i] + size[i]] for each i of which, in a row, and where each begins (and the last ends)."""
    lens = size[which]
    ends = np.concatenate([[0], np.cumsum(lens)])
    return flat[np.repeat(start[which] - ends[:-1], lens) + np.arange(ends[-1])], ends


def per_piece(piece_size: np.ndarray, token_size: np.ndarray) -> np.ndarray | None:
    """How many of the tokens in a row each piece has, by their sizes; None if a token crosses a border of pieces."""
    ends = np.concatenate([[0], np.cumsum(token_size)])
    border = np.concatenate([[0], np.cumsum(piece_size)])
    at = np.searchsorted(ends, border)
    return None if (ends[np.minimum(at, len(ends) - 1)] != border).any() else np.diff(at)


def any_of(special: Iterable[str]) -> re.Pattern[bytes] | None:
    """A pattern of the special tokens, the longest first."""
    found = sorted((t.encode() for t in special), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, found))) if found else None


class Pretokens:
    """Ids of pieces, by their distinct pre-tokens. tokens: ids of a list of pre-tokens in a row, and how many each has."""

    def __init__(self, pattern, special: dict[str, int], tokens: Callable[[list[str]], Encoded]) -> None:
        self.findall, self.special, self.tokens = pattern.findall, special, tokens
        self.parts = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _split(self, text: str) -> list[str]:
        if not self.parts or not self.parts.search(text):
            return self.findall(text)
        return [t for part in self.parts.split(text) for t in ([part] if part in self.special else self.findall(part))]

    def row(self, raw: bytes, size: np.ndarray) -> Encoded | None:
        own = self._split(raw.decode())
        counts = per_piece(size, np.fromiter((len(t.encode()) for t in own), np.int64, len(own)))
        return None if counts is None else self._ids(own, counts)

    def alone(self, pieces: list[str]) -> Encoded:
        own = [self._split(p) for p in pieces]
        return self._ids([t for p in own for t in p], np.fromiter(map(len, own), np.int64, len(own)))

    def _ids(self, pretokens: list[str], counts: np.ndarray) -> Encoded:
        index = _Index()
        numbers = np.fromiter(map(index.__getitem__, pretokens), np.int64, len(pretokens))
        plain = [t for t in index.new if t not in self.special]
        flat, size = self.tokens(plain)
        flat, size = np.append(flat, [*self.special.values()]).astype(np.int32), np.append(size, np.ones(len(self.special), np.int64)).astype(np.int64)
        of = np.zeros(len(index.new), np.int64)
        of[[t not in self.special for t in index.new]] = np.arange(len(plain))
        for k, t in enumerate(self.special):
            if t in index:
                of[index[t]] = len(plain) + k
        ids, ends = gather(flat, np.cumsum(size) - size, size, of[numbers])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


class Pieces:
    """row: ids of pieces in a row, of given sizes in bytes, and how many each has, or None. alone: the same of a list of pieces.

    A piece is known by a 64-bit code of its bytes. most bounds a worker's memory, and with it
    the pairs of pieces that codes could confuse: about most**2 / 2**65 of a memory would.
    """

    def __init__(self, row: Callable[[bytes, np.ndarray], Encoded | None], alone: Callable[[list[str]], Encoded], special: Iterable[str] = (), most: int = MOST_PIECES) -> None:
        self.row, self.alone, self.special, self.most = row, alone, any_of(special), most
        self.risky = _RISKY.copy()
        self.risky[[t.encode()[0] for t in special]] = True  # before a special token the space is the end of what goes before
        self.clear()

    def clear(self) -> None:
        self.code, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # of known pieces, by code
        self.rows: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        self.singles: list[tuple[str, int]] = []
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.done = 0

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers of all texts, and where each text's begin. Call learn() before ids()."""
        data, start, first = cut(texts, self.special)
        if len(start) < 2:
            return np.zeros(0, np.int32), first
        code, which, of = np.unique(codes_between(data, start[:-1], start[1:]), return_index=True, return_inverse=True)
        at = np.searchsorted(self.code, code)
        known = np.zeros(len(code), bool)
        some = at < len(self.code)
        known[some] = self.code[at[some]] == code[some]
        number = np.zeros(len(code), np.int32)
        number[known] = self.number[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            number[new] = self.done + np.arange(len(new))
            self._hold(data, start, which[new], number[new])
            self.code, self.number = np.insert(self.code, at[new], code[new]), np.insert(self.number, at[new], number[new])
            self.done += len(new)
        return number[of], first

    def _hold(self, data: np.ndarray, start: np.ndarray, which: np.ndarray, number: np.ndarray) -> None:
        size = np.diff(start)
        after = data[np.minimum(start[which] + 1, len(data) - 1)]
        joins = (data[start[which]] == 0x20) & (size[which] > 1) & ~self.risky[after]
        if joins.any():
            self.rows.append((gather(data, start, size, which[joins])[0].tobytes(), size[which[joins]], number[joins]))
        for w, n in zip(which[~joins].tolist(), number[~joins].tolist(), strict=True):
            self.singles.append((data[start[w] : start[w + 1]].tobytes().decode(), n))

    def learn(self) -> None:
        if self.done > len(self.start):
            self.start, self.size = (np.resize(x, 2 * self.done) for x in (self.start, self.size))
        if self.rows:
            raw, size, number = (f(x) for f, x in zip((b"".join, np.concatenate, np.concatenate), zip(*self.rows, strict=True), strict=True))
            at = np.concatenate([[0], np.cumsum(size)]).tolist()
            found = self.row(raw, size) or self.alone([raw[a:b].decode() for a, b in itertools.pairwise(at)])
            self._keep(*found, number)
        if self.singles:
            texts, number = zip(*self.singles, strict=True)
            self._keep(*self.alone(list(texts)), np.array(number))
        self.rows, self.singles = [], []

    def _keep(self, ids: np.ndarray, counts: np.ndarray, number: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.resize(self.flat, need + need // 2)
        self.flat[self.used : need] = ids
        self.size[number] = counts
        self.start[number] = self.used + np.cumsum(counts) - counts
        self.used = need

    def ids(self, numbers: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin."""
        ids, ends = gather(self.flat, self.start, self.size, numbers)
        return ids, ends[begins]

    def full(self) -> bool:
        return self.done > self.most

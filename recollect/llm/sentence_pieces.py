"""Encoding and decoding with the merge-type vocabulary of a SentencePiece model.

A text becomes symbols of one character; an agenda holds every pair of adjacent symbols that spell a piece, the best score
first and the leftmost of equal ones. The first pair is joined, the pairs it makes with its neighbours enter the agenda, and
entries whose symbols have changed since are passed over. What is no piece in the end falls back to its UTF-8 bytes.

No piece spans a word start (a run of word marks after another character) or a character that no piece holds, nor, in most
vocabularies, the place between a letter and another sign (which is looked up). So a text is cut there first and each worker keeps the ids of segments it has met (at most HELD). The library encodes each new segment
too, a batch at a time, and a difference stops the job.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _text as T

#: The word mark that stands for a blank, and the numbers of the piece types in model files (fixed values).
MARK, NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = "▁", 1, 2, 4, 5, 6
#: Segments of at most KEPT characters are kept, HELD of them.
HELD, KEPT = 1_000_000, 64
ROWS = 256
#: Bits of a symbol's number and of a place; the number of a symbol that its left neighbour has taken in.
WIDE, SYMBOL, PLACE, GONE = 20, (1 << 20) - 1, (1 << 40) - 1, -2


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"={len(ids)}i", *ids)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """The pieces of a model file and the segments met so far."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}
        self.bytes, self.unknown = [0] * 256, 0
        normal, trainer = {}, {}
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        n = 0
        for number, value in message:
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece.get(1, b"").decode(), piece.get(3, NORMAL)
                if kind == NORMAL:
                    self.ids[text], self.cost[text] = n, -struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                elif kind == BYTE:
                    self.bytes[int(text[3:5], 16)] = n
                elif kind == UNKNOWN:
                    self.unknown = n
                elif kind in (USER_DEFINED, UNUSED):
                    raise ValueError("user-defined and unused pieces are not supported")
                n += 1
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("a merge-type vocabulary with byte fallback is needed")
        if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1) or trainer.get(24):
            raise ValueError("only the identity normalisation, with a word mark in front and blanks kept, is supported")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that span a word start are not supported")
        held = set().union(*self.ids)
        self.apart = next(c for c in "\n\r\t\x01\x02\x03" if c not in held)
        letters = {c for c in held if c.isalpha()}
        if letters and all(len({c in letters for c in p.lstrip(MARK)}) < 2 for p in self.ids):
            own = re.escape("".join(sorted(letters)))
            parts = (f"[{own}]", f"[^{own}{MARK}{self.apart}]")
        else:
            parts = (f"[^{MARK}{self.apart}]",)
        self.cut = re.compile("|".join([self.apart, *(f"{MARK}*{p}+" for p in parts), f"{MARK}+"]))
        self.met: dict[str, bytes] = {}
        self.before = _packed(self.library.encode(self.apart))
        #: Symbols are numbered: the pieces, then single characters that only occur inside pieces. joins: two symbols to (rank, symbol).
        names = [*self.ids, *sorted(held.difference(self.ids))]
        self.number = {name: k for k, name in enumerate(names)}
        self.spelling = [_packed([self.ids[x]]) if x in self.ids else self._bytes(x) for x in names]
        ranks = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
        self.joins = {}
        for whole, c in self.cost.items():
            for k in range(1, len(whole)):
                left, right = self.number.get(whole[:k]), self.number.get(whole[k:])
                if left is not None and right is not None:
                    self.joins[left << WIDE | right] = ranks[c] << WIDE | self.number[whole]

    def _bytes(self, char: str) -> bytes:
        return _packed([self.bytes[b] for b in char.encode()])

    def merge(self, segment: str) -> bytes:
        """The ids of one segment, by the agenda; its entries are rank, then place of the left symbol."""
        number, joins, n = self.number, self.joins, len(segment)
        symbols = [number.get(c, -1) for c in segment]
        agenda = []
        for i in range(n - 1):
            found = joins.get(symbols[i] << WIDE | symbols[i + 1])
            if found is not None:
                agenda.append(found >> WIDE << 40 | i)
        if agenda:
            before, after = list(range(-1, n)), list(range(1, n + 2))
            symbols.append(-1)
            heapq.heapify(agenda)
            while agenda:
                entry = heapq.heappop(agenda)
                i = entry & PLACE
                j, left = after[i], symbols[i]
                if left == GONE or j >= n:
                    continue
                found = joins.get(left << WIDE | symbols[j])
                if found is None or found >> WIDE != entry >> 40:  # its symbols have changed
                    continue
                symbols[i] = new = found & SYMBOL
                symbols[j] = GONE
                after[i] = k = after[j]
                before[k] = i
                found = joins.get(new << WIDE | symbols[k])
                if found is not None:
                    heapq.heappush(agenda, found >> WIDE << 40 | i)
                h = before[i]
                if h >= 0:
                    found = joins.get(symbols[h] << WIDE | new)
                    if found is not None:
                        heapq.heappush(agenda, found >> WIDE << 40 | h)
            symbols.pop()
        spelling = self.spelling
        return b"".join([spelling[s] if s >= 0 else self._bytes(segment[i]) for i, s in enumerate(symbols) if s != GONE])

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str], check: bool = True) -> list[np.ndarray]:
        """Ids of each text. check: the library encodes each segment not met before too; ValueError where it differs."""
        parts = [self.segments(t) for t in texts]
        if len(self.met) > HELD:
            self.met.clear()
        met = self.met
        new = {s: self.merge(s) for s in set(chain.from_iterable(parts)).difference(met)}
        if check and new:
            names = list(new)
            for name, ids in zip(names, self.library.encode([self.apart + s.replace(MARK, " ") for s in names], num_threads=1)):
                if _packed(ids) != self.before + new[name]:
                    raise ValueError(f"the library encodes {name[:80]!r} differently")
        met.update(new)
        out = [np.frombuffer(b"".join([met[s] for s in p]), np.int32) for p in parts]
        for s in new:
            if len(s) > KEPT:
                del met[s]
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    """Once for each Python worker."""
    return Vocabulary(path)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, check: bool = True) -> DataFrame:
    """doc_id, ids (array of int) of each whole text, without begin or end ids, and decoded, what the ids decode to.

    A null or empty text has no ids and decodes to an empty text; a null id is kept; repeated rows give repeated results;
    an empty table gives no rows; other columns are ignored. Texts are handled ROWS at a time. model is a path that every
    executor can read.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                ids = v.encode([t or "" for t in b.column(1).slice(k, ROWS).to_pylist()], check)
                back = v.library.decode([x.tolist() for x in ids], num_threads=1)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, ROWS), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])
            T.give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and text of each row of ids. Null or no ids give an empty text; an id outside the vocabulary stops the job."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            text = v.library.decode([x or [] for x in b.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")

"""Operator 5, packing: minimum bin slack.

Each document becomes token ids and an end id. Whole windows are cut off long documents; what remains of each (shorter
than a window) waits in a buffer with its length. A window takes the longest piece that waits and then the multiset of
waiting lengths that comes closest to filling it, found by a subset-sum dynamic programme over a bit set (one big integer
a length, bits are reachable sums), with the counts taken back from the last bit. Where no multiset fills the window, the
smallest piece that overflows it is cut and its rest waits on. At a partition's end the last window is cut into powers
of two, which need no padding. Pieces never leave the task that made their ids, so nothing is shuffled; a task holds at
most `buffer` pieces shorter than a window and one document. A lost task makes the same sequences again.

Null and empty texts have only the end id. Rows with the same key are documents of their own. A very long text is one
document, whose ids are in memory at a time. An empty table has no pieces. Columns other than key and text take no part,
whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common as C

WINDOW = 4096
END = 2
BUFFER = 1024
#: Words whose ids a worker keeps.
CACHE = 2_000_000
#: White space to str.split(), but not to tokenizers.
_ODD = re.compile("[\x1c-\x1f]")
_BREAK = re.compile("[ \t\r\n]+")
#: Letters and then ASCII signs without apostrophes: pre-tokenizers part these, so each side has ids of its own.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


#: Beyond the Latin letters that are normal forms and have one small letter each.
_LATIN = "\u0250"
#: The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for U+0100 and on, in order.
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in _SELF)}


class WordIds(dict):
    """Ids of a word, as bytes of little-endian 32-bit numbers; for tokenizers that drop white space and case, part letters
    from signs and never look across either border. Words of Latin small letters go to the model as they are."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        if word.isalpha() and max(word) < _LATIN and (low := word.lower()).isalpha():
            if low == word:
                plain = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
                ids = [t.id for t in self.model.tokenize(plain)]
                got = struct.pack(f"<{len(ids)}I", *ids)
            else:
                got = self[low]
        elif (m := _MARKED.fullmatch(word)) and m[1].isalpha():
            got = self[m[1]] + self[m[2]]
        else:
            got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        ws = [w for w in _BREAK.split(text) if w] if _ODD.search(text) else text.split()
        return b"".join(map(self.__getitem__, ws))


_TOKENIZERS: dict[str, WordIds] = {}


def fill(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """The multiset of lengths (ascending, each as often as counts says) whose sum is largest, at most room."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in reversed(lengths):
        if length > room:
            continue
        left, take = counts[length], 1
        while left and not reach >> room & 1:
            k = min(take, left)
            steps.append((length, k, reach))
            reach = (reach | reach << length * k) & full
            left, take = left - k, take * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * k
            total -= length * k
    return out


class Packer:
    """Waiting pieces by length, and the sequences that they fill."""

    def __init__(self, window: int):
        self.window, self.lengths, self.pieces, self.n = window, [], {}, 0

    def add(self, piece: tuple) -> None:
        """piece: (document, start, length, ...)"""
        if piece[2] not in self.pieces:
            insort(self.lengths, piece[2])
            self.pieces[piece[2]] = []
        self.pieces[piece[2]].append(piece)
        self.n += 1

    def take(self, length: int) -> tuple:
        got = self.pieces[length].pop()
        if not self.pieces[length]:
            del self.pieces[length]
            self.lengths.pop(bisect_left(self.lengths, length))
        self.n -= 1
        return got

    def next(self) -> list[tuple]:
        """Pieces of one full window, or all that wait if they are less."""
        out = [self.take(self.lengths[-1])]
        room = self.window - out[0][2]
        for length in fill(room, self.lengths, {k: len(v) for k, v in self.pieces.items()}):
            out.append(self.take(length))
            room -= length
        if room and self.n:
            doc, start, length = self.take(self.lengths[bisect_left(self.lengths, room)])
            out.append((doc, start, room))
            self.add((doc, start + room, length - room))
        return out


def binary(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """Cuts the pieces into sequences whose lengths are the powers of two in their sum."""
    left = sum(p[2] for p in pieces)
    queue = list(reversed(pieces))
    while left:
        room, out = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            doc, start, length = queue.pop()
            if length > room:
                queue.append((doc, start + room, length - room))
            out.append((doc, start, min(length, room)))
            room -= min(length, room)
        yield out


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, end: int = END, buffer: int = BUFFER) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file whose pre-tokenizer splits at white space and drops it.
    """
    C.ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, WordIds(tokenizer))
        packer, sequence = Packer(window), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (k, data), start, length in pieces:
                rows.append((k, start, length, zlib.crc32(memoryview(data)[4 * start : 4 * (start + length)]), len(data) // 4, sequence, offset))
                offset += length
            sequence += 1

        def table() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        last = int(end).to_bytes(4, "little")
        for batch in batches:
            for k, t in zip(batch["k"], batch["t"], strict=True):
                data = (ids.ids(t) if t else b"") + last
                n = len(data) // 4
                for start in range(0, n - window + 1, window):
                    put([((k, data), start, window)])
                if n % window:
                    rest = n // window * window
                    packer.add(((k, data), rest, n - rest))
                while packer.n > buffer:
                    put(packer.next())
                if len(rows) > 20_000:
                    yield table()
        while packer.n:
            got = packer.next()
            if sum(p[2] for p in got) == window:
                put(got)
            else:
                for pieces in binary(got):
                    put(pieces)
        yield table()

    got = docs.selectExpr(f"`{key}` k", f"`{text}` t")
    out = got.mapInPandas(C.lean(run), f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("k", key)
